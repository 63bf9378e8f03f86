"""Uploads as they arrive: every micro-batch runs the batch ingestion.

The query's checkpoint is the durable record of which files are done, so a
restart goes on where it stopped; documents are keyed by their content, so a
micro-batch that runs twice writes the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomdex.plans.embedding import Embedder
from loomdex.plans.ingest import Ingested, ingest
from loomdex.settings import DEFAULTS, Settings
from loomdex.sources.files import classify_uploads, stream_files
from loomdex.sources.parsers import PARSERS, Block


def start_upload_stream(
    spark: SparkSession,
    path: str,
    checkpoint: str,
    write: Callable[[Ingested, DataFrame, int], None],
    *,
    existing: Callable[[], DataFrame | None] = lambda: None,
    make_embedder: Callable[[], Embedder] | None = None,
    settings: Settings = DEFAULTS,
    parsers: Mapping[str, Callable[[bytes], list[Block]]] = PARSERS,
) -> StreamingQuery:
    """Ingest all files that are there now and stop.

    ``write`` gets the ingested tables, the rejected files and the batch id, and
    must overwrite by batch id; ``existing`` returns the documents known so far;
    ``parsers`` is that of ``ingest``.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        files = classify_uploads(batch, settings)
        rejected = files.filter(F.col("rejected").isNotNull()).select("path", "filename", "length", "rejected")
        accepted = files.filter(F.col("rejected").isNull())
        uploads = accepted.select(
            F.struct("modificationTime", "path").alias("seq"), "filename", "kind", "content"
        )
        write(ingest(uploads, existing(), make_embedder, settings, parsers), rejected, batch_id)

    return (
        stream_files(spark, path)
        .writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
