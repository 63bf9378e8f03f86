"""Files -> documents, chunks and vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomdex.functions.text import heading, paragraphs
from loomdex.operators.blocks import normalize_blocks, sheet_lines, table_text
from loomdex.operators.chunking import chunk_blocks
from loomdex.operators.local_best import slices
from loomdex.operators.state import register_uploads
from loomdex.plans.embedding import Embedder, embed_texts
from loomdex.session import durable
from loomdex.settings import DEFAULTS, Settings
from loomdex.sources.parsers import PARSERS, Block, NoTextLayer

RAW_BLOCKS = (
    "doc_id STRING, position INT, kind STRING, content STRING, page INT, section STRING, "
    "rows ARRAY<ARRAY<STRING>>, error STRING"
)


@dataclass(frozen=True)
class Ingested:
    documents: DataFrame
    chunks: DataFrame
    vectors: DataFrame | None


def parse_files(files: DataFrame, parsers: Mapping[str, Callable[[bytes], list[Block]]] = PARSERS) -> DataFrame:
    """``(doc_id, kind, content BYTES)`` -> raw blocks, one file at a time.

    A file that cannot be parsed yields one row with the error and no block; it
    never fails the job. The upload limit bounds what a task holds.
    """

    schema = to_arrow_schema(T.StructType.fromDDL(RAW_BLOCKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            for doc_id, kind, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    if kind not in parsers:
                        raise ValueError(f"no parser for {kind}")
                    blocks = parsers[kind](bytes(content))
                    rows = [(doc_id, i, *block, None) for i, block in enumerate(blocks)]
                except NoTextLayer as exc:
                    rows = [(doc_id, None, None, None, None, None, None, str(exc))]
                except Exception as exc:  # noqa: BLE001 - reported per document
                    reason = f"parse: {type(exc).__name__}: {exc}"
                    rows = [(doc_id, None, None, None, None, None, None, reason)]
                columns = zip(*rows, strict=True) if rows else [()] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return files.select("doc_id", "kind", "content").mapInArrow(run, RAW_BLOCKS)


def to_blocks(raw: DataFrame) -> DataFrame:
    """Raw blocks with page texts cut into paragraphs and tables turned into text.

    ``block_no`` numbers the parser's blocks and the paragraphs inside them.
    """
    good = raw.filter(F.col("error").isNull())
    single = F.when(F.col("rows").isNotNull(), table_text(F.col("rows"))).otherwise(F.col("content"))
    parts = (
        F.when(F.col("kind") == "page", paragraphs(F.col("content")))
        .when(F.col("kind") == "sheet", sheet_lines(F.col("rows")))
        .otherwise(F.array(single))
    )
    exploded = good.select(
        "doc_id", "position", "kind", "page", "section", F.posexplode(parts).alias("part", "content")
    )
    is_page = F.col("kind") == "page"
    return exploded.select(
        "doc_id",
        F.struct("position", "part").alias("block_no"),
        F.when(is_page, "text").when(F.col("kind") == "sheet", "table").otherwise(F.col("kind")).alias("kind"),
        "content",
        "page",
        F.when(is_page, heading(F.col("content"))).otherwise(F.col("section")).alias("section"),
    )


def chunk_raw_blocks(raw: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The chunks of parsed files: paragraphs and table texts, without repeated lines,
    cleaned and cut."""
    return chunk_blocks(normalize_blocks(to_blocks(raw)), settings)


def ingest(
    uploads: DataFrame,
    existing: DataFrame | None = None,
    make_embedder: Callable[[], Embedder] | None = None,
    settings: Settings = DEFAULTS,
    parsers: Mapping[str, Callable[[bytes], list[Block]]] = PARSERS,
) -> Ingested:
    """New contents of ``uploads`` (seq, filename, kind, content) through all steps.

    A content already known is not parsed again. A document is published once,
    with its final status: ``indexed``, ``failed`` (no text layer or a parse
    error) or ``embed_failed`` (chunks kept, vectors missing). ``parsers`` has the
    reader of every kind; for pdf the caller adds one to ``PARSERS``.
    """
    registered = register_uploads(uploads, existing).filter("created")
    new = registered.select("first_seq", "doc_id", "kind")
    contents = uploads.select(F.col("seq").alias("first_seq"), "content")
    files = contents.join(new, "first_seq").select("doc_id", "kind", "content")
    raw = durable(parse_files(files, parsers))
    chunks = durable(chunk_raw_blocks(raw, settings))
    counts = chunks.groupBy("doc_id").agg(F.count("*").cast("int").alias("chunks_count"))
    errors = raw.filter(F.col("error").isNotNull()).select("doc_id", F.col("error").alias("parse_error"))
    vectors, embed_errors = None, None
    if make_embedder is not None:
        embedded = durable(
            embed_texts(chunks, make_embedder, id_column="chunk_id", keep_errors=True)
        )
        vectors = embedded.filter(F.col("error").isNull()).drop("error")
        failed = embedded.filter(F.col("error").isNotNull())
        embed_errors = failed.groupBy("doc_id").agg(F.min("error").alias("embed_error"))
    documents = registered.join(errors, "doc_id", "left").join(counts, "doc_id", "left")
    if embed_errors is not None:
        documents = documents.join(embed_errors, "doc_id", "left")
    else:
        documents = documents.withColumn("embed_error", F.lit(None).cast("string"))
    status = (
        F.when(F.col("parse_error").isNotNull(), "failed")
        .when(F.col("embed_error").isNotNull(), "embed_failed")
        .otherwise("indexed")
    )
    return Ingested(
        documents.select(
            "doc_id",
            "filename",
            "content_hash",
            "kind",
            status.alias("status"),
            F.coalesce("chunks_count", F.lit(0)).alias("chunks_count"),
            F.coalesce("parse_error", "embed_error").alias("error"),
        ),
        chunks,
        vectors,
    )
