"""Which contents are known, across micro-batches: keyed state in the state store.

The state holds one small row per content hash (least upload number, its name and kind,
number of copies), so a content that was seen in any earlier micro-batch, before or after a
restart, keeps its document. Contents are hashed where they are read; only hashes and
names are shuffled. For very many contents set the state store to RocksDB
(``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomdex.operators.state import new_id

STATE = ("filename", "kind", "first_seq", "copies")


def upload_facts(uploads: DataFrame) -> DataFrame:
    """``(seq, filename, kind, content_hash)`` of uploads with their content."""
    return uploads.select("seq", "filename", "kind", F.sha2("content", 256).alias("content_hash"))


def start_registry(facts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Register a stream of ``upload_facts`` and stop when all that is there is done.

    Each micro-batch writes the changed state rows to a folder of its own, named by the
    batch number, so one that runs twice writes the same rows.
    """
    state = facts.groupBy("content_hash").agg(
        F.min_by("filename", "seq").alias("filename"),
        F.min_by("kind", "seq").alias("kind"),
        F.min("seq").alias("first_seq"),
        F.count(F.lit(1)).alias("copies"),
    )

    def write(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        state.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def registered(spark: SparkSession, path: str) -> DataFrame:
    """``(content_hash, doc_id, filename, kind, first_seq, copies)``: the last state of
    every content."""
    rows = spark.read.parquet(path)
    last = rows.groupBy("content_hash").agg(F.max_by(F.struct(*STATE), "batch").alias("state"))
    return last.select("content_hash", new_id(F.col("content_hash")).alias("doc_id"), "state.*")
