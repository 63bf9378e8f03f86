"""Texts laid end to end in blocks, and questions about their hashes to all blocks.

Several passes over whole texts, in which a text needs to know which of its hashes
other texts have, shuffle hashes and answers only: the texts are written once to a
table bucketed by block, so answers come back to the block without moving it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.llm.common import maybe_broadcast, partitions, raw_text, staged

BLOCK = "block long, keys binary, offsets binary, body binary"
KEY = ["h1", "h2", "n_bytes"]


def blocks(block_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts laid end to end, with the three numbers that name each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        keys, bodies, held = [], [], 0

        def block() -> pa.RecordBatch:
            offsets = np.cumsum([0, *map(len, bodies)]).astype(np.int64)
            columns = [[number], [np.array(keys, np.int64).tobytes()], [offsets.tobytes()], [b"".join(bodies)]]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)],
                ["block", "keys", "offsets", "body"],
            )

        for batch in batches:
            raw, offsets = raw_text(batch.column("text"))
            whole, ends = raw.tobytes(), offsets.tolist()
            names = list(zip(*(batch.column(c).to_pylist() for c in ("h1", "h2", "n_bytes")), strict=True))
            for k, name in enumerate(names):
                keys.append(name)
                bodies.append(whole[ends[k] : ends[k + 1]])
                held += name[2]
                if held >= block_bytes:
                    yield block()
                    keys, bodies, held, number = [], [], 0, number + 1
        if keys:
            yield block()

    return run


def unpacked(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, offsets, body = (batch.column(c)[row].as_py() for c in ("keys", "offsets", "body"))
    return np.frombuffer(keys, np.int64).reshape(-1, 3), np.frombuffer(offsets, np.int64), np.frombuffer(body, np.uint8)


def parts_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Where each of the 2 ** bits buckets begins in sorted hashes."""
    edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.r_[np.searchsorted(hashes, edges), len(hashes)]


def named(documents: DataFrame) -> DataFrame:
    """Rows with three numbers that tell texts apart (two hashes and the length)."""
    text = F.coalesce("text", F.lit(""))
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(text).alias("h1"),
        F.hash(text).cast("long").alias("h2"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.xxhash64("text").alias("text_hash"),
        text.alias("text"),
    )


def bucket_bits(total_bytes: int, bucket_bytes: int) -> int:
    return max(4, int(total_bytes // bucket_bytes).bit_length())


def write_blocks(documents: DataFrame, least_bytes: int, block_bytes: int) -> tuple[str, DataFrame, int]:
    """The name of a table with a block row for about ``block_bytes`` of the distinct
    texts of at least ``least_bytes``, the texts with copies, and the bytes of all.

    Rows with a null id may bring a text again; nothing relies on single texts.
    """
    spark = documents.sparkSession
    rows = named(documents).filter(F.col("n_bytes") >= least_bytes)
    light = rows.drop("text")
    copies = light.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("keep")).filter("n > 1")
    copies = staged(copies.select(*KEY, "keep"), "copies")
    total = light.agg(F.sum("n_bytes")).first()[0] or 0
    once = rows.join(maybe_broadcast(copies), KEY, "left").filter("keep IS NULL OR doc_id = keep")
    name = f"text_blocks_{uuid.uuid4().hex}"
    buckets = max(partitions(spark), int(total // (32 * block_bytes)) + 1)
    laid = once.select(*KEY, "text").mapInArrow(blocks(block_bytes), BLOCK)
    laid.write.bucketBy(buckets, "block").option("compression", "zstd").saveAsTable(name)
    return name, copies, total


def answered(hashes: DataFrame, bits: int, answer: Callable, name: str) -> DataFrame:
    """(block, ``name``): for every block the answers of the buckets that it asked;
    ``answer`` works on the rows of one bucket and returns (block, bucket, mask)."""
    asked = hashes.repartitionById(1 << bits, "bucket")
    masks = asked.mapInArrow(answer, "block long, bucket int, mask binary")
    return staged(masks.groupBy("block").agg(F.collect_list(F.struct("bucket", "mask")).alias(name)), name)
