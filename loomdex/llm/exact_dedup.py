"""Exact dedup over an extendible-hash index kept on shared files.

1. Every task lower-cases A-Z, compares the bytes of its own texts and keeps one
   entry for each distinct text: hash, SHA-256, largest id, rows, bytes.
2. The directory starts with one bucket and doubles while a bucket is overfull;
   splitting needs only the bytes for each hash prefix, a table of at most
   ``2 ** max_depth`` rows that a first pass adds up.
3. A second pass writes the entries to the shared folder, a file for each page of a
   bucket, which is a contiguous range of hashes. A bucket that is overfull at full depth
   (a hot text with many entries) gets overflow pages, dealt by the writing task. The
   index can be opened again (``read_index``).
4. An owner task reads a page's file, chains the entries of a hash and compares bytes
   along the chain. Pages of one bucket meet as small rows of digests.

Cases: null text counts as empty. Rows with a null id are rows of their group; they
stay only if no row of the group has an id. Repeated rows count as rows, and all
rows that carry the id that stays are kept. An empty table gives an empty result.
Columns beside doc_id and text play no part and are not returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.llm.common import ascii_lower, new_folder, raw_text, staged, unstage, with_hash

ENTRY = "hash long, sha string, keep_id long, rows long, bytes long, text binary"


@dataclass(frozen=True)
class IndexSettings:
    bucket_bytes: int = 16 << 20
    max_depth: int = 20
    entry_bytes: int = 64
    flush_bytes: int = 16 << 20


def digests(raw: bytes) -> tuple[int, str]:
    sha = hashlib.sha256(raw)
    return int.from_bytes(sha.digest()[:8], "big", signed=True), sha.hexdigest()


def lowered(batch: pa.RecordBatch) -> Iterator[bytes]:
    raw, offsets = raw_text(batch.column("text"))
    whole = ascii_lower(raw).tobytes()
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield whole[start:end]


def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_hash, sha) of every row."""
    for batch in batches:
        shas = pa.array([digests(raw)[1] for raw in lowered(batch)], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), shas], ["doc_id", "text_hash", "sha"])


def entry_batch(found: dict[bytes, list]) -> Iterator[pa.RecordBatch]:
    items = list(found.items())
    for start in range(0, len(items), 2000):
        part = items[start : start + 2000]
        named = [digests(raw) for raw, _ in part]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([h for h, _ in named], pa.int64()),
                pa.array([s for _, s in named], pa.string()),
                pa.array([keep for _, (keep, _) in part], pa.int64()),
                pa.array([rows for _, (_, rows) in part], pa.int64()),
                pa.array([len(raw) for raw, _ in part], pa.int64()),
                pa.array([raw for raw, _ in part], pa.binary()),
            ],
            ["hash", "sha", "keep_id", "rows", "bytes", "text"],
        )


def merge(entry: list, keep: int | None, rows: int) -> None:
    entry[0] = keep if entry[0] is None else entry[0] if keep is None else max(entry[0], keep)
    entry[1] += rows


def local_entries(flush_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One entry for each distinct text that a task holds; a dictionary of bytes
    compares them. The dictionary is emptied at ``flush_bytes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, list] = {}
        held = 0
        for batch in batches:
            for keep, raw in zip(batch.column("doc_id").to_pylist(), lowered(batch), strict=True):
                if raw in found:
                    merge(found[raw], keep, 1)
                else:
                    found[raw] = [keep, 1]
                    held += len(raw)
            if held > flush_bytes:
                yield from entry_batch(found)
                found, held = {}, 0
        yield from entry_batch(found)

    return run


def directory(weights: dict[int, int], depth: int, capacity: int) -> tuple[np.ndarray, list[int]]:
    """The bucket of every prefix of ``depth`` bits, and the overflow pages of each bucket."""
    sums = np.zeros((1 << depth) + 1, np.int64)
    for prefix, weight in weights.items():
        sums[prefix + 1] = weight
    sums = np.cumsum(sums)
    owner, pages = np.zeros(1 << depth, np.int32), []
    splitting = [(0, 1 << depth)]
    while splitting:
        start, width = splitting.pop()
        weight = int(sums[start + width] - sums[start])
        if weight > capacity and width > 1:
            splitting += [(start + width // 2, width // 2), (start, width // 2)]
        else:
            owner[start : start + width] = len(pages)
            pages.append(max(1, -(-weight // capacity)))
    return owner, pages


def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One page of a bucket: chains of equal hashes, bytes compared along a chain."""
    chains: dict[int, list[tuple[bytes, str, list]]] = {}
    for batch in batches:
        for h, sha, keep, rows, raw in zip(*(batch.column(c).to_pylist() for c in ("hash", "sha", "keep_id", "rows", "text")), strict=True):
            chain = chains.setdefault(h, [])
            for other, _, entry in chain:
                if other == raw:
                    merge(entry, keep, rows)
                    break
            else:
                chain.append((raw, sha, [keep, rows]))
    flat = [(sha, *entry) for chain in chains.values() for _, sha, entry in chain]
    yield pa.RecordBatch.from_arrays(
        [pa.array([x[0] for x in flat], pa.string()), pa.array([x[1] for x in flat], pa.int64()), pa.array([x[2] for x in flat], pa.int64())],
        ["sha", "keep_id", "group_size"],
    )


def local_weights(settings: IndexSettings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The bytes of a task's entries for each hash prefix of the greatest depth."""
    entries = local_entries(settings.flush_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in entries(batches):
            hashes = batch.column("hash").to_numpy().view(np.uint64) >> np.uint64(64 - settings.max_depth)
            prefix, place = np.unique(hashes.astype(np.int64), return_inverse=True)
            weight = np.bincount(place, batch.column("bytes").to_numpy() + settings.entry_bytes, len(prefix)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(prefix), pa.array(weight)], ["prefix", "weight"])

    return run


def build_index(docs: DataFrame, settings: IndexSettings = IndexSettings()) -> str:
    """Write the index of (doc_id, text) to the shared folder; returns its path.

    ``directory`` has the pages of every hash prefix. ``pages`` has a file for each
    page, of the entries of its range of hashes. The texts are read twice, for the
    directory and for the entries, which are thus written once, in their place.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text")
    weights = rows.mapInArrow(local_weights(settings), "prefix long, weight long").groupBy("prefix").agg(F.sum("weight").alias("weight"))
    weights = staged(weights, "dedup-weights")
    total = weights.agg(F.sum("weight")).first()[0] or 0
    depth = min(settings.max_depth, 4 + int(np.ceil(np.log2(max(1, total / settings.bucket_bytes)))))
    at_depth = weights.groupBy(F.shiftright("prefix", settings.max_depth - depth).alias("prefix")).agg(F.sum("weight").alias("weight"))
    owner, pages = directory({r["prefix"]: r["weight"] for r in at_depth.toLocalIterator()}, depth, settings.bucket_bytes)
    unstage(weights)
    first_page = np.concatenate([[0], np.cumsum(pages)]).astype(np.int64)
    # At most 2 ** max_depth rows of three numbers.
    slots = spark.createDataFrame(
        [(p, int(first_page[b]), int(pages[b])) for p, b in enumerate(owner.tolist())], "prefix long, first_page long, pages long"
    )
    path = new_folder(spark, "dedup-index")
    slots.write.parquet(f"{path}/directory")
    # Entries of one hot text come from many tasks, which deal them over its pages.
    entries = rows.mapInArrow(local_entries(settings.flush_bytes), ENTRY).withColumn("task", F.spark_partition_id())
    placed = entries.join(F.broadcast(slots), F.shiftrightunsigned("hash", 64 - depth) == F.col("prefix"))
    page = (F.col("first_page") + F.pmod(F.col("task"), F.col("pages"))).cast("int")
    placed = placed.select(page.alias("page"), "hash", "sha", "keep_id", "rows", "text")
    placed.repartitionById(int(first_page[-1]), "page").write.parquet(f"{path}/pages")
    return path


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(sha, keep_id, group_size) of every distinct text of an index: owner tasks open
    the files of their pages; those of a text on several pages, or of a large file that
    several tasks read, meet as digests."""
    pages = spark.read.parquet(f"{path}/pages").drop("page")
    merged = pages.mapInArrow(chained, "sha string, keep_id long, group_size long")
    return merged.groupBy("sha").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def exact_dedup(documents: DataFrame, settings: IndexSettings = IndexSettings()) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and text_hash of every row."""
    docs = with_hash(documents)
    groups = read_index(docs.sparkSession, build_index(docs, settings)).filter("group_size > 1")
    rows = docs.mapInArrow(keys, "doc_id long, text_hash long, sha string")
    joined = rows.join(groups, "sha", "left")
    single = F.col("group_size").isNull()
    keep = F.when(single, F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.col("sha").alias("text_sha256"),
        "text_hash",
    )
