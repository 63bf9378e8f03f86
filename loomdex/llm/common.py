"""Shared folders, staged tables and Arrow batches for the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task holds as numpy arrays at once (a longer text is held alone).
PIECE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared scratch folder, from ``spark.checkpoint.dir``. Where it
    is unset, a local session gets a folder of its own; a cluster gets an error."""
    folder = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="loomdex-shared-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, so
    a lost executor repeats nothing before it."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written.staged_path = path
    return written


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that no result needs any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.staged_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that are not among those of ``df`` (upper case is no difference)."""
    taken = {c.lower() for c in df.columns}
    names = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        names.append(name)
    return names


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(text: str) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def raw_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    start, end = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8)[start:end] if data is not None and end > start else np.zeros(0, np.uint8)
    return raw, offsets.astype(np.int64) - start


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for row, size in enumerate(sizes):
            if row > start and held + size > limit:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += int(size)
        if len(sizes) > start:
            yield batch.slice(start)


def ascii_lower(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case, every other byte as it is."""
    return raw + (((raw >= 65) & (raw <= 90)).view(np.uint8) << 5)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, wrapping (the published splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RangeHash:
    """64-bit polynomial hashes of any byte ranges of a buffer, by prefix sums."""

    def __init__(self) -> None:
        self.codes = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        base = 0x5851F42D4C957F2D
        self.base = np.uint64(base)
        self.inverse_base = np.uint64(pow(base, -1, 1 << 64))
        self._grow(1 << 16)

    def _grow(self, size: int) -> None:
        self.powers = np.full(size, self.base, np.uint64)
        self.inverses = np.full(size, self.inverse_base, np.uint64)
        self.powers[0] = self.inverses[0] = 1
        np.cumprod(self.powers, out=self.powers)
        np.cumprod(self.inverses, out=self.inverses)

    def load(self, raw: np.ndarray) -> None:
        if len(raw) + 1 > len(self.powers):
            self._grow(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.codes[raw] * self.powers[: len(raw)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64))


#: Up to so many narrow rows (a few numbers each) are broadcast; more are shuffled.
BROADCAST_ROWS = 500_000


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS, weight: Column | None = None) -> DataFrame:
    """A broadcast hint behind a count of the rows, or of what they hold as ``weight``
    tells; else Spark joins by shuffle."""
    size = df.count() if weight is None else df.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= limit else df


def with_hash(documents: DataFrame) -> DataFrame:
    """(doc_id, text_hash, text); the first two tell rows apart for ``without``."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def without(documents: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows whose (doc_id, text_hash) is not among ``dropped``."""
    drop_id, drop_hash = free_names(documents, "drop_id", "drop_hash")
    names = staged(dropped.select(F.col("doc_id").alias(drop_id), F.col("text_hash").alias(drop_hash)).distinct(), "dropped")
    same = documents["doc_id"].eqNullSafe(F.col(drop_id)) & (F.xxhash64(documents["text"]) == F.col(drop_hash))
    return documents.join(maybe_broadcast(names), same, "left_anti")
