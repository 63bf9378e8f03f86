"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source; a row's place
is its fractional rank ``(2 * rank - 1) / (2 * rows of the source)``. Sorted by
place, every stretch of rows holds the sources in the proportion of the whole
table, so cutting the sequence into equal stretches gives shards of equal counts
(at most one apart, the law ``rows``) and of the same mixture.

No rank is taken in one task: rows fall into buckets of their hash, and later of
their place, both spread evenly by construction; a window numbers the rows of one
bucket and a table of bucket counts (sources x buckets, or buckets) shifts it.

Cases: null text has size 16 and the checksum of the empty text; a null source is
a source of its own; a null id hashes as the empty string. Repeated rows are rows:
they differ by nothing, so which of them comes first does not matter. An empty
table gives an empty result. Only doc_id, text and source are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomdex.llm.common import staged, text_bytes

#: Rows that one window partition numbers, on average.
BUCKET_ROWS = 1 << 16


def numbered(df: DataFrame, group: list[str], bucket: str, order: list, name: str, size: str | None = None) -> DataFrame:
    """1-based number of every row of a group by (bucket, order), and the rows of
    its group as ``size``; ``bucket`` must rise with ``order`` and spread the rows
    of a group evenly."""
    counts = df.groupBy(*group, bucket).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(
        *group, bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"), F.sum("_n").over(whole).alias("_size")
    )
    inside = Window.partitionBy(*group, bucket).orderBy(*order)
    ranked = df.withColumn("_inside", F.row_number().over(inside))
    same = [ranked[c].eqNullSafe(shifts[c]) for c in (*group, bucket)]
    out = [ranked[c] for c in df.columns] + [(F.col("_inside") + F.col("_shift")).alias(name)]
    return ranked.join(shifts, same).select(*out, *([F.col("_size").alias(size)] if size else []))


def shard_rows(documents: DataFrame, n_shards: int = 40, seed: str = "loomdex", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and the source of every row."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source"),
        (text_bytes("text") + 16).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("shuffled"),
    )
    total = documents.count()
    buckets = 1 << max(8, (total // bucket_rows).bit_length())
    rows = rows.withColumn("bucket", F.shiftright(F.conv(F.substring("shuffled", 1, 8), 16, 10).cast("long") * buckets, 32))
    ties = ["shuffled", "doc_id", "text_crc32", "size"]
    ranked = numbered(rows, ["source"], "bucket", ties, "rank", "source_rows")
    placed = ranked.withColumn("place", (F.col("rank") * 2 - 1) / (F.col("source_rows") * 2)).drop("rank", "source_rows")
    placed = staged(placed.withColumn("bucket", F.floor(F.col("place") * buckets)), "shard-places")
    sequence = numbered(placed, [], "bucket", ["place", F.col("source").asc_nulls_first(), *ties], "number")
    # Row i of the sequence is in shard i * n_shards / total; a shard's first row
    # is therefore ceil(shard * total / n_shards).
    sharded = sequence.withColumn("shard", F.expr(f"((number - 1) * {n_shards}) div {max(1, total)}"))
    return sharded.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.expr(f"number - 1 - (shard * {total} + {n_shards - 1}) div {n_shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
    )
