"""Running numbers inside groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_ordinals(df: DataFrame, keys: list[str], order: list, bucket: Column) -> DataFrame:
    """Adds ``ordinal``: the 1-based position in the group in ``order``.

    ``bucket`` must not decrease along ``order``. Rows are numbered inside
    (group, bucket) and shifted by the sizes of the buckets before, so a group
    that holds a large share of all rows is spread over its buckets.
    """
    spread = df.withColumn("_bucket", bucket)
    parts = [*keys, "_bucket"]
    so_far = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        spread.groupBy(*parts)
        .agg(F.count("*").alias("_rows"))
        .select(*parts, F.coalesce(F.sum("_rows").over(so_far), F.lit(0)).alias("_offset"))
    )
    local = F.row_number().over(Window.partitionBy(*parts).orderBy(*order))
    return (
        spread.withColumn("_local", local)
        .join(offsets, parts)
        .withColumn("ordinal", F.col("_local") + F.col("_offset"))
        .drop("_bucket", "_local", "_offset")
    )
