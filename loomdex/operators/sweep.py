"""Retrieval-threshold measurement: one scan per leg, every threshold from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdex.operators.fusion import fused_top_k
from loomdex.settings import DEFAULTS

# The measured grid, and the tolerance of the plateau.
THRESHOLDS = (0.0, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5)
PLATEAU_TOLERANCE = 0.01


def _per_threshold(legs: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    return legs.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))


def hybrid_by_threshold(
    legs: DataFrame, k: int, thresholds: tuple[float, ...] = THRESHOLDS
) -> DataFrame:
    """The fused top-k of every query at every threshold."""
    return fused_top_k(
        _per_threshold(legs, thresholds), k, F.col("threshold"), ("query_id", "threshold")
    )


def vector_by_threshold(
    legs: DataFrame, k: int, thresholds: tuple[float, ...] = THRESHOLDS
) -> DataFrame:
    """The vector leg alone at every threshold."""
    return _per_threshold(legs.filter(F.col("vec_rank").isNotNull()), thresholds).filter(
        (F.col("cosine") >= F.col("threshold")) & (F.col("vec_rank") <= k)
    )


def purity(
    results: DataFrame,
    queries: DataFrame,
    families: DataFrame,
    k: int,
    thresholds: tuple[float, ...] = THRESHOLDS,
) -> DataFrame:
    """``(threshold, purity, in_family, full_share)`` averaged over all queries.

    Purity divides by k even when fewer chunks came back, and a query that found
    nothing counts as zero. ``queries`` has query_id and family, ``families``
    chunk_id and family.
    """
    picked = results.select("query_id", "threshold", "chunk_id")
    found = families.join(picked, "chunk_id")
    hits = (
        found.withColumnRenamed("family", "chunk_family")
        .join(queries.select("query_id", "family"), "query_id")
        .groupBy("query_id", "threshold")
        .agg(F.count_if(F.col("chunk_family") == F.col("family")).alias("hits"))
    )
    grid = _per_threshold(queries.select("query_id"), thresholds)
    per_query = grid.join(hits, ["query_id", "threshold"], "left").withColumn(
        "hits", F.coalesce("hits", F.lit(0))
    )
    return per_query.groupBy("threshold").agg(
        F.round(F.avg(F.col("hits") / F.lit(k)), 6).alias("purity"),
        F.round(F.avg("hits"), 6).alias("in_family"),
        F.round(F.avg((F.col("hits") == k).cast("double")), 6).alias("full_share"),
    )


def first_foreign(legs: DataFrame, queries: DataFrame, families: DataFrame) -> DataFrame:
    """``(query_id, rank, cosine)`` of the best ranked chunk of another family."""
    ranked = legs.filter(F.col("vec_rank").isNotNull())
    foreign = (
        families.withColumnRenamed("family", "chunk_family")
        .join(ranked, "chunk_id")
        .join(queries.select("query_id", "family"), "query_id")
        .filter(F.col("chunk_family") != F.col("family"))
    )
    return foreign.groupBy("query_id").agg(
        F.min("vec_rank").alias("rank"), F.min_by("cosine", "vec_rank").alias("cosine")
    )


def upper_median(values: DataFrame, column: str) -> DataFrame:
    """One row, ``<column>_median``: element ``n div 2`` of the sorted values, found
    in the running sums of a count per value."""
    counts = values.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    running = counts.withColumns({"upto": F.sum("n").over(upto), "all": F.sum("n").over(Window.partitionBy())})
    middle = F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col(column))
    return running.agg(F.min(middle).alias(f"{column}_median"))


def foreign_summary(first: DataFrame) -> DataFrame:
    """Median, minimum and maximum of the rank and cosine of the first foreign chunk."""
    first = first.withColumn("cosine", F.round("cosine", 6))
    columns = []
    for name in ("rank", "cosine"):
        columns += [F.min(name).alias(f"{name}_min"), F.max(name).alias(f"{name}_max")]
    medians = {f"{name}_median": upper_median(first, name).scalar() for name in ("rank", "cosine")}
    return first.agg(*columns).withColumns(medians)


def recommend(
    purities: DataFrame, current: float = DEFAULTS.retrieval_threshold
) -> DataFrame:
    """``(plateau_min, plateau_max, best)``: thresholds whose mean in-family count
    is within the tolerance of the maximum; the current threshold stays if inside,
    else the nearest one wins (the lower of two equally near)."""
    top = Window.partitionBy()
    plateau = purities.withColumn("top", F.max("in_family").over(top)).filter(
        F.col("in_family") >= F.col("top") - PLATEAU_TOLERANCE
    )
    low, high = F.min("threshold"), F.max("threshold")
    nearest = F.min_by(
        "threshold", F.struct(F.abs(F.col("threshold") - current), F.col("threshold"))
    )
    return plateau.agg(
        low.alias("plateau_min"),
        high.alias("plateau_max"),
        F.when((low <= current) & (high >= current), F.lit(current)).otherwise(nearest).alias("best"),
    )
