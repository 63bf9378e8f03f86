"""Reciprocal-rank fusion of the vector and the full-text leg."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdex.functions.vectors import dot
from loomdex.operators.nearest import COSINE_DECIMALS
from loomdex.operators.query_batch import QueryBlock
from loomdex.settings import DEFAULTS

KEYS = ["query_id", "chunk_id"]


def fuse_legs(vector: DataFrame, fulltext: DataFrame) -> DataFrame:
    """``(query_id, chunk_id, vec_rank, cosine, fts_rank)``: every hit of either leg."""
    return vector.select(*KEYS, F.col("rank").alias("vec_rank"), "cosine").join(
        fulltext.select(*KEYS, F.col("rank").alias("fts_rank")), KEYS, "full_outer"
    )


def rrf_score(rrf_k: int = DEFAULTS.rrf_k) -> Column:
    """Sum of reciprocal ranks; a leg that missed the chunk adds nothing."""

    def part(rank: str) -> Column:
        return F.coalesce(F.lit(1.0) / (F.lit(float(rrf_k)) + F.col(rank)), F.lit(0.0))

    return F.round(part("vec_rank") + part("fts_rank"), 12)


def passes_threshold(threshold: Column) -> Column:
    """The threshold cuts only chunks that nothing but the vector leg found; a
    full-text hit stays and keeps its vector term even below the threshold."""
    return F.col("fts_rank").isNotNull() | (F.col("cosine") >= threshold)


def fused_top_k(
    legs: DataFrame, k: int, threshold: Column, partition: tuple[str, ...] = ("query_id",)
) -> DataFrame:
    """Ranked fusion of prepared legs, k rows per partition of ``partition``."""
    order = Window.partitionBy(*partition).orderBy(
        F.desc("rrf_score"), F.desc(F.coalesce("cosine", F.lit(0.0))), "chunk_id"
    )
    return (
        legs.filter(passes_threshold(threshold))
        .withColumn("rrf_score", rrf_score())
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
    )


def attach_cosine(hits: DataFrame, block: QueryBlock, vectors: DataFrame) -> DataFrame:
    """Adds ``vec_score``: the cosine of every hit, also of those only the
    full-text leg found; NULL when the chunk has no vector. Cosines of the vector
    leg are reused; only the rest is looked up."""
    missing = hits.filter(F.col("cosine").isNull()).select(*KEYS)
    wanted = missing.join(block.frame.select("query_id", "query_vec"), "query_id")
    found = vectors.select("chunk_id", "embedding").join(wanted, "chunk_id").select(
        *KEYS, F.round(dot(F.col("embedding"), F.col("query_vec")), COSINE_DECIMALS).alias("found")
    )
    joined = hits.join(found, KEYS, "left")
    return joined.withColumn("vec_score", F.coalesce("cosine", "found")).drop("found")
