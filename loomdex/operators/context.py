"""Packing ranked chunks into a context of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdex.session import durable
from loomdex.settings import DEFAULTS

# Page label, and the shortest possible body "[x | y]\n".
PAGE_LABEL = "стр. "
MIN_BODY = 7


def chunk_header(chunk_id: Column, filename: Column, page: Column, section: Column) -> Column:
    """``[chunk | file | page | section]``; a missing or zero page and an empty
    section are left out."""
    parts = [
        chunk_id.cast("string"),
        F.coalesce(filename, F.lit("")),
        F.when(page != 0, F.concat(F.lit(PAGE_LABEL), page.cast("string"))),
        F.when(section != "", section),
    ]
    return F.concat(F.lit("["), F.concat_ws(" | ", *parts), F.lit("]"))


def chunk_body() -> Column:
    header = chunk_header(
        F.col("chunk_id"), F.col("filename"), F.col("metadata.page"), F.col("metadata.section")
    )
    return F.concat(header, F.lit("\n"), F.col("text"))


def pack_order(bodies: DataFrame, limit: int = DEFAULTS.context_char_limit) -> DataFrame:
    """``(job_id, chunk_id, rank, running_chars)`` of the chunks that fit.

    ``bodies`` has job_id, chunk_id, rank and body_chars, no text. Chunks enter
    in rank order until the first that would pass the limit; the first always
    enters; repeated chunks count once. Sizes only grow, so "stop at the first
    overflow" is a filter on the running sum. Every body has a header, so no
    more than ``limit / MIN_BODY`` chunks can fit: each task prunes its share of
    a job to that many rows before the shuffle, whatever the size of the job.
    """
    distinct = bodies.groupBy("job_id", "chunk_id").agg(
        F.min(F.struct("rank", "body_chars")).alias("first")
    )
    rows = distinct.select("job_id", "chunk_id", "first.rank", "first.body_chars")
    order = Window.partitionBy("job_id").orderBy("rank", "chunk_id")
    candidates = rows.withColumn("position", F.row_number().over(order)).filter(
        F.col("position") <= limit // MIN_BODY + 1
    )
    running = F.sum("body_chars").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return (
        candidates.withColumn("running_chars", running)
        .filter((F.col("running_chars") <= limit) | (F.col("position") == 1))
        .select("job_id", "chunk_id", "rank", "position", "running_chars")
    )


def build_context(ranked: DataFrame, limit: int = DEFAULTS.context_char_limit) -> DataFrame:
    """``(job_id, context, allowed_ids)`` from job_id, rank, chunk_id, filename,
    metadata and text. Only lengths are ranked; texts join for the survivors, out of a
    checkpoint: what was ranked (a search, chunks cut anew) is not derived twice."""
    bodies = durable(ranked.select("job_id", "chunk_id", "rank", chunk_body().alias("body")))
    fits = pack_order(
        bodies.select("job_id", "chunk_id", "rank", F.char_length("body").alias("body_chars")),
        limit,
    )
    kept = bodies.select("job_id", "chunk_id", "rank", "body").join(
        fits.select("job_id", "chunk_id", "rank", "position"), ["job_id", "chunk_id", "rank"]
    )
    parts = F.sort_array(F.collect_set(F.struct("position", "chunk_id", "body")))
    return kept.groupBy("job_id").agg(parts.alias("parts")).select(
        "job_id",
        F.array_join(F.col("parts.body"), "\n\n").alias("context"),
        F.col("parts.chunk_id").alias("allowed_ids"),
    )


def context_chunk_ids(context: Column) -> Column:
    """Chunk ids named by the headers of a context text."""
    return F.array_distinct(
        F.regexp_extract_all(context, F.lit(r"(?m)^\[([a-z0-9]+) \|"), F.lit(1))
    )
