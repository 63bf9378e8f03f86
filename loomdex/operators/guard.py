"""Protection of the context and of the finished card."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.functions.binding import let
from loomdex.functions.injection import injection_reason, output_marker_issues
from loomdex.functions.pii import mask_pii, pii_count
from loomdex.settings import DEFAULTS

Detector = Callable[[DataFrame], DataFrame]


def screen_chunks(chunks: DataFrame) -> DataFrame:
    """Masks ``text`` and adds ``masked_pii`` and ``reason`` (NULL when clean)."""
    masked = chunks.withColumn("_masked", mask_pii(F.col("text")))
    return (
        masked.withColumn("text", F.col("_masked.text"))
        .withColumn("masked_pii", pii_count(F.col("_masked")))
        .drop("_masked")
        .withColumn("reason", injection_reason(F.col("text")))
    )


def fragments(chunks: DataFrame, limit: int = DEFAULTS.detector_char_limit) -> DataFrame:
    """``(chunk_id, start, fragment_id, text)``: the whole text of every chunk in
    windows of ``limit`` characters that overlap by a tenth."""
    overlap = limit // 10
    starts = F.sequence(F.lit(1), F.greatest(F.char_length("text") - overlap, F.lit(1)), F.lit(limit - overlap))
    rows = chunks.select("chunk_id", "text", F.explode(starts).alias("start"))
    name = F.concat_ws("#", F.col("chunk_id").cast("string"), F.col("start").cast("string"))
    return rows.select("chunk_id", "start", name.alias("fragment_id"), F.substring("text", F.col("start"), F.lit(limit)).alias("text"))


def confirm_suspicious(screened: DataFrame, detector: Detector | None = None) -> DataFrame:
    """Adds ``blocked`` and settles ``reason``.

    ``detector`` takes (fragment_id, text), the windows of suspicious chunks only,
    and returns (fragment_id, injection BOOLEAN, detail STRING). It runs on a branch
    of its own, so clean chunks never reach the model. A chunk is blocked if any of
    its windows is, and a window without a verdict is.
    """
    if detector is None:
        return screened.withColumn("blocked", F.col("reason").isNotNull())
    suspicious = screened.filter(F.col("reason").isNotNull()).select("chunk_id", "text")
    asked = fragments(suspicious.dropDuplicates(["chunk_id"]))
    verdicts = detector(asked.select("fragment_id", "text")).select("fragment_id", "injection", "detail")
    yes = F.coalesce("injection", F.lit(True))
    found = asked.select("chunk_id", "start", "fragment_id").join(verdicts, "fragment_id", "left")
    settled = found.groupBy("chunk_id").agg(
        F.max(yes).alias("injection"), F.min_by("detail", F.struct(~yes, F.col("start"))).alias("detail")
    )
    joined = screened.join(settled, "chunk_id", "left")
    suspect = F.col("reason").isNotNull()
    return (
        joined.withColumn("blocked", suspect & F.coalesce("injection", F.lit(True)))
        .withColumn(
            "reason", F.when(suspect, F.coalesce(F.nullif("detail", F.lit("")), F.col("reason")))
        )
        .drop("injection", "detail")
    )


def guard_report(confirmed: DataFrame, limit: int = DEFAULTS.suspicious_chunk_limit) -> DataFrame:
    """``(job_id, masked_pii, suspicious, needs_review)``; sums that combine
    map-side, so a job with very many chunks is no heavier than another."""
    grouped = confirmed.groupBy("job_id").agg(
        F.sum("masked_pii").alias("masked_pii"), F.count_if("blocked").alias("suspicious")
    )
    return grouped.withColumn("needs_review", F.col("suspicious") > limit)


def blocked_chunks(confirmed: DataFrame) -> DataFrame:
    """``(job_id, rank, chunk_id, reason)`` of every blocked chunk, one row each:
    their number per job has no bound, so they are not gathered into lists."""
    reason = F.concat(F.col("chunk_id").cast("string"), F.lit(": "), "reason")
    return confirmed.filter("blocked").select("job_id", "rank", "chunk_id", reason.alias("reason"))


def guard_context(chunks: DataFrame, detector: Detector | None = None) -> DataFrame:
    """Screened and confirmed chunks; callers keep the rows that are not blocked."""
    return confirm_suspicious(screen_chunks(chunks), detector)


def guard_output(card_json: Column) -> Column:
    """STRUCT<cleaned, issues>: personal data masked, issues listed.

    Issues are a note for people; they do not change the status of a card.
    """

    def report(masked: Column) -> Column:
        count = pii_count(masked)
        pii_issue = F.when(
            count > 0,
            F.array(F.concat(F.lit("personal data masked in card: "), count.cast("string"))),
        ).otherwise(F.array().cast("array<string>"))
        return F.struct(
            masked["text"].alias("cleaned"),
            F.concat(pii_issue, output_marker_issues(card_json)).alias("issues"),
        )

    return let(mask_pii(card_json), report)
