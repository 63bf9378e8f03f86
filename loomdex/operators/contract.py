"""The card contract, its sources, their coverage, and the final decision.

A card is a struct column of schema ``schemas.CARD``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.functions.text import evidence_key, is_blank
from loomdex.schemas import CARD, EMPTY_LIST, EMPTY_MAP, SOURCE
from loomdex.settings import DEFAULTS, Settings


def with_defaults(card: Column) -> Column:
    """Contract defaults for absent optional fields; blank characteristics go."""
    seo = card["seo"]
    characteristics = F.coalesce(card["characteristics"], F.expr(EMPTY_MAP))
    sources = F.transform(
        card["sources"],
        lambda s: F.struct(
            s["chunk_id"].alias("chunk_id"),
            F.coalesce(s["doc_id"], F.lit("")).alias("doc_id"),
            s["page"].alias("page"),
            s["score"].alias("score"),
        ),
    )
    empty = F.expr(EMPTY_LIST)
    return F.struct(
        card["title"].alias("title"),
        card["description"].alias("description"),
        F.map_filter(characteristics, lambda k, v: ~is_blank(v)).alias("characteristics"),
        F.coalesce(card["benefits"], empty).alias("benefits"),
        F.struct(
            F.coalesce(seo["title"], F.lit("")).alias("title"),
            F.coalesce(seo["description"], F.lit("")).alias("description"),
            F.coalesce(seo["keywords"], empty).alias("keywords"),
        ).alias("seo"),
        F.coalesce(sources, F.expr(f"CAST(ARRAY() AS ARRAY<{SOURCE}>)")).alias("sources"),
        F.coalesce(card["missing_fields"], empty).alias("missing_fields"),
        F.coalesce(card["confidence"], F.lit(0.5)).alias("confidence"),
    ).cast(CARD)


def contract_violations(card: Column, settings: Settings = DEFAULTS) -> Column:
    """ARRAY<STRING> of broken rules of a card after ``with_defaults``."""
    both = F.sort_array(
        F.array_intersect(card["missing_fields"], F.map_keys(card["characteristics"]))
    )
    rules = [
        (card.isNull() | card["title"].isNull(), F.lit("title is missing")),
        (card["description"].isNull(), F.lit("description is missing")),
        (
            F.char_length(card["title"]) > settings.card_title_max_len,
            F.concat(
                F.lit(f"title longer than {settings.card_title_max_len} characters: "),
                F.char_length(card["title"]).cast("string"),
            ),
        ),
        (
            ~card["confidence"].between(0.0, 1.0) | F.isnan(card["confidence"]),
            F.lit("confidence must be in [0, 1]"),
        ),
        (
            F.exists(card["sources"], lambda s: s["chunk_id"].isNull()),
            F.lit("source without chunk_id"),
        ),
        (
            F.size(both) > 0,
            F.concat(
                F.lit("fields both present and missing: "), F.array_join(both, ", ")
            ),
        ),
    ]
    return F.array_compact(F.array(*[F.when(broken, text) for broken, text in rules]))


def cited_ids(card: Column) -> Column:
    return F.sort_array(F.array_distinct(card["sources"]["chunk_id"]))


def source_errors(card: Column, allowed: Column, known: Column) -> Column:
    """Cited ids outside the context, else cited ids the store does not have;
    NULL when all are fine. A card without sources is fine here."""
    foreign = F.array_except(cited_ids(card), allowed)
    absent = F.array_except(cited_ids(card), known)
    return (
        F.when(F.size(card["sources"]) == 0, F.lit(None).cast("string"))
        .when(
            F.size(foreign) > 0,
            F.concat(F.lit("sources not in the context: "), F.array_join(foreign, ", ")),
        )
        .when(
            F.size(absent) > 0,
            F.concat(F.lit("sources not in the store: "), F.array_join(absent, ", ")),
        )
    )


def cited_chunks(cards: DataFrame, chunks: DataFrame) -> DataFrame:
    """``cards`` (job_id, card) with ``cited``: ARRAY<STRUCT<chunk_id, doc_id, page,
    text>> of the cited chunks that exist.

    The cited (job, chunk) pairs are distinct. Spark picks the join by the sizes it
    sees, and splits a chunk that very many cards cite. A card cites few chunks,
    so its list is one small row.
    """
    pairs = cards.select("job_id", F.explode(cited_ids(F.col("card"))).alias("chunk_id"))
    payload = chunks.select("chunk_id", "doc_id", F.col("metadata.page").alias("page"), "text")
    grouped = (
        payload.join(pairs, "chunk_id")
        .groupBy("job_id")
        .agg(F.sort_array(F.collect_list(F.struct("chunk_id", "doc_id", "page", "text"))).alias("cited"))
    )
    empty = F.expr(
        "CAST(ARRAY() AS ARRAY<STRUCT<chunk_id: STRING, doc_id: STRING, page: INT, text: STRING>>)"
    )
    return cards.join(grouped, "job_id", "left").withColumn("cited", F.coalesce("cited", empty))


def enrich_sources(card: Column, cited: Column, scores: Column) -> Column:
    """Fills doc_id, page and score of a source where the model left them out."""

    def enriched(source: Column) -> Column:
        info = F.get(F.filter(cited, lambda c: c["chunk_id"] == source["chunk_id"]), F.lit(0))
        score = F.round(F.try_element_at(scores, source["chunk_id"]), 4)
        found = info.isNotNull()
        return F.struct(
            source["chunk_id"].alias("chunk_id"),
            F.coalesce(F.nullif(source["doc_id"], F.lit("")), info["doc_id"].cast("string"), F.lit("")).alias("doc_id"),
            F.coalesce(source["page"], info["page"].cast("int")).alias("page"),
            F.coalesce(source["score"], F.when(found, score)).alias("score"),
        )

    return card.withField("sources", F.transform(card["sources"], enriched))


def source_coverage(card: Column, cited: Column) -> Column:
    """Share of characteristics whose value occurs in a cited chunk's text.

    Zero without characteristics, sources or texts.
    """
    keys = F.filter(F.transform(cited, lambda c: evidence_key(c["text"])), lambda k: k != "")
    values = F.transform(F.map_values(card["characteristics"]), evidence_key)
    covered = F.filter(
        values, lambda v: (v != "") & F.exists(keys, lambda k: F.contains(k, v))
    )
    has_evidence = (F.size(values) > 0) & (F.size(card["sources"]) > 0) & (F.size(keys) > 0)
    return F.when(has_evidence, F.size(covered) / F.size(values)).otherwise(F.lit(0.0))


def decide_status(
    card: Column,
    approved: Column,
    coverage: Column,
    guard_needs_review: Column,
    settings: Settings = DEFAULTS,
) -> Column:
    """``rejected``, ``needs_review`` or ``done``."""
    doubtful = (
        (F.size(card["sources"]) == 0)
        | guard_needs_review
        | (coverage < settings.source_coverage_threshold)
        | (card["confidence"] < settings.confidence_human_threshold)
    )
    return (
        F.when(card.isNull() | ~F.coalesce(approved, F.lit(False)), "rejected")
        .when(doubtful, "needs_review")
        .otherwise("done")
    )


def confidence_gate(confidence: Column, settings: Settings = DEFAULTS) -> Column:
    return F.when(confidence < settings.confidence_human_threshold, "needs_review").otherwise("done")
