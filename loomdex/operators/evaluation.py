"""Scores of cards against golden records, and their averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.functions.binding import let
from loomdex.functions.text import normalize_value

METRICS = ("field_accuracy", "citation_hit", "faithfulness")


def _normalised_pairs(pairs: Column) -> Column:
    """Entries with both sides normalised; of equal keys the last one stays."""
    entries = F.transform(
        F.map_entries(pairs),
        lambda e: F.struct(
            normalize_value(e["key"]).alias("key"), normalize_value(e["value"]).alias("value")
        ),
    )

    def last_of_key(all_entries: Column) -> Column:
        return F.filter(
            all_entries,
            lambda e, i: ~F.exists(
                F.slice(all_entries, i + 2, F.size(all_entries)), lambda x: x["key"] == e["key"]
            ),
        )

    return let(entries, last_of_key)


def field_accuracy(card: Column, golden: Column) -> Column:
    """Share of golden characteristics found in the card: the same pair, or key and
    value each containing the other. An empty golden record scores 1."""

    def hit(g: Column, pairs: Column) -> Column:
        def either(a: Column, b: Column) -> Column:
            return F.contains(a, b) | F.contains(b, a)

        return F.exists(
            pairs, lambda c: either(c["key"], g["key"]) & either(c["value"], g["value"])
        )

    def share(pairs: Column) -> Column:
        wanted = F.transform(
            F.map_entries(golden),
            lambda e: F.struct(
                normalize_value(e["key"]).alias("key"), normalize_value(e["value"]).alias("value")
            ),
        )
        hits = F.size(F.filter(wanted, lambda g: hit(g, pairs)))
        return hits / F.size(golden)

    return F.when(F.size(golden) > 0, let(_normalised_pairs(card), share)).otherwise(F.lit(1.0))


def citation_hit(probes: Column, cited_texts: Column) -> Column:
    """Share of probe texts that some cited chunk contains; no probes score 1."""

    def share(texts: Column) -> Column:
        found = F.filter(
            probes, lambda p: F.exists(texts, lambda t: F.contains(t, normalize_value(p)))
        )
        return F.size(found) / F.size(probes)

    return F.when(
        F.size(probes) > 0, let(F.transform(cited_texts, normalize_value), share)
    ).otherwise(F.lit(1.0))


def macro_averages(scores: DataFrame) -> DataFrame:
    """One row: averages over documents that have golden expectations, and the
    weakest metric. A missing faithfulness is left out of its average.

    ``scores``: field_accuracy, citation_hit, faithfulness, cost, tokens, expected.
    """
    included = scores.filter(F.col("expected"))
    averages = included.agg(
        *[F.avg(m).alias(m) for m in METRICS],
        F.avg("cost").alias("avg_cost"),
        F.avg("tokens").alias("avg_tokens"),
        F.count("*").alias("documents"),
    )
    ranked = F.array_sort(
        F.array(
            *[
                F.struct(
                    F.coalesce(F.col(m), F.lit(2.0)).alias("value"),
                    F.lit(i).alias("place"),
                    F.lit(m).alias("name"),
                )
                for i, m in enumerate(METRICS)
            ]
        )
    )
    return averages.withColumn("weakest_metric", F.get(ranked, F.lit(0))["name"])
