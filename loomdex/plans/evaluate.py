"""Golden-set evaluation: cards for golden documents, judged and scored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.operators import contract
from loomdex.operators import evaluation as ev
from loomdex.plans.cards import DEFAULT_QUERY, CardFlow
from loomdex.plans.retrieval import Corpus
from loomdex.schemas import EMPTY_LIST, EMPTY_MAP
from loomdex.session import durable


def evaluate(
    golden: DataFrame, corpus: Corpus, flow: CardFlow, only_files: list[str] | None = None
) -> DataFrame:
    """One row per golden file that is stored: status, scores, tokens and cost.

    Golden files that are not stored are left out. The calls of a card carry its
    job, so tokens and cost are sums per job.
    """
    chosen = golden if only_files is None else golden.filter(F.col("file").isin(only_files))
    stored = corpus.documents.select("doc_id", F.col("filename").alias("file"))
    cases = durable(chosen.join(stored, "file").withColumn("job_id", F.concat(F.lit("eval-"), "doc_id")))
    jobs = cases.select(
        "job_id",
        F.array("doc_id").alias("document_ids"),
        F.coalesce("product", F.lit(DEFAULT_QUERY)).alias("product_hint"),
    )
    run = flow.rag_cards(jobs, corpus)
    # A person is not asked here: a finished card counts as done.
    status = F.when(F.col("status") == "awaiting_human", "done").otherwise(F.col("status"))
    results = run.results.withColumn("status", status)
    judged = flow.judge(run.contexts, results.filter(F.col("card").isNotNull()))
    calls = durable(run.calls).groupBy("job_id").agg(
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"),
        F.sum("cost").cast("double").alias("cost"),
    )
    empty = F.expr(EMPTY_MAP)
    characteristics = F.coalesce("characteristics", empty)
    probes = F.transform(
        F.map_values(F.coalesce("source_probes", F.expr("CAST(MAP() AS MAP<STRING, STRUCT<page: INT, text_contains: STRING>>)"))),
        lambda p: p["text_contains"],
    )
    has_card = F.col("card").isNotNull()
    cited = contract.cited_chunks(results.select("job_id", "card", "status", "attempts"), corpus.chunks)
    scored = (
        cases.join(cited, "job_id").join(judged, "job_id", "left").join(calls, "job_id", "left")
    )
    field_accuracy = ev.field_accuracy(F.coalesce("card.characteristics", empty), characteristics)
    citation_hit = ev.citation_hit(probes, F.col("cited.text"))
    return scored.select(
        "file",
        "status",
        F.when(has_card, F.col("attempts")).otherwise(0).alias("attempts"),
        F.round(F.when(has_card, field_accuracy).otherwise(0.0), 3).alias("field_accuracy"),
        F.round(F.when(has_card, citation_hit).otherwise(0.0), 3).alias("citation_hit"),
        F.round("faithfulness", 3).alias("faithfulness"),
        F.coalesce("card.confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("card.missing_fields", F.expr(EMPTY_LIST)).alias("missing_fields_of_card"),
        "prompt_tokens",
        "completion_tokens",
        (F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"),
        F.round("cost", 4).alias("cost"),
        ((F.size(characteristics) > 0) | (F.size(probes) > 0)).alias("expected"),
    )
