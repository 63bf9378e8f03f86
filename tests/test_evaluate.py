import json

from loomdex.operators.contract import with_defaults
from loomdex.operators.evaluation import macro_averages
from loomdex.plans.cards import CardFlow
from loomdex.plans.evaluate import evaluate
from loomdex.plans.lookups import get_document, get_jobs, get_trace, list_documents
from loomdex.schemas import CARD, GOLDEN
from loomdex.sources.reports import evaluation_report, threshold_report
from pyspark.sql import functions as F
from stubs import make_client
from test_cards import corpus


def test_golden_set(spark):
    golden = [
        {"file": "ok.pdf", "product": "Насос", "characteristics": {"мощность": "540вт", "Цвет": "белый"},
         "source_probes": {"p": {"page": 1, "text_contains": "мощность:  540"}}},
        {"file": "fake.pdf", "characteristics": {"a": "1"}},
        {"file": "unsure.pdf"},
        {"file": "absent.pdf"},
        {"file": "down.pdf", "characteristics": {"a": "1"}},
    ]
    rows = spark.createDataFrame([(json.dumps(g, ensure_ascii=False),) for g in golden], "j STRING")
    frame = rows.select(F.from_json("j", GOLDEN).alias("g")).select("g.*")
    flow = CardFlow(make_client, prices={"default": {"input": 1.0, "output": 1.0}})
    scores = evaluate(frame, corpus(spark), flow, ["ok.pdf", "fake.pdf", "unsure.pdf", "absent.pdf"])
    got = {r["file"]: r for r in scores.collect()}
    assert set(got) == {"ok.pdf", "fake.pdf", "unsure.pdf"}
    ok = got["ok.pdf"]
    assert (ok["status"], ok["field_accuracy"], ok["citation_hit"], ok["faithfulness"]) == ("done", 0.5, 1.0, 0.75)
    assert ok["tokens"] > 0 and ok["cost"] > 0 and ok["attempts"] == 1
    fake = got["fake.pdf"]
    assert (fake["status"], fake["field_accuracy"], fake["citation_hit"], fake["faithfulness"]) == ("needs_review", 0.0, 0.0, None)
    assert not got["unsure.pdf"]["expected"]
    averages = macro_averages(scores)
    report = json.loads(evaluation_report(scores, averages))
    assert report["averages"]["documents"] == 2 and report["weakest_metric"]["name"] == "field_accuracy"
    assert report["weakest_metric"]["value"] == 0.25


def test_lookups(spark):
    data = corpus(spark)
    card = with_defaults(F.from_json(F.lit('{"title": "t", "description": "d", "characteristics": {"a": "540 Вт"}, "sources": [{"chunk_id": "okc0"}]}'), CARD))
    jobs = spark.createDataFrame([("j1", True), ("j2", False)], "job_id STRING, has BOOLEAN").select(
        "job_id", F.when(F.col("has"), card).alias("card"))
    got = {r["job_id"]: r["source_coverage"] for r in get_jobs(jobs, data.chunks).collect()}
    assert got == {"j1": 1.0, "j2": None}
    assert get_jobs(jobs, data.chunks, "j1").count() == 1
    documents = spark.createDataFrame([("b", "f", "pdf", "indexed", 1, 2), ("a", "g", "pdf", "new", 0, 1)],
                                      "doc_id STRING, filename STRING, kind STRING, status STRING, chunks_count INT, created_at INT")
    assert [r["doc_id"] for r in list_documents(documents).collect()] == ["a", "b"]
    assert get_document(documents, "a").count() == 1
    traces = spark.createDataFrame([("j", 2, "y"), ("j", 1, "x"), ("k", 1, "z")], "job_id STRING, position INT, step STRING")
    assert [r["step"] for r in get_trace(traces, "j").collect()] == ["x", "y"]


def test_threshold_report(spark):
    hybrid = spark.createDataFrame([(0.2, 0.9, 4.5, 0.7)], "threshold DOUBLE, purity DOUBLE, in_family DOUBLE, full_share DOUBLE")
    foreign = spark.createDataFrame([(9, 5, 10, 0.47, 0.37, 0.54)], "rank_median INT, rank_min INT, rank_max INT, cosine_median DOUBLE, cosine_min DOUBLE, cosine_max DOUBLE")
    best = spark.createDataFrame([(0.0, 0.4, 0.35)], "plateau_min DOUBLE, plateau_max DOUBLE, best DOUBLE")
    text = threshold_report(hybrid, hybrid, foreign, best)
    assert "| 0.2 | 0.90 | 4.50 | 70 % |" in text and "Recommended: 0.35" in text


def test_fix_field(spark):
    class Fixer:
        model = "m"

        def complete(self, agent, prompt, timeout_s):
            from loomdex.plans.models import Completion

            good = '{"title": "short", "description": "d"}'
            return Completion(good if "REPAIR" in prompt else "no")

    card = with_defaults(F.from_json(F.lit('{"title": "x", "description": "d"}'), CARD))
    cards = spark.createDataFrame([("a", "REPAIR"), ("b", "-")], "job_id STRING, error STRING").select(
        "job_id", card.alias("card"), F.lit("title").alias("field"), "error")
    got = {r["job_id"]: r["card"] for r in CardFlow(lambda agent: Fixer()).fix_field(cards).collect()}
    assert got["a"]["title"] == "short" and got["b"] is None
