import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomdex.operators import contract
from loomdex.operators import evaluation as ev
from loomdex.schemas import CARD

TEXTS = {
    "c1": "Пылесос Вихрь 16. Мощность: 1600 Вт. Ёмкость мешка: 2,5 л.",
    "c2": "Служит пять лет. Цвет: бирюзовый.",
}
BASE = {
    "title": "Пылесос",
    "description": "Описание.",
    "characteristics": {"Мощность": "1600 Вт", "Ёмкость мешка": "2,5 л"},
    "sources": [{"chunk_id": "c1"}],
    "confidence": 0.9,
}


def cards(spark, overrides):
    rows = [(str(i), json.dumps({**BASE, **o}, ensure_ascii=False)) for i, o in enumerate(overrides)]
    frame = spark.createDataFrame(rows, "job_id STRING, raw STRING")
    return frame.select("job_id", contract.with_defaults(F.from_json("raw", CARD)).alias("card"))


def with_texts(spark, overrides, texts=TEXTS):
    chunks = spark.createDataFrame(
        [(c, "d", (7,), t) for c, t in texts.items()] or [("none", "d", (1,), "")],
        "chunk_id STRING, doc_id STRING, metadata STRUCT<page: INT>, text STRING",
    )
    return contract.cited_chunks(cards(spark, overrides), chunks)


def test_contract(spark):
    cases = [
        ({}, 0),
        ({"title": "x" * 60}, 0),
        ({"title": "x" * 61}, 1),
        ({"confidence": 1.5}, 1),
        ({"confidence": -0.1}, 1),
        ({"missing_fields": ["Мощность"]}, 1),
        ({"missing_fields": ["Пусто"], "characteristics": {"Пусто": "  "}}, 0),
        ({"title": None}, 1),
        ({"title": "x" * 61, "confidence": 2.0}, 2),
    ]
    frame = cards(spark, [o for o, _ in cases])
    got = frame.select("job_id", "card", contract.contract_violations(F.col("card")).alias("v"))
    rows = sorted(got.collect(), key=lambda r: int(r["job_id"]))
    assert [len(r["v"]) for r in rows] == [n for _, n in cases]
    assert rows[6]["card"]["characteristics"] == {}
    source = rows[0]["card"]["sources"][0]
    assert (source["doc_id"], source["page"], source["score"]) == ("", None, None)
    defaults = cards(spark, [{"confidence": None, "sources": None}]).collect()[0]["card"]
    assert defaults["confidence"] == 0.5 and defaults["sources"] == [] and defaults["seo"]["title"] == ""


def test_coverage(spark):
    cases = [
        ({"characteristics": {"Мощность": "1600 Вт", "Материал": "бамбук"}}, 0.5),
        ({"characteristics": {"Мощность": "1600  вт.", "Объём": "2.5 л"}}, 1.0),
        ({"characteristics": {}}, 0.0),
        ({"sources": []}, 0.0),
        ({"sources": [{"chunk_id": "c2"}]}, 0.0),
        ({"sources": [{"chunk_id": "nope"}]}, 0.0),
        ({}, 1.0),
    ]
    frame = with_texts(spark, [o for o, _ in cases])
    got = frame.select("job_id", contract.source_coverage(F.col("card"), F.col("cited")).alias("c"))
    assert [r["c"] for r in sorted(got.collect(), key=lambda r: int(r["job_id"]))] == [c for _, c in cases]


def test_decisions(spark):
    cases = [
        ({}, True, False, "done"),
        ({"sources": [], "confidence": 1.0}, True, False, "needs_review"),
        ({"characteristics": {**BASE["characteristics"], "Цена": "12 990 ₽"}}, True, False, "needs_review"),
        ({"confidence": 0.2}, True, False, "needs_review"),
        ({}, True, True, "needs_review"),
        ({}, False, False, "rejected"),
    ]
    frame = with_texts(spark, [c[0] for c in cases])
    flags = spark.createDataFrame([(str(i), c[1], c[2]) for i, c in enumerate(cases)], "job_id STRING, ok BOOLEAN, bad BOOLEAN")
    status = contract.decide_status(
        F.col("card"), F.col("ok"), contract.source_coverage(F.col("card"), F.col("cited")), F.col("bad")
    )
    got = frame.join(flags, "job_id").select("job_id", status.alias("s")).collect()
    assert [r["s"] for r in sorted(got, key=lambda r: int(r["job_id"]))] == [c[3] for c in cases]
    none = spark.range(1).select(
        contract.decide_status(F.lit(None).cast(CARD), F.lit(True), F.lit(1.0), F.lit(False))
    )
    assert none.collect()[0][0] == "rejected"
    gate = spark.createDataFrame([(0.3,), (0.87,)], "c DOUBLE").select(contract.confidence_gate(F.col("c")))
    assert [r[0] for r in gate.collect()] == ["needs_review", "done"]


def test_sources(spark):
    frame = with_texts(
        spark,
        [{}, {"sources": [{"chunk_id": "deadbeef0000"}]}, {"sources": [{"chunk_id": "gone"}]}, {"sources": []}],
    )
    errors = contract.source_errors(
        F.col("card"), F.array(F.lit("c1"), F.lit("gone")), F.col("cited.chunk_id")
    )
    got = {r["job_id"]: r["e"] for r in frame.select("job_id", errors.alias("e")).collect()}
    assert got == {
        "0": None,
        "1": "sources not in the context: deadbeef0000",
        "2": "sources not in the store: gone",
        "3": None,
    }
    scores = F.create_map(F.lit("c1"), F.lit(0.51234))
    rich = frame.filter("job_id = '0'").select(contract.enrich_sources(F.col("card"), F.col("cited"), scores))
    assert tuple(rich.collect()[0][0]["sources"][0]) == ("c1", "d", 7, 0.5123)
    kept = with_texts(spark, [{"sources": [{"chunk_id": "c1", "doc_id": "x", "page": 2, "score": 0.1}]}])
    row = kept.select(contract.enrich_sources(F.col("card"), F.col("cited"), scores)).collect()[0][0]
    assert tuple(row["sources"][0]) == ("c1", "x", 2, 0.1)


def test_scores(spark):
    schema = "card MAP<STRING, STRING>, golden MAP<STRING, STRING>"
    cases = [
        (({"Мощность": "1600 Вт"}, {"мощность": "1600вт."}), 1.0),
        (({"Мощность, Вт": "1600"}, {"Мощность": "1600 Вт"}), 1.0),
        (({"Цвет": "белый"}, {"Мощность": "1600 Вт", "цвет": "Белый"}), 0.5),
        (({}, {"a": "1"}), 0.0),
        (({"a": "1"}, {}), 1.0),
    ]
    frame = spark.createDataFrame([c for c, _ in cases], schema)
    got = [r[0] for r in frame.select(ev.field_accuracy(F.col("card"), F.col("golden"))).collect()]
    assert got == [e for _, e in cases]
    probes = spark.createDataFrame(
        [(["1600 вт", "нет"], ["Мощность: 1600 Вт."]), ([], []), (["x"], [])],
        "probes ARRAY<STRING>, texts ARRAY<STRING>",
    )
    hits = [r[0] for r in probes.select(ev.citation_hit(F.col("probes"), F.col("texts"))).collect()]
    assert hits == [0.5, 1.0, 0.0]
    scores = spark.createDataFrame(
        [(0.4, 0.8, None, 0.1, 10.0, True), (0.6, 1.0, 0.5, 0.3, 30.0, True), (1.0, 1.0, 0.0, 9.0, 9.0, False)],
        "field_accuracy DOUBLE, citation_hit DOUBLE, faithfulness DOUBLE, cost DOUBLE, tokens DOUBLE, expected BOOLEAN",
    )
    row = ev.macro_averages(scores).collect()[0]
    assert (row["field_accuracy"], row["citation_hit"], row["faithfulness"]) == pytest.approx((0.5, 0.9, 0.5))
    assert row["weakest_metric"] == "field_accuracy" and row["documents"] == 2


@settings(max_examples=10, deadline=None)
@given(st.dictionaries(st.text("ab 1", max_size=4), st.text("ab 1.", max_size=5), max_size=4))
def test_coverage_is_a_share(spark, characteristics):
    frame = with_texts(spark, [{"characteristics": characteristics}], {"c1": "ab 1 ba"})
    got = frame.select(contract.source_coverage(F.col("card"), F.col("cited"))).collect()[0][0]
    kept = {k: v for k, v in characteristics.items() if v.strip()}
    keys = ["".join(c for c in v if c.isalnum()) for v in kept.values()]
    expected = sum(1 for k in keys if k and k in "ab1ba") / len(keys) if keys else 0.0
    assert got == pytest.approx(expected)


@pytest.mark.parametrize(
    ("text", "errors"),
    [
        ('{"title": "t", "confidence": "0.9"}', []),
        ('{"title": 1}', ["title is no string"]),
        ('{"title": null}', ["title is no string"]),
        ('{"benefits": "x"}', ["benefits is no list of strings"]),
        ('{"benefits": ["x", null]}', ["benefits is no list of strings"]),
        ('{"benefits": [], "characteristics": {}, "sources": []}', []),
        ('{"characteristics": {"a": 1}}', ["characteristics is no object of strings"]),
        ('{"sources": [{"chunk_id": "c", "page": "1", "score": null}]}', []),
        ('{"sources": [{"page": 1}]}', ["sources is no list of sources"]),
        ('{"sources": [{"chunk_id": "c", "page": 1.5}]}', ["sources is no list of sources"]),
        ('{"sources": {"chunk_id": "c"}}', ["sources is no list of sources"]),
        ('{"seo": {"keywords": [1]}, "confidence": "high"}', ["seo.keywords is no list of strings", "confidence is no number"]),
        ('{"unknown": {"a": [1]}, "confidence": true}', []),
        ("[1]", ["the answer is no JSON object"]),
        ('{"title": "t"', ["the answer is no valid JSON"]),
        (None, []),
    ],
)
def test_types_of_a_card(spark, text, errors):
    from loomdex.operators.card_json import read_card

    got = spark.createDataFrame([(text,)], "text string").select(read_card(F.col("text")).alias("r")).first()["r"]
    assert got["type_errors"] == errors
    if text is None or "valid" in "".join(errors):
        assert got["card"] is None


def test_card_text_is_parsed_once(spark):
    from loomdex.operators.card_json import read_card

    cards = spark.createDataFrame([('{"title": "a", "sources": [{"chunk_id": "c"}]}',), ("{",), (None,)], "text string")
    read = cards.select(read_card(F.col("text")).alias("read")).select("read.type_errors", "read.card")
    assert [r["type_errors"] for r in read.collect()] == [[], ["the answer is no valid JSON"], []]
    assert read._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson(") == 1
