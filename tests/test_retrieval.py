import math
import os
import subprocess
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomdex.functions.lexemes import weight_table
from loomdex.functions.vectors import l2_normalize, stored_precision
from loomdex.operators import query_batch, sweep
from loomdex.operators.context import build_context, context_chunk_ids, pack_order
from loomdex.operators.fulltext import fulltext_leg, postings, query_lexemes, stored_leg
from loomdex.operators.nearest import vector_leg
from loomdex.operators.ordinals import group_ordinals
from loomdex.plans.retrieval import (
    Corpus,
    chunks_of_documents,
    hybrid_legs,
    search,
    search_fts,
    search_hybrid,
    search_vector,
)
from loomdex.schemas import CHUNK_METADATA

BLENDER, KETTLE = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
BOTH = [1 / math.sqrt(2), 1 / math.sqrt(2), 0.0]
ROWS = [
    ("tstc1", 0, "Мощность блендера 800 Вт", BLENDER, "A"),
    ("tstc2", 1, "Чайник 2200 Вт, объём 1.7 л", KETTLE, "B"),
    ("tstc3", 2, "Гарантия 24 месяца", BOTH, "A"),
]
PENDING = ("tstc4", 3, "Мощность блендера 800 Вт, двойная стенка корпуса", None, None)


def make_corpus(spark, rows=tuple(ROWS), status="indexed", **options):
    table = spark.createDataFrame(
        [(c, "tstdoc1", o, t, v, ("tstdoc1", 1, "", None, b)) for c, o, t, v, b in rows],
        "chunk_id STRING, doc_id STRING, ordinal INT, text STRING, embedding ARRAY<FLOAT>, "
        f"metadata {CHUNK_METADATA}",
    )
    documents = spark.createDataFrame(
        [("tstdoc1", "test.pdf", status)], "doc_id STRING, filename STRING, status STRING"
    )
    return Corpus.from_chunk_table(table, documents, **options)


def ask(spark, *texts):
    rows = [(t, t, BLENDER if "блендер" in t.lower() else KETTLE) for t in texts]
    return spark.createDataFrame(rows, "query_id STRING, query_text STRING, query_vec ARRAY<DOUBLE>")


def ids(frame):
    return [r["chunk_id"] for r in frame.orderBy("rank").collect()]


def test_vector_search(spark):
    corpus = make_corpus(spark)
    got = search_vector(ask(spark, "мощность блендера"), corpus, top_k=3).orderBy("rank").collect()
    assert got[0]["chunk_id"] == "tstc1" and got[0]["score"] >= 0.9
    assert [r["chunk_id"] for r in got] == ["tstc1", "tstc3"]
    assert ids(search_vector(ask(spark, "мощность блендера"), corpus, threshold=0.99)) == ["tstc1"]
    everything = search_vector(ask(spark, "мощность блендера"), corpus, top_k=0, threshold=0.0)
    assert ids(everything) == ["tstc1", "tstc3", "tstc2"]


@pytest.mark.parametrize("analyzer", ["simple", "russian"])
def test_fulltext_search(spark, analyzer):
    corpus = make_corpus(spark, analyzer=analyzer)
    assert ids(search_fts(ask(spark, "гарантия"), corpus)) == ["tstc3"]
    assert set(ids(search_fts(ask(spark, "блендера гарантия"), corpus))) == {"tstc1", "tstc3"}
    assert ids(search_fts(ask(spark, "  ... "), corpus)) == []
    stemmed = ids(search_fts(ask(spark, "гарантии блендеров"), corpus))
    assert set(stemmed) == ({"tstc1", "tstc3"} if analyzer == "russian" else set())
    one = search_fts(ask(spark, "гарантия"), corpus).collect()[0]["score"]
    assert one == pytest.approx(0.0607927, abs=1e-6)
    two = search_fts(ask(spark, "гарантия утюг"), corpus).collect()[0]["score"]
    assert two == pytest.approx(one / 2, abs=1e-9)


def test_stored_postings_give_the_same_ranking(spark):
    corpus = make_corpus(spark, analyzer="russian")
    indexed = make_corpus(spark, analyzer="russian", index=postings(corpus.chunks, "russian"))
    query = ask(spark, "мощность гарантия вт", "чайник")
    left = {tuple(r) for r in search_fts(query, corpus).collect()}
    assert left == {tuple(r) for r in search_fts(query, indexed).collect()} and len(left) >= 4


def test_hybrid_search(spark):
    corpus = make_corpus(spark, [*ROWS, PENDING])
    assert ids(search_hybrid(ask(spark, "мощность блендера"), make_corpus(spark), top_k=3))[0] == "tstc1"
    strict = search_hybrid(ask(spark, "мощность блендера"), corpus, threshold=0.9, doc_ids=["tstdoc1"])
    rows = {r["chunk_id"]: r for r in strict.collect()}
    assert set(rows) == {"tstc1", "tstc4"}
    assert rows["tstc4"]["score"] is None
    # The query vector is that of the kettle, so the cosine of tstc1 is zero.
    kept = search_hybrid(ask(spark, "мощность"), make_corpus(spark), threshold=0.35)
    assert "tstc1" in ids(kept)
    wide = ids(search_hybrid(ask(spark, "блендера гарантия"), corpus, top_k=50))
    assert {"tstc1", "tstc3"} <= set(wide)
    # Rank 1 in both legs, then once in one leg.
    best = rows["tstc1"]["rrf_score"]
    assert best == pytest.approx(2 / 61, abs=1e-9)


def test_document_filter_and_status(spark):
    query = ask(spark, "мощность блендера")
    corpus = make_corpus(spark)
    for searcher in (search_vector, search_fts, search_hybrid):
        assert ids(searcher(query, corpus, doc_ids=["unknown"])) == []
        assert ids(searcher(query, corpus, doc_ids=[])) != []
        assert ids(searcher(query, make_corpus(spark, status="embed_failed"))) == []


def test_rows_without_a_document_are_not_found(spark):
    """Vectors and texts of deleted documents stay stored for a while."""
    corpus = make_corpus(spark)
    gone = {"chunk_id": F.lit("gone"), "doc_id": F.lit("gone")}
    with_orphans = Corpus(
        corpus.chunks.union(corpus.chunks.withColumns(gone)),
        corpus.vectors.union(corpus.vectors.withColumns(gone)),
        corpus.documents,
    )
    for mode in ("vector", "fts", "hybrid"):
        asked = ask(spark, "мощность блендера")
        found = {r["chunk_id"] for r in search(asked, with_orphans, mode=mode, top_k=10).collect()}
        assert found == {r["chunk_id"] for r in search(asked, corpus, mode=mode, top_k=10).collect()}
        assert "gone" not in found


FOREIGN = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
sys.path.remove({root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
print("ROWS", entry.queries()["hybrid_search"](spark, {small!r}).count())
"""


def test_search_needs_no_package_on_the_workers(tmp_path):
    """Started elsewhere without PYTHONPATH, the workers cannot import the package."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    small = "/root/testdata/sf0.001"
    if not os.path.isdir(small):
        pytest.skip("test tables not present")
    script = tmp_path / "foreign.py"
    script.write_text(FOREIGN.format(root=root, small=small))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in done.stdout, done.stderr[-2000:]


def test_facade(spark):
    corpus = make_corpus(spark)
    found = search(ask(spark, "мощность блендера"), corpus, mode="vector", threshold=0.0, brand="A", top_k=3)
    rows = found.orderBy("rank").collect()
    assert [r["chunk_id"] for r in rows] == ["tstc1", "tstc3"]
    assert rows[0]["filename"] == "test.pdf" and rows[0]["text"].startswith("Мощность")
    assert search(ask(spark, "мощность"), corpus, mode="fts").count() == 1
    with pytest.raises(ValueError, match="unknown search mode"):
        search(ask(spark, "x"), corpus, mode="other")


def test_full_document_scan_ignores_status(spark):
    corpus = make_corpus(spark, [*ROWS, PENDING], status="failed")
    assert chunks_of_documents(corpus, ["tstdoc1"]).count() == 4
    assert chunks_of_documents(corpus, []).count() == 0


def test_vector_leg_equals_brute_force_with_ties(spark):
    rng = np.random.default_rng(3)
    vectors = rng.integers(-1, 2, size=(300, 4)).astype(float)
    queries = rng.normal(size=(7, 4))
    frame = spark.createDataFrame(
        [(f"c{i:03d}", v.tolist()) for i, v in enumerate(vectors)], "chunk_id STRING, embedding ARRAY<FLOAT>"
    ).repartition(5)
    batch = spark.createDataFrame(
        [(i, "", q.tolist()) for i, q in enumerate(queries)] + [(99, "", None)],
        "query_id INT, query_text STRING, query_vec ARRAY<DOUBLE>",
    )
    block = next(query_batch.query_blocks(batch))
    got = {}
    for r in vector_leg(block, frame, 10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    for i, q in enumerate(queries):
        order = sorted(range(300), key=lambda j: (-round(float(vectors[j] @ q), 12), j))
        assert got[i] == [f"c{j:03d}" for j in order[:10]]
    assert 99 not in got
    with pytest.raises(Exception, match="expected 4 dimensions, not 3"):
        odd = spark.createDataFrame([("odd", [1.0, 2.0, 3.0])], "chunk_id STRING, embedding ARRAY<FLOAT>")
        vector_leg(block, frame.union(odd), 10).collect()


def test_fulltext_leg_equals_plain_counting(spark):
    """Chunks of common and rare words, ties, repeated words, no words at all."""
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choice(vocabulary, size=n, p=np.arange(30, 0, -1) / 465)) for n in rng.integers(0, 60, size=300)]
    texts[7], texts[8] = None, "w1 " * 400
    chunks = spark.createDataFrame([(f"c{i:03d}", f"d{i}", t) for i, t in enumerate(texts)], "chunk_id STRING, doc_id STRING, text STRING")
    asked = [" ".join(rng.choice(vocabulary, size=n)) for n in (1, 2, 5, 9)] + ["", "?!", "unknown", None]
    batch = spark.createDataFrame(list(enumerate(asked)), "query_id INT, query_text STRING")
    block = next(query_batch.query_blocks(batch))
    got = {}
    for r in fulltext_leg(block, chunks.repartition(5), 10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["chunk_id"], r["score"]))
    table = weight_table()
    for i, query in enumerate(asked):
        terms = set((query or "").split()) - {"?!"}
        scored = []
        for c, text in enumerate(texts):
            counts = Counter((text or "").split())
            hit = [table[min(counts[t], 255) - 1] for t in terms if counts[t]]
            if hit:
                scored.append((f"c{c:03d}", round(sum(h / len(terms) for h in hit), 12)))
        best = sorted(scored, key=lambda x: (-x[1], x[0]))[:10]
        assert [c for c, _ in got.get(i, [])] == [c for c, _ in best]
        assert [s for _, s in got.get(i, [])] == pytest.approx([s for _, s in best], abs=1e-11)
    stored = stored_leg(block, postings(chunks), 10).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["chunk_id"]) for r in stored] == [(i, c) for i in sorted(got) for c, _ in got[i]]


def exchanges(frame):
    """What is shuffled, for a plan in which nothing is broadcast."""
    spark = frame.sparkSession
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange" in line]


def test_legs_shuffle_only_the_best_of_each_task(spark):
    corpus = make_corpus(spark)
    stored = Corpus(
        *(t.withColumn("status", F.lit("indexed")) for t in (corpus.chunks, corpus.vectors)), corpus.documents
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for searcher in (search_vector, search_fts):
            found = exchanges(searcher(ask(spark, "мощность блендера"), stored))
            assert len(found) == 1 and "hashpartitioning(query_id" in found[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_many_queries_run_in_blocks(spark, monkeypatch):
    corpus = make_corpus(spark)
    texts = [f"мощность блендера {i}" for i in range(9)]
    whole = {tuple(r) for r in search_hybrid(ask(spark, *texts), corpus).collect()}
    monkeypatch.setattr(query_batch, "QUERY_BLOCK", 4)
    assert len(list(query_batch.query_blocks(ask(spark, *texts)))) == 5
    assert {tuple(r) for r in search_hybrid(ask(spark, *texts), corpus).collect()} == whole


def test_vectors(spark):
    frame = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v ARRAY<FLOAT>")
    assert [r[0] for r in frame.select(l2_normalize(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    exact = spark.createDataFrame([([0.12345678],)], "v ARRAY<DOUBLE>")
    assert exact.select(stored_precision(F.col("v"))).collect()[0][0][0] == pytest.approx(0.123457, abs=1e-8)


def test_query_lexemes_are_distinct(spark):
    rows = query_lexemes(ask(spark, "да да нет", "")).collect()
    assert sorted(sorted(r["lexemes"]) for r in rows) == [[], ["да", "нет"]]


def simulate(vec, fts, threshold, k):
    found = {c for c in fts} | {c for c, cos in vec if cos >= threshold}
    vec_rank = {c: i for i, (c, _) in enumerate(vec, 1)}
    fts_rank = {c: i for i, c in enumerate(fts, 1)}
    cosine = dict(vec)
    def score(c):
        return sum(1 / (60 + r[c]) for r in (vec_rank, fts_rank) if c in r)

    return sorted(found, key=lambda c: (-round(score(c), 12), -cosine.get(c, 0.0), c))[:k]


def test_sweep_matches_a_per_query_simulation(spark):
    vec = [("a", 0.9), ("b", 0.5), ("c", 0.3), ("d", 0.1)]
    fts = ["c", "x", "b"]
    rows = [("q", c, i, cos, None) for i, (c, cos) in enumerate(vec, 1)]
    legs = {c: [r, cos, None] for (_, c, r, cos, _) in rows}
    for i, c in enumerate(fts, 1):
        legs.setdefault(c, [None, None, None])[2] = i
    frame = spark.createDataFrame(
        [("q", c, r, cos, f) for c, (r, cos, f) in legs.items()],
        "query_id STRING, chunk_id STRING, vec_rank INT, cosine DOUBLE, fts_rank INT",
    )
    grid = (0.0, 0.35, 0.95)
    got = {}
    for r in sweep.hybrid_by_threshold(frame, 3, grid).orderBy("threshold", "rank").collect():
        got.setdefault(r["threshold"], []).append(r["chunk_id"])
    assert got == {t: simulate(vec, fts, t, 3) for t in grid}

    queries = spark.createDataFrame([("q", 1), ("empty", 1)], "query_id STRING, family INT")
    families = spark.createDataFrame(
        [("a", 1), ("b", 1), ("c", 2), ("d", 1), ("x", 2)], "chunk_id STRING, family INT"
    )
    pure = {r["threshold"]: r for r in sweep.purity(
        sweep.hybrid_by_threshold(frame, 3, grid), queries, families, 3, grid).collect()}
    assert pure[0.0]["in_family"] == pytest.approx(sum(c in "abd" for c in got[0.0]) / 2)
    first = sweep.first_foreign(frame, queries, families).collect()
    assert [(r["rank"], r["cosine"]) for r in first] == [(3, 0.3)]
    flat = spark.createDataFrame([(t, 4.0 if t < 0.3 else 3.5) for t in sweep.THRESHOLDS], "threshold DOUBLE, in_family DOUBLE")
    assert tuple(sweep.recommend(flat).collect()[0]) == (0.0, 0.25, 0.25)
    assert sweep.recommend(flat, 0.1).collect()[0]["best"] == 0.1


def pack(spark, rows, limit):
    frame = spark.createDataFrame(rows, "job_id STRING, chunk_id STRING, rank INT, body_chars INT")
    return [r["chunk_id"] for r in pack_order(frame, limit).orderBy("position").collect()]


def test_context_budget(spark):
    assert pack(spark, [("j", "a", 1, 50), ("j", "b", 2, 60), ("j", "c", 3, 10)], 100) == ["a"]
    assert pack(spark, [("j", "a", 1, 500), ("j", "b", 2, 10)], 100) == ["a"]
    assert pack(spark, [("j", "a", 1, 40), ("j", "a", 2, 40), ("j", "b", 3, 60)], 100) == ["a", "b"]
    many = [("j", f"c{i:04d}", i, 7) for i in range(3000)]
    assert len(pack(spark, many, 700)) == 100


def test_context_text(spark):
    rows = [
        ("j", 1, "abc1", "f.pdf", ("d", 2, "Раздел", None, None), "первый"),
        ("j", 2, "abc2", "f.pdf", ("d", 0, "", None, None), "второй"),
        ("j", 3, "abc1", "f.pdf", ("d", 2, "Раздел", None, None), "первый"),
    ]
    frame = spark.createDataFrame(
        rows, f"job_id STRING, rank INT, chunk_id STRING, filename STRING, metadata {CHUNK_METADATA}, text STRING"
    )
    got = build_context(frame)
    context = got.collect()[0]["context"]
    assert context == "[abc1 | f.pdf | стр. 2 | Раздел]\nпервый\n\n[abc2 | f.pdf]\nвторой"
    assert got.collect()[0]["allowed_ids"] == ["abc1", "abc2"]
    assert got.select(context_chunk_ids(F.col("context"))).collect()[0][0] == ["abc1", "abc2"]


def test_ordinals_of_a_dominating_group(spark):
    rows = [("hot", i * 3) for i in range(2500)] + [(f"k{i}", i) for i in range(50)]
    frame = spark.createDataFrame(rows, "k STRING, t INT").repartition(7)
    numbered = group_ordinals(frame, ["k"], ["t"], F.expr("t DIV 100")).collect()
    hot = sorted((r["t"], r["ordinal"]) for r in numbered if r["k"] == "hot")
    assert [o for _, o in hot] == list(range(1, 2501))
    assert all(r["ordinal"] == 1 for r in numbered if r["k"] != "hot")
