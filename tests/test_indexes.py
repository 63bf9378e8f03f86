"""Stored forms of a corpus: equal results, and what they save."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomdex.functions.lexemes import weight_table
from loomdex.operators.block_max import BlockSettings, save_blocks
from loomdex.operators.vector_cells import CellSettings, nearest_centroid, open_cells, save_cells
from loomdex.plans.retrieval import Corpus, index_use, search, search_fts, search_vector
from loomdex.sources.tables import drop_corpus, open_corpus, save_corpus

FAMILIES, WIDTH = 8, 6


def clustered(spark, n=300, seed=1):
    """Vectors around a few directions, some of deleted or failed documents, some pending."""
    rng, words = np.random.default_rng(seed), [f"w{k}" for k in range(60)]
    centres = rng.normal(size=(FAMILIES, WIDTH)) * 3
    rows, texts = [], random.Random(seed)
    for k in range(n):
        v = centres[k % FAMILIES] + rng.normal(size=WIDTH) * 0.1
        v = v / np.linalg.norm(v)
        text = " ".join(texts.choices(words[: 10 + k % FAMILIES * 6], k=texts.randrange(1, 40)))
        rows.append((k, k, text, None if k % 17 == 0 else [round(float(x), 4) for x in v]))
    rows += [(n + k, k, rows[k][2], rows[k][3]) for k in range(20)]  # ties
    chunks = spark.createDataFrame(rows, "chunk_id long, doc_id long, text string, embedding array<float>")
    documents = [(k, f"f{k}", "failed" if k % 13 == 0 else "indexed") for k in range(n) if k % 11]
    documents = spark.createDataFrame(documents, "doc_id long, filename string, status string")
    queries = [(f"q{k}", " ".join(texts.choices(words, k=3)) if k else "?!", [float(x) for x in centres[k] / np.linalg.norm(centres[k])]) for k in range(FAMILIES)]
    queries = spark.createDataFrame(queries, "query_id string, query_text string, query_vec array<double>")
    return Corpus.from_chunk_table(chunks, documents, analyzer="simple"), queries


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_cells_lose_nothing_and_skip(spark, tmp_path):
    corpus, queries = clustered(spark)
    cells = save_cells(corpus.vectors, str(tmp_path), 3, CellSettings(cells=16))
    stored = Corpus(corpus.chunks, corpus.vectors, corpus.documents, analyzer="simple", cells=cells)
    for k, ids in ((1, None), (5, None), (40, None), (1000, None), (5, [1, 2, 3, 30]), (5, [0])):
        want = rows(search_vector(queries, corpus, top_k=k, threshold=-1.0, doc_ids=ids))
        assert rows(search_vector(queries, stored, top_k=k, threshold=-1.0, doc_ids=ids)) == want
    used = index_use(queries, stored, top_k=5).collect()
    assert all(0 < r["cells_read"] < r["cells"] / 2 and r["blocks"] is None for r in used)
    # Every cell that is not read is below the k-th best by its stored radius.
    best = {q: s for q, _, _, s in rows(search_vector(queries, corpus, top_k=5, threshold=-1.0).filter("rank = 5"))}
    table = cells.cells.collect()
    live = {r["cell"] for r in cells.vectors.join(corpus.documents.filter("status = 'indexed'"), "doc_id").select("cell").distinct().collect()}
    for r in queries.collect():
        vec = np.array(r["query_vec"])
        reach = [c["cell"] for c in table if c["cell"] in live and vec @ np.array(c["centroid"]) + c["radius"] >= best[r["query_id"]]]
        assert next(u["cells_read"] for u in used if u["query_id"] == r["query_id"]) >= len(reach)


def test_cells_hold_their_vectors(spark, tmp_path):
    corpus, _ = clustered(spark)
    save_cells(corpus.vectors, str(tmp_path), 3, CellSettings(cells=7))
    cells = open_cells(spark, str(tmp_path))
    centroids = {r["cell"]: (np.array(r["centroid"]), r["radius"]) for r in cells.cells.collect()}
    stored = cells.vectors.collect()
    assert len(stored) == corpus.vectors.count()
    for r in stored:
        centroid, radius = centroids[r["cell"]]
        assert np.linalg.norm(np.array(r["embedding"], np.float64) - centroid) <= radius + 1e-12


def test_cells_of_nothing(spark, tmp_path):
    corpus, queries = clustered(spark)
    cells = save_cells(corpus.vectors.limit(0), str(tmp_path / "none"), 2)
    empty = Corpus(corpus.chunks, corpus.vectors, corpus.documents, cells=cells, analyzer="simple")
    assert rows(search_vector(queries, empty, top_k=3, threshold=-1.0)) == []
    assert {r["cells_read"] for r in index_use(queries, empty).collect()} == {0}
    one = save_cells(corpus.vectors.filter("chunk_id = 1"), str(tmp_path / "one"), 2)
    assert one.cells.count() == 1
    owner, distance = nearest_centroid(np.array([[1.0, 0.0]]), np.array([[0.0, 0.0], [1.0, 1.0]]))
    assert owner.tolist() == [0] and distance.tolist() == [1.0]


@pytest.mark.parametrize("block_chunks", [1, 16, 5000])
def test_blocks_lose_nothing_and_skip(spark, tmp_path, block_chunks):
    corpus, queries = clustered(spark)
    blocks = save_blocks(corpus.chunks, str(tmp_path / "blocks"), 3, settings=BlockSettings(block_chunks))
    stored = Corpus(corpus.chunks, corpus.vectors, corpus.documents, analyzer="simple", blocks=blocks)
    for k, ids in ((1, None), (4, None), (1000, None), (3, [1, 2, 3, 30]), (3, [0])):
        want = rows(search_fts(queries, corpus, top_k=k, doc_ids=ids))
        assert rows(search_fts(queries, stored, top_k=k, doc_ids=ids)) == want
    used = {r["query_id"]: r for r in index_use(queries, stored, top_k=2).collect()}
    assert used["q0"]["blocks"] == 0  # a query without words
    assert all(r["blocks_read"] <= r["blocks"] for r in used.values())
    if block_chunks == 1:
        assert sum(r["blocks_read"] for r in used.values()) < 0.7 * sum(r["blocks"] for r in used.values())
    tops = blocks.withColumn("most", F.array_max(F.transform("entries", lambda e: e["weight"])))
    assert tops.filter("top <> most").count() == 0
    assert blocks.agg(F.max("top")).first()[0] <= max(weight_table())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_corpus_moves_no_vector(spark, tmp_path):
    corpus, queries = clustered(spark)
    names = ("chunks", "vectors", "documents")
    tables = save_corpus({n: getattr(corpus, n) for n in names}, "bucketed_test", 4, str(tmp_path))
    try:
        stored = Corpus(**open_corpus(spark, "bucketed_test", names), analyzer="simple")
        assert tables.keys() == set(names)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for searcher in (search_vector, search_fts):
            found = searcher(queries, stored, top_k=5)
            lines = [line for line in plan_of(found).splitlines() if "Exchange" in line]
            assert lines and not any("doc_id" in line for line in lines), lines
            assert any("doc_id" in line for line in plan_of(searcher(queries, corpus, top_k=5)).splitlines() if "Exchange" in line)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for mode in ("vector", "fts", "hybrid"):
            columns = ("query_id", "rank", "chunk_id", "filename")
            assert rows(search(queries, stored, mode=mode, top_k=5).select(*columns)) == rows(search(queries, corpus, mode=mode, top_k=5).select(*columns))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        drop_corpus(spark, "bucketed_test", names)
    assert not spark.catalog.tableExists("bucketed_test_vectors")


def test_blocks_are_scored_where_they_are_stored(spark, tmp_path):
    corpus, queries = clustered(spark)
    blocks = save_blocks(corpus.chunks, str(tmp_path / "blocks"), 4, settings=BlockSettings(16))
    stored = Corpus(corpus.chunks, corpus.vectors, corpus.documents, analyzer="simple", blocks=blocks)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = [x for x in plan_of(search_fts(queries, stored, top_k=5)).splitlines() if "Exchange hashpartitioning" in x]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert lines and not any("lexeme" in x or "chunk_id" in x for x in lines), lines
