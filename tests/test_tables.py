import statistics

import pytest
from pyspark.sql import functions as F

from loomdex.operators import accounting as acc
from loomdex.operators import state
from loomdex.schemas import CALLS
from loomdex.sources.versions import SlicedTable, VersionConflict

ROWS = [
    ("j1", "A", "m", 10, 5, "0.500000", 100, "ok", None),
    ("j1", "B", "m", 20, 5, "0.250000", 300, "ok", None),
    (None, "A", 'q"\\', None, None, "0.000000", 900, "error", "boom"),
    (None, "A", "n", 7, 1, "1.000000", None, "ok", None),
]


def calls(spark, rows=ROWS):
    frame = spark.createDataFrame(
        rows,
        "job_id STRING, agent STRING, model STRING, prompt_tokens INT, completion_tokens INT, "
        "cost STRING, latency_ms INT, outcome STRING, error STRING",
    )
    typed = frame.withColumn("cost", F.col("cost").cast("decimal(10,6)"))
    assert typed.schema.simpleString() == spark.createDataFrame([], CALLS).schema.simpleString()
    return typed


def test_totals(spark):
    row = acc.call_totals(calls(spark)).collect()[0]
    assert (row["calls"], row["calls_ok"], row["calls_error"]) == (4, 3, 1)
    assert (row["prompt_tokens"], row["completion_tokens"]) == (37, 11)
    assert float(row["cost_total"]) == 1.75 and row["cost_avg"] == pytest.approx(0.4375)
    assert row["latency_avg_ms"] == pytest.approx(1300 / 3)
    assert row["latency_p95_ms"] == pytest.approx(840.0)
    assert row["invalid_share"] == 0.25
    empty = acc.call_totals(calls(spark).limit(0)).collect()[0]
    assert empty["calls"] == 0 and empty["invalid_share"] == 0.0 and empty["latency_p95_ms"] is None


def test_percentile_is_exact(spark):
    values = [(i * 7919) % 2003 for i in range(1000)]
    rows = [(None, "A", "m", 1, 1, "0", v, "ok", None) for v in values]
    got = acc.call_totals(calls(spark, rows)).collect()[0]["latency_p95_ms"]
    ordered = sorted(values)
    assert got == pytest.approx(ordered[949] + 0.05 * (ordered[950] - ordered[949]))
    assert statistics.mean(values) == pytest.approx(acc.call_totals(calls(spark, rows)).collect()[0]["latency_avg_ms"])


def test_groupings(spark):
    frame = calls(spark)
    assert [r["agent"] for r in acc.calls_by(frame, "agent").collect()] == ["A", "B"]
    assert [r["model"] for r in acc.cost_by_model(frame).collect()] == ["n", "m", 'q"\\']
    assert [(r["job_id"], r["calls"]) for r in acc.job_cost(frame).collect()] == [("j1", 2)]
    assert acc.unattributed_cost(frame).collect()[0]["prompt_tokens"] == 7
    nobody = acc.unattributed_cost(frame.filter("job_id IS NOT NULL")).collect()[0]
    assert nobody["calls"] == 0 and nobody["cost"] == 0


def test_exposition(spark):
    jobs = spark.createDataFrame([("done",), ("failed",), ("done",)], "status STRING")
    text = acc.render_metrics(calls(spark), jobs, jobs.limit(0))
    lines = text.split("\n")
    assert lines[0] == "# llm_calls" and lines[2] == "llm_calls_total 4"
    assert "llm_cost_total 1.750000" in lines and "llm_latency_ms_p95 840.0" in lines
    assert 'llm_calls_by_model{model="q\\"\\\\"} 1' in lines
    assert lines.index("# jobs") < lines.index("jobs_total 3") < lines.index('jobs_total{status="done"} 2')
    assert lines[-2:] == ["documents_total 0", ""]
    nothing = acc.render_metrics(calls(spark, []), jobs, jobs).split("\n")
    assert nothing[2] == "llm_calls_total 0" and 'documents_total{status="failed"} 1' in nothing


def test_exposition_scans_every_table_once(spark, tmp_path):
    jobs = spark.createDataFrame([("done",), ("failed",), ("done",)], "status STRING")
    tables = {"calls": calls(spark), "jobs": jobs, "documents": jobs}
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / name))
    lines = acc.metrics_lines(*(spark.read.parquet(str(tmp_path / name)) for name in tables))
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 3, plan


def test_uploads(spark):
    uploads = spark.createDataFrame(
        [(1, "a.pdf", "pdf", b"x"), (2, "b.pdf", "pdf", b"x"), (3, "c.pdf", "pdf", b"y"), (4, "d.pdf", "pdf", b"old")],
        "seq INT, filename STRING, kind STRING, content BINARY",
    )
    existing = spark.createDataFrame([(b"old", "known")], "c BINARY, doc_id STRING").select(
        F.sha2("c", 256).alias("content_hash"), "doc_id"
    )
    rows = {r["filename"]: r for r in state.register_uploads(uploads, existing).collect()}
    assert set(rows) == {"a.pdf", "c.pdf", "d.pdf"}
    assert rows["a.pdf"]["copies"] == 2 and rows["a.pdf"]["created"]
    assert rows["d.pdf"]["doc_id"] == "known" and not rows["d.pdf"]["created"]
    assert len(rows["a.pdf"]["doc_id"]) == 12


def test_jobs(spark):
    requests = spark.createDataFrame(
        [(1, "k", "p1"), (2, "k", "p2"), (3, None, "p3"), (4, None, "p4"), (5, "", "p5"), (6, "", "p6"), (7, "old", "p7")],
        "seq INT, idempotency_key STRING, payload STRING",
    )
    existing = spark.createDataFrame([("job-old", "old"), ("x", None)], "job_id STRING, idempotency_key STRING")
    rows = state.create_jobs(requests, existing).collect()
    assert len(rows) == 6 and len({r["job_id"] for r in rows}) == 6
    by_seq = {r["seq"]: r for r in rows}
    assert by_seq[1]["requests"] == 2 and by_seq[1]["payload"] == "p1"
    assert by_seq[7]["job_id"] == "job-old" and not by_seq[7]["created"]
    assert sum(r["created"] for r in rows) == 5


def test_state_fold(spark):
    events = spark.createDataFrame(
        [
            ("j", 1, "retrieving", None, None),
            ("j", 2, "generating", None, None),
            ("j", 3, "generating", None, "slow"),
            ("j", 4, "done", "card", None),
            ("k", 1, "failed", None, None),
        ],
        "job STRING, seq INT, status STRING, result STRING, error STRING",
    )
    got = state.current_state(events, "job", ["status"], ["result", "error"], F.col("status") == "generating")
    rows = {r["job"]: tuple(r)[1:] for r in got.collect()}
    assert rows == {"j": ("done", "card", "slow", 2), "k": ("failed", None, None, 0)}


def test_reconcile_and_flags(spark):
    documents = spark.createDataFrame(
        [("a", "embed_failed", "e"), ("b", "embed_failed", "e"), ("c", "parsing", None), ("d", "failed", "e"), ("n", "new", None)],
        "doc_id STRING, status STRING, error STRING",
    )
    chunks = spark.createDataFrame([("a1", "a"), ("b1", "b"), ("b2", "b"), ("d1", "d")], "chunk_id STRING, doc_id STRING")
    vectors = spark.createDataFrame([("a1",), ("b1",), ("d1",)], "chunk_id STRING")
    pending = state.pending_chunks(chunks, vectors)
    assert [r["chunk_id"] for r in pending.collect()] == ["b2"]
    rows = {r["doc_id"]: (r["status"], r["error"]) for r in state.reconcile_indexed(documents, pending).collect()}
    assert rows == {
        "a": ("indexed", None),
        "b": ("embed_failed", "e"),
        # A document without chunks has none pending.
        "c": ("indexed", None),
        "d": ("failed", "e"),
        "n": ("new", None),
    }
    marked = state.mark_suspicious(
        chunks.withColumn("suspicious", F.col("chunk_id") == "a1"),
        spark.createDataFrame([("b1",), ("b1",), ("zz",)], "chunk_id STRING"),
    )
    assert {r["chunk_id"] for r in marked.filter("suspicious").collect()} == {"a1", "b1"}
    updates = spark.createDataFrame([("a1", "new"), ("z", "new")], "chunk_id STRING, v STRING")
    merged = state.upsert_vectors(vectors.withColumn("v", F.lit("old")), updates)
    assert {tuple(r) for r in merged.collect()} == {("a1", "new"), ("z", "new"), ("b1", "old"), ("d1", "old")}


def sliced(table):
    return sorted((r["doc_id"], r["v"]) for r in table.read().collect())


def test_reingest_rewrites_only_touched_slices(spark, tmp_path):
    table = SlicedTable(spark, str(tmp_path / "chunks"), slices=4)
    schema = "doc_id STRING, v INT"
    nobody = spark.createDataFrame([], "doc_id STRING")
    first = [(f"d{i}", 0) for i in range(20)]
    assert table.version() == 0
    with pytest.raises(ValueError, match="no version"):
        table.read()
    assert table.replace(spark.createDataFrame(first, schema), nobody) == 1 and sliced(table) == sorted(first)
    untouched = {f for f in table.read(1).filter("doc_id <> 'd3'").inputFiles()}
    assert table.replace(spark.createDataFrame([("d3", 1), ("d3", 2)], schema), nobody) == 2
    assert sliced(table) == sorted([r for r in first if r[0] != "d3"] + [("d3", 1), ("d3", 2)])
    kept = set(table.read().inputFiles()) & untouched
    assert len(kept) >= 3 * len(untouched) // 4 - 1 and len(table.read().select("slice").distinct().collect()) == 4
    # Old versions stay readable until they are vacuumed.
    assert table.read(1).count() == 20
    # Deleting every document of a slice leaves nothing of it.
    gone = table.read().filter("slice = 1").select("doc_id").distinct()
    names = {r["doc_id"] for r in gone.collect()}
    assert names and table.replace(spark.createDataFrame([], schema), gone) == 3
    assert {r["doc_id"] for r in table.read().collect()} == {f"d{i}" for i in range(20)} - names
    table.vacuum()
    assert sliced(table) == sorted(r for r in sliced(table) if r[0] not in names) and table.version() == 3
    everything = table.read().select("doc_id")
    assert table.replace(spark.createDataFrame([], schema), everything) == 4 and sliced(table) == []


def test_a_failure_between_the_steps_leaves_the_old_version(spark, tmp_path, monkeypatch):
    table = SlicedTable(spark, str(tmp_path / "chunks"), slices=4)
    nobody = spark.createDataFrame([], "doc_id STRING")
    rows = [(f"d{i}", 0) for i in range(20)]
    table.replace(spark.createDataFrame(rows, "doc_id STRING, v INT"), nobody)
    fresh = spark.createDataFrame([("d1", 7)], "doc_id STRING, v INT")
    opened = table.read()

    def dies(self, version, manifest):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(SlicedTable, "_commit", dies)
        with pytest.raises(OSError, match="lost"):
            table.replace(fresh, nobody)
    assert table.version() == 1 and sliced(table) == sorted(rows)
    # The next attempt takes the same number; whoever opened the old version keeps it.
    assert table.replace(fresh, nobody) == 2 and ("d1", 7) in sliced(table)
    assert sorted((r["doc_id"], r["v"]) for r in opened.collect()) == sorted(rows)
    with pytest.raises(VersionConflict):
        table._commit(2, {"schema": None, "slices": {}})
    assert table.version() == 2 and ("d1", 7) in sliced(table)


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    from loomdex.plans.retrieval import Corpus, searchable
    from loomdex.sources.tables import save_bucketed, save_postings

    vectors = spark.createDataFrame([(f"c{i}", f"d{i % 7}", [1.0, float(i)]) for i in range(40)],
                                    "chunk_id STRING, doc_id STRING, embedding ARRAY<FLOAT>")
    documents = spark.createDataFrame([(f"d{i}", "f", "indexed") for i in range(7)],
                                      "doc_id STRING, filename STRING, status STRING")
    stored_vectors = save_bucketed(vectors, "t_vectors", 4, path=str(tmp_path / "v"))
    stored_documents = save_bucketed(documents, "t_documents", 4, path=str(tmp_path / "d"))
    corpus = Corpus(stored_vectors, stored_vectors, stored_documents)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pool = searchable(stored_vectors, corpus, None)
        plan = pool._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and pool.count() == 40
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE t_vectors")
        spark.sql("DROP TABLE t_documents")
    index = spark.createDataFrame([("a", f"c{i}", "d", 1) for i in range(50)], "lexeme STRING, chunk_id STRING, doc_id STRING, tf INT")
    save_postings(index, str(tmp_path / "p"), 3)
    assert spark.read.parquet(str(tmp_path / "p")).count() == 50
