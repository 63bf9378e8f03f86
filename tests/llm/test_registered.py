"""The registered queries on the smallest tables, with their SQL where there is one."""

import os
from fractions import Fraction

import pytest
from compare import compare, duck
from pyspark.sql import functions as F

import corpus_pipeline
from loomdex.llm import registry
from loomdex.llm.minhash_tensor import remove_near_copies
from loomdex.llm.ngram_join import JaccardSettings, join_similar

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables not present")


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    found = registry.QUERIES[name](spark, SMALL)
    if name in registry.ORACLES:
        ok, rows, detail = compare(found, duck(SMALL), registry.ORACLES[name])
        assert ok and rows, detail
    elif name == "op12_whitening":
        assert found.count() == 32 * spark.read.parquet(f"{SMALL}/embeddings.parquet").count()
    else:
        assert found.count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()


def test_minhash_equals_the_exact_join(spark):
    """Two methods, one contract: the components at five words and 0.85."""
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    exact = join_similar(documents, JaccardSettings(width=5, threshold=Fraction(85, 100)))
    found = remove_near_copies(documents)
    columns = ("doc_id", "n_shingles", "component_id")
    rows = [sorted(map(tuple, df.select(*columns).collect())) for df in (exact, found)]
    assert rows[0] == rows[1] and any(i != c for i, _, c in rows[0])


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("ids", F.lit("clash"))
    docs = docs.union(docs.limit(1)).union(docs.limit(1).withColumn("text", F.lit(None).cast("string")))
    before, columns = docs.count(), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before, name
        before = docs.count()
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert last.count() == before and dict(last.dtypes)["ids"] == "array<int>"


def test_pipeline_run(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0
