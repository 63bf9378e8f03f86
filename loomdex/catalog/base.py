"""How the given tables stand in for documents, chunks, queries and calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.functions.vectors import l2_normalize
from loomdex.plans.retrieval import Corpus
from loomdex.session import read_table


def document_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, filename, status: a document labelled toxic is not searchable."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id",
        F.concat_ws("_", "source", F.col("doc_id").cast("string")).alias("filename"),
        F.when(F.col("toxic") == 1, "failed").otherwise("indexed").alias("status"),
    )


def corpus(spark: SparkSession, sf_dir: str, analyzer: str = "simple") -> Corpus:
    """One chunk per document; documents without a vector row are pending."""
    chunks = read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"),
        "doc_id",
        "text",
        F.struct(F.col("lang").alias("brand"), F.col("source").alias("section")).alias("metadata"),
    )
    vectors = read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("doc_id"), "embedding"
    )
    return Corpus(chunks, vectors, document_table(spark, sf_dir), analyzer=analyzer)


def chunk_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.col("label").alias("family")
    )


def family_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(family, query_vec): unit mean vector of every label, over the whole table."""
    elements = read_table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("family"), F.posexplode("embedding").alias("position", "value")
    )
    means = elements.groupBy("family", "position").agg(
        F.avg(F.col("value").cast("double")).alias("mean")
    )
    vectors = means.groupBy("family").agg(
        F.sort_array(F.collect_list(F.struct("position", "mean"))).alias("items")
    )
    return vectors.select("family", l2_normalize(F.col("items.mean")).alias("query_vec"))


def query_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text is a query; its vector is that of the family it is
    assigned to in turn."""
    return query_families(spark, sf_dir).join(family_vectors(spark, sf_dir), "family", "left")


def query_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query_text, family) of every search."""
    families = read_table(spark, sf_dir, "embeddings").agg(F.max("label") + 1).scalar()
    return read_table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.col("text").alias("query_text"),
        F.pmod(F.col("item_id"), families).cast("int").alias("family"),
    )


def doc_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document filter used by the filtered searches: documents of good quality."""
    return read_table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")


# The same mapping in SQL; WORDS is the simple analyzer.
WORDS = (
    "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda w: w <> '')"
)

_WORDS_IN_FORMAT = WORDS.replace("{", "{{").replace("}", "}}")

DOCS_SQL = """
docs AS (
  SELECT d.doc_id, d.source || '_' || d.doc_id AS filename,
         CASE WHEN l.toxic = 1 THEN 'failed' ELSE 'indexed' END AS status
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
chunks AS (
  SELECT d.doc_id AS chunk_id, d.doc_id, d.text, e.embedding, d.lang AS brand, d.source AS section
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id),
pool AS (
  SELECT c.* FROM chunks c JOIN docs d ON d.doc_id = c.doc_id WHERE d.status = 'indexed' {filter})"""

QUERY_SQL = """
elements AS (
  SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings),
means AS (SELECT label, pos, avg(v) AS m FROM elements GROUP BY label, pos),
mean_vectors AS (SELECT label, list(m ORDER BY pos) AS vec FROM means GROUP BY label),
family_vectors AS (
  SELECT label, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) AS vec
  FROM mean_vectors),
q AS (
  SELECT b.item_id AS query_id, b.text, f.label AS family, f.vec
  FROM benchmark b JOIN family_vectors f
    ON f.label = b.item_id % (SELECT max(label) + 1 FROM embeddings))"""

VECTOR_LEG_SQL = """
cosines AS (
  SELECT q.query_id, c.chunk_id, round(list_dot_product(c.embedding::DOUBLE[], q.vec), 12) AS cosine
  FROM q, pool c WHERE c.embedding IS NOT NULL),
vleg AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, chunk_id) AS rank FROM cosines)
  WHERE rank <= {depth})"""

FTS_LEG_SQL = (
    """
qlex AS (SELECT DISTINCT query_id, lexeme FROM (SELECT query_id, unnest("""
    + _WORDS_IN_FORMAT
    + """) AS lexeme FROM q)),
qsize AS (SELECT query_id, count(*) AS n FROM qlex GROUP BY query_id),
postings AS (
  SELECT chunk_id, lexeme, count(*) AS tf
  FROM (SELECT chunk_id, unnest("""
    + _WORDS_IN_FORMAT
    + """) AS lexeme FROM pool) GROUP BY chunk_id, lexeme),
fts AS (
  SELECT l.query_id, p.chunk_id,
         round(sum(0.1::DOUBLE * list_sum(list_transform(range(1, least(p.tf, 255) + 1),
               lambda j: 1.0::DOUBLE / (j * j))) / 1.64493406685::DOUBLE / s.n), 12) AS score
  FROM postings p JOIN qlex l ON l.lexeme = p.lexeme JOIN qsize s ON s.query_id = l.query_id
  GROUP BY l.query_id, p.chunk_id),
fleg AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fts)
  WHERE rank <= {depth})"""
)

LEGS_SQL = """
legs AS (
  SELECT coalesce(v.query_id, f.query_id) AS query_id, coalesce(v.chunk_id, f.chunk_id) AS chunk_id,
         v.rank AS vec_rank, v.cosine, f.rank AS fts_rank,
         round(coalesce(1.0::DOUBLE / (60 + v.rank), 0) + coalesce(1.0::DOUBLE / (60 + f.rank), 0), 12) AS rrf
  FROM vleg v FULL OUTER JOIN fleg f ON f.query_id = v.query_id AND f.chunk_id = v.chunk_id)"""

HYBRID_SQL = """
ranked AS (
  SELECT *, row_number() OVER (
    PARTITION BY query_id ORDER BY rrf DESC, coalesce(cosine, 0) DESC, chunk_id) AS rank
  FROM legs WHERE fts_rank IS NOT NULL OR cosine >= {threshold}),
hybrid AS (SELECT * FROM ranked WHERE rank <= {k}),
scored AS (
  SELECT h.query_id, h.rank, h.chunk_id, round(h.rrf, 9) AS rrf_score,
         round(list_dot_product(c.embedding::DOUBLE[], q.vec), 6) AS score
  FROM hybrid h JOIN chunks c ON c.chunk_id = h.chunk_id JOIN q ON q.query_id = h.query_id)"""

GOOD_DOCS_SQL = "AND c.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)"


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)
