"""Search, fusion and threshold-measurement queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.catalog import query
from loomdex.catalog.base import (
    DOCS_SQL,
    FTS_LEG_SQL,
    GOOD_DOCS_SQL,
    HYBRID_SQL,
    LEGS_SQL,
    QUERY_SQL,
    VECTOR_LEG_SQL,
    WORDS,
    chunk_families,
    corpus,
    doc_filter,
    family_vectors,
    query_batch,
    query_families,
    with_ctes,
)
from loomdex.catalog.stems_sql import stems_sql
from loomdex.functions.vectors import l2_normalize, stored_precision
from loomdex.operators import sweep
from loomdex.operators.block_max import BlockSettings, save_blocks
from loomdex.operators.fulltext import postings, vocabulary
from loomdex.operators.state import upsert_vectors
from loomdex.operators.vector_cells import save_cells
from loomdex.plans import retrieval
from loomdex.plans.retrieval import Corpus
from loomdex.session import read_table, scratch_folder
from loomdex.sources.tables import drop_corpus, save_corpus, save_postings

TOP_K = 5
THRESHOLD = 0.33
GRID = (0.0, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5)

NO_FILTER = DOCS_SQL.format(filter="")
GOOD_ONLY = DOCS_SQL.format(filter=GOOD_DOCS_SQL)


def _inputs(spark: SparkSession, sf_dir: str, **options) -> tuple[DataFrame, Corpus]:
    return query_batch(spark, sf_dir), corpus(spark, sf_dir, **options)


def _rounded(hits: DataFrame) -> DataFrame:
    columns = ["query_id", F.col("rank").cast("long").alias("rank"), "chunk_id"]
    if "rrf_score" in hits.columns:
        columns.append(F.round("rrf_score", 9).alias("rrf_score"))
    return hits.select(*columns, F.round("score", 6).alias("score"))


@query(
    with_ctes(NO_FILTER, QUERY_SQL, VECTOR_LEG_SQL.format(depth=TOP_K))
    + " SELECT query_id, rank, chunk_id, round(cosine, 6) AS score FROM vleg"
)
def vector_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(
        retrieval.search_vector(*_inputs(spark, sf_dir), top_k=TOP_K, threshold=-1.0)
    )


_TOP_K_SQL = (
    with_ctes(NO_FILTER, QUERY_SQL, VECTOR_LEG_SQL.format(depth=TOP_K))
    + " SELECT query_id, rank, chunk_id, round(cosine, 6) AS score FROM vleg"
)


def _files(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@query(_TOP_K_SQL)
def vector_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search over stored tables in equal buckets: the join with the
    documents moves no vector."""
    queries, live = _inputs(spark, sf_dir)
    path = scratch_folder(spark, "corpus")
    prefix = path.rpartition("/")[2].replace("-", "_")
    tables = save_corpus({"vectors": live.vectors, "documents": live.documents}, prefix, _files(spark), path)
    stored = replace(live, **tables)
    hits = _rounded(retrieval.search_vector(queries, stored, top_k=TOP_K, threshold=-1.0))
    drop_corpus(spark, prefix, tables)
    return hits


def _cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Corpus]:
    queries, live = _inputs(spark, sf_dir)
    cells = save_cells(live.vectors, scratch_folder(spark, "cells"), _files(spark))
    return queries, replace(live, cells=cells)


@query(_TOP_K_SQL)
def vector_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search out of the cell index: cells below the k-th best are not read."""
    return _rounded(retrieval.search_vector(*_cells(spark, sf_dir), top_k=TOP_K, threshold=-1.0))


@query()
def vector_cells_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cells each search reads, of all; tested against the bounds by hand."""
    return retrieval.index_use(*_cells(spark, sf_dir), top_k=TOP_K).select("query_id", "cells_read", "cells")


@query(
    with_ctes(NO_FILTER, QUERY_SQL, VECTOR_LEG_SQL.format(depth=20))
    + f" SELECT query_id, rank, chunk_id, round(cosine, 6) AS score FROM vleg WHERE cosine >= {THRESHOLD}"
)
def vector_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(
        retrieval.search_vector(*_inputs(spark, sf_dir), top_k=20, threshold=THRESHOLD)
    )


@query(
    with_ctes(GOOD_ONLY, QUERY_SQL, VECTOR_LEG_SQL.format(depth=TOP_K))
    + " SELECT query_id, rank, chunk_id, round(cosine, 6) AS score FROM vleg WHERE cosine >= 0.1"
)
def vector_document_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(
        retrieval.search_vector(
            *_inputs(spark, sf_dir),
            top_k=TOP_K,
            threshold=0.1,
            doc_ids=doc_filter(spark, sf_dir),
        )
    )


@query(
    with_ctes(NO_FILTER, QUERY_SQL, FTS_LEG_SQL.format(depth=TOP_K))
    + " SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM fleg"
)
def fulltext_any_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(retrieval.search_fts(*_inputs(spark, sf_dir), top_k=TOP_K))


@query(
    with_ctes(GOOD_ONLY, QUERY_SQL, FTS_LEG_SQL.format(depth=TOP_K))
    + " SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM fleg"
)
def fulltext_document_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(
        retrieval.search_fts(
            *_inputs(spark, sf_dir), top_k=TOP_K, doc_ids=doc_filter(spark, sf_dir)
        )
    )


@query(
    with_ctes(NO_FILTER, QUERY_SQL, FTS_LEG_SQL.format(depth=TOP_K))
    + " SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM fleg"
)
def fulltext_stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search out of postings that are stored first, with the status of
    their documents, clustered by lexeme."""
    queries, live = _inputs(spark, sf_dir)
    index = postings(live.chunks).join(live.documents.select("doc_id", "status"), "doc_id")
    path = scratch_folder(spark, "postings")
    save_postings(index, path, int(spark.conf.get("spark.sql.shuffle.partitions")))
    stored = replace(live, index=spark.read.parquet(path))
    return _rounded(retrieval.search_fts(queries, stored, top_k=TOP_K))


def _blocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Corpus]:
    queries, live = _inputs(spark, sf_dir)
    settings = BlockSettings(block_chunks=32)
    return queries, replace(live, blocks=save_blocks(live.chunks, scratch_folder(spark, "blocks"), _files(spark), settings=settings))


@query(
    with_ctes(NO_FILTER, QUERY_SQL, FTS_LEG_SQL.format(depth=TOP_K))
    + " SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM fleg"
)
def fulltext_block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search out of block-maximum postings."""
    return _rounded(retrieval.search_fts(*_blocks(spark, sf_dir), top_k=TOP_K))


@query()
def fulltext_blocks_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many blocks each search opens, of those with a word of it."""
    return retrieval.index_use(*_blocks(spark, sf_dir), top_k=TOP_K).select("query_id", "blocks_read", "blocks")


@query(
    with_ctes(NO_FILTER, QUERY_SQL, FTS_LEG_SQL.format(depth=TOP_K))
    + " SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM fleg WHERE query_id % 2 = 0"
)
def fulltext_wordless_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other query has no word and finds nothing."""
    queries, live = _inputs(spark, sf_dir)
    wordless = F.when(F.col("query_id") % 2 == 0, F.col("query_text")).otherwise("?! ...")
    return _rounded(retrieval.search_fts(queries.withColumn("query_text", wordless), live, top_k=TOP_K))


_ALL_WORDS_SQL = f"all_words AS (SELECT DISTINCT word FROM (SELECT unnest({WORDS}) AS word FROM documents UNION ALL SELECT unnest({WORDS}) FROM benchmark))"
# The simple leg with the lexeme of every word in place of the word.
_STEMMED_LEG_SQL = (
    FTS_LEG_SQL.format(depth=TOP_K)
    .replace("qlex AS (SELECT DISTINCT query_id, lexeme FROM (", "qlex AS (SELECT DISTINCT query_id, s.lexeme FROM (")
    .replace(" AS lexeme FROM q)),", " AS word FROM q) w JOIN stems s ON s.word = w.word),", 1)
    .replace("SELECT chunk_id, lexeme, count(*) AS tf\n  FROM (", "SELECT chunk_id, s.lexeme, count(*) AS tf\n  FROM (")
    .replace(" AS lexeme FROM pool) GROUP BY chunk_id, lexeme),", " AS word FROM pool) w JOIN stems s ON s.word = w.word GROUP BY chunk_id, s.lexeme),")
)


@query(
    with_ctes(NO_FILTER, QUERY_SQL, _ALL_WORDS_SQL, stems_sql("all_words"), _STEMMED_LEG_SQL)
    + " SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM fleg"
)
def fulltext_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default analyzer: every distinct word is stemmed once, texts are counted by
    the words whose lexeme is asked for."""
    return _rounded(
        retrieval.search_fts(*_inputs(spark, sf_dir, analyzer="russian"), top_k=TOP_K)
    )


@query(
    with_ctes(f"doc_words AS (SELECT DISTINCT unnest({WORDS}) AS word FROM documents)", stems_sql("doc_words"))
    + " SELECT word, lexeme FROM stems"
)
def word_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary of all documents with its lexemes."""
    return vocabulary(corpus(spark, sf_dir).chunks)


_HYBRID = (
    QUERY_SQL,
    VECTOR_LEG_SQL.format(depth=2 * TOP_K),
    FTS_LEG_SQL.format(depth=2 * TOP_K),
    LEGS_SQL,
)


@query(
    with_ctes(NO_FILTER, *_HYBRID, HYBRID_SQL.format(k=TOP_K, threshold=THRESHOLD))
    + " SELECT query_id, rank, chunk_id, rrf_score, score FROM scored"
)
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(
        retrieval.search_hybrid(*_inputs(spark, sf_dir), top_k=TOP_K, threshold=THRESHOLD)
    )


@query(
    with_ctes(GOOD_ONLY, *_HYBRID, HYBRID_SQL.format(k=TOP_K, threshold=0.35))
    + " SELECT query_id, rank, chunk_id, rrf_score, score FROM scored"
)
def hybrid_document_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(
        retrieval.search_hybrid(*_inputs(spark, sf_dir), doc_ids=doc_filter(spark, sf_dir))
    )


@query(
    with_ctes(NO_FILTER, *_HYBRID, HYBRID_SQL.format(k=TOP_K, threshold=THRESHOLD))
    + """ SELECT s.query_id, s.rank, s.chunk_id, d.filename, length(c.text) AS text_length
        FROM scored s JOIN chunks c ON c.chunk_id = s.chunk_id JOIN docs d ON d.doc_id = c.doc_id
        WHERE c.brand = 'en'"""
)
def brand_filter_after_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieval.search(
        *_inputs(spark, sf_dir), mode="hybrid", brand="en", top_k=TOP_K, threshold=THRESHOLD
    )
    return hits.select(
        "query_id",
        F.col("rank").cast("long").alias("rank"),
        "chunk_id",
        "filename",
        F.char_length("text").cast("long").alias("text_length"),
    )


def _legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.hybrid_legs(*_inputs(spark, sf_dir), top_k=TOP_K)


_GRID_SQL = f"grid AS (SELECT unnest([{', '.join(str(t) for t in GRID)}])::DOUBLE AS threshold)"
_PURITY_SQL = f"""
per_query AS (
  SELECT q.query_id, g.threshold,
         count(*) FILTER (WHERE e.label = q.family) AS hits
  FROM q CROSS JOIN grid g
  LEFT JOIN picked p ON p.query_id = q.query_id AND p.threshold = g.threshold
  LEFT JOIN embeddings e ON e.vec_id = p.chunk_id
  GROUP BY q.query_id, g.threshold),
purities AS (
  SELECT threshold, round(avg(hits / {TOP_K}::DOUBLE), 6) AS purity,
         round(avg(hits), 6) AS in_family,
         round(avg(CASE WHEN hits = {TOP_K} THEN 1.0 ELSE 0.0 END), 6) AS full_share
  FROM per_query GROUP BY threshold)"""
_HYBRID_PICKED = f"""
picked AS (
  SELECT * FROM (
    SELECT l.query_id, g.threshold, l.chunk_id, row_number() OVER (
      PARTITION BY l.query_id, g.threshold
      ORDER BY l.rrf DESC, coalesce(l.cosine, 0) DESC, l.chunk_id) AS rank
    FROM legs l CROSS JOIN grid g WHERE l.fts_rank IS NOT NULL OR l.cosine >= g.threshold)
  WHERE rank <= {TOP_K})"""
_VECTOR_PICKED = f"""
picked AS (
  SELECT v.query_id, g.threshold, v.chunk_id
  FROM vleg v CROSS JOIN grid g WHERE v.cosine >= g.threshold AND v.rank <= {TOP_K})"""


def _hybrid_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = sweep.hybrid_by_threshold(_legs(spark, sf_dir), TOP_K, GRID)
    return sweep.purity(
        results, query_families(spark, sf_dir), chunk_families(spark, sf_dir), TOP_K, GRID
    )


@query(
    with_ctes(NO_FILTER, *_HYBRID, _GRID_SQL, _HYBRID_PICKED, _PURITY_SQL)
    + " SELECT * FROM purities"
)
def threshold_sweep_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid_purity(spark, sf_dir)


@query(
    with_ctes(
        NO_FILTER,
        QUERY_SQL,
        VECTOR_LEG_SQL.format(depth=2 * TOP_K),
        _GRID_SQL,
        _VECTOR_PICKED,
        _PURITY_SQL,
    )
    + " SELECT * FROM purities"
)
def threshold_sweep_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    legs = _vector_legs(spark, sf_dir)
    return sweep.purity(
        sweep.vector_by_threshold(legs, TOP_K, GRID),
        query_families(spark, sf_dir),
        chunk_families(spark, sf_dir),
        TOP_K,
        GRID,
    )


@query(
    with_ctes(NO_FILTER, *_HYBRID, _GRID_SQL, _HYBRID_PICKED, _PURITY_SQL)
    + """, plateau AS (SELECT * FROM purities
        WHERE in_family >= (SELECT max(in_family) FROM purities) - 0.01)
    SELECT min(threshold) AS plateau_min, max(threshold) AS plateau_max,
           CASE WHEN min(threshold) <= 0.35 AND max(threshold) >= 0.35 THEN 0.35::DOUBLE
                ELSE (SELECT threshold FROM plateau ORDER BY abs(threshold - 0.35), threshold LIMIT 1)
           END AS best FROM plateau"""
)
def threshold_plateau(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.recommend(_hybrid_purity(spark, sf_dir))


def _vector_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieval.search_vector(
        *_inputs(spark, sf_dir), top_k=2 * TOP_K, threshold=-1.0
    )
    return hits.select(
        "query_id", "chunk_id", F.col("rank").alias("vec_rank"), F.col("score").alias("cosine")
    )


_FOREIGN_SQL = """
foreign_rows AS (
  SELECT v.query_id, v.rank, v.cosine FROM vleg v JOIN embeddings e ON e.vec_id = v.chunk_id
  JOIN q ON q.query_id = v.query_id WHERE e.label <> q.family),
first_foreign AS (
  SELECT query_id, min(rank) AS rank, arg_min(cosine, rank) AS cosine FROM foreign_rows GROUP BY query_id)"""
_FOREIGN = with_ctes(
    NO_FILTER, QUERY_SQL, VECTOR_LEG_SQL.format(depth=2 * TOP_K), _FOREIGN_SQL
)


@query(_FOREIGN + " SELECT query_id, rank, round(cosine, 6) AS score FROM first_foreign")
def first_foreign_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = sweep.first_foreign(
        _vector_legs(spark, sf_dir),
        query_families(spark, sf_dir),
        chunk_families(spark, sf_dir),
    )
    return first.select(
        "query_id", F.col("rank").cast("long").alias("rank"), F.round("cosine", 6).alias("score")
    )


@query(
    _FOREIGN
    + """ SELECT (list_sort(list(rank)))[count(*) // 2 + 1] AS rank_median,
        min(rank) AS rank_min, max(rank) AS rank_max,
        round((list_sort(list(cosine)))[count(*) // 2 + 1], 6) AS cosine_median,
        round(min(cosine), 6) AS cosine_min, round(max(cosine), 6) AS cosine_max FROM first_foreign"""
)
def first_foreign_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = sweep.first_foreign(
        _vector_legs(spark, sf_dir),
        query_families(spark, sf_dir),
        chunk_families(spark, sf_dir),
    )
    summary = sweep.foreign_summary(first)
    return summary.select(
        *[F.col(c).cast("long").alias(c) for c in summary.columns if c.startswith("rank")],
        *[F.round(c, 6).alias(c) for c in summary.columns if c.startswith("cosine")],
    )


@query(
    with_ctes(QUERY_SQL)
    + """, flat AS (SELECT label AS family, generate_subscripts(vec, 1) AS position,
          unnest(vec) AS value FROM family_vectors)
    SELECT family, position::BIGINT AS position, round(value, 6)::DOUBLE AS value FROM flat"""
)
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = family_vectors(spark, sf_dir)
    return vectors.select(
        "family", F.posexplode("query_vec").alias("position", "value")
    ).select(
        "family",
        (F.col("position") + 1).cast("long").alias("position"),
        F.round("value", 6).alias("value"),
    )


@query(
    """SELECT d.doc_id, e.vec_id IS NULL AS pending,
        round(list_sum(list_transform(e.embedding, lambda x: round(x::DOUBLE, 6)::FLOAT::DOUBLE)), 6) AS checksum
    FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id"""
)
def embedding_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written to their chunks at stored precision; the rest stay pending."""
    data = corpus(spark, sf_dir)
    vectors = data.vectors.withColumn("embedding", stored_precision(F.col("embedding")))
    chunks = data.chunks.select("doc_id").join(vectors, "doc_id", "left")
    total = F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x.cast("double"))
    return chunks.select(
        "doc_id", F.col("embedding").isNull().alias("pending"), F.round(total, 6).alias("checksum")
    )


@query(
    """SELECT coalesce(e.vec_id, d.doc_id) AS chunk_id,
        round(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE)) * CASE WHEN e.vec_id % 3 = 0 THEN -1 ELSE 1 END, 4) AS checksum
    FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id
    UNION ALL SELECT -1 - vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) FROM embeddings WHERE vec_id % 5 = 0"""
)
def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the stored vectors is replaced, and vectors of new chunks come in."""
    vectors = corpus(spark, sf_dir).vectors.select("chunk_id", "embedding")
    turned = vectors.filter("chunk_id % 3 = 0").withColumn("embedding", F.transform("embedding", lambda x: -x))
    fresh = vectors.filter("chunk_id % 5 = 0").withColumn("chunk_id", -1 - F.col("chunk_id"))
    total = F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x.cast("double"))
    return upsert_vectors(vectors, turned.union(fresh)).select("chunk_id", F.round(total, 4).alias("checksum"))


@query(
    """SELECT vec_id AS chunk_id,
        round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm,
        round(list_sum(list_transform(embedding, lambda x: x::DOUBLE
          / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))), 6) AS unit_sum
    FROM embeddings"""
)
def l2_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    square = F.aggregate(
        "embedding", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")
    )
    unit = F.aggregate(l2_normalize(F.col("embedding")), F.lit(0.0), lambda t, x: t + x)
    return vectors.select(
        F.col("vec_id").alias("chunk_id"),
        F.round(F.sqrt(square), 6).alias("norm"),
        F.round(unit, 6).alias("unit_sum"),
    )
