"""OR full-text ranking of whole texts against a batch of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from loomdex.functions.lexemes import is_stop_word, lexeme_of, weight_table, words
from loomdex.operators.local_best import SCORE_CELLS, LocalBest, merged, slices
from loomdex.operators.query_batch import QueryBlock

# Scores are compared at this many decimals, so that equal ones tie exactly.
SCORE_DECIMALS = 12
# Rows of texts that are counted at once in a task.
TEXT_ROWS = 256


def vocabulary(chunks: DataFrame, analyzer: str = "russian") -> DataFrame:
    """``(word, lexeme)`` of every distinct word of the chunks that is no stop word. Words
    are made distinct in each text and task before they are shuffled, and each is
    stemmed once; stored, it serves all searches (``Corpus.vocabulary``).

    No filter asks for the lexeme, which Spark would stem for before words are distinct:
    stop words are known by the word, and the column cannot be NULL. Words are few bytes
    and much work, so they are dealt out to a fixed number of tasks."""
    word = F.col("word")
    found = chunks.select(F.explode(F.array_distinct(words(F.col("text")))).alias("word"))
    found = found.filter(~is_stop_word(word, analyzer)).distinct()
    tasks = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(tasks, "word").select("word", F.coalesce(lexeme_of(word, analyzer), F.lit("")).alias("lexeme"))


def lexemes_of(text: Column, analyzer: str) -> Column:
    """All lexemes of a text, with repetitions."""
    if analyzer == "simple":
        return words(text)
    found = F.transform(words(text), lambda w: lexeme_of(w, analyzer))
    return F.array_compact(found)


def query_lexemes(queries: DataFrame, analyzer: str = "simple") -> DataFrame:
    """``(query_id, lexemes)``: the distinct lexemes of every query; a query
    without lexemes has none and therefore finds nothing."""
    return queries.select("query_id", F.array_distinct(lexemes_of(F.col("query_text"), analyzer)).alias("lexemes"))


class QueryTerms:
    """The lexemes of a batch, and for each the queries that have it with their weights."""

    def __init__(self, ids: list, lexemes: list[list[str]], forms: list[tuple[str, str]] | None = None) -> None:
        """``forms``: the words that stand for a lexeme in texts; without any, a
        lexeme is its own word."""
        self.ids = ids
        number: dict[str, int] = {}
        owner, term = [], []
        for query, found in enumerate(lexemes):
            for lexeme in found or ():
                owner.append(query)
                term.append(number.setdefault(lexeme, len(number)))
        self.lexemes = list(number)
        forms = [(x, x) for x in number] if forms is None else forms
        self.vocabulary = [word for word, _ in forms]
        self.terms = np.array([number[lexeme] for _, lexeme in forms], np.int64)
        order = np.argsort(term, kind="stable")
        self.queries = np.array(owner, np.int64)[order]
        self.starts = np.searchsorted(np.array(term, np.int64)[order], np.arange(len(number) + 1))
        self.sizes = np.array([len(found or ()) for found in lexemes], np.float64)

    def plain(self) -> tuple:
        """Lists and arrays only: a broadcast variable is pickled by reference to its
        classes, and the workers may have no copy of this package."""
        return self.ids, self.vocabulary, self.terms, self.queries, self.starts, self.sizes


def query_terms(block: QueryBlock, analyzer: str, known: DataFrame | None = None) -> QueryTerms:
    """The terms of a batch; ``known`` (word, lexeme) gives the words of its lexemes. On
    the driver: the words of the batch, in all forms that the corpus has."""
    rows = query_lexemes(block.frame, analyzer).toArrow()
    ids, lexemes = rows.column("query_id").to_pylist(), rows.column("lexemes").to_pylist()
    if known is None:
        return QueryTerms(ids, lexemes)
    asked = sorted({x for found in lexemes for x in found or ()})
    wanted = block.frame.sparkSession.createDataFrame([(x,) for x in asked], "lexeme string")
    forms = known.join(F.broadcast(wanted), "lexeme", "left_semi").select("word", "lexeme")
    return QueryTerms(ids, lexemes, [tuple(r) for r in forms.toLocalIterator()])


def fulltext_leg(
    block: QueryBlock, chunks: DataFrame, k: int, analyzer: str = "simple", known: DataFrame | None = None
) -> DataFrame:
    """``(query_id, chunk_id, rank, score)`` for the k best chunks per query.

    All words of a chunk are in its row, so the chunk is scored for every query
    where it is read: counts of the query lexemes in it, times the queries that
    have them. Each task keeps its own k best per query, so neither words nor
    (query, chunk) pairs are shuffled and a common word is no hot key. No word of a
    text is stemmed for it: the ``vocabulary`` (``known``, else that of the chunks)
    names the words whose lexeme is asked for.
    """
    if analyzer != "simple" and known is None:
        known = vocabulary(chunks, analyzer)
    terms = query_terms(block, analyzer, None if analyzer == "simple" else known)
    counted = chunks.select("chunk_id", words(F.col("text")).alias("lexemes"))
    return _ranked(counted, block, terms, k)


def _ranked(counted: DataFrame, block: QueryBlock, terms: QueryTerms, k: int) -> DataFrame:
    id_types = (block.frame.schema["query_id"].dataType, counted.schema["chunk_id"].dataType)
    schema = T.StructType(
        [
            T.StructField("query_id", id_types[0]),
            T.StructField("chunk_id", id_types[1]),
            T.StructField("score", T.DoubleType()),
        ]
    )
    if not terms.vocabulary:
        return merged(counted.sparkSession.createDataFrame([], schema), k, "score")
    shipped = counted.sparkSession.sparkContext.broadcast(terms.plain())
    return merged(counted.mapInArrow(_local_best(shipped, k, id_types), schema), k, "score")


def _local_best(shipped, k: int, id_types):
    arrow_types = tuple(to_arrow_type(t) for t in id_types)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, known_words, term_of, queries, starts, sizes = shipped.value
        weights = np.array(weight_table())
        value_set = pa.array(known_words, pa.string())
        count, term_count = len(ids), len(starts)
        best = LocalBest(count, k)
        for batch in slices(batches, min(TEXT_ROWS, max(1, SCORE_CELLS // count))):
            column = batch.column("lexemes")
            lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            known = pc.index_in(column.flatten(), value_set=value_set)
            found = pc.is_valid(known).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), lengths)[found]
            term = term_of[known.drop_null().to_numpy(zero_copy_only=False)]
            # (row, lexeme) with its count, in lexeme order within a row.
            pair, tf = np.unique(row * term_count + term, return_counts=True)
            row, term = pair // term_count, pair % term_count
            weight = weights[np.minimum(tf, len(weights)) - 1]
            # Every pair meets the queries that have its lexeme.
            spread = starts[term + 1] - starts[term]
            ends = np.cumsum(spread)
            at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - spread, spread) + np.repeat(starts[term], spread)
            query = queries[at]
            cell = np.repeat(row, spread) * count + query
            sums = np.bincount(cell, np.repeat(weight, spread) / sizes[query], batch.num_rows * count)
            scores = np.round(sums.reshape(batch.num_rows, count), SCORE_DECIMALS)
            best.add(np.where(scores > 0, scores, -np.inf), batch.column("chunk_id"))
        yield from best.rows(ids, arrow_types, "score")

    return scan


def postings(chunks: DataFrame, analyzer: str = "simple") -> DataFrame:
    """Inverted table ``(lexeme, chunk_id, doc_id, tf)`` of whole chunk texts, made in
    one narrow pass: a chunk's counts are complete where it is read."""
    keys = ("chunk_id", "doc_id")
    lexemes = lexemes_of(F.col("text"), analyzer)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, TEXT_ROWS):
            for row, found in enumerate(batch.column("lexemes").to_pylist()):
                tally: dict[str, int] = {}
                for lexeme in found or ():
                    tally[lexeme] = tally.get(lexeme, 0) + 1
                if tally:
                    ids = [pa.repeat(batch.column(c)[row], len(tally)) for c in keys]
                    columns = [pa.array(list(tally), pa.string()), *ids, pa.array(list(tally.values()), pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["lexeme", *keys, "tf"])

    fields = [T.StructField("lexeme", T.StringType()), *(chunks.schema[c] for c in keys), T.StructField("tf", T.LongType())]
    return chunks.select(*keys, lexemes.alias("lexemes")).mapInArrow(count, T.StructType(fields))


def stored_leg(block: QueryBlock, index: DataFrame, k: int, analyzer: str = "simple") -> DataFrame:
    """The same ranking out of stored postings. Only rows of the query lexemes are
    read (the filter reaches the scan, whose files are clustered by lexeme); they
    meet per chunk, which is a shuffle of matched postings and not of texts."""
    terms = query_terms(block, analyzer)
    matched = index.filter(F.col("lexeme").isin(terms.lexemes))
    repeated = F.array_repeat("lexeme", F.col("tf").cast("int"))
    counted = matched.groupBy("chunk_id").agg(F.flatten(F.collect_list(repeated)).alias("lexemes"))
    return _ranked(counted, block, terms, k)
