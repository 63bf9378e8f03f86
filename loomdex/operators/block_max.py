"""Block-maximum postings: blocks of chunks that cannot reach a query's k-th score are
never opened.

Chunks are dealt into blocks by a hash of their id. A stored row holds the occurrences of one
lexeme in one block, and the largest weight among them. The sum of these over a query's
lexemes bounds the score of every chunk of the block. Blocks are ranked by that bound;
the pivot is the first block whose bound is below the k-th best score of the blocks
before it, and everything from there on is skipped. Bounds are joins and aggregates;
the entries of an opened block are scored in one group.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from loomdex.functions.lexemes import weight_table
from loomdex.operators.fulltext import SCORE_DECIMALS, TEXT_ROWS, QueryTerms, lexemes_of, query_lexemes
from loomdex.operators.local_best import SCORE_CELLS, LocalBest, merged, slices
from loomdex.operators.query_batch import QueryBlock
from loomdex.sources.tables import save_bucketed

# Bounds and scores are sums in different order.
SLACK = 1e-9


@dataclass(frozen=True)
class BlockSettings:
    block_chunks: int = 1024


def save_blocks(chunks: DataFrame, path: str, files: int, analyzer: str = "simple", settings: BlockSettings = BlockSettings()) -> DataFrame:
    """Write (lexeme, block, top, entries) in ``files`` buckets of blocks, and open it. The
    row of a block without lexeme lists its chunks. Only texts are shuffled, once: a block
    is made, and later scored, in the task that has it."""
    spark = chunks.sparkSession
    blocks = -(-chunks.count() // settings.block_chunks) or 1
    block = F.pmod(F.xxhash64("chunk_id"), F.lit(blocks)).cast("int").alias("block")
    dealt = chunks.select(block, "chunk_id", "doc_id", "text").repartition(files, "block").sortWithinPartitions("block")
    entry = T.StructType([*(chunks.schema[c] for c in ("chunk_id", "doc_id")), T.StructField("weight", T.DoubleType())])
    fields = [("lexeme", T.StringType()), ("block", T.IntegerType()), ("top", T.DoubleType()), ("entries", T.ArrayType(entry))]
    schema = T.StructType([T.StructField(*f) for f in fields])
    rows = dealt.select("block", "chunk_id", "doc_id", lexemes_of(F.col("text"), analyzer).alias("lexemes")).mapInArrow(_block_rows(to_arrow_schema(schema)), schema)
    name = f"blocks_{uuid.uuid4().hex}"
    index = save_bucketed(rows, name, files, "block", path, sort=False)
    spark.sql(f"DROP TABLE {name}")
    return index


def _block_rows(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    table = np.array(weight_table())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, entries = None, {}

        def made() -> pa.RecordBatch:
            lexemes = list(entries)
            values = [entries[x] for x in lexemes]
            columns = [lexemes, [number] * len(lexemes), [max(w for _, _, w in v) for v in values], [[dict(zip(("chunk_id", "doc_id", "weight"), e, strict=True)) for e in v] for v in values]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in slices(batches, TEXT_ROWS):
            for block, chunk, doc, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != number:
                    if entries:
                        yield made()
                    number, entries = block, {}
                entries.setdefault(None, []).append((chunk, doc, 0.0))
                for lexeme, count in Counter(found or ()).items():
                    entries.setdefault(lexeme, []).append((chunk, doc, float(table[min(count, len(table)) - 1])))
        if entries:
            yield made()

    return run


def block_leg(
    block: QueryBlock, index: DataFrame, live: Callable[[DataFrame], DataFrame], k: int, analyzer: str = "simple"
) -> tuple[DataFrame, DataFrame]:
    """``(query_id, chunk_id, rank, score)`` of the k best live chunks per query, and
    ``(query_id, blocks_read, blocks)``: what was opened of the blocks that have a lexeme
    of the query."""
    asked = query_lexemes(block.frame, analyzer)
    terms = asked.select("query_id", F.size("lexemes").alias("terms"), F.explode("lexemes").alias("lexeme"))
    # The batch is bounded, and so are its lexemes; the filter reaches the scan.
    local = asked.toArrow()
    ids = local.column("query_id").to_pylist()
    by_id = {i: n for n, i in reversed(list(enumerate(ids)))}
    batch = QueryTerms(ids, local.column("lexemes").to_pylist())
    rows = index.filter(F.col("lexeme").isin(batch.lexemes))
    bound = (F.sum("top") / F.first("terms")).alias("bound")
    bounds = rows.select("lexeme", "block", "top").join(F.broadcast(terms), "lexeme").groupBy("query_id", "block").agg(bound)
    by_bound = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    placed = bounds.withColumn("place", F.row_number().over(by_bound))
    members = index.filter("lexeme IS NULL").select("block", F.inline("entries")).select("block", "doc_id")
    alive = live(members).select(F.col("block").alias("opens"), F.lit(None).cast(block.frame.schema["query_id"].dataType).alias("query_id"), "doc_id")
    id_types = (block.frame.schema["query_id"].dataType, index.schema["entries"].dataType.elementType["chunk_id"].dataType)
    schema = T.StructType([T.StructField("query_id", id_types[0]), T.StructField("chunk_id", id_types[1]), T.StructField("score", T.DoubleType())])
    shipped = index.sparkSession.sparkContext.broadcast((*batch.plain(), by_id))
    score = _scored(shipped, k, tuple(to_arrow_type(t) for t in id_types), to_arrow_schema(schema))

    def opened(pairs: DataFrame) -> DataFrame:
        """The k best live chunks of each (query_id, block) pair: a block's rows meet its
        queries and live documents where the block is stored."""
        wanted = pairs.select(F.col("block").alias("opens"), "query_id", F.lit(None).cast(alive.schema["doc_id"].dataType).alias("doc_id"))
        stored = rows.select("block", "lexeme", "entries").groupBy("block")
        return stored.cogroup(wanted.unionByName(alive).groupBy("opens")).applyInArrow(score, schema)

    # A block with a lexeme of the query has a match, so k blocks give k chunks if they live.
    first = merged(opened(placed.filter(F.col("place") <= k)), k, "score")
    reached = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("bar"))
    open_too = F.col("bound") >= F.coalesce("bar", F.lit(0.0)) - SLACK
    read = placed.join(reached, "query_id", "left").withColumn("opened", (F.col("place") <= k) | open_too)
    hits = merged(opened(read.filter("opened")), k, "score")
    visited = read.groupBy("query_id").agg(F.count_if("opened").alias("blocks_read"), F.count(F.lit(1)).alias("blocks"))
    return hits, visited


def _scored(shipped, k: int, id_types: tuple, schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k best chunks of one block for each query that opens it."""

    def run(stored: pa.Table, wanted: pa.Table) -> pa.Table:
        ids, known, _, queries, starts, sizes, by_id = shipped.value
        asked = sorted({by_id[i] for i in wanted.column("query_id").drop_null().to_pylist()})
        entries = stored.column("entries").combine_chunks()
        lengths = pc.list_value_length(entries).to_numpy(zero_copy_only=False)
        flat = entries.flatten()
        chunk, doc, weight = (flat.field(n) for n in ("chunk_id", "doc_id", "weight"))
        alive = wanted.column("doc_id").drop_null().combine_chunks()
        lives = pc.is_in(doc, value_set=alive).to_numpy(zero_copy_only=False)
        if not asked or not lives.any():
            return schema.empty_table()
        term = pc.index_in(stored.column("lexeme").combine_chunks(), value_set=pa.array(known, pa.string())).to_numpy(zero_copy_only=False)
        term = np.repeat(term, lengths)[lives].astype(np.int64)
        weight = weight.to_numpy(zero_copy_only=False)[lives]
        named = chunk.filter(pa.array(lives)).dictionary_encode(null_encoding="encode")
        row, count = named.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(named.dictionary)
        # Every entry meets the queries that have its lexeme.
        spread = starts[term + 1] - starts[term]
        ends = np.cumsum(spread)
        at = np.arange(ends[-1]) - np.repeat(ends - spread, spread) + np.repeat(starts[term], spread)
        same = np.array([by_id[i] for i in ids], np.int64)  # repeated ids are one query
        query, row, weight = same[queries[at]], np.repeat(row, spread), np.repeat(weight, spread)
        parts, step = [], max(1, SCORE_CELLS // count)
        for begin in range(0, len(asked), step):
            part = np.array(asked[begin : begin + step])
            place = np.full(len(ids), -1)
            place[part] = np.arange(len(part))
            mine = place[query] >= 0
            cell = row[mine] * len(part) + place[query[mine]]
            sums = np.bincount(cell, weight[mine], count * len(part)).reshape(count, -1)
            scores = np.round(sums / np.maximum(sizes[part], 1), SCORE_DECIMALS)
            best = LocalBest(len(part), k)
            best.add(np.where(scores > 0, scores, -np.inf), named.dictionary)
            parts += best.rows([ids[q] for q in part], id_types, "score")
        return pa.Table.from_batches([b.cast(schema) for b in parts], schema) if parts else schema.empty_table()

    return run
