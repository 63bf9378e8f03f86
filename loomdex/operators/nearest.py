"""Exact cosine ranking of a chunk table against a batch of query vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from loomdex.operators.local_best import SCORE_CELLS, LocalBest, merged, slices
from loomdex.operators.query_batch import QueryBlock

# Cosines are compared at this many decimals, so that equal vectors tie exactly
# and the chunk id breaks the tie.
COSINE_DECIMALS = 12


def checked_vectors(vectors: DataFrame, width: int) -> DataFrame:
    """The rows that have a vector; one of another width is an error."""
    message = F.concat(F.lit(f"expected {width} dimensions, not "), F.size("embedding").cast("string"))
    checked = F.when(F.size("embedding") == width, F.col("embedding")).otherwise(F.raise_error(message))
    return vectors.filter("embedding IS NOT NULL").withColumn("embedding", checked)


def vector_leg(block: QueryBlock, vectors: DataFrame, k: int) -> DataFrame:
    """``(query_id, chunk_id, rank, cosine)`` for the k nearest chunks per query.

    Every task multiplies its Arrow batches with the query matrix, one slice of
    queries after the other, and keeps its own k best per query: no (query,
    chunk) pair beyond those leaves a task. A stored vector of another width than
    the queries is an error, as in a vector column of fixed width.
    """
    id_types = (block.frame.schema["query_id"].dataType, vectors.schema["chunk_id"].dataType)
    schema = T.StructType(
        [
            T.StructField("query_id", id_types[0]),
            T.StructField("chunk_id", id_types[1]),
            T.StructField("cosine", T.DoubleType()),
        ]
    )
    ids, matrix = block.matrix()
    if not ids:
        return merged(vectors.sparkSession.createDataFrame([], schema), k, "cosine")
    width = matrix.shape[1]
    stored = checked_vectors(vectors, width).select("chunk_id", "embedding")
    shipped = vectors.sparkSession.sparkContext.broadcast((ids, np.ascontiguousarray(matrix.T)))
    return merged(stored.mapInArrow(_local_top_k(shipped, k, id_types), schema), k, "cosine")


def _local_top_k(shipped, k: int, id_types):
    arrow_types = tuple(to_arrow_type(t) for t in id_types)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, transposed = shipped.value
        width, count = transposed.shape
        best = LocalBest(count, k)
        for batch in slices(batches, max(k, SCORE_CELLS // count)):
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
            scores = flat.astype(np.float64).reshape(batch.num_rows, width) @ transposed
            best.add(np.round(scores, COSINE_DECIMALS), batch.column("chunk_id"))
        yield from best.rows(ids, arrow_types, "cosine")

    return scan
