"""The k best rows of a task for every query of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Scores computed at once in a task: bounds its memory for any batch.
SCORE_CELLS = 4_000_000


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


class LocalBest:
    """Keeps the k best (score, then least id) rows for each of ``count`` queries."""

    def __init__(self, count: int, k: int) -> None:
        self.count, self.k = count, k
        # A candidate must reach its query's bar: the k-th best score seen so far.
        self.bar = np.full(count, -np.inf)
        self.query = np.empty(0, dtype=np.int64)
        self.score = np.empty(0, dtype=np.float64)
        self.row_id = None

    def add(self, scores: np.ndarray, row_ids: pa.Array) -> None:
        """``scores`` is row x query; ``-inf`` is no candidate."""
        if len(scores) >= self.k:
            self.bar = np.maximum(self.bar, np.partition(scores, -self.k, axis=0)[-self.k])
        row, query = np.nonzero((scores >= self.bar) & (scores > -np.inf))
        ids = row_ids.to_numpy(zero_copy_only=False)
        ids = (ids.astype(str) if ids.dtype == object else ids)[row]
        self.row_id = ids if self.row_id is None else np.concatenate([self.row_id, ids])
        self.query = np.concatenate([self.query, query])
        self.score = np.concatenate([self.score, scores[row, query]])
        order = np.lexsort((self.row_id, -self.score, self.query))
        ordered = self.query[order]
        place = np.arange(order.size) - np.searchsorted(ordered, ordered, side="left")
        keep = order[place < self.k]
        self.query, self.score, self.row_id = self.query[keep], self.score[keep], self.row_id[keep]
        worst = np.full(self.count, np.inf)
        np.minimum.at(worst, self.query, self.score)
        self.bar = np.where(np.bincount(self.query, minlength=self.count) >= self.k, worst, self.bar)

    def rows(self, ids: list, id_types: tuple[pa.DataType, pa.DataType], score: str) -> Iterator[pa.RecordBatch]:
        if self.row_id is not None and self.row_id.size:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[i] for i in self.query], type=id_types[0]),
                    pa.array(self.row_id.tolist(), type=id_types[1]),
                    pa.array(self.score, type=pa.float64()),
                ],
                names=["query_id", "chunk_id", score],
            )


def merged(local: DataFrame, k: int, score: str) -> DataFrame:
    """``(query_id, chunk_id, rank, score)`` out of the tasks' lists, whose length
    is at most ``tasks * queries * k`` whatever the size of the scanned table."""
    best_first = Window.partitionBy("query_id").orderBy(F.desc(score), "chunk_id")
    ranked = local.withColumn("rank", F.row_number().over(best_first))
    return ranked.filter(F.col("rank") <= k).select("query_id", "chunk_id", "rank", score)
