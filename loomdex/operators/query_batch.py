"""A batch of searches, fetched once and shipped to every task."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Searches that are answered in one pass over the corpus. Their vectors (one Arrow
# buffer on the driver, never Python numbers) and lexemes are a broadcast variable (1000
# doubles each: about 500 MB in all), which tasks work through in slices; only a larger
# batch takes another pass.
QUERY_BLOCK = 65_536

COLUMNS = ("query_id", "query_text", "query_vec")


@dataclass(frozen=True)
class QueryBlock:
    """At most ``QUERY_BLOCK`` searches as a local table."""

    frame: DataFrame
    ids: list
    #: Arrow lists of numbers, or None where the batch has no vectors.
    vectors: pa.Array | None

    @property
    def size(self) -> int:
        return len(self.ids)

    def matrix(self) -> tuple[list, np.ndarray]:
        """Ids and vectors of the searches that have a vector."""
        if self.vectors is None:
            return [], np.zeros((0, 0))
        known = self.vectors.is_valid().to_numpy(zero_copy_only=False)
        found = self.vectors.drop_null()
        widths = np.unique(pc.list_value_length(found).to_numpy(zero_copy_only=False))
        if len(widths) > 1:
            raise ValueError(f"query vectors of several widths: {widths.tolist()}")
        flat = found.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        ids = [i for i, k in zip(self.ids, known.tolist(), strict=True) if k]
        return ids, flat.reshape(len(ids), -1) if ids else np.zeros((0, 0))


def query_blocks(queries: DataFrame) -> Iterator[QueryBlock]:
    batch = queries.select(*[c for c in COLUMNS if c in queries.columns])
    first = batch.limit(QUERY_BLOCK + 1).toArrow()
    if first.num_rows <= QUERY_BLOCK:
        yield _block(queries, first)
        return
    parts = -(-batch.count() // (QUERY_BLOCK // 2))
    for part in range(parts):
        member = F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part
        yield _block(queries, batch.filter(member).toArrow())


def _block(queries: DataFrame, table) -> QueryBlock:
    vectors = None
    if "query_vec" in table.column_names:
        vectors = table.column("query_vec").combine_chunks()
    schema = queries.select(*table.column_names).schema
    frame = queries.sparkSession.createDataFrame(table, schema)
    return QueryBlock(frame, table.column("query_id").to_pylist(), vectors)


def per_block(queries: DataFrame, search: Callable[[QueryBlock], DataFrame]) -> DataFrame:
    """Union of one search result per block."""
    return reduce(DataFrame.unionByName, [search(block) for block in query_blocks(queries)])
