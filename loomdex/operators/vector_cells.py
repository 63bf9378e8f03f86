"""An exact cell index of vectors: cells are visited by bound, the rest is never read.

Every vector belongs to the cell of its nearest centroid; a cell's radius is the
greatest distance of its vectors to the centroid. For a query q, no vector of a cell
has a larger product with it than ``q . centroid + |q| * radius`` (the triangle
inequality), so a cell below a query's k-th best score cannot change its result. The
centroids come from a bounded sample; they decide what is skipped, never what is found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from loomdex.operators.local_best import SCORE_CELLS, LocalBest, merged, slices
from loomdex.operators.nearest import COSINE_DECIMALS, checked_vectors
from loomdex.operators.query_batch import QueryBlock

# Rounding of products and of stored scores stays far below this.
SLACK = 1e-9


@dataclass(frozen=True)
class CellSettings:
    cells: int = 256
    #: Vectors that the centroids are fitted on, and rounds of fitting.
    sample: int = 16_384
    rounds: int = 6


@dataclass(frozen=True)
class VectorCells:
    """``vectors``: cell, chunk_id, doc_id, embedding [, status], clustered by cell;
    ``cells``: cell, centroid, radius (one row each)."""

    vectors: DataFrame
    cells: DataFrame


def fit_centroids(vectors: DataFrame, settings: CellSettings) -> np.ndarray:
    """Lloyd's rounds on a sample chosen by a hash of the ids."""
    known = vectors.filter("embedding IS NOT NULL").select("chunk_id", "embedding")
    share = F.pmod(F.xxhash64("chunk_id", F.lit(5)), F.lit(max(1, known.count())))
    sample = known.filter(share < settings.sample).limit(2 * settings.sample).toArrow()
    if not sample.num_rows:
        return np.zeros((0, 0))
    sample = sample.take(pa.array(np.argsort(sample.column("chunk_id").to_pylist(), kind="stable")))
    width = len(sample.column("embedding")[0])
    points = sample.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    start = np.linspace(0, len(points) - 1, min(settings.cells, len(points))).astype(int)
    centroids = points[start].copy()
    for _ in range(settings.rounds):
        owner, _ = nearest_centroid(points, centroids)
        counts = np.bincount(owner, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, owner, points)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    return centroids


def nearest_centroid(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each vector, and its distance to the centroid."""
    owner = ((centroids * centroids).sum(1) / 2 - points @ centroids.T).argmin(1)
    return owner, np.sqrt(((points - centroids[owner]) ** 2).sum(1))


def assign_cells(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The rows with ``cell`` and ``distance``; rows without a vector are left out."""
    rows = checked_vectors(vectors, centroids.shape[1])
    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("distance", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, max(1, SCORE_CELLS // len(centroids))):
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            owner, distance = nearest_centroid(flat.reshape(batch.num_rows, -1), centroids)
            columns = [*batch.columns, pa.array(owner, pa.int32()), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "cell", "distance"])

    return rows.mapInArrow(run, schema)


def save_cells(vectors: DataFrame, path: str, files: int, settings: CellSettings = CellSettings()) -> VectorCells:
    """Write the index of (chunk_id, doc_id, embedding [, status]) and open it. Large
    cells span several files; a scan of some cells reads their row groups only."""
    spark = vectors.sparkSession
    centroids = fit_centroids(vectors, settings)
    placed = assign_cells(vectors, centroids) if len(centroids) else vectors.limit(0).withColumns({"cell": F.lit(0), "distance": F.lit(0.0)})
    clustered = placed.repartitionByRange(files, "cell", "chunk_id").sortWithinPartitions("cell", "chunk_id")
    clustered.write.parquet(f"{path}/vectors")
    stored = spark.read.parquet(f"{path}/vectors")
    radii = stored.groupBy("cell").agg(F.max("distance").alias("radius"))
    table = spark.createDataFrame([(c, x.tolist()) for c, x in enumerate(centroids)], "cell int, centroid array<double>")
    table.join(radii, "cell").write.parquet(f"{path}/cells")
    return open_cells(spark, path)


def open_cells(spark, path: str) -> VectorCells:
    return VectorCells(spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/cells"))


def cell_leg(
    block: QueryBlock, index: VectorCells, live: Callable[[DataFrame], DataFrame], k: int
) -> tuple[DataFrame, DataFrame]:
    """``(query_id, chunk_id, rank, cosine)`` of the k nearest live chunks per query, and
    ``(query_id, cells_read, cells)``.

    First the best cells of each query that hold k live vectors are read; then, once,
    all cells whose bound reaches the k-th best of those. ``live`` keeps the rows that
    may be found. On the driver: a row for each cell, and k for each query.
    """
    spark = index.vectors.sparkSession
    ids, matrix = block.matrix()
    query_type, chunk_type = block.frame.schema["query_id"].dataType, index.vectors.schema["chunk_id"].dataType
    found = T.StructType([T.StructField("query_id", query_type), T.StructField("chunk_id", chunk_type), T.StructField("cosine", T.DoubleType())])
    visited = T.StructType([found["query_id"], T.StructField("cells_read", T.LongType()), T.StructField("cells", T.LongType())])
    rows = index.cells.join(live(index.vectors.select("cell", "doc_id", *status_of(index.vectors))).groupBy("cell").count(), "cell").toArrow()
    if not ids or not rows.num_rows:
        return merged(spark.createDataFrame([], found), k, "cosine"), spark.createDataFrame([(i, 0, 0) for i in ids], visited)
    cells, counts = rows.column("cell").to_numpy(), rows.column("count").to_numpy()
    centroids = np.array(rows.column("centroid").to_pylist())
    bounds = matrix @ centroids.T + np.sqrt((matrix * matrix).sum(1))[:, None] * rows.column("radius").to_numpy() + SLACK
    order = np.argsort(-bounds, axis=1, kind="stable")
    before = np.cumsum(counts[order], axis=1) - counts[order]
    first = np.zeros(bounds.shape, bool)
    np.put_along_axis(first, order, before < k, axis=1)

    def scan(wanted: np.ndarray) -> DataFrame:
        at = np.flatnonzero(wanted.any(0))
        some = live(index.vectors.filter(F.col("cell").isin(cells[at].tolist())))
        shipped = spark.sparkContext.broadcast((ids, matrix, cells[at], wanted[:, at]))
        some = checked_vectors(some, matrix.shape[1]).select("chunk_id", "embedding", "cell")
        return some.mapInArrow(_scores_of_cells(shipped, k, (query_type, chunk_type)), found)

    best = merged(scan(first), k, "cosine").select("query_id", "chunk_id", "cosine").toArrow()
    bars = dict.fromkeys(ids, -np.inf)
    last = best.group_by("query_id").aggregate([("cosine", "min"), ("cosine", "count")]).to_pylist()
    bars |= {r["query_id"]: r["cosine_min"] for r in last if r["cosine_count"] >= k}
    more = (bounds >= np.array([bars[i] for i in ids])[:, None]) & ~first
    known = spark.createDataFrame(best, found)
    hits = known.union(scan(more)) if more.any() else known
    read = (first | more).sum(1).tolist()
    return merged(hits, k, "cosine"), spark.createDataFrame([(i, n, len(cells)) for i, n in zip(ids, read, strict=True)], visited)


def status_of(table: DataFrame) -> list[str]:
    return ["status"] if "status" in table.columns else []


def _scores_of_cells(shipped, k: int, id_types):
    arrow_types = tuple(to_arrow_type(t) for t in id_types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix, cells, wanted = shipped.value
        column_of = {cell: c for c, cell in enumerate(cells.tolist())}
        best = LocalBest(len(ids), k)
        for batch in slices(batches, max(k, SCORE_CELLS // len(ids))):
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            points, cell = flat.reshape(batch.num_rows, -1), batch.column("cell").to_numpy()
            scores = np.full((batch.num_rows, len(ids)), -np.inf)
            for one in np.unique(cell).tolist():
                rows, queries = np.flatnonzero(cell == one), np.flatnonzero(wanted[:, column_of[one]])
                scores[np.ix_(rows, queries)] = np.round(points[rows] @ matrix[queries].T, COSINE_DECIMALS)
            best.add(scores, batch.column("chunk_id"))
        yield from best.rows(ids, arrow_types, "cosine")

    return run
