"""Embedding whitening by an incremental eigendecomposition.

1. Every partition carries (n, mean, eigenvalues, eigenvectors) of its own scatter
   through its rows. A batch of more rows than dimensions is first reduced to as many rows of
   the same centred scatter (the R of a QR factorisation); each row is then a centred
   rank-one update: the new eigenvalues are the roots of the secular equation, after
   components that the update does not touch and equal eigenvalues are deflated.
2. Spectra are combined ``fan_in`` at a time, by successive rank-one updates with the
   other's scaled eigenvectors and the difference of the means. The sums of the exact
   integers are carried along, so the mean is exact.
3. Rayleigh-Ritz refinement: the scatter of all rows is projected on the combined
   basis in one more distributed pass and diagonalised. The basis is complete, so the
   refined pairs are those of the covariance to double precision, whatever rounding
   the updates had.
4. A last pass measures the covariance of what was whitened against the identity.

Matrices are summed pairwise in a tree of grouped tasks; the driver sees one matrix of
``dimensions ** 2`` numbers.

Cases: vectors that are null, or hold null or non-finite entries, are left out, and so
are those of another width than most (ties: the larger width). A null id is an id,
repeated rows are rows. Components without variance (beyond rounding) cannot be whitened
and are left out: one row, or equal rows only, and an empty table, give an empty result.
Entries beyond 2^46 are an error, and so is a deviation beyond a long. Only the id and vector columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.llm.common import staged

SCALE, SHIFT = 64, 1_000_000
LARGEST = 1 << 46
EPS = np.finfo(np.float64).eps


@dataclass(frozen=True)
class WhiteningSettings:
    components: int = 32
    #: Rows that are reduced together before their updates.
    batch_rows: int = 2048
    #: Spectra or matrices that one task combines.
    fan_in: int = 32


def secular_roots(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(z^2 / (d - x)) for ascending distinct d and nonzero z, as (index
    of the nearest pole, distance to it). One root lies behind each pole."""
    k = len(d)
    ends = np.r_[d[1:], d[-1] + z @ z]
    weight = z * z
    row = np.arange(k)
    # The sign in the middle tells which pole is nearer.
    middle = (ends - d) / 2
    gap = (d[None, :] - d[:, None]) - middle[:, None]
    at_middle = 1 + (weight / gap).sum(1)
    right = (at_middle < 0) & (row < k - 1)
    origin = np.where(right, row + 1, row)
    poles = d[None, :] - d[origin][:, None]
    low = np.where(at_middle < 0, middle, 0.0) - np.where(right, ends - d, 0.0)
    high = np.where(at_middle < 0, ends - d, middle) - np.where(right, ends - d, 0.0)
    behind = row[None, :] <= row[:, None]
    first, second = (d - d[origin]), (ends - d[origin])
    x = (low + high) / 2
    for _ in range(80):
        gap = poles - x[:, None]
        term = weight / gap
        value = 1 + term.sum(1)
        slope = term / gap
        # Poles on either side are stood for by one pole each (the middle way).
        psi, phi = np.where(behind, slope, 0).sum(1), np.where(behind, 0, slope).sum(1)
        low, high = np.where(value < 0, x, low), np.where(value < 0, high, x)
        d1, d2 = first - x, second - x
        c = value - d1 * psi - d2 * phi
        a = c * (d1 + d2) + d1 * d1 * psi + d2 * d2 * phi
        b = d1 * d2 * value
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        new = x + step
        new = np.where((new > low) & (new < high) & np.isfinite(new), new, (low + high) / 2)
        exact = np.abs(value) <= EPS * (1 + np.abs(term).sum(1))
        done = exact | (np.abs(new - x) <= 2 * EPS * np.abs(new))
        x = np.where(exact, x, new)
        if done.all():
            break
    return origin, x


class Spectrum:
    """Count, mean and eigendecomposition (ascending) of a centred scatter."""

    def __init__(self, width: int) -> None:
        self.n, self.mean = 0, np.zeros(width)
        self.values, self.vectors = np.zeros(width), np.eye(width)

    def rank_one(self, u: np.ndarray) -> None:
        """Add u u' to the scatter."""
        size = float(u @ u)
        if size == 0:
            return
        d, z = self.values, self.vectors.T @ u
        scale = max(float(np.abs(d).max()), size)
        tolerance = 8 * EPS * scale
        # Deflation: eigenvalues that are equal within rounding are rotated until one
        # of them holds all of the update; entries that change nothing stay as they are.
        z = z.copy()
        live = np.flatnonzero(np.abs(z) * np.sqrt(size) > tolerance)
        kept: list[int] = []
        for j in live.tolist():
            if kept and d[j] - d[kept[-1]] <= tolerance:
                i = kept.pop()
                length = np.hypot(z[i], z[j])
                c, s = z[j] / length, z[i] / length
                pair = self.vectors[:, [i, j]] @ np.array([[c, s], [-s, c]])
                self.vectors[:, [i, j]] = pair
                z[i], z[j] = 0.0, length
            kept.append(j)
        live = np.array(kept, np.int64)
        if not len(live):
            return
        origin, x = secular_roots(d[live], z[live])
        poles = d[live]
        # Distance of root j to pole i, and the update for which these roots are exact
        # (so that the vectors are orthogonal to rounding).
        away = (poles[origin][None, :] - poles[:, None]) + x[None, :]
        apart = poles[None, :] - poles[:, None]
        np.fill_diagonal(apart, 1.0)
        exact = np.sqrt(np.abs(np.prod(away / apart, axis=1))) * np.sign(z[live])
        turned = exact[:, None] / -away
        turned /= np.sqrt((turned * turned).sum(0))
        self.vectors[:, live] = self.vectors[:, live] @ turned
        self.values = d.copy()
        self.values[live] = poles[origin] + x
        order = np.argsort(self.values, kind="stable")
        self.values, self.vectors = self.values[order], self.vectors[:, order]

    def add(self, n: int, mean: np.ndarray, rows: np.ndarray) -> None:
        """Another set of n rows by its mean and rows of the same centred scatter."""
        if self.n:
            apart = mean - self.mean
            self.rank_one(np.sqrt(self.n / (self.n + n) * n) * apart)
            self.mean = self.mean + apart * (n / (self.n + n))
        else:
            self.mean = mean
        self.n += n
        for row in rows:
            self.rank_one(row)

    def add_rows(self, rows: np.ndarray) -> None:
        if len(rows) <= rows.shape[1]:
            for row in rows:
                self.add(1, row, rows[:0])
        else:
            mean = rows.mean(0)
            self.add(len(rows), mean, np.linalg.qr(rows - mean, mode="r"))

    def add_spectrum(self, other: Spectrum) -> None:
        self.add(other.n, other.mean, np.sqrt(np.maximum(other.values, 0))[:, None] * other.vectors.T)


SPECTRUM = "part long, n long, sums array<decimal(38,0)>, mean array<double>, numbers array<double>, vectors array<double>"


def integers(column: pa.Array, width: int) -> np.ndarray:
    """x of every vector: floor(64 * entry) + 1000000."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) and np.abs(flat).max() > LARGEST:
        raise ValueError("an entry is beyond 2^46")
    return (np.floor(SCALE * flat).astype(np.int64) + SHIFT).reshape(-1, width)


def slices_of(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def spectrum_row(part: int, spectrum: Spectrum, sums: list[int]) -> pa.RecordBatch:
    columns = [[part], [spectrum.n], [sums], [spectrum.mean], [spectrum.values], [spectrum.vectors.ravel()]]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.decimal128(38, 0)), *[pa.list_(pa.float64())] * 3]
    names = ["part", "n", "sums", "mean", "numbers", "vectors"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def local_spectra(width: int, settings: WhiteningSettings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        spectrum, sums = Spectrum(width), [0] * width
        for batch in slices_of(batches, settings.batch_rows):
            x = integers(batch.column("embedding"), width)
            sums = [s + int(t) for s, t in zip(sums, x.sum(0), strict=True)]
            spectrum.add_rows((x - SHIFT).astype(np.float64))
        if spectrum.n:
            yield spectrum_row(TaskContext.get().partitionId(), spectrum, sums)

    return run


def combined_spectra(width: int, fan_in: int) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("part")
        spectrum, sums = Spectrum(width), [0] * width
        for row in rows.to_pylist():
            other = Spectrum(width)
            other.n, other.mean, other.values = row["n"], np.array(row["mean"]), np.array(row["numbers"])
            other.vectors = np.array(row["vectors"]).reshape(width, width)
            spectrum.add_spectrum(other)
            sums = [s + int(t) for s, t in zip(sums, row["sums"], strict=True)]
        part = rows.column("part")[0].as_py() // fan_in
        return pa.Table.from_batches([spectrum_row(part, spectrum, sums)])

    return run


MATRIX = "part long, numbers array<double>"


def matrix_row(part: int, matrix: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([matrix.ravel()], pa.list_(pa.float64()))], ["part", "numbers"])


def summed_matrices(fan_in: int) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("part")
        total = np.sum([np.array(x) for x in rows.column("numbers").to_pylist()], axis=0)
        return pa.Table.from_batches([matrix_row(rows.column("part")[0].as_py() // fan_in, total)])

    return run


def folded(parts: DataFrame, fold: Callable[[pa.Table], pa.Table], fan_in: int, label: str):
    """One row out of a row for each partition, ``fan_in`` at a time, in the order of
    the partitions; None where there is no row."""
    parts = staged(parts, label)
    while (last := parts.agg({"part": "max"}).first()[0]) is not None:
        if last == 0:
            return parts.first()
        grouped = parts.groupBy(F.floor(F.col("part") / fan_in).alias("group"))
        parts = staged(grouped.applyInArrow(fold, parts.schema), label)
    return None


@dataclass(frozen=True)
class Centre:
    """The exact mean, as sums and count."""

    n: int
    sums: list[int]

    def numerators(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x - sums // n, and the remainders that are still to be taken off, over n."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        return x - whole, np.array([s % self.n for s in self.sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        near, rest = self.numerators(x)
        return near - rest / self.n

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """The exact sum over dimensions of (n * x - sums) ** 2."""
        near, rest = self.numerators(x)
        largest = self.n * (int(np.abs(near).max(initial=0)) + 1)
        kind = np.int64 if largest * largest * max(1, x.shape[1]) < 1 << 62 else object
        off = near.astype(kind) * self.n - rest.astype(kind)
        return (off * off).sum(1)


def projected(width: int, centre: Centre, basis, settings: WhiteningSettings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A partition's scatter in a basis."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((basis.shape[1],) * 2)
        for batch in slices_of(batches, settings.batch_rows):
            y = centre.centred(integers(batch.column("embedding"), width)) @ basis
            total += y.T @ y
        yield matrix_row(TaskContext.get().partitionId(), total)

    return run


@dataclass(frozen=True)
class Whitening:
    """What the fit gives: ``basis`` turns a centred vector into its whitened components."""

    width: int
    centre: Centre
    basis: np.ndarray
    explained: np.ndarray
    identity_error: float


def fit_list(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, embedding) of the rows that take part, and their width."""
    broken = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    rows = embeddings.select("vec_id", "embedding").filter(F.col("embedding").isNotNull() & ~broken)
    widths = rows.groupBy(F.size("embedding").alias("width")).count()
    most = widths.agg(F.max(F.struct("count", "width")).alias("most")).first()["most"]
    width = most["width"] if most else 0
    return rows.filter(F.size("embedding") == width), width


def fit_whitening(rows: DataFrame, width: int, settings: WhiteningSettings = WhiteningSettings()) -> Whitening | None:
    """The components of the rows' covariance, or None where none has variance."""
    if not width:
        return None
    local = rows.mapInArrow(local_spectra(width, settings), SPECTRUM)
    whole = folded(local, combined_spectra(width, settings.fan_in), settings.fan_in, "spectra")
    centre = Centre(whole["n"], [int(s) for s in whole["sums"]])

    def scatter(basis: np.ndarray, label: str) -> np.ndarray:
        parts = rows.mapInArrow(projected(width, centre, basis, settings), MATRIX)
        total = folded(parts, summed_matrices(settings.fan_in), settings.fan_in, label)
        return np.array(total["numbers"]).reshape(basis.shape[1], -1) / centre.n

    basis = np.array(whole["vectors"]).reshape(width, width)
    # Orthogonal to rounding before the projection, so that nothing is scaled.
    basis = np.linalg.qr(basis)[0]
    values, turned = np.linalg.eigh(scatter(basis, "projected"))
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], basis @ turned[:, order]
    kept = int((values > max(values[0], 0) * width * EPS).sum())
    kept = min(settings.components, kept)
    if not kept:
        return None
    whitener = vectors[:, :kept] / np.sqrt(values[:kept])
    error = np.abs(scatter(whitener, "whitened") - np.eye(kept)).max()
    return Whitening(width, centre, whitener, values[:kept] / values.sum(), float(error))


def whitened_rows(fit: Whitening) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kept = fit.basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_of(batches, 4096):
            x = integers(batch.column("embedding"), fit.width)
            white = fit.centre.centred(x) @ fit.basis
            count = len(x)
            row = pa.array(np.repeat(np.arange(count), kept))
            deviation = pa.array(fit.centre.deviations(x).tolist(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(row), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), count)), pa.array(np.full(count * kept, fit.centre.n)),
                 deviation.take(row), pa.array(white.ravel()), pa.array(np.tile(fit.explained, count)), pa.array(np.full(count * kept, fit.identity_error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def whiten(embeddings: DataFrame, settings: WhiteningSettings = WhiteningSettings()) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for
    every vector of the fit list and component."""
    rows, width = fit_list(embeddings)
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit = fit_whitening(rows, width, settings)
    if fit is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    return rows.mapInArrow(whitened_rows(fit), schema)
