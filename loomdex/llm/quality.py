"""Quality classifier: regularised quadratic discriminant over document statistics.

Every text is reduced to ``COUNTS`` and these to ``STATISTICS``: logarithms of counts and of
shares, drawn towards the corpus' own shares where a text is short.
The labelled rows outside the held-out fold give each class a mean and a covariance
from one pass of summed moments; the covariance is shrunk towards the pooled one
and that towards its diagonal. A text's score is the logistic of the difference of
the two log densities plus the log prior ratio; densities are Mahalanobis lengths
under Cholesky factors computed once and sent with the tasks.

Cases: null text is the empty text, which has statistics and a score like any
other. A row without id is not held out and has no label. Several labels of one id:
the lowest counts; labels other than 0 and 1 are ignored. Repeated rows are scored
each and learned each. With labels of one class only, every score is that class;
without labels 0.5. An empty table gives an empty result.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.llm.common import pieces, raw_text, staged, with_hash

#: What is counted in every text.
COUNTS = (
    "words", "chars", "letters", "upper", "symbols", "sentence marks", "digits", "non-ASCII", "distinct words",
    "most common word", "marked words", "lines", "repeated lines", "doubled words",
)

#: Shares as (count, whole).
SHARES = (
    ("upper", "letters"), ("symbols", "chars"), ("sentence marks", "chars"), ("digits", "chars"), ("non-ASCII", "chars"),
    ("most common word", "words"), ("marked words", "words"), ("repeated lines", "lines"), ("lines", "words"), ("words", "chars"), ("doubled words", "words"),
)

STATISTICS = ("log words", "distinct words", *(f"{part} of {whole}" for part, whole in SHARES))


@dataclass(frozen=True)
class QualitySettings:
    fold: int = 4
    held_out: int = 2
    to_pooled: float = 0.2
    to_diagonal: float = 0.1
    threshold: float = 0.7
    pseudo_count: float = 20.0


def byte_classes() -> np.ndarray:
    """0 lower, 1 upper, 2 digit, 3 white space, 4 sentence mark, 5 other ASCII, 6 lead byte, 7 continuation."""
    classes = np.full(256, 5, np.uint8)
    for k, group in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\n\r\x0b\x0c", ".,;:?'\"-()")):
        classes[[ord(c) for c in group]] = k
    classes[0x80:0xC0], classes[0xC0:] = 7, 6
    return classes


def counts_of(column: pa.Array, classes: np.ndarray) -> np.ndarray:
    """Text x COUNTS."""
    raw, offsets = raw_text(column)
    rows = len(column)
    owner = np.repeat(np.arange(rows, dtype=np.int64), np.diff(offsets))
    seen = np.bincount(owner * 8 + classes[raw], minlength=rows * 8).reshape(rows, 8).astype(float)
    counted = np.zeros((rows, 7))
    for row, text in enumerate(pc.fill_null(column, "").to_pylist()):
        words, lines = text.lower().split(), text.split("\n")
        tally: dict[str, int] = {}
        for word in words:
            tally[word] = tally.get(word, 0) + 1
        marked = sum(n for word, n in tally.items() if not word[-1].isalnum() and word[-1] not in ".,;:?'\"")
        doubled = sum(map(operator.eq, words, words[1:]))
        counted[row] = len(words), len(tally), max(tally.values(), default=0), marked, len(lines), len(lines) - len(set(lines)), doubled
    words, distinct, most, marked, lines, repeated, doubled = counted.T
    chars = seen[:, :7].sum(1) - seen[:, 3]
    letters = seen[:, 0] + seen[:, 1] + seen[:, 6]
    return np.column_stack([words, chars, letters, seen[:, 1], seen[:, 5], seen[:, 4], seen[:, 2], seen[:, 6], distinct, most, marked, lines, repeated, doubled])


def transformed(counts: np.ndarray, corpus: np.ndarray, pseudo: float) -> np.ndarray:
    """Text x STATISTICS. A share is drawn towards that of the whole corpus by
    ``pseudo`` observations, so a short text is not extreme by chance."""
    at = {name: k for k, name in enumerate(COUNTS)}
    words = counts[:, at["words"]]
    # Distinct words grow as a power of the words, so their logarithm is set against it.
    columns = [np.log(words + pseudo), np.log(counts[:, at["distinct words"]] + pseudo) - 0.8 * np.log(words + pseudo)]
    for part, whole in SHARES:
        usual = (corpus[at[part]] + 1e-3) / (corpus[at[whole]] + 1e-2)
        columns.append(np.log((counts[:, at[part]] + pseudo * usual) / (counts[:, at[whole]] + pseudo)))
    return np.column_stack(columns)


def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    classes = byte_classes()
    for batch in pieces(batches, "text"):
        values = counts_of(batch.column("text"), classes)
        ends = pa.array(np.arange(len(values) + 1, dtype=np.int32) * len(COUNTS))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.ListArray.from_arrays(ends, pa.array(values.ravel()))],
            ["doc_id", "text_hash", "x"],
        )


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(COUNTS))


def moments(corpus: np.ndarray, pseudo: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of (1, x) times its transpose for each class, one row for each element."""
    size = len(STATISTICS) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, size, size))
        for batch in batches:
            x = transformed(matrix(batch.column("x")), corpus, pseudo)
            x = np.column_stack([np.ones(len(x)), x])
            label = batch.column("label").to_numpy(zero_copy_only=False)
            for k in (0, 1):
                sums[k] += x[label == k].T @ x[label == k]
        flat, element = sums.reshape(2, -1), np.arange(size * size)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat([0, 1], size * size), pa.int32()), pa.array(np.tile(element, 2), pa.int32()), pa.array(flat.ravel())],
            ["label", "element", "value"],
        )

    return run


@dataclass(frozen=True)
class Discriminant:
    """For each class the mean, the inverse Cholesky factor and the constant of its log density."""

    means: tuple
    factors: tuple
    constants: tuple

    def score(self, x: np.ndarray) -> np.ndarray:
        density = [c - 0.5 * np.sum(((x - m) @ f.T) ** 2, axis=1) for m, f, c in zip(self.means, self.factors, self.constants, strict=True)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500)))


def fitted(sums: np.ndarray, settings: QualitySettings) -> Discriminant | float:
    """The discriminant, or the only possible score where a class has no rows."""
    counts = sums[:, 0, 0]
    if counts.min() == 0:
        return 0.5 if counts.max() == 0 else float(counts[1] > 0)
    means = sums[:, 0, 1:] / counts[:, None]
    scatter = sums[:, 1:, 1:] - counts[:, None, None] * means[:, :, None] * means[:, None, :]
    pooled = scatter.sum(0) / counts.sum()
    factors, constants = [], []
    for k in (0, 1):
        shrunk = (1 - settings.to_pooled) * scatter[k] / counts[k] + settings.to_pooled * pooled
        diagonal = np.diag(np.diag(shrunk) + 1e-3)
        lower = np.linalg.cholesky((1 - settings.to_diagonal) * shrunk + settings.to_diagonal * diagonal)
        factors.append(np.linalg.inv(lower))
        constants.append(np.log(counts[k]) - np.log(np.diag(lower)).sum())
    return Discriminant(tuple(means), tuple(factors), tuple(constants))


def scorer(model: Discriminant | float, corpus: np.ndarray, pseudo: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"))
            scores = np.full(len(x), model) if isinstance(model, float) else model.score(transformed(x, corpus, pseudo))
            columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(np.round(scores, 9))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "score"])

    return run


def remainder(fold: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % fold, F.lit(-1))


def score_quality(documents: DataFrame, labels: DataFrame, settings: QualitySettings = QualitySettings()) -> DataFrame:
    """doc_id, held_out, score, predicted and text_hash of every row."""
    kind = "doc_id long, text_hash long, x array<double>"
    rows = staged(with_hash(documents).mapInArrow(described, kind), "quality-statistics")
    totals = rows.agg(*(F.sum(F.col("x")[k]) for k in range(len(COUNTS)))).first()
    corpus = np.array([t or 0.0 for t in totals])
    known = labels.filter("quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    learned = rows.filter(remainder(settings.fold) != settings.held_out).join(known, "doc_id").select("label", "x")
    parts = learned.mapInArrow(moments(corpus, settings.pseudo_count), "label int, element int, value double")
    size = len(STATISTICS) + 1
    sums = np.zeros((2, size * size))
    for row in parts.groupBy("label", "element").agg(F.sum("value").alias("value")).collect():
        sums[row["label"], row["element"]] = row["value"]
    model = fitted(sums.reshape(2, size, size), settings)
    scored = rows.mapInArrow(scorer(model, corpus, settings.pseudo_count), "doc_id long, text_hash long, score double")
    return scored.select(
        "doc_id",
        (remainder(settings.fold) == settings.held_out).alias("held_out"),
        "score",
        (F.col("score") >= settings.threshold).cast("int").alias("predicted"),
        "text_hash",
    )
