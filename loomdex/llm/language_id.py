"""Language ID by mixture inference.

Learning counts the letter trigrams (lower case, everything else a space, hashed to
``BUCKETS`` columns) of each language over all learning rows. A text is a mixture:
expectation-maximisation on its trigram counts estimates the proportions of all
languages; from the likeliest single language on, the language with the largest
remaining proportion joins the set while the likelihood of the set's own mixture
gains more than ``penalty * log(trigrams)``. The prediction is the language with the
largest share of the chosen set, the score is its share.

Cases: a null text, or one without a letter, is ``und`` with score 0, and so is
every text where nothing could be learned. A row without id is not held out.
Repeated rows count and are judged each. An empty table gives an empty result.
Memory is one slice of ``ROWS`` rows and the table of languages x ``BUCKETS``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.llm.common import mixed, pieces

BITS = 13
BUCKETS = 1 << BITS
ROWS = 256


@dataclass(frozen=True)
class LanguageSettings:
    fold: int = 5
    held_out: int = 0
    steps: int = 12
    penalty: float = 4.0
    smoothing: float = 0.5


class Trigrams:
    """Counts of hashed letter trigrams of a slice of texts, as a row x bucket table."""

    def __init__(self) -> None:
        self.letters = np.array([chr(c).isalpha() for c in range(0x10000)])

    def counts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = [x.lower() for x in pc.fill_null(column, "").to_pylist()]
        codes = np.frombuffer(("\0" + "\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
        low = codes < 0x10000
        letter = self.letters[np.where(low, codes, 0)]
        for code in np.unique(codes[~low]):
            letter |= (codes == code) & chr(code).isalpha()
        codes = np.where(letter, codes, 0).astype(np.uint64)
        owner = np.repeat(np.arange(len(texts)), [len(x) + 1 for x in texts])
        at = np.flatnonzero(letter)
        grams = codes[at - 1] * np.uint64(0x1F123BB5) + codes[at] * np.uint64(0x2545F4914F6CDD1D) + codes[at + 1] * np.uint64(0x9E3779B97F4A7C15)
        bucket = (mixed(grams) >> np.uint64(64 - BITS)).astype(np.int64)
        rows = owner[at - 1]
        table = np.bincount(rows * BUCKETS + bucket, minlength=len(texts) * BUCKETS).reshape(len(texts), BUCKETS)
        return table, np.bincount(rows, minlength=len(texts))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", 1 << 20):
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n) of a task's learning rows."""
    grams, sums = Trigrams(), {}
    for batch in slices(batches):
        table, _ = grams.counts(batch.column("text"))
        langs = np.array(batch.column("lang").to_pylist(), object)
        for lang in set(langs):
            sums[lang] = sums.get(lang, 0) + table[langs == lang].sum(0)
    for lang, row in sums.items():
        at = np.flatnonzero(row)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(row[at], pa.int64())], ["lang", "bucket", "n"]
        )


class Mixtures:
    """Inference for the texts of one slice; entries are sorted by text."""

    def __init__(self, table: np.ndarray, probability: np.ndarray, settings: LanguageSettings) -> None:
        row, bucket = np.nonzero(table)
        self.n = table[row, bucket].astype(float)
        self.likelihood = probability[bucket]
        self.starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        self.index = np.repeat(np.arange(len(self.starts)), np.diff(np.r_[self.starts, len(row)]))
        self.total = np.add.reduceat(self.n, self.starts)
        self.settings = settings

    def fit(self, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """EM from ``share``, whose zeros stay; the shares and the log likelihood."""
        for _ in range(self.settings.steps):
            joint = self.likelihood * share[self.index]
            weight = self.n / joint.sum(1)
            share = np.add.reduceat(joint * weight[:, None], self.starts) / self.total[:, None]
        mixture = (self.likelihood * share[self.index]).sum(1)
        return share, np.add.reduceat(self.n * np.log(mixture), self.starts)

    def chosen(self) -> np.ndarray:
        """Shares of every text over its chosen language set."""
        texts, langs = len(self.starts), self.likelihood.shape[1]
        each = np.arange(texts)
        whole, _ = self.fit(np.full((texts, langs), 1 / langs))
        alone = np.add.reduceat(self.n[:, None] * np.log(self.likelihood), self.starts)
        share = np.zeros((texts, langs))
        best = alone.argmax(1)
        share[each, best], gain = 1.0, alone[each, best]
        open_texts = np.ones(texts, bool)
        for size in range(2, langs + 1):
            rest = np.where(share > 0, -1.0, whole)
            wider = (share > 0).astype(float)
            wider[each, rest.argmax(1)] = 1.0
            wider, likelihood = self.fit(wider / size)
            better = open_texts & (likelihood - gain > self.settings.penalty * np.log(self.total + 1))
            share[better], gain[better] = np.maximum(wider[better], 1e-12 * (wider[better] > 0)), likelihood[better]
            open_texts = better
            if not better.any():
                break
        return share


def predictor(langs: list[str], probability: np.ndarray, settings: LanguageSettings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Trigrams()
        for batch in slices(batches):
            table, letters = grams.counts(batch.column("text"))
            names, scores = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
            if langs and letters.any():
                share = Mixtures(table, probability, settings).chosen()
                has = np.flatnonzero(letters)
                names[has] = np.array(langs, object)[share.argmax(1)]
                scores[has] = np.clip(share.max(1), 0, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(np.round(scores, 9))], ["doc_id", "lang_pred", "score"]
            )

    return run


def identify_language(documents: DataFrame, settings: LanguageSettings = LanguageSettings()) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of (doc_id, text, lang)."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % settings.fold == settings.held_out, F.lit(False))
    learning = rows.filter(~held_out & F.col("lang").isNotNull()).select("text", "lang")
    counts = learning.mapInArrow(counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # Languages x BUCKETS numbers at most.
    found = counts.toPandas()
    langs = sorted(found["lang"].unique())
    table = np.full((BUCKETS, len(langs)), settings.smoothing)
    np.add.at(table, (found["bucket"].to_numpy(np.int64), found["lang"].map({x: k for k, x in enumerate(langs)}).to_numpy(np.int64)), found["n"].to_numpy(float))
    probability = table / table.sum(0)
    judged = rows.select("doc_id", "text").mapInArrow(predictor(langs, probability, settings), "doc_id long, lang_pred string, score double")
    return judged.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
