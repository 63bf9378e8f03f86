"""Spelling variants by k-d trees over letter counts.

1. Words are counted in the JVM. A word whose place has a hash divisible by 31 has lost
   one letter (``misspelt``), so every vocabulary has variants in it.
2. A word becomes a vector of letter counts (code points beyond a-z share six counts,
   which only makes vectors closer). One edit moves it by an L1 distance of at most two.
3. Per length, the space is cut into cells: a k-d tree, whose splits come from a bounded
   sample, tells in which cell a word lies and which cells are within reach of it; cells
   over ``cell_words`` are cut further by hash, and all visitors go to all cuts. The sample
   only decides how words are dealt out, never what is found.
4. A task has the words of one cell and their visitors: words of the same length
   and words one letter longer. It builds a k-d tree with bounding boxes, searches all
   visitors level by level, drops boxes beyond the distance, and verifies the order of
   the letters of what is left. Each pair of words is found from one side.
5. The form of a word is its near word of largest count, if that is ten times its own.
   Counts grow along forms, so roots are found by doubling: a few joins of the words
   that have a form.

No word has more than about 190 near words for each of its letters, so no group of
pairs is hot. Visitors of a cell are dealt out by ``visit_words`` at a time.

Cases: null text and text without letters have no words. A null id counts as an empty
string in the hash, an id that repeats is hashed alike, its rows count each. Words may be
of any length. An empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.llm.common import staged

# Fixed values of the contract.
LETTERS = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MISSPELT_ONE_IN = 31
RATIO = 10

#: Counts of a-z, then of all other code points by their remainder.
AXES = 32


@dataclass(frozen=True)
class SpellingSettings:
    least_letters: int = 7
    least_count: int = 2
    #: Words of a cell, visitors at once, cells of one length, and sampled words for each cell.
    cell_words: int = 50_000
    visit_words: int = 200_000
    most_cells: int = 1024
    sampled: int = 32


def misspelt(word: Column, doc_id: Column) -> Column:
    """The word without one code point where the hash of its place says so."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word)
    h = F.crc32(key.cast("binary"))
    at = F.pmod(h, F.length(word)).cast("int")
    cut = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))
    return F.when(h % MISSPELT_ONE_IN == 0, cut).otherwise(word)


def vocabulary(documents: DataFrame, settings: SpellingSettings) -> DataFrame:
    """(word, n) of all words that are long and frequent enough."""
    lowered = F.translate("text", UPPER, LOWER)
    runs = documents.select("doc_id", F.explode(F.regexp_extract_all(lowered, F.lit(f"({LETTERS})"))).alias("run"))
    # A shorter run cannot give a word that is long enough.
    runs = runs.filter(F.length("run") >= settings.least_letters)
    words = runs.select(misspelt(F.col("run"), F.col("doc_id")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return words.filter((F.length("word") >= settings.least_letters) & (F.col("n") >= settings.least_count))


def codes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all words, at most 0xFF each, end to end, and their offsets."""
    coded = [w.encode("latin-1") for w in words.to_pylist()]
    offsets = np.cumsum([0, *map(len, coded)])
    return np.frombuffer(b"".join(coded), np.uint8), offsets


AXIS = np.array([c - 97 if 97 <= c <= 122 else 26 + c % (AXES - 26) for c in range(256)])


def letter_counts(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """[word, axis] counts."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    counts = np.bincount(owner * AXES + AXIS[codes], minlength=(len(offsets) - 1) * AXES)
    return counts.reshape(-1, AXES).astype(np.int32)


class KdTree:
    """A k-d tree of integer vectors. Boxes are those of the vectors (``tight``, for
    searching among them) or of the splits (for dealing out any vectors)."""

    def __init__(self, points: np.ndarray, leaf_points: int, tight: bool, most_leaves: int | None = None) -> None:
        self.low, self.high, self.left, self.axis, self.cut = [], [], [], [], []
        self.members: list[np.ndarray | None] = []
        wide = np.iinfo(np.int32).max // 4
        leaves = 1
        waiting = [(self._node(np.full(AXES, -wide), np.full(AXES, wide)), np.arange(len(points)))]
        for node, rows in waiting:
            own = points[rows]
            if tight and len(rows):
                self.low[node], self.high[node] = own.min(0), own.max(0)
            split = None
            if len(rows) > leaf_points and (most_leaves is None or leaves < most_leaves):
                split = self._split(own)
            if split is None:
                self.members[node] = rows
                continue
            axis, cut = split
            leaves += 1
            self.axis[node], self.cut[node], self.left[node] = axis, cut, len(self.low)
            below = own[:, axis] <= cut
            for side in (below, ~below):
                low, high = self.low[node].copy(), self.high[node].copy()
                if side is below:
                    high[axis] = cut
                else:
                    low[axis] = cut + 1
                waiting.append((self._node(low, high), rows[side]))
        self.low, self.high = np.array(self.low, np.int32), np.array(self.high, np.int32)
        self.left, self.axis, self.cut = (np.array(x, np.int64) for x in (self.left, self.axis, self.cut))
        self.number = np.cumsum(self.left < 0) - 1  # of a leaf, in order
        self.leaves = int((self.left < 0).sum())

    def _node(self, low: np.ndarray, high: np.ndarray) -> int:
        for values, value in ((self.low, low), (self.high, high), (self.left, -1), (self.axis, 0), (self.cut, 0), (self.members, None)):
            values.append(value)
        return len(self.low) - 1

    @staticmethod
    def _split(points: np.ndarray) -> tuple[int, int] | None:
        """The axis of greatest variance and its most even cut."""
        axis = int(points.var(0).argmax())
        values, counts = np.unique(points[:, axis], return_counts=True)
        if len(values) < 2:
            return None
        below = np.cumsum(counts)[:-1]
        return axis, int(values[np.abs(2 * below - len(points)).argmin()])

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        """The number of the leaf in whose part of the space each vector is."""
        node = np.zeros(len(points), np.int64)
        while len(at := np.flatnonzero(self.left[node] >= 0)):
            inner = node[at]
            node[at] = self.left[inner] + (points[at, self.axis[inner]] > self.cut[inner])
        return self.number[node]

    def reach(self, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(vector, leaf node) wherever the node's box is within the L1 radius."""
        query, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        found = []
        while len(query):
            at = points[query]
            away = np.maximum(self.low[node] - at, 0).sum(1) + np.maximum(at - self.high[node], 0).sum(1)
            query, node = query[away <= radius], node[away <= radius]
            leaf = self.left[node] < 0
            found.append((query[leaf], node[leaf]))
            query, node = query[~leaf], self.left[node[~leaf]]
            query, node = np.r_[query, query], np.r_[node, node + 1]
        if not found:
            return query, node
        return np.concatenate([q for q, _ in found]), np.concatenate([n for _, n in found])


def one_edit(longer: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Which rows of two code arrays differ by one replaced letter (equal widths), or
    by one letter that only the longer has."""
    width = shorter.shape[1]
    if longer.shape[1] == width:
        return (longer != shorter).sum(1) == 1
    ahead = np.logical_and.accumulate(longer[:, :width] == shorter, axis=1).sum(1)
    behind = np.logical_and.accumulate((longer[:, 1:] == shorter)[:, ::-1], axis=1).sum(1)
    return ahead + behind >= width


NEAR = "word string, near string, near_n long"


def near_words(leaf_words: int = 24, rows_at_once: int = 512) -> Callable[[pa.Table], pa.Table]:
    """Both directions of every near pair of a cell's words and its visitors."""

    def search(tree: KdTree, stored: np.ndarray, asked: np.ndarray, counts: np.ndarray, same: bool, ids: tuple[np.ndarray, np.ndarray]):
        width = stored.shape[1] + asked.shape[1] + 2 * AXES
        step = max(1, min(rows_at_once, (64 << 20) // (16 * width)))
        for start in range(0, len(asked), step):
            query, node = tree.reach(counts[start : start + step], 2 if same else 1)
            sizes = np.array([len(tree.members[n]) for n in node], np.int64)
            for cut in np.split(np.arange(len(node)), np.flatnonzero(np.diff(np.cumsum(sizes) // (1 << 18))) + 1):
                if not len(cut):
                    continue
                member = np.concatenate([tree.members[n] for n in node[cut]])
                visitor = start + np.repeat(query[cut], sizes[cut])
                if same:  # each pair from one side
                    once = ids[1][member] < ids[0][visitor]
                    member, visitor = member[once], visitor[once]
                for part in range(0, len(member), chunk := max(1, (32 << 20) // width)):
                    m, v = member[part : part + chunk], visitor[part : part + chunk]
                    right = one_edit(asked[v], stored[m])
                    yield v[right], m[right]

    def run(rows: pa.Table) -> pa.Table:
        words, role = rows.column("word").combine_chunks(), rows.column("role").to_numpy()
        n, length = rows.column("n").to_numpy(), rows.column("letters").to_numpy()
        codes, offsets = codes_of(words)
        # Equal lengths, so the words of one kind are the rows of a matrix.
        kinds, base = [], length[role == 0][:1]
        number = np.argsort(np.argsort(np.array(words.to_pylist(), object))) if len(base) else np.zeros(0)
        for at in (np.flatnonzero(role == 0), np.flatnonzero((role == 1) & (length == base)), np.flatnonzero((role == 1) & (length != base))) if len(base) else ():
            size = int(length[at[0]]) if len(at) else 0
            matrix = codes[(offsets[at][:, None] + np.arange(size)).ravel()].reshape(len(at), size)
            kinds.append((at, matrix, letter_counts(matrix.ravel(), np.arange(len(at) + 1) * size)))
        left, right = [], []
        if len(base):
            (stored_at, stored, points), *visitors = kinds
            tree = KdTree(points, leaf_words, tight=True)
            for at, matrix, counts in visitors:
                same = matrix.shape[1] == stored.shape[1]
                for v, m in search(tree, stored, matrix, counts, same, (number[at], number[stored_at])) if len(at) else ():
                    left.append(at[v])
                    right.append(stored_at[m])
        a = np.concatenate([*left, *right]) if left else np.zeros(0, np.int64)
        b = np.concatenate([*right, *left]) if left else np.zeros(0, np.int64)
        return pa.table({"word": words.take(pa.array(a)), "near": words.take(pa.array(b)), "near_n": pa.array(n[b], pa.int64())})

    return run


def cells(words: DataFrame, settings: SpellingSettings) -> dict[int, KdTree]:
    """For every length with more words than a cell holds, a tree of its cells."""
    lengths = words.groupBy("letters").agg(F.count(F.lit(1)).alias("words")).filter(F.col("words") > settings.cell_words)
    trees = {}
    for letters, count in sorted(tuple(r) for r in lengths.collect()):
        leaves = min(settings.most_cells, 2 * -(-count // settings.cell_words))
        wanted = leaves * settings.sampled
        sample = words.filter(F.col("letters") == letters).filter(F.pmod(F.xxhash64("word", F.lit(11)), F.lit(count)) < wanted)
        points = letter_counts(*codes_of(sample.limit(2 * wanted).toArrow().column("word").combine_chunks()))
        trees[letters] = KdTree(points, 2, tight=False, most_leaves=leaves)
        trees[letters].members = []  # only the boxes are sent to tasks
    return trees


def dealt(trees: dict[int, KdTree]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(base, cell, role, word, n, letters): a word in its own cell (role 0), and as a
    visitor of the cells in reach that hold words of its length or one letter less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("letters").to_numpy()
            points = letter_counts(*codes_of(batch.column("word")))
            row, base, cell, role = [], [], [], []

            def send(at: np.ndarray, to: int, where: np.ndarray, as_role: int) -> None:
                for values, value in ((row, at), (base, np.full(len(at), to)), (cell, where), (role, np.full(len(at), as_role))):
                    values.append(value)

            for letters in np.unique(length).tolist():
                at = np.flatnonzero(length == letters)
                tree = trees.get(letters)
                send(at, letters, tree.leaf_of(points[at]) if tree else np.zeros(len(at), np.int64), 0)
                for to, radius in ((letters, 2), (letters - 1, 1)):
                    tree = trees.get(to)
                    query, node = tree.reach(points[at], radius) if tree else (np.arange(len(at)), None)
                    send(at[query], to, np.zeros(len(query), np.int64) if node is None else tree.number[node], 1)
            rows = np.concatenate(row) if row else np.zeros(0, np.int64)
            whole = [np.concatenate(x).astype(np.int32) if x else np.zeros(0, np.int32) for x in (base, cell, role)]
            taken = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, whole), *(taken.column(c) for c in ("word", "n", "letters"))], ["base", "cell", "role", "word", "n", "letters"]
            )

    return run


def near_pairs(words: DataFrame, settings: SpellingSettings) -> DataFrame:
    """(word, near, near_n), each pair in both directions, of (word, n)."""
    lettered = words.select("word", "n", F.length("word").alias("letters"))
    schema = "base int, cell int, role int, word string, n long, letters int"
    rows = staged(lettered.mapInArrow(dealt(cells(lettered, settings)), schema), "cells")
    own = F.sum(F.when(F.col("role") == 0, 1).otherwise(0))
    loads = rows.groupBy("base", "cell").agg(own.alias("words"), (F.count(F.lit(1)) - own).alias("visitors")).filter("words > 0")
    cuts = F.ceil(F.col("words") / settings.cell_words).cast("int").alias("cuts")
    shares = F.greatest(F.lit(1), F.ceil(F.col("visitors") / settings.visit_words)).cast("int").alias("shares")
    placed = rows.join(staged(loads.select("base", "cell", cuts, shares), "loads"), ["base", "cell"])
    spread = lambda count: F.sequence(F.lit(0), F.col(count) - 1)
    dealt_one = lambda count: F.array(F.pmod(F.xxhash64("word"), count).cast("int"))
    stored = F.col("role") == 0
    placed = placed.withColumn("cut", F.explode(F.when(stored, dealt_one("cuts")).otherwise(spread("cuts"))))
    placed = placed.withColumn("share", F.explode(F.when(stored, spread("shares")).otherwise(dealt_one("shares"))))
    return placed.groupBy("base", "cell", "cut", "share").applyInArrow(near_words(), NEAR)


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form, by doubling."""
    roots = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if roots.join(further, "root", "left_semi").isEmpty():
            return roots
        roots = staged(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")


def spelling_variants(documents: DataFrame, settings: SpellingSettings = SpellingSettings()) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word."""
    words = staged(vocabulary(documents, settings), "words")
    near = near_pairs(words, settings)
    best = F.min(F.struct((-F.col("near_n")).alias("minus_n"), F.col("near").alias("form"))).alias("best")
    met = staged(near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best), "near")
    joined = words.join(met, "word", "left")
    has_form = -F.col("best.minus_n") >= RATIO * F.col("n")
    formed = staged(
        joined.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(has_form, F.col("best.form")).alias("form"),
            F.when(has_form, -F.col("best.minus_n")).alias("form_n"),
        ),
        "forms",
    )
    roots = roots_of(formed.filter("form IS NOT NULL"))
    return formed.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
