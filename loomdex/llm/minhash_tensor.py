"""MinHash near-duplicate detection with tensored banding.

1. Every distinct set of word shingles gets two small collections of half keys, each
   made of ``half_size`` minhashes. Table (i, j) is keyed by half key i of the first and
   j of the second collection: ``collection ** 2`` tables of ``2 * half_size`` minhashes out of
   ``2 * collection * half_size`` minhashes, instead of that number squared. Sets of
   similarity s meet in some table with probability ``(1 - (1 - s^half_size)^collection)^2``
   (``recall``: 0.9998 at 0.85 with the defaults, more above it).
2. A pair needs a half key of both collections in common, so half keys that only one set
   has are dropped before table keys are formed from the pairs that are left.
3. Candidates are verified on their full sets, in two steps. First each set follows the
   least set that shares most of its tables; a tree of followers is a group (cut by
   ``group_bytes``; a few of its sets go to every part) and is searched for links in one task. Then the tables whose sets are not yet
   one component are looked at again: a set visits the other groups in such a table,
   later groups the earlier ones, each pair of groups once. Sets that are already
   connected are not compared. Every pair that shares a table is thus connected or
   compared, and only links confirmed by 100 * intersection >= 85 * union connect.

Equal texts, and texts with equal sets, are one set throughout. The hot keys are those of
large groups of near copies: half keys and tables are only ever reduced to their least
and greatest set, groups are cut by bytes, and visitors of a group are dealt out by
``visit_bytes``. No pairs are listed.

Cases: null text and texts without words have the empty set and are linked with nothing
(they are kept). Rows that repeat an id share its component. A null id is never a
component's name unless all its rows lack one. An empty table gives an empty result.
Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.llm.common import maybe_broadcast, mixed, pieces, raw_text, staged
from loomdex.llm.components import connected_components
from loomdex.llm.shingles import Shingler, set_id
from loomdex.llm.text_blocks import KEY, named


@dataclass(frozen=True)
class TensorSettings:
    width: int = 5
    threshold: Fraction = Fraction(85, 100)
    #: Half keys in each of the two collections, and minhashes in a half key.
    collection: int = 10
    half_size: int = 3
    seed: int = 20
    #: Bytes of shingle hashes (with 256 a set) in a group, and of the sets that visit it at once.
    group_bytes: int = 2 << 20
    visit_bytes: int = 8 << 20
    #: Sets of a group of several parts that are searched for in each of them.
    pivots: int = 8

    def recall(self, similarity: float) -> float:
        return (1 - (1 - similarity**self.half_size) ** self.collection) ** 2


class MinHasher:
    """Half keys of sets of 64-bit shingle hashes."""

    def __init__(self, settings: TensorSettings) -> None:
        self.shape = (2, settings.collection, settings.half_size)
        count = int(np.prod(self.shape))
        seeds = mixed(np.arange(1, 2 * count + 1, dtype=np.uint64) + np.uint64(settings.seed << 32))
        self.factors, self.terms = seeds[:count] | np.uint64(1), seeds[count:]

    def half_keys(self, tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """[set, collection, half key] of nonempty sets laid end to end."""
        least = np.empty((len(self.factors), len(starts)), np.uint64)
        for k, (factor, term) in enumerate(zip(self.factors, self.terms, strict=True)):
            least[k] = np.minimum.reduceat(tokens * factor + term, starts)
        parts = mixed(least).reshape(*self.shape, len(starts))
        keys = np.zeros((*self.shape[:2], len(starts)), np.uint64)
        for part in range(self.shape[2]):
            keys = mixed(keys * self.factors[0] + parts[:, :, part])
        # The same values in another place of a collection are other keys.
        place = np.arange(2 * self.shape[1], dtype=np.uint64).reshape(2, self.shape[1], 1)
        return np.moveaxis(mixed(keys ^ mixed(place + np.uint64(1))), 2, 0).view(np.int64)


SIGNED = "doc_id long, text_hash long, h1 long, h2 long, n_bytes long, size long, set_id long, halves array<array<long>>"


def signatures(settings: TensorSettings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The size, number and half keys of every row's set; null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, hasher = Shingler(settings.width), MinHasher(settings)
        kind = pa.list_(pa.list_(pa.int64()))
        for batch in pieces(batches, "text"):
            sets = list(shingler.of(*raw_text(batch.column("text"))))
            sizes = np.array([len(x) for x in sets], np.int64)
            full = np.flatnonzero(sizes)
            halves: list = [None] * len(sets)
            if len(full):
                starts = np.r_[0, np.cumsum(sizes[full])[:-1]]
                keys = hasher.half_keys(np.concatenate([sets[k] for k in full]), starts)
                for k, key in zip(full.tolist(), keys, strict=True):
                    halves[k] = list(key)
            names = pa.array([set_id(x) if len(x) else None for x in sets], pa.int64())
            columns = [batch.column(c) for c in ("doc_id", "text_hash", *KEY)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sizes), names, pa.array(halves, kind)], ["doc_id", "text_hash", *KEY, "size", "set_id", "halves"]
            )

    return run


def shingle_sets(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(set_id, tokens) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in pieces(batches, "text"):
            tokens = [x.tobytes() for x in shingler.of(*raw_text(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([batch.column("set_id"), pa.array(tokens, pa.binary())], ["set_id", "tokens"])

    return run


def table_keys(sets: DataFrame) -> DataFrame:
    """(set_id, table_key) of the sets that share half keys of both collections.

    A half key is looked at through its least and greatest set only, so one that a
    third of all sets have is no large group."""
    sides = [sets.select("set_id", F.lit(side).alias("side"), F.explode(F.col("halves")[side]).alias("half")) for side in (0, 1)]
    halves = staged(sides[0].union(sides[1]), "half-keys")
    shared = halves.groupBy("half").agg(F.min("set_id").alias("least"), F.max("set_id").alias("most")).filter("least < most").select("half")
    left = halves.join(shared, "half").groupBy("set_id")
    pairs = left.agg(*[F.collect_list(F.when(F.col("side") == side, F.col("half"))).alias(f"side{side}") for side in (0, 1)])
    # At most ``collection`` half keys of each side in a row.
    first = pairs.select("set_id", "side1", F.explode("side0").alias("one"))
    return first.select("set_id", "one", F.explode("side1").alias("other")).select("set_id", F.xxhash64("one", "other").alias("table_key"))


class Links:
    """Finds which of some sets are connected by links, given who is so already."""

    def __init__(self, threshold: Fraction, tokens: list[np.ndarray], roots: np.ndarray) -> None:
        self.up, self.down = threshold.numerator, threshold.denominator
        self.tokens, self.sizes = tokens, np.array([len(x) for x in tokens], np.int64)
        self.roots = np.unique(roots, return_inverse=True)[1]
        self.edges: list[tuple[int, int]] = []

    def index(self, members: np.ndarray) -> None:
        """Who has each token, for the sets that are searched."""
        self.members = members
        whole = np.concatenate([self.tokens[k] for k in members])
        order = np.argsort(whole, kind="stable")
        self.holders = np.repeat(np.arange(len(members)), self.sizes[members])[order]
        self.union, starts = np.unique(whole[order], return_index=True)
        self.starts = np.r_[starts, len(whole)]

    def overlaps(self, q: int, wanted: np.ndarray) -> np.ndarray:
        """Shared tokens of set q with the wanted members (positions)."""
        if len(wanted) <= 4:
            own = self.tokens[q]
            return np.array([len(np.intersect1d(own, self.tokens[k], assume_unique=True)) for k in self.members[wanted]])
        at = np.searchsorted(self.union, self.tokens[q])
        at[at == len(self.union)] = 0
        at = at[self.union[at] == self.tokens[q]]
        counts = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(counts)
        places = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts) + np.repeat(self.starts[at], counts)
        return np.bincount(self.holders[places], minlength=len(self.members))[wanted]

    def search(self, queries: np.ndarray) -> None:
        """Connect each query with the members that it links to, unless already connected."""
        near = self.sizes[self.members]
        for q in queries.tolist():
            size, apart = self.sizes[q], self.roots[self.members] != self.roots[q]
            # A link needs sizes within the threshold of each other.
            fits = (self.down * np.minimum(near, size) >= self.up * np.maximum(near, size)) & apart
            wanted = np.flatnonzero(fits)
            if not len(wanted):
                continue
            shared = self.overlaps(q, wanted)
            linked = self.members[wanted[self.down * shared >= self.up * (size + near[wanted] - shared)]]
            if len(linked):
                merged, first = np.unique(self.roots[linked], return_index=True)
                self.edges += [(q, int(k)) for k in linked[first]]
                self.roots[np.isin(self.roots, merged)] = self.roots[q]


def found_links(threshold: Fraction) -> Callable[[pa.Table], pa.Table]:
    """Edges of a spanning forest for one group: its sets (role 0: searched only, 1:
    also queries) and its visitors (role 2)."""

    def run(rows: pa.Table) -> pa.Table:
        role = rows.column("role").to_numpy()
        names = rows.column("set_id").to_numpy()
        tokens = [np.frombuffer(x, np.uint64) for x in rows.column("tokens").to_pylist()]
        links = Links(threshold, tokens, rows.column("component").to_numpy())
        members, queries = np.flatnonzero(role < 2), np.flatnonzero(role > 0)
        if len(members) and len(queries):
            links.index(members)
            links.search(queries)
        pairs = np.array(links.edges, np.int64).reshape(-1, 2)
        return pa.table({"u": pa.array(names[pairs[:, 0]]), "v": pa.array(names[pairs[:, 1]])})

    return run


GROUP = ["centre", "part"]


def grouped_sets(keys: DataFrame, sizes: DataFrame, settings: TensorSettings) -> DataFrame:
    """(set_id, centre, part, parts, bytes): each set follows the least set that shares
    most of its tables; a tree of followers is a group, named by its least set, in parts
    of about ``group_bytes``, in which followers of one set stay together if they fit."""
    centres = keys.groupBy("table_key").agg(F.min("set_id").alias("followed"), F.max("set_id").alias("most"))
    near = keys.join(centres.filter("followed < most").drop("most"), "table_key").groupBy("set_id", "followed").agg(F.count(F.lit(1)).alias("tables"))
    best = near.groupBy("set_id").agg(F.max_by("followed", F.struct(F.col("tables"), F.bitwise_not("followed"))).alias("followed"))
    best = staged(best, "followed")
    trees = connected_components(best).select(F.col("node").alias("set_id"), F.col("component").alias("centre"))
    placed = staged(best.join(trees, "set_id").join(sizes, "set_id").withColumn("bytes", F.col("size") * 8 + 256), "trees")
    filled = F.ceil(F.sum("bytes") / settings.group_bytes).cast("int")
    parts = placed.groupBy("centre").agg(filled.alias("parts"))
    alike = placed.groupBy("centre", "followed").agg(filled.alias("own_parts"))
    placed = placed.join(parts, "centre").join(alike, ["centre", "followed"])
    part = F.pmod(F.xxhash64("followed", F.pmod("set_id", "own_parts")), "parts").cast("int")
    return staged(placed.select("set_id", "centre", part.alias("part"), "parts", "bytes"), "groups")


def pivots(placed: DataFrame, count: int) -> DataFrame:
    """(set_id, centre, part): the centre and some more sets of every group of several
    parts, for all of them; parts of near copies become one component through these."""
    some = [F.min_by("set_id", F.xxhash64("set_id", F.lit(k))) for k in range(count)]
    chosen = placed.filter("parts > 1").groupBy("centre", "parts").agg(F.array_distinct(F.array("centre", *some)).alias("sets"))
    spread = chosen.select("centre", "parts", F.explode("sets").alias("set_id"))
    return spread.select("set_id", "centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))


def visits(keys: DataFrame, placed: DataFrame) -> DataFrame:
    """(set_id, centre, part) of the earlier groups that a set must visit: those with a
    set in one of its tables whose component is another."""
    mixed_keys = keys.join(placed.select("set_id", "component", *GROUP), "set_id")
    open_keys = mixed_keys.groupBy("table_key").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    rows = staged(mixed_keys.join(open_keys.filter("least < most").select("table_key"), "table_key"), "open-tables")
    # A group is named once for each table and component side it has there.
    hosts = rows.groupBy("table_key", *GROUP).agg(F.min("component").alias("least"), F.max("component").alias("most"))
    hosts = hosts.select("table_key", F.struct(*GROUP).alias("host"), "least", "most")
    visitors = rows.select("table_key", "set_id", "component", F.struct(*GROUP).alias("home"))
    met = visitors.join(hosts, "table_key").filter("host < home AND (least <> component OR most <> component)")
    return met.select("set_id", "host.centre", "host.part").distinct()


def remove_near_copies(documents: DataFrame, settings: TensorSettings = TensorSettings()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and text_hash of every row."""
    texts = named(documents)
    rows = staged(texts.mapInArrow(signatures(settings), SIGNED), "signatures")
    full = rows.filter("set_id IS NOT NULL")
    of_set = full.groupBy("set_id").agg(
        F.min("doc_id").alias("first_doc"),
        F.min("size").alias("size"),
        F.min_by(F.struct("doc_id", *KEY), F.struct(F.col("doc_id").isNull(), "doc_id", *KEY)).alias("bearer"),
        F.first("halves").alias("halves"),
    )
    of_set = staged(of_set, "distinct-sets")
    keys = staged(table_keys(of_set), "table-keys")
    placed = grouped_sets(keys, of_set.select("set_id", "size"), settings)

    # The full sets of candidates, each from one of the rows that have it.
    bearers = placed.join(of_set.select("set_id", "bearer"), "set_id").select("set_id", F.col("bearer.doc_id").alias("bearer_id"), *[f"bearer.{c}" for c in KEY])
    same = [texts[c] == F.col(f"b.{c}") for c in KEY] + [texts["doc_id"].eqNullSafe(F.col("b.bearer_id"))]
    borne = texts.join(maybe_broadcast(bearers).alias("b"), same).select("set_id", texts["text"])
    full_sets = staged(borne.mapInArrow(shingle_sets(settings.width), "set_id long, tokens binary").dropDuplicates(["set_id"]), "full-sets")

    columns = [*GROUP, "share", "set_id", "component", "tokens", "role"]
    homes = placed.select("set_id", *GROUP).union(pivots(placed, settings.pivots)).distinct()
    homes = homes.join(full_sets, "set_id").withColumns({"share": F.lit(0), "component": F.col("set_id"), "role": F.lit(1)})
    search = found_links(settings.threshold)
    inside = staged(homes.select(*columns).groupBy(*GROUP, "share").applyInArrow(search, "u long, v long"), "links")
    components = connected_components(inside).withColumnRenamed("node", "set_id")
    placed = placed.join(components, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    placed = staged(placed, "components")

    going = staged(visits(keys, placed), "visits")
    loads = going.join(placed.select("set_id", "bytes"), "set_id").groupBy(*GROUP).agg(F.ceil(F.sum("bytes") / settings.visit_bytes).cast("int").alias("shares"))
    loads = staged(loads, "shares")
    whole = placed.select("set_id", "component", *GROUP).join(full_sets, "set_id")
    hosts = whole.join(loads, GROUP).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).withColumn("role", F.lit(0))
    guests = going.join(loads, GROUP).withColumn("share", F.pmod(F.xxhash64("set_id"), "shares").cast("int")).withColumn("role", F.lit(2))
    guests = guests.join(whole.drop(*GROUP), "set_id")
    across = hosts.select(*columns).union(guests.select(*columns)).groupBy(*GROUP, "share").applyInArrow(search, "u long, v long")

    linked = connected_components(inside.union(staged(across, "links-across"))).withColumnRenamed("node", "set_id")
    names = linked.join(of_set.select("set_id", "first_doc"), "set_id").groupBy("component").agg(F.min("first_doc").alias("component_id"))
    of_set = of_set.select("set_id", "first_doc").join(linked, "set_id", "left").join(names, "component", "left")
    of_set = of_set.select("set_id", F.coalesce("component_id", "first_doc").alias("component_id"))
    component = F.coalesce("component_id", "doc_id")
    return rows.select("doc_id", "text_hash", "size", "set_id").join(of_set, "set_id", "left").select(
        "doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_hash"
    )
