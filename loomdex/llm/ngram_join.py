"""N-gram Jaccard join with a token-group matrix.

1. Every distinct text becomes a set of hashed word shingles; the number of texts that
   have each shingle is counted (hashes are shuffled, texts stay where they are).
2. A set of n shingles needs ``ceil(t * n)`` of them in a partner. Where so many are
   in no other text that this is impossible, it has no link. Of the others, the
   ``n - ceil(t * n) + 1`` rarest shingles must hold one of any partner's (the prefix
   filter); sets that share one are candidates, joined through one of them, and
   components of candidates are the clusters within which links can be.
3. Clusters are cut into groups (blocks) of similar sets, by their least hash, of
   about ``group_bytes`` of shingles. The token-group matrix keeps each group's token union; a set's
   overlap with the union bounds its overlap with every member. Only where the bound
   reaches ``ceil(t * n)`` is the group opened and each member's overlap counted. In a
   cluster of several groups the bound is taken twice: a set whose prefix shingles are
   all outside a group's union cannot reach it (narrow rows, before any set moves), then
   its whole overlap with the union. A cluster of one group is always opened: its
   queries are its members, and only the prefix filter has selected them.
4. Links become components (``components``) and degrees; copies count in degrees
   without being expanded.

Each pair of groups is looked at from one side. The sets that query a group are dealt
out by ``query_bytes`` at a time, so a hot group is no single task. Near copies of one text
cost a count of shared shingles (a vector operation for each query and group) within their
cluster; there are no rows for pairs.

Cases: null text and texts without words have the empty set and are linked with
nothing. Rows that repeat an id are copies of a document and share its component. A
null id is never a component's name unless all its rows lack one. An empty table
gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.llm.common import staged, unstage
from loomdex.llm.components import connected_components
from loomdex.llm.shingles import Shingler, set_id
from loomdex.llm.text_blocks import KEY, answered, bucket_bits, named, parts_of, unpacked, write_blocks

#: Counts of texts with a shingle are exact below this.
MANY = 255


@dataclass(frozen=True)
class JaccardSettings:
    width: int = 5
    threshold: Fraction = Fraction(8, 10)
    block_bytes: int = 1 << 20
    bucket_bytes: int = 16 << 20
    #: Bytes of shingle hashes of a group of sets, and of the sets that query it at once.
    group_bytes: int = 2 << 20
    query_bytes: int = 8 << 20


def binaries(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([x.tobytes() for x in arrays], pa.binary())


def numbers(column: pa.Array, kind) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in column.to_pylist()]


def block_tokens(shingler: Shingler, offsets: np.ndarray, body: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The sets of a block's texts, all their shingles in order, and in how many of
    the texts each is."""
    sets = list(shingler.of(body, offsets))
    whole, counts = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_counts=True)
    return sets, whole, np.minimum(counts, MANY).astype(np.uint8)


def shingle_counts(settings: JaccardSettings, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(bucket, block, hashes, counts), packed for each bucket of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(settings.width)
        for batch in batches:
            for row in range(batch.num_rows):
                _, offsets, body = unpacked(batch, row)
                _, whole, counts = block_tokens(shingler, offsets, body)
                edges = parts_of(whole, bits)
                filled = np.flatnonzero(np.diff(edges))
                cut = [[x[edges[b] : edges[b + 1]] for b in filled] for x in (whole, counts)]
                block = pa.repeat(batch.column("block")[row], len(filled))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(filled, pa.int32()), block, binaries(cut[0]), binaries(cut[1])], ["bucket", "block", "hashes", "counts"]
                )

    return run


def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket: sort the hashes, sum their counts, and tell every block."""
    buckets, owners, hashes, counts = [], [], [], []
    for batch in batches:
        buckets += batch.column("bucket").to_pylist()
        owners += batch.column("block").to_pylist()
        hashes += numbers(batch.column("hashes"), np.uint64)
        counts += numbers(batch.column("counts"), np.uint8)
    if not hashes:
        return
    edges = np.cumsum([0, *map(len, hashes)])
    whole, count = np.concatenate(hashes), np.concatenate(counts)
    del hashes, counts
    order = np.argsort(whole)
    ordered = whole[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    sums = np.minimum(np.add.reduceat(count[order].astype(np.int64), starts), MANY).astype(np.uint8)
    told = np.empty(len(whole), np.uint8)
    told[order] = np.repeat(sums, np.diff(np.r_[starts, len(whole)]))
    yield pa.RecordBatch.from_arrays(
        [pa.array(owners, pa.int64()), pa.array(buckets, pa.int32()), binaries([told[s:e] for s, e in zip(edges[:-1], edges[1:], strict=True)])],
        ["block", "bucket", "mask"],
    )


SETS = "h1 long, h2 long, n_bytes long, size long, set_id long, tokens binary, prefix array<long>"


def linkable(settings: JaccardSettings, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Every text with its set; tokens and prefix only of sets that can have a link."""
    up, down = settings.threshold.numerator, settings.threshold.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(settings.width)
        for batch in batches:
            for row in range(batch.num_rows):
                keys, offsets, body = unpacked(batch, row)
                sets, whole, _ = block_tokens(shingler, offsets, body)
                edges, count = parts_of(whole, bits), np.zeros(len(whole), np.uint8)
                for answer in batch.column("counts")[row].as_py() or ():
                    count[edges[answer["bucket"]] : edges[answer["bucket"] + 1]] = np.frombuffer(answer["mask"], np.uint8)
                names, tokens, prefixes = [], [], []
                for found in sets:
                    names.append(set_id(found) if len(found) else None)
                    texts = count[np.searchsorted(whole, found)]
                    spare = len(found) - -(-up * len(found) // down) + 1
                    # Rarest first, ties by hash: one order for all texts.
                    first = np.lexsort((found, texts))[:spare]
                    shared = found[first[texts[first] > 1]]
                    tokens.append(found.tobytes() if len(shared) else None)
                    prefixes.append(shared.view(np.int64) if len(shared) else None)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(keys[:, k]) for k in range(3)), pa.array([len(x) for x in sets], pa.int64()), pa.array(names, pa.int64()),
                     pa.array(tokens, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))],
                    [*KEY, "size", "set_id", "tokens", "prefix"],
                )

    return run


class TokenGroup:
    """The members of a block: their token union, and who has each token."""

    def __init__(self, tokens: list[np.ndarray]) -> None:
        self.sizes = np.array([len(x) for x in tokens], np.int64)
        whole = np.concatenate(tokens)
        member = np.repeat(np.arange(len(tokens)), self.sizes)
        order = np.argsort(whole, kind="stable")
        self.holders = member[order]
        self.union, starts = np.unique(whole[order], return_index=True)
        self.starts = np.r_[starts, len(whole)]

    def overlaps(self, query: np.ndarray, least: int) -> np.ndarray | None:
        """Shared tokens with every member; None where the union bound is too low."""
        at = np.searchsorted(self.union, query)
        at[at == len(self.union)] = 0
        at = at[self.union[at] == query]
        if len(at) < least:
            return None
        counts = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(counts)
        within = np.arange(ends[-1]) - np.repeat(ends - counts, counts)
        return np.bincount(self.holders[np.repeat(self.starts[at], counts) + within], minlength=len(self.sizes))


def opened(threshold: Fraction) -> Callable[[pa.Table], pa.Table]:
    """Links of one block with its queries and, once, among its members, as
    (set_id, partner on a spanning forest, copies of the sets it is linked with)."""
    up, down = threshold.numerator, threshold.denominator

    def run(rows: pa.Table) -> pa.Table:
        sets, copies, role = (rows.column(c).to_numpy() for c in ("set_id", "copies", "role"))
        tokens = numbers(rows.column("tokens"), np.uint64)
        members, queries = np.flatnonzero(role < 2), np.flatnonzero(role > 0)
        edges, degree, roots = [], np.zeros(len(sets), np.int64), np.arange(len(sets))
        if len(members) and len(queries):
            group, names = TokenGroup([tokens[k] for k in members]), sets[members]
            for q in queries.tolist():
                size = len(tokens[q])
                shared = group.overlaps(tokens[q], -(-up * size // down))
                if shared is None:
                    continue
                linked = down * shared >= up * (size + group.sizes - shared)
                if role[q] == 1:  # a member is its own query: each pair once
                    linked &= names < sets[q]
                linked = members[linked]
                degree[q] += copies[linked].sum()
                degree[linked] += copies[q]
                trees, first = np.unique(roots[linked], return_index=True)
                new = trees != roots[q]
                if new.any():
                    edges += [(q, int(k)) for k in linked[first[new]]]
                    roots[np.isin(roots, trees[new])] = roots[q]
        ends = np.array(edges, np.int64).reshape(-1, 2)
        some = np.flatnonzero(degree)
        columns = [np.r_[sets[ends[:, 0]], sets[some]], np.r_[sets[ends[:, 1]], some], np.r_[np.zeros(len(ends), np.int64), degree[some]]]
        no_partner = np.arange(len(columns[0])) >= len(ends)
        return pa.table({"set_id": columns[0], "partner": pa.array(columns[1], pa.int64(), mask=no_partner), "links": columns[2]})

    return run


def clusters_of(sets: DataFrame, group_bytes: int) -> DataFrame:
    """(set_id, cluster, block, blocks) of the sets that share a prefix shingle with another."""
    postings = sets.select("set_id", F.explode("prefix").alias("token"))
    centres = postings.groupBy("token").agg(F.min("set_id").alias("centre"), F.max("set_id").alias("other")).filter("centre < other")
    edges = postings.join(centres.select("token", "centre"), "token").select("set_id", "centre").distinct()
    clusters = connected_components(edges).select(F.col("node").alias("set_id"), F.col("component").alias("cluster"))
    clusters = staged(clusters.join(sets.select("set_id", "least", "size"), "set_id"), "clusters")
    filled = F.ceil(F.sum("size") / group_bytes)
    sizes = clusters.groupBy("cluster").agg(filled.cast("int").alias("blocks"))
    # Sets of one least hash are similar and share a block, unless they fill several.
    alike = clusters.groupBy("cluster", "least").agg(filled.alias("parts"))
    placed = clusters.join(sizes, "cluster").join(alike, ["cluster", "least"])
    block = F.pmod(F.xxhash64("least", F.pmod("set_id", "parts")), "blocks").cast("int")
    return staged(placed.select("set_id", "cluster", block.alias("block"), "blocks"), "blocks")


def join_similar(documents: DataFrame, settings: JaccardSettings = JaccardSettings()) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links and text_hash of every row."""
    spark = documents.sparkSession
    name, copies_of_texts, total = write_blocks(documents, 1, settings.block_bytes)
    try:
        table = spark.table(name)
        bits = bucket_bits(2 * total, settings.bucket_bytes)
        asked = table.mapInArrow(shingle_counts(settings, bits), "bucket int, block long, hashes binary, counts binary")
        counts = answered(asked, bits, totals, "counts")
        told = table.join(counts.hint("shuffle_hash"), "block", "left")
        texts = staged(told.mapInArrow(linkable(settings, bits), SETS), "sets")
    finally:
        spark.sql(f"DROP TABLE {name}")
    unstage(counts, copies_of_texts)

    keyed = named(documents).select("doc_id", "text_hash", *KEY)
    of_text = texts.select(*KEY, "size", "set_id").dropDuplicates(KEY)
    rows = staged(keyed.join(of_text, KEY, "left").drop(*KEY), "rows")
    sets = rows.filter("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies"))
    sets = staged(sets, "set-sizes")

    # Texts with the same set are one; where only copies share its shingles it is alone.
    linked = texts.filter("prefix IS NOT NULL").select("set_id", "tokens", "prefix").dropDuplicates(["set_id"])
    linked = linked.withColumns({"least": F.xxhash64(F.substring("tokens", 1, 8)), "size": F.octet_length("tokens")})
    linked = staged(linked, "linkable-sets")
    placed = clusters_of(linked.drop("tokens"), settings.group_bytes)
    members = placed.join(linked.select("set_id", "tokens"), "set_id").join(sets.select("set_id", "copies"), "set_id")
    members = staged(members, "members")
    # A block is queried by the sets of later blocks of its cluster that have a prefix
    # shingle in common with its union. Tokens move for these only.
    share_count = F.greatest(F.lit(1), F.ceil(F.col("blocks") * settings.group_bytes / settings.query_bytes)).cast("int")
    columns = ["cluster", "block", "share", "set_id", "copies", "tokens", "role"]
    inside = members.withColumn("share", F.explode(F.sequence(F.lit(0), share_count - 1)))
    inside = inside.withColumn("role", F.when(F.col("share") == 0, 1).otherwise(0)).select(*columns)
    several = placed.filter("blocks > 1").select("set_id", "cluster", "block")
    held = several.join(linked.select("set_id", F.explode("prefix").alias("token")), "set_id")
    union = held.select("cluster", "token", F.col("block").alias("asked")).distinct()
    asking = held.join(union, ["cluster", "token"]).filter("asked < block").select("set_id", "asked").distinct()
    outside = members.join(asking, "set_id").withColumn("share", F.pmod(F.xxhash64("set_id"), share_count).cast("int"))
    outside = outside.withColumn("block", F.col("asked")).withColumn("role", F.lit(2)).select(*columns)
    grouped = inside.union(outside).groupBy("cluster", "block", "share")
    results = staged(grouped.applyInArrow(opened(settings.threshold), "set_id long, partner long, links long"), "links")

    unstage(texts, linked, members, placed)
    parts = connected_components(results.filter("partner IS NOT NULL").select("set_id", "partner"))
    parts = parts.withColumnRenamed("node", "set_id")
    names = parts.join(sets, "set_id").groupBy("component").agg(F.min("first_doc").alias("component_id"))
    links = results.groupBy("set_id").agg(F.sum("links").alias("links"))
    of_set = sets.join(parts, "set_id", "left").join(names, "component", "left").join(links, "set_id", "left")
    of_set = of_set.select(
        "set_id",
        F.coalesce("component_id", "first_doc").alias("component_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    return rows.join(of_set, "set_id", "left").select(
        "doc_id",
        F.coalesce("size", F.lit(0)).cast("long").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        "text_hash",
    )
