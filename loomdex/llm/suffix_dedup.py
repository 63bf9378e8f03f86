"""Removal of long repeated byte strings by sparse suffix buckets.

Wanted are the suffixes whose first ``depth`` bytes start somewhere else too. A
difference cover D modulo v (for any two positions there is a shift below v that
puts both into D; ``|D|`` is about the root of v) makes a sparse suffix array enough
to find all that can tie:

1. Cover sample: suffixes at positions of D are named by the hash of their first
   ``depth - v + 1`` bytes. Names are sorted one bucket of the hash range at a time;
   equal neighbours share a rank, and a suffix of an unshared rank is done.
2. Of two equal strings of ``depth`` bytes, one shift below v reaches a sample suffix in
   both, with a shared rank. So a suffix can tie only if a sample position with a
   shared rank lies less than v behind its start; no other suffix enters a bucket.
3. Those long ties are resolved by the hash of all ``depth`` bytes, again sorted one
   bucket at a time; neighbours of equal hash are repeated.

Buckets are ranges of a hash and not of the text, as only equality to a fixed depth
is asked and no order beyond; they are of even size whatever the texts repeat, and a
task of texts sends a hash once however often it has it. Texts are written once
to a table bucketed by block, so the passes over it shuffle hashes and bit masks only.
Texts with the same bytes are reduced to one (and are removed whole) before that.

Cases: null text is empty. Rows that repeat an id or a text are separate rows, so
their texts repeat. Texts under ``depth`` bytes lose nothing. A null id is an id. An
empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.llm.common import RangeHash, maybe_broadcast, raw_text, staged, unstage
from loomdex.llm.text_blocks import KEY, answered, bucket_bits, named, parts_of, unpacked, write_blocks


#: Numbers in all spans (ends of spans and names of texts) up to which they are broadcast.
BROADCAST_NUMBERS = 2_000_000


@dataclass(frozen=True)
class SuffixSettings:
    depth: int = 400
    block_bytes: int = 1 << 20
    bucket_bytes: int = 16 << 20


def difference_cover(q: int) -> tuple[int, list[int]]:
    """A perfect difference set of q + 1 numbers modulo q * q + q + 1 for a prime q:
    the powers of a generator of GF(q^3) that lie in a plane (Singer)."""
    order = q**3 - 1
    for code in range(1, q**3):
        a, b, c = code % q, code // q % q, code // q // q
        x, seen = (0, 1, 0), []
        for power in range(1, order + 1):
            seen.append(x)
            if x == (1, 0, 0):
                break
            # times t, where t^3 = a t^2 + b t + c
            x = (x[2] * c % q, (x[0] + x[2] * b) % q, (x[1] + x[2] * a) % q)
            if x == (0, 0, 0):
                break
        if power == order and x == (1, 0, 0):
            modulus = q * q + q + 1
            return modulus, sorted((k + 1) % modulus for k, y in enumerate(seen[:modulus]) if y[2] == 0)
    raise ValueError(f"{q} is not a prime")


def cover_for(depth: int) -> tuple[int, list[int]]:
    """The largest cover with a period of at most half the depth."""
    primes = [q for q in range(2, 200) if all(q % p for p in range(2, q)) and q * q + q + 1 <= max(7, depth // 2)]
    return difference_cover(primes[-1])


class Suffixes:
    """Hashes and coverage for the texts of one block."""

    def __init__(self, settings: SuffixSettings) -> None:
        self.depth = settings.depth
        self.period, cover = cover_for(self.depth)
        if self.depth < self.period:
            raise ValueError("depth is below the shortest cover")
        self.sampled = np.zeros(self.period, bool)
        self.sampled[cover] = True
        self.name_bytes = self.depth - self.period + 1
        self.hash = RangeHash()

    def load(self, body: np.ndarray, offsets: np.ndarray) -> None:
        self.hash.load(body)
        self.size, self.offsets = len(body), offsets
        lengths = np.diff(offsets)
        self.start = np.repeat(offsets[:-1], lengths)
        self.place = np.arange(self.size) - self.start
        self.left = np.repeat(lengths, lengths) - self.place
        at = np.flatnonzero(self.sampled[self.place % self.period] & (self.left >= self.name_bytes))
        self.samples = at
        self.names, self.name_of, counts = np.unique(self.hash.of(at, at + self.name_bytes), return_inverse=True, return_counts=True)
        self.name_repeated = counts > 1

    def tie(self, shared: np.ndarray) -> None:
        """Hashes of the suffixes that can tie, given the ranks shared with other blocks."""
        at = self.samples[(shared | self.name_repeated)[self.name_of]]
        change = np.zeros(self.size + 1, np.int32)
        np.add.at(change, np.maximum(at - self.period + 1, self.start[at]), 1)
        np.add.at(change, at + 1, -1)
        self.ties = np.flatnonzero((np.cumsum(change[:-1]) > 0) & (self.left >= self.depth))
        self.keys, self.key_of, counts = np.unique(self.hash.of(self.ties, self.ties + self.depth), return_inverse=True, return_counts=True)
        self.key_repeated = counts > 1

    def spans(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of bytes in repeated strings. Texts of
        a block lie end to end, so a run also ends with its text."""
        at = self.ties[(shared | self.key_repeated)[self.key_of]]
        if not len(at):
            return at, at
        new = np.r_[True, (at[1:] > at[:-1] + self.depth) | (self.start[at[1:]] != self.start[at[:-1]])]
        first = np.flatnonzero(new)
        return at[first], at[np.r_[first[1:], len(at)] - 1] + self.depth


def masked(hashes: np.ndarray, bits: int, answers: list[dict] | None) -> np.ndarray:
    """The answers of all buckets as one mask over a block's sorted hashes."""
    mask = np.zeros(len(hashes), bool)
    if answers:
        edges = parts_of(hashes, bits)
        for answer in answers:
            start, end = edges[answer["bucket"]], edges[answer["bucket"] + 1]
            mask[start:end] = np.unpackbits(np.frombuffer(answer["mask"], np.uint8), count=end - start).astype(bool)
    return mask


def sent(block: int, hashes: np.ndarray, bits: int) -> pa.RecordBatch:
    edges = parts_of(hashes, bits)
    filled = np.flatnonzero(np.diff(edges))
    parts = [hashes[edges[b] : edges[b + 1]].tobytes() for b in filled]
    return pa.RecordBatch.from_arrays(
        [pa.array(filled, pa.int32()), pa.array(np.full(len(filled), block), pa.int64()), pa.array(parts, pa.binary())], ["bucket", "block", "hashes"]
    )


def name_hashes(settings: SuffixSettings, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suffixes = Suffixes(settings)
        for batch in batches:
            for row in range(batch.num_rows):
                _, offsets, body = unpacked(batch, row)
                suffixes.load(body, offsets)
                yield sent(batch.column("block")[row].as_py(), suffixes.names, bits)

    return run


def tie_hashes(settings: SuffixSettings, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suffixes = Suffixes(settings)
        for batch in batches:
            for row in range(batch.num_rows):
                _, offsets, body = unpacked(batch, row)
                suffixes.load(body, offsets)
                suffixes.tie(masked(suffixes.names, bits, batch.column("ranks")[row].as_py()))
                yield sent(batch.column("block")[row].as_py(), suffixes.keys, bits)

    return run


def repeated_spans(settings: SuffixSettings, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(h1, h2, n_bytes, starts, ends) of the texts with repeated strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suffixes = Suffixes(settings)
        for batch in batches:
            for row in range(batch.num_rows):
                keys, offsets, body = unpacked(batch, row)
                suffixes.load(body, offsets)
                suffixes.tie(masked(suffixes.names, bits, batch.column("ranks")[row].as_py()))
                starts, ends = suffixes.spans(masked(suffixes.keys, bits, batch.column("repeats")[row].as_py()))
                owner = np.searchsorted(offsets, starts, "right") - 1
                texts, first = np.unique(owner, return_index=True)
                edges = pa.array(np.r_[first, len(owner)], pa.int32())
                local = [pa.ListArray.from_arrays(edges, pa.array(x - offsets[owner], pa.int64())) for x in (starts, ends)]
                yield pa.RecordBatch.from_arrays([*(pa.array(keys[texts, k]) for k in range(3)), *local], ["h1", "h2", "n_bytes", "starts", "ends"])

    return run


def shared_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket: sort, and tell each block which of its hashes other blocks have."""
    buckets, owners, parts = [], [], []
    for batch in batches:
        buckets += batch.column("bucket").to_pylist()
        owners += batch.column("block").to_pylist()
        parts += [np.frombuffer(x, np.uint64) for x in batch.column("hashes").to_pylist()]
    if not parts:
        return
    edges = np.cumsum([0, *map(len, parts)])
    whole = np.concatenate(parts)
    del parts
    order = np.argsort(whole)
    ordered = whole[order]
    same = ordered[1:] == ordered[:-1]
    shared = np.zeros(len(whole), bool)
    shared[order] = np.r_[False, same] | np.r_[same, False]
    masks = [shared[s:e] for s, e in zip(edges[:-1], edges[1:], strict=True)]
    told = [k for k, mask in enumerate(masks) if mask.any()]
    yield pa.RecordBatch.from_arrays(
        [pa.array([owners[k] for k in told], pa.int64()), pa.array([buckets[k] for k in told], pa.int32()), pa.array([np.packbits(masks[k]).tobytes() for k in told], pa.binary())],
        ["block", "bucket", "mask"],
    )


def repeated_strings(documents: DataFrame, settings: SuffixSettings = SuffixSettings()) -> DataFrame:
    """(h1, h2, n_bytes, starts, ends) of every distinct text with repeated strings."""
    spark = documents.sparkSession
    name, copies, total = write_blocks(documents, settings.depth, settings.block_bytes)
    try:
        table = spark.table(name)
        cover = cover_for(settings.depth)
        names_bytes = total * 8 * len(cover[1]) // cover[0]
        bits = bucket_bits(names_bytes, settings.bucket_bytes)
        kind = "bucket int, block long, hashes binary"
        ranks = answered(table.mapInArrow(name_hashes(settings, bits), kind), bits, shared_hashes, "ranks")
        # Blocks without a shared rank may still repeat within themselves: a left join.
        ranked = table.join(ranks.hint("shuffle_hash"), "block", "left")
        repeats = answered(ranked.mapInArrow(tie_hashes(settings, bits), kind), bits, shared_hashes, "repeats")
        both = ranked.join(repeats.hint("shuffle_hash"), "block", "left")
        spans = both.mapInArrow(repeated_spans(settings, bits), "h1 long, h2 long, n_bytes long, starts array<long>, ends array<long>")
        whole = copies.select(*KEY, F.array(F.lit(0).cast("long")).alias("starts"), F.array("n_bytes").alias("ends"))
        spans = staged(spans.join(maybe_broadcast(copies.select(*KEY)), KEY, "left_anti").union(whole), "spans")
    finally:
        spark.sql(f"DROP TABLE {name}")
    unstage(ranks, repeats, copies)
    return spans


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes outside the spans, and the spans' total."""
    for batch in batches:
        raw, offsets = raw_text(batch.column("text"))
        whole, at = raw.tobytes(), offsets.tolist()
        kept, removed = [], []
        for k, (starts, ends) in enumerate(zip(batch.column("starts").to_pylist(), batch.column("ends").to_pylist(), strict=True)):
            text = whole[at[k] : at[k + 1]]
            edges = [0, *(x for pair in zip(starts or (), ends or (), strict=True) for x in pair), len(text)]
            kept.append(b"".join(text[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True)))
            removed.append(len(text) - len(kept[-1]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_bytes"), pa.array(removed, pa.int64()), batch.column("starts"), batch.column("ends"), pa.array(kept, pa.binary())],
            ["doc_id", "n_bytes", "n_removed", "starts", "ends", "kept"],
        )


def remove_repeats(documents: DataFrame, settings: SuffixSettings = SuffixSettings()) -> DataFrame:
    """doc_id, n_bytes, n_removed, span starts and ends (null: none) and kept bytes of every row."""
    spans = repeated_strings(documents, settings)
    # Spans are broadcast by the numbers they hold: a text may have any number of them.
    spans = maybe_broadcast(spans, BROADCAST_NUMBERS, F.size("starts") * 2 + len(KEY))
    joined = named(documents).join(spans, KEY, "left")
    return joined.select("doc_id", "n_bytes", "text", "starts", "ends").mapInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, starts array<long>, ends array<long>, kept binary"
    )
