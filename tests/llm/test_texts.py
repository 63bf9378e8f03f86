"""Operators on texts against plain versions, on a fixture with every awkward case."""

import hashlib
import random
from collections import Counter
from fractions import Fraction

import pytest
from helpers import LOWER, awkward_rows, frame, sentence, words
from pyspark.sql import functions as F

from loomdex.llm import registry
from loomdex.llm.common import with_hash
from loomdex.llm.decontaminate import find_contamination
from loomdex.llm.exact_dedup import IndexSettings, build_index, directory, exact_dedup, read_index
from loomdex.llm.ngram_join import JaccardSettings, TokenGroup, join_similar
from loomdex.llm.sharding import shard_rows
from loomdex.llm.suffix_dedup import SuffixSettings, cover_for, remove_repeats

ROWS = awkward_rows()
EMPTY = []


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, EMPTY)


def listed(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def similar_by_hand(rows, width, t):
    sets = []
    for _, text, *_ in rows:
        w = words(text)
        sets.append(frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = Counter()
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= t * len(a | b):
                parent[root(i)] = root(j)
                links[i] += 1
                links[j] += 1
    least = {}
    for i, (doc_id, *_) in enumerate(rows):
        if doc_id is not None and sets[i]:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return sorted(((d[0], len(sets[i]), least.get(root(i), d[0]) if sets[i] else d[0], links[i]) for i, d in enumerate(rows)), key=repr)


@pytest.mark.parametrize("width,t", [(4, Fraction(85, 100)), (5, Fraction(8, 10)), (2, Fraction(1, 2)), (1, Fraction(1))])
def test_similar(spark, docs, width, t):
    found = join_similar(docs, JaccardSettings(width, t))
    assert listed(found, "doc_id", "n_shingles", "component_id", "n_links") == similar_by_hand(ROWS, width, t)


def test_similar_group_of_near_copies(spark):
    """A group larger than a block: chains of copies that differ a little more each time."""
    import random

    rng = random.Random(3)
    base = sentence(rng, 80, 10_000).split()
    rows = []
    for k in range(420):
        own = list(base)
        for _ in range(rng.randrange(5)):
            own[rng.randrange(len(own))] = f"v{rng.randrange(40)}"
        rows.append((k, " ".join(own), "en", "a"))
    found = join_similar(frame(spark, rows), JaccardSettings(4, Fraction(85, 100)))
    assert listed(found, "doc_id", "n_shingles", "component_id", "n_links") == similar_by_hand(rows, 4, Fraction(85, 100))


def chains(rng, bases, copies, width):
    """Near copies of several bases whose ends are shared, so that all are one cluster."""
    rows, tail = [], sentence(rng, 20, 10_000).split()
    for b in range(bases):
        base = [*sentence(rng, width, 10_000).split(), *tail]
        for k in range(copies):
            own = list(base)
            for _ in range(rng.randrange(5)):
                own[rng.randrange(len(own))] = f"v{rng.randrange(40)}"
            rows.append((b * copies + k, " ".join(own), "en", "a"))
    return rows


def test_two_thousand_linked_sets_are_counted_at_once():
    import time

    import numpy as np
    import pyarrow as pa

    from loomdex.llm.ngram_join import opened

    rng = np.random.default_rng(2)
    base = np.sort(rng.integers(0, 1 << 63, 10)).astype(np.uint64)
    tokens = [np.sort(np.r_[base, rng.integers(0, 1 << 63, 1).astype(np.uint64)]) for _ in range(2000)]
    columns = {"set_id": np.arange(2000), "copies": np.ones(2000, np.int64), "role": np.ones(2000, np.int32)}
    table = pa.table({**columns, "tokens": pa.array([x.tobytes() for x in tokens], pa.binary())})
    start = time.perf_counter()
    found = opened(Fraction(8, 10))(table).to_pylist()
    assert time.perf_counter() - start < 3
    assert sum(r["partner"] is not None for r in found) == 1999
    assert [r["links"] for r in found if r["partner"] is None] == [1999] * 2000


def test_similar_over_several_blocks_and_shares(spark, monkeypatch):
    import random

    from loomdex.llm import ngram_join

    rows = chains(random.Random(4), 6, 50, 70)
    settings = JaccardSettings(4, Fraction(85, 100), group_bytes=20_000, query_bytes=50_000)
    placed = []
    plain = ngram_join.clusters_of

    def seen(sets, group_bytes):
        found = plain(sets, group_bytes)
        placed.extend(found.select("blocks").collect())
        return found

    monkeypatch.setattr(ngram_join, "clusters_of", seen)
    found = join_similar(frame(spark, rows), settings)
    assert listed(found, "doc_id", "n_shingles", "component_id", "n_links") == similar_by_hand(rows, 4, Fraction(85, 100))
    # Several blocks a cluster, hence queries from outside; several shares of 50 000 bytes.
    assert max(r["blocks"] for r in placed) >= 5


def test_bound_by_the_union():
    import numpy as np

    group = TokenGroup([np.array(x, np.uint64) for x in ([1, 3, 5], [3, 5, 9], [5])])
    query = np.array([2, 3, 5, 9, 12], np.uint64)
    assert group.overlaps(query, 3).tolist() == [2, 3, 1] and group.overlaps(query, 4) is None


def test_exact(spark, docs):
    groups = {}
    for doc_id, text, *_ in ROWS:
        groups.setdefault((text or "").translate(LOWER), []).append(doc_id)
    expected = []
    for low, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(low.encode()).hexdigest()
        expected += [(i, keep, len(ids), i == keep, sha) for i in ids]
    columns = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert listed(exact_dedup(docs), *columns) == sorted(expected, key=repr)
    # Tiny buckets: the directory doubles and hot buckets get overflow pages.
    small = IndexSettings(bucket_bytes=600, max_depth=3, flush_bytes=1000)
    assert listed(exact_dedup(docs, small), *columns) == sorted(expected, key=repr)


def test_index_has_a_file_for_each_page_and_opens_again(spark, docs):
    settings = IndexSettings(bucket_bytes=3000, flush_bytes=2000, max_depth=6)
    path = build_index(with_hash(docs), settings)
    directory_rows = spark.read.parquet(f"{path}/directory").collect()
    pages = spark.read.parquet(f"{path}/pages").withColumn("file", F.input_file_name())
    assert len(directory_rows) > 4 and max(r["pages"] for r in directory_rows) > 1
    files = pages.select("page", "file").distinct().collect()
    assert len({r["file"] for r in files}) == len({r["page"] for r in files}) == len(files)
    found = [listed(read_index(spark, path), "sha", "keep_id", "group_size") for _ in range(2)]
    texts = {}
    for doc_id, text, *_ in ROWS:
        texts.setdefault((text or "").translate(LOWER), []).append(doc_id)
    want = [(hashlib.sha256(t.encode()).hexdigest(), max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in texts.items()]
    assert found[0] == found[1] == sorted(want, key=repr)


def test_directory_doubles_only_where_full():
    owner, pages = directory({0: 10, 1: 10, 7: 100}, 3, 20)
    assert owner.tolist() == [0, 0, 0, 0, 1, 1, 2, 3] and pages == [1, 1, 1, 5]


def contaminated_by_hand(rows, items):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = {}
    for item, text in items:
        w = words(text, pattern)
        n = min(13, len(w))
        for k in range(len(w) - n + 1):
            if n and item is not None:
                windows.setdefault(tuple(w[k : k + n]), set()).add(item)
    out = []
    for doc_id, text, *_ in rows:
        w = words(text, pattern)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= ids
        out.append((doc_id, len(w), tuple(sorted(hit)), tuple(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def test_contamination(spark, docs):
    long_item = " ".join((ROWS[8][1] or "").split()[:200])
    items = [
        (1, ROWS[6][1]), (2, long_item), (2, "another, Text! OF the same id"), (3, None), (4, "..."), (None, "w1"),
        (5, ROWS[3][1]), (6, " ".join(ROWS[20][1].split()[25:45])), (7, ROWS[20][1]), (8, "w5"),
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = find_contamination(docs, benchmark)
    # Rows that repeat an id and a text give a row each.
    rows = found.select("doc_id", "n_words", "places", "items", "contaminated").collect()
    got = sorted(((r[0], r[1], tuple(sorted(r[2])), tuple(sorted(r[3])), r[4]) for r in rows), key=repr)
    assert got == contaminated_by_hand(ROWS, items)
    nothing = find_contamination(docs, benchmark.limit(0)).select("contaminated").distinct().collect()
    assert [r[0] for r in nothing] == [False]


def removed_by_hand(rows, depth):
    bodies = [(t or "").encode() for _, t, *_ in rows]
    starts = Counter(b[k : k + depth] for b in bodies for k in range(len(b) - depth + 1))
    out = []
    for (doc_id, *_), b in zip(rows, bodies, strict=True):
        covered = set()
        for k in range(len(b) - depth + 1):
            if starts[b[k : k + depth]] > 1:
                covered.update(range(k, k + depth))
        runs = sum(1 for k in covered if k - 1 not in covered)
        out.append((doc_id, len(b), len(covered), runs, hashlib.sha256(bytes(x for k, x in enumerate(b) if k not in covered)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("depth", [400, 60, 9])
def test_repeats(spark, docs, depth):
    rows = [r for r in ROWS if len(r[1] or "") < 50_000] + [(60, "ab" * 900, "en", "a"), (61, "x" * 450, "en", "a")]
    found = remove_repeats(frame(spark, rows).repartition(3), SuffixSettings(depth=depth, block_bytes=3000, bucket_bytes=2000))
    got = [(r[0], r[1], r[2], len(r[3] or ()), hashlib.sha256(bytes(r[5])).hexdigest()) for r in found.collect()]
    assert sorted(got, key=repr) == removed_by_hand(rows, depth)


def test_planted_passages(spark, tmp_path):
    """The query on passages of over 50 words in two documents each: one of 400 bytes goes, one of 399 stays."""
    rng, rows, want = random.Random(8), [], []
    for k, size in enumerate((400, 399, 1200, 0)):
        passage = sentence(rng, 300, 100_000)[:size]
        assert not size or len(passage.split()) > 50
        for copy in "ab":
            # Other bytes on both sides of each copy: no more than the passage repeats.
            before, after = f"{sentence(rng, 70, 100_000)}{copy}", f"{copy}{sentence(rng, 70, 100_000)}"
            rows.append((len(rows), before + passage + after, "en", "a"))
            kept, spans = (before + after, 1) if size >= 400 else (rows[-1][1], 0)
            want.append((rows[-1][0], len(rows[-1][1]), spans * size, spans, hashlib.sha256(kept.encode()).hexdigest()))
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.QUERIES["op8_suffix_buckets"](spark, str(tmp_path))
    assert listed(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_difference_covers():
    for depth in (14, 30, 60, 400):
        period, cover = cover_for(depth)
        assert {(a - b) % period for a in cover for b in cover} == set(range(period)) and len(cover) ** 2 < 2 * period


def test_shards(spark, docs):
    rows = shard_rows(docs, n_shards=5, bucket_rows=2).collect()
    assert len(rows) == len(ROWS)
    sizes = Counter(r["shard"] for r in rows)
    assert set(sizes) == set(range(5)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(n))
    for source in ("a", "b", "c", None):
        share = [sum(r["source"] == source for r in rows if r["shard"] == s) for s in range(5)]
        assert max(share) - min(share) <= 2
    assert sorted(r["size"] for r in rows) == sorted(len((t or "").encode()) + 16 for _, t, *_ in ROWS)


def test_empty_tables(spark, none):
    benchmark = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    for df in (join_similar(none), exact_dedup(none), find_contamination(none, benchmark), remove_repeats(none), shard_rows(none)):
        assert df.count() == 0


def test_contamination_is_native(spark, docs):
    from loomdex.llm import decontaminate as dc

    items = dc.item_table(spark.createDataFrame([(1, "a b c")], "item_id long, text string"))
    rows = docs.selectExpr("doc_id", "xxhash64(text) AS text_hash", "text")
    hits = dc.hits_of(rows, dc.item_fingerprints(items, [3]), [3])
    for df in (hits, dc.extended(hits, rows, items)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not [word for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop") if word in plan]


def test_bytes_of_a_text_that_another_has_in_capitals(spark):
    """Exact dedup and shingles lower A-Z only; other letters keep their case."""
    rows = [(1, "Été AB cd ef gh", "fr", "a"), (2, "Été ab CD ef gh", "fr", "a"), (3, "été ab cd ef gh", "fr", "a")]
    kept = {r["doc_id"]: r["keep_id"] for r in exact_dedup(frame(spark, rows)).collect()}
    assert kept == {1: 2, 2: 2, 3: 3}
    same = {r["doc_id"]: r["component_id"] for r in join_similar(frame(spark, rows), JaccardSettings(2, Fraction(1))).collect()}
    assert same == {1: 1, 2: 1, 3: 3}
