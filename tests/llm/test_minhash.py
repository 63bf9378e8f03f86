"""Tensored MinHash against all pairs by hand."""

import random
from fractions import Fraction

import numpy as np
import pytest
from helpers import awkward_rows, frame, sentence
from test_texts import chains, similar_by_hand

from loomdex.llm.minhash_tensor import Links, MinHasher, TensorSettings, remove_near_copies
from loomdex.llm.shingles import Shingler


def listed(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def by_hand(rows, settings):
    found = similar_by_hand(rows, settings.width, settings.threshold)
    return sorted(((d, n, c, d == c) for d, n, c, _ in found), key=repr)


@pytest.mark.parametrize("settings", [TensorSettings(), TensorSettings(width=1, threshold=Fraction(9, 10)), TensorSettings(width=2, threshold=Fraction(1))])
def test_near_copies(spark, settings):
    rows = awkward_rows()
    assert listed(remove_near_copies(frame(spark, rows).repartition(3), settings)) == by_hand(rows, settings)


def near_chain(seed, count):
    """A large group of near copies, each of which is linked with some others only."""
    rng = random.Random(seed)
    base, rows = sentence(rng, 90, 10_000).split(), []
    for k in range(count):
        own = list(base)
        for _ in range(rng.randrange(4)):
            own[rng.randrange(len(own))] = f"v{rng.randrange(40)}"
        rows.append((k, " ".join(own), "en", "a"))
    return rows


@pytest.mark.parametrize("settings", [TensorSettings(), TensorSettings(group_bytes=30_000, visit_bytes=60_000, pivots=0), TensorSettings(group_bytes=30_000, visit_bytes=60_000)])
def test_a_large_group_in_several_parts(spark, settings):
    rows = near_chain(3, 300) + [(1000 + i, *rest) for i, *rest in chains(random.Random(4), 5, 30, 70)]
    assert listed(remove_near_copies(frame(spark, rows), settings)) == by_hand(rows, settings)


def test_empty(spark):
    assert listed(remove_near_copies(frame(spark, []))) == []
    rows = [(1, None, None, None), (2, "", None, None), (None, " ", None, None)]
    assert listed(remove_near_copies(frame(spark, rows))) == [(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, True)]


def test_half_keys_agree_as_often_as_sets_are_similar():
    settings = TensorSettings(collection=60)
    rng = np.random.default_rng(0)
    shared, own = rng.integers(0, 1 << 63, 800).astype(np.uint64), rng.integers(0, 1 << 63, 200).astype(np.uint64)
    one, other = np.unique(np.r_[shared, own[:100]]), np.unique(np.r_[shared, own[100:]])
    keys = MinHasher(settings).half_keys(np.concatenate([one, other]), np.array([0, len(one)]))
    share = (keys[0] == keys[1]).mean()
    assert share == pytest.approx(0.8**3, abs=0.15)
    assert TensorSettings().recall(0.85) > 0.9995 and TensorSettings().recall(0.1) < 0.001


def test_two_thousand_linked_sets_are_one_search():
    import time

    rng = random.Random(1)
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(base[:k] + [f"v{rng.randrange(900)}"] + base[k + 1 :]) for k in (rng.randrange(58, 60) for _ in range(2000))]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    sets = list(Shingler(5).of(raw, np.cumsum([0, *map(len, texts)])))
    links = Links(Fraction(85, 100), sets, np.arange(len(sets)))
    start = time.perf_counter()
    links.index(np.arange(len(sets)))
    links.search(np.arange(len(sets)))
    assert len(np.unique(links.roots)) == 1 and time.perf_counter() - start < 5
    assert len(links.edges) == len(sets) - 1
