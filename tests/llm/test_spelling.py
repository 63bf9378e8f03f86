"""Spelling variants against a plain version."""

import random
import re
import zlib

import numpy as np
import pytest
from helpers import LOWER, awkward_rows, frame

from loomdex.llm import spelling
from loomdex.llm.spelling import KdTree, SpellingSettings, spelling_variants

COLUMNS = ("word", "n", "n_near", "form", "form_n", "root")


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_hand(rows):
    counts = {}
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
            counts[word] = counts.get(word, 0) + 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    out, forms = {}, {}
    for word, n in counts.items():
        others = [w for w in counts if near(word, w)]
        best = min(others, key=lambda w: (-counts[w], w), default=None)
        forms[word] = best if best and counts[best] >= 10 * n else None
        out[word] = (word, n, len(others), forms[word], counts[best] if forms[word] else None)
    found = []
    for word, row in out.items():
        root = word
        while forms[root]:
            root = forms[root]
        found.append((*row, root))
    return sorted(found)


def listed(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def words_of(rng, count):
    """Random words and edits of them, anagrams, accents and chains of forms."""
    base = ["".join(rng.choice("abcdeéñ÷") for _ in range(rng.randrange(6, 11))) for _ in range(count)]
    out = list(base)
    for word in base:
        at = rng.randrange(len(word))
        out += [word[:at] + word[at + 1 :], word[:at] + rng.choice("abcé") + word[at:], word[:at] + rng.choice("abcé") + word[at + 1 :]]
        out.append("".join(rng.sample(word, len(word))))
    return out


def many_rows(seed=5):
    rng = random.Random(seed)
    rows = awkward_rows()
    for k, word in enumerate(words_of(rng, 60)):
        rows.append((100 + k, " ".join([word, word.upper()] * rng.choice([1, 1, 1, 3, 20, 300])), "en", "a"))
    chain = ["chainaaaa", "chainaaab", "chainaabb", "chainabbb"]
    rows += [(900 + k, " ".join([w] * 2 * 11**k), "en", "a") for k, w in enumerate(chain)]
    rows += [(950, "ties" * 5 + " tiestiestiestiestiesx" * 40, None, None), (951, "tiestiestiestiestiesy " * 40 + "ties" * 5, None, None)]
    return rows


@pytest.mark.parametrize("settings", [SpellingSettings(), SpellingSettings(cell_words=16, visit_words=40, most_cells=3, sampled=4)])
def test_variants(spark, settings):
    rows = many_rows()
    expected = variants_by_hand(rows)
    assert any(r[5] not in (r[0], r[3]) for r in expected)  # a chain of forms
    assert listed(spelling_variants(frame(spark, rows).repartition(3), settings)) == expected


def test_dealt_out_over_cells_cuts_and_shares(spark, monkeypatch):
    """With tiny cells the words of one length are in several tasks."""
    seen = []
    plain = spelling.cells
    monkeypatch.setattr(spelling, "cells", lambda words, settings: seen.append(plain(words, settings)) or seen[0])
    rows = many_rows(6)
    settings = SpellingSettings(cell_words=16, visit_words=40, most_cells=3, sampled=4)
    assert listed(spelling_variants(frame(spark, rows), settings)) == variants_by_hand(rows)
    assert any(tree.leaves == 3 for tree in seen[0].values())


def test_empty_tables(spark):
    assert listed(spelling_variants(frame(spark, []))) == []
    assert listed(spelling_variants(frame(spark, [(1, None, None, None), (2, "", None, None), (3, "1234567 1234567", None, None)]))) == []


@pytest.mark.parametrize("tight", [True, False])
def test_tree_finds_all_within_the_distance(tight):
    rng = np.random.default_rng(1)
    points = rng.integers(0, 3, (400, spelling.AXES)).astype(np.int32)
    points[:, 4:] = 0
    points[:50] = points[0]
    tree = KdTree(points, 8, tight=tight)
    where = np.empty(len(points), np.int64)
    for node, rows in enumerate(tree.members):
        if rows is not None:
            where[rows] = node
    assert (tree.number[where] == tree.leaf_of(points)).all() or tight
    query, node = tree.reach(points, 2)
    reached = set(zip(query.tolist(), node.tolist(), strict=True))
    for i in range(len(points)):
        for j in np.flatnonzero(np.abs(points - points[i]).sum(1) <= 2).tolist():
            assert (i, int(where[j])) in reached
