"""The stages of the pipeline against plain versions, on planted copies, passages and junk."""

import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from helpers import LOWER, frame
from test_texts import contaminated_by_hand, similar_by_hand

import corpus_pipeline
from loomdex.llm.quality import byte_classes, counts_of, score_quality, transformed

pytest.importorskip("public_tokenizers")
STAGES = dict(corpus_pipeline.STAGES)


def prose(rng, n):
    return " ".join(f"{rng.choice('bcdfgmnprst')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice('aeiou')}{rng.randrange(3) * 's'}" for _ in range(n)).capitalize() + "."


def planted():
    rng = random.Random(11)
    good = [prose(rng, 100 + k) for k in range(24)]
    junk = [" ".join(rng.choice(("$$#", "BUY", "!!!", "NOW@", "%%%")) for _ in range(80)) for _ in range(12)]
    passage = prose(rng, 40)
    rows = [(k, text, "en", "a") for k, text in enumerate(good)] + [(50 + k, text, "en", "b") for k, text in enumerate(junk)]

    def cased(text):
        return text[0].swapcase() + text[1:]

    def near(text, at):
        words = text.split()
        words[at] = "changed"
        return " ".join(words)

    rows += [(100, cased(good[0]), "en", "b"), (101, good[1], "en", "b"), (None, good[5], "en", "a")]
    # Copies under one id: repeated rows, a case variant, another source, and a copy with a lesser id.
    rows += [rows[2]] * 3 + [(3, cased(good[3]), "en", "a"), (4, good[4], "en", "z"), (7, good[8], "en", "a")]
    # Copies that all lack an id.
    lost = prose(rng, 90)
    rows += [(None, lost, "en", "a")] * 2 + [(None, lost, "en", "q"), (None, cased(lost), "en", "a")]
    # Near copies, in a chain, and one below the threshold.
    rows += [(110, near(good[6], 50), "en", "a"), (111, near(near(good[6], 50), 20), "en", "a"), (112, " ".join([*good[9].split()[:50], *prose(rng, 60).split()]), "en", "a")]
    rows += [(120, f"{prose(rng, 40)} {passage} {prose(rng, 40)}", "en", "a"), (121, f"{prose(rng, 40)} {' '.join(passage.split()[:12])} {prose(rng, 40)}", "en", "a")]
    rows += [(130, None, "en", "a"), (131, "", "en", "a")]
    labels = [(k, 1, 0) for k in range(24)] + [(50 + k, 0, 0) for k in range(12)]
    return rows, labels, [(1, passage), (2, prose(rng, 30))]


ROWS, LABELS, ITEMS = planted()


def good_by_hand(rows, labels):
    """Predictions by two normal densities, from the same statistics."""
    counts = counts_of(pa.array([r[1] for r in rows], pa.string()), byte_classes())
    x = transformed(counts, counts.sum(0), 20.0)
    known = {i: q for i, q, _ in labels}
    label = np.array([known.get(r[0], -1) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 != 2 else -1 for r in rows])
    spread = [np.cov(x[label == k].T, bias=True) for k in (0, 1)]
    n = [(label == k).sum() for k in (0, 1)]
    pooled = (n[0] * spread[0] + n[1] * spread[1]) / sum(n)
    density = []
    for k in (0, 1):
        own = 0.8 * spread[k] + 0.2 * pooled
        own = 0.9 * own + 0.1 * np.diag(np.diag(own) + 1e-3)
        d = x - x[label == k].mean(0)
        density.append(np.log(n[k]) - np.linalg.slogdet(own)[1] / 2 - (d * np.linalg.solve(own, d.T).T).sum(1) / 2)
    return 1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500)))


def plain(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source").collect()]


def test_score_of_a_plain_discriminant(spark):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    found = score_quality(frame(spark, ROWS), labels).select("doc_id", "score").collect()
    scores = good_by_hand(ROWS, LABELS)
    assert {0, 1} == set((scores >= 0.7).astype(int))
    key = lambda x: (-1 if x[0] is None else x[0], x[1])
    got, expected = sorted((tuple(r) for r in found), key=key), sorted(zip((r[0] for r in ROWS), scores.tolist(), strict=True), key=key)
    assert [i for i, _ in got] == [i for i, _ in expected]
    assert [s for _, s in got] == pytest.approx([s for _, s in expected], abs=1e-6)


def exact_by_hand(rows):
    """Of every text the rows of which one stays."""
    groups = {}
    for row in rows:
        groups.setdefault((row[1] or "").translate(LOWER), []).append(row)
    out = []
    for group in groups.values():
        ids = [r[0] for r in group if r[0] is not None]
        out.append([r for r in group if not ids or r[0] == max(ids)])
    return out


def test_every_stage_and_the_run(spark, tmp_path):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = frame(spark, ROWS)
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    sf_dir = str(tmp_path)

    kept = plain(STAGES["quality classifier"](spark, docs, sf_dir))
    expected = [r for r, score in zip(ROWS, good_by_hand(ROWS, LABELS), strict=True) if score >= 0.7]
    assert Counter(kept) == Counter(expected)
    assert {r[0] for r in ROWS if r[0] is not None and 50 <= r[0] < 62}.isdisjoint(r[0] for r in kept) and len(kept) > 30

    ready = frame(spark, kept)
    exact = [plain(STAGES["exact dedup"](spark, ready.repartition(parts), sf_dir)) for parts in (1, 5)]
    assert Counter(exact[0]) == Counter(exact[1])
    groups = exact_by_hand(kept)
    assert len(exact[0]) == len(groups)
    for group in groups:
        assert sum(r in group for r in exact[0]) == 1

    near = plain(STAGES["n-gram Jaccard join"](spark, frame(spark, exact[0]), sf_dir))
    judged = similar_by_hand(exact[0], 5, Fraction(8, 10))
    assert sorted((r[0] for r in near), key=repr) == sorted((i for i, _, c, _ in judged if i == c), key=repr)
    assert {110, 111}.isdisjoint(r[0] for r in near) and {6, 9, 112} <= {r[0] for r in near} and set(near) <= set(exact[0])

    clean = plain(STAGES["benchmark decontamination"](spark, frame(spark, near), sf_dir))
    dirty = {i for i, _, _, _, hit in contaminated_by_hand(near, ITEMS) if hit}
    assert dirty == {120} and Counter(clean) == Counter(r for r in near if r[0] not in dirty)

    final = plain(corpus_pipeline.run(spark, sf_dir))
    assert Counter(final) == Counter(clean)


def test_exact_copies_leave_one_row(spark):
    """Repeated rows, case variants and other columns under one id, and groups without ids."""
    rows = [(1, "Same text", "en", "a")] * 3 + [(1, "same TEXT", "en", "a"), (1, "Same text", "en", "b"), (0, "same text", "en", "a")]
    rows += [(None, "no id", "en", "a"), (None, "No id", "en", "a"), (None, "no id", "en", "a"), (2, "alone", "en", "a"), (1, "other text", "en", "a")]
    rows += [(None, None, "en", "a"), (None, "", "en", "a")]
    found = plain(STAGES["exact dedup"](spark, frame(spark, rows), ""))
    assert Counter((r[0], (r[1] or "").lower()) for r in found) == Counter([(1, "same text"), (None, "no id"), (2, "alone"), (1, "other text"), (None, "")])
    assert set(found) <= set(rows)
