"""Statistics and inference of the trained operators against plain loops."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import awkward_rows

from loomdex.llm.language_id import BITS, BUCKETS, LanguageSettings, Mixtures, Trigrams
from loomdex.llm.quality import COUNTS, SHARES, byte_classes, counts_of, transformed

TEXTS = [r[1] for r in awkward_rows() if len(r[1] or "") < 5000]
TEXTS += ["The the THE cat. sat\non on the mat!!\nthe cat\nthe cat", "naïve café — ÉÀ 世界 123,45", "a-b c# d? e;", "\t\r\n", "İI ıi"]


def counts_by_hand(text):
    text = text or ""
    words, lines = text.lower().split(), text.split("\n")
    letters = [c for c in text if c.isascii() and c.isalpha()]
    beyond = sum(not c.isascii() for c in text)
    marks = sum(c in ".,;:?'\"-()" for c in text)
    digits = sum(c in "0123456789" for c in text)
    white = sum(c in " \t\n\r\x0b\x0c" for c in text)
    symbols = len(text) - len(letters) - beyond - marks - digits - white
    tally = Counter(words)
    return {
        "words": len(words), "chars": len(text) - white, "letters": len(letters) + beyond, "upper": sum(c.isupper() for c in letters),
        "symbols": symbols, "sentence marks": marks, "digits": digits, "non-ASCII": beyond, "distinct words": len(tally),
        "most common word": max(tally.values(), default=0),
        "marked words": sum(not w[-1].isalnum() and w[-1] not in ".,;:?'\"" for w in words),
        "lines": len(lines), "repeated lines": len(lines) - len(set(lines)), "doubled words": sum(a == b for a, b in zip(words, words[1:], strict=False)),
    }


def test_quality_counts():
    found = counts_of(pa.array(TEXTS, pa.string()), byte_classes())
    for row, text in zip(found, TEXTS, strict=True):
        assert dict(zip(COUNTS, row, strict=True)) == counts_by_hand(text), text


def test_quality_statistics():
    counts = [counts_by_hand(t) for t in TEXTS]
    table = np.array([[c[name] for name in COUNTS] for c in counts], float)
    corpus = {name: sum(c[name] for c in counts) for name in COUNTS}
    found = transformed(table, table.sum(0), 20.0)
    for row, c in zip(found, counts, strict=True):
        want = [math.log(c["words"] + 20), math.log(c["distinct words"] + 20) - 0.8 * math.log(c["words"] + 20)]
        for part, whole in SHARES:
            usual = (corpus[part] + 1e-3) / (corpus[whole] + 1e-2)
            want.append(math.log((c[part] + 20 * usual) / (c[whole] + 20)))
        assert row.tolist() == pytest.approx(want, rel=1e-12)


def bucket_by_hand(three):
    mask = (1 << 64) - 1
    x = sum(c * m for c, m in zip(three, (0x1F123BB5, 0x2545F4914F6CDD1D, 0x9E3779B97F4A7C15), strict=True)) & mask
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & mask
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & mask
    return (x ^ (x >> 31)) >> (64 - BITS)


def test_trigrams():
    table, letters = Trigrams().counts(pa.array(TEXTS, pa.string()))
    for row, count, text in zip(table, letters, TEXTS, strict=True):
        codes = [ord(c) if c.isalpha() else 0 for c in (text or "").lower()]
        padded = [0, *codes, 0]
        want = Counter(bucket_by_hand(padded[k : k + 3]) for k in range(len(codes)) if codes[k])
        assert count == sum(want.values())
        assert {int(b): int(row[b]) for b in np.flatnonzero(row)} == dict(want)


def mixture_by_hand(counts, probability, settings):
    """EM and the greedy language set of one text, entry by entry."""
    langs = probability.shape[1]

    def log_likelihood(share):
        return sum(n * math.log(sum(probability[b][k] * share[k] for k in range(langs))) for b, n in counts.items())

    def fit(share):
        for _ in range(settings.steps):
            new = [0.0] * langs
            for b, n in counts.items():
                whole = sum(probability[b][k] * share[k] for k in range(langs))
                for k in range(langs):
                    new[k] += n * probability[b][k] * share[k] / whole
            share = [x / sum(counts.values()) for x in new]
        return share, log_likelihood(share)

    whole, _ = fit([1 / langs] * langs)
    alone = [sum(n * math.log(probability[b][k]) for b, n in counts.items()) for k in range(langs)]
    chosen = [max(range(langs), key=lambda k: alone[k])]
    share, best = [float(k in chosen) for k in range(langs)], max(alone)
    while len(chosen) < langs:
        more = max((k for k in range(langs) if k not in chosen), key=lambda k: whole[k])
        wider, likelihood = fit([float(k in [*chosen, more]) / (len(chosen) + 1) for k in range(langs)])
        if likelihood - best <= settings.penalty * math.log(sum(counts.values()) + 1):
            break
        chosen, share, best = [*chosen, more], wider, likelihood
    return share


def test_mixture_of_languages():
    rng, draw = np.random.default_rng(4), random.Random(4)
    probability = rng.dirichlet(np.full(60, 0.2), 4).T + 1e-4
    probability /= probability.sum(0)
    full = np.full((BUCKETS, 4), 1e-6)
    full[:60] = probability
    texts = []
    for _ in range(40):
        langs = draw.sample(range(4), draw.choice([1, 1, 2, 3]))
        drawn = [int(rng.choice(60, p=probability[:, draw.choice(langs)])) for _ in range(draw.choice([1, 5, 60, 400]))]
        texts.append(Counter(drawn))
    table = np.zeros((len(texts), BUCKETS), np.int64)
    for row, counts in enumerate(texts):
        for bucket, n in counts.items():
            table[row, bucket] = n
    settings = LanguageSettings()
    found = Mixtures(table, full, settings).chosen()
    assert (found > 1e-9).sum(1).max() >= 3 and (found > 1e-9).sum(1).min() == 1
    for row, counts in zip(found, texts, strict=True):
        assert row.tolist() == pytest.approx(mixture_by_hand(counts, full, settings), abs=1e-9)
