"""Small fixtures with every awkward case, and plain versions of the contracts."""

from __future__ import annotations

import random
import re

from pyspark.sql import types as T

#: Names that operators and stages use, or used once, for columns of their own.
CLASHING = (
    "text_hash", "ids", "component_id", "set_id", "kept", "row", "rows", "own_id", "own_hash", "drop_id", "DROP_HASH",
    "_id", "_hash", "_text", "_drop_id", "_drop_hash", "h1", "n_bytes", "sha", "size", "word", "n", "hits", "place",
)
DOCUMENTS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
     *(T.StructField(name, T.StringType()) for name in CLASHING)]
)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    """rows: (doc_id, text, lang, source)."""
    full = [(i, t, lang, source, None if t is None else len(t), *CLASHING) for i, t, lang, source in rows]
    return spark.createDataFrame(full, DOCUMENTS)


def sentence(rng: random.Random, words: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


def awkward_rows(seed: int = 7) -> list[tuple]:
    """Nulls, empty and very long texts, exact, near and repeated copies, shared passages."""
    rng = random.Random(seed)
    base = [sentence(rng, n) for n in (3, 20, 60, 200, 400)]
    passage = sentence(rng, 90)
    rows = [(0, None, "en", "a"), (1, "", "en", None), (2, " \n\t", None, "a"), (3, "ÉÀ ß É", "fr", "b"), (None, base[2], "en", "a")]
    for k, text in enumerate(base):
        rows.append((10 + k, text, "en", "a"))
        rows.append((20 + k, text.upper() if k % 2 else text, "en", "b"))
        words = text.split()
        words[len(words) // 2] = "changed"
        rows.append((30 + k, " ".join(words), "de", "a"))
        rows.append((40 + k, f"{sentence(rng, 30)} {passage} {sentence(rng, 30)}", "es", "c"))
    rows.append((50, sentence(rng, 20_000, 50_000), "en", "a"))
    rows.append((51, "x" * 100_000, "en", "a"))
    rows += [rows[7], (10, "another text of the same id", "en", "a")]
    return rows


def words(text: str | None, pattern: str = r"[^\x20\x09-\x0D]+") -> list[str]:
    return re.findall(pattern, (text or "").translate(LOWER))
