"""Trained and tokenizing operators: held-out accuracy, exact round trips, fixtures."""

import os
import random

import pytest
from helpers import awkward_rows, frame, sentence

from loomdex.llm.language_id import identify_language
from loomdex.llm.piece_encoding import ChunkTable, encode_pieces, load
from loomdex.llm.quality import QualitySettings, score_quality

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
ROWS = awkward_rows()
MEDIUM = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(MEDIUM), reason="test tables not present")


def test_pieces_equal_the_library(spark):
    rows = [*ROWS, (70, "▁a▁ b  c   ", "en", "a"), (71, "tab\tline\n  世界🙂 <s></s>", "en", "a"), (72, " ", "en", "a")]
    found = {(r["doc_id"], r["text"]): r for r in encode_pieces(frame(spark, rows), MODEL, keep=("doc_id", "text")).collect()}
    with open(MODEL, "rb") as file:
        processor = load(file.read())
    for doc_id, text, *_ in rows:
        ids = processor.encode(text or "")
        assert found[doc_id, text]["ids"] == ids and found[doc_id, text]["decoded"] == processor.decode(ids)
    assert encode_pieces(frame(spark, []), MODEL).count() == 0


def test_chunks_of_random_texts():
    with open(MODEL, "rb") as file:
        processor = load(file.read())
    table, rng = ChunkTable(processor, limit=50), random.Random(2)
    parts = [" ", "  ", "\n", "▁", "the", "é", "世", "🙂", "<s>", "<0x0A>", "000", "　", "\0"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        chunks = table.chunks(text)
        table.learn([chunks])
        assert [i for c in chunks for i in table.ids[c]] == processor.encode(text)


@needs_tables
def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet")
    scored = score_quality(spark.read.parquet(f"{MEDIUM}/documents.parquet"), labels).join(labels, "doc_id").filter("held_out")
    right = scored.filter("predicted = quality").count()
    assert right >= 0.97 * scored.count()
    assert scored.filter("score < 0 OR score > 1").count() == 0


def test_quality_cases(spark):
    docs = frame(spark, ROWS)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(10, 50)] + [(11, None, 0), (12, 1, 1), (13, 7, 0)], "doc_id long, quality int, toxic int")
    scored = score_quality(docs, labels)
    assert scored.count() == len(ROWS) and scored.filter("score IS NULL OR score < 0 OR score > 1 OR held_out IS NULL").count() == 0
    assert {r[0] for r in score_quality(docs, labels.filter("quality = 1")).select("score").collect()} == {1.0}
    assert {r[0] for r in score_quality(docs, labels.limit(0)).select("score").collect()} == {0.5}
    assert score_quality(frame(spark, []), labels, QualitySettings()).count() == 0


@needs_tables
def test_language_held_out(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    judged = identify_language(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert judged.filter("lang = lang_pred").count() >= 0.98 * judged.count()


def test_language_mixture_and_cases(spark):
    rng = random.Random(5)
    letters = {"aa": "abcde", "bb": "vwxyz"}

    def text(lang, n):
        return " ".join("".join(rng.choice(letters[lang]) for _ in range(6)) for _ in range(n))

    rows = [(k, text(lang, 40), lang, "a") for k, lang in enumerate(["aa", "bb"] * 30)]
    rows += [(900, None, "aa", "a"), (901, "123 !?", "aa", "a"), (902, text("aa", 70) + " " + text("bb", 30), None, "a"), (None, text("bb", 9), None, "a")]
    found = {r["doc_id"]: r for r in identify_language(frame(spark, rows)).collect()}
    assert all(found[k]["lang_pred"] == lang and found[k]["score"] > 0.95 for k, (_, _, lang, _) in enumerate(rows[:60]))
    assert (found[900]["lang_pred"], found[901]["lang_pred"], found[900]["score"]) == ("und", "und", 0.0)
    assert found[902]["lang_pred"] == "aa" and 0.6 < found[902]["score"] < 0.8
    assert found[None]["lang_pred"] == "bb" and found[None]["held_out"] is False
    unlearned = identify_language(frame(spark, [(1, sentence(rng, 5), None, "a")])).collect()
    assert [(r["lang_pred"], r["score"]) for r in unlearned] == [("und", 0.0)]
    assert identify_language(frame(spark, [])).count() == 0
