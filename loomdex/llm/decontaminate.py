"""Benchmark decontamination by winnowing, in DataFrame functions only.

The fingerprints of a word sequence are the least hashes of its ``GRAM``-word grams
in every stretch of ``STRETCH`` consecutive grams. Two sequences that share
``GRAM + STRETCH - 1`` words, the window of the contamination rule, share a
fingerprint at the same place of that span. Document fingerprints are joined with
those of the items; a hit is an (item, offset) pair, and it is extended by comparing
the words of every window of the item with the document's words at that offset. An
item shorter than a window has one fingerprint, its whole sequence, and is looked
up among the document's grams of that length (only lengths that occur are made).

Document texts are read twice and only those with hits are shuffled; what is joined
by hash are numbers. Item fingerprints are broadcast up to ``BROADCAST_ROWS`` rows
(counted), beyond that the join shuffles and Spark splits hot hashes.

Cases: null text has no words. Items without words or without id are ignored;
several texts of one item id are windows of that id. Rows with equal id and equal
text are judged once and give a row each; a null id is an id. Empty tables give no rows, or no hits.
Columns beside ids and texts are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.llm.common import staged, with_hash

WINDOW = 13
GRAM = 8
STRETCH = WINDOW - GRAM + 1
PLACE_BITS = 30
BROADCAST_ROWS = 1_000_000
#: ASCII that separates words, before lower-casing.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for each row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words with A-Z in lower case. A word that lower() leaves alone has no A-Z."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda w: w != "")
    return F.transform(words, lambda w: F.when(F.lower(w) == w, w).otherwise(F.translate(w, UPPER, LOWER)))


def places(count: Column) -> Column:
    """0 .. count - 1 (empty for less than one)."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def grams(codes: Column, length: int) -> Column:
    return F.transform(places(F.size(codes) - (length - 1)), lambda i: F.xxhash64(*(codes[i + k] for k in range(length))))


def winnowed(codes: Column) -> Column:
    """(hash, place) of the fingerprints of a sequence of word codes."""

    def chosen(hashes: Column) -> Column:
        # Low bits hold the place, so the least number is the leftmost least hash.
        placed = F.transform(hashes, lambda h, i: F.shiftleft(h, PLACE_BITS).bitwiseOR(i.cast("long")))
        least = let(placed, lambda p: F.transform(places(F.size(p) - (STRETCH - 1)), lambda i: F.least(*(p[i + k] for k in range(STRETCH)))))
        at = F.transform(F.array_distinct(least), lambda x: x.bitwiseAND((1 << PLACE_BITS) - 1).cast("int"))
        return F.transform(at, lambda i: F.struct(hashes[i].alias("hash"), i.alias("place")))

    return let(grams(codes, GRAM), chosen)


def whole_grams(codes: Column, length: int) -> Column:
    """(hash, place) of all grams of a length; the length is part of the hash."""
    return F.transform(grams(codes, length), lambda h, i: F.struct(F.xxhash64(F.lit(length), h).alias("hash"), i.alias("place")))


def item_table(benchmark: DataFrame) -> DataFrame:
    items = benchmark.filter("item_id IS NOT NULL").select("item_id", words_of(F.col("text")).alias("item_words"))
    return items.filter(F.size("item_words") > 0).distinct()


def item_fingerprints(items: DataFrame, lengths: list[int]) -> DataFrame:
    codes = F.transform("item_words", lambda w: F.xxhash64(w))
    size = F.size("item_words")
    prints = F.when(size >= WINDOW, let(codes, winnowed))
    for length in lengths:
        prints = prints.when(size == length, whole_grams(codes, length))
    return items.select("item_id", F.explode(prints).alias("print")).select("item_id", "print.hash", F.col("print.place").alias("item_place"))


def hits_of(documents: DataFrame, prints: DataFrame, lengths: list[int]) -> DataFrame:
    """doc_id, text_hash, n_words, rows and the set of (item_id, offset) of every document."""

    def marks(words: Column) -> Column:
        def all_prints(codes: Column) -> Column:
            found = [winnowed(codes), *(whole_grams(codes, n) for n in lengths)]
            # Place -1 stands for the document itself, so that one without hits stays.
            own = F.array(F.struct(F.lit(None).cast("long").alias("hash"), F.lit(-1).alias("place")))
            return F.struct(F.size(words).alias("n_words"), F.concat(own, *found).alias("prints"))

        return let(F.transform(words, lambda w: F.xxhash64(w)), all_prints)

    rows = documents.select("doc_id", "text_hash", let(words_of(F.col("text")), marks).alias("m"))
    rows = rows.select("doc_id", "text_hash", "m.n_words", F.explode("m.prints").alias("print"))
    rows = rows.select("doc_id", "text_hash", "n_words", "print.hash", "print.place")
    if prints.count() <= BROADCAST_ROWS:
        prints = F.broadcast(prints)
    joined = rows.join(prints, "hash", "left").filter("place < 0 OR item_id IS NOT NULL")
    hit = F.when(F.col("item_id").isNotNull(), F.struct("item_id", (F.col("place") - F.col("item_place")).alias("offset")))
    own = F.count_if(F.col("place") < 0)
    return joined.groupBy("doc_id", "text_hash").agg(F.max("n_words").cast("long").alias("n_words"), own.alias("rows"), F.collect_set(hit).alias("hits"))


def extended(hits: DataFrame, documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, text_hash, hit word places and item ids of the documents with hits."""
    pairs = hits.select("doc_id", "text_hash", F.explode("hits").alias("hit")).select("doc_id", "text_hash", "hit.item_id", "hit.offset")
    # An item's words are in a row once, whatever the number of its offsets there.
    offsets = pairs.groupBy("doc_id", "text_hash", "item_id").agg(F.collect_set("offset").alias("offsets"))
    listed = offsets.join(items, "item_id").groupBy("doc_id", "text_hash").agg(
        F.collect_set(F.struct("item_id", "offsets", "item_words")).alias("hits")
    )
    texts = documents.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "text")
    texts = listed.join(texts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
    texts = texts.dropDuplicates(["doc_id", "text_hash"])

    def compared(words: Column, hit: Column) -> Column:
        size = F.size(hit["item_words"])
        window = F.least(size, F.lit(WINDOW))

        def places_at(start: Column) -> Column:
            same = F.filter(
                places(size - window + 1),
                lambda s: (s + start >= 0)
                & (s + start + window <= F.size(words))
                & (F.slice(words, F.greatest(s + start, F.lit(0)) + 1, window) == F.slice(hit["item_words"], s + 1, window)),
            )
            return F.flatten(F.transform(same, lambda s: F.sequence(s + start, s + start + window - 1)))

        return F.struct(hit["item_id"].alias("item_id"), F.flatten(F.transform(hit["offsets"], places_at)).alias("at"))

    found = let(words_of(F.col("text")), lambda words: F.filter(F.transform("hits", lambda h: compared(words, h)), lambda x: F.size(x["at"]) > 0))
    texts = texts.select("doc_id", "text_hash", found.alias("found"))
    return texts.select(
        "doc_id",
        "text_hash",
        F.array_distinct(F.flatten("found.at")).alias("places"),
        F.array_distinct("found.item_id").alias("items"),
    )


def find_contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, hit places (word numbers from 0), item ids, contaminated, text_hash."""
    docs = with_hash(documents)
    items = item_table(benchmark)
    short = items.select(F.size("item_words").alias("n")).filter(F.col("n") < WINDOW).distinct()
    # At most WINDOW - 1 lengths.
    lengths = sorted(r["n"] for r in short.collect())
    hits = staged(hits_of(docs, item_fingerprints(items, lengths), lengths), "winnowed")
    sure = extended(hits.filter(F.size("hits") > 0), docs, items)
    sure = sure.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "places", "items")
    joined = hits.join(sure, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    places_hit = F.coalesce("places", F.array().cast("array<int>"))
    n_hit = F.size(places_hit).cast("long")
    # A row for every row that has this id and text.
    joined = joined.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    return joined.select(
        "doc_id",
        "n_words",
        places_hit.alias("places"),
        F.coalesce("items", F.array().cast("array<bigint>")).alias("items"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"),
        "text_hash",
    )
