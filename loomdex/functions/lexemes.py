"""Analyzers: text -> lexemes, and the weight of a lexeme in a chunk."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomdex.functions.stemming import english_stem, russian_stem
from loomdex.functions.stopwords import ENGLISH_STOP, RUSSIAN_STOP
from loomdex.functions.text import WORD

# Fixed values of the ranking function: the weight of an unlabelled lexeme, the
# limit of sum(1/j^2), and the positions kept per lexeme and chunk (the documented
# limit of the ranking's own index; further occurrences add nothing to a rank).
LEXEME_WEIGHT = 0.1
INVERSE_SQUARE_LIMIT = 1.64493406685
MAX_POSITIONS = 255

ANALYZERS = ("simple", "russian")


def words(text: Column) -> Column:
    """Lower-cased runs of word characters, in text order."""
    return F.filter(F.split(F.lower(text), rf"[^{WORD}]+", -1), lambda w: w != "")


def is_stop_word(word: Column, analyzer: str) -> Column:
    """Whether the analyzer drops a word."""
    return word.isin(*ENGLISH_STOP, *RUSSIAN_STOP) if analyzer == "russian" else F.lit(False)


def lexeme_of(word: Column, analyzer: str) -> Column:
    """Lexeme of one word; NULL for a stop word.

    ``russian`` sends ASCII words to the English stemmer and all others to the
    Russian one, each after dropping its own stop words.
    """
    if analyzer == "simple":
        return word
    if analyzer != "russian":
        raise ValueError(f"unknown analyzer: {analyzer}")
    is_ascii = word.rlike(r"^[\x00-\x7F]*$")
    return F.when(
        is_ascii, F.when(~word.isin(*ENGLISH_STOP), english_stem(word))
    ).otherwise(F.when(~word.isin(*RUSSIAN_STOP), russian_stem(word)))


def weight_table() -> list[float]:
    """Rank contribution of a lexeme that occurs 1, 2, ... times in a chunk; the
    last entry holds for all higher counts."""
    table, series = [], 0.0
    for j in range(1, MAX_POSITIONS + 1):
        series += 1.0 / (j * j)
        table.append(LEXEME_WEIGHT * series / INVERSE_SQUARE_LIMIT)
    return table
