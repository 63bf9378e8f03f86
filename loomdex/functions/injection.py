"""Prompt-injection patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomdex.functions.pii import BLANK
from loomdex.functions.text import NOT_WORD_BEFORE

# Patterns in the order that decides the reported reason, and the
# traces of a carried-out injection in a finished card.
_S = f"[{BLANK}]"
INJECTION_PATTERNS = (
    rf"игнорируй{_S}+(все{_S}+)?предыдущ",
    rf"ignore{_S}+(all{_S}+)?previous{_S}+instructions",
    rf"disregard{_S}+(all{_S}+)?(previous|above)",
    rf"{NOT_WORD_BEFORE}system{_S}*:",
    r"<\|im_start\|>|<\|system\|>",
    rf"reveal{_S}+your{_S}+(prompt|instructions)",
    rf"ты{_S}+теперь{_S}+(должен|обязан)",
    rf"нов[ые]{_S}+инструкции:",
    rf"укажи{_S}+цену{_S}+\p{{Nd}}",
)
OUTPUT_MARKERS = ("1 рубль", "1 руб.", "promo@spammlot.example")
_FLAGS = "(?iu)"


def injection_reason(text: Column) -> Column:
    """``regex: '<match>'`` of the first pattern that hits, else NULL.

    Clean texts are read once, by the alternation of all patterns.
    """
    hits = [F.nullif(F.regexp_extract(text, _FLAGS + p, 0), F.lit("")) for p in INJECTION_PATTERNS]
    match = F.coalesce(*hits)
    for char, escaped in (("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r"), ("\u00a0", "\\xa0")):
        match = F.replace(match, F.lit(char), F.lit(escaped))
    any_hit = text.rlike(_FLAGS + "|".join(f"(?:{p})" for p in INJECTION_PATTERNS))
    return F.when(any_hit, F.concat(F.lit("regex: '"), match, F.lit("'")))


def output_marker_issues(card_json: Column) -> Column:
    """Injection traces found in a card, as messages."""
    found = F.filter(
        F.array(*[F.lit(m) for m in OUTPUT_MARKERS]), lambda m: F.contains(card_json, m)
    )
    return F.transform(found, lambda m: F.concat(F.lit("injection trace in card: "), m))
