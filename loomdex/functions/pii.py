"""Masking of personal data with numbered placeholders, inside the JVM.

A pattern cuts the text into segments and matches; the matches that pass their
check become ``[KIND_n]``, the others stay, and the parts are joined again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomdex.functions.binding import let
from loomdex.functions.text import NOT_WORD_AFTER, NOT_WORD_BEFORE

# Patterns, in the order they apply, and checksum weights.
BLANK = r"\s\x0B\x1C-\x1F\x85\p{Z}"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = rf"(?:\+7|8)[{BLANK}(-]*[0-9]{{3}}[{BLANK})-]*[0-9]{{3}}[{BLANK}-]?[0-9]{{2}}[{BLANK}-]?[0-9]{{2}}"
INN = (
    rf"{NOT_WORD_BEFORE}[0-9]{{10}}{NOT_WORD_AFTER}|{NOT_WORD_BEFORE}[0-9]{{12}}{NOT_WORD_AFTER}"
)
CARD = rf"{NOT_WORD_BEFORE}[0-9](?:[ -]?[0-9]){{12,18}}{NOT_WORD_AFTER}"
INN10_WEIGHTS = (2, 4, 10, 3, 5, 9, 4, 6, 8)
INN11_WEIGHTS = (7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
INN12_WEIGHTS = (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
EAN13_WEIGHTS = (1, 3) * 6
CARD_LENGTHS = (13, 16, 19)
KINDS = ("email", "phone", "inn", "card")

# Without this there is no match: a scan for it costs less than the pattern's.
NEEDED = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "phone": lambda t: t.rlike("[0-9]{3}"),
    "inn": lambda t: t.rlike("[0-9]{10}"),
    "card": lambda t: t.rlike("[0-9](?:[ -]?[0-9]){12}"),
}


def _digit(digits: Column, position: int) -> Column:
    return F.substring(digits, position, 1).cast("int")


def _weighted(digits: Column, weights: tuple[int, ...]) -> Column:
    total = F.lit(0)
    for position, weight in enumerate(weights, start=1):
        total = total + F.lit(weight) * _digit(digits, position)
    return total


def inn_valid(digits: Column) -> Column:
    """Tax number checksum for 10 and 12 digits."""
    ten = _weighted(digits, INN10_WEIGHTS) % 11 % 10 == _digit(digits, 10)
    twelve = (_weighted(digits, INN11_WEIGHTS) % 11 % 10 == _digit(digits, 11)) & (
        _weighted(digits, INN12_WEIGHTS) % 11 % 10 == _digit(digits, 12)
    )
    length = F.char_length(digits)
    return F.when(length == 10, ten).when(length == 12, twelve).otherwise(F.lit(False))


def ean13_valid(digits: Column) -> Column:
    """Product barcode checksum."""
    expected = (10 - _weighted(digits, EAN13_WEIGHTS) % 10) % 10
    return F.when(F.char_length(digits) == 13, expected == _digit(digits, 13)).otherwise(
        F.lit(False)
    )


def card_valid(match: Column) -> Column:
    """Payment card: a card length, Luhn-valid, and not a product barcode."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    return (
        F.char_length(digits).isin(*CARD_LENGTHS) & ~ean13_valid(digits) & F.call_function("luhn_check", digits)
    )


def _mask_kind(
    text: Column, pattern: str, kind: str, accept: Callable[[Column], Column] | None
) -> Column:
    """STRUCT<text, n> after replacing one kind."""

    def rebuild(segments: Column, matches: Column, accepted: Column) -> Column:
        # Every match with the text after it; between two accepted ones lies one
        # slice, so the number of a placeholder is the number of its slice.
        pairs = F.arrays_zip(matches.alias("match"), F.slice(segments, F.lit(2), F.size(matches)).alias("after"))
        at = F.filter(F.sequence(F.lit(0), F.size(matches) - 1), lambda i: F.get(accepted, i))

        def plain(start: Column, stop: Column, rows: Column) -> Column:
            return F.array_join(F.transform(F.slice(rows, start + 1, stop - start), lambda x: F.concat(x["match"], x["after"])), "")

        def joined(rows: Column, hits: Column) -> Column:
            def piece(i: Column, k: Column) -> Column:
                placeholder = F.concat(F.lit(f"[{kind.upper()}_"), (k + 1).cast("string"), F.lit("]"))
                stop = F.coalesce(F.get(hits, k + 1), F.size(rows))
                return F.concat(placeholder, F.get(rows, i)["after"], plain(i + 1, stop, rows))

            first = F.coalesce(F.get(hits, F.lit(0)), F.size(rows))
            head = F.concat(F.get(segments, F.lit(0)), plain(F.lit(0), first, rows))
            return F.struct(
                F.concat(head, F.array_join(F.transform(hits, piece), "")).alias("text"), F.size(hits).alias("n")
            )

        return let(pairs, lambda rows: let(at, lambda hits: joined(rows, hits)))

    def replace(t: Column) -> Column:
        unchanged = F.struct(t.alias("text"), F.lit(0).alias("n"))

        def with_matches(matches: Column) -> Column:
            accepted = F.transform(matches, accept if accept else lambda m: F.lit(True))
            masked = rebuild(F.split(t, pattern, -1), matches, accepted)
            return F.when(F.size(matches) == 0, unchanged).otherwise(masked)

        found = let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), with_matches)
        return F.when(NEEDED[kind](t), found).otherwise(unchanged)

    return let(text, replace)


def mask_pii(text: Column) -> Column:
    """STRUCT<text, n_email, n_phone, n_inn, n_card> of one text.

    Numbering restarts per text; the originals are not kept.
    """

    def then(state: Column, pattern: str, kind: str, accept=None) -> Column:
        def step(s: Column) -> Column:
            done = [s[f"n_{k}"].alias(f"n_{k}") for k in KINDS[: KINDS.index(kind)]]
            return let(
                _mask_kind(s["text"], pattern, kind, accept),
                lambda r: F.struct(r["text"].alias("text"), *done, r["n"].alias(f"n_{kind}")),
            )

        return let(state, step)

    state = F.struct(text.alias("text"))
    state = then(state, EMAIL, "email")
    state = then(state, PHONE, "phone")
    state = then(state, INN, "inn", inn_valid)
    return then(state, CARD, "card", card_valid)


def pii_count(masked: Column) -> Column:
    return masked["n_email"] + masked["n_phone"] + masked["n_inn"] + masked["n_card"]
