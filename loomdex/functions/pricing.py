"""Price table and the cost of a call."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdex.functions.text import price_key

# Variable names that carry prices per million tokens.
PRICE_VARIABLE = re.compile(r"^PRICE_(?P<key>[A-Z0-9_]+)_(?P<side>INPUT|OUTPUT)$")
DEFAULT_KEY = "default"
SIDES = ("input", "output")


def prices_from_variables(*sources: Mapping[str, str | None]) -> dict[str, dict[str, float]]:
    """Price table from settings; a later source wins, a missing side is zero."""
    named = ((PRICE_VARIABLE.match(name), value) for source in sources for name, value in source.items())
    given = {
        (found["key"].lower(), found["side"].lower()): float(value)
        for found, value in named
        if found and str("" if value is None else value).strip()
    }
    models = sorted({DEFAULT_KEY, *(model for model, _ in given)})
    return {model: {side: given.get((model, side), 0.0) for side in SIDES} for model in models}


def _price_of(model: Column, prices: Mapping[str, Mapping[str, float]], side: str) -> Column:
    known = F.create_map(
        *[x for key, p in prices.items() for x in (F.lit(key), F.lit(p[side]).cast("decimal(18,6)"))]
    )
    default = prices.get(DEFAULT_KEY, dict.fromkeys(SIDES, 0.0))[side]
    return F.coalesce(F.try_element_at(known, price_key(model)), F.lit(default).cast("decimal(18,6)"))


def call_cost(
    model: Column,
    prompt_tokens: Column,
    completion_tokens: Column,
    prices: Mapping[str, Mapping[str, float]],
) -> Column:
    """DECIMAL(10,6) cost, rounded half to even; unknown models use the default price.

    The table is a few settings, so it is a literal map. The model name is
    normalised on lookup, so names with ``/``, ``.`` and ``-`` find their price.
    """
    total = F.lit(0).cast("decimal(38,6)")
    for tokens, side in ((prompt_tokens, "input"), (completion_tokens, "output")):
        count = F.coalesce(tokens, F.lit(0)).cast("decimal(12,0)")
        total = total + (count * _price_of(model, prices, side))
    per_million = total.cast("decimal(30,6)") * F.lit("0.000001").cast("decimal(6,6)")
    return F.bround(per_million, 6).cast(T.DecimalType(10, 6))
