"""JSON objects out of untidy model answers."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Signs of a Python literal instead of JSON.
LITERAL_SIGNS = ("='", "'=", "={'", "= '")


def _load_object(text: str, loader) -> dict | None:
    try:
        value = loader(text)
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def repair_object(answer: str | None) -> dict | None:
    """The object in an answer: plain, fenced, wrapped in prose, or a literal."""
    text = (answer or "").strip()
    if text.startswith("```"):
        text = text[text.find("\n") + 1 :]
        closing = text.rfind("```")
        text = (text[:closing] if closing >= 0 else text).strip()
    first, last = text.find("{"), text.rfind("}")
    inner = text[first : last + 1] if 0 <= first < last else None
    candidates = [(text, json.loads), (inner, json.loads)]
    if any(sign in text for sign in LITERAL_SIGNS):
        candidates += [(inner, ast.literal_eval), ("{" + text + "}", ast.literal_eval)]
    for candidate, loader in candidates:
        found = _load_object(candidate, loader) if candidate else None
        if found is not None:
            return found
    return None


@F.pandas_udf(T.StringType())
def repaired_json(answers: pd.Series) -> pd.Series:
    """Canonical JSON text of the object, NULL where there is none.

    In Python because the JVM parsers accept trailing text, and because of the
    literal branch; it only ever reads model answers.
    """

    def one(answer):
        found = repair_object(answer)
        return None if found is None else json.dumps(found, ensure_ascii=False)

    return answers.map(one)
