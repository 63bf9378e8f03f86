"""The gate between JSON text and the card contract, in VARIANT expressions.

Only types are judged here: what is absent gets its default later, what is there must
have its type. Strings are never made of numbers; numbers may be written as strings;
fields that the contract does not know are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomdex.functions.binding import let
from loomdex.schemas import CARD, SOURCE

NUMBERS = "^(BIGINT|DOUBLE|FLOAT|BOOLEAN|DECIMAL.*)$"


def _at(value: Column, path: str) -> Column:
    """The part of a VARIANT at a path; NULL where it is absent (JSON null is no NULL)."""
    return F.try_variant_get(value, path, "variant")


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _is_string(value: Column) -> Column:
    return _kind(value) == "STRING"


def _number(value: Column, kind: str) -> Column:
    """A number, or the number that a string spells; NULL for neither."""
    spelt = F.trim(F.try_variant_get(value, "$", "string")).try_cast(kind)
    return F.when(_kind(value).rlike(NUMBERS), F.try_variant_get(value, "$", kind)).when(_is_string(value), spelt)


def _whole(value: Column) -> Column:
    number = _number(value, "double")
    return number == F.floor(number)


def _strings(value: Column) -> Column:
    """Whether a VARIANT is an array of strings."""
    items = F.try_variant_get(value, "$", "array<variant>")
    return _kind(value).startswith("ARRAY") & F.forall(items, _is_string)


def _values(value: Column) -> Column:
    """Whether a VARIANT is an object of strings."""
    values = F.map_values(F.try_variant_get(value, "$", "map<string,variant>"))
    return _kind(value).startswith("OBJECT") & F.forall(values, _is_string)


def _wrong(value: Column, fits: Column) -> Column:
    """Present, and not fitting."""
    return value.isNotNull() & ~F.coalesce(fits, F.lit(False))


def _nullable(value: Column, fits: Column) -> Column:
    return (_kind(value) == "VOID") | fits


def _source_fits(source: Column) -> Column:
    chunk, doc, page, score = (_at(source, f"$.{name}") for name in ("chunk_id", "doc_id", "page", "score"))
    broken = (
        ~F.coalesce(_is_string(chunk), F.lit(False))
        | _wrong(doc, _is_string(doc))
        | _wrong(page, _nullable(page, _whole(page)))
        | _wrong(score, _nullable(score, _number(score, "double").isNotNull()))
    )
    return _kind(source).startswith("OBJECT") & ~broken


def _source(source: Column) -> Column:
    text = lambda name: F.try_variant_get(source, f"$.{name}", "string")
    return F.struct(
        text("chunk_id").alias("chunk_id"),
        text("doc_id").alias("doc_id"),
        _number(_at(source, "$.page"), "double").cast("int").alias("page"),
        _number(_at(source, "$.score"), "double").alias("score"),
    ).cast(SOURCE)


def read_card(text: Column) -> Column:
    """``STRUCT<card, type_errors>`` of JSON text: a card with NULL for what is absent, and
    a message for each field of a wrong type (then the card is not to be used). The text
    is parsed once, however many parts are asked of it."""
    return let(F.try_parse_json(text), lambda value: _judged(text, value))


def _judged(text: Column, value: Column) -> Column:
    field = {name: _at(value, f"$.{name}") for name in ("title", "description", "characteristics", "benefits", "seo", "sources", "missing_fields", "confidence")}
    seo = {name: _at(value, f"$.seo.{name}") for name in ("title", "description", "keywords")}
    sources = F.try_variant_get(field["sources"], "$", "array<variant>")
    confidence = _number(field["confidence"], "double")
    rules = [
        (text.isNotNull() & value.isNull(), "the answer is no valid JSON"),
        (value.isNotNull() & ~_kind(value).startswith("OBJECT"), "the answer is no JSON object"),
        (_wrong(field["title"], _is_string(field["title"])), "title is no string"),
        (_wrong(field["description"], _is_string(field["description"])), "description is no string"),
        (_wrong(field["characteristics"], _values(field["characteristics"])), "characteristics is no object of strings"),
        (_wrong(field["benefits"], _strings(field["benefits"])), "benefits is no list of strings"),
        (_wrong(field["seo"], _kind(field["seo"]).startswith("OBJECT")), "seo is no object"),
        (_wrong(seo["title"], _is_string(seo["title"])), "seo.title is no string"),
        (_wrong(seo["description"], _is_string(seo["description"])), "seo.description is no string"),
        (_wrong(seo["keywords"], _strings(seo["keywords"])), "seo.keywords is no list of strings"),
        (_wrong(field["sources"], _kind(field["sources"]).startswith("ARRAY") & F.forall(sources, _source_fits)), "sources is no list of sources"),
        (_wrong(field["missing_fields"], _strings(field["missing_fields"])), "missing_fields is no list of strings"),
        (_wrong(field["confidence"], confidence.isNotNull()), "confidence is no number"),
    ]
    get = lambda path, kind: F.try_variant_get(value, path, kind)
    card = F.struct(
        get("$.title", "string").alias("title"),
        get("$.description", "string").alias("description"),
        get("$.characteristics", "map<string,string>").alias("characteristics"),
        get("$.benefits", "array<string>").alias("benefits"),
        F.struct(
            get("$.seo.title", "string").alias("title"),
            get("$.seo.description", "string").alias("description"),
            get("$.seo.keywords", "array<string>").alias("keywords"),
        ).alias("seo"),
        F.transform(sources, _source).alias("sources"),
        get("$.missing_fields", "array<string>").alias("missing_fields"),
        confidence.alias("confidence"),
    ).cast(CARD)
    errors = F.array_compact(F.array(*[F.when(broken, F.lit(message)) for broken, message in rules]))
    return F.struct(F.when(value.isNotNull(), card).alias("card"), errors.alias("type_errors"))
