"""The first name of a long list that a text contains, by one automaton for all names."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of all names of a list; tasks hold an automaton of about 50 bytes for each.
MOST_CHARACTERS = 20_000_000


def first_in_list(texts: DataFrame, names: DataFrame, text: str = "text", found: str = "brand") -> DataFrame:
    """``texts`` with ``found``: of the ``names`` (name, place) that the text contains,
    that of least place, then least name; NULL for none.

    One pass over each text, whatever the length of the list (an Aho-Corasick automaton,
    built once in a Python worker from the broadcast list). A list of a few names
    is cheaper as ``functions.text.brand``. A list above ``MOST_CHARACTERS`` is an error.
    """
    listed = names.filter("name <> ''").groupBy("name").agg(F.min("place").alias("place"))
    size = listed.agg(F.sum(F.char_length("name"))).first()[0] or 0
    if size > MOST_CHARACTERS:
        raise ValueError(f"the list has {size} characters, more than {MOST_CHARACTERS}")
    ordered = [r["name"] for r in listed.orderBy("place", "name").select("name").toLocalIterator()]
    shipped = texts.sparkSession.sparkContext.broadcast(ordered)
    schema = T.StructType([*texts.schema.fields, T.StructField(found, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for place, name in enumerate(shipped.value):
            automaton.add_word(name, place)
        automaton.make_automaton()

        def first(value: str | None) -> str | None:
            if value is None or not len(automaton):
                return None
            place = min((p for _, p in automaton.iter(value)), default=None)
            return None if place is None else shipped.value[place]

        for batch in batches:
            brands = [first(x) for x in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(brands, pa.string())], [*batch.schema.names, found])

    return texts.mapInArrow(run, schema)
