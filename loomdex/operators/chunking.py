"""Blocks -> overlapping text chunks and row-preserving table chunks."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdex.functions.text import BRANDS, articul, brand
from loomdex.settings import DEFAULTS, Settings

# Fixed value: mark of a repeated first line in a split table.
HEADER_MARK = "[шапка] "


def window_spans(length: int, spaces: list[int], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Spans of the windows of a text. An inner window ends at the last of its
    ``spaces`` (sorted positions) that lies in its second half, if there is one,
    and the next window reaches ``overlap`` back from there."""
    first = 0
    while first + size < length:
        at = bisect_left(spaces, first + size) - 1
        least = first + max(size // 2, 1)
        last = spaces[at] if at >= 0 and spaces[at] >= least else first + size
        yield first, last
        first = last - overlap
    yield first, length


def text_windows(text: str, size: int, overlap: int) -> list[str]:
    """Overlapping windows of ``size`` characters, trimmed; a text that fits stays whole."""
    if len(text) <= size:
        return [text] if text else []
    spaces = [found.start() for found in re.finditer(" ", text)]
    spans = window_spans(len(text), spaces, size, overlap)
    return [piece for first, last in spans if (piece := text[first:last].strip())]


def table_pieces(text: str, size: int) -> list[str]:
    """Whole lines packed up to ``size`` characters (line breaks not counted).

    A piece that would follow one not starting with the first line's key is
    opened with a marked copy of the first line, which counts as that line. Where
    a piece ends is looked up in the prefix sums of the line lengths.
    """
    lines = text.split("\n") if text else []
    upto = list(accumulate(map(len, lines), initial=0))
    pieces: list[str] = []
    done = 0
    while done < len(lines):
        key = lines[0].partition(":")[0]
        opened = bool(pieces and lines[0]) and not pieces[-1].startswith(key)
        room = size - len(lines[0]) * opened
        stop = max(done + 1, bisect_right(upto, upto[done] + room) - 1)
        pieces.append("\n".join([HEADER_MARK + lines[0]] * opened + lines[done:stop]))
        done = stop
    return pieces


def cut_blocks(blocks: DataFrame, size: int, overlap: int) -> DataFrame:
    """Blocks with ``pieces`` ARRAY<STRING> in place of kind and content.

    Each window depends on the end of the one before, so this is a small helper
    on Arrow batches, linear in the text length.
    """
    kept = ["doc_id", "page", "block_no", "section"]
    source = blocks.select(*kept, "kind", "content")
    schema = T.StructType(
        [*[source.schema[c] for c in kept], T.StructField("pieces", T.ArrayType(T.StringType()))]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, contents = batch.column("kind").to_pylist(), batch.column("content").to_pylist()
            cut_rows = [
                table_pieces(c, size) if k == "table" else text_windows(c, size, overlap)
                for k, c in zip(kinds, contents, strict=True)
            ]
            pieces = pa.array(cut_rows, type=pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept] + [pieces], names=[*kept, "pieces"]
            )

    return source.mapInArrow(cut, schema)


def chunk_id(doc_id: Column, ordinal: Column) -> Column:
    """Stable identifier, so that a recomputed task yields the same chunks."""
    key = F.concat_ws("|", doc_id.cast("string"), ordinal.cast("string"))
    return F.substring(F.sha2(key, 256), 1, 12)


def chunk_metadata(
    doc_id: Column, page: Column, section: Column, text: Column, brands: tuple[str, ...] = BRANDS
) -> Column:
    return F.struct(
        doc_id.alias("doc_id"),
        page.alias("page"),
        F.coalesce(section, F.lit("")).alias("section"),
        articul(text).alias("articul"),
        brand(text, brands).alias("brand"),
    )


def chunk_blocks(
    blocks: DataFrame, settings: Settings = DEFAULTS, brands: tuple[str, ...] = BRANDS
) -> DataFrame:
    """``chunk_id, doc_id, ordinal, text, metadata`` of normalised blocks.

    The ordinal runs over all chunks of a document in block order: the piece
    number plus the pieces of the blocks before. This is the only shuffle, by
    document; the upload limit bounds what one document can hold.
    """
    cut = cut_blocks(blocks, settings.chunk_size, settings.chunk_overlap)
    order = Window.partitionBy("doc_id").orderBy("page", "block_no")
    before = F.sum(F.size("pieces")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    numbered = cut.withColumn("before", F.coalesce(before, F.lit(0)))
    exploded = numbered.select(
        "doc_id", "page", "section", "before", F.posexplode("pieces").alias("piece", "text")
    )
    ordinal = (F.col("before") + F.col("piece")).cast("int")
    return exploded.select(
        chunk_id(F.col("doc_id"), ordinal).alias("chunk_id"),
        "doc_id",
        ordinal.alias("ordinal"),
        "text",
        chunk_metadata(
            F.col("doc_id"), F.col("page"), F.col("section"), F.col("text"), brands
        ).alias("metadata"),
    )
