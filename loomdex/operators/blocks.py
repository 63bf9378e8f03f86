"""Blocks of a parsed document: paragraphs, tables, repeated lines, cleaning.

A block row is ``doc_id, block_no, kind, content, page, section`` (and ``rows``
for tables); ``block_no`` carries the document order a table does not have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.functions.binding import let
from loomdex.functions.text import (
    clean_text,
    cleans_to_nothing,
    heading,
    line_template,
    paragraphs,
    strip,
)

# Header words that mark a two-column parameter table.
PARAMETER_HEADERS = ("параметр", "характеристика")

# Fixed value: the key column of a specification sheet.
SHEET_KEY = "Артикул"


def text_blocks(pages: DataFrame) -> DataFrame:
    """``(doc_id, page, text)`` -> one text block per paragraph; a heading names
    the section of its own block only."""
    exploded = pages.select(
        "doc_id", "page", F.posexplode(paragraphs(F.col("text"))).alias("block_no", "content")
    )
    return exploded.select(
        "doc_id",
        "page",
        "block_no",
        F.lit("text").alias("kind"),
        "content",
        heading(F.col("content")).alias("section"),
    )


def sheet_lines(rows: Column) -> Column:
    """ARRAY of texts, one for each row below the header: ``key: value; ...`` of the
    filled cells under a named column (of columns with the same name the last filled
    one counts, at the first one's place), opened by the key column's value."""

    def line(header: Column, row: Column) -> Column:
        at = F.filter(
            F.sequence(F.lit(0), F.least(F.size(header), F.size(row)) - 1),
            lambda i: (F.get(header, i) != "") & (F.get(row, i) != ""),
        )
        names = F.array_distinct(F.transform(at, lambda i: F.get(header, i)))

        def value(name: Column) -> Column:
            return F.get(row, F.array_max(F.filter(at, lambda i: F.get(header, i) == name)))

        pairs = F.array_join(F.transform(names, lambda n: F.concat(n, F.lit(": "), value(n))), "; ")
        article = F.when(F.array_contains(names, SHEET_KEY), F.concat(value(F.lit(SHEET_KEY)), F.lit(": ")))
        return F.concat(F.coalesce(article, F.lit("")), pairs)

    return F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda row: line(F.get(rows, F.lit(0)), row))


def table_text(rows: Column) -> Column:
    """Table rows (ARRAY<ARRAY<STRING>>) as lines; the first row is the header.

    A parameter table gives ``key: value``, any other ``header=value; ...``
    without empty cells.
    """

    def line(header: Column, row: Column) -> Column:
        width = F.least(F.size(header), F.size(row))
        cells = F.transform(
            F.filter(F.sequence(F.lit(0), width - 1), lambda i: F.get(row, i) != ""),
            lambda i: F.concat(F.get(header, i), F.lit("="), F.get(row, i)),
        )
        return F.when(width > 0, F.array_join(cells, "; ")).otherwise(F.lit(""))

    def lines(header: Column) -> Column:
        body = F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))
        is_parameters = (F.size(header) == 2) & F.lower(F.get(header, 0)).isin(*PARAMETER_HEADERS)
        return F.array_join(
            F.transform(
                body,
                lambda row: F.when(
                    is_parameters,
                    F.concat(F.get(row, 0), F.lit(": "), F.coalesce(F.get(row, 1), F.lit(""))),
                ).otherwise(line(header, row)),
            ),
            "\n",
        )

    return F.when(F.size(rows) > 0, let(F.get(rows, 0), lines)).otherwise(F.lit(""))


def repeated_templates(blocks: DataFrame, min_pages: int | None = None) -> DataFrame:
    """``(doc_id, template, pages)``: line templates of text blocks on many pages.

    Without ``min_pages`` a template must occur on every page of a document of at
    least two; tables count as pages too. Counting is two levels of aggregation
    with a map-side combine, so a document or line that dominates is spread out.
    """
    lines = blocks.filter(F.col("kind") == "text").select(
        "doc_id", "page", F.explode(F.split("content", "\n", -1)).alias("line")
    )
    on_pages = (
        lines.select("doc_id", "page", line_template(F.col("line")).alias("template"))
        .filter(F.col("template") != "")
        .distinct()
        .groupBy("doc_id", "template")
        .agg(F.count("*").alias("pages"))
    )
    if min_pages is not None:
        return on_pages.filter(F.col("pages") >= min_pages)
    doc_pages = blocks.groupBy("doc_id").agg(F.count_distinct("page").alias("doc_pages"))
    several = doc_pages.filter(F.col("doc_pages") >= 2)
    repeated = on_pages.filter(F.col("pages") >= 2).join(several, "doc_id")
    return repeated.filter(F.col("pages") == F.col("doc_pages")).drop("doc_pages")


def strip_footers(blocks: DataFrame) -> DataFrame:
    """Remove lines repeated on every page from text blocks; drop emptied blocks.

    The footers of a document fit in one row, because each occurs on its
    shortest page, so the lines are filtered in place and never regrouped.
    """
    footers = repeated_templates(blocks).groupBy("doc_id").agg(
        F.collect_list("template").alias("footers")
    )
    kept = F.filter(
        F.split("content", "\n", -1),
        lambda line: ~F.array_contains("footers", line_template(line)),
    )
    is_stripped = F.col("footers").isNotNull() & (F.col("kind") == "text")
    return (
        blocks.join(footers, "doc_id", "left")
        .withColumn(
            "content",
            F.when(is_stripped, strip(F.array_join(kept, "\n"))).otherwise(F.col("content")),
        )
        .filter(~is_stripped | (F.col("content") != ""))
        .drop("footers")
    )


def normalize_blocks(blocks: DataFrame) -> DataFrame:
    """Footers out, text cleaned, empty blocks dropped."""
    # Asked of the raw text, so that cleaning runs once and only on kept blocks.
    kept = strip_footers(blocks).filter(~cleans_to_nothing(F.col("content")))
    return kept.withColumn("content", clean_text(F.col("content")))
