"""Office files made from given rows and read back."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomdex.catalog import query
from loomdex.operators.local_best import slices
from loomdex.plans.ingest import parse_files, to_blocks
from loomdex.session import durable, read_table
from loomdex.sources.parsers import R, S, SHEET_SECTION, W

# The smallest packages of parts that office programs open.
_NAMES = {"w": W.strip("{}"), "s": S.strip("{}"), "r": R.strip("{}")}
TURNS_PER_SHEET = 256
# Files that a task holds at once.
FILES_AT_ONCE = 64
_PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"


def _packed(parts: dict[str, str]) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, xml in parts.items():
            archive.writestr(name, xml)
    return buffer.getvalue()


def docx_of(text: str) -> bytes:
    """One paragraph for each line; the first one is a heading."""
    styles = ['<w:pPr><w:pStyle w:val="h1"/></w:pPr>'] + [""] * text.count("\n")
    paragraphs = (
        f'<w:p>{style}<w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>'
        for style, line in zip(styles, text.split("\n"), strict=True)
    )
    space = f'xmlns:w="{_NAMES["w"]}"'
    return _packed(
        {
            "word/document.xml": f"<w:document {space}><w:body>{''.join(paragraphs)}</w:body></w:document>",
            "word/styles.xml": f'<w:styles {space}><w:style w:styleId="h1"><w:name w:val="heading 1"/></w:style></w:styles>',
        }
    )


def xlsx_of(rows: list[list[str]]) -> bytes:
    """One sheet of text cells."""
    lines = (
        "<row>" + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(cell)}</t></is></c>' for cell in row) + "</row>" for row in rows
    )
    main = f'xmlns="{_NAMES["s"]}"'
    return _packed(
        {
            "xl/workbook.xml": f'<workbook {main} xmlns:r="{_NAMES["r"]}"><sheets><sheet name="a" sheetId="1" r:id="x1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}"><Relationship Id="x1" Target="worksheets/a.xml"/></Relationships>',
            "xl/worksheets/a.xml": f"<worksheet {main}><sheetData>{''.join(lines)}</sheetData></worksheet>",
        }
    )


def _made(rows: DataFrame, kind: str, make: Callable) -> DataFrame:
    """``(doc_id, kind, content)`` out of (doc_id, body), a few rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, FILES_AT_ONCE):
            contents = [make(b) for b in batch.column("body").to_pylist()]
            columns = [batch.column("doc_id"), pa.repeat(pa.scalar(kind), batch.num_rows), pa.array(contents, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "kind", "content"])

    return rows.mapInArrow(run, "doc_id STRING, kind STRING, content BINARY")


_TRIM = r"regexp_replace(line, '^\s+|\s+$', '', 'g')"


@query(
    f"""WITH lines AS (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
    kept AS (SELECT doc_id, n, {_TRIM} AS line FROM lines WHERE {_TRIM} <> '')
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS position, md5(line) AS content_md5,
      md5(coalesce(max(CASE WHEN n = 1 THEN line END) OVER (PARTITION BY doc_id), '')) AS section_md5 FROM kept"""
)
def docx_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a docx file with a heading, parsed into blocks."""
    rows = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("body"))
    blocks = to_blocks(parse_files(_made(rows, "docx", docx_of)))
    return blocks.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("block_no.position").cast("long").alias("position"),
        F.md5("content").alias("content_md5"),
        F.md5("section").alias("section_md5"),
    )


@query(
    """SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS part,
      md5(turn || ': Артикул: ' || turn || '; role: ' || role || CASE WHEN trim(text) <> '' THEN '; text: ' || regexp_replace(text, '^\\s+|\\s+$', '', 'g') ELSE '' END) AS content_md5,
      'Спецификация' AS section
    FROM conversations"""
)
def xlsx_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as sheets of turns, parsed into lines of a specification."""
    return sheets_of_turns(read_table(spark, sf_dir, "conversations"))


def sheets_of_turns(turns: DataFrame, turns_per_sheet: int = TURNS_PER_SHEET) -> DataFrame:
    """One sheet for the turns of a conversation whose numbers fall into one step of
    ``turns_per_sheet``, so that a long conversation is many small files. Parts are
    numbered through the conversation: by the parts of a sheet plus those of the sheets
    before it (a window over one short row a sheet)."""
    row = F.array(F.col("turn").cast("string"), "role", "text")
    header = F.array(F.array(F.lit("Артикул"), F.lit("role"), F.lit("text")))
    sorted_rows = F.transform(F.sort_array(F.collect_list(F.struct("turn", row.alias("cells")))), lambda x: x["cells"])
    # A turn without number comes first. The sheet's name is its step and the conversation, if there is one.
    step = F.coalesce(F.floor(F.col("turn") / turns_per_sheet), F.lit(-(1 << 62)))
    name = F.concat_ws("/", step.cast("string"), F.col("conv_id").cast("string"))
    rows = turns.groupBy(name.alias("doc_id")).agg(F.concat(header, sorted_rows).alias("body"))
    blocks = to_blocks(parse_files(_made(rows, "xlsx", xlsx_of)))
    named = F.split("doc_id", "/")
    parts = durable(
        blocks.filter(F.col("section") == SHEET_SECTION).select(
            F.get(named, F.lit(1)).cast("long").alias("doc_id"),
            F.get(named, F.lit(0)).cast("long").alias("step"),
            F.col("block_no.part").cast("long").alias("part"),
            F.md5("content").alias("content_md5"),
            "section",
        )
    )
    sheets = parts.groupBy("doc_id", "step").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("doc_id").orderBy("step")) - F.col("n")
    sheets = sheets.select(F.col("doc_id").alias("id"), F.col("step").alias("at"), before.alias("before"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("step") == F.col("at"))
    return parts.join(sheets, same).select("doc_id", (F.col("part") + F.col("before")).alias("part"), "content_md5", "section")
