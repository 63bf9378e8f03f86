"""Ingestion, chunking, context and document-state queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.catalog import query
from loomdex.catalog.base import document_table, with_ctes
from loomdex.functions import text as tx
from loomdex.operators import blocks as bl
from loomdex.operators import chunking, state
from loomdex.operators.context import build_context, chunk_body, context_chunk_ids, pack_order
from loomdex.operators.dictionary import first_in_list
from loomdex.operators.ordinals import group_ordinals
from loomdex.plans.ingest import chunk_raw_blocks
from loomdex.plans.retrieval import Corpus, chunks_by_ids, chunks_of_documents
from loomdex.session import read_table, scratch_folder
from loomdex.settings import DEFAULTS
from loomdex.sources.files import classify_uploads
from loomdex.sources.versions import SlicedTable
from loomdex.streaming.registry import registered, start_registry, upload_facts

# SQL spelling of the shared text expressions.
SPACE_SQL = "[\\s\\x0B\\x1C-\\x1F\\x{85}\\p{Z}]"


def strip_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{SPACE_SQL}+', ''), '{SPACE_SQL}+$', '')"


def clean_sql(x: str) -> str:
    for code, plain in (
        (0xFB00, "ff"),
        (0xFB01, "fi"),
        (0xFB02, "fl"),
        (0xFB03, "ffi"),
        (0xFB04, "ffl"),
        (0xAD, ""),
        (0xA0, " "),
    ):
        x = f"replace({x}, chr({code}), '{plain}')"
    x = f"regexp_replace({x}, '([\\p{{L}}\\p{{N}}_])-\\n([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g')"
    x = f"regexp_replace({x}, '[ \\t]+', ' ', 'g')"
    x = f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return strip_sql(x)


TITLE_SQL = (
    "array_to_string(list_transform(regexp_extract_all({x}, '\\p{{L}}+|[^\\p{{L}}]+'), "
    "lambda r: upper(r[1]) || lower(r[2:])), '')"
)
HEADING_SQL = (
    "CASE WHEN {x} = upper({x}) AND {x} <> lower({x}) AND length({x}) > 3 AND length({x}) < 80 THEN "
    + TITLE_SQL
    + " WHEN length({x}) < 60 AND right({x}, 1) NOT IN ('.', ';', ',') "
    "AND length({x}) - length(replace({x}, ' ', '')) <= 6 THEN {x} ELSE '' END"
)

_PARAGRAPHS = (
    "paras AS (SELECT doc_id, list_filter(list_transform(string_split(replace(text, chr(10), chr(10) || chr(10)), "
    f"chr(10) || chr(10)), lambda p: {strip_sql('p')}), lambda p: p <> '') AS ps FROM documents), "
    "blocks AS (SELECT doc_id, generate_subscripts(ps, 1) - 1 AS block_no, unnest(ps) AS content FROM paras)"
)


def _line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as one page whose lines are paragraphs."""
    pages = read_table(spark, sf_dir, "documents").select(
        "doc_id",
        F.lit(1).alias("page"),
        F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"),
    )
    return bl.text_blocks(pages)


@query(
    f"WITH {_PARAGRAPHS} SELECT doc_id, block_no::BIGINT AS block_no, length(content) AS length, "
    f"md5(content) AS content_md5, {HEADING_SQL.format(x='content')} AS section FROM blocks"
)
def paragraph_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_blocks(spark, sf_dir).select(
        "doc_id",
        F.col("block_no").cast("long").alias("block_no"),
        F.char_length("content").cast("long").alias("length"),
        F.md5("content").alias("content_md5"),
        "section",
    )


@query(
    "SELECT l_orderkey AS doc_id, l_linenumber, 'Part=' || l_partkey || '; Quantity=' || l_quantity::BIGINT || "
    "CASE WHEN l_returnflag = 'N' THEN '' ELSE '; Returned=' || l_returnflag END AS content FROM lineitem"
)
def table_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line as a table of a header and one row; an empty cell is left out."""
    header = F.array(F.lit("Part"), F.lit("Quantity"), F.lit("Returned"))
    cells = F.array(
        F.col("l_partkey").cast("string"),
        F.col("l_quantity").cast("long").cast("string"),
        F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")),
    )
    return read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"),
        "l_linenumber",
        bl.table_text(F.array(header, cells)).alias("content"),
    )


def _parameter_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a two-column parameter table."""
    return read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), bl.table_text(_parameter_rows()).alias("content"))


def _parameter_rows() -> Column:
    names = ("p_name", "p_brand", "p_type", "p_size", "p_partkey")
    rows = [F.array(F.lit(n[2:].title()), F.col(n).cast("string")) for n in names]
    return F.array(F.array(F.lit("Параметр"), F.lit("Значение")), *rows)


_PARAMETERS_SQL = (
    "'Name: ' || p_name || chr(10) || 'Brand: ' || p_brand || chr(10) || 'Type: ' || p_type || chr(10) || "
    "'Size: ' || p_size || chr(10) || 'Partkey: ' || p_partkey"
)


@query(f"SELECT p_partkey AS doc_id, {_PARAMETERS_SQL} AS content FROM part")
def parameter_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parameter_tables(spark, sf_dir)


# Lines are packed one by one: a line opens a new piece when it does not fit. The
# first line comes back, marked, from the third piece on.
_PACK_LINES_SQL = f"""
RECURSIVE tables AS (SELECT p_partkey AS doc_id, string_split({_PARAMETERS_SQL}, chr(10)) AS ls FROM part),
packing AS (
  SELECT doc_id, ls, 1 AS line_no, 0 AS piece, length(ls[1]) AS used, ls[1] AS current, false AS opened FROM tables
  UNION ALL
  SELECT doc_id, ls, line_no + 1,
    CASE WHEN used + length(ls[line_no + 1]) > 40 THEN piece + 1 ELSE piece END,
    CASE WHEN used + length(ls[line_no + 1]) <= 40 THEN used + length(ls[line_no + 1])
         WHEN piece > 0 THEN length(ls[1]) + length(ls[line_no + 1]) ELSE length(ls[line_no + 1]) END,
    CASE WHEN used + length(ls[line_no + 1]) <= 40 THEN current || chr(10) || ls[line_no + 1]
         WHEN piece > 0 THEN '[шапка] ' || ls[1] || chr(10) || ls[line_no + 1] ELSE ls[line_no + 1] END,
    false
  FROM packing WHERE line_no < len(ls))"""


@query(
    f"WITH {_PACK_LINES_SQL} SELECT doc_id, piece::BIGINT AS ordinal, arg_max(current, line_no) AS content "
    "FROM packing GROUP BY doc_id, piece"
)
def table_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _parameter_tables(spark, sf_dir).select(
        "doc_id",
        F.lit(1).alias("page"),
        F.lit(0).alias("block_no"),
        F.lit("table").alias("kind"),
        "content",
        F.lit("").alias("section"),
    )
    return chunking.chunk_blocks(tables, replace(DEFAULTS, chunk_size=40)).select(
        "doc_id", F.col("ordinal").cast("long").alias("ordinal"), F.col("text").alias("content")
    )


@query(
    "WITH lines AS (SELECT source AS doc_id, doc_id AS page, unnest(string_split(text, chr(10))) AS line FROM documents), "
    f"templates AS (SELECT DISTINCT doc_id, page, regexp_replace({strip_sql('line')}, '\\p{{Nd}}+', '#', 'g') AS template FROM lines) "
    "SELECT doc_id, template, count(*) AS pages FROM templates WHERE template <> '' "
    "GROUP BY doc_id, template HAVING count(*) >= 2"
)
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line templates that several documents of one source share."""
    documents = read_table(spark, sf_dir, "documents").select(
        F.col("source").alias("doc_id"),
        F.col("doc_id").alias("page"),
        F.lit("text").alias("kind"),
        F.col("text").alias("content"),
    )
    return bl.repeated_templates(documents, min_pages=2)


_SITE_SQL = (
    "site AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS doc_id, page_id AS page, "
    "replace(html, '><', '>' || chr(10) || '<') AS content FROM pages), "
    "site_lines AS (SELECT doc_id, page, generate_subscripts(ls, 1) AS line_no, unnest(ls) AS line "
    "FROM (SELECT doc_id, page, string_split(content, chr(10)) AS ls FROM site)), "
    f"marked AS (SELECT *, regexp_replace({strip_sql('line')}, '\\p{{Nd}}+', '#', 'g') AS template FROM site_lines), "
    "doc_pages AS (SELECT doc_id, count(DISTINCT page) AS n FROM site GROUP BY doc_id), "
    "footers AS (SELECT m.doc_id, m.template FROM marked m JOIN doc_pages p ON p.doc_id = m.doc_id "
    "WHERE m.template <> '' AND p.n >= 2 GROUP BY m.doc_id, m.template, p.n HAVING count(DISTINCT m.page) = p.n), "
    "kept AS (SELECT m.doc_id, m.page, string_agg(m.line, chr(10) ORDER BY m.line_no) AS content FROM marked m "
    "WHERE NOT EXISTS (SELECT 1 FROM footers f WHERE f.doc_id = m.doc_id AND f.template = m.template) "
    "GROUP BY m.doc_id, m.page)"
)


@query(
    f"WITH {_SITE_SQL}, final AS (SELECT k.doc_id, k.page, CASE WHEN k.doc_id IN (SELECT doc_id FROM footers) "
    f"THEN {strip_sql('k.content')} ELSE k.content END AS content FROM kept k) "
    "SELECT doc_id, page, length(content) AS length, md5(content) AS content_md5 FROM final WHERE content <> ''"
)
def footer_stripping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a host without the markup lines that all its pages share."""
    site = read_table(spark, sf_dir, "pages").select(
        F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("doc_id"),
        F.col("page_id").alias("page"),
        F.lit("text").alias("kind"),
        F.replace("html", F.lit("><"), F.lit(">\n<")).alias("content"),
    )
    return bl.strip_footers(site).select(
        "doc_id",
        "page",
        F.char_length("content").cast("long").alias("length"),
        F.md5("content").alias("content_md5"),
    )


@query(
    f"WITH c AS (SELECT doc_id, {clean_sql('text')} AS content FROM documents) "
    "SELECT doc_id, length(content) AS length, md5(content) AS content_md5 FROM c"
)
def cleaned_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = read_table(spark, sf_dir, "documents").select(
        "doc_id", tx.clean_text(F.col("text")).alias("content")
    )
    return cleaned.select(
        "doc_id",
        F.char_length("content").cast("long").alias("length"),
        F.md5("content").alias("content_md5"),
    )


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of every document, taken as one cleaned block."""
    return chunks_of(read_table(spark, sf_dir, "documents"))


def chunks_of(documents: DataFrame) -> DataFrame:
    documents = documents.select(
        "doc_id",
        F.lit(1).alias("page"),
        F.lit(0).alias("block_no"),
        F.lit("text").alias("kind"),
        F.col("text").alias("content"),
        F.col("source").alias("section"),
    )
    kept = documents.filter(~tx.cleans_to_nothing(F.col("content")))
    return chunking.chunk_blocks(kept.withColumn("content", tx.clean_text(F.col("content"))))


CHUNK_CTES = (
    "RECURSIVE cleaned AS (SELECT doc_id, source, "
    + clean_sql("text")
    + " AS text FROM documents), "
    "windows AS (SELECT doc_id, 0::BIGINT AS start, text, length(text) AS n FROM cleaned WHERE text <> '' "
    "UNION ALL SELECT doc_id, stop - 120, text, n FROM (SELECT doc_id, text, n, CASE WHEN start + 700 < n AND "
    "strpos(substring(text, start + 351, 350), ' ') > 0 THEN start + 350 + 350 - "
    "strpos(reverse(substring(text, start + 351, 350)), ' ') ELSE start + 700 END AS stop FROM windows) WHERE stop < n), "
    "cut AS (SELECT doc_id, start, CASE WHEN n <= 700 THEN text ELSE "
    + strip_sql(
        "substring(text, start + 1, CASE WHEN start + 700 < n AND "
        "strpos(substring(text, start + 351, 350), ' ') > 0 THEN 700 - "
        "strpos(reverse(substring(text, start + 351, 350)), ' ') ELSE 700 END)"
    )
    + " END AS text FROM windows), "
    "numbered AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS ordinal, text "
    "FROM cut WHERE text <> ''), "
    "doc_chunks AS (SELECT substring(sha256(doc_id || '|' || ordinal), 1, 12) AS chunk_id, n.doc_id, "
    "c.source AS section, d.source || '_' || n.doc_id AS filename, n.ordinal, n.text "
    "FROM numbered n JOIN cleaned c USING (doc_id) JOIN documents d USING (doc_id))"
)
ARTICUL_SQL = "nullif(regexp_extract(text, '\\b[A-Z]{2,5}-[A-Z0-9]{2,6}\\b'), '')"


@query(
    f"WITH {CHUNK_CTES} SELECT chunk_id, doc_id, ordinal, length(text) AS length, md5(text) AS text_md5 FROM doc_chunks"
)
def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_chunks(spark, sf_dir).select(
        "chunk_id",
        "doc_id",
        F.col("ordinal").cast("long").alias("ordinal"),
        F.char_length("text").cast("long").alias("length"),
        F.md5("text").alias("text_md5"),
    )


@query(
    f"WITH {CHUNK_CTES} SELECT chunk_id, section, {ARTICUL_SQL} AS articul FROM doc_chunks"
)
def chunk_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_chunks(spark, sf_dir).select(
        "chunk_id", F.col("metadata.section").alias("section"), F.col("metadata.articul").alias("articul")
    )


# Pages to paragraphs, without the lines that all pages of a host share, cleaned; then
# the tables of the parts; then the windows of every block, numbered by document.
_NORMALISED_SQL = f"""
RECURSIVE site AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS doc_id, page_id AS page,
  replace(replace(html, '</p>', chr(10) || chr(10)), '><', '>' || chr(10) || '<') AS text FROM pages),
paras AS (SELECT doc_id, page, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: {strip_sql("p")}), lambda p: p <> '') AS ps FROM site),
raw_blocks AS (SELECT doc_id, page, generate_subscripts(ps, 1) - 1 AS part, unnest(ps) AS content FROM paras),
block_lines AS (SELECT doc_id, page, part, generate_subscripts(ls, 1) AS line_no, unnest(ls) AS line
  FROM (SELECT doc_id, page, part, string_split(content, chr(10)) AS ls FROM raw_blocks)),
marked AS (SELECT *, regexp_replace({strip_sql("line")}, '\\p{{Nd}}+', '#', 'g') AS template FROM block_lines),
doc_pages AS (SELECT doc_id, count(DISTINCT page) AS n FROM raw_blocks GROUP BY doc_id),
footers AS (SELECT m.doc_id, m.template FROM marked m JOIN doc_pages p ON p.doc_id = m.doc_id
  WHERE m.template <> '' AND p.n >= 2 GROUP BY m.doc_id, m.template, p.n HAVING count(DISTINCT m.page) = p.n),
kept AS (SELECT m.doc_id, m.page, m.part, string_agg(m.line, chr(10) ORDER BY m.line_no) AS content FROM marked m
  WHERE NOT EXISTS (SELECT 1 FROM footers f WHERE f.doc_id = m.doc_id AND f.template = m.template) GROUP BY m.doc_id, m.page, m.part),
stripped AS (SELECT doc_id, page, part, CASE WHEN doc_id IN (SELECT doc_id FROM footers) THEN {strip_sql("content")} ELSE content END AS content FROM kept),
cleaned AS (SELECT doc_id, page, part, {clean_sql("content")} AS text FROM stripped WHERE content <> ''
  UNION ALL SELECT 'part ' || p_partkey, 1, 0, {clean_sql(_PARAMETERS_SQL)} FROM part),
windows AS (SELECT doc_id, page, part, 0::BIGINT AS start, text, length(text) AS n FROM cleaned WHERE text <> ''
  UNION ALL SELECT doc_id, page, part, stop - 120, text, n FROM (SELECT doc_id, page, part, text, n, CASE WHEN start + 700 < n AND
    strpos(substring(text, start + 351, 350), ' ') > 0 THEN start + 350 + 350 -
    strpos(reverse(substring(text, start + 351, 350)), ' ') ELSE start + 700 END AS stop FROM windows) WHERE stop < n),
cut AS (SELECT doc_id, page, part, start, CASE WHEN n <= 700 THEN text ELSE {strip_sql("""substring(text, start + 1, CASE WHEN start + 700 < n AND
    strpos(substring(text, start + 351, 350), ' ') > 0 THEN 700 - strpos(reverse(substring(text, start + 351, 350)), ' ') ELSE 700 END)""")} END AS text FROM windows)"""


@query(
    f"WITH {_NORMALISED_SQL} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, part, start) - 1 AS ordinal, "
    "page::BIGINT AS page, length(text) AS length, md5(text) AS text_md5 FROM cut WHERE text <> ''"
)
def normalised_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a parser gives, pages and tables, through all steps up to chunks: a host's
    pages are one document, every part is a table."""
    none = {"content": F.lit(None).cast("string"), "rows": F.lit(None).cast("array<array<string>>"), "section": F.lit(None).cast("string")}
    marked = F.replace(F.replace("html", F.lit("</p>"), F.lit("\n\n")), F.lit("><"), F.lit(">\n<"))
    pages = read_table(spark, sf_dir, "pages").select(
        F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("doc_id"),
        F.lit(0).alias("position"),
        F.lit("page").alias("kind"),
        F.col("page_id").cast("int").alias("page"),
        marked.alias("content"),
        *[none[c].alias(c) for c in ("section", "rows")],
    )
    tables = read_table(spark, sf_dir, "part").select(
        F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("doc_id"),
        F.lit(0).alias("position"),
        F.lit("table").alias("kind"),
        F.lit(1).alias("page"),
        none["content"].alias("content"),
        F.lit("").alias("section"),
        _parameter_rows().alias("rows"),
    )
    raw = pages.unionByName(tables).withColumn("error", F.lit(None).cast("string"))
    return chunk_raw_blocks(raw).select(
        "doc_id",
        F.col("ordinal").cast("long").alias("ordinal"),
        F.col("metadata.page").cast("long").alias("page"),
        F.char_length("text").cast("long").alias("length"),
        F.md5("text").alias("text_md5"),
    )


_LEFT_SQL = (
    "FROM (SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN 'new text: ' || text ELSE text END AS text "
    "FROM documents WHERE doc_id % 3 <> 1))"
)


@query(
    f"WITH {CHUNK_CTES.replace('FROM documents)', _LEFT_SQL, 1)} SELECT doc_id, ordinal, length(text) AS length, md5(text) AS text_md5 FROM doc_chunks"
)
def reingested_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks in a versioned table: a third of the documents comes again with another
    text and a third is deleted, in one commit."""
    table = SlicedTable(spark, scratch_folder(spark, "versions"), slices=16)
    documents = read_table(spark, sf_dir, "documents")
    nobody = documents.select("doc_id").limit(0)
    table.replace(document_chunks(spark, sf_dir), nobody)
    changed = documents.filter("doc_id % 3 = 0").withColumn("text", F.concat(F.lit("new text: "), F.col("text")))
    table.replace(chunks_of(changed), documents.filter("doc_id % 3 <> 2").select("doc_id"))
    return table.read().select(
        "doc_id",
        F.col("ordinal").cast("long").alias("ordinal"),
        F.char_length("text").cast("long").alias("length"),
        F.md5("text").alias("text_md5"),
    )


def _chunk_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    vectors = spark.createDataFrame([], "chunk_id STRING, doc_id BIGINT, embedding ARRAY<FLOAT>")
    return Corpus(document_chunks(spark, sf_dir), vectors, document_table(spark, sf_dir))


@query(
    f"WITH {CHUNK_CTES} SELECT filename, chunk_id, doc_id, ordinal, length(text) AS length FROM doc_chunks "
    "WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)"
)
def full_document_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks of the given documents, with no threshold and any status."""
    wanted = read_table(spark, sf_dir, "labels").filter("quality = 0")
    return chunks_of_documents(_chunk_corpus(spark, sf_dir), wanted).select(
        "filename",
        "chunk_id",
        "doc_id",
        F.col("ordinal").cast("long").alias("ordinal"),
        F.char_length("text").cast("long").alias("length"),
    )


@query(
    f"WITH {CHUNK_CTES}, wanted AS (SELECT DISTINCT substring(sha256(doc_id || '|' || quality), 1, 12) AS chunk_id FROM labels) "
    "SELECT chunk_id, doc_id, md5(text) AS text_md5 FROM doc_chunks WHERE chunk_id IN (SELECT chunk_id FROM wanted)"
)
def chunks_by_id_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-key lookup; ids that do not exist find nothing."""
    wanted = read_table(spark, sf_dir, "labels").select(
        chunking.chunk_id(F.col("doc_id"), F.col("quality")).alias("chunk_id")
    )
    return chunks_by_ids(document_chunks(spark, sf_dir), wanted).select(
        "chunk_id", "doc_id", F.md5("text").alias("text_md5")
    )


def _ranked_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job per source; its documents' chunks compete in document order."""
    chunks = document_chunks(spark, sf_dir)
    names = document_table(spark, sf_dir).select("doc_id", "filename")
    return chunks.join(names, "doc_id").select(
        F.col("metadata.section").alias("job_id"),
        F.struct("doc_id", "ordinal").alias("rank"),
        "chunk_id",
        "filename",
        "metadata",
        "text",
    )


_BODY_SQL = (
    "'[' || chunk_id || ' | ' || filename || ' | стр. 1 | ' || section || ']' || chr(10) || text"
)
_PACK_SQL = (
    f"bodies AS (SELECT section AS job_id, (doc_id, ordinal) AS rank, chunk_id, {_BODY_SQL} AS body FROM doc_chunks), "
    "running AS (SELECT *, sum(length(body)) OVER w AS running_chars, row_number() OVER w AS position FROM bodies "
    "WINDOW w AS (PARTITION BY job_id ORDER BY rank, chunk_id)), "
    "packed AS (SELECT * FROM running WHERE running_chars <= 6000 OR position = 1)"
)


@query(
    f"WITH {CHUNK_CTES}, {_PACK_SQL} SELECT job_id, chunk_id, position, running_chars::BIGINT AS running_chars FROM packed"
)
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = _ranked_bodies(spark, sf_dir).select(
        "job_id", "chunk_id", "rank", F.char_length(chunk_body()).alias("body_chars")
    )
    return pack_order(bodies).select(
        "job_id",
        "chunk_id",
        F.col("position").cast("long").alias("position"),
        F.col("running_chars").cast("long").alias("running_chars"),
    )


@query(
    f"WITH {CHUNK_CTES}, {_PACK_SQL} SELECT job_id, chunk_id, position, running_chars::BIGINT AS running_chars FROM packed"
)
def context_first_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk comes again behind all others of its job and counts once."""
    bodies = _ranked_bodies(spark, sf_dir).select(
        "job_id", "chunk_id", "rank", F.char_length(chunk_body()).alias("body_chars")
    )
    again = F.struct((F.col("rank.doc_id") + (1 << 40)).alias("doc_id"), F.col("rank.ordinal").alias("ordinal"))
    return pack_order(bodies.union(bodies.withColumn("rank", again))).select(
        "job_id",
        "chunk_id",
        F.col("position").cast("long").alias("position"),
        F.col("running_chars").cast("long").alias("running_chars"),
    )


@query(
    f"WITH {CHUNK_CTES}, {_PACK_SQL}, joined AS (SELECT job_id, string_agg(body, chr(10) || chr(10) ORDER BY position) AS context "
    "FROM packed GROUP BY job_id) SELECT job_id, md5(context) AS context_md5, length(context) AS length, "
    "array_to_string(list_sort(list_distinct(regexp_extract_all(context, '(?m)^\\[([a-z0-9]+) \\|', 1))), ',') AS ids FROM joined"
)
def context_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_context(_ranked_bodies(spark, sf_dir)).select(
        "job_id",
        F.md5("context").alias("context_md5"),
        F.char_length("context").cast("long").alias("length"),
        F.array_join(F.array_sort(context_chunk_ids(F.col("context"))), ",").alias("ids"),
    )


@query(
    "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)"
)
def pending_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = read_table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("chunk_id"))
    vectors = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"))
    return state.pending_chunks(chunks, vectors).select("doc_id")


@query(
    """WITH folders AS (SELECT doc_id // 100 AS doc_id, count(*) AS n FROM documents GROUP BY 1),
    stated AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'embed_failed' WHEN 1 THEN 'parsing' ELSE 'failed' END AS status
      FROM folders)
    SELECT s.doc_id, CASE WHEN s.status IN ('embed_failed', 'parsing') AND NOT EXISTS (
        SELECT 1 FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id
        WHERE d.doc_id // 100 = s.doc_id AND e.vec_id IS NULL) THEN 'indexed' ELSE s.status END AS status
    FROM stated s"""
)
def reconcile_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred documents form one folder; a folder without pending vectors is lifted."""
    chunks = read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.expr("doc_id DIV 100").alias("doc_id")
    )
    vectors = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"))
    folders = chunks.select("doc_id").distinct().select(
        "doc_id",
        F.when(F.col("doc_id") % 3 == 0, "embed_failed")
        .when(F.col("doc_id") % 3 == 1, "parsing")
        .otherwise("failed")
        .alias("status"),
        F.lit("timeout").alias("error"),
    )
    return state.reconcile_indexed(folders, state.pending_chunks(chunks, vectors)).select(
        "doc_id", "status"
    )


@query(
    """WITH names AS (SELECT p_name AS name, p_partkey AS place FROM part
      UNION ALL SELECT unnest(string_split(p_name, ' ')), 1000000 + p_partkey FROM part),
    listed AS (SELECT name, min(place) AS place FROM names GROUP BY name),
    found AS (SELECT d.doc_id, arg_min(l.name, (l.place, l.name)) AS brand FROM documents d JOIN listed l ON contains(d.text, l.name) GROUP BY d.doc_id)
    SELECT d.doc_id, f.brand FROM documents d LEFT JOIN found f ON f.doc_id = d.doc_id"""
)
def brand_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts, then their single words, looked up in every document: the order
    of the list decides."""
    parts = read_table(spark, sf_dir, "part")
    whole = parts.select(F.col("p_name").alias("name"), F.col("p_partkey").cast("long").alias("place"))
    single = parts.select(F.explode(F.split("p_name", " ")).alias("name"), (F.col("p_partkey") + 1_000_000).cast("long").alias("place"))
    texts = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return first_in_list(texts, whole.union(single)).select("doc_id", "brand")


_UPLOADS_SQL = """SELECT sha256(text) AS content_hash, substring(sha256(sha256(text)), 1, 12) AS doc_id,
        arg_min(source, doc_id) AS filename, min(doc_id) AS first_seq, count(*) AS copies
    FROM documents GROUP BY text"""
_UPLOAD_COLUMNS = ("content_hash", "doc_id", "filename", "first_seq", "copies")


#: Bytes of text in a file of the stream's input folder.
STREAM_FILE_BYTES = 64 << 20


def _uploads(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("doc_id").alias("seq"),
        F.col("source").alias("filename"),
        F.col("lang").alias("kind"),
        F.col("text").cast("binary").alias("content"),
    )


@query(_UPLOADS_SQL)
def streamed_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents as a stream: two micro-batches, then, after a restart, two
    more with contents that are known by then. A micro-batch has as many files as its
    texts need, so that no task reads a share of all texts."""
    folder = scratch_folder(spark, "stream")
    documents = read_table(spark, sf_dir, "documents")
    total = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = -(-total // (4 * STREAM_FILE_BYTES)) or 1
    for half in (0, 1):
        part = documents.filter(F.pmod(F.floor(F.col("doc_id") / 7), F.lit(2)) == half)
        part.repartitionByRange(2 * files, "doc_id").write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(documents.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
        start_registry(upload_facts(_uploads(stream)), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return registered(spark, f"{folder}/out").select(*_UPLOAD_COLUMNS)


@query(_UPLOADS_SQL)
def upload_deduplication(spark: SparkSession, sf_dir: str) -> DataFrame:
    uploads = _uploads(read_table(spark, sf_dir, "documents"))
    return state.register_uploads(uploads).select(*_UPLOAD_COLUMNS)


@query(
    """WITH files AS (SELECT doc_id, source || '_' || doc_id || '.' || CASE lang WHEN 'en' THEN 'pdf' WHEN 'fr' THEN 'DOCX'
        WHEN 'de' THEN 'xlsx' ELSE 'txt' END AS filename, lang, n_chars FROM documents)
    SELECT filename, CASE lang WHEN 'en' THEN 'pdf' WHEN 'fr' THEN 'docx' WHEN 'de' THEN 'xlsx' END AS kind,
      CASE WHEN lang NOT IN ('en', 'fr', 'de') THEN 415 WHEN n_chars > 4000 THEN 413 WHEN n_chars = 0 THEN 400 END AS rejected
    FROM files"""
)
def upload_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acceptance of every document as a file named by source and language."""
    extension = (
        F.when(F.col("lang") == "en", "pdf")
        .when(F.col("lang") == "fr", "DOCX")
        .when(F.col("lang") == "de", "xlsx")
        .otherwise("txt")
    )
    files = read_table(spark, sf_dir, "documents").select(
        F.concat(
            F.lit("/in/"), "source", F.lit("_"), F.col("doc_id").cast("string"), F.lit("."), extension
        ).alias("path"),
        F.col("n_chars").alias("length"),
    )
    checked = classify_uploads(files, replace(DEFAULTS, upload_max_bytes=4000))
    return checked.select("filename", "kind", F.col("rejected").cast("long").alias("rejected"))


_REQUEST_GROUP = (
    "CASE WHEN event_type = 'view' THEN 'request:' || event_id ELSE 'key:' || user_id || '-' || event_type END"
)


@query(
    f"""WITH g AS (SELECT {_REQUEST_GROUP} AS job_group, event_id, props FROM events)
    SELECT substring(sha256(job_group), 1, 12) AS job_id, min(event_id) AS seq,
           arg_min(props, event_id) AS payload, count(*) AS requests FROM g GROUP BY job_group"""
)
def job_idempotency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated keys share a job; a request without a key always gets its own."""
    key = F.concat_ws("-", F.col("user_id").cast("string"), "event_type")
    requests = read_table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") != "view", key).alias("idempotency_key"),
        F.col("props").alias("payload"),
    )
    return state.create_jobs(requests).select("job_id", "seq", "payload", "requests")


@query(
    """SELECT user_id AS job_id, arg_max(event_type, event_id) AS status,
        arg_max(props, event_id) FILTER (WHERE event_type = 'purchase') AS result,
        arg_max(props, event_id) FILTER (WHERE event_type = 'error') AS error,
        count(*) FILTER (WHERE event_type = 'click') AS attempts
    FROM events GROUP BY user_id"""
)
def job_state_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current state of a job from its update events."""
    events = read_table(spark, sf_dir, "events").select(
        F.col("user_id").alias("job_id"),
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("status"),
        F.when(F.col("event_type") == "purchase", F.col("props")).alias("result"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("error"),
    )
    return state.current_state(
        events, "job_id", ["status"], ["result", "error"], F.col("status") == "click"
    )


@query(
    "SELECT d.doc_id AS chunk_id, coalesce(l.toxic = 1, false) AS suspicious FROM documents d "
    "LEFT JOIN labels l ON l.doc_id = d.doc_id"
)
def suspicious_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.lit(False).alias("suspicious")
    )
    flagged = read_table(spark, sf_dir, "labels").filter("toxic = 1").select(
        F.col("doc_id").alias("chunk_id")
    )
    return state.mark_suspicious(chunks, flagged)


@query(
    """SELECT conv_id AS job_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ordinal,
        role AS step, length(text) AS length FROM conversations"""
)
def trace_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = read_table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("job_id"), "turn", F.col("role").alias("step"), "text"
    )
    numbered = group_ordinals(steps, ["job_id"], ["turn"], F.expr("turn DIV 1000"))
    return numbered.select(
        "job_id", "ordinal", "step", F.char_length("text").cast("long").alias("length")
    )


@query(
    with_ctes(
        """
docs AS (SELECT d.doc_id, d.source || '_' || d.doc_id AS filename, lower(regexp_extract(d.source || '_' || d.doc_id, '^[^_.]*')) AS family,
  CASE WHEN l.toxic = 1 THEN 'failed' ELSE 'indexed' END AS status FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
    )
    + " SELECT * FROM docs"
)
def document_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_table(spark, sf_dir).withColumn("family", tx.family_of(F.col("filename")))


@query(
    "WITH k AS (SELECT doc_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', '', 'g') AS evidence, "
    "regexp_replace(regexp_replace(lower(text), '" + SPACE_SQL + "+', '', 'g'), '[.,;:«»\"''()\\-–—]', '', 'g') AS value "
    "FROM documents) SELECT doc_id, md5(evidence) AS evidence_md5, md5(value) AS value_md5 FROM k"
)
def comparison_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select(
        "doc_id",
        F.md5(tx.evidence_key(F.col("text"))).alias("evidence_md5"),
        F.md5(tx.normalize_value(F.col("text"))).alias("value_md5"),
    )
