"""Card contract, coverage, decisions and scores.

Every part of the catalogue is a product: its columns are the golden record, a
specification chunk and a sales chunk (from its order lines) are its documents,
and a card with deliberate flaws is derived from the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.catalog import query
from loomdex.functions.binding import let
from loomdex.functions.text import evidence_key
from loomdex.operators import contract
from loomdex.operators import evaluation as ev
from loomdex.operators.card_json import read_card
from loomdex.schemas import CARD, EMPTY_LIST
from loomdex.session import read_table


def product_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part columns with sold quantity; parts never ordered have NULL."""
    sold = read_table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.sum("l_quantity").cast("long").alias("sold")
    )
    parts = read_table(spark, sf_dir, "part")
    return parts.join(sold, F.col("p_partkey") == F.col("l_partkey"), "left").drop("l_partkey")


def product_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A specification chunk of every part and a sales chunk of every sold one."""
    key = F.col("p_partkey").cast("string")
    spec = F.concat(
        "p_name", F.lit(". Brand: "), "p_brand", F.lit(". Type: "), "p_type",
        F.lit(". Size: "), F.col("p_size").cast("string"), F.lit(" mm."),
    )
    sales = F.concat(F.lit("Units sold: "), F.col("sold").cast("string"), F.lit(". Best seller."))
    return (
        product_sales(spark, sf_dir)
        .select(
            F.concat(F.lit("p"), key).alias("doc_id"),
            F.posexplode(F.array(spec, sales)).alias("ordinal", "text"),
        )
        .filter(F.col("text").isNotNull())
        .select(
            F.concat("doc_id", F.lit("c"), F.col("ordinal").cast("string")).alias("chunk_id"),
            "doc_id",
            "ordinal",
            "text",
            F.struct((F.col("ordinal") + 1).alias("page"), F.lit("").alias("section")).alias("metadata"),
        )
    )


def product_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, card: large parts have no source, wide ones cite a chunk that does
    not exist, small ones an over-long title, and so on."""
    key = F.col("p_partkey").cast("string")
    doc = F.concat(F.lit("p"), key)
    size = F.col("p_size")
    characteristics = F.map_from_arrays(
        F.array(F.lit("Brand"), F.lit("type"), F.lit("Size"), F.lit("Sold"), F.lit("Colour")),
        F.array(
            F.upper("p_brand"),
            F.lower("p_type"),
            F.concat(size.cast("string"), F.lit(" MM")),
            F.coalesce(F.concat(F.lit("sold: "), F.col("sold").cast("string"), F.lit(" units")), F.lit(" ")),
            F.when(size % 3 == 0, "blue").otherwise(F.lit("")),
        ),
    )
    source = lambda suffix: F.struct(  # noqa: E731 - a local shorthand
        F.concat(doc, F.lit(suffix)).alias("chunk_id"),
        F.lit("").alias("doc_id"),
        F.lit(None).cast("int").alias("page"),
        F.lit(None).cast("double").alias("score"),
    )
    sources = (
        F.when(size > 45, F.array().cast(f"array<{_SOURCE}>"))
        .when(size > 40, F.array(source("c0"), source("c9")))
        .otherwise(F.array(source("c0"), source("c1")))
    )
    title = F.when(size < 4, F.repeat("p_name", 8)).otherwise(F.col("p_name"))
    card = F.struct(
        title.alias("title"),
        F.concat("p_name", F.lit(" by "), "p_brand").alias("description"),
        characteristics.alias("characteristics"),
        F.expr(EMPTY_LIST).alias("benefits"),
        F.struct(
            F.col("p_name").alias("title"), F.lit("").alias("description"), F.expr(EMPTY_LIST).alias("keywords")
        ).alias("seo"),
        sources.alias("sources"),
        F.array(F.when(size % 5 == 0, "Size").otherwise("Warranty")).alias("missing_fields"),
        (F.col("p_retailprice") % 100 / 100 + F.when(size % 7 == 0, 0.5).otherwise(0.0)).alias("confidence"),
    ).cast(CARD)
    return product_sales(spark, sf_dir).select(
        doc.alias("job_id"), contract.with_defaults(card).alias("card"), "p_size", "p_brand", "p_type", "sold"
    )


_SOURCE = "struct<chunk_id:string,doc_id:string,page:int,score:double>"

PRODUCTS_SQL = """
sold AS (SELECT l_partkey, sum(l_quantity)::BIGINT AS sold FROM lineitem GROUP BY l_partkey),
products AS (
  SELECT p.*, s.sold, 'p' || p_partkey AS job_id,
    p_name || '. Brand: ' || p_brand || '. Type: ' || p_type || '. Size: ' || p_size || ' mm.' AS spec,
    'Units sold: ' || s.sold || '. Best seller.' AS sales,
    CASE WHEN p_size < 4 THEN repeat(p_name, 8) ELSE p_name END AS title,
    p_retailprice % 100 / 100 + CASE WHEN p_size % 7 = 0 THEN 0.5 ELSE 0 END AS confidence,
    CASE WHEN p_size % 5 = 0 THEN 'Size' ELSE 'Warranty' END AS missing
  FROM part p LEFT JOIN sold s ON s.l_partkey = p.p_partkey),
pairs AS (
  SELECT job_id, unnest(['Brand', 'type', 'Size', 'Sold', 'Colour']) AS k,
    unnest([upper(p_brand), lower(p_type), p_size || ' MM',
      coalesce('sold: ' || sold || ' units', ' '), CASE WHEN p_size % 3 = 0 THEN 'blue' ELSE '' END]) AS v
  FROM products),
characteristics AS (SELECT * FROM pairs WHERE trim(v) <> ''),
citations AS (
  SELECT job_id, job_id || unnest(CASE WHEN p_size > 45 THEN [] WHEN p_size > 40 THEN ['c0', 'c9'] ELSE ['c0', 'c1'] END) AS chunk_id
  FROM products),
product_chunks AS (
  SELECT job_id AS doc_id, job_id || 'c0' AS chunk_id, spec AS text, 1 AS page FROM products
  UNION ALL SELECT job_id, job_id || 'c1', sales, 2 FROM products WHERE sales IS NOT NULL),
cited AS (SELECT c.job_id, p.* FROM citations c JOIN product_chunks p ON p.chunk_id = c.chunk_id)"""
_P = "WITH " + PRODUCTS_SQL


def key_sql(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_]+', '', 'g')"


def norm_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower({x}), '\\s+', '', 'g'), '[.,;:«»\"''()\\-–—]', '', 'g')"


@query(
    _P
    + """ SELECT p.job_id, concat_ws('; ',
      CASE WHEN length(title) > 60 THEN 'title longer than 60 characters: ' || length(title) END,
      CASE WHEN confidence > 1 THEN 'confidence must be in [0, 1]' END,
      CASE WHEN missing = 'Size' THEN 'fields both present and missing: Size' END) AS violations
    FROM products p"""
)
def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_cards(spark, sf_dir).select(
        "job_id", F.array_join(contract.contract_violations(F.col("card")), "; ").alias("violations")
    )


def _cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contract.cited_chunks(product_cards(spark, sf_dir), product_chunks(spark, sf_dir))


@query(
    _P
    + """ SELECT p.job_id, CASE WHEN p_size > 40 AND p_size <= 45 THEN 'sources not in the context: ' || p.job_id || 'c9'
        WHEN p_size <= 40 AND sales IS NULL THEN 'sources not in the store: ' || p.job_id || 'c1' ELSE '' END AS problem
    FROM products p"""
)
def source_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = F.array(F.concat("job_id", F.lit("c0")), F.concat("job_id", F.lit("c1")))
    problem = contract.source_errors(F.col("card"), allowed, F.col("cited.chunk_id"))
    return _cited(spark, sf_dir).select("job_id", F.coalesce(problem, F.lit("")).alias("problem"))


@query(
    _P
    + """ SELECT c.job_id, c.chunk_id, coalesce(p.doc_id, '') AS doc_id, p.page, CASE WHEN p.page = 1 THEN 0.5123 END AS score
    FROM citations c LEFT JOIN product_chunks p ON p.chunk_id = c.chunk_id"""
)
def source_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = F.create_map(F.concat("job_id", F.lit("c0")), F.lit(0.512345))
    enriched = _cited(spark, sf_dir).select(
        "job_id", contract.enrich_sources(F.col("card"), F.col("cited"), scores).alias("card")
    )
    return enriched.select("job_id", F.inline("card.sources"))


_COVERAGE_SQL = f"""
covered AS (
  SELECT ch.job_id, count(*) AS n, count(*) FILTER (WHERE {key_sql('v')} <> '' AND EXISTS (
    SELECT 1 FROM cited c WHERE c.job_id = ch.job_id AND contains({key_sql('c.text')}, {key_sql('v')}))) AS hits
  FROM characteristics ch GROUP BY ch.job_id),
coverages AS (SELECT job_id, CASE WHEN n > 0 THEN hits / n ELSE 0 END AS coverage FROM covered)"""


@query(_P + "," + _COVERAGE_SQL + " SELECT job_id, round(coverage, 3) AS coverage FROM coverages")
def source_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    coverage = contract.source_coverage(F.col("card"), F.col("cited"))
    return _cited(spark, sf_dir).select("job_id", F.round(coverage, 3).alias("coverage"))


@query(
    _P
    + ","
    + _COVERAGE_SQL
    + """ SELECT p.job_id, CASE WHEN p_size % 11 = 0 THEN 'rejected'
        WHEN p_size > 45 OR coalesce(sold, 0) > 1000 OR coverage < 0.8 OR confidence < 0.5 THEN 'needs_review'
        ELSE 'done' END AS status
    FROM products p JOIN coverages c ON c.job_id = p.job_id"""
)
def card_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Critics reject every eleventh size; guards object to the best sold parts."""
    card = F.col("card")
    status = contract.decide_status(
        card,
        F.col("p_size") % 11 != 0,
        contract.source_coverage(card, F.col("cited")),
        F.coalesce("sold", F.lit(0)) > 1000,
    )
    return _cited(spark, sf_dir).select("job_id", status.alias("status"))


@query(
    _P + " SELECT job_id, CASE WHEN confidence < 0.5 THEN 'needs_review' ELSE 'done' END AS status FROM products"
)
def confidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_cards(spark, sf_dir).select(
        "job_id", contract.confidence_gate(F.col("card.confidence")).alias("status")
    )


_GOLDEN_SQL = f"""
golden AS (
  SELECT job_id, unnest(['brand', 'Type', 'Size', 'Units sold', 'Weight']) AS k,
    unnest([p_brand, p_type, p_size || 'mm', coalesce(sold, 0)::VARCHAR, p_size || ' g']) AS v FROM products),
norm_card AS (SELECT job_id, {norm_sql('k')} AS k, {norm_sql('v')} AS v FROM characteristics),
norm_golden AS (SELECT job_id, {norm_sql('k')} AS k, {norm_sql('v')} AS v FROM golden),
accuracy AS (
  SELECT g.job_id, avg(CASE WHEN EXISTS (SELECT 1 FROM norm_card c WHERE c.job_id = g.job_id
    AND (contains(c.k, g.k) OR contains(g.k, c.k)) AND (contains(c.v, g.v) OR contains(g.v, c.v))) THEN 1.0 ELSE 0.0 END) AS field_accuracy
  FROM norm_golden g GROUP BY g.job_id),
probes AS (
  SELECT job_id, unnest([p_brand, coalesce(sold, 0) || '. BEST', 'no such text']) AS probe FROM products),
hits AS (
  SELECT p.job_id, avg(CASE WHEN EXISTS (SELECT 1 FROM cited c WHERE c.job_id = p.job_id
    AND contains({norm_sql('c.text')}, {norm_sql('p.probe')})) THEN 1.0 ELSE 0.0 END) AS citation_hit
  FROM probes p GROUP BY p.job_id),
scores AS (
  SELECT p.job_id, a.field_accuracy, h.citation_hit,
    CASE WHEN p_size % 4 <> 0 THEN p_size / 50 END AS faithfulness,
    p_size * 0.001 AS cost, p_size * 100 AS tokens, p_type <> 'SMALL' AS expected
  FROM products p JOIN accuracy a ON a.job_id = p.job_id JOIN hits h ON h.job_id = p.job_id)"""


def product_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    sold = F.coalesce("sold", F.lit(0)).cast("string")
    golden = F.map_from_arrays(
        F.array(*[F.lit(k) for k in ("brand", "Type", "Size", "Units sold", "Weight")]),
        F.array(
            F.col("p_brand"),
            F.col("p_type"),
            F.concat(F.col("p_size").cast("string"), F.lit("mm")),
            sold,
            F.concat(F.col("p_size").cast("string"), F.lit(" g")),
        ),
    )
    probes = F.array(F.col("p_brand"), F.concat(sold, F.lit(". BEST")), F.lit("no such text"))
    size = F.col("p_size")
    return _cited(spark, sf_dir).select(
        "job_id",
        ev.field_accuracy(F.col("card.characteristics"), golden).alias("field_accuracy"),
        ev.citation_hit(probes, F.col("cited.text")).alias("citation_hit"),
        F.when(size % 4 != 0, size / 50).alias("faithfulness"),
        (size * F.lit(0.001)).alias("cost"),
        (size * 100).alias("tokens"),
        (F.col("p_type") != "SMALL").alias("expected"),
    )


@query(
    _P
    + ","
    + _GOLDEN_SQL
    + " SELECT job_id, round(field_accuracy, 3) AS field_accuracy, round(citation_hit, 3) AS citation_hit FROM scores"
)
def card_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_scores(spark, sf_dir).select(
        "job_id",
        F.round("field_accuracy", 3).alias("field_accuracy"),
        F.round("citation_hit", 3).alias("citation_hit"),
    )


@query(
    _P
    + ","
    + _GOLDEN_SQL
    + """, m AS (SELECT avg(field_accuracy) AS f, avg(citation_hit) AS c, avg(faithfulness) AS j,
        avg(cost) AS cost, avg(tokens) AS tokens, count(*) AS n FROM scores WHERE expected)
    SELECT round(f, 6) AS field_accuracy, round(c, 6) AS citation_hit, round(j, 6) AS faithfulness,
      round(cost, 6) AS avg_cost, round(tokens, 6) AS avg_tokens, n AS documents,
      CASE WHEN f <= c AND f <= coalesce(j, 2) THEN 'field_accuracy' WHEN c <= coalesce(j, 2) THEN 'citation_hit'
        ELSE 'faithfulness' END AS weakest_metric FROM m"""
)
def evaluation_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    averages = ev.macro_averages(product_scores(spark, sf_dir))
    return averages.select(
        *[
            F.round(c, 6).alias(c)
            for c in ("field_accuracy", "citation_hit", "faithfulness", "avg_cost", "avg_tokens")
        ],
        "documents",
        "weakest_metric",
    )


@query(f"{_P} SELECT chunk_id, {key_sql('text')} AS evidence FROM product_chunks")
def evidence_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_chunks(spark, sf_dir).select("chunk_id", evidence_key(F.col("text")).alias("evidence"))


_FLAW = "p_partkey % 12"
_CARD_JSON_SQL = f"""
flawed AS (SELECT p_partkey, CASE {_FLAW} WHEN 7 THEN substr(j, 1, length(j) - 4) ELSE j END AS j FROM (
  SELECT p_partkey, '{{"title": ' || CASE {_FLAW} WHEN 1 THEN p_size::VARCHAR ELSE '"' || p_name || '"' END
    || CASE {_FLAW} WHEN 4 THEN '' ELSE ', "description": "' || p_type || ' part"' END
    || ', "characteristics": {{"brand": "' || p_brand || '", "size": ' || CASE {_FLAW} WHEN 2 THEN p_size::VARCHAR ELSE '"' || p_size || '"' END || '}}'
    || CASE {_FLAW} WHEN 3 THEN ', "benefits": "light"' ELSE ', "benefits": ["light"]' END
    || CASE {_FLAW} WHEN 10 THEN ', "seo": null' WHEN 11 THEN ', "colour": {{"a": [1, 2]}}' ELSE ', "seo": {{"keywords": ["k"]}}' END
    || ', "sources": [{{"chunk_id": ' || CASE {_FLAW} WHEN 9 THEN p_partkey::VARCHAR ELSE '"c' || p_partkey || '"' END
    || ', "page": ' || CASE {_FLAW} WHEN 8 THEN '"' || p_size || '"' ELSE p_size::VARCHAR END || '}}]'
    || ', "confidence": ' || CASE {_FLAW} WHEN 5 THEN '"0.25"' WHEN 6 THEN '"high"' ELSE '0.5' END || '}}' AS j FROM part)),
parsed AS (SELECT p_partkey, j, json_valid(j) AS ok, CASE WHEN json_valid(j) THEN j::JSON END AS v FROM flawed),
judged AS (SELECT *, array_to_string(list_filter([
    CASE WHEN NOT ok THEN 'the answer is no valid JSON' END,
    CASE WHEN json_type(v, '$.title') <> 'VARCHAR' THEN 'title is no string' END,
    CASE WHEN EXISTS (SELECT 1 FROM (SELECT unnest(json_keys(v, '$.characteristics')) AS k) WHERE json_type(v, '$.characteristics.' || k) <> 'VARCHAR') THEN 'characteristics is no object of strings' END,
    CASE WHEN json_type(v, '$.benefits') <> 'ARRAY' THEN 'benefits is no list of strings' END,
    CASE WHEN json_type(v, '$.seo') <> 'OBJECT' THEN 'seo is no object' END,
    CASE WHEN json_type(v, '$.sources[0].chunk_id') <> 'VARCHAR' THEN 'sources is no list of sources' END,
    CASE WHEN TRY_CAST(v ->> '$.confidence' AS DOUBLE) IS NULL AND ok THEN 'confidence is no number' END], lambda x: x IS NOT NULL), '; ') AS type_errors FROM parsed)"""


@query(
    f"""WITH {_CARD_JSON_SQL} SELECT p_partkey, type_errors,
      CASE WHEN type_errors <> '' THEN '' WHEN json_type(v, '$.description') IS NULL THEN 'description is missing' ELSE '' END AS violations,
      CASE WHEN type_errors = '' THEN v ->> '$.title' END AS title, CASE WHEN type_errors = '' THEN (v ->> '$.confidence')::DOUBLE END AS confidence,
      CASE WHEN type_errors = '' THEN (v ->> '$.sources[0].page')::BIGINT END AS page,
      CASE WHEN type_errors = '' THEN v ->> '$.characteristics.size' END AS size, CASE WHEN type_errors = '' THEN true END AS same_again FROM judged"""
)
def card_json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards as JSON text with missing, extra, wrongly typed and broken fields, read
    through the gate; good ones are written and read once more."""
    flaw = F.col("p_partkey") % 12

    def flawed(numbers: dict[int, Column], usual: Column) -> Column:
        out = F
        for number, value in numbers.items():
            out = out.when(flaw == number, value)
        return out.otherwise(usual)

    def quoted(value: Column) -> Column:
        return F.concat(F.lit('"'), value.cast("string"), F.lit('"'))

    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    text = F.concat(
        F.lit('{"title": '), flawed({1: size}, quoted(F.col("p_name"))),
        flawed({4: F.lit("")}, F.concat(F.lit(', "description": "'), "p_type", F.lit(' part"'))),
        F.lit(', "characteristics": {"brand": '), quoted(F.col("p_brand")), F.lit(', "size": '), flawed({2: size}, quoted(size)), F.lit("}"),
        flawed({3: F.lit(', "benefits": "light"')}, F.lit(', "benefits": ["light"]')),
        flawed({10: F.lit(', "seo": null'), 11: F.lit(', "colour": {"a": [1, 2]}')}, F.lit(', "seo": {"keywords": ["k"]}')),
        F.lit(', "sources": [{"chunk_id": '), flawed({9: key}, quoted(F.concat(F.lit("c"), key))),
        F.lit(', "page": '), flawed({8: quoted(size)}, size), F.lit("}]"),
        F.lit(', "confidence": '), flawed({5: F.lit('"0.25"'), 6: F.lit('"high"')}, F.lit("0.5")), F.lit("}"),
    )
    text = F.when(flaw == 7, F.substring(text, F.lit(1), F.length(text) - 4)).otherwise(text)
    # Small rows and much work: a few files must not be a few tasks.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cards = read_table(spark, sf_dir, "part").select("p_partkey", text.alias("text")).repartition(tasks)
    read = cards.withColumn("read", read_card(F.col("text")))
    read = read.select("p_partkey", "read.type_errors", let(F.col("read.card"), contract.with_defaults).alias("card"))
    typed = F.size("type_errors") == 0
    again = let(read_card(F.to_json("card"))["card"], contract.with_defaults)
    value = lambda column: F.when(typed, column)  # noqa: E731 - a local shorthand
    return read.select(
        "p_partkey",
        F.array_join("type_errors", "; ").alias("type_errors"),
        F.when(typed, F.array_join(contract.contract_violations(F.col("card")), "; ")).otherwise(F.lit("")).alias("violations"),
        value(F.col("card.title")).alias("title"),
        value(F.col("card.confidence")).alias("confidence"),
        value(F.get("card.sources", F.lit(0))["page"].cast("long")).alias("page"),
        value(F.try_element_at("card.characteristics", F.lit("size"))).alias("size"),
        value(F.to_json(again) == F.to_json("card")).alias("same_again"),
    )
