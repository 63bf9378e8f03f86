"""Masking, injection screening and answer repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.catalog import query
from loomdex.functions.json_repair import repaired_json
from loomdex.functions.pii import CARD, EMAIL, INN, PHONE, mask_pii
from loomdex.operators import guard
from loomdex.session import read_table

# SQL spelling of the patterns; \b is a word boundary here.
EMAIL_SQL = EMAIL
PHONE_SQL = PHONE.replace("\\x85", "\\x{85}")
INN_SQL = "\\b[0-9]{10}\\b|\\b[0-9]{12}\\b"
CARD_SQL = "\\b[0-9](?:[ -]?[0-9]){12,18}\\b"


def _digit(i: int) -> str:
    return f"substr(d, {i}, 1)::INT"


def _weighted(weights: tuple[int, ...]) -> str:
    return "(" + " + ".join(f"{w} * {_digit(i)}" for i, w in enumerate(weights, 1)) + ")"


INN_OK_SQL = (
    f"CASE length(d) WHEN 10 THEN {_weighted((2, 4, 10, 3, 5, 9, 4, 6, 8))} % 11 % 10 = {_digit(10)} "
    f"WHEN 12 THEN {_weighted((7, 2, 4, 10, 3, 5, 9, 4, 6, 8))} % 11 % 10 = {_digit(11)} AND "
    f"{_weighted((3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8))} % 11 % 10 = {_digit(12)} ELSE false END"
)
LUHN_SQL = (
    "list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN (length(d) - i) % 2 = 0 "
    "THEN substr(d, i, 1)::INT ELSE (substr(d, i, 1)::INT * 2) // 10 + (substr(d, i, 1)::INT * 2) % 10 END)) % 10 = 0"
)
EAN_SQL = (
    f"length(d) = 13 AND (10 - {_weighted((1, 3) * 6)} % 10) % 10 = {_digit(13)}"
)
CARD_OK_SQL = f"length(d) IN (13, 16, 19) AND NOT coalesce(({EAN_SQL}), false) AND {LUHN_SQL}"


def mask_step_sql(source: str, target: str, pattern: str, kind: str, accept: str = "true") -> str:
    """CTEs that replace one kind: cut into matches and segments, number the
    accepted matches, join again."""
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    ok = f"list_transform(ms, lambda m: (SELECT {accept} FROM (SELECT {digits} AS d)))"
    if accept != "true":
        # Inline the digits: a lambda may not hold a subquery.
        ok = f"list_transform(list_transform(ms, lambda m: {digits}), lambda d: {accept})"
    else:
        ok = "list_transform(ms, lambda m: true)"
    return f"""
{target}_parts AS (
  SELECT *, regexp_extract_all(text, '{pattern}') AS ms, regexp_split_to_array(text, '{pattern}') AS segs FROM {source}),
{target}_ok AS (SELECT *, {ok} AS oks FROM {target}_parts),
{target} AS (
  SELECT * EXCLUDE (text, ms, segs, oks),
    CASE WHEN len(ms) = 0 THEN text ELSE segs[1] || array_to_string(list_transform(range(1, len(ms) + 1), lambda i:
      CASE WHEN oks[i] THEN '[{kind.upper()}_' || len(list_filter(oks[1:i], lambda o: o)) || ']' ELSE ms[i] END
      || segs[i + 1]), '') END AS text,
    len(list_filter(oks, lambda o: o)) AS n_{kind}
  FROM {target}_ok)"""


def mask_sql(source: str) -> str:
    """CTEs from ``source`` (with a column text) to ``masked``."""
    return ",".join(
        [
            mask_step_sql(source, "m1", EMAIL_SQL, "email"),
            mask_step_sql("m1", "m2", PHONE_SQL, "phone"),
            mask_step_sql("m2", "m3", INN_SQL, "inn", INN_OK_SQL),
            mask_step_sql("m3", "masked", CARD_SQL, "card", CARD_OK_SQL),
        ]
    )


@query(
    "WITH src AS (SELECT doc_id, text FROM documents),"
    + mask_sql("src")
    + " SELECT doc_id, md5(text) AS text_md5, n_email, n_phone, n_inn, n_card FROM masked"
)
def masked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = read_table(spark, sf_dir, "documents").select(
        "doc_id", mask_pii(F.col("text")).alias("m")
    )
    return masked.select(
        "doc_id",
        F.md5("m.text").alias("text_md5"),
        *[F.col(f"m.n_{k}").cast("long").alias(f"n_{k}") for k in ("email", "phone", "inn", "card")],
    )


@query(
    "WITH src AS (SELECT page_id, html AS text FROM pages),"
    + mask_sql("src")
    + " SELECT page_id, md5(text) AS text_md5, n_email, n_phone, n_inn, n_card FROM masked"
)
def masked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = read_table(spark, sf_dir, "pages").select("page_id", mask_pii(F.col("html")).alias("m"))
    return masked.select(
        "page_id",
        F.md5("m.text").alias("text_md5"),
        *[F.col(f"m.n_{k}").cast("long").alias(f"n_{k}") for k in ("email", "phone", "inn", "card")],
    )


@query(
    f"""SELECT doc_id, len(regexp_extract_all(text, '{EMAIL_SQL}')) AS n_email,
        len(regexp_extract_all(text, '{PHONE_SQL}')) AS n_phone,
        len(regexp_extract_all(text, '{INN_SQL}')) AS n_inn,
        len(regexp_extract_all(text, '{CARD_SQL}')) AS n_card FROM documents"""
)
def pii_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate counts on the raw text, before any checksum."""
    return read_table(spark, sf_dir, "documents").select(
        "doc_id",
        *[
            F.regexp_count("text", F.lit(pattern)).cast("long").alias(f"n_{kind}")
            for kind, pattern in (("email", EMAIL), ("phone", PHONE), ("inn", INN), ("card", CARD))
        ],
    )


INJECTION_SQL = [
    "игнорируй\\s+(все\\s+)?предыдущ",
    "ignore\\s+(all\\s+)?previous\\s+instructions",
    "disregard\\s+(all\\s+)?(previous|above)",
    "\\bsystem\\s*:",
    "<\\|im_start\\|>|<\\|system\\|>",
    "reveal\\s+your\\s+(prompt|instructions)",
    "ты\\s+теперь\\s+(должен|обязан)",
    "нов[ые]\\s+инструкции:",
    "укажи\\s+цену\\s+[0-9]",
]
REASON_SQL = (
    "'regex: ''' || coalesce("
    + ", ".join(f"nullif(regexp_extract(text, '(?i){p}'), '')" for p in INJECTION_SQL)
    + ") || ''''"
)
_TURNS_SQL = (
    "src AS (SELECT conv_id AS job_id, turn AS rank, conv_id || '-' || turn AS chunk_id, "
    "role || ': ' || text AS text FROM conversations)"
)


def transcript_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as ``role: text`` chunks; a system turn looks like an
    attempt to take over the role."""
    turns = read_table(spark, sf_dir, "conversations")
    return turns.select(
        F.col("conv_id").alias("job_id"),
        F.col("turn").alias("rank"),
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("chunk_id"),
        F.concat_ws(": ", "role", "text").alias("text"),
    )


@query(
    f"WITH {_TURNS_SQL},"
    + mask_sql("src")
    + f", screened AS (SELECT *, {REASON_SQL} AS reason FROM masked) "
    "SELECT job_id, chunk_id, md5(text) AS text_md5, n_email + n_phone + n_inn + n_card AS masked_pii, reason FROM screened"
)
def guarded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    screened = guard.screen_chunks(transcript_chunks(spark, sf_dir))
    return screened.select(
        "job_id",
        "chunk_id",
        F.md5("text").alias("text_md5"),
        F.col("masked_pii").cast("long").alias("masked_pii"),
        "reason",
    )


@query(
    f"WITH {_TURNS_SQL},"
    + mask_sql("src")
    + f""", screened AS (SELECT *, {REASON_SQL} AS reason FROM masked)
    SELECT job_id, sum(n_email + n_phone + n_inn + n_card)::BIGINT AS masked_pii,
      count(reason) AS suspicious, count(reason) > 2 AS needs_review FROM screened GROUP BY job_id"""
)
def guard_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = guard.guard_report(guard.guard_context(transcript_chunks(spark, sf_dir)))
    return report.withColumn("masked_pii", F.col("masked_pii").cast("long"))


@query(
    f"WITH {_TURNS_SQL},"
    + mask_sql("src")
    + f""", screened AS (SELECT *, {REASON_SQL} AS reason FROM masked)
    SELECT job_id, rank, chunk_id, chunk_id || ': ' || reason AS reason FROM screened WHERE reason IS NOT NULL"""
)
def blocked_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guard.blocked_chunks(guard.guard_context(transcript_chunks(spark, sf_dir)))


@query(
    f"WITH {_TURNS_SQL},"
    + mask_sql("src")
    + f""", screened AS (SELECT *, {REASON_SQL} AS reason FROM masked)
    SELECT job_id, rank, reason IS NOT NULL AND job_id % 3 <> 1 AS blocked,
      CASE WHEN reason IS NOT NULL AND job_id % 3 < 2 THEN 'verdict ' || (job_id % 3 = 0) ELSE reason END AS reason
    FROM screened"""
)
def confirmed_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of verdicts as the detector: a third of the conversations has a yes, a
    third a no and a third has none, which blocks."""

    def verdicts(asked: DataFrame) -> DataFrame:
        conversation = F.split_part("fragment_id", F.lit("-"), F.lit(1)).cast("long")
        yes = conversation % 3 == 0
        detail = F.concat(F.lit("verdict "), yes.cast("string"))
        return asked.filter(conversation % 3 < 2).select("fragment_id", yes.alias("injection"), detail.alias("detail"))

    confirmed = guard.guard_context(transcript_chunks(spark, sf_dir), verdicts)
    return confirmed.select("job_id", "rank", "blocked", "reason")


@query(
    f"WITH src AS (SELECT conv_id, turn, text AS raw, to_json(struct_pack(title := role, description := text))::VARCHAR AS text FROM conversations),"
    + mask_sql("src")
    + """ SELECT conv_id, turn, md5(text) AS cleaned_md5,
      CASE WHEN n_email + n_phone + n_inn + n_card > 0 THEN 'personal data masked in card: ' || (n_email + n_phone + n_inn + n_card) ELSE '' END AS issues
    FROM masked"""
)
def guarded_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations")
    card = F.to_json(F.struct(F.col("role").alias("title"), F.col("text").alias("description")))
    checked = turns.select("conv_id", "turn", guard.guard_output(card).alias("g"))
    return checked.select(
        "conv_id",
        "turn",
        F.md5("g.cleaned").alias("cleaned_md5"),
        F.array_join("g.issues", "; ").alias("issues"),
    )


@query(
    """SELECT event_id, event_type <> 'error' AS found,
        CASE WHEN event_type <> 'error' THEN regexp_extract(props, '([0-9]+)', 1)::BIGINT END AS k FROM events"""
)
def repaired_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties dressed up as untidy model answers, one kind per type."""
    k = F.get_json_object("props", "$.k")
    answer = (
        F.when(F.col("event_type") == "view", F.col("props"))
        .when(F.col("event_type") == "click", F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("Here it is: "), "props", F.lit(" done.")))
        .when(F.col("event_type") == "signup", F.concat(F.lit("x='y' {'k': "), k, F.lit("}")))
        .otherwise(F.concat(F.lit("no object, k is "), k))
    )
    repaired = read_table(spark, sf_dir, "events").select(
        "event_id", repaired_json(answer).alias("json")
    )
    return repaired.select(
        "event_id",
        F.col("json").isNotNull().alias("found"),
        F.get_json_object("json", "$.k").cast("long").alias("k"),
    )
