"""Call accounting: events stand in for model calls, orders for jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.catalog import query
from loomdex.catalog.base import DOCS_SQL, document_table
from loomdex.functions.pricing import call_cost
from loomdex.functions.text import price_key
from loomdex.operators import accounting as acc
from loomdex.session import read_table

PRICES = {
    "default": {"input": 0.25, "output": 1.0},
    "vendor_click_1_5": {"input": 1.5, "output": 3.0},
    "vendor_error_1_5": {"input": 0.0, "output": 0.0},
}


def call_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """agent = event type, job = user (none for sign-ups), latency = value in ms."""
    k = F.get_json_object("props", "$.k").cast("int")
    failed = F.col("event_type") == "error"
    prompt = F.when(~failed, k * 17)
    completion = F.when(~failed, k + F.round("value").cast("int"))
    model = F.concat(F.lit("Vendor/"), F.col("event_type"), F.lit("-1.5"))
    return read_table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_type") != "signup", F.col("user_id").cast("string")).alias("job_id"),
        F.col("event_type").alias("agent"),
        model.alias("model"),
        prompt.alias("prompt_tokens"),
        completion.alias("completion_tokens"),
        call_cost(model, prompt, completion, PRICES).alias("cost"),
        F.when(k != 0, F.round(F.col("value") * 100).cast("int")).alias("latency_ms"),
        F.when(failed, "error").otherwise("ok").alias("outcome"),
    )


def job_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"))


# Costs are counted in micro-units, so that rounding half to even is exact.
CALLS_SQL = """
raw AS (
  SELECT *, regexp_extract(props, '([0-9]+)', 1)::BIGINT AS k FROM events),
priced AS (
  SELECT event_id, CASE WHEN event_type <> 'signup' THEN user_id::VARCHAR END AS job_id,
         event_type AS agent, 'Vendor/' || event_type || '-1.5' AS model,
         CASE WHEN event_type <> 'error' THEN k * 17 END AS prompt_tokens,
         CASE WHEN event_type <> 'error' THEN k + round(value)::BIGINT END AS completion_tokens,
         CASE WHEN k <> 0 THEN round(value * 100)::BIGINT END AS latency_ms,
         CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS outcome
  FROM raw),
hundredths AS (
  SELECT *, coalesce(prompt_tokens, 0) * CASE agent WHEN 'click' THEN 150 WHEN 'error' THEN 0 ELSE 25 END
    + coalesce(completion_tokens, 0) * CASE agent WHEN 'click' THEN 300 WHEN 'error' THEN 0 ELSE 100 END AS h
  FROM priced),
calls AS (
  SELECT * EXCLUDE (h), (CASE
      WHEN h % 100 > 50 OR (h % 100 = 50 AND (h // 100) % 2 = 1) THEN h // 100 + 1
      ELSE h // 100 END)::DECIMAL(18, 0) * 0.000001::DECIMAL(7, 6) AS cost
  FROM hundredths)"""
_CALLS = "WITH " + CALLS_SQL
_TOTALS = """
totals AS (
  SELECT count(*) AS calls, count(*) FILTER (WHERE outcome = 'ok') AS calls_ok,
         count(*) FILTER (WHERE outcome <> 'ok') AS calls_error,
         coalesce(sum(prompt_tokens), 0)::BIGINT AS prompt_tokens,
         coalesce(sum(completion_tokens), 0)::BIGINT AS completion_tokens,
         coalesce(sum(cost), 0)::DOUBLE AS cost_total,
         avg(latency_ms) AS latency_avg_ms, quantile_cont(latency_ms, 0.95)::DOUBLE AS latency_p95_ms
  FROM calls)"""


@query(
    _CALLS
    + ","
    + _TOTALS
    + """ SELECT calls, calls_ok, calls_error, prompt_tokens, completion_tokens,
        round(cost_total, 6) AS cost_total, round(latency_avg_ms, 6) AS latency_avg_ms,
        round(latency_p95_ms, 6) AS latency_p95_ms, round(calls_error / calls, 6) AS invalid_share,
        round(cost_total / calls, 9) AS cost_avg FROM totals"""
)
def call_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = acc.call_totals(call_table(spark, sf_dir))
    counts = ["calls", "calls_ok", "calls_error", "prompt_tokens", "completion_tokens"]
    return totals.select(
        *counts,
        *[
            F.round(F.col(c).cast("double"), 6).alias(c)
            for c in ("cost_total", "latency_avg_ms", "latency_p95_ms", "invalid_share")
        ],
        F.round("cost_avg", 9).alias("cost_avg"),
    )


def _priced(df: DataFrame) -> DataFrame:
    return df.withColumn("cost", F.round(F.col("cost").cast("double"), 6))


@query(_CALLS + " SELECT agent, count(*) AS calls, round(sum(cost)::DOUBLE, 6) AS cost FROM calls GROUP BY agent")
def calls_by_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _priced(acc.calls_by(call_table(spark, sf_dir), "agent"))


@query(_CALLS + " SELECT model, count(*) AS calls, round(sum(cost)::DOUBLE, 6) AS cost FROM calls GROUP BY model")
def calls_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _priced(acc.calls_by(call_table(spark, sf_dir), "model"))


@query(
    _CALLS
    + """, m AS (SELECT model, count(*) AS calls, round(sum(cost)::DOUBLE, 6) AS cost FROM calls GROUP BY model)
    SELECT model, calls, cost, row_number() OVER (ORDER BY cost DESC, model) AS position FROM m"""
)
def cost_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    ranked = _priced(acc.cost_by_model(call_table(spark, sf_dir)))
    # One row per model: the ranking window is tiny.
    order = Window.orderBy(F.desc("cost"), "model")
    return ranked.withColumn("position", F.row_number().over(order).cast("long"))


_USAGE = """count(*) AS calls, round(coalesce(sum(cost), 0)::DOUBLE, 6) AS cost,
    coalesce(sum(prompt_tokens), 0)::BIGINT AS prompt_tokens,
    coalesce(sum(completion_tokens), 0)::BIGINT AS completion_tokens"""


@query(_CALLS + f" SELECT job_id, {_USAGE} FROM calls WHERE job_id IS NOT NULL GROUP BY job_id")
def job_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _priced(acc.job_cost(call_table(spark, sf_dir)))


@query(_CALLS + f" SELECT {_USAGE} FROM calls WHERE job_id IS NULL")
def unattributed_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _priced(acc.unattributed_cost(call_table(spark, sf_dir)))


@query(_CALLS + " SELECT event_id, round(cost::DOUBLE, 6) AS cost FROM calls")
def call_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _priced(call_table(spark, sf_dir).select("event_id", "cost"))


@query('SELECT o_orderstatus AS status, count(*) AS "rows" FROM orders GROUP BY o_orderstatus')
def jobs_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acc.status_counts(job_table(spark, sf_dir))


@query("WITH " + DOCS_SQL.format(filter="") + ' SELECT status, count(*) AS "rows" FROM docs GROUP BY status')
def documents_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acc.status_counts(document_table(spark, sf_dir))


_EXPOSITION = """
agents AS (SELECT agent, count(*) AS calls, sum(cost)::DOUBLE AS cost FROM calls GROUP BY agent),
models AS (SELECT model, count(*) AS calls FROM calls GROUP BY model),
job_counts AS (SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1),
doc_counts AS (SELECT status, count(*) AS n FROM docs GROUP BY 1)
SELECT '# llm_calls' AS line
UNION ALL SELECT '# share of invalid model answers = llm_calls_error / llm_calls_total'
UNION ALL SELECT unnest(['llm_calls_total ' || calls, 'llm_calls_ok ' || calls_ok, 'llm_calls_error ' || calls_error,
  format('llm_calls_invalid_share {:.6f}', calls_error / calls), 'llm_prompt_tokens_total ' || prompt_tokens,
  'llm_completion_tokens_total ' || completion_tokens, format('llm_cost_total {:.6f}', cost_total),
  format('llm_cost_avg {:.6f}', cost_total / calls), format('llm_latency_ms_avg {:.1f}', latency_avg_ms),
  format('llm_latency_ms_p95 {:.1f}', latency_p95_ms)]) FROM totals
UNION ALL SELECT unnest(['llm_calls_by_agent{agent="' || agent || '"} ' || calls,
  'llm_cost_by_agent{agent="' || agent || '"} ' || format('{:.6f}', cost)]) FROM agents
UNION ALL SELECT 'llm_calls_by_model{model="' || model || '"} ' || calls FROM models
UNION ALL SELECT unnest(['# jobs', 'jobs_total ' || sum(n)]) FROM job_counts
UNION ALL SELECT 'jobs_total{status="' || status || '"} ' || n FROM job_counts
UNION ALL SELECT unnest(['# documents', 'documents_total ' || sum(n)]) FROM doc_counts
UNION ALL SELECT 'documents_total{status="' || status || '"} ' || n FROM doc_counts"""


@query("WITH " + DOCS_SQL.format(filter="") + "," + CALLS_SQL + "," + _TOTALS + "," + _EXPOSITION)
def metrics_exposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = acc.metrics_lines(
        call_table(spark, sf_dir), job_table(spark, sf_dir), document_table(spark, sf_dir)
    )
    return lines.select("line")


@query(
    """SELECT p_partkey, trim(regexp_replace(lower(p_brand || '/' || p_name || '-' || p_type || '.'), '[^a-z0-9]+', '_', 'g'), '_') AS price_key
    FROM part"""
)
def price_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("p_brand", F.lit("/"), "p_name", F.lit("-"), "p_type", F.lit("."))
    return read_table(spark, sf_dir, "part").select("p_partkey", price_key(name).alias("price_key"))
