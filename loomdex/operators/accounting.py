"""Usage, latency and cost of model calls, and status counts.

``calls`` follows ``schemas.CALLS``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.functions.text import escape_label, ratio

QUANTILE = 0.95


def _sum(column: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0))


def _added_up() -> list[Column]:
    """What is added up of calls, in any grouping."""
    return [
        F.count("*").alias("calls"),
        F.count_if(F.col("outcome") == "ok").alias("calls_ok"),
        F.count_if(F.col("outcome") != "ok").alias("calls_error"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("cost").alias("cost_total"),
    ]


def _totals_of(per_latency: DataFrame, *keys: str) -> DataFrame:
    """Totals, latencies and shares out of rows that are added up per latency value."""
    timed = F.col("latency_ms").isNotNull()
    weighted = F.sum(F.when(timed, F.col("latency_ms").cast("long") * F.col("calls")))
    names = ("calls", "calls_ok", "calls_error", "prompt_tokens", "completion_tokens", "cost_total")
    totals = per_latency.groupBy(*keys).agg(
        *[_sum(name).alias(name) for name in names],
        (weighted / F.nullif(F.sum(F.when(timed, F.col("calls"))), F.lit(0))).alias("latency_avg_ms"),
        F.percentile("latency_ms", F.lit(QUANTILE), F.when(timed, F.col("calls")).otherwise(F.lit(0))).alias("latency_p95_ms"),
    )
    shares = {"invalid_share": ratio(F.col("calls_error"), F.col("calls")), "cost_avg": ratio(F.col("cost_total").cast("double"), F.col("calls"))}
    return totals.withColumns(shares)


def call_totals(calls: DataFrame) -> DataFrame:
    """One row of totals with the exact 95th percentile of the latency.

    Calls are first added up per latency value. Latencies are whole milliseconds
    below the call timeout, so the second step, the only one in a single task,
    reads a bounded histogram and never the calls themselves.
    """
    return _totals_of(calls.groupBy("latency_ms").agg(*_added_up()))


def calls_by(calls: DataFrame, dimension: str) -> DataFrame:
    """Calls and cost per agent or model, most called first."""
    grouped = calls.groupBy(dimension).agg(F.count("*").alias("calls"), _sum("cost").alias("cost"))
    return grouped.orderBy(F.desc("calls"), dimension)


def cost_by_model(calls: DataFrame) -> DataFrame:
    """Calls and cost per model, most expensive first."""
    grouped = calls.groupBy("model").agg(F.count("*").alias("calls"), F.sum("cost").alias("cost"))
    return grouped.orderBy(F.desc_nulls_first("cost"), "model")


def _usage(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("*").alias("calls"),
        _sum("cost").alias("cost"),
        _sum("prompt_tokens").alias("prompt_tokens"),
        _sum("completion_tokens").alias("completion_tokens"),
    )


def job_cost(calls: DataFrame) -> DataFrame:
    """Calls, cost and tokens of every job."""
    return _usage(calls.filter(F.col("job_id").isNotNull()), "job_id")


def unattributed_cost(calls: DataFrame) -> DataFrame:
    """Calls, cost and tokens of the calls outside any job, in one row."""
    return _usage(calls.filter(F.col("job_id").isNull()))


def status_counts(table: DataFrame) -> DataFrame:
    return table.groupBy("status").agg(F.count("*").alias("rows")).orderBy("status")


def metrics_lines(calls: DataFrame, jobs: DataFrame, documents: DataFrame) -> DataFrame:
    """``(section, key, position, line)``: the text exposition of all metrics, one
    snapshot: every input is scanned once, in grouping sets."""
    return _call_lines(calls).unionByName(_status_lines({"jobs": jobs, "documents": documents}))


CALL_VALUES = (
    ("llm_calls_total", "%d", "calls"),
    ("llm_calls_ok", "%d", "calls_ok"),
    ("llm_calls_error", "%d", "calls_error"),
    ("llm_calls_invalid_share", "%.6f", "invalid_share"),
    ("llm_prompt_tokens_total", "%d", "prompt_tokens"),
    ("llm_completion_tokens_total", "%d", "completion_tokens"),
    ("llm_cost_total", "%.6f", "cost_total"),
    ("llm_cost_avg", "%.6f", "cost_avg"),
    ("llm_latency_ms_avg", "%.1f", "latency_avg_ms"),
    ("llm_latency_ms_p95", "%.1f", "latency_p95_ms"),
)


def _printed(form: str, column: str) -> Column:
    value = F.col(column).cast("long" if form == "%d" else "double")
    return F.format_string(form, F.coalesce(value, F.lit(0)))


def _labelled(metric: str, label: str, form: str, column: str) -> Column:
    return F.concat(F.lit(f'{metric}{{{label}="'), escape_label(F.col("key")), F.lit('"} '), _printed(form, column))


def _rendered(rows: DataFrame, sections: list[tuple[Column, Column, list[Column]]]) -> DataFrame:
    """The lines of each row by the first condition that it meets: (condition, section, lines)."""
    (condition, section, lines), *more = sections
    named, listed = F.when(condition, section), F.when(condition, F.array(*lines))
    for condition, section, lines in more:
        named, listed = named.when(condition, section), listed.when(condition, F.array(*lines))
    return rows.select(named.alias("section"), "key", F.posexplode(listed).alias("position", "line"))


def _with_empty_row(df: DataFrame) -> DataFrame:
    """One more row of nulls, so that totals exist for an empty table."""
    return df.union(df.sparkSession.range(1).select(*[F.lit(None).cast(f.dataType) for f in df.schema]))


def _call_lines(calls: DataFrame) -> DataFrame:
    dimensions = ("latency_ms", "agent", "model")
    sets = calls.groupingSets([[d] for d in dimensions], *dimensions)
    # A row belongs to the one dimension that is not grouped away.
    own = [F.when(F.grouping(d) == 0, F.lit(d)) for d in dimensions]
    grouped = _with_empty_row(sets.agg(F.coalesce(*own).alias("kind"), *_added_up()))
    kind = F.coalesce("kind", F.lit("latency_ms"))
    key = F.when(kind == "agent", F.col("agent")).when(kind == "model", F.col("model"))
    grouped = grouped.withColumns({"kind": kind, "key": F.coalesce(key, F.lit(""))})
    totals = _totals_of(grouped, "kind", "key")
    head = ["# llm_calls", "# share of invalid model answers = llm_calls_error / llm_calls_total"]
    lines = [F.lit(x) for x in head] + [F.concat(F.lit(f"{name} "), _printed(form, column)) for name, form, column in CALL_VALUES]
    agents = [_labelled("llm_calls_by_agent", "agent", "%d", "calls"), _labelled("llm_cost_by_agent", "agent", "%.6f", "cost_total")]
    return _rendered(
        totals,
        [
            (F.col("kind") == "latency_ms", F.lit("1-calls"), lines),
            (F.col("kind") == "agent", F.lit("2-agents"), agents),
            (F.col("kind") == "model", F.lit("3-models"), [_labelled("llm_calls_by_model", "model", "%d", "calls")]),
        ],
    )


def _status_lines(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for number, (name, table) in enumerate(tables.items()):
        sets = table.groupingSets([["status"], []], "status")
        counts = _with_empty_row(sets.agg(F.grouping("status").alias("whole"), F.count("*").alias("rows")))
        # The empty row belongs to the total.
        whole = F.coalesce("whole", F.lit(1)) == 1
        counts = counts.groupBy(whole.alias("whole"), F.coalesce("status", F.lit("")).alias("key")).agg(_sum("rows").alias("rows"))
        head = [F.lit(f"# {name}"), F.concat(F.lit(f"{name}_total "), _printed("%d", "rows"))]
        each = [_labelled(f"{name}_total", "status", "%d", "rows")]
        lines = _rendered(counts, [(F.col("whole"), F.lit(f"{4 + 2 * number}-{name}"), head), (~F.col("whole"), F.lit(f"{5 + 2 * number}-{name}-status"), each)])
        out = lines if out is None else out.unionByName(lines)
    return out


def render_metrics(calls: DataFrame, jobs: DataFrame, documents: DataFrame) -> str:
    """The exposition as one text, for whoever serves it."""
    rows = metrics_lines(calls, jobs, documents).orderBy("section", "key", "position").collect()
    return "\n".join(r["line"] for r in rows) + "\n"
