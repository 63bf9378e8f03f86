"""Documents and jobs as append-only facts; current state is an aggregate.

"First" and "last" are ``min``/``max_by`` over a sequence number, which combine
map-side, so a key with very many rows costs no more than one with few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def new_id(*parts: Column) -> Column:
    """Twelve hex characters that depend only on the parts."""
    return F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 12)


def first_of_group(rows: DataFrame, group: str, seq: str, payload: list[str], count: str) -> DataFrame:
    """One row per group: the payload of its least ``seq`` and its rows as ``count``.

    The aggregate holds numbers only, so it is a hash aggregate; the payload comes by
    a join with the rows that were first. Of rows that repeat the first one's number one
    gives the payload; all are counted.
    """
    least = rows.groupBy(group).agg(F.min(seq).alias(seq), F.count(F.lit(1)).alias(count))
    first = rows.select(group, seq, *payload).join(least, [group, seq])
    return first.dropDuplicates([group, seq])


def register_uploads(uploads: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """``(content_hash, doc_id, filename, kind, first_seq, copies, created)`` per
    distinct content of ``uploads`` (seq, filename, kind, content).

    The first upload of a content names the document; content already in
    ``existing`` (content_hash, doc_id) keeps its document and is not created.
    """
    hashed = uploads.select("seq", "filename", "kind", F.sha2(F.col("content"), 256).alias("content_hash"))
    first = first_of_group(hashed, "content_hash", "seq", ["filename", "kind"], "copies")
    fresh = first.select(
        "content_hash",
        new_id(F.col("content_hash")).alias("new_doc_id"),
        "filename",
        "kind",
        F.col("seq").alias("first_seq"),
        "copies",
    )
    if existing is None:
        known = fresh.withColumn("doc_id", F.lit(None).cast("string"))
    else:
        known = fresh.join(existing.select("content_hash", "doc_id"), "content_hash", "left")
    return (
        known.withColumn("created", F.col("doc_id").isNull())
        .withColumn("doc_id", F.coalesce("doc_id", "new_doc_id"))
        .drop("new_doc_id")
    )


def create_jobs(requests: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """``(job_id, idempotency_key, seq, payload, requests, created)``: one job per
    key, one per request without a key.

    Requests that repeat a key of ``existing`` (job_id, idempotency_key) or of an
    earlier request get that job and create none.
    """
    no_key = F.coalesce(F.col("idempotency_key"), F.lit("")) == ""
    group = F.when(no_key, F.concat(F.lit("request:"), F.col("seq").cast("string"))).otherwise(
        F.concat(F.lit("key:"), F.col("idempotency_key"))
    )
    grouped = requests.select("seq", "idempotency_key", "payload", group.alias("job_group"))
    jobs = first_of_group(grouped, "job_group", "seq", ["idempotency_key", "payload"], "requests").select(
        new_id(F.col("job_group")).alias("new_job_id"), "idempotency_key", "seq", "payload", "requests"
    )
    if existing is None:
        known = jobs.withColumn("job_id", F.lit(None).cast("string"))
    else:
        old = existing.filter(F.col("idempotency_key").isNotNull()).select("job_id", "idempotency_key")
        known = jobs.join(old, "idempotency_key", "left")
    return (
        known.withColumn("created", F.col("job_id").isNull())
        .withColumn("job_id", F.coalesce("job_id", "new_job_id"))
        .drop("new_job_id")
    )


def current_state(
    events: DataFrame, key: str, always: list[str], keep_last: list[str], bump: Column | None = None
) -> DataFrame:
    """Latest state per key of an event log (key, seq, ...).

    ``always`` columns take the value of the last event, even NULL; ``keep_last``
    columns the last value that was set. ``bump`` counts into ``attempts``.
    """
    columns = [F.max_by(c, "seq").alias(c) for c in always]
    columns += [
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in keep_last
    ]
    if bump is not None:
        columns.append(F.count_if(bump).alias("attempts"))
    return events.groupBy(key).agg(*columns)


def pending_chunks(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks without a vector."""
    return chunks.join(vectors.select("chunk_id"), "chunk_id", "left_anti")


def reconcile_indexed(documents: DataFrame, pending: DataFrame) -> DataFrame:
    """Documents with their status lifted to ``indexed`` and the error cleared, where
    the status was embed_failed or parsing and no chunk lacks a vector. A document
    without chunks lacks none."""
    waiting = pending.select("doc_id").distinct().withColumn("_waiting", F.lit(True))
    lifted = F.col("status").isin("embed_failed", "parsing") & F.col("_waiting").isNull()
    return (
        documents.join(waiting, "doc_id", "left")
        .withColumn("error", F.when(lifted, F.lit(None)).otherwise(F.col("error")))
        .withColumn("status", F.when(lifted, "indexed").otherwise(F.col("status")))
        .drop("_waiting")
    )


def mark_suspicious(chunks: DataFrame, flagged: DataFrame) -> DataFrame:
    """Chunks with ``suspicious`` raised for the flagged ids; a raised flag stays."""
    flags = flagged.select("chunk_id").distinct().withColumn("_flag", F.lit(True))
    raised = F.coalesce("suspicious", F.lit(False)) | F.col("_flag").isNotNull()
    return chunks.join(flags, "chunk_id", "left").withColumn("suspicious", raised).drop("_flag")


def upsert_vectors(vectors: DataFrame, updates: DataFrame) -> DataFrame:
    """Stored vectors with the updated chunks replaced or added."""
    kept = vectors.join(updates.select("chunk_id"), "chunk_id", "left_anti")
    return kept.unionByName(updates.select(*vectors.columns))
