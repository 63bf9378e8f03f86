"""Reads behind a service: listings, point lookups and a job with its coverage.

The key predicates reach the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.operators.contract import cited_chunks, source_coverage


def list_documents(documents: DataFrame) -> DataFrame:
    """All documents in order of creation."""
    return documents.select("doc_id", "filename", "kind", "status", "chunks_count", "created_at").orderBy(
        "created_at", "doc_id"
    )


def get_document(documents: DataFrame, doc_id: str) -> DataFrame:
    return documents.filter(F.col("doc_id") == doc_id)


def get_jobs(jobs: DataFrame, chunks: DataFrame, job_id: str | None = None) -> DataFrame:
    """Jobs with ``source_coverage`` derived next to the stored card; NULL without one."""
    wanted = jobs if job_id is None else jobs.filter(F.col("job_id") == job_id)
    coverage = F.when(
        F.col("card").isNotNull(), F.round(source_coverage(F.col("card"), F.col("cited")), 3)
    )
    return cited_chunks(wanted, chunks).withColumn("source_coverage", coverage).drop("cited")


def get_trace(traces: DataFrame, job_id: str) -> DataFrame:
    """The steps of one job in order."""
    return traces.filter(F.col("job_id") == job_id).orderBy("position")
