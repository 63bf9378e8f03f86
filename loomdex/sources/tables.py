"""Stored tables: bucketed by document, clustered by lexeme."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_bucketed(
    df: DataFrame, name: str, buckets: int, key: str = "doc_id", path: str | None = None, sort: bool = True
) -> DataFrame:
    """Parquet table bucketed and sorted by ``key``, read back: chunks, vectors,
    postings and documents stored alike join on it without a shuffle."""
    writer = df.write.mode("overwrite").format("parquet").bucketBy(buckets, key)
    if sort:
        writer = writer.sortBy(key)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def save_corpus(tables: dict[str, DataFrame], prefix: str, buckets: int, path: str) -> dict[str, DataFrame]:
    """Chunks, vectors and documents in equal buckets of ``doc_id``, so that a change of
    a document's status, or its deletion, rewrites the small table of documents only and
    searches join it bucket by bucket: no vector or text is shuffled. The files are below
    ``path``; ``drop_corpus`` forgets the tables and ``open_corpus`` finds them again."""
    return {name: save_bucketed(df, f"{prefix}_{name}", buckets, path=f"{path}/{name}") for name, df in tables.items()}


def open_corpus(spark: SparkSession, prefix: str, names: Iterable[str]) -> dict[str, DataFrame]:
    return {name: spark.table(f"{prefix}_{name}") for name in names}


def drop_corpus(spark: SparkSession, prefix: str, names: Iterable[str]) -> None:
    """Forget the tables; their files stay below the path they were saved to."""
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {prefix}_{name}")


def save_postings(index: DataFrame, path: str, files: int) -> None:
    """Postings clustered by lexeme: a search reads only the row groups whose
    statistics cover its lexemes. Hot lexemes span several files."""
    clustered = index.repartitionByRange(files, "lexeme", "chunk_id").sortWithinPartitions("lexeme", "chunk_id")
    clustered.write.mode("overwrite").parquet(path)
