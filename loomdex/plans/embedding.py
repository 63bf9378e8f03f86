"""Vectors from a pluggable embedding model, batch by batch inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Task prefixes of the embedding model, and texts per call.
QUERY_PREFIX = "task: search result | query: "
DOCUMENT_PREFIX = "task: search result | title: none | text: "
BATCH = 256
STORED_DECIMALS = 6


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[tuple[int, list[float]]]:
        """(index, vector) per text, in any order."""


class EmbeddingError(RuntimeError):
    pass


def embed_batch(embedder: Embedder, texts: list[str], prefix: str) -> list[list[float]]:
    """Unit vectors in input order. A wrong number of answers is an error; a zero
    vector stays as the model gave it."""
    if not texts:
        return []
    answers = sorted(embedder.embed([prefix + t for t in texts]), key=lambda a: a[0])
    if len(answers) != len(texts):
        raise EmbeddingError(f"{len(answers)} vectors for {len(texts)} texts")
    matrix = np.array([v for _, v in answers], dtype=np.float64)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return (matrix / np.where(norms == 0, 1.0, norms)).tolist()


def embed_texts(
    df: DataFrame,
    make_embedder: Callable[[], Embedder],
    *,
    id_column: str,
    text_column: str = "text",
    prefix: str = DOCUMENT_PREFIX,
    output: str = "embedding",
    keep_errors: bool = False,
) -> DataFrame:
    """``(id, [doc_id,] embedding, error)``; one model per task, ``BATCH`` texts per call.

    A failed call fails the job, unless ``keep_errors``: then its rows come back
    with a NULL vector and the error, never with a zero vector.
    """
    keys = [c for c in (id_column, "doc_id") if c in df.columns]
    source = df.select(*dict.fromkeys(keys), text_column)
    keys = source.columns[:-1]
    schema = T.StructType(
        [
            *[source.schema[k] for k in keys],
            T.StructField(output, T.ArrayType(T.FloatType())),
            T.StructField("error", T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedder = make_embedder()
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                texts = part.column(text_column).to_pylist()
                error = None
                try:
                    vectors = embed_batch(embedder, texts, prefix)
                    vectors = [np.round(v, STORED_DECIMALS).tolist() for v in vectors]
                except Exception as exc:
                    if not keep_errors:
                        raise
                    vectors, error = [None] * len(texts), f"embedding: {exc!r}"
                yield pa.RecordBatch.from_arrays(
                    [part.column(k) for k in keys]
                    + [
                        pa.array(vectors, type=pa.list_(pa.float32())),
                        pa.array([error] * len(texts), type=pa.string()),
                    ],
                    names=[*keys, output, "error"],
                )

    return source.mapInArrow(run, schema)
