"""The corpus pipeline: five stages over ``documents``.

Each stage reads what its predecessor wrote to the shared folder and judges it anew
(the near-duplicate groups, for example, are those of the documents that are left).
All but the last return the columns of ``documents``; a row is dropped by its id and
text together, so rows that repeat an id are judged by their own texts.

Cases: as in the operators. Rows without id are kept or dropped like others, but stand
for no group, except that one of equal texts without any id stays. Of near copies that
share the least id of their component, or that all lack one, every row stays. Extra columns are carried along, except that the last stage's own names
replace columns of the same name. An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.llm.common import free_names, maybe_broadcast, new_folder, staged, table, without
from loomdex.llm.decontaminate import find_contamination
from loomdex.llm.exact_dedup import exact_dedup
from loomdex.llm.ngram_join import join_similar
from loomdex.llm.piece_encoding import encode_pieces
from loomdex.llm.quality import score_quality

MODEL = "piece_bpe_32k.model"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    judged = score_quality(docs, table(spark, sf_dir, "labels"))
    return without(docs, judged.filter("predicted = 0"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one row stays: that with the largest doc_id, and of several with
    that id (or of texts without any) that with the largest hash of its text as
    written, then of all its columns."""
    copies = staged(exact_dedup(docs).filter("group_size > 1").select("doc_id", "kept", "text_sha256", "text_hash"), "copies")
    written = copies.filter("kept").groupBy("text_sha256", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    chosen = written.groupBy("text_sha256").agg(F.max("text_hash").alias("chosen"))
    written = staged(written.join(chosen, "text_sha256"), "written")
    other = written.filter("text_hash <> chosen").select("doc_id", "text_hash")
    left = without(docs, copies.filter("NOT kept").select("doc_id", "text_hash").union(other))
    return one_of_each(left, written.filter("text_hash = chosen AND n > 1"))


def one_of_each(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """One row for each (doc_id, text_hash) of ``repeated``; other rows stay as they are."""
    own_id, own_hash = free_names(docs, "own_id", "own_hash")
    names = repeated.select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash))
    if names.isEmpty():
        return docs
    same = docs["doc_id"].eqNullSafe(F.col(own_id)) & (F.xxhash64(docs["text"]) == F.col(own_hash))
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    rows = docs.join(maybe_broadcast(names), same).select(F.col(own_id).alias("own_id"), F.col(own_hash).alias("own_hash"), row.alias("row"))
    first = rows.groupBy("own_id", "own_hash").agg(F.max_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return without(docs, repeated).union(first.select("row.*"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a component of similar texts (five words, 0.8), the least doc_id stays."""
    return without(docs, join_similar(docs).filter("doc_id <> component_id OR (doc_id IS NULL AND component_id IS NOT NULL)"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, found.filter("contaminated"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with ids, n_tokens and the SHA-256 of the decoded text."""
    keep = tuple(c for c in docs.columns if c not in ("ids", "decoded", "n_tokens", "decoded_sha256"))
    coded = encode_pieces(docs, public_tokenizers.path(MODEL), keep=keep)
    return coded.select(*keep, "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding", encode),
]

# Trained scores, set similarity over components and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        path = new_folder(spark, f"pipeline-{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
