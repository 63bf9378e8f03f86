"""Upload scans: batch and streaming, with the acceptance rules as columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.settings import DEFAULTS, Settings

# Accepted extensions, and the answer codes of rejected uploads.
KINDS = {"pdf": "pdf", "docx": "docx", "xlsx": "xlsx"}
UNSUPPORTED, TOO_LARGE, EMPTY = 415, 413, 400

BINARY_SCHEMA = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """Every file below a folder; ``content`` is read only if a plan uses it."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def stream_files(spark: SparkSession, path: str) -> DataFrame:
    """The same as an unbounded source that picks up new files."""
    return (
        spark.readStream.format("binaryFile")
        .schema(BINARY_SCHEMA)
        .option("recursiveFileLookup", "true")
        .load(path)
    )


def classify_uploads(files: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Adds filename, kind and ``rejected`` (NULL, or the answer code).

    The rules use only the file's name and length, so no rejected file is read.
    """
    filename = F.element_at(F.split("path", "/"), -1)
    extension = F.lower(F.regexp_extract(filename, r"\.([^.]+)$", 1))
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    kind = F.try_element_at(kinds, extension)
    rejected = (
        F.when(kind.isNull(), UNSUPPORTED)
        .when(F.col("length") > settings.upload_max_bytes, TOO_LARGE)
        .when(F.col("length") == 0, EMPTY)
    )
    return (
        files.withColumn("filename", filename).withColumn("kind", kind).withColumn("rejected", rejected)
    )


def golden_records(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """Golden records by file, and the files evaluated by default."""
    import json

    from loomdex.schemas import GOLDEN

    text = "\n".join(r["value"] for r in spark.read.option("wholetext", "true").text(path).collect())
    content = json.loads(text)
    rows = [json.dumps({"file": f, **r}, ensure_ascii=False) for f, r in content["documents"].items()]
    frame = spark.createDataFrame([(r,) for r in rows], "record STRING")
    parsed = frame.select(F.from_json("record", GOLDEN).alias("g")).select("g.*")
    return parsed, content.get("eval_defaults", [])
