"""Session builder and the helpers every plan shares."""

from __future__ import annotations

import os
import tempfile
import uuid
from types import ModuleType

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "loomdex", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the plans rely on.

    ``maxBytesPerBatch`` keeps Arrow batches small when rows carry whole
    documents or long vectors; skew handling stays on because a third of all
    rows may share one key.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(64 * 1024 * 1024))
        .config("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_with_tasks(*modules: ModuleType) -> None:
    """Send the package's functions with the tasks that call them, so that the
    workers need no installed copy; ``modules`` adds a caller's own."""
    import loomdex

    for module in (loomdex, *modules):
        cloudpickle.register_pickle_by_value(module)


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new folder below the cluster's shared one, ``spark.checkpoint.dir``; only a
    session on one machine (tests) gets one where that is unset."""
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", "") or context.getCheckpointDir()
    if not shared:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="loomdex-ckpt-"))
        shared = context.getCheckpointDir()
    return f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the cluster's shared folder.

    Used after every stage whose output must not be computed twice (model
    answers).
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(os.path.dirname(scratch_folder(df.sparkSession, "checkpoint")))
    return df.checkpoint(eager=True)


def read_table(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(base_dir, f"{name}.parquet"))
