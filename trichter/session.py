"""Spark session defaults and durable intermediate results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "trichter", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every analysis assumes.

    Cluster sizing (executors, shuffle partitions, broadcast threshold) is left to the
    deployment; adaptive execution adjusts partition counts, join types and skew at run time.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Analyses that run side by side share the cores; a session with one job at a time sees no difference.
        .config("spark.scheduler.mode", "FAIR")
        # Recording the Python call site of every column expression doubles planning time.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and continue from the written copy."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder that all executors reach, below the session's checkpoint folder."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpoint_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, set from ``spark.checkpoint.dir`` where it is not yet.

    Only a local-mode session may fall back to a temporary folder: on a cluster that folder
    would vanish with its machine.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="trichter-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()
