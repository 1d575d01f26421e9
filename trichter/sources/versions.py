"""Which version of a set of stored tables is current, as an append-only Parquet table of versions.

A version becomes current by one committed row, written after all of its files. A job that fails
before that row leaves the version before it as it was.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "number bigint, version string, published timestamp"


def version_folder(path: str, version: str) -> str:
    return f"{path.rstrip('/')}/versions/{version}"


def version_log(spark: SparkSession, path: str) -> DataFrame | None:
    """All published versions below ``path``, or none if nothing was ever published there."""
    try:
        return spark.read.schema(SCHEMA).parquet(f"{path.rstrip('/')}/version_log")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def current_version(spark: SparkSession, path: str) -> str | None:
    """The version published last; of two published at once the one of the larger name."""
    log = version_log(spark, path)
    row = None if log is None else log.orderBy(F.desc("number"), F.desc("version")).first()
    return None if row is None else row.version


def make_current(spark: SparkSession, path: str, version: str) -> None:
    log = version_log(spark, path)
    number = 0 if log is None else (log.agg(F.max("number")).first()[0] or 0)
    row = spark.range(1).select(
        F.lit(number + 1).cast("bigint").alias("number"),
        F.lit(version).alias("version"),
        F.current_timestamp().alias("published"),
    )
    row.coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/version_log")
