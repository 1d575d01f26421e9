"""Runs of equal labels in an ordered series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_runs(df: DataFrame, keys: Sequence[str], label: str, order: str) -> DataFrame:
    """Number the runs per key: ``run_id`` starts at 1 and rises by one wherever the label changes.

    A change flag and its running sum need only the (keys, order) sort that the caller's other
    windows already use.
    """
    series = Window.partitionBy(*keys).orderBy(order)
    # A struct is null only where there is no previous row, even if a label is null.
    boxed = F.struct(label)
    starts = F.when(boxed.eqNullSafe(F.lag(boxed).over(series)), 0).otherwise(1)
    return (
        df.withColumn("_starts", starts)
        .withColumn("run_id", F.sum("_starts").over(series.rowsBetween(Window.unboundedPreceding, 0)))
        .drop("_starts")
    )


def with_run_lengths(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Add ``run_length`` and ``run_position`` (1-based); both share one sort."""
    run = Window.partitionBy(*keys, "run_id").orderBy(order)
    return df.withColumns(
        {
            "run_length": F.count(F.lit(1)).over(run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
            "run_position": F.row_number().over(run).cast("long"),
        }
    )
