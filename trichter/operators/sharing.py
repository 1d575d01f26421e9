"""Let several readers of the same rows share one exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LOWEST_INT = -(2**31)


def every_column(df: DataFrame) -> DataFrame:
    """``df`` behind a filter that holds for every row and mentions every column.

    Two readers of an aggregate that need different columns get it pruned in two ways, so Spark
    computes it twice, scans included. Readers that need the same columns share its exchange.
    """
    return df.where(F.hash(*df.columns) >= _LOWEST_INT)
