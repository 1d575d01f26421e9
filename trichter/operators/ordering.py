"""Total, deterministic orders: nulls last, ties broken by entity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def by_entity() -> list[Column]:
    """Numeric order of the id where it is a number, then the id itself."""
    return [F.col("hotel_id").try_cast("bigint").asc_nulls_last(), F.col("hotel_id").asc_nulls_last()]


def ascending(*names: str) -> list[Column]:
    return [F.col(name).asc_nulls_last() for name in names]


def descending(*names: str) -> list[Column]:
    return [F.col(name).desc_nulls_last() for name in names]
