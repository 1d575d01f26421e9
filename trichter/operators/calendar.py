"""Calendars seen in the data and dense entity grids.

A calendar is one array value, computed by a one-row aggregate and read as a scalar subquery;
exploding it per entity builds the grid without a cross join or a broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


MOST_MONTHS = 1200


def month_calendar(spend: DataFrame, conversions: DataFrame, most_months: int = MOST_MONTHS) -> DataFrame:
    """One row, one column ``calendar``: every month from the first to the last day in either fact."""
    days = spend.select(F.col("date").alias("day")).unionAll(
        conversions.select(F.col("booking_date").alias("day"))
    )
    return months_between(days, "day", most_months)


def months_between(df: DataFrame, day: str, most_months: int = MOST_MONTHS) -> DataFrame:
    """The calendar from the first to the last ``day`` of ``df``.

    More than ``most_months`` months fail: one stray date would multiply every grid.
    """
    bounds = df.agg(F.trunc(F.min(day), "MM").alias("first"), F.trunc(F.max(day), "MM").alias("last"))
    too_long = F.concat(
        F.lit(f"the calendar is longer than {most_months} months: "), F.col("first").cast("string"), F.lit(" to "), F.col("last").cast("string")
    )
    months = F.sequence("first", "last", F.expr("interval 1 month"))
    fits = F.months_between("last", "first") < most_months
    return bounds.select(F.when(F.col("first").isNull() | fits, months).otherwise(F.raise_error(too_long)).alias("calendar"))


def month_spine(spend: DataFrame, conversions: DataFrame) -> DataFrame:
    """The same calendar as rows of ``month``."""
    return month_calendar(spend, conversions).select(F.explode("calendar").alias("month"))


def years_in(totals: DataFrame) -> DataFrame:
    """One row, one column ``calendar``: the values of ``year`` that occur in ``totals``."""
    return totals.agg(F.collect_set("year").alias("calendar"))


def dense_grid(entities: DataFrame, calendar: DataFrame, name: str) -> DataFrame:
    """Every known entity at every calendar entry: ``hotel_id`` and ``name``."""
    entries: Column = calendar.select("calendar").scalar()
    return entities.where(F.col("hotel_id").isNotNull()).select("hotel_id", F.explode(entries).alias(name))
