"""Cost, leads and revenue of two years side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trichter.functions.dates import in_iso_years, in_years, month_name, with_period
from trichter.functions.numbers import money, or_zero
from trichter.operators.kpis import pivot_periods
from trichter.operators.rollup import funnel_rollup

MEASURES = ("cost_cents", "leads", "revenue_cents")


def _side_by_side(spend: DataFrame, conversions: DataFrame, year: str, step: str, years: tuple[int, int]) -> DataFrame:
    totals = funnel_rollup(spend, conversions, [year, step], bookings=False)
    return pivot_periods(totals, year, {y: str(y) for y in years}, MEASURES, [step])


def _filled(pivoted: DataFrame, step: str, label: str, years: tuple[int, int]) -> DataFrame:
    return pivoted.orderBy(step).select(
        F.col(step).alias(label),
        *[
            (or_zero(F.col(f"{m}_{y}")) if m == "leads" else money(or_zero(F.col(f"{m}_{y}")))).alias(
                f"{m.removesuffix('_cents')}_{y}"
            )
            for m in MEASURES
            for y in years
        ],
    )


def compare_monthly_series(spend: DataFrame, conversions: DataFrame, years: tuple[int, int]) -> DataFrame:
    """Twelve rows, one per calendar month; months without data are 0."""
    pivoted = _side_by_side(
        with_period(spend.where(in_years(F.col("date"), years)), "date", "year", "month_number"),
        with_period(
            conversions.where(in_years(F.col("booking_date"), years)), "booking_date", "year", "month_number"
        ),
        "year",
        "month_number",
        years,
    )
    months = spend.sparkSession.range(1, 13, numPartitions=1).withColumnRenamed("id", "month_number")
    return _filled(months.join(pivoted, "month_number", "left"), "month_number", "month", years)


def compare_weekly_series(spend: DataFrame, conversions: DataFrame, years: tuple[int, int]) -> DataFrame:
    """One row per ISO week that occurs, by ISO year, so the turn of the year stays in one week."""
    pivoted = _side_by_side(
        with_period(spend.where(in_iso_years(F.col("date"), years)), "date", "iso_year", "iso_week"),
        with_period(
            conversions.where(in_iso_years(F.col("booking_date"), years)), "booking_date", "iso_year", "iso_week"
        ),
        "iso_year",
        "iso_week",
        years,
    )
    return _filled(pivoted, "iso_week", "week", years)


def with_month_name(series: DataFrame) -> DataFrame:
    """A monthly series with English month names beside the numbers, ready for an axis."""
    return series.withColumn("month_name", month_name(F.col("month")))
