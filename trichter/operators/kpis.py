"""Funnel KPIs from summed stages, and their comparison across two periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trichter.functions.numbers import money, or_zero, ratio


def with_kpis(df: DataFrame) -> DataFrame:
    """Add money columns and unrounded ctr, cpc, lr, cpl, roas, aov and bookings_per_lead.

    Every ratio is null where its denominator is 0 or absent; absent revenue counts as 0.
    """
    cost = money(F.col("cost_cents"))
    revenue = money(or_zero(F.col("revenue_cents")))
    return df.withColumns(
        {
            "cost": cost,
            "revenue": money(F.col("revenue_cents")),
            "ctr": ratio(F.col("clicks"), F.col("impressions")),
            "cpc": ratio(cost, F.col("clicks")),
            "lr": ratio(F.col("leads"), F.col("clicks")),
            "cpl": ratio(cost, F.col("leads")),
            "roas": ratio(revenue, cost),
            "aov": ratio(revenue, F.col("bookings")),
            "bookings_per_lead": ratio(or_zero(F.col("bookings")), F.col("leads")),
        }
    )


def pivot_periods(
    df: DataFrame,
    period: str,
    suffixes: dict[object, str],
    columns: Sequence[str],
    keys: Sequence[str] = (),
) -> DataFrame:
    """One row per key (or one row in all) with ``<column>_<suffix>`` for each period value.

    Expects at most one row per key and period.
    """

    def at(column: str, value: object) -> Column:
        return F.max(F.when(F.col(period) == F.lit(value), F.col(column)))

    return df.groupBy(*keys).agg(
        *[at(c, value).alias(f"{c}_{suffix}") for c in columns for value, suffix in suffixes.items()]
    )
