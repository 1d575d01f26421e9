"""Rounding, ratios and exact money."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column, digits: int) -> Column:
    """Scale, round half away from zero, scale back.

    ``F.round(value, digits)`` rounds the printed decimal instead, so 1.005 would give 1.01;
    thresholds and rankings act on rounded values, so the two must not be mixed.
    """
    scale = float(10**digits)
    return F.round(value.cast("double") * scale, 0) / scale


def ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator`` as double, null where the denominator is 0."""
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


def pct_change(new: Column, old: Column) -> Column:
    """Relative change from ``old`` to ``new`` in percent, 2 decimals, null where ``old`` is 0."""
    return rounded(ratio(new.cast("double") - old.cast("double"), old) * 100, 2)


def or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def cents(amount: Column) -> Column:
    """An amount as whole cents.

    Sums of longs are exact and independent of row order, and cheaper than sums of wide
    decimals; ANSI mode raises on overflow instead of wrapping.
    """
    return (amount.cast("decimal(18,2)") * 100).cast("long")


def money(total_cents: Column) -> Column:
    """Cents back to a currency amount."""
    return total_cents.cast("double") / 100.0
