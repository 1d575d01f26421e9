"""Aggregate both facts to a common grain.

``funnel_rollup`` stacks the facts under one schema and aggregates the stack, instead of
aggregating each and joining the results: one shuffle chain on the grain keys, no join, no
sort, and map-side partial aggregation so that a very frequent key costs each task one row
per grain key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trichter.functions.dates import with_period
from trichter.functions.numbers import cents
from trichter.sources.schemas import ATTRIBUTES, MONEY

VOLUMES = ("impressions", "clicks", "leads")
BOOKED = "booked"  # marks the rows of the rollup of bookings that have a booking id


def spend_by(spend: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sums of impressions, clicks, leads and cost (in cents) per key."""
    return spend.groupBy(*keys).agg(
        *[F.sum(name).alias(name) for name in VOLUMES],
        F.sum(cents(F.col("cost"))).alias("cost_cents"),
    )


def conversions_by(conversions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exact distinct bookings and revenue (in cents) per key.

    Spark first groups by key and booking id, so a hot key is spread over its bookings.
    """
    return conversions.groupBy(*keys).agg(
        F.countDistinct("booking_id").alias("bookings"),
        F.sum(cents(F.col("revenue"))).alias("revenue_cents"),
    )


def funnel_rollup(
    spend: DataFrame,
    conversions: DataFrame,
    keys: Sequence[str],
    spine: DataFrame | None = None,
    bookings: bool = True,
    full: bool = False,
) -> DataFrame:
    """Both facts at the grain of ``keys``, optionally with a spine of keys that must appear.

    ``from_spend``, ``from_conversions`` and ``from_spine`` tell where a key occurs, which
    expresses any outer join afterwards as a filter: keep ``from_spend`` for a left join from
    spend, ``from_spine`` for a dense grid. As in an equi-join, a conversion row with a null key then
    matches nothing and is left out. With ``full`` such rows stay, as a full join keeps them, in
    the group of the null key.

    Conversions are first reduced to one row per key and booking id, so that distinct bookings
    are a plain count in the final aggregate and spend rows skip that shuffle. Callers that
    need no bookings skip it as well, and so does the rollup of bookings at its own grain, where
    its rows are the distinct bookings.
    """
    revenue_cents = cents(F.col("revenue")).alias("revenue_cents")
    has_keys = reduce(lambda a, b: a & b, [F.col(key).isNotNull() for key in keys])
    matching = conversions if full else conversions.where(has_keys)
    if bookings and BOOKED in conversions.columns and set(keys) == {"hotel_id", "month"}:
        sales = matching.select(*keys, F.when(F.col(BOOKED), F.lit("")).alias("booking_id"), revenue_cents)
    elif bookings:
        sales = matching.select(*keys, "booking_id", revenue_cents).groupBy(*keys, "booking_id")
        sales = sales.agg(F.sum("revenue_cents").alias("revenue_cents"))
    else:
        sales = matching.select(*keys, revenue_cents)
    parts = [
        spend.select(*keys, *VOLUMES, cents(F.col("cost")).alias("cost_cents"), F.lit(True).alias("from_spend")),
        sales.withColumn("from_conversions", F.lit(True)),
    ]
    flags = ["from_spend", "from_conversions"]
    if spine is not None:
        parts.append(spine.select(*keys, F.lit(True).alias("from_spine")))
        flags.append("from_spine")
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.groupBy(*keys).agg(
        *[F.sum(name).alias(name) for name in (*VOLUMES, "cost_cents", "revenue_cents")],
        *([F.count("booking_id").alias("bookings")] if bookings else []),
        *[F.coalesce(F.max(name), F.lit(False)).alias(name) for name in flags],
    )


def compact_spend(spend: DataFrame) -> DataFrame:
    """The spend fact reduced to one row per entity and month, still shaped like a spend fact.

    All sums are exact, so every analysis at month grain or coarser gives the same result on
    this frame as on the raw fact, at a fraction of the scan.
    """
    monthly = spend_by(with_period(spend, "date", "month"), ["hotel_id", "month"])
    return monthly.select(
        "hotel_id",
        F.col("month").alias("date"),
        *VOLUMES,
        _amount("cost_cents").alias("cost"),
    )


def compact_revenue(conversions: DataFrame) -> DataFrame:
    """The conversion fact reduced to revenue per entity and month, still shaped like a conversion
    fact. For analyses that use no bookings: distinct bookings do not add up across rows."""
    monthly = (
        with_period(conversions, "booking_date", "month")
        .groupBy("hotel_id", "month")
        .agg(F.sum(cents(F.col("revenue"))).alias("revenue_cents"))
    )
    return monthly.select(
        "hotel_id", F.col("month").alias("booking_date"), _amount("revenue_cents").alias("revenue")
    )


def compact_bookings(conversions: DataFrame) -> DataFrame:
    """The conversion fact reduced to one row per entity, month and booking id, still shaped like a
    conversion fact.

    Distinct bookings per month do not add up to those of a year, their ids do: every analysis at
    month grain or coarser counts the same bookings on this frame as on the raw fact. A booking id
    is part of the key, so a hot entity is spread over its bookings. Rows without a booking id keep
    their revenue, and are not ``booked``.
    """
    monthly = (
        with_period(conversions, "booking_date", "month")
        .groupBy("hotel_id", "month", "booking_id")
        .agg(F.sum(cents(F.col("revenue"))).alias("revenue_cents"))
    )
    return monthly.select(
        "booking_id",
        "hotel_id",
        F.col("month").alias("booking_date"),
        _amount("revenue_cents").alias("revenue"),
        F.col("booking_id").isNotNull().alias(BOOKED),
    )


def _amount(cents_column: str) -> Column:
    # Multiplied: a division of decimals takes several times as long.
    return (F.col(cents_column).cast("decimal(20,0)") * F.lit("0.01").cast("decimal(2,2)")).cast(MONEY)


def with_attributes(df: DataFrame, entities: DataFrame) -> DataFrame:
    """Left-join the entity attributes. No broadcast hint: the dimension may grow, so the choice
    is left to Spark's own size check, with a shuffled join beyond the threshold."""
    return df.join(entities.select("hotel_id", *ATTRIBUTES), "hotel_id", "left")
