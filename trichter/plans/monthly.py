"""Monthly KPIs per entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trichter.functions.dates import month_text, with_period
from trichter.functions.numbers import money, ratio, rounded
from trichter.operators.ordering import by_entity, descending
from trichter.operators.rollup import spend_by, with_attributes


def spend_monthly(spend: DataFrame) -> DataFrame:
    """Sums per entity and month, cost in cents."""
    return spend_by(with_period(spend, "date", "month"), ["hotel_id", "month"])


def monthly_kpis(spend: DataFrame, entities: DataFrame) -> DataFrame:
    """Volumes, cost, ctr, cpc and leads per click for every entity and month, latest month first."""
    cost = money(F.col("cost_cents"))
    return (
        with_attributes(spend_monthly(spend), entities)
        .orderBy(*descending("month"), *by_entity())
        .select(
            month_text(F.col("month")).alias("month"),
            "hotel_id",
            "country",
            "region",
            "hotel_category",
            "impressions",
            "clicks",
            "leads",
            cost.alias("cost"),
            rounded(ratio(F.col("clicks"), F.col("impressions")), 4).alias("ctr"),
            rounded(ratio(cost, F.col("clicks")), 2).alias("cpc"),
            rounded(ratio(F.col("leads"), F.col("clicks")), 4).alias("conversion_rate"),
        )
    )
