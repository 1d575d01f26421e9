"""Entities with the most volatile monthly leads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trichter.functions.numbers import money, ratio, rounded
from trichter.operators.ordering import ascending, descending
from trichter.operators.rollup import with_attributes
from trichter.plans.monthly import spend_monthly


def lead_spread(spend: DataFrame, by_year: bool = False) -> DataFrame:
    """Spread of monthly leads per entity (and year), with the weakest and strongest month.

    ``min_by``/``max_by`` find both months within the same aggregation; the earlier month wins
    a tie, months without a lead figure come last.
    """
    keys = ["hotel_id", "year"] if by_year else ["hotel_id"]
    monthly = spend_monthly(spend).withColumn("year", F.year("month").cast("long"))
    at = F.struct("month", "leads", "cost_cents")
    low = F.min_by(at, F.struct(F.col("leads").isNull(), "leads", "month"))
    high = F.max_by(at, F.struct(F.col("leads").isNotNull(), "leads", -F.unix_date("month")))
    return (
        monthly.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("months"),
            F.sum("leads").alias("total_leads"),
            F.avg("leads").alias("mean"),
            F.stddev_samp("leads").alias("sd"),
            F.min("leads").alias("min_monthly_leads"),
            F.max("leads").alias("max_monthly_leads"),
            low.alias("low"),
            high.alias("high"),
        )
        .withColumns(
            {
                "avg_monthly_leads": rounded(F.col("mean"), 2),
                "sd_monthly_leads": rounded(F.col("sd"), 2),
                "cv_leads": rounded(ratio(F.col("sd"), F.col("mean")), 4),
            }
        )
    )


def lead_volatility(spend: DataFrame, entities: DataFrame, by_year: bool = False, top_n: int = 5) -> DataFrame:
    """The ``top_n`` entities by coefficient of variation, overall or within each year."""
    by = ["year"] if by_year else []
    order = [*descending("cv_leads", "sd_monthly_leads"), *ascending("hotel_id")]
    spread = lead_spread(spend, by_year)
    if not by_year:
        spread = spread.orderBy(*order).limit(top_n)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    top = spread.withColumn("volatility_rank", rank.cast("long")).where(F.col("volatility_rank") <= top_n)
    return (
        with_attributes(top, entities)
        .orderBy(*by, "volatility_rank")
        .select(
            "volatility_rank",
            "hotel_id",
            "country",
            "region",
            "hotel_category",
            *by,
            "months",
            "total_leads",
            "avg_monthly_leads",
            "sd_monthly_leads",
            "cv_leads",
            "min_monthly_leads",
            "max_monthly_leads",
            (F.col("max_monthly_leads") - F.col("min_monthly_leads")).alias("range_leads"),
            F.col("low.month").alias("min_month"),
            F.col("low.leads").alias("min_leads"),
            money(F.col("low.cost_cents")).alias("cost_at_min"),
            F.col("high.month").alias("max_month"),
            F.col("high.leads").alias("max_leads"),
            money(F.col("high.cost_cents")).alias("cost_at_max"),
        )
    )
