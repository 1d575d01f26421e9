"""Entities whose cost rises while their leads fall over three consecutive months."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trichter.functions.numbers import money, ratio, rounded
from trichter.operators.ordering import ascending, descending
from trichter.operators.rollup import with_attributes
from trichter.plans.monthly import spend_monthly


def diverging_windows(spend: DataFrame, strict: bool = True) -> DataFrame:
    """All three-month windows that qualify, with their unrounded score.

    ``strict`` asks for a monotone move in both steps, otherwise only the end points count.
    A missing month breaks a window.
    """
    series = Window.partitionBy("hotel_id").orderBy("month")
    windows = spend_monthly(spend).select(
        "hotel_id",
        *[
            F.lag(name, 3 - step).over(series).alias(f"{name}_{step}")
            for name in ("month", "cost_cents", "leads")
            for step in (1, 2)
        ],
        F.col("month").alias("month_3"),
        F.col("cost_cents").alias("cost_cents_3"),
        F.col("leads").alias("leads_3"),
    )
    c1, c2, c3 = (F.col(f"cost_cents_{step}") for step in (1, 2, 3))
    l1, l2, l3 = (F.col(f"leads_{step}") for step in (1, 2, 3))
    consecutive = (F.col("month_2") == F.add_months("month_3", -1)) & (F.col("month_1") == F.add_months("month_3", -2))
    if strict:
        diverging = (c1 < c2) & (c2 < c3) & (l1 > l2) & (l2 > l3)
    else:
        diverging = (c3 > c1) & (l3 < l1)
    rise = ratio(money(c3) - money(c1), money(c1))
    drop = ratio(l1 - l3, l1)
    return windows.where(consecutive & diverging).withColumns(
        {
            "rise": rise,
            "drop": drop,
            "score": F.coalesce(rise, F.lit(0.0)) + F.coalesce(drop, F.lit(0.0)),
        }
    )


def rising_cost_falling_leads(
    spend: DataFrame, entities: DataFrame, strict: bool = True, top_n: int = 10
) -> DataFrame:
    """The worst window of each entity, the ``top_n`` worst entities."""
    score = "ano_score_pct" if strict else "ano_score"
    worst = Window.partitionBy("hotel_id").orderBy(*descending("score"), *ascending("month_3"))
    picked = (
        diverging_windows(spend, strict)
        .withColumn("place", F.row_number().over(worst))
        .where(F.col("place") == 1)
        .withColumn(score, rounded(F.col("score"), 4))
        .orderBy(*descending(score), *ascending("hotel_id", "month_3"))
        .limit(top_n)
    )
    return (
        with_attributes(picked, entities)
        .orderBy(*descending(score), *ascending("hotel_id", "month_3"))
        .select(
            "hotel_id",
            "country",
            "region",
            "hotel_category",
            "month_1",
            "month_2",
            "month_3",
            *[money(F.col(f"cost_cents_{step}")).alias(f"cost_month_{step}") for step in (1, 2, 3)],
            *[F.col(f"leads_{step}").alias(f"leads_month_{step}") for step in (1, 2, 3)],
            money(F.col("cost_cents_3") - F.col("cost_cents_1")).alias("abs_cost_increase"),
            (F.col("leads_1") - F.col("leads_3")).alias("abs_leads_drop"),
            rounded(F.col("rise"), 4).alias("pct_cost_increase"),
            rounded(F.col("drop"), 4).alias("pct_leads_drop"),
            score,
        )
    )
