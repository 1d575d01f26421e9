"""Entity-months whose KPIs deviate from the entity's own history, with a likely reason."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trichter.functions.dates import with_period
from trichter.functions.numbers import or_zero, ratio, rounded
from trichter.operators.kpis import with_kpis
from trichter.operators.ordering import ascending, descending
from trichter.operators.rollup import funnel_rollup, with_attributes

# Each KPI with the sign of its bad direction.
BAD_DIRECTION = {"ctr": -1, "cpc": 1, "lr": -1, "cpl": 1, "roas": -1, "aov": -1}
THRESHOLD = 2.0
PAIR_THRESHOLD = 1.5
# KPIs that must all be off, label, reason; the first match counts.
CAUSES = (
    (("roas", "cpl"), "ROAS drop, high CPL", "Efficiency Collapse"),
    (("ctr", "cpc"), "low CTR, high CPC", "Ad Crisis"),
    (("roas",), "poor ROAS", "Unprofitable campaigns"),
    (("aov",), "AOV drop", "Very low revenue per booking (customer value sinking)"),
    (("cpl",), "high CPL", "Expensive customer acquisition"),
    (("cpc",), "high CPC", "High CPC"),
    (("ctr",), "low CTR", "Interest Drop"),
    (("lr",), "low lead rate", "Lead Conversion Crisis"),
)
OTHER_CAUSE = "Anomalous combination in performance metrics"
OTHER_REASON = "Anomalous Combination in Performance Metrics"
DIGITS = {"cost": 2, "revenue": 2, "ctr": 4, "cpc": 2, "lr": 4, "cpl": 2, "roas": 2, "aov": 2}


def _off(kpi: str, threshold: float) -> Column:
    sign = BAD_DIRECTION[kpi]
    z = F.col(f"z_{kpi}")
    return z >= threshold if sign > 0 else z <= -threshold


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _first_cause(position: int, other: str) -> Column:
    chain = None
    for cause in CAUSES:
        condition = _all([_off(kpi, THRESHOLD) for kpi in cause[0]])
        chain = F.when(condition, cause[position]) if chain is None else chain.when(condition, cause[position])
    return chain.otherwise(other)


def kpi_zscores(spend: DataFrame, conversions: DataFrame, by_year: bool = False) -> DataFrame:
    """Monthly KPIs with rounded z-scores against the entity's own months (of the same year).

    Only months with impressions, clicks, leads and cost count. The window is ordered by month
    although it spans the whole group, so that sums run in the same order on every layout.
    """
    active = (F.col("impressions") > 0) & (F.col("clicks") > 0) & (F.col("leads") > 0) & (F.col("cost_cents") > 0)
    months = with_kpis(
        funnel_rollup(
            with_period(spend, "date", "month"),
            with_period(conversions, "booking_date", "month"),
            ["hotel_id", "month"],
        ).where(active)
    ).withColumn("revenue", or_zero(F.col("revenue")))
    months = months.withColumn("year", F.year("month").cast("long"))
    group = ["hotel_id", "year"] if by_year else ["hotel_id"]
    history = (
        Window.partitionBy(*group)
        .orderBy("month")
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return months.withColumns(
        {
            f"z_{kpi}": rounded(
                ratio(F.col(kpi) - F.avg(kpi).over(history), F.stddev_samp(kpi).over(history)), 2
            )
            for kpi in BAD_DIRECTION
        }
    )


def flag_anomalies(scores: DataFrame) -> DataFrame:
    """Rows whose rounded z-scores pass a threshold, with score, label and reason."""
    flagged = reduce(lambda a, b: a | b, [_off(kpi, THRESHOLD) for kpi in BAD_DIRECTION]) | (
        _off("roas", PAIR_THRESHOLD) & _off("cpl", PAIR_THRESHOLD)
    )
    score = sum(F.greatest(F.lit(0.0), sign * F.col(f"z_{kpi}")) for kpi, sign in BAD_DIRECTION.items())
    return scores.where(flagged).withColumns(
        {
            "anomaly_score": rounded(score, 2),
            "anomaly": _first_cause(1, OTHER_CAUSE),
            "reason": _first_cause(2, OTHER_REASON),
        }
    )


def detect_anomalies(
    spend: DataFrame,
    conversions: DataFrame,
    entities: DataFrame,
    by_year: bool = False,
    top_n: int = 15,
) -> DataFrame:
    """The ``top_n`` highest scores, overall with their rank or within each year."""
    flagged = flag_anomalies(kpi_zscores(spend, conversions, by_year))
    severity = [*descending("anomaly_score"), *ascending("month", "hotel_id")]
    if by_year:
        place = F.row_number().over(Window.partitionBy("year").orderBy(*severity))
        top = flagged.withColumn("place", place).where(F.col("place") <= top_n)
        lead, order = "year", [*descending("year"), F.col("place")]
    else:
        # Numbering follows the limit, so the unpartitioned window sees top_n rows only.
        top = flagged.orderBy(*severity).limit(top_n)
        top = top.withColumn("anomaly_rank", F.row_number().over(Window.orderBy(*severity)).cast("long"))
        lead, order = "anomaly_rank", [F.col("anomaly_rank")]
    return (
        with_attributes(top, entities)
        .orderBy(*order)
        .select(
            lead,
            "hotel_id",
            "country",
            "region",
            "hotel_category",
            "month",
            "leads",
            rounded(F.col("cost"), 2).alias("cost"),
            "bookings",
            *[rounded(F.col(name), digits).alias(name) for name, digits in DIGITS.items() if name != "cost"],
            *[f"z_{kpi}" for kpi in BAD_DIRECTION],
            "anomaly_score",
            "anomaly",
            "reason",
        )
    )
