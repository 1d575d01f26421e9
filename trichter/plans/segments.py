"""Performance segments from quartiles of revenue, leads and bookings per lead."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trichter.functions.dates import with_period
from trichter.functions.numbers import money, or_zero, ratio, rounded
from trichter.operators.calendar import dense_grid, years_in
from trichter.operators.ordering import ascending, descending
from trichter.operators.rollup import VOLUMES, funnel_rollup, with_attributes
from trichter.operators.sharing import every_column
from trichter.operators.tiles import with_ntiles

# Lowest score of each segment, and the segment of entities without leads.
SEGMENTS = ((10, "1 Top Performer"), (8, "2 High Performer"), (6, "3 Potential / Optimize"))
LOWEST_SEGMENT = "4 Weak Performer"
GAP_SEGMENT = "5 Gap"

QUARTILES = {"revenue_q": "revenue_cents", "leads_q": "leads", "conversion_q": "conversion_rate"}


def entity_totals(
    spend: DataFrame, conversions: DataFrame, entities: DataFrame, by_year: bool = False
) -> DataFrame:
    """Zero-filled totals of every known entity, optionally for every year that occurs."""
    measures = [*VOLUMES, "cost_cents", "bookings", "revenue_cents"]
    if by_year:
        # The facts are summed first; the years that occur and the grid over them start from the sums.
        keys = ["hotel_id", "year"]
        summed = every_column(
            funnel_rollup(
                with_period(spend, "date", "year"), with_period(conversions, "booking_date", "year"), keys, full=True
            ).select(*keys, *measures)
        )
        grid = dense_grid(entities, years_in(summed), "year").withColumn("from_spine", F.lit(True))
        stacked = summed.unionByName(grid, allowMissingColumns=True)
        totals = stacked.groupBy(*keys).agg(
            *[F.sum(name).alias(name) for name in measures], F.max("from_spine").alias("from_spine")
        )
    else:
        keys = ["hotel_id"]
        spine = entities.where(F.col("hotel_id").isNotNull()).select("hotel_id")
        totals = funnel_rollup(spend, conversions, keys, spine)
    totals = totals.where("from_spine")
    return totals.select(*keys, *[or_zero(F.col(name)).alias(name) for name in measures]).withColumn(
        "conversion_rate", ratio(F.col("bookings"), F.col("leads"))
    )


def segment_entities(
    spend: DataFrame, conversions: DataFrame, entities: DataFrame, by_year: bool = False
) -> DataFrame:
    """Totals, quartiles (4 is best), score and segment; entities without leads form their own."""
    by = ["year"] if by_year else []
    totals = entity_totals(spend, conversions, entities, by_year).where("leads >= 0")
    tiled = with_ntiles(totals, 4, QUARTILES, "hotel_id", by, takes_part=F.col("leads") > 0)
    scored = tiled.withColumn("performance_score", F.col("revenue_q") + F.col("leads_q") + F.col("conversion_q"))
    segment = F.when(F.col("performance_score").isNull(), GAP_SEGMENT)
    for threshold, name in SEGMENTS:
        segment = segment.when(F.col("performance_score") >= threshold, name)
    labelled = scored.withColumns(
        {
            "segment_category": segment.otherwise(LOWEST_SEGMENT),
            "total_revenue": money(F.col("revenue_cents")),
        }
    )
    return (
        with_attributes(labelled, entities)
        .orderBy(
            *descending(*by),
            *ascending("segment_category"),
            *descending("performance_score", "total_revenue"),
            *ascending("hotel_id"),
        )
        .select(
            "hotel_id",
            *by,
            "country",
            "region",
            "hotel_category",
            F.col("impressions").alias("total_impressions"),
            F.col("clicks").alias("total_clicks"),
            F.col("leads").alias("total_leads"),
            money(F.col("cost_cents")).alias("total_cost"),
            F.col("bookings").alias("total_bookings"),
            "total_revenue",
            rounded(F.col("conversion_rate"), 4).alias("conversion_rate"),
            *QUARTILES,
            "performance_score",
            "segment_category",
        )
    )
