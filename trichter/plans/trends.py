"""Moving-average trends, their runs, and snapshots of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trichter.functions.dates import with_period
from trichter.functions.numbers import money, or_zero, ratio, rounded
from trichter.operators.calendar import dense_grid, months_between
from trichter.operators.islands import with_run_lengths, with_runs
from trichter.operators.ordering import ascending, by_entity, descending
from trichter.operators.rollup import funnel_rollup, with_attributes
from trichter.operators.sharing import every_column

# Trend labels as they appear in the results.
NOT_POSSIBLE = "Trend not possible"
INCREASING = "increasing"
DECREASING = "decreasing"
LEADS_UP = "leads increase, revenue decrease"
LEADS_DOWN = "leads decrease, revenue increase"
MIXED = "stable/mixed"


SERIES = ["entity_number", "hotel_id"]


def labelled_months(
    spend: DataFrame, conversions: DataFrame, entities: DataFrame, window: int = 3, in_order: bool = False
) -> DataFrame:
    """Zero-filled entity-month series with trailing frame sums and the trend label.

    ``in_order`` lays the series out by ranges of entities instead of hashes, so that a caller
    that returns all of it in entity order needs no further shuffle.
    """
    totals = every_column(  # read twice, for the series and for its calendar
        funnel_rollup(
            with_period(spend, "date", "month"),
            with_period(conversions, "booking_date", "month"),
            ["hotel_id", "month"],
            bookings=False,
            full=True,  # rows without an entity count for the calendar; the grid leaves them out
        ).select("hotel_id", "month", "leads", "revenue_cents")
    ).withColumn("in_grid", F.lit(False))
    grid = dense_grid(entities, months_between(totals, "month"), "month").withColumn("in_grid", F.lit(True))
    stacked = totals.unionByName(grid, allowMissingColumns=True).withColumn(
        "entity_number", F.col("hotel_id").try_cast("bigint")
    )
    # Totals and grid meet on the partitioning the windows need, so the grid is shuffled once and
    # filling it costs no join. Facts of unknown entities meet no grid row and drop out.
    placed = stacked.repartitionByRange(*ascending(*SERIES)) if in_order else stacked.repartition(*SERIES)
    monthly = (
        placed.groupBy(*SERIES, "month")
        .agg(
            or_zero(F.sum("leads")).alias("leads"),
            or_zero(F.sum("revenue_cents")).alias("revenue_cents"),
            F.max("in_grid").alias("in_grid"),
        )
        .where("in_grid")
        .drop("in_grid")
    )
    series = Window.partitionBy(*SERIES).orderBy("month")

    def back(name: str, rows: int) -> Column:
        return or_zero(F.lag(name, rows).over(series)) if rows else F.col(name)

    def total(name: str, first: int) -> Column:
        return reduce(lambda a, b: a + b, [back(name, first + i) for i in range(window)])

    # Offsets share one window pass; a sliding frame would be summed anew for every row.
    return monthly.withColumns(
        {
            "row": F.row_number().over(series),
            "leads_sum": total("leads", 0),
            "leads_sum_before": total("leads", 1),
            "revenue_sum": total("revenue_cents", 0),
            "revenue_sum_before": total("revenue_cents", 1),
            "leads_left": back("leads", window),
            "revenue_left": back("revenue_cents", window),
        }
    ).withColumn("trend", _label(window))


def _label(window: int) -> Column:
    """Compares trailing averages. Two neighbouring full frames differ by the month that enters
    and the month that leaves, so comparing these two whole numbers decides it exactly."""
    leads, leads_left = F.col("leads"), F.col("leads_left")
    revenue, revenue_left = F.col("revenue_cents"), F.col("revenue_left")
    return (
        F.when(F.col("row") <= window, NOT_POSSIBLE)
        .when((leads > leads_left) & (revenue > revenue_left), INCREASING)
        .when((leads < leads_left) & (revenue < revenue_left), DECREASING)
        .when((leads > leads_left) & (revenue < revenue_left), LEADS_UP)
        .when((leads < leads_left) & (revenue > revenue_left), LEADS_DOWN)
        .otherwise(MIXED)
    )


def trend_runs(
    spend: DataFrame, conversions: DataFrame, entities: DataFrame, window: int = 3, in_order: bool = False
) -> DataFrame:
    """``labelled_months`` with the run each month belongs to."""
    labelled = labelled_months(spend, conversions, entities, window, in_order)
    return with_runs(labelled, SERIES, "trend", "month")


def _averages(window: int) -> dict[str, Column]:
    """Rounded averages and their change; frames are shorter in the first rows."""
    size = F.least(F.col("row"), F.lit(window))
    size_before = F.least(F.col("row") - 1, F.lit(window))
    leads, leads_before = ratio(F.col("leads_sum"), size), ratio(F.col("leads_sum_before"), size_before)
    revenue = ratio(money(F.col("revenue_sum")), size)
    revenue_before = ratio(money(F.col("revenue_sum_before")), size_before)
    return {
        "leads_3m_mov_av": rounded(leads, 2),
        "revenue_3m_mov_av": rounded(revenue, 2),
        "leads_3m_diff_abs": rounded(leads - leads_before, 2),
        "revenue_3m_diff_abs": rounded(revenue - revenue_before, 2),
        "leads_3m_diff_pct": rounded(ratio(leads - leads_before, leads_before), 2),
        "revenue_3m_diff_pct": rounded(ratio(revenue - revenue_before, revenue_before), 2),
    }


def moving_average_trends(
    spend: DataFrame, conversions: DataFrame, entities: DataFrame, window: int = 3, min_run: int = 3
) -> DataFrame:
    """Every entity and month with averages, run length, position in the run and the sustained trend."""
    runs = with_run_lengths(
        trend_runs(spend, conversions, entities, window, in_order=True), SERIES, "month"
    )
    sustained = (
        F.when(F.col("trend") == NOT_POSSIBLE, NOT_POSSIBLE)
        .when(
            F.col("run_length") >= min_run,
            F.concat("trend", F.lit(" (Phase of "), F.col("run_length").cast("string"), F.lit(" months)")),
        )
        .otherwise(f"No sustaining trend (< {min_run} months)")
    )
    return (
        with_attributes(runs, entities)
        .orderBy(*ascending(*SERIES), "month")
        .select(
            "month",
            "hotel_id",
            "country",
            "region",
            "hotel_category",
            "leads",
            money(F.col("revenue_cents")).alias("revenue"),
            *[column.alias(name) for name, column in _averages(window).items()],
            F.col("run_length").alias("total_months_in_current_trend"),
            F.col("run_position").alias("current_month_in_trend"),
            sustained.alias("consecutive_trend"),
        )
    )


def longest_trend_runs(
    spend: DataFrame, conversions: DataFrame, entities: DataFrame, window: int = 3
) -> DataFrame:
    """The longest run of each label over all entities; ties are all kept.

    The record per label is an aggregate of at most five rows, joined back, instead of a rank
    over the label: one label may hold most runs, which a rank would gather in one task.
    """
    runs = (
        trend_runs(spend, conversions, entities, window)
        .where(F.col("trend") != NOT_POSSIBLE)
        .groupBy(*SERIES, "run_id", "trend")
        .agg(
            F.count(F.lit(1)).alias("total_months_in_trend"),
            F.min("month").alias("trend_start"),
            F.max("month").alias("trend_end"),
        )
    )
    records = runs.groupBy("trend").agg(F.max("total_months_in_trend").alias("total_months_in_trend"))
    best = runs.join(F.broadcast(records), ["trend", "total_months_in_trend"])
    return (
        with_attributes(best, entities)
        .orderBy("total_months_in_trend", *by_entity(), "trend_start")
        .select("hotel_id", "country", "trend", "total_months_in_trend", "trend_start", "trend_end")
    )


def month_snapshot_trend(
    spend: DataFrame, conversions: DataFrame, entities: DataFrame, month: int = 12, window: int = 3
) -> DataFrame:
    """The trend of one calendar month in every year, strongest combined change first."""
    averages = _averages(window)
    snapshot = labelled_months(spend, conversions, entities, window).where(F.month("month") == month)
    scored = snapshot.withColumns(
        {name: averages[name] for name in averages if "_diff_" in name}
    ).withColumn(
        "trend_score_pct",
        rounded(
            F.coalesce("leads_3m_diff_pct", F.lit(0.0)) + F.coalesce("revenue_3m_diff_pct", F.lit(0.0)), 2
        ),
    )
    return (
        with_attributes(scored, entities)
        .orderBy(*descending("month", "trend_score_pct"), *ascending("hotel_id"))
        .select(
            "month",
            "hotel_id",
            "country",
            "region",
            "hotel_category",
            F.col("trend").alias("trend_3M_mov_av"),
            "leads_3m_diff_abs",
            "revenue_3m_diff_abs",
            "leads_3m_diff_pct",
            "revenue_3m_diff_pct",
            "trend_score_pct",
        )
    )
