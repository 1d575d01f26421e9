"""Two periods compared: overall, per entity, and month by month for one entity."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trichter.functions.dates import in_years, month_text, with_period
from trichter.functions.numbers import money, or_zero, pct_change, ratio, rounded
from trichter.operators.kpis import pivot_periods, with_kpis
from trichter.operators.ordering import ascending, by_entity
from trichter.operators.rollup import funnel_rollup, with_attributes

MEASURES = ("cost_cents", "leads", "bookings", "revenue_cents")


def _yearly(spend: DataFrame, conversions: DataFrame, keys: list[str], years: tuple[int, int]) -> DataFrame:
    return funnel_rollup(
        with_period(spend.where(in_years(F.col("date"), years)), "date", "year"),
        with_period(conversions.where(in_years(F.col("booking_date"), years)), "booking_date", "year"),
        [*keys, "year"],
        full=bool(keys),
    )


def _compared(years: tuple[int, int], bookings_ratio: str) -> list[Column]:
    """Seven KPIs, each as two yearly values and the change in percent."""

    def kpis(y: int) -> dict[str, tuple[Column, int | None]]:
        leads, bookings = F.col(f"leads_{y}"), F.col(f"bookings_{y}")
        cost, revenue = money(F.col(f"cost_cents_{y}")), money(F.col(f"revenue_cents_{y}"))
        return {
            "cost": (cost, 2),
            "leads": (leads, None),
            "cost_per_lead": (ratio(cost, leads), 2),
            "bookings": (bookings, None),
            "revenue": (revenue, 2),
            "roas": (ratio(revenue, cost), 2),
            bookings_ratio: (ratio(bookings, leads), 4),
        }

    old, new = kpis(years[0]), kpis(years[1])
    columns = []
    for name in old:
        for y, (value, digits) in zip(years, (old[name], new[name])):
            columns.append((value if digits is None else rounded(value, digits)).alias(f"{name}_{y}"))
        columns.append(pct_change(new[name][0], old[name][0]).alias(f"{name}_change_pct"))
    return columns


def executive_summary(spend: DataFrame, conversions: DataFrame, years: tuple[int, int]) -> DataFrame:
    """One row over all entities. A year counts only if it has spend."""
    yearly = (
        _yearly(spend, conversions, [], years)
        .where("from_spend")
        .withColumn("revenue_cents", or_zero(F.col("revenue_cents")))
    )
    pivoted = pivot_periods(yearly, "year", {y: str(y) for y in years}, MEASURES)
    return pivoted.select(*_compared(years, "bookings_per_lead"))


def entity_year_comparison(
    spend: DataFrame,
    conversions: DataFrame,
    entities: DataFrame,
    years: tuple[int, int],
    entity_id: str | None = None,
) -> DataFrame:
    """The same KPIs for one entity, or for every entity with activity in either year.

    A year with bookings but no spend, or the reverse, keeps its figures and counts the rest as 0.
    Over all entities, rows without an entity stay as an entity of null.
    """
    if entity_id is not None:
        spend = spend.where(F.col("hotel_id") == entity_id)
        conversions = conversions.where(F.col("hotel_id") == entity_id)
    yearly = _yearly(spend, conversions, ["hotel_id"], years).select(
        "hotel_id", "year", *[or_zero(F.col(name)).alias(name) for name in MEASURES]
    )
    pivoted = pivot_periods(yearly, "year", {y: str(y) for y in years}, MEASURES, ["hotel_id"])
    return (
        with_attributes(pivoted, entities)
        .orderBy(*by_entity())
        .select("hotel_id", "region", "country", *_compared(years, "conversion_rate"))
    )


def entity_period_kpis(
    spend: DataFrame,
    conversions: DataFrame,
    entities: DataFrame,
    entity_id: str,
    start: date,
    end: date,
    compare: tuple[date, date],
) -> DataFrame:
    """Monthly KPIs of one entity from ``start`` to before ``end``, then one row of changes in
    percent between the two months of ``compare`` (null where a month has no data)."""

    def sliced(df: DataFrame, day: str) -> DataFrame:
        inside = (F.col("hotel_id") == entity_id) & (F.col(day) >= F.lit(start)) & (F.col(day) < F.lit(end))
        return with_period(df.where(inside), day, "month")

    monthly = (
        with_kpis(
            funnel_rollup(sliced(spend, "date"), sliced(conversions, "booking_date"), ["hotel_id", "month"])
        )
        .where("from_spend")
        .withColumn("bookings", F.when(F.col("from_conversions"), F.col("bookings")))
    )
    names = ["impressions", "clicks", "leads", "cost", "ctr_pct", "cpc", "lead_rate_pct", "cost_per_lead"]
    names += ["bookings", "revenue", "roas", "conversion_rate"]

    def row(values: list[Column], sort_order: int, text: Column) -> list[Column]:
        return [
            F.col("hotel_id"),
            text.alias("zeitraum"),
            *[value.cast("double").alias(name) for name, value in zip(names, values)],
            F.lit(sort_order).cast("long").alias("sort_order"),
        ]

    figures = [
        F.col("impressions"),
        F.col("clicks"),
        F.col("leads"),
        rounded(F.col("cost"), 2),
        rounded(F.col("ctr") * 100, 2),
        rounded(F.col("cpc"), 2),
        rounded(F.col("lr") * 100, 2),
        rounded(F.col("cpl"), 2),
        F.col("bookings"),
        rounded(F.col("revenue"), 2),
        rounded(F.col("roas"), 2),
        rounded(F.col("bookings_per_lead"), 4),
    ]
    detail = monthly.select(*row(figures, 1, month_text(F.col("month"))))

    measures = ["impressions", "clicks", "leads", "cost", "bookings", "revenue"]
    pivoted = pivot_periods(monthly, "month", {compare[0]: "old", compare[1]: "new"}, measures, ["hotel_id"])

    def changed(numerator: str, denominator: str | None = None) -> Column:
        def value(side: str) -> Column:
            top = F.col(f"{numerator}_{side}")
            return top if denominator is None else ratio(top, F.col(f"{denominator}_{side}"))

        return pct_change(value("new"), value("old"))

    changes = [
        changed("impressions"),
        changed("clicks"),
        changed("leads"),
        changed("cost"),
        changed("clicks", "impressions"),
        changed("cost", "clicks"),
        changed("leads", "clicks"),
        changed("cost", "leads"),
        changed("bookings"),
        changed("revenue"),
        changed("revenue", "cost"),
        changed("bookings", "leads"),
    ]
    title = F.lit(f"CHANGE ({compare[0]:%B} vs {compare[1]:%B} %)")
    summary = pivoted.select(*row(changes, 2, title))
    return (
        with_attributes(detail.unionByName(summary), entities)
        .orderBy(*ascending("sort_order", "zeitraum", "hotel_id"))
        .select("hotel_id", "region", "country", "zeitraum", *names, "sort_order")
    )
