"""Every operator and analysis as a query over the star-schema test tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trichter.functions.dates import with_period
from trichter.functions.numbers import money, rounded
from trichter.operators import quality
from trichter.operators.calendar import dense_grid, month_calendar, month_spine
from trichter.operators.cleaning import clean_table, clean_tables, repair_tables
from trichter.operators.date_formats import chosen_formats, date_format_counts
from trichter.operators.questions import filter_result, intent_counts, tag_intent, with_slots
from trichter.operators.rollup import conversions_by, funnel_rollup
from trichter.operators.tiles import with_ntiles
from trichter.plans.anomalies import kpi_zscores
from trichter.plans.catalogue import ANALYSES, ON_MONTHLY_BOOKINGS, Params, run_catalogue
from trichter.plans.catalogue import query as run
from trichter.plans.comparison import entity_year_comparison
from trichter.plans.divergence import diverging_windows
from trichter.plans.monthly import spend_monthly
from trichter.plans.segments import entity_totals
from trichter.plans.series import with_month_name
from trichter.plans.trends import SERIES, trend_runs
from trichter.plans.volatility import lead_spread
from trichter.session import shared_folder
from trichter.sources import schemas
from trichter.sources.colocated import load_colocated, publish_colocated
from trichter.sources.rejects import read_csv_with_rejects
from trichter.sources.star import (
    booking_lines,
    dated_star_bookings,
    faulty_star_tables,
    questions,
    read_star,
    star_tables,
    untidy_star_tables,
)
from trichter.sources.tables import FunnelTables, load_tables, publish_tables, replace_months, write_tables

Query = Callable[[SparkSession, str], DataFrame]

STAR_PARAMS = Params(
    years=(1999, 2000),
    entity_id="1",
    period=(date(2000, 6, 1), date(2000, 9, 1)),
    compare=(date(2000, 6, 1), date(2000, 8, 1)),
)
STAR_BUCKETS = 8


def _analysis(name: str) -> Query:
    return lambda spark, folder: run(name, star_tables(spark, folder), STAR_PARAMS)


def _on_star(build: Callable[[FunnelTables], DataFrame]) -> Query:
    return lambda spark, folder: build(star_tables(spark, folder))


def _on_untidy(build: Callable[[FunnelTables], DataFrame]) -> Query:
    return lambda spark, folder: build(clean_tables(untidy_star_tables(spark, folder)))


def _on_faulty(build: Callable[[FunnelTables], DataFrame]) -> Query:
    return lambda spark, folder: build(clean_tables(faulty_star_tables(spark, folder)))


def _in_money(df: DataFrame) -> DataFrame:
    """Cents columns as currency amounts."""
    for name in [c for c in df.columns if c.endswith("_cents")]:
        df = df.withColumn(name.removesuffix("_cents"), money(F.col(name))).drop(name)
    return df


def _spread(tables: FunnelTables) -> DataFrame:
    spread = _in_money(
        lead_spread(tables.spend, by_year=True).withColumns(
            {
                "range_leads": F.col("max_monthly_leads") - F.col("min_monthly_leads"),
                "min_month": F.col("low.month"),
                "min_leads": F.col("low.leads"),
                "cost_at_min_cents": F.col("low.cost_cents"),
                "max_month": F.col("high.month"),
                "max_leads": F.col("high.leads"),
                "cost_at_max_cents": F.col("high.cost_cents"),
            }
        )
    )
    return spread.drop("mean", "sd", "low", "high")


def _islands(tables: FunnelTables) -> DataFrame:
    return (
        trend_runs(tables.spend, tables.conversions, tables.entities)
        .groupBy(*SERIES, "run_id", "trend")
        .agg(
            F.count(F.lit(1)).alias("months"),
            F.min("month").alias("first_month"),
            F.max("month").alias("last_month"),
        )
        .drop("entity_number")
    )


def _order_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """Hundred price tiles over all orders, and seven age tiles within each priority."""
    orders = read_star(spark, folder, "orders").select(
        "o_orderkey", "o_totalprice", "o_orderpriority", F.unix_date(F.col("o_orderdate").cast("date")).alias("day")
    )
    priced = with_ntiles(orders, 100, {"price_tile": "o_totalprice"}, "o_orderkey")
    aged = with_ntiles(priced, 7, {"age_tile": "day"}, "o_orderkey", by=["o_orderpriority"])
    return aged.select("o_orderkey", "price_tile", "age_tile")


def _zscores(by_year: bool) -> Query:
    return _on_star(
        lambda t: kpi_zscores(t.spend, t.conversions, by_year).select(
            "hotel_id", "month", *[f"z_{kpi}" for kpi in ("ctr", "cpc", "lr", "cpl", "roas", "aov")]
        )
    )


def _windows(strict: bool) -> Query:
    return _on_star(
        lambda t: diverging_windows(t.spend, strict).select(
            "hotel_id", "month_1", "month_3", rounded(F.col("score"), 4).alias("score")
        )
    )


def _stored_rows(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of the three tables, written clustered and read back."""
    path = shared_folder(spark, "stored")
    write_tables(star_tables(spark, folder), path)
    stored = load_tables(spark, path)
    nothing = F.lit(None)
    return (
        stored.spend.select(
            F.lit("spend").alias("table"),
            "hotel_id",
            F.col("campaign_id").alias("id"),
            F.col("date").alias("day"),
            F.col("campaign_type").alias("kind"),
            "leads",
            F.col("cost").cast("double").alias("amount"),
        )
        .unionAll(
            stored.conversions.select(
                F.lit("conversions"),
                "hotel_id",
                "booking_id",
                "booking_date",
                "travel_type",
                nothing.cast("bigint"),
                F.col("revenue").cast("double"),
            )
        )
        .unionAll(
            stored.entities.select(
                F.lit("entities"),
                "hotel_id",
                "country",
                nothing.cast("date"),
                "hotel_category",
                nothing.cast("bigint"),
                nothing.cast("double"),
            )
        )
    )


def _with_plain_revenue(bookings: DataFrame) -> DataFrame:
    return bookings.withColumn("revenue", F.col("revenue").cast("double"))


def _replaced_months(spark: SparkSession, folder: str) -> DataFrame:
    """Bookings published without revenue, of which the first quarters are then replaced by the true ones."""
    path, true = shared_folder(spark, "published"), star_tables(spark, folder)
    unknown = replace(true, conversions=true.conversions.withColumn("revenue", F.lit(0).cast(schemas.MONEY)))
    publish_tables(unknown, path, by_month=True)
    quarter = replace(
        true, spend=true.spend.where("month(date) <= 3"), conversions=true.conversions.where("month(booking_date) <= 3")
    )
    replace_months(quarter, path)
    return _with_plain_revenue(load_tables(spark, path).conversions)


def _read_lines(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    path = shared_folder(spark, "lines")
    booking_lines(spark, folder).write.text(path)
    return read_csv_with_rejects(spark, path, schemas.CONVERSIONS.names)


def _accepted_lines(spark: SparkSession, folder: str) -> DataFrame:
    return _with_plain_revenue(clean_table(_read_lines(spark, folder)[0]))


def _column_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Bookings read in the one date format that fits their column."""
    dated = dated_star_bookings(spark, folder)
    return _with_plain_revenue(clean_table(dated, chosen_formats(date_format_counts(dated))))


def _colocated_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Both facts per entity and month, from facts stored in the same buckets by entity."""
    path = shared_folder(spark, "colocated")
    publish_colocated(star_tables(spark, folder), path, STAR_BUCKETS)
    stored = load_colocated(spark, path)
    months = with_period(stored.spend, "date", "month"), with_period(stored.conversions, "booking_date", "month")
    rollup = funnel_rollup(*months, ["hotel_id", "month"]).drop("from_spend", "from_conversions")
    return _in_money(rollup)


def _bookings_from_rollups(spark: SparkSession, folder: str) -> DataFrame:
    """Bookings and revenue in the six analyses that count bookings, run on stored rollups."""
    tables = star_tables(spark, folder).with_rollups(shared_folder(spark, "rollups"), revenue=False)
    return _booking_counts(lambda name: run(name, tables, STAR_PARAMS))


def _bookings_side_by_side(spark: SparkSession, folder: str) -> DataFrame:
    """The same from the results that a catalogue run of four analyses at a time has stored."""
    out = shared_folder(spark, "catalogue")
    run_catalogue(star_tables(spark, folder), out, STAR_PARAMS, ON_MONTHLY_BOOKINGS, "parquet", side_by_side=4)
    return _booking_counts(lambda name: spark.read.parquet(f"{out}/{name}"))


def _booking_counts(result: Callable[[str], DataFrame]) -> DataFrame:
    nobody, label = F.lit(None).cast("string"), F.lit(None).cast("string")

    def row(name: str, entity: Column, period: Column, bookings: str, revenue: str, label: Column) -> list[Column]:
        return [
            F.lit(name).alias("analysis"),
            entity.alias("hotel_id"),
            period.cast("string").alias("period"),
            F.col(bookings).alias("bookings"),
            F.col(revenue).alias("revenue"),
            label.alias("label"),
        ]

    def part(name: str, *columns: Column | str) -> DataFrame:
        return result(name).select(*row(name, *columns))

    def by_year(name: str, entity: Column) -> DataFrame:
        """Both years from one evaluation."""
        years = [row(name, entity, F.lit(y), f"bookings_{y}", f"revenue_{y}", label) for y in STAR_PARAMS.years]
        return result(name).select(F.inline(F.array(*[F.struct(*year) for year in years])))

    hotel, segment = F.col("hotel_id"), F.col("segment_category")
    parts = [
        part("segments_total", hotel, F.lit("all"), "total_bookings", "total_revenue", segment),
        part("segments_by_year", hotel, F.col("year"), "total_bookings", "total_revenue", segment),
        part("anomalies_total", hotel, F.col("month"), "bookings", "revenue", F.col("anomaly")),
        part("anomalies_by_year", hotel, F.col("month"), "bookings", "revenue", F.col("anomaly")),
        by_year("executive_summary", nobody),
        by_year("entity_year_comparison", hotel),
    ]
    return reduce(DataFrame.unionAll, parts)


QUERIES: dict[str, Query] = {
    **{name: _analysis(name) for name in ANALYSES},
    "series_monthly_named": lambda spark, folder: with_month_name(_analysis("series_monthly")(spark, folder)),
    "entity_year_comparison_all": _on_star(
        lambda t: entity_year_comparison(t.spend, t.conversions, t.entities, STAR_PARAMS.years)
    ),
    "diverging_windows_strict": _windows(True),
    "diverging_windows_loose": _windows(False),
    "kpi_zscores": _zscores(False),
    "kpi_zscores_by_year": _zscores(True),
    "lead_spread": _on_star(_spread),
    "trend_islands": _on_star(_islands),
    "spend_monthly": _on_star(lambda t: _in_money(spend_monthly(t.spend))),
    "conv_monthly": _on_star(
        lambda t: _in_money(
            conversions_by(with_period(t.conversions, "booking_date", "month"), ["hotel_id", "month"])
        )
    ),
    "totals_by_entity": _on_star(
        lambda t: _in_money(entity_totals(t.spend, t.conversions, t.entities)).drop("conversion_rate")
    ),
    "month_spine": _on_star(lambda t: month_spine(t.spend, t.conversions)),
    "dense_grid": _on_star(lambda t: dense_grid(t.entities, month_calendar(t.spend, t.conversions), "month")),
    "ntile_global": _order_tiles,
    "clean_tables": _on_untidy(lambda t: t.spend.withColumn("cost", F.col("cost").cast("double"))),
    "clean_bookings": _on_untidy(lambda t: t.conversions.withColumn("revenue", F.col("revenue").cast("double"))),
    "repair_tables": _on_untidy(lambda t: repair_tables(t).spend.withColumn("cost", F.col("cost").cast("double"))),
    "orphan_rows": _on_untidy(lambda t: quality.orphan_rows(t.spend, t.entities).drop("cost")),
    "repair_bookings": _on_faulty(
        lambda t: repair_tables(t).conversions.withColumn("revenue", F.col("revenue").cast("double"))
    ),
    "orphan_bookings": _on_faulty(lambda t: quality.orphan_rows(t.conversions, t.entities).drop("revenue")),
    "clean_entities": _on_faulty(lambda t: t.entities),
    "stored_round_trip": _stored_rows,
    "catalogue_from_rollups": _bookings_from_rollups,
    "catalogue_side_by_side": _bookings_side_by_side,
    "colocated_rollup": _colocated_rollup,
    "replaced_months": _replaced_months,
    "csv_accepted_lines": _accepted_lines,
    "csv_rejected_lines": lambda spark, folder: _read_lines(spark, folder)[1].select("line"),
    "date_format_counts": lambda spark, folder: date_format_counts(dated_star_bookings(spark, folder)),
    "bookings_in_column_format": _column_dates,
    "quality_missing": _on_untidy(quality.missing_counts),
    "quality_duplicates": _on_untidy(
        lambda t: quality.duplicate_count(t.conversions, "booking_data", "booking_id")
    ),
    "quality_nonpositive": _on_untidy(quality.nonpositive_counts),
    "quality_plausibility": _on_untidy(quality.plausibility_counts),
    "quality_orphans": _on_untidy(quality.orphan_counts),
    "quality_report": _on_untidy(quality.quality_report),
    "table_summary": _on_untidy(quality.table_summary),
    "filter_result": lambda spark, folder: filter_result(_analysis("segments_by_year")(spark, folder), year=2000),
    "question_slots": lambda spark, folder: with_slots(questions(spark, folder)).drop("text"),
    "question_tags": lambda spark, folder: tag_intent(
        questions(spark, folder), focus_entity=STAR_PARAMS.entity_id
    ).select("conv_id", "turn", "intent"),
    "question_intents": lambda spark, folder: intent_counts(
        questions(spark, folder), focus_entity=STAR_PARAMS.entity_id
    ),
}
