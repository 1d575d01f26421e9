from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from tests.helpers import entity_table
from trichter.operators import quality
from trichter.operators.cleaning import (
    clean_column_names,
    clean_table,
    floor_nonpositive,
    ids_to_string,
    invalidate_clicks,
    invalidate_leads,
    repair_spend,
    repair_tables,
)
from trichter.functions.dates import COLUMN_FORMATS, read_date
from trichter.operators.date_formats import chosen_formats, date_format_counts
from trichter.sources.tables import FunnelTables


def test_column_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], [" Hotel ID ", "TravelType", "Booking  Date"])
    assert clean_column_names(df).columns == ["hotel_id", "travel_type", "booking__date"]


def test_ids_only_where_present(spark):
    df = ids_to_string(spark.createDataFrame([(18, 5)], ["hotel_id", "stars"]))
    assert df.dtypes == [("hotel_id", "string"), ("stars", "bigint")]


def test_text_numbers_and_nan(spark):
    text = spark.createDataFrame([("12.0", "3.455"), ("x", ""), (" 7 ", "9999999999999999.99")], ["Clicks", "Cost"])
    assert [tuple(r) for r in clean_table(text).collect()] == [
        (12, Decimal("3.46")),
        (None, None),
        (7, Decimal("9999999999999999.99")),
    ]
    huge = spark.createDataFrame([("1" * 25, "1" * 25)], ["Clicks", "Cost"])
    assert tuple(clean_table(huge).first()) == (None, None)
    doubles = spark.createDataFrame([(float("nan"), 1.5), (4.0, float("nan"))], ["Leads", "Revenue"])
    assert [tuple(r) for r in clean_table(doubles).collect()] == [(None, Decimal("1.50")), (4, None)]


def test_floor_keeps_null(spark):
    df = spark.createDataFrame([(-5,), (0,), (3,), (None,)], "cost bigint")
    assert [r.cost for r in floor_nonpositive(df, ["cost", "absent"]).collect()] == [0, 0, 3, None]


def test_leads_are_judged_by_the_clicks_that_remain(spark):
    df = spark.createDataFrame([(10, 12, 11), (10, 8, 9), (10, None, 5)], "impressions bigint, clicks bigint, leads bigint")
    assert [tuple(r) for r in invalidate_leads(invalidate_clicks(df)).collect()] == [
        (10, None, 11),
        (10, 8, None),
        (10, None, 5),
    ]


def test_floor_precedes_plausibility(spark):
    df = spark.createDataFrame([(10, -4, -2, Decimal("-1.00"))], "impressions bigint, clicks bigint, leads bigint, cost decimal(18,2)")
    assert tuple(repair_spend(df).first()) == (10, 0, 0, Decimal("0.00"))


def make(spark):
    spend = spark.createDataFrame(
        [
            ("a", "1", date(2024, 1, 1), "S", 10, 12, 11, Decimal("-5")),
            ("b", "X", None, "S", 10, 5, 6, Decimal("0")),
            ("c", None, date(2024, 1, 1), None, 10, 0, 0, Decimal("3")),
        ],
        "campaign_id string, hotel_id string, date date, campaign_type string, impressions bigint, clicks bigint, "
        "leads bigint, cost decimal(18,2)",
    )
    bookings = spark.createDataFrame(
        [(b, "1", date(2024, 1, 1), "T", Decimal("1")) for b in ("a", "a", "a", None, None)],
        "booking_id string, hotel_id string, booking_date date, travel_type string, revenue decimal(18,2)",
    )
    return FunnelTables(spend, bookings, entity_table(spark, ["1"]))


def test_report(spark):
    got = {(r.check, r.table, r.column): r.n for r in quality.quality_report(make(spark)).collect()}
    assert got == {
        ("missing", "campaign_performance", "hotel_id"): 1,
        ("missing", "campaign_performance", "date"): 1,
        ("missing", "campaign_performance", "campaign_type"): 1,
        ("missing", "booking_data", "booking_id"): 2,
        ("nonpositive", "campaign_performance", "cost"): 2,
        ("nonpositive", "campaign_performance", "clicks"): 1,
        ("nonpositive", "campaign_performance", "leads"): 1,
        ("nonpositive", "booking_data", "revenue"): 0,
        ("invalid", "campaign_performance", "clicks"): 1,
        ("invalid", "campaign_performance", "leads"): 1,
        ("duplicate", "booking_data", "booking_id"): 3,
        ("orphan", "campaign_performance", "hotel_id"): 2,
        ("orphan", "booking_data", "hotel_id"): 0,
    }


def test_single_checks_agree_with_the_report(spark):
    tables = make(spark)
    report = quality.quality_report(tables)
    for check, single in (
        ("missing", quality.missing_counts(tables)),
        ("nonpositive", quality.nonpositive_counts(tables)),
        ("invalid", quality.plausibility_counts(tables)),
        ("orphan", quality.orphan_counts(tables)),
    ):
        assert sorted(single.collect()) == sorted(report.where(F.col("check") == check).collect())


def test_orphans_are_kept(spark):
    tables = make(spark)
    assert repair_tables(tables).spend.count() == 3
    assert sorted(str(r.hotel_id) for r in quality.orphan_rows(tables.spend, tables.entities).collect()) == ["None", "X"]


def test_summary(spark):
    rows = quality.table_summary(make(spark)).where("table = 'booking_data' and column = 'booking_id'").collect()
    assert [tuple(r) for r in rows] == [("booking_data", "booking_id", "string", 5, 3)]


def test_empty_tables_give_zero_counts(spark):
    tables = make(spark)
    empty = FunnelTables(tables.spend.limit(0), tables.conversions.limit(0), tables.entities)
    assert {r.n for r in quality.quality_report(empty).collect()} == {0}


def test_the_format_of_a_column(spark):
    texts = ["03/04/2021", "13/04/2021", "2021-01-01", "soon", "", None, "2021-02-03 10:00"]
    df = spark.createDataFrame([(t,) for t in texts], "`Date ` string")
    counts = date_format_counts(df)
    found = {r.format: (r.parsed, r.others, r.ambiguous) for r in counts.collect() if r.parsed}
    assert found == {"dd/MM/yyyy": (2, 3, False), "MM/dd/yyyy": (1, 3, False)}
    days = [r.date for r in clean_table(df, chosen_formats(counts)).collect()]
    assert days == [date(2021, 4, 3), date(2021, 4, 13), date(2021, 1, 1), None, None, None, date(2021, 2, 3)]


def test_formats_that_read_as_many(spark):
    either = date_format_counts(spark.createDataFrame([("03/04/2021",)], "date string"))
    assert sorted((r.format, r.chosen) for r in either.where("ambiguous").collect()) == [("MM/dd/yyyy", True), ("dd/MM/yyyy", False)]
    same = date_format_counts(spark.createDataFrame([("04/04/2021",)], "date string"))
    assert same.where("ambiguous").count() == 0
    for nothing in ([], [(None,)], [("soon",)], [("2021-01-01",)]):
        assert chosen_formats(date_format_counts(spark.createDataFrame(nothing, "date string"))) == {}
    typed = spark.createDataFrame([(date(2021, 1, 1), 1)], "date date, clicks int")
    assert date_format_counts(typed).collect() == []


def test_only_texts_of_a_format_reach_the_parser(spark):
    texts = ["31.12.2020", "29.02.2021", "1.2.2020", "00.01.2020", "32.01.2020", "01.13.2020", "01.01.+12020", "01.01.-0044", "01.01.12020"]
    texts += ["01.01.2020 ", "01.01.2020\n", "01.01.20", "12/31/2020", "31/12/2020", "02/30/2020", "31-12-2020", "2020/12/31", "20201231"]
    texts += ["+120201231", "120201231", "2020-12-31", "0١.01.2020", "soon", "", None, "03/04/2021", "01a01a2020"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for fmt in (*COLUMN_FORMATS, "d.M.yyyy", "dd MMM yyyy"):
        wrong = df.where(~read_date(F.col("t"), fmt).eqNullSafe(F.try_to_date("t", fmt)))
        assert wrong.collect() == []
    assert read_date(F.lit("x"), "dd.MM.yyyy")._jc.toString().startswith("CASE WHEN")
    spark.conf.set("spark.sql.legacy.timeParserPolicy", "LEGACY")
    try:
        assert df.where("t = '1.2.2020'").select(read_date(F.col("t"), "dd.MM.yyyy")).first()[0] == date(2020, 2, 1)
    finally:
        spark.conf.unset("spark.sql.legacy.timeParserPolicy")


def test_a_text_is_parsed_once_for_all_counts(spark):
    dates = spark.createDataFrame([("03/04/2021",)], "date string")
    plan = date_format_counts(dates)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("gettimestamp(") == len(COLUMN_FORMATS)
