from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tests.helpers import bookings_table, spend_table
from trichter.functions.dates import coerce_date, in_iso_years, in_years, with_period
from trichter.functions.numbers import cents, money, pct_change, ratio, rounded
from trichter.functions.text import normalised_question
from trichter.operators.cleaning import normalise_category
from trichter.plans.series import compare_weekly_series


def values(spark, data, ddl, column):
    return [row[0] for row in spark.createDataFrame(data, ddl).select(column).collect()]


def test_rounding_scales_first(spark):
    data = [(1.005,), (0.285,), (2.675,), (-0.125,)]
    assert values(spark, data, "x double", rounded(F.col("x"), 2)) == [1.0, 0.28, 2.68, -0.13]


def test_ratio_and_change_are_null_on_zero(spark):
    data = [(6, 3), (5, 0), (5, None)]
    assert values(spark, data, "a bigint, b bigint", ratio(F.col("a"), F.col("b"))) == [2.0, None, None]
    assert values(spark, data, "a bigint, b bigint", pct_change(F.col("a"), F.col("b"))) == [100.0, None, None]


def test_money_sums_are_exact(spark):
    df = spark.createDataFrame([(0.1,)] * 10, "x double")
    assert df.agg(money(F.sum(cents(F.col("x"))))).first()[0] == 1.0


def test_large_amounts_survive_cents(spark):
    text = "9999999999999999.99"
    df = spark.sql(f"SELECT CAST('{text}' AS DECIMAL(18,2)) AS x")
    assert df.select(cents(F.col("x"))).first()[0] == 999999999999999999


def test_categories(spark):
    data = [("\t city-trip ",), ("KID'S club",), (None,), ("BUSINESS  travel",)]
    assert values(spark, data, "x string", normalise_category(F.col("x"))) == [
        "City-Trip",
        "Kid'S Club",
        None,
        "Business  Travel",
    ]


def test_questions_are_folded(spark):
    assert values(spark, [("  Größe FÜR Äpfel\n",)], "x string", normalised_question(F.col("x"))) == [
        "groesse fuer aepfel"
    ]


def test_dates(spark):
    data = [("2024-02-29",), ("2024-02-30",), ("2024-05-01 10:11:12",), ("24.12.2024",), ("n/a",), (None,)]
    data += [("2024-05-01T10:11:12.123456Z",), (" 2024-5-1 ",), ("2024-05-01 soon",), ("12/31/2024",), ("",)]
    assert values(spark, data, "x string", coerce_date(F.col("x"))) == [
        date(2024, 2, 29),
        None,
        date(2024, 5, 1),
        date(2024, 12, 24),
        None,
        None,
        date(2024, 5, 1),
        date(2024, 5, 1),
        None,
        date(2024, 12, 31),
        None,
    ]


def test_dates_already_typed(spark):
    df = spark.createDataFrame([(datetime(2024, 3, 4, 5, 6, 7, 890), date(2024, 3, 4))], "t timestamp, d date")
    row = df.select(coerce_date(F.col("t")).alias("t"), coerce_date(F.col("d")).alias("d")).first()
    assert row.t == row.d == date(2024, 3, 4)


@pytest.mark.parametrize(
    ("text", "expected"),
    [("2024-12-30", (2025, 1)), ("2021-01-01", (2020, 53)), ("2020-12-31", (2020, 53))],
)
def test_iso_weeks(spark, text, expected):
    df = with_period(spark.createDataFrame([(date.fromisoformat(text),)], "d date"), "d", "iso_year", "iso_week")
    row = df.first()
    assert (row.iso_year, row.iso_week) == expected


def test_year_ranges_equal_year_functions(spark):
    df = spark.range(0, 366 * 12).select(F.date_add(F.lit(date(2015, 1, 1)), F.col("id").cast("int")).alias("d"))
    df = with_period(df, "d", "year", "iso_year")
    years = (2016, 2018, 2020)
    wrong = df.where((F.col("year").isin(*years) != in_years(F.col("d"), years)))
    wrong_iso = df.where((F.col("iso_year").isin(*years) != in_iso_years(F.col("d"), years)))
    assert wrong.count() == wrong_iso.count() == 0


def test_week_of_new_year_stays_whole(spark):
    spend = spend_table(spark, [("1", "2024-12-30", 10, 5, 1, 7), ("1", "2025-01-02", 10, 5, 2, 3)])
    bookings = bookings_table(spark, [("b", "1", "2024-01-03", 5)])
    rows = [row.asDict() for row in compare_weekly_series(spend, bookings, (2024, 2025)).collect()]
    assert rows == [
        {
            "week": 1,
            "cost_2024": 0.0,
            "cost_2025": 10.0,
            "leads_2024": 0,
            "leads_2025": 3,
            "revenue_2024": 5.0,
            "revenue_2025": 0.0,
        }
    ]
