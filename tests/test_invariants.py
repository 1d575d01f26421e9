"""Relations that must hold between analyses, on the whole sf0.01 tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from trichter.plans.anomalies import BAD_DIRECTION
from trichter.plans.catalogue import ANALYSES, query
from trichter.plans.divergence import diverging_windows
from trichter.plans.registered import STAR_PARAMS
from trichter.sources.star import star_tables

Y0, Y1 = STAR_PARAMS.years


@pytest.fixture(scope="module")
def tables(spark):
    return star_tables(spark, "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def results(tables):
    cache = {}

    def get(name):
        if name not in cache:
            cache[name] = query(name, tables, STAR_PARAMS).toPandas()
        return cache[name]

    return get


def test_months_add_up_to_the_summary(results):
    series, summary = results("series_monthly"), results("executive_summary").iloc[0]
    for measure in ("cost", "leads", "revenue"):
        for y in (Y0, Y1):
            assert round(float(series[f"{measure}_{y}"].sum()), 2) == float(summary[f"{measure}_{y}"])


def test_years_add_up_to_totals(results):
    total = results("segments_total").set_index("hotel_id").sort_index()
    years = results("segments_by_year").groupby("hotel_id").sum(numeric_only=True).sort_index()
    for column in ("total_leads", "total_clicks", "total_impressions", "total_bookings"):
        assert (total[column] == years[column]).all()
    for column in ("total_cost", "total_revenue"):
        assert (total[column] - years[column]).abs().max() < 0.005


def test_entities_add_up_to_the_summary(results):
    years, summary = results("segments_by_year"), results("executive_summary").iloc[0]
    for y in (Y0, Y1):
        part = years[years.year == y]
        assert int(part.total_leads.sum()) == summary[f"leads_{y}"]
        assert round(float(part.total_cost.sum()), 2) == summary[f"cost_{y}"]


def test_weeks_differ_from_months_by_the_turn_of_the_year(tables, results):
    spend = tables.spend
    iso = F.extract(F.lit("YEAROFWEEK"), "date")
    for y in (Y0, Y1):
        moved = spend.select(
            (F.when(iso == y, 1).otherwise(0) - F.when(F.year("date") == y, 1).otherwise(0)).alias("sign"), "leads"
        ).agg(F.sum(F.col("sign") * F.col("leads"))).first()[0]
        months, weeks = results("series_monthly"), results("series_weekly")
        assert int(weeks[f"leads_{y}"].sum() - months[f"leads_{y}"].sum()) == moved


@pytest.mark.parametrize("name", ["anomalies_total", "anomalies_by_year"])
def test_score_is_the_sum_of_bad_deviations(results, name):
    frame = results(name)
    total = sum((sign * frame[f"z_{k}"]).clip(lower=0).fillna(0) for k, sign in BAD_DIRECTION.items())
    assert ((total - frame.anomaly_score).abs() < 1e-9).all()
    assert len(frame) == (15 if name == "anomalies_total" else 15 * frame.year.nunique())


def test_volatility_and_segments_agree_on_leads(results):
    segments = results("segments_total").set_index("hotel_id").total_leads
    for row in results("volatility_total").itertuples():
        assert segments[row.hotel_id] == row.total_leads


def test_strict_windows_are_loose_windows(tables):
    keys = ["hotel_id", "month_3"]
    strict, loose = (diverging_windows(tables.spend, s).select(*keys) for s in (True, False))
    assert (strict.count(), loose.count()) == (62, 1121)
    assert strict.join(loose, keys, "left_anti").count() == 0


def test_tiles_are_even_and_entities_unique(results):
    frame = results("segments_total")
    assert frame.hotel_id.is_unique
    for column in ("revenue_q", "leads_q", "conversion_q"):
        sizes = frame[column].dropna().value_counts()
        assert sizes.max() - sizes.min() <= 1 and set(sizes.index) == {1, 2, 3, 4}


def test_runs_cover_every_month(results):
    frame = results("moving_average_trends")
    ends = frame[frame.total_months_in_current_trend == frame.current_month_in_trend]
    months = frame.groupby("hotel_id").size()
    assert (ends.groupby("hotel_id").total_months_in_current_trend.sum() == months).all()
    assert set(months) == {83}


def test_layout_does_not_change_results(spark, results):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        shuffled = star_tables(spark, "/root/testdata/sf0.01")
        shuffled = type(shuffled)(
            shuffled.spend.repartition(13), shuffled.conversions.repartition(7), shuffled.entities
        )
        for name in sorted(ANALYSES):
            got = query(name, shuffled, STAR_PARAMS).toPandas()
            assert got.equals(results(name)), name
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_stray_date_fails_instead_of_stretching_the_calendar(spark):
    from tests.helpers import day
    from trichter.operators.calendar import months_between

    days = spark.createDataFrame([(day("2024-01-05"),), (day("9999-12-31"),)], "day date")
    with pytest.raises(Exception, match="longer than 1200 months"):
        months_between(days, "day").collect()
    assert len(months_between(days.limit(0), "day").collect()) == 1
