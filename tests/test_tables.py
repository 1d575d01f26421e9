"""Sources, sinks and the catalogue run."""

from __future__ import annotations

import csv
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.helpers import bookings_table, entity_table, spend_table
from trichter.__main__ import main
from trichter.functions.dates import with_period
from trichter.operators.cleaning import clean_tables, repair_tables
from trichter.operators.quality import quality_report
from trichter.operators.rollup import compact_bookings, funnel_rollup
from trichter.plans.catalogue import (
    ANALYSES,
    ON_MONTHLY_BOOKINGS,
    ON_MONTHLY_REVENUE,
    Params,
    query,
    run_catalogue,
)
from trichter.plans.ingest import ingest
from trichter.plans.registered import STAR_PARAMS
from trichter.sources import schemas
from trichter.sources.star import star_tables, untidy_star_tables
from trichter.sources.tables import FunnelTables, load_tables, write_tables

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    write_tables(star_tables(spark, DATA), folder)
    return folder


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_round_trip(spark, stored):
    before, after = star_tables(spark, DATA), load_tables(spark, stored)
    for name in ("spend", "conversions", "entities"):
        assert rows(getattr(before, name)) == rows(getattr(after, name))
    assert after.spend.schema == schemas.SPEND
    assert after.conversions.schema == schemas.CONVERSIONS


def test_missing_table_fails_at_once(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="campaign_performance"):
        load_tables(spark, str(tmp_path))


def test_raw_csv_to_clean_tables(spark, tmp_path):
    raw = untidy_star_tables(spark, DATA)
    names = {"spend": "campaign_performance", "conversions": "booking_data", "entities": "hotel_information"}
    for key, name in names.items():
        getattr(raw, key).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option(
            "ignoreTrailingWhiteSpace", False
        ).csv(f"{tmp_path}/{name}")
    loaded = load_tables(spark, str(tmp_path), "csv", raw=True)
    direct, read = repair_tables(clean_tables(raw)), repair_tables(clean_tables(loaded))
    for name in ("spend", "conversions", "entities"):
        assert getattr(read, name).dtypes == getattr(direct, name).dtypes
        assert rows(getattr(read, name)) == rows(getattr(direct, name))


def test_ingest_and_command_line(spark, tmp_path, capsys, monkeypatch):
    raw = untidy_star_tables(spark, DATA)
    source, target, out = (f"{tmp_path}/{name}" for name in ("raw", "stored", "out"))
    for key, name in (("spend", "campaign_performance"), ("conversions", "booking_data"), ("entities", "hotel_information")):
        getattr(raw, key).write.parquet(f"{source}/{name}")
    monkeypatch.setattr("trichter.__main__.build_session", lambda: spark)
    main(["ingest", source, target, "--format", "parquet"])
    stored = load_tables(spark, target)
    assert rows(stored.spend) == rows(repair_tables(clean_tables(raw)).spend)
    report = spark.read.option("header", True).csv(f"{target}/quality_report")
    assert rows(report.selectExpr("check", "table", "column", "cast(n as bigint)")) == rows(quality_report(clean_tables(raw)))
    assert spark.read.option("header", True).csv(f"{target}/table_summary").count() == 17
    options = ["--years", "1999", "2000", "--entity", "1"]
    main(["run", target, out, "--only", "executive_summary", "--format", "parquet", *options])
    assert rows(spark.read.parquet(f"{out}/executive_summary")) == rows(query("executive_summary", stored, STAR_PARAMS))
    main(["ask", target, "Top 2 Segmente", *options])
    assert "intent: segments_total" in capsys.readouterr().out


def test_csv_goes_by_name(spark, tmp_path):
    tables = star_tables(spark, DATA)
    mixed = replace(tables, spend=tables.spend.select("cost", F.lit("web").alias("platform"), *tables.spend.columns[:-1]))
    write_tables(mixed, f"{tmp_path}/t", "csv", cluster=False)
    back = load_tables(spark, f"{tmp_path}/t", "csv")
    assert back.spend.columns == [*tables.spend.columns, "platform"]
    assert rows(back.spend.drop("platform")) == rows(tables.spend)
    assert rows(back.conversions) == rows(tables.conversions)
    tables.spend.drop("leads").withColumnRenamed("cost", "spend").write.mode("overwrite").option("header", True).csv(
        f"{tmp_path}/t/campaign_performance"
    )
    with pytest.raises(ValueError, match="leads, cost"):
        load_tables(spark, f"{tmp_path}/t", "csv")


def test_ingest_keeps_all_columns_and_needs_the_declared_ones(spark, tmp_path):
    raw = untidy_star_tables(spark, DATA)
    raw = replace(raw, spend=raw.spend.withColumn("Plat form", F.when(F.col(raw.spend.columns[0]).endswith("1"), "web")))
    for key, name in (("spend", "campaign_performance"), ("conversions", "booking_data"), ("entities", "hotel_information")):
        getattr(raw, key).write.parquet(f"{tmp_path}/raw/{name}")
    stored = ingest(spark, f"{tmp_path}/raw", f"{tmp_path}/stored", "parquet")
    assert rows(stored.spend) == rows(repair_tables(clean_tables(raw)).spend)
    report = spark.read.option("header", True).csv(f"{tmp_path}/stored/quality_report")
    assert report.where("`check` = 'missing' AND `column` = 'plat_form' AND n > 0").count() == 1
    raw.conversions.drop(raw.conversions.columns[-1]).write.mode("overwrite").parquet(f"{tmp_path}/raw/booking_data")
    with pytest.raises(ValueError, match="booking_data"):
        ingest(spark, f"{tmp_path}/raw", f"{tmp_path}/other", "parquet")


def test_catalog_tables(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS funnel_test LOCATION '{tmp_path}/db'")
    try:
        tables = star_tables(spark, DATA)
        write_tables(tables, database="funnel_test")
        write_tables(tables, database="funnel_test", cluster=False)
        assert spark.table("funnel_test.booking_data").count() == tables.conversions.count()
    finally:
        spark.sql("DROP DATABASE funnel_test CASCADE")
    with pytest.raises(ValueError):
        write_tables(tables)


def test_catalogue_run(spark, stored, tmp_path):
    tables = load_tables(spark, stored)
    folders = run_catalogue(tables, str(tmp_path), STAR_PARAMS)
    assert [Path(f).name for f in folders] == sorted(ANALYSES)
    for name, folder in zip(sorted(ANALYSES), folders):
        want = query(name, tables, STAR_PARAMS)
        parts = sorted(Path(folder).glob("part-*.csv"))
        records = []
        for part in parts:
            with part.open(newline="") as handle:
                header, *body = csv.reader(handle)
            assert header == want.columns
            records += body
        expected = [["" if v is None else v for v in row] for row in want.collect()]
        assert len(records) == len(expected), name
        for got, exp in zip(sorted(records), sorted([str(v) for v in row] for row in expected)):
            assert [_same(g, e) for g, e in zip(got, exp)].count(False) == 0, (name, got, exp)


def _same(left: str, right: str) -> bool:
    try:
        return float(left) == float(right)
    except ValueError:
        return left == right


def test_rollups_change_nothing(spark, stored, tmp_path):
    tables = load_tables(spark, stored)
    rolled = tables.with_rollups(str(tmp_path))
    assert rolled.monthly_spend.count() < tables.spend.count()
    assert rolled.monthly_bookings.count() <= tables.conversions.count()
    for name in ANALYSES:
        assert rows(query(name, tables, STAR_PARAMS)) == rows(query(name, rolled, STAR_PARAMS)), name


def test_a_booking_spread_over_months_counts_once_a_year(spark, tmp_path):
    bookings = bookings_table(
        spark,
        [
            ("b1", "1", "2024-01-31", 10),
            ("b1", "1", "2024-02-01", 5),
            ("b1", "2", "2024-02-01", 7),
            ("b2", "1", "2024-02-02", "0.01"),
            ("b2", "1", "2024-02-03", "0.02"),
            (None, "1", "2024-02-03", 4),
            ("b3", None, "2024-02-03", 3),
            ("b4", "1", None, 2),
        ],
    )
    spend = spend_table(spark, [("1", "2024-01-05", 10, 5, 2, 3), ("2", "2024-02-05", 10, 5, 1, 3)])
    tables = FunnelTables(spend, bookings, entity_table(spark, ["1", "2"]))
    rolled = tables.with_rollups(str(tmp_path))
    assert rolled.monthly_bookings.count() == 7
    for name in ("segments_total", "segments_by_year", "executive_summary", "anomalies_total"):
        params = Params(years=(2023, 2024), entity_id="1")
        assert rows(query(name, rolled, params)) == rows(query(name, tables, params)), name
    first = query("segments_total", rolled).where("hotel_id = '1'").first()
    assert (first.total_bookings, first.total_revenue) == (3, 21.03)


def test_a_catalogue_scans_raw_bookings_once(spark, stored, tmp_path):
    """Every analysis that counts bookings reads their rollup."""
    rolled = load_tables(spark, stored).with_rollups(str(tmp_path))
    for name in ON_MONTHLY_BOOKINGS | ON_MONTHLY_REVENUE:
        files = query(name, rolled, STAR_PARAMS).inputFiles()
        assert not any("booking_data" in f or "campaign_performance" in f for f in files), name


def test_unknown_analysis(spark, stored):
    with pytest.raises(KeyError, match="monthly_kpis"):
        query("nope", load_tables(spark, stored), Params())


def test_monthly_bookings_are_not_reduced_again(spark, tmp_path):
    bookings = bookings_table(
        spark,
        [("b1", "1", "2024-01-31", 10), ("b1", "1", "2024-01-02", 5), ("b1", "1", "2024-02-01", "0.07"), (None, "1", "2024-01-03", 4)],
    )
    tables = FunnelTables(spend_table(spark, [("1", "2024-01-05", 10, 5, 2, 3)]), bookings, entity_table(spark, ["1"]))
    rolled = tables.with_rollups(str(tmp_path), revenue=False)

    def monthly(t):
        sales = with_period(t.bookings_by_month, "booking_date", "month")
        return funnel_rollup(with_period(t.spend_by_month, "date", "month"), sales, ["hotel_id", "month"])

    assert rows(monthly(rolled)) == rows(monthly(tables))
    assert {r.month.month: (r.bookings, r.revenue_cents) for r in monthly(rolled).collect()} == {1: (1, 1900), 2: (1, 7)}
    plans = [monthly(t)._jdf.queryExecution().optimizedPlan().toString() for t in (tables, rolled)]
    assert [plan.count("Aggregate [") for plan in plans] == [2, 1]
    assert "/ 100" not in compact_bookings(bookings)._jdf.queryExecution().optimizedPlan().toString()
