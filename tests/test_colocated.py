"""Facts in buckets by entity, bloom filters of entity ids, and analyses run side by side."""

from __future__ import annotations

from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.helpers import bookings_table, entity_table, spend_table
from trichter.functions.dates import with_period
from trichter.operators.rollup import compact_bookings, compact_spend, funnel_rollup, spend_by
from trichter.plans.catalogue import ANALYSES, query, run_catalogue
from trichter.plans.comparison import entity_period_kpis
from trichter.plans.ingest import ingest
from trichter.plans.registered import STAR_PARAMS
from trichter.sources import colocated
from trichter.sources.colocated import load_colocated, publish_colocated
from trichter.sources.star import star_tables, untidy_star_tables
from trichter.sources.tables import FunnelTables, load_tables, write_tables
from trichter.sources.versions import version_folder

DATA = "/root/testdata/sf0.01"
KEYS = ["hotel_id", "month"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("colocated"))
    publish_colocated(star_tables(spark, DATA), path, 8)
    return path


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


def scanned(spark, df) -> list[int]:
    """Rows that each scan of the plan hands on."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = df.select("*")
        df.collect()
        leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    metrics = [leaves.apply(i).metrics().get("numOutputRows") for i in range(leaves.size())]
    return [m.get().value() for m in metrics if m.isDefined()]


def monthly(tables, **options):
    return funnel_rollup(
        with_period(tables.spend, "date", "month"), with_period(tables.conversions, "booking_date", "month"), KEYS, **options
    )


def test_rollups_by_entity_need_no_exchange(spark, folder):
    stored, raw = load_colocated(spark, folder), star_tables(spark, DATA)
    for options in ({}, {"full": True}, {"bookings": False}):
        assert "Exchange" not in plan(monthly(stored, **options))
        assert rows(monthly(stored, **options)) == rows(monthly(raw, **options))
    assert "Exchange" not in plan(spend_by(with_period(stored.spend, "date", "month"), KEYS))
    assert "Exchange" not in plan(compact_spend(stored.spend))
    assert "Exchange" not in plan(compact_bookings(stored.conversions))


def test_one_entity_is_read_from_one_bucket(spark, folder):
    stored = load_colocated(spark, folder)
    everything = stored.spend.count()
    one = stored.spend.where("hotel_id = '1'").select("date", "hotel_id")
    (read,) = scanned(spark, one)
    assert 0 < one.count() <= read <= everything / 4
    kpis = entity_period_kpis(stored.spend, stored.conversions, stored.entities, "1", *STAR_PARAMS.period, STAR_PARAMS.compare)
    assert rows(kpis) == rows(query("entity_period_kpis", star_tables(spark, DATA), STAR_PARAMS))
    assert max(scanned(spark, kpis)) <= everything / 4


@pytest.mark.parametrize("name", ["segments_by_year", "moving_average_trends", "anomalies_total", "monthly_kpis"])
def test_analyses_give_the_same_on_buckets(spark, folder, name):
    stored, raw = load_colocated(spark, folder), star_tables(spark, DATA)
    assert rows(query(name, stored, STAR_PARAMS)) == rows(query(name, raw, STAR_PARAMS))


def test_another_session_finds_the_buckets(spark, folder):
    other = spark.newSession()
    for table in spark.catalog.listTables():
        if table.name.startswith(("campaign_performance_", "booking_data_")):
            spark.sql(f"DROP TABLE default.{table.name}")  # external, so its files stay
    stored = load_colocated(other, folder)
    assert "Exchange" not in plan(monthly(stored))
    assert rows(stored.conversions) == rows(star_tables(spark, DATA).conversions)
    assert rows(load_tables(spark, folder).spend) == rows(stored.spend)  # read plainly, the rows are the same


def small(spark, spend_ids):
    return FunnelTables(
        spend_table(spark, [(i, "2024-01-05", 10, 5, 2, 3) for i in spend_ids]),
        bookings_table(spark, [(str(n), str(n % 64), "2024-01-31", 5) for n in range(640)]),
        entity_table(spark, ["1", "2"]),
    )


def test_a_hot_entity_keeps_its_fact_out_of_buckets(spark, tmp_path):
    path = str(tmp_path)
    hot = small(spark, ["1"] * 500 + [str(n) for n in range(500)])
    publish_colocated(hot, path, 16)
    stored = load_colocated(spark, path)
    assert "Bucketed: true" in plan(compact_bookings(stored.conversions))
    assert "Exchange" in plan(compact_spend(stored.spend))
    assert rows(monthly(stored)) == rows(monthly(hot))


def test_edge_rows_and_versions(spark, tmp_path):
    path = str(tmp_path)
    with pytest.raises(ValueError, match="bucket"):
        publish_colocated(small(spark, ["1"]), path, 0)
    empty = small(spark, ["1"])
    publish_colocated(replace(empty, spend=empty.spend.limit(0)), path, 4)
    assert load_colocated(spark, path).spend.count() == 0
    extra = small(spark, [None, "1", "1", "2", "é", ""])
    extra = replace(extra, spend=extra.spend.withColumn("odd name", F.lit(7)))
    publish_colocated(extra, path, 2)
    assert rows(load_colocated(spark, path).spend) == rows(extra.spend)
    write_tables(small(spark, ["9"]), f"{path}/plain")
    assert load_colocated(spark, f"{path}/plain").spend.count() == 1


def test_a_failed_version_is_not_seen(spark, tmp_path):
    path = str(tmp_path)
    publish_colocated(small(spark, ["1", "2", "3", "4"]), path, 2)
    broken = small(spark, ["5", "6", "7", "8"])
    lost = F.when(F.col("revenue") > 0, F.raise_error(F.lit("lost")).cast("decimal(18,2)"))
    with pytest.raises(Exception, match="lost"):
        publish_colocated(replace(broken, conversions=broken.conversions.withColumn("revenue", lost)), path, 2)
    assert {r.hotel_id for r in load_colocated(spark, path).spend.collect()} == {"1", "2", "3", "4"}


def test_even_buckets_follow_spark_buckets(spark):
    ids = spark.range(1000).select(F.col("id").cast("string").alias("hotel_id"))
    assert colocated.even_buckets(ids, 8, 1.5) and not colocated.even_buckets(ids, 900, 4.0)
    assert not colocated.even_buckets(ids.limit(0), 8, 4.0)


def test_bloom_filters_skip_row_groups(spark, tmp_path):
    """Ids within the range of a row group that do not occur in it; without a dictionary only a bloom filter tells."""
    even = small(spark, [f"{n:06}" for n in range(0, 20_000, 2)])
    spark.conf.set("parquet.enable.dictionary", "false")
    try:
        write_tables(even, str(tmp_path))
    finally:
        spark.conf.unset("parquet.enable.dictionary")
    spend = load_tables(spark, str(tmp_path)).spend
    there, absent = (spend.where(F.col("hotel_id") == entity).select("hotel_id") for entity in ("000778", "000777"))
    assert sum(scanned(spark, there)) > 0 and sum(scanned(spark, absent)) == 0
    spark.conf.set("parquet.filter.bloom.enabled", "false")
    try:
        assert sum(scanned(spark, absent)) > 0
    finally:
        spark.conf.unset("parquet.filter.bloom.enabled")


def test_ingest_into_buckets(spark, tmp_path):
    raw = untidy_star_tables(spark, "/root/testdata/sf0.001")
    for key, name in (("spend", "campaign_performance"), ("conversions", "booking_data"), ("entities", "hotel_information")):
        getattr(raw, key).write.parquet(f"{tmp_path}/raw/{name}")
    with pytest.raises(ValueError, match="either"):
        ingest(spark, f"{tmp_path}/raw", f"{tmp_path}/no", "parquet", by_month=True, buckets=2)
    plain = ingest(spark, f"{tmp_path}/raw", f"{tmp_path}/plain", "parquet")
    stored = ingest(spark, f"{tmp_path}/raw", f"{tmp_path}/buckets", "parquet", buckets=2)
    assert rows(stored.spend) == rows(plain.spend) and rows(stored.conversions) == rows(plain.conversions)


def test_side_by_side_gives_what_single_runs_give(spark, tmp_path):
    tables = star_tables(spark, "/root/testdata/sf0.001")
    folders = run_catalogue(tables, str(tmp_path), STAR_PARAMS, fmt="parquet", side_by_side=4)
    assert [Path(f).name for f in folders] == sorted(ANALYSES)
    for name, folder in zip(sorted(ANALYSES), folders):
        assert rows(spark.read.parquet(folder)) == rows(query(name, tables, STAR_PARAMS)), name
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None


def test_one_failure_leaves_the_others(spark, tmp_path, monkeypatch):
    def fails(tables, params):
        raise RuntimeError("no such luck")

    monkeypatch.setitem(ANALYSES, "series_monthly", fails)
    names = ["volatility_total", "series_monthly", "monthly_kpis", "monthly_kpis"]
    tables = star_tables(spark, "/root/testdata/sf0.001")
    with pytest.raises(RuntimeError, match="no such luck") as caught:
        run_catalogue(tables, str(tmp_path), STAR_PARAMS, names, "parquet", side_by_side=2)
    assert caught.value.__notes__ == ["analyses that failed: series_monthly"]
    assert all(spark.read.parquet(f"{tmp_path}/{name}").count() for name in ("volatility_total", "monthly_kpis"))
    with pytest.raises(KeyError, match="unknown"):
        run_catalogue(tables, str(tmp_path), STAR_PARAMS, ["none"])


def test_buckets_grow_with_the_facts(spark, tmp_path):
    tables = star_tables(spark, DATA)
    most = max(tables.spend.count(), tables.conversions.count())
    version = publish_colocated(tables, str(tmp_path), 2, rows_a_bucket=most // 12)
    assert colocated._layout(spark, version_folder(str(tmp_path), version)) == {"spend": 16, "conversions": 16}
    stored = load_colocated(spark, str(tmp_path))
    assert "Exchange" not in plan(monthly(stored))
    assert rows(monthly(stored)) == rows(monthly(tables))
    with pytest.raises(ValueError, match="at least one row"):
        publish_colocated(tables, str(tmp_path), 2, rows_a_bucket=0)
