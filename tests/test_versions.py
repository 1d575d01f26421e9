"""Versions of stored tables, months replaced alone, and broken lines set aside."""

from __future__ import annotations

from dataclasses import replace
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.helpers import bookings_table, entity_table, spend_table
from trichter.plans.ingest import ingest
from trichter.sources.rejects import read_csv_with_rejects
from trichter.sources.star import untidy_star_tables
from trichter.sources.tables import FunnelTables, load_tables, publish_tables, replace_months, write_tables
from trichter.sources.versions import version_log

DATA = "/root/testdata/sf0.001"


def tables(spark, revenue=10):
    bookings = [(b, "1", d, revenue) for b, d in (("a", "2024-01-31"), ("b", "2024-02-01"), ("b", "2024-02-01"), ("c", None))]
    spend = [("1", "2024-01-05", 10, 5, 2, 3), ("2", "2024-02-05", 10, 5, 1, 3)]
    return FunnelTables(spend_table(spark, spend), bookings_table(spark, bookings), entity_table(spark, ["1", "2"]))


def revenues(stored):
    return sorted((r.booking_id, r.revenue) for r in stored.conversions.collect())


def failing(conversions):
    """The same columns, but no task gets through."""
    lost = F.when(F.col("revenue") > 0, F.raise_error(F.lit("lost")).cast("decimal(18,2)"))
    return conversions.withColumn("revenue", lost)


def test_a_failed_write_leaves_the_version_before_it(spark, tmp_path):
    path = str(tmp_path)
    publish_tables(tables(spark), path)
    broken = tables(spark, 99)
    broken = replace(broken, conversions=failing(broken.conversions))
    with pytest.raises(Exception, match="lost"):
        publish_tables(broken, path)
    assert {r for _, r in revenues(load_tables(spark, path))} == {Decimal(10)}
    last = publish_tables(tables(spark, 7), path)
    assert {r for _, r in revenues(load_tables(spark, path))} == {Decimal(7)}
    log = version_log(spark, path).orderBy("number").collect()
    assert [r.number for r in log] == [1, 2] and log[-1].version == last


def test_months_are_replaced_alone(spark, tmp_path):
    path = str(tmp_path)
    publish_tables(tables(spark), path, by_month=True)
    stored = load_tables(spark, path)
    assert stored.conversions.schema == tables(spark).conversions.schema
    new = replace(
        tables(spark),
        spend=tables(spark).spend.limit(0),
        conversions=bookings_table(spark, [("z", "2", "2024-02-09", 5), ("n", "2", None, 6), ("m", "1", "2024-03-01", 8)]),
    )
    failed = replace(new, conversions=failing(new.conversions))
    with pytest.raises(Exception, match="lost"):
        replace_months(failed, path)
    assert len(revenues(load_tables(spark, path))) == 4
    replace_months(new, path)
    after = load_tables(spark, path)
    assert revenues(after) == [("a", 10), ("m", 8), ("n", 6), ("z", 5)]
    assert after.spend.count() == 2
    write_tables(tables(spark), f"{path}/plain")
    with pytest.raises(ValueError, match="by month"):
        replace_months(new, f"{path}/plain")


def test_broken_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y z,file\n1,2,3\n4,5\n6,7,8,9\n"a,b",,q\n\n"open,1,2\n')
    whole, rejected = read_csv_with_rejects(spark, str(tmp_path))
    assert [tuple(r) for r in whole.collect()] == [("1", "2", "3"), ("a,b", None, "q")]
    assert [r.line for r in rejected.collect()] == ["4,5", "6,7,8,9", '"open,1,2']
    assert {r.file.rsplit("/", 1)[1] for r in rejected.collect()} == {"a.csv"}
    assert (whole.count(), rejected.count(), whole.select("file").count()) == (2, 3, 2)
    named, _ = read_csv_with_rejects(spark, str(tmp_path), ["broken_line", "b", "c"])
    assert named.columns == ["broken_line", "b", "c"] and named.count() == 3


def test_ingest_sets_broken_lines_aside(spark, tmp_path):
    raw = untidy_star_tables(spark, DATA)
    for key, name in (("spend", "campaign_performance"), ("conversions", "booking_data"), ("entities", "hotel_information")):
        getattr(raw, key).write.option("header", True).csv(f"{tmp_path}/raw/{name}")
    header = ",".join(raw.conversions.columns)
    (tmp_path / "raw/booking_data/more.csv").write_text(f"{header}\nq1,1,31/01/2024,City,5\nq2,1,2024-01-01\n")
    stored = ingest(spark, f"{tmp_path}/raw", f"{tmp_path}/stored", find_date_formats=True, by_month=True)
    assert stored.conversions.count() == raw.conversions.count() + 1
    assert str(stored.conversions.where("booking_id = 'q1'").first().booking_date) == "2024-01-31"
    broken = spark.read.parquet(f"{tmp_path}/stored/rejected").collect()
    assert [(r.table, r.line) for r in broken] == [("booking_data", "q2,1,2024-01-01")]
    report = spark.read.option("header", True).csv(f"{tmp_path}/stored/quality_report").where("`check` = 'rejected'")
    assert [(r.table, r.n) for r in report.collect()] == [("booking_data", "1")]
