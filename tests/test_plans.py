"""What the physical plans must and must not contain."""

from __future__ import annotations

import re

import pytest

from trichter.operators.quality import quality_report
from trichter.plans.catalogue import ANALYSES, query
from trichter.plans.registered import STAR_PARAMS
from trichter.plans.segments import entity_totals
from trichter.plans.trends import trend_runs
from trichter.sources.star import star_tables
from trichter.sources.tables import load_tables, write_tables


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("planned"))
    write_tables(star_tables(spark, "/root/testdata/sf0.001"), folder)
    return load_tables(spark, folder)


@pytest.fixture(autouse=True)
def whole_filters_in_plans(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def main_plan(text: str) -> str:
    """The plan without its scalar subqueries."""
    lines, skip = [], None
    for line in text.split("\n"):
        depth = len(line) - len(line.lstrip(" :+-"))
        if skip is not None and depth > skip:
            continue
        skip = depth if "Subquery subquery" in line and "+- Subquery" in line else None
        if skip is None:
            lines.append(line)
    return "\n".join(lines)


@pytest.mark.parametrize("name", sorted(ANALYSES))
def test_no_cross_join_no_python_no_gathered_rows(tables, name):
    text = plan(query(name, tables, STAR_PARAMS))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "Python" not in text and "Pandas" not in text
    for line in main_plan(text).split("\n"):
        if "Exchange SinglePartition" in line:
            # Only after a limit, or for the one-row overall comparison.
            assert name in ("anomalies_total", "volatility_total", "executive_summary"), line


def test_trend_windows_share_one_exchange(tables):
    text = main_plan(plan(trend_runs(tables.spend, tables.conversions, tables.entities)))
    exchanges = [line for line in text.split("\n") if re.search(r"[^t] *Exchange (hash|range)", line)]
    assert len(exchanges) == 2, exchanges
    assert sum("REPARTITION_BY_COL" in line for line in exchanges) == 1
    assert len(re.findall(r"- Sort \[", text)) == 1


def test_ordered_trends_are_shuffled_twice_in_all(tables):
    text = main_plan(plan(query("moving_average_trends", tables, STAR_PARAMS)))
    exchanges = re.findall(r"[^t] *Exchange (hash|range)partitioning", text)
    assert exchanges == ["range", "hash"]


@pytest.mark.parametrize(
    "name", ["series_monthly", "series_weekly", "executive_summary", "entity_year_comparison", "entity_period_kpis"]
)
def test_period_filters_reach_both_scans(tables, name):
    text = plan(query(name, tables, STAR_PARAMS))
    pushed = [line for line in text.split("\n") if "PushedFilters" in line]
    dated = [line for line in pushed if "GreaterThanOrEqual(date," in line or "GreaterThanOrEqual(booking_date," in line]
    facts = [line for line in pushed if "campaign_performance" in line or "booking_data" in line]
    assert facts and len(dated) == len(facts)


@pytest.mark.parametrize(("name", "columns"), [("monthly_kpis", 6), ("volatility_total", 4)])
def test_only_needed_columns_are_read(tables, name, columns):
    text = query(name, tables, STAR_PARAMS)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in text.split("\n") if "campaign_performance" in line)
    assert scan.split("FileScan parquet [")[1].split("]")[0].count(",") + 1 == columns


def test_revenue_only_analyses_skip_the_booking_shuffle(tables):
    for name in ("moving_average_trends", "series_monthly"):
        assert "booking_id" not in plan(query(name, tables, STAR_PARAMS))


def test_top_k_per_group_is_limited_before_its_shuffle(tables):
    for name in ("anomalies_by_year", "volatility_by_year"):
        assert plan(query(name, tables, STAR_PARAMS)).count("WindowGroupLimit") == 2
    for name in ("anomalies_total", "volatility_total", "rising_cost_falling_leads_strict"):
        assert "TakeOrderedAndProject" in plan(query(name, tables, STAR_PARAMS))


def test_quality_report_scans_each_fact_once(spark, tables):
    text = main_plan(plan(quality_report(tables)))
    scans = [line.split("FileScan parquet [")[1].split("]")[0] for line in text.split("\n") if "FileScan parquet [" in line]
    assert sum("impressions" in scan for scan in scans) == 1
    assert sum("booking_id" in scan for scan in scans) == 1


@pytest.mark.parametrize("name", ["moving_average_trends", "longest_trend_runs", "december_snapshot_trend", "segments_by_year"])
def test_calendars_start_from_the_sums(spark, tables, name):
    """One scan per fact: the calendar and the series read the same exchange of sums."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else reuse shows only as the query runs
    try:
        if name == "segments_by_year":
            text = plan(entity_totals(tables.spend, tables.conversions, tables.entities, by_year=True))
        else:
            text = plan(query(name, tables, STAR_PARAMS))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    scans = [line for line in text.split("\n") if "FileScan parquet" in line]
    assert sum("campaign_performance" in line for line in scans) == 1
    assert sum("booking_data" in line for line in scans) == 1
    assert "ReusedExchange" in text
