"""Edge cases of the named analyses on small literal tables."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.helpers import bookings_table, day, entity_table, months, spend_table
from trichter.operators.islands import with_run_lengths, with_runs
from trichter.plans.anomalies import BAD_DIRECTION, detect_anomalies, flag_anomalies, kpi_zscores
from trichter.plans.comparison import entity_period_kpis, entity_year_comparison, executive_summary
from trichter.plans.divergence import diverging_windows, rising_cost_falling_leads
from trichter.plans.monthly import monthly_kpis
from trichter.plans.segments import segment_entities
from trichter.plans.series import compare_monthly_series, with_month_name
from trichter.plans.trends import month_snapshot_trend, moving_average_trends
from trichter.plans.volatility import lead_volatility


def series(spark, figures, hotel="1", first="2024-01-01"):
    """One spend row per month from (cost, leads); ``None`` leaves the month out."""
    rows = [
        (hotel, month, 1000, 100, f[1], f[0]) for month, f in zip(months(len(figures), first), figures) if f is not None
    ]
    return spend_table(spark, rows)


# ---- divergence


def test_gap_breaks_a_window(spark):
    spend = series(spark, [(1, 30), (2, 20), None, (3, 10)])
    assert diverging_windows(spend, True).count() == diverging_windows(spend, False).count() == 0


def test_dip_is_loose_only(spark):
    spend = series(spark, [(10, 30), (5, 20), (20, 10)])
    assert diverging_windows(spend, True).count() == 0
    assert diverging_windows(spend, False).count() == 1


def test_equal_cost_is_not_rising(spark):
    assert diverging_windows(series(spark, [(10, 30), (10, 20), (20, 10)]), True).count() == 0


def test_equal_scores_take_the_earlier_window(spark):
    figures = [(10, 40), (15, 30), (20, 20), None, (10, 40), (15, 30), (20, 20)]
    rows = rising_cost_falling_leads(series(spark, figures), entity_table(spark, ["1"])).collect()
    assert [r.month_1 for r in rows] == [day("2024-01-01")]
    assert rows[0].ano_score_pct == 1.5


def test_zero_base_counts_as_zero(spark):
    row = rising_cost_falling_leads(series(spark, [(0, 40), (5, 30), (9, 20)]), entity_table(spark, [])).first()
    assert (row.pct_cost_increase, row.pct_leads_drop, row.ano_score_pct) == (None, 0.5, 0.5)


# ---- trends


def trends(spark, leads, revenue, ids=("1",)):
    names = months(len(leads))
    spend = spend_table(spark, [("1", m, 1000, 500, x, 1) for m, x in zip(names, leads)])
    bookings = bookings_table(spark, [(f"b{m}", "1", m, x) for m, x in zip(names, revenue)])
    return moving_average_trends(spend, bookings, entity_table(spark, ids))


def test_flat_leads_are_never_a_trend(spark):
    rows = trends(spark, [0] * 24, [100 * (i % 5) for i in range(24)]).collect()
    assert [r.consecutive_trend for r in rows] == ["Trend not possible"] * 3 + ["stable/mixed (Phase of 21 months)"] * 21
    assert {r.total_months_in_current_trend for r in rows} == {3, 21}


def test_only_long_runs_are_sustained(spark):
    # Frame sums rise while a value exceeds the one three months before.
    steps = ["U", "U", "D", "U", "U", "U"]
    values = [10, 10, 10]
    for step in steps:
        values.append(values[-3] + (1 if step == "U" else -1))
    rows = trends(spark, values, values).collect()[3:]
    assert [(r.total_months_in_current_trend, r.current_month_in_trend) for r in rows] == [
        (2, 1), (2, 2), (1, 1), (3, 1), (3, 2), (3, 3),
    ]
    assert [r.consecutive_trend for r in rows] == ["No sustaining trend (< 3 months)"] * 3 + [
        "increasing (Phase of 3 months)"
    ] * 3


def test_late_and_unknown_entities(spark):
    rows = trends(spark, [5] * 6, [7] * 6, ids=("1", "2")).where("hotel_id = '2'").collect()
    assert len(rows) == 6
    assert all(r.leads == 0 and r.revenue == 0.0 for r in rows)
    only_unknown = trends(spark, [5] * 6, [7] * 6, ids=("2",)).collect()
    assert {r.hotel_id for r in only_unknown} == {"2"}


def test_snapshot_score_adds_rounded_parts(spark):
    names = months(12)
    spend = spend_table(spark, [("1", m, 1000, 500, 30, 1) for m in names])
    bookings = bookings_table(spark, [(m, "1", m, 100 + 7 * i) for i, m in enumerate(names)])
    rows = month_snapshot_trend(spend, bookings, entity_table(spark, ["1"])).collect()
    assert [(r.month, r.trend_3M_mov_av, r.leads_3m_diff_pct, r.revenue_3m_diff_pct, r.trend_score_pct) for r in rows] == [
        (day("2024-12-01"), "stable/mixed", 0.0, 0.04, 0.04)
    ]


def test_runs_of_labels(spark):
    df = spark.createDataFrame(list(enumerate("UUDUUU")), "i int, label string").withColumn("k", F.lit(1))
    runs = with_run_lengths(with_runs(df, ["k"], "label", "i"), ["k"], "i").orderBy("i").collect()
    assert [r.run_id for r in runs] == [1, 1, 2, 3, 3, 3]
    assert [r.run_length for r in runs] == [2, 2, 1, 3, 3, 3]


# ---- segments


def test_scores_map_to_segments(spark):
    n = 40
    spend = spend_table(spark, [(str(i), "2024-01-01", 1000, 500, 10 + i % 7, 5) for i in range(n)])
    bookings = bookings_table(spark, [(f"{i}-{j}", str(i), "2024-02-01", 10) for i in range(n) for j in range(i % 9)])
    rows = segment_entities(spend, bookings, entity_table(spark, [str(i) for i in range(n)])).collect()
    for r in rows:
        assert r.performance_score == r.revenue_q + r.leads_q + r.conversion_q
        expected = "1 Top Performer" if r.performance_score >= 10 else "2 High Performer"
        if r.performance_score < 8:
            expected = "3 Potential / Optimize" if r.performance_score >= 6 else "4 Weak Performer"
        assert r.segment_category == expected
    keys = [(r.segment_category, -r.performance_score, -r.total_revenue) for r in rows]
    assert len(rows) == n and keys == sorted(keys)


def test_bookings_without_spend_are_a_gap(spark):
    spend = spend_table(spark, [("1", "2024-01-01", 10, 5, 2, 1), ("9", "2024-01-01", 10, 5, 2, 1)])
    bookings = bookings_table(spark, [("b", "2", "2025-01-01", 8)])
    entities = entity_table(spark, ["1", "2"])
    gap = segment_entities(spend, bookings, entities).where("hotel_id = '2'").first()
    assert (gap.segment_category, gap.revenue_q, gap.performance_score, gap.total_revenue) == ("5 Gap", None, None, 8.0)
    assert gap.conversion_rate is None
    by_year = segment_entities(spend, bookings, entities, by_year=True).collect()
    assert [(r.year, r.hotel_id, r.segment_category) for r in by_year] == [
        (2025, "2", "5 Gap"), (2025, "1", "5 Gap"), (2024, "1", "4 Weak Performer"), (2024, "2", "5 Gap"),
    ]
    assert monthly_kpis(spend, entities).where("hotel_id = '2'").count() == 0


# ---- comparisons


def test_year_with_bookings_only(spark):
    spend = spend_table(spark, [("1", "2025-03-01", 100, 50, 4, 20)])
    bookings = bookings_table(spark, [("a", "1", "2024-05-01", 30), ("b", "1", "2025-05-01", 60)])
    summary = executive_summary(spend, bookings, (2024, 2025)).first()
    assert (summary.bookings_2024, summary.revenue_2024, summary.bookings_2025, summary.roas_2025) == (None, None, 1, 3.0)
    row = entity_year_comparison(spend, bookings, entity_table(spark, ["1"]), (2024, 2025), "1").first()
    assert (row.bookings_2024, row.revenue_2024, row.cost_2024, row.roas_2024) == (1, 30.0, 0.0, None)
    assert (row.cost_change_pct, row.revenue_change_pct) == (None, 100.0)


def test_rows_without_an_entity_stay_in_the_comparison_of_all(spark):
    spend = spend_table(spark, [("1", "2024-01-01", 10, 5, 2, 7), (None, "2024-02-01", 10, 5, 2, 3)])
    bookings = bookings_table(spark, [("a", "1", "2024-01-05", 20), ("b", None, "2024-01-06", 40)])
    each = entity_year_comparison(spend, bookings, entity_table(spark, ["1"]), (2024, 2025)).collect()
    whole = executive_summary(spend, bookings, (2024, 2025)).first()
    assert {(r.hotel_id, r.cost_2024, r.revenue_2024) for r in each} == {("1", 7.0, 20.0), (None, 3.0, 40.0)}
    assert (sum(r.cost_2024 for r in each), sum(r.revenue_2024 for r in each)) == (whole.cost_2024, whole.revenue_2024)


def test_period_rows_and_change(spark):
    spend = spend_table(
        spark,
        [("18", "2025-06-02", 100, 50, 10, 20), ("18", "2025-08-03", 200, 50, 5, 30), ("7", "2025-06-02", 1, 1, 1, 1)],
    )
    bookings = bookings_table(spark, [("a", "18", "2025-06-09", 40), ("a", "18", "2025-06-10", 40)])
    args = (spend, bookings, entity_table(spark, ["18"]), "18", date(2025, 6, 1), date(2025, 9, 1))
    rows = entity_period_kpis(*args, (date(2025, 6, 1), date(2025, 8, 1))).collect()
    assert [r.zeitraum for r in rows] == ["August 2025", "June 2025", "CHANGE (June vs August %)"]
    august, june, change = rows
    assert (june.bookings, june.revenue, june.roas) == (1.0, 80.0, 4.0)
    assert (august.bookings, august.revenue, august.roas, august.conversion_rate) == (None, None, 0.0, 0.0)
    assert (change.impressions, change.leads, change.ctr_pct, change.revenue) == (100.0, -50.0, -50.0, None)
    missing = entity_period_kpis(*args, (date(2025, 7, 1), date(2025, 8, 1))).collect()[-1]
    assert missing.sort_order == 2 and missing.cost is None
    nobody = entity_period_kpis(*args[:3], "99", *args[4:], (date(2025, 6, 1), date(2025, 8, 1)))
    assert nobody.count() == 0


def test_monthly_series_has_all_months(spark):
    spend = spend_table(spark, [("1", "2024-03-01", 1, 1, 1, "0.10"), ("1", "2023-03-01", 1, 1, 1, 9)])
    rows = with_month_name(compare_monthly_series(spend, bookings_table(spark, []), (2024, 2025))).collect()
    assert [r.month for r in rows] == list(range(1, 13))
    assert [r.month_name for r in rows][:3] == ["January", "February", "March"]
    assert (rows[2].cost_2024, rows[2].cost_2025, rows[0].leads_2024) == (0.1, 0.0, 0)


# ---- anomalies


def z_rows(spark, **scores):
    base = {f"z_{kpi}": 0.0 for kpi in BAD_DIRECTION}
    base.update({f"z_{k}": v for k, v in scores.items()})
    return flag_anomalies(spark.createDataFrame([tuple(base.values())], ", ".join(f"{k} double" for k in base)))


@pytest.mark.parametrize(
    ("scores", "anomaly", "total"),
    [
        ({"lr": -2.0}, "low lead rate", 2.0),
        ({"roas": -1.6, "cpl": 1.6}, "Anomalous combination in performance metrics", 3.2),
        ({"roas": -2.0, "cpl": 2.0, "aov": None}, "ROAS drop, high CPL", 4.0),
        ({"ctr": -3.0, "cpc": 2.5, "aov": -2.2}, "low CTR, high CPC", 7.7),
        ({"roas": -2.1, "aov": -2.2}, "poor ROAS", 4.3),
        ({"aov": -2.2, "cpl": 2.0}, "AOV drop", 4.2),
        ({"cpl": 2.0, "cpc": 2.0}, "high CPL", 4.0),
        ({"cpc": 2.0, "ctr": 9.0}, "high CPC", 2.0),
        ({"ctr": -2.0, "lr": -2.0}, "low CTR", 4.0),
    ],
)
def test_first_matching_cause(spark, scores, anomaly, total):
    row = z_rows(spark, **scores).first()
    assert (row.anomaly, row.anomaly_score) == (anomaly, total)


def test_below_all_thresholds(spark):
    assert z_rows(spark, lr=-1.99, roas=-1.5, cpl=1.49, cpc=1.99, ctr=5.0).count() == 0


def test_single_month_and_constant_kpi_have_no_score(spark):
    one = kpi_zscores(series(spark, [(10, 5)]), bookings_table(spark, [])).first()
    assert {one[f"z_{k}"] for k in BAD_DIRECTION} == {None}
    flat = kpi_zscores(series(spark, [(10, 5)] * 4), bookings_table(spark, [])).collect()
    assert {r.z_cpl for r in flat} == {None}
    assert detect_anomalies(series(spark, [(10, 5)] * 4), bookings_table(spark, []), entity_table(spark, ["1"])).count() == 0


def test_inactive_months_are_outside_the_statistics(spark):
    spend = series(spark, [(10, 5), (11, 6), (0, 5), (12, 0), (13, 9)])
    assert kpi_zscores(spend, bookings_table(spark, [])).count() == 3


# ---- volatility


def test_ties_report_the_earliest_month(spark):
    spend = series(spark, [(1, 9), (2, 3), (3, 9), (4, 3)])
    row = lead_volatility(spend, entity_table(spark, ["1"])).first()
    assert (row.min_month, row.cost_at_min, row.max_month, row.cost_at_max) == (day("2024-02-01"), 2.0, day("2024-01-01"), 1.0)
    assert (row.months, row.total_leads, row.range_leads) == (4, 24, 6)


def test_single_month_ranks_last(spark):
    spend = series(spark, [(1, 9)]).unionAll(series(spark, [(1, 1), (1, 3)], hotel="2"))
    rows = lead_volatility(spend, entity_table(spark, ["1", "2"])).collect()
    assert [(r.volatility_rank, r.hotel_id, r.cv_leads) for r in rows] == [(1, "2", 0.7071), (2, "1", None)]


def test_unknown_leads_never_are_an_extreme(spark):
    spend = series(spark, [(1, 9), (2, None), (3, 4)])
    row = lead_volatility(spend, entity_table(spark, ["1"])).first()
    assert (row.min_leads, row.max_leads, row.months) == (4, 9, 3)


def test_unknown_entities_stay_in_fact_driven_analyses(spark):
    spend = spend_table(spark, [(None, "2024-01-01", 10, 5, 2, "1.50"), ("X", "2024-01-01", 10, 5, 2, 1)])
    rows = monthly_kpis(spend, entity_table(spark, ["1"])).collect()
    assert [(r.hotel_id, r.country, r.cost) for r in rows] == [("X", None, 1.0), (None, None, 1.5)]


def test_cost_is_decimal_in_and_double_out(spark):
    spend = spend_table(spark, [("1", "2024-01-01", 10, 5, 2, Decimal("0.10"))] * 3)
    assert monthly_kpis(spend, entity_table(spark, ["1"])).first().cost == 0.3
