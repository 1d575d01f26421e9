from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.helpers import bookings_table, entity_table, months, spend_table
from trichter.operators.questions import filter_result, intent_counts, tag_intent, with_slots
from trichter.plans.catalogue import Params, answer
from trichter.sources.tables import FunnelTables

QUESTIONS = {
    "Zeig mir die Top 5 Anomalien pro Jahr 2024": "anomalies_by_year",
    "Hotel 18 KPI Juni August": "entity_period_kpis",
    "hotel_id 18 im Vergleich": "entity_year_comparison",
    "Hotel 180 monatlich": "monthly_kpis",
    "": "help",
    "  ": "help",
    "Hilfe bei Hotel 18": "help",
    "Executive Summary 2024 vs 2025": "executive_summary",
    "Management Summary und Budget": "executive_summary",
    "Warum sinken die Leads?": "topic_hypotheses",
    "Welche Daten sollten wir zusätzlich anfordern?": "topic_data",
    "Soll der Kunde das Budget erhöhen?": "topic_budget",
    "Zeitreihe": "series_monthly",
    "Zeitreihe pro KW": "series_weekly",
    "wöchentlich bitte": "series_weekly",
    "Wie ist die CTR?": "monthly_kpis",
    "Hotels mit steigende Kosten und sinkende Leads": "rising_cost_falling_leads_loose",
    "Streng: steigende Kosten": "rising_cost_falling_leads_strict",
    "Trends": "moving_average_trends",
    "Trend, aber stop": "longest_trend_runs",
    "Segmente": "segments_total",
    "Segmente pro Jahr": "segments_by_year",
    "Ausreißer": "anomalies_total",
    "Volatilität per year": "volatility_by_year",
    "Schwankungen": "volatility_total",
    "Gib mir eine Empfehlung": "executive_summary",
    "Wie wird das Wetter?": "unmatched",
}


def log(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "text string")


def test_intents(spark):
    assert {r.text: r.intent for r in tag_intent(log(spark, QUESTIONS)).collect()} == QUESTIONS
    counts = {r.intent: r.n for r in intent_counts(log(spark, QUESTIONS)).collect()}
    assert counts["help"] == 3 and sum(counts.values()) == len(QUESTIONS)


@pytest.mark.parametrize(
    ("text", "top_n", "year", "entity"),
    [
        ("Zeig mir die Top 5 Anomalien pro Jahr 2024", 5, 2024, None),
        ("HOTEL #7 top10", 10, None, "7"),
        ("hotel_id: 12 in 20245", None, None, "12"),
        ("hotel 18a", None, None, None),
        ("Hotel 18 2023 und 2024", None, 2023, None),
        ("top 99999999999999999999", None, None, None),
    ],
)
def test_slots(spark, text, top_n, year, entity):
    row = with_slots(log(spark, [text])).first()
    assert (row.top_n, row.year) == (top_n, year)
    if " " not in text:
        assert row.entity_id == entity


def test_views(spark):
    row = with_slots(log(spark, ["stop: streng, pro Jahr und Woche"])).first()
    assert (row.top_view, row.year_view, row.week_view, row.strict_view) == (True, True, True, True)


def test_filter_uses_existing_columns_only(spark):
    df = spark.createDataFrame([(2024, "1"), (2025, "1"), (2025, "2")], "year int, hotel_id string")
    assert filter_result(df, 2025, "1").collect() == [(2025, "1")]
    assert filter_result(df.drop("year"), 2025, "1").count() == 2
    assert filter_result(df, top_n=2).count() == 2
    assert filter_result(df).count() == 3
    with pytest.raises(ValueError):
        filter_result(df, top_n=2**31)


def test_answers(spark):
    rows = [(h, m, 1000, 100, 10 + i % 3, 5) for h in ("18", "7") for i, m in enumerate(months(24))]
    tables = FunnelTables(
        spend_table(spark, rows), bookings_table(spark, [("b", "18", "2025-06-01", 9)]), entity_table(spark, ["18", "7"])
    )
    monthly = answer(tables, "monatlich für Hotel 7, top 3")
    assert monthly.intent == "monthly_kpis"
    assert [r.month for r in monthly.data.collect()] == ["December 2025", "November 2025", "October 2025"]
    assert {r.hotel_id for r in monthly.data.collect()} == {"7"}
    assert answer(tables, "monatlich").data.count() == 48
    period = answer(tables, "Hotel 18 Juni", Params())
    assert [r.sort_order for r in period.data.collect()] == [1, 1, 1, 2]
    topic = answer(tables, "Budget?")
    assert (topic.intent, topic.data) == ("topic_budget", None)
    assert answer(tables, "Segmente pro Jahr 2024").data.select(F.collect_set("year")).first()[0] == [2024]
