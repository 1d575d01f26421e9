"""Classify a log of free-text questions: slots, view modifiers and intent."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trichter.functions.text import normalised_question

# Patterns that pull a slot out of a normalised question.
TOP_N_PATTERN = r"top\s*(\d+)"
YEAR_PATTERN = r"\b(20\d{2})\b"
ENTITY_PATTERN = r"\bhotel(?:_id)?\s*[:#-]?\s*(\d+)\b"

# Keywords that ask for a certain view.
TOP_VIEW = ("top trend", "top")
YEAR_VIEW = ("jahr", "jahre", "year", "years", "pro jahr", "per year", "by year")
WEEK_VIEW = ("woechentlich", "weekly", "woche", "kw", "kalenderwoche")
STRICT_VIEW = ("konsekutiv", "streng", "3 monate am stueck", "drei monate am stueck")
PERIOD_VIEW = ("juni", "june", "august", "aug", "jun", "kritische phase", "jun aug", "juni august")

HELP = "help"
UNMATCHED = "unmatched"
# Words that ask for help.
HELP_WORDS = ("hilfe", "help", "was kannst", "beispiele")


@dataclass(frozen=True)
class Rule:
    """``intent`` if any of ``words`` occurs, or ``special`` if a word of ``view`` occurs too."""

    words: tuple[str, ...]
    intent: str
    view: tuple[str, ...] = ()
    special: str = ""


# Rules in order of precedence, after help and the questions about the focus entity.
RULES = (
    Rule(("executive summary", "management summary", "gesamtvergleich", "2024 vs", "2025 vs"), "executive_summary"),
    Rule(("hypothese", "hypothesen", "gruende", "warum"), "topic_hypotheses"),
    Rule(("zusaetzliche daten", "welche daten", "must have", "nice to have"), "topic_data"),
    Rule(("budget", "erhoehen", "werbebudget"), "topic_budget"),
    Rule(
        ("zeitreihe", "time series", "zeitverlauf", "woechentlich", "weekly", "woche"),
        "series_monthly",
        WEEK_VIEW,
        "series_weekly",
    ),
    Rule(("monatlich", "monthly", "ctr", "cpc", "conversion rate", "performance pro hotel"), "monthly_kpis"),
    Rule(
        ("steigende kosten", "sinkende leads", "auffaellig", "rising", "sinking"),
        "rising_cost_falling_leads_loose",
        STRICT_VIEW,
        "rising_cost_falling_leads_strict",
    ),
    Rule(
        ("moving average", "gleitender durchschnitt", "trend", "trends"),
        "moving_average_trends",
        TOP_VIEW,
        "longest_trend_runs",
    ),
    Rule(("segment", "segmente", "segmentierung"), "segments_total", YEAR_VIEW, "segments_by_year"),
    Rule(
        ("anomalie", "anomalien", "anomaly", "ausreisser"), "anomalies_total", YEAR_VIEW, "anomalies_by_year"
    ),
    Rule(
        ("volatil", "volatilitaet", "schwankung", "schwankungen"),
        "volatility_total",
        YEAR_VIEW,
        "volatility_by_year",
    ),
    Rule(("handlungsempfehlung", "empfehlung", "summary"), "executive_summary"),
)


def mentions(question: Column, words: tuple[str, ...]) -> Column:
    """Whether any of ``words`` occurs, also inside a longer word."""
    return question.rlike("|".join(words))


def focus_pattern(entity_id: str) -> str:
    # The two ways to name the focus entity.
    name = re.escape(entity_id)
    return rf"\bhotel\s*{name}\b|\bhotel_id\s*{name}\b"


def intent_of(question: Column, focus_entity: str = "18") -> Column:
    """First matching rule for a normalised question."""
    about_focus = question.rlike(focus_pattern(focus_entity))
    chain = (
        F.when((question == "") | mentions(question, HELP_WORDS), HELP)
        .when(about_focus & mentions(question, PERIOD_VIEW), "entity_period_kpis")
        .when(about_focus, "entity_year_comparison")
    )
    for rule in RULES:
        matches = mentions(question, rule.words)
        if rule.view:
            chain = chain.when(matches & mentions(question, rule.view), rule.special)
        chain = chain.when(matches, rule.intent)
    return chain.otherwise(UNMATCHED)


def _extract(question: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(question, pattern, 1), F.lit(""))


def with_slots(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``top_n``, ``year``, ``entity_id`` and the view flags; a slot that is not named, or a number too large, is null."""
    question = normalised_question(F.col(text))
    return df.withColumns(
        {
            "top_n": _extract(question, TOP_N_PATTERN).try_cast("bigint"),
            "year": _extract(question, YEAR_PATTERN).try_cast("bigint"),
            "entity_id": _extract(question, ENTITY_PATTERN),
            "top_view": mentions(question, TOP_VIEW),
            "year_view": mentions(question, YEAR_VIEW),
            "week_view": mentions(question, WEEK_VIEW),
            "strict_view": mentions(question, STRICT_VIEW),
        }
    )


def tag_intent(df: DataFrame, text: str = "text", focus_entity: str = "18") -> DataFrame:
    """Add ``intent``."""
    return df.withColumn("intent", intent_of(normalised_question(F.col(text)), focus_entity))


def intent_counts(df: DataFrame, text: str = "text", focus_entity: str = "18") -> DataFrame:
    """How often each intent occurs."""
    return tag_intent(df, text, focus_entity).groupBy("intent").agg(F.count(F.lit(1)).alias("n"))


def filter_result(
    df: DataFrame, year: int | None = None, entity_id: str | None = None, top_n: int | None = None
) -> DataFrame:
    """Narrow a result to a year and an entity where it has such columns, then, if ``top_n`` is
    given, take the first rows in its order. Values compare as text."""
    if year is not None and "year" in df.columns:
        df = df.where(F.col("year").cast("string") == str(year))
    if entity_id is not None and "hotel_id" in df.columns:
        df = df.where(F.col("hotel_id").cast("string") == entity_id)
    if top_n is None:
        return df
    if not 0 <= top_n < 2**31:
        raise ValueError(f"cannot take the first {top_n} rows")
    return df.limit(top_n)
