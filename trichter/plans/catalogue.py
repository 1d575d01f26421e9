"""The catalogue of named analyses: look one up, run them all, or answer a question."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import date

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trichter.functions.text import normalised_question
from trichter.operators.questions import filter_result, intent_of, with_slots
from trichter.plans.anomalies import detect_anomalies
from trichter.plans.comparison import entity_period_kpis, entity_year_comparison, executive_summary
from trichter.plans.divergence import rising_cost_falling_leads
from trichter.plans.monthly import monthly_kpis
from trichter.plans.segments import segment_entities
from trichter.plans.series import compare_monthly_series, compare_weekly_series
from trichter.plans.trends import longest_trend_runs, month_snapshot_trend, moving_average_trends
from trichter.plans.volatility import lead_volatility
from trichter.sources.tables import FunnelTables


@dataclass(frozen=True)
class Params:
    """What the analyses compare and whom they single out."""

    years: tuple[int, int] = (2024, 2025)
    entity_id: str = "18"
    period: tuple[date, date] = (date(2025, 6, 1), date(2025, 9, 1))
    compare: tuple[date, date] = (date(2025, 6, 1), date(2025, 8, 1))


Analysis = Callable[[FunnelTables, Params], DataFrame]

# Only the weekly series needs days; the period slice of one entity reads too little to gain
# from a rollup. All other analyses accept the monthly rollup of the spend fact, and either the one
# of bookings or, if they count none, the one of revenue.
ANALYSES: dict[str, Analysis] = {
    "monthly_kpis": lambda t, p: monthly_kpis(t.spend_by_month, t.entities),
    "rising_cost_falling_leads_strict": lambda t, p: rising_cost_falling_leads(t.spend_by_month, t.entities, True),
    "rising_cost_falling_leads_loose": lambda t, p: rising_cost_falling_leads(t.spend_by_month, t.entities, False),
    "moving_average_trends": lambda t, p: moving_average_trends(t.spend_by_month, t.revenue_by_month, t.entities),
    "longest_trend_runs": lambda t, p: longest_trend_runs(t.spend_by_month, t.revenue_by_month, t.entities),
    "december_snapshot_trend": lambda t, p: month_snapshot_trend(t.spend_by_month, t.revenue_by_month, t.entities),
    "segments_total": lambda t, p: segment_entities(t.spend_by_month, t.bookings_by_month, t.entities),
    "segments_by_year": lambda t, p: segment_entities(t.spend_by_month, t.bookings_by_month, t.entities, by_year=True),
    "series_monthly": lambda t, p: compare_monthly_series(t.spend_by_month, t.revenue_by_month, p.years),
    "series_weekly": lambda t, p: compare_weekly_series(t.spend, t.conversions, p.years),
    "anomalies_total": lambda t, p: detect_anomalies(t.spend_by_month, t.bookings_by_month, t.entities),
    "anomalies_by_year": lambda t, p: detect_anomalies(t.spend_by_month, t.bookings_by_month, t.entities, by_year=True),
    "volatility_total": lambda t, p: lead_volatility(t.spend_by_month, t.entities),
    "volatility_by_year": lambda t, p: lead_volatility(t.spend_by_month, t.entities, by_year=True),
    "executive_summary": lambda t, p: executive_summary(t.spend_by_month, t.bookings_by_month, p.years),
    "entity_year_comparison": lambda t, p: entity_year_comparison(
        t.spend_by_month, t.bookings_by_month, t.entities, p.years, p.entity_id
    ),
    "entity_period_kpis": lambda t, p: entity_period_kpis(
        t.spend, t.conversions, t.entities, p.entity_id, *p.period, p.compare
    ),
}


# Analyses that read the rollups; decides which rollups a run builds.
ON_MONTHLY_SPEND = frozenset(ANALYSES) - {"series_weekly", "entity_period_kpis"}
ON_MONTHLY_REVENUE = frozenset(
    {"moving_average_trends", "longest_trend_runs", "december_snapshot_trend", "series_monthly"}
)
ON_MONTHLY_BOOKINGS = frozenset(
    {
        "segments_total",
        "segments_by_year",
        "anomalies_total",
        "anomalies_by_year",
        "executive_summary",
        "entity_year_comparison",
    }
)


def query(name: str, tables: FunnelTables, params: Params = Params()) -> DataFrame:
    """The result of one named analysis, lazily."""
    if name not in ANALYSES:
        raise KeyError(f"unknown analysis {name!r}; known: {', '.join(sorted(ANALYSES))}")
    return ANALYSES[name](tables, params)


def run_catalogue(
    tables: FunnelTables,
    out_dir: str,
    params: Params = Params(),
    names: Iterable[str] | None = None,
    fmt: str = "csv",
    side_by_side: int = 1,
) -> list[str]:
    """Write every named analysis below ``out_dir``; returns the folders, in name order.

    Each fact is rolled up once, below ``out_dir``/_rollups, if a chosen analysis reads the rollup.
    Results are written by the executors. Up to ``side_by_side`` analyses are planned and run at
    the same time, so that one fills the cores which another leaves idle. Each is a scheduler pool of its
    own: in a session with ``spark.scheduler.mode=FAIR``, as ``build_session`` makes it, a long
    one does not hold up the others. If an analysis fails, the others are still finished, then
    the first failure in name order is raised with a note that names all that failed.
    """
    chosen = sorted(ANALYSES if names is None else set(names))
    unknown = [name for name in chosen if name not in ANALYSES]
    if unknown:
        raise KeyError(f"unknown analyses {', '.join(unknown)}; known: {', '.join(sorted(ANALYSES))}")
    if side_by_side < 1:
        raise ValueError("side_by_side must be at least 1")
    tables = tables.with_rollups(
        f"{out_dir.rstrip('/')}/_rollups",
        spend=not ON_MONTHLY_SPEND.isdisjoint(chosen),
        revenue=not ON_MONTHLY_REVENUE.isdisjoint(chosen),
        bookings=not ON_MONTHLY_BOOKINGS.isdisjoint(chosen),
    )
    spark = tables.spend.sparkSession

    def write(name: str) -> str:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        folder = f"{out_dir.rstrip('/')}/{name}"
        writer = query(name, tables, params).write.mode("overwrite")
        (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(folder)
        return folder

    with ThreadPoolExecutor(side_by_side, "analysis") as pool:
        # Wrapped one by one: each run starts from the local properties of this thread.
        runs = {name: pool.submit(inheritable_thread_target(spark)(write), name) for name in chosen}
    failed = [name for name, run in runs.items() if run.exception() is not None]
    if failed:
        error = runs[failed[0]].exception()
        error.add_note(f"analyses that failed: {', '.join(failed)}")
        raise error
    return [run.result() for run in runs.values()]


@dataclass(frozen=True)
class Answer:
    """What a question was taken to mean, and the narrowed result if an analysis answers it."""

    intent: str
    data: DataFrame | None


def answer(tables: FunnelTables, question: str, params: Params = Params()) -> Answer:
    """Route one question with the same rules that tag a whole question log."""
    asked = tables.spend.sparkSession.createDataFrame([(question,)], "text string")
    slots = with_slots(asked).withColumn(
        "intent", intent_of(normalised_question(F.col("text")), params.entity_id)
    )
    row = slots.first()
    if row.intent not in ANALYSES:
        return Answer(row.intent, None)
    result = query(row.intent, tables, params)
    return Answer(row.intent, filter_result(result, row.year, row.entity_id, row.top_n))
