"""Counters on cleaned, not yet repaired tables; one scan per table for all per-row checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trichter.operators.cleaning import clicks_invalid, floor_nonpositive, invalidate_clicks, leads_invalid
from trichter.sources.tables import TABLE_NAMES, FunnelTables


def _counters(df: DataFrame, table: str, checks: dict[tuple[str, str], Column]) -> DataFrame:
    """One aggregate over ``df``, unfolded to rows of (check, table, column, n)."""
    row = df.agg(*[F.count_if(test).alias(f"n{i}") for i, test in enumerate(checks.values())])
    entries = [
        F.struct(
            F.lit(check).alias("check"),
            F.lit(table).alias("table"),
            F.lit(column).alias("column"),
            F.col(f"n{i}").alias("n"),
        )
        for i, (check, column) in enumerate(checks)
    ]
    return row.select(F.inline(F.array(*entries)))


def _named(tables: FunnelTables) -> list[tuple[str, DataFrame]]:
    return [(TABLE_NAMES[key], getattr(tables, key)) for key in TABLE_NAMES]


def _missing(df: DataFrame) -> dict[tuple[str, str], Column]:
    return {("missing", c): F.col(c).isNull() for c in df.columns}


def _nonpositive(df: DataFrame) -> dict[tuple[str, str], Column]:
    return {("nonpositive", c): F.col(c) <= 0 for c in ("cost", "revenue", "clicks", "leads") if c in df.columns}


def missing_counts(tables: FunnelTables) -> DataFrame:
    """Nulls per column, only where there are any."""
    parts = [_counters(df, name, _missing(df)) for name, df in _named(tables)]
    return reduce(DataFrame.unionAll, parts).where("n > 0")


def nonpositive_counts(tables: FunnelTables) -> DataFrame:
    """Values at or below 0 that flooring sets to 0, exact zeros included."""
    facts = [pair for pair in _named(tables) if _nonpositive(pair[1])]
    return reduce(DataFrame.unionAll, [_counters(df, name, _nonpositive(df)) for name, df in facts])


def _staged(spend: DataFrame) -> DataFrame:
    """Original columns plus the verdicts of the plausibility checks, taken in repair order."""
    floor = floor_nonpositive(spend.select("impressions", "clicks", "leads", F.struct("*").alias("row")), ["clicks", "leads"])
    judged = invalidate_clicks(floor.withColumn("bad_clicks", clicks_invalid())).withColumn(
        "bad_leads", leads_invalid()
    )
    return judged.select("row.*", "bad_clicks", "bad_leads")


def _invalid() -> dict[tuple[str, str], Column]:
    return {("invalid", "clicks"): F.col("bad_clicks"), ("invalid", "leads"): F.col("bad_leads")}


def plausibility_counts(tables: FunnelTables) -> DataFrame:
    """Clicks above impressions, and leads above the clicks that remain."""
    return _counters(_staged(tables.spend), TABLE_NAMES["spend"], _invalid())


def duplicate_count(df: DataFrame, table: str, key: str) -> DataFrame:
    """Rows beyond the first per key; null counts as one key."""
    extra = df.groupBy(key).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n"))
    return extra.select(
        F.lit("duplicate").alias("check"), F.lit(table).alias("table"), F.lit(key).alias("column"), "n"
    )


def orphan_rows(fact: DataFrame, entities: DataFrame) -> DataFrame:
    """Fact rows whose entity is unknown or null."""
    return fact.join(entities.select("hotel_id"), "hotel_id", "left_anti")


def orphan_count(fact: DataFrame, entities: DataFrame, table: str) -> DataFrame:
    """How many there are. Rows are counted per entity before the anti join, so that a frequent
    entity or a mass of null ids is one row by the time it is shuffled."""
    unknown = orphan_rows(fact.groupBy("hotel_id").count(), entities)
    return unknown.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n")).select(
        F.lit("orphan").alias("check"), F.lit(table).alias("table"), F.lit("hotel_id").alias("column"), "n"
    )


def orphan_counts(tables: FunnelTables) -> DataFrame:
    return orphan_count(tables.spend, tables.entities, TABLE_NAMES["spend"]).unionAll(
        orphan_count(tables.conversions, tables.entities, TABLE_NAMES["conversions"])
    )


def _fact_report(
    fact: DataFrame, table: str, checks: dict[tuple[str, str], Column], entities: DataFrame, unique: str | None = None
) -> DataFrame:
    """Row checks, orphans and, with ``unique``, duplicates of a fact, from one scan and one shuffle.

    Every row counts under its entity and under its unique key. Both kinds of keys are pre-aggregated
    in one shuffle, so a frequent entity, or a mass of null ids, is one row per task. The grouped rows
    then meet the known entities once, and all counters follow in one last aggregate.
    """
    flags = [test.alias(f"c{i}") for i, test in enumerate(checks.values())]
    keys = [F.struct(F.lit("entity").alias("kind"), F.col("hotel_id").cast("string").alias("key"))]
    if unique is not None:
        keys.append(F.struct(F.lit("unique").alias("kind"), F.col(unique).cast("string").alias("key")))
    grouped = (
        fact.select(*flags, F.inline(F.array(*keys)))
        .groupBy("kind", "key")
        .agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(f"c{i}").alias(f"c{i}") for i in range(len(checks))])
    )
    known = entities.select(F.lit("entity").alias("kind"), F.col("hotel_id").cast("string").alias("key"), F.lit(True).alias("known"))
    met = grouped.join(known.distinct(), ["kind", "key"], "left")
    entity = F.col("kind") == "entity"
    counts = {key: F.when(entity, F.col(f"c{i}")) for i, key in enumerate(checks)}
    if unique is not None:
        counts["duplicate", unique] = F.when(~entity, F.col("rows") - 1)
    counts["orphan", "hotel_id"] = F.when(entity & F.col("known").isNull(), F.col("rows"))
    row = met.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(f"n{i}") for i, n in enumerate(counts.values())])
    entries = [
        F.struct(
            F.lit(check).alias("check"),
            F.lit(table).alias("table"),
            F.lit(column).alias("column"),
            F.col(f"n{i}").alias("n"),
        )
        for i, (check, column) in enumerate(counts)
    ]
    return row.select(F.inline(F.array(*entries)))


def quality_report(tables: FunnelTables) -> DataFrame:
    """All checks as rows of (check, table, column, n); missing values only where there are any.

    Each fact is scanned once.
    """
    spend, conversions, entities = tables.spend, tables.conversions, tables.entities
    parts = [
        _fact_report(
            _staged(spend), TABLE_NAMES["spend"], {**_missing(spend), **_nonpositive(spend), **_invalid()}, entities
        ),
        _fact_report(
            conversions,
            TABLE_NAMES["conversions"],
            {**_missing(conversions), **_nonpositive(conversions)},
            entities,
            unique="booking_id",
        ),
        _counters(entities, TABLE_NAMES["entities"], _missing(entities)),
    ]
    return reduce(DataFrame.unionAll, parts).where((F.col("check") != "missing") | (F.col("n") > 0))


def table_summary(tables: FunnelTables) -> DataFrame:
    """Type, row count and non-null count of every column."""

    def summarise(name: str, df: DataFrame) -> DataFrame:
        row = df.agg(
            F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(f"n{i}") for i, c in enumerate(df.columns)]
        )
        entries = [
            F.struct(
                F.lit(name).alias("table"),
                F.lit(field.name).alias("column"),
                F.lit(field.dataType.simpleString()).alias("type"),
                F.col("rows"),
                F.col(f"n{i}").alias("non_null"),
            )
            for i, field in enumerate(df.schema)
        ]
        return row.select(F.inline(F.array(*entries)))

    return reduce(DataFrame.unionAll, [summarise(name, df) for name, df in _named(tables)])
