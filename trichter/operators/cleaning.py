"""Tidy raw tables and repair implausible values, all as column expressions in one projection."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, FloatType, StringType, TimestampNTZType, TimestampType

from trichter.functions.dates import OTHER_FORMATS, coerce_date
from trichter.functions.text import stripped, title_case
from trichter.sources.schemas import MONEY
from trichter.sources.tables import FunnelTables

# The columns of each kind.
DATES = ("date", "booking_date")
IDENTIFIERS = ("campaign_id", "hotel_id", "booking_id", "hotel_category", "campaign_type", "travel_type")
CATEGORIES = ("campaign_type", "travel_type", "hotel_category")
COUNTS = ("impressions", "clicks", "leads")
AMOUNTS = ("cost", "revenue")


def clean_column_names(df: DataFrame) -> DataFrame:
    """Strip, lower-case, blanks to underscores, and the one misspelt header corrected."""
    names = [c.strip().lower().replace(" ", "_").replace("traveltype", "travel_type") for c in df.columns]
    return df.toDF(*names)


def ids_to_string(df: DataFrame, columns: Iterable[str] = IDENTIFIERS) -> DataFrame:
    """Cast those of ``columns`` that exist."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns if c in df.columns})


def normalise_category(text: Column) -> Column:
    return title_case(stripped(text))


def _number(df: DataFrame, name: str, target: str) -> Column:
    """Typed number; NaN and whatever does not fit the type become null."""
    kind = df.schema[name].dataType
    value = F.col(name)
    if isinstance(kind, StringType):
        # Amounts keep all their digits: text goes to decimal, never through a double.
        value = F.trim(value).try_cast("decimal(38,6)")
    elif isinstance(kind, (DoubleType, FloatType)):
        value = F.when(~F.isnan(value), value)
    return value.try_cast(target)


def _day(df: DataFrame, name: str, formats: Iterable[str]) -> Column:
    """Typed dates and timestamps as they are; only text is parsed."""
    kind = df.schema[name].dataType
    if isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
        return F.col(name).cast("date")
    return coerce_date(F.col(name), formats)


def clean_table(df: DataFrame, date_formats: Mapping[str, Iterable[str]] | None = None) -> DataFrame:
    """Column names, dates, identifiers, categories and number types; other columns stay as they are.

    ``date_formats`` names, per date column, what text dates may look like besides ISO.
    """
    date_formats = date_formats or {}
    tidy = ids_to_string(clean_column_names(df))
    present = set(tidy.columns)
    changes: dict[str, Column] = {}
    changes |= {c: _day(tidy, c, date_formats.get(c, OTHER_FORMATS)) for c in DATES if c in present}
    changes |= {c: normalise_category(F.col(c)) for c in CATEGORIES if c in present}
    changes |= {c: _number(tidy, c, "bigint") for c in COUNTS if c in present}
    changes |= {c: _number(tidy, c, MONEY.simpleString()) for c in AMOUNTS if c in present}
    return tidy.withColumns(changes)


def clean_tables(raw: FunnelTables, date_formats: Mapping[str, Iterable[str]] | None = None) -> FunnelTables:
    return FunnelTables(
        clean_table(raw.spend, date_formats), clean_table(raw.conversions, date_formats), clean_table(raw.entities)
    )


def floored(df: DataFrame, name: str) -> Column:
    """Values at or below 0 become 0; null stays null."""
    value = F.col(name)
    return F.when(value <= 0, F.lit(0).cast(df.schema[name].dataType)).otherwise(value)


def floor_nonpositive(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.withColumns({c: floored(df, c) for c in columns if c in df.columns})


def clicks_invalid() -> Column:
    return F.col("clicks") > F.col("impressions")


def leads_invalid() -> Column:
    return F.col("leads") > F.col("clicks")


def invalidate_clicks(df: DataFrame) -> DataFrame:
    """More clicks than impressions: unknown."""
    return df.withColumn("clicks", F.when(clicks_invalid(), F.lit(None)).otherwise(F.col("clicks")))


def invalidate_leads(df: DataFrame) -> DataFrame:
    """More leads than clicks: unknown. Unknown clicks say nothing about leads."""
    return df.withColumn("leads", F.when(leads_invalid(), F.lit(None)).otherwise(F.col("leads")))


def repair_spend(spend: DataFrame) -> DataFrame:
    """Floor first, then clicks, then leads: each step reads the result of the one before."""
    return invalidate_leads(invalidate_clicks(floor_nonpositive(spend, ["cost", "clicks", "leads"])))


def repair_tables(tables: FunnelTables) -> FunnelTables:
    """Repaired facts. Rows of unknown entities are kept; the quality report counts them."""
    return replace(
        tables,
        spend=repair_spend(tables.spend),
        conversions=floor_nonpositive(tables.conversions, ["revenue"]),
    )
