"""Calendar columns and period filters that reach the Parquet scan."""

from __future__ import annotations

import re
from collections.abc import Iterable
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Text dates that are understood, ISO with an optional time of day, and these formats.
ISO_DATE = r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}([.]\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
OTHER_FORMATS = ("dd.MM.yyyy", "MM/dd/yyyy")
# Formats a whole column may be in.
COLUMN_FORMATS = ("dd.MM.yyyy", "MM/dd/yyyy", "dd/MM/yyyy", "dd-MM-yyyy", "yyyy/MM/dd", "yyyyMMdd")


# What the parser can read into each field of a format.
_FIELDS = {"dd": "(0[1-9]|[12][0-9]|3[01])", "MM": "(0[1-9]|1[0-2])", "yyyy": "[+-]?[0-9]{4,}"}


def read_date(text: Column, fmt: str) -> Column:
    """``try_to_date``, called only for texts that look like ``fmt``.

    For every text it cannot read the parser throws and catches an exception, which takes far
    longer than the reading. Formats with other fields go to the parser at once, and so does
    everything under a time parser policy with looser rules.
    """
    parsed = F.try_to_date(text, fmt)
    parts = re.split("(dd|MM|yyyy)", fmt)
    if any(re.search("[^-./ ]", literal) for literal in parts[0::2]) or not _strict_parser():
        return parsed
    shape = "".join(_FIELDS[p] if p in _FIELDS else re.escape(p) for p in parts)
    return F.when(text.rlike(f"^{shape}$"), parsed)


def _strict_parser() -> bool:
    session = SparkSession.getActiveSession()
    return session is not None and session.conf.get("spark.sql.legacy.timeParserPolicy").upper() == "CORRECTED"


def coerce_date(value: Column, formats: Iterable[str] = OTHER_FORMATS) -> Column:
    """ISO text or the first format that parses, else null; unparsable text never fails the job."""
    text = F.trim(value.cast("string"))
    iso = F.when(text.rlike(ISO_DATE), text.try_cast("date"))
    return F.coalesce(iso, *[read_date(text, fmt) for fmt in formats])


def with_period(df: DataFrame, date_column: str, *grains: str) -> DataFrame:
    """Add the columns ``month`` (first day), ``year``, ``month_number``, ``iso_year``, ``iso_week`` asked for."""
    day = F.col(date_column)
    columns = {
        "month": F.trunc(day, "MM"),
        "year": F.year(day).cast("long"),
        "month_number": F.month(day).cast("long"),
        "iso_year": F.extract(F.lit("YEAROFWEEK"), day).cast("long"),
        "iso_week": F.weekofyear(day).cast("long"),
    }
    return df.withColumns({grain: columns[grain] for grain in grains})


def _within(day: Column, spans: list[tuple[date, date]]) -> Column:
    """Whether ``day`` is in one of the sorted half-open spans; touching spans become one range."""
    merged: list[tuple[date, date]] = []
    for start, end in spans:
        if merged and merged[-1][1] == start:
            start = merged.pop()[0]
        merged.append((start, end))
    return reduce(
        lambda a, b: a | b,
        [(day >= F.lit(start)) & (day < F.lit(end)) for start, end in merged],
    )


def in_years(day: Column, years: Iterable[int]) -> Column:
    """``year(day) in years`` written as date ranges: a function of the column would not be
    pushed into the scan, a range prunes row groups by their statistics."""
    return _within(day, [(date(y, 1, 1), date(y + 1, 1, 1)) for y in sorted(set(years))])


def in_iso_years(day: Column, years: Iterable[int]) -> Column:
    """Same for ISO week-numbering years, which start on the Monday of week 1."""
    return _within(
        day,
        [(date.fromisocalendar(y, 1, 1), date.fromisocalendar(y + 1, 1, 1)) for y in sorted(set(years))],
    )


def month_text(month: Column) -> Column:
    """``June 2025``."""
    return F.date_format(month, "MMMM yyyy")


def month_name(number: Column) -> Column:
    """``6`` to ``June``."""
    return F.date_format(F.make_date(F.lit(2000), number.cast("int"), F.lit(1)), "MMMM")
