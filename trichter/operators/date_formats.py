"""The format of a column of text dates, found from the whole column."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from trichter.functions.dates import COLUMN_FORMATS, coerce_date, read_date
from trichter.operators.cleaning import DATES, clean_column_names


def date_format_counts(
    df: DataFrame, columns: Iterable[str] = DATES, formats: Iterable[str] = COLUMN_FORMATS
) -> DataFrame:
    """Rows of (``column``, ``format``, ``parsed``, ``others``, ``ambiguous``, ``chosen``) for each column of text dates.

    ``others`` counts the texts that are neither null, blank nor ISO: only for these the format
    matters, and ``parsed`` is how many of them it reads. The format that reads most is chosen, of
    equals the first in ``formats``; it is ambiguous if another one reads as many and a different
    day in some row. A column without other texts has no chosen format. Columns that are absent or
    typed are left out. One scan, one row per task is shuffled.
    """
    tidy = clean_column_names(df)
    formats = list(formats)
    names = [c for c in columns if c in tidy.columns and isinstance(tidy.schema[c].dataType, StringType)]
    read, counters, entries = [], [], []
    for i, name in enumerate(names):
        text = F.trim(name)
        other = (text != "") & coerce_date(text, ()).isNull()
        # Columns of their own, so that a text is parsed once, however many counters use it.
        read.append(other.alias(f"other{i}"))
        read += [F.when(other, read_date(text, fmt)).alias(f"day{i}_{j}") for j, fmt in enumerate(formats)]
        days = [F.col(f"day{i}_{j}") for j in range(len(formats))]
        counters.append(F.count_if(f"other{i}").alias(f"o{i}"))
        for j, day in enumerate(days):
            counters.append(F.count(day).alias(f"p{i}_{j}"))
            differs = [F.count_if(~day.eqNullSafe(rival)).alias(f"d{i}_{j}_{k}") for k, rival in enumerate(days) if k != j]
            counters += differs
            rivals = [(F.col(f"p{i}_{k}") == F.col(f"p{i}_{j}")) & (F.col(f"d{i}_{j}_{k}") > 0) for k in range(len(days)) if k != j]
            ambiguous = F.lit(False)
            for rival in rivals:
                ambiguous = ambiguous | rival
            entries.append(
                F.struct(
                    F.lit(name).alias("column"),
                    F.lit(formats[j]).alias("format"),
                    F.lit(j).alias("place"),
                    F.col(f"p{i}_{j}").alias("parsed"),
                    F.col(f"o{i}").alias("others"),
                    (ambiguous & (F.col(f"p{i}_{j}") > 0)).alias("ambiguous"),
                )
            )
    if not entries:
        schema = "column string, format string, parsed bigint, others bigint, ambiguous boolean, chosen boolean"
        return df.sparkSession.createDataFrame([], schema)
    best = Window.partitionBy("column").orderBy(F.desc("parsed"), "place")
    rows = tidy.select(*read).agg(*counters).select(F.inline(F.array(*entries)))
    chosen = (F.row_number().over(best) == 1) & (F.col("parsed") > 0)
    return rows.withColumn("chosen", chosen).drop("place")


def chosen_formats(counts: DataFrame) -> dict[str, list[str]]:
    """Per column the format to read it with, for ``clean_table``; at most one row per column reaches the driver."""
    return {row.column: [row.format] for row in counts.where("chosen").select("column", "format").collect()}
