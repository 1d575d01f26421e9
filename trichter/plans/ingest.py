"""From raw tables to checked, repaired and clustered ones."""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from trichter.operators.cleaning import clean_tables, repair_tables
from trichter.operators.date_formats import chosen_formats, date_format_counts
from trichter.operators.quality import quality_report, table_summary
from trichter.sources import schemas
from trichter.sources.colocated import load_colocated, publish_colocated
from trichter.sources.tables import (
    TABLE_NAMES,
    FunnelTables,
    declared,
    load_raw_csv,
    load_tables,
    publish_tables,
    write_tables,
)


def ingest(
    spark: SparkSession,
    source: str,
    target: str,
    fmt: str = "csv",
    *,
    find_date_formats: bool = False,
    by_month: bool = False,
    buckets: int | None = None,
    **options: Any,
) -> FunnelTables:
    """Clean, report, repair and publish the tables found below ``source``, with all their columns.

    A declared column that is absent after cleaning raises ``ValueError`` before anything is written.

    Writes the cleaned tables as they came (``cleaned/``), the quality report, the repaired
    tables as a new version and their summary below ``target``. The report and the range sort,
    which both pass over the data more than once, start from the cleaned Parquet. Of CSV sources,
    broken lines are set aside in ``rejected/`` and counted in the report, by a pass of their own.
    With ``find_date_formats``, one more pass finds the format of each column of text dates, and
    only that one and ISO are read. ``by_month`` stores facts by month, for ``replace_months``,
    ``buckets`` stores them in that many buckets by entity, for ``load_colocated``; not both.
    """
    if by_month and buckets is not None:
        raise ValueError("facts are stored either by month or in buckets by entity")
    target = target.rstrip("/")
    if fmt == "csv":
        raw, broken = load_raw_csv(spark, source, **options)
    else:
        raw = load_tables(spark, source, fmt, raw=True, **options)
    formats: dict[str, list[str]] = {}
    if find_date_formats:
        formats = chosen_formats(date_format_counts(raw.spend).unionAll(date_format_counts(raw.conversions)))
    tidy = clean_tables(raw, formats)
    checked = FunnelTables(
        declared(tidy.spend, schemas.SPEND, TABLE_NAMES["spend"]),
        declared(tidy.conversions, schemas.CONVERSIONS, TABLE_NAMES["conversions"]),
        declared(tidy.entities, schemas.ENTITIES, TABLE_NAMES["entities"]),
    )
    write_tables(checked, f"{target}/cleaned", cluster=False)
    cleaned = load_tables(spark, f"{target}/cleaned")
    report = quality_report(cleaned)
    if fmt == "csv":
        broken.write.mode("overwrite").parquet(f"{target}/rejected")
        rejected = spark.read.schema(broken.schema).parquet(f"{target}/rejected")
        counted = rejected.groupBy("table").count()
        nowhere = F.lit(None).cast("string").alias("column")
        report = report.unionAll(counted.select(F.lit("rejected"), "table", nowhere, "count"))
    report.write.mode("overwrite").option("header", True).csv(f"{target}/quality_report")
    if buckets is None:
        publish_tables(repair_tables(cleaned), target, by_month=by_month)
    else:
        publish_colocated(repair_tables(cleaned), target, buckets)
    stored = load_colocated(spark, target)
    table_summary(stored).write.mode("overwrite").option("header", True).csv(f"{target}/table_summary")
    return stored
