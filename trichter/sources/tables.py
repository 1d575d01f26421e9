"""Read and write the three funnel tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trichter.operators.rollup import compact_bookings, compact_revenue, compact_spend
from trichter.sources import schemas
from trichter.sources.rejects import read_csv_with_rejects
from trichter.sources.versions import current_version, make_current, version_folder

STORED_MONTH = "stored_month"

TABLE_NAMES = {
    "spend": "campaign_performance",
    "conversions": "booking_data",
    "entities": "hotel_information",
}

# The day of each fact, and the order its rows are stored in.
DAYS = {"spend": "date", "conversions": "booking_date"}
CLUSTERED_BY = {
    "spend": ("date", "hotel_id", "campaign_id"),
    "conversions": ("booking_date", "hotel_id", "booking_id"),
}


@dataclass(frozen=True)
class FunnelTables:
    """Spend fact, conversion fact and entity dimension, plus optional monthly rollups of both facts."""

    spend: DataFrame
    conversions: DataFrame
    entities: DataFrame
    monthly_spend: DataFrame | None = None
    monthly_revenue: DataFrame | None = None
    monthly_bookings: DataFrame | None = None

    @property
    def spend_by_month(self) -> DataFrame:
        """The spend fact at month grain or finer, for analyses that need no finer grain."""
        return self.spend if self.monthly_spend is None else self.monthly_spend

    @property
    def revenue_by_month(self) -> DataFrame:
        """The conversion fact at month grain or finer, for analyses that also need no bookings."""
        return self.conversions if self.monthly_revenue is None else self.monthly_revenue

    @property
    def bookings_by_month(self) -> DataFrame:
        """The conversion fact with its booking ids at month grain or finer, for analyses that count bookings."""
        return self.conversions if self.monthly_bookings is None else self.monthly_bookings

    def with_rollups(
        self, path: str, spend: bool = True, revenue: bool = True, bookings: bool = True
    ) -> "FunnelTables":
        """Scan each fact once and keep its monthly rollups, as Parquet below ``path``, for all later analyses.

        With ``bookings``, the rollup of revenue is taken from that of bookings.
        """

        def stored(df: DataFrame, name: str) -> DataFrame:
            location = f"{path.rstrip('/')}/{name}"
            df.write.mode("overwrite").parquet(location)
            return df.sparkSession.read.schema(df.schema).parquet(location)

        monthly_bookings = stored(compact_bookings(self.conversions), "monthly_bookings") if bookings else None
        sales = self.conversions if monthly_bookings is None else monthly_bookings
        return replace(
            self,
            monthly_bookings=monthly_bookings,
            monthly_spend=stored(compact_spend(self.spend), "monthly_spend") if spend else None,
            monthly_revenue=stored(compact_revenue(sales), "monthly_revenue") if revenue else None,
        )


def load_tables(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    *,
    raw: bool = False,
    names: dict[str, str] | None = None,
    **options: Any,
) -> FunnelTables:
    """Read ``<path>/<table>`` for each table; a missing table raises ``FileNotFoundError`` at once.

    Clean tables must have all declared columns, in any order; an absent one raises ``ValueError``
    and is named. Declared columns come first, with their declared types, others follow as they
    are stored. CSV columns go by the names in the header and are read as text first, so no
    inference scan is needed; values that do not fit their type fail. ``raw=True`` is for
    untidy sources: the columns stay as they are for the cleaning step. Where versions were
    published below ``path``, the last one is read.
    """
    names = {**TABLE_NAMES, **(names or {})}
    version = current_version(spark, path)
    if version is not None:
        path = version_folder(path, version)

    def read(key: str, schema: StructType) -> DataFrame:
        reader = spark.read.format(fmt).options(**options)
        if fmt == "csv":
            reader = reader.option("header", True).option("enforceSchema", False)
        if not raw and fmt == "json":
            reader = reader.schema(schema)
        location = f"{path.rstrip('/')}/{names[key]}"
        with _needed(names[key], fmt, location):
            df = reader.load(location)
        return df if raw else declared(df.drop(STORED_MONTH), schema, names[key])

    return FunnelTables(
        read("spend", schemas.SPEND),
        read("conversions", schemas.CONVERSIONS),
        read("entities", schemas.ENTITIES),
    )


@contextmanager
def _needed(name: str, fmt: str, location: str) -> Iterator[None]:
    try:
        yield
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no {fmt} data for table {name!r} at {location}") from error
        raise


def load_raw_csv(
    spark: SparkSession, path: str, names: dict[str, str] | None = None, **options: Any
) -> tuple[FunnelTables, DataFrame]:
    """Untidy CSV tables as text, and their broken lines as rows of (``table``, ``line``, ``file``)."""
    names = {**TABLE_NAMES, **(names or {})}
    whole: dict[str, DataFrame] = {}
    broken: list[DataFrame] = []
    for key, name in names.items():
        location = f"{path.rstrip('/')}/{name}"
        with _needed(name, "csv", location):
            whole[key], rejected = read_csv_with_rejects(spark, location, **options)
        broken.append(rejected.select(F.lit(name).alias("table"), "line", "file"))
    return FunnelTables(**whole), reduce(DataFrame.unionAll, broken)


def declared(df: DataFrame, schema: StructType, name: str) -> DataFrame:
    """Declared columns first and in their types, all others behind them; absent ones raise."""
    absent = [field.name for field in schema if field.name not in df.columns]
    if absent:
        raise ValueError(f"table {name!r} lacks the columns {', '.join(absent)}; it has {', '.join(df.columns)}")
    known = [df[field.name].cast(field.dataType).alias(field.name) for field in schema]
    return df.select(*known, *[df[c] for c in df.columns if c not in schema.names])


def write_tables(
    tables: FunnelTables,
    path: str | None = None,
    fmt: str = "parquet",
    *,
    database: str | None = None,
    names: dict[str, str] | None = None,
    cluster: bool = True,
    by_month: bool = False,
) -> None:
    """Create or replace the three tables, as files under ``path`` or as catalog tables in ``database``.

    With ``by_month``, facts get one folder a month, which ``replace_months`` can replace alone.
    With ``cluster``, facts are range-partitioned by day, then entity: period filters skip files
    and row groups by their statistics, and because the entity and row ids are part of the range,
    one busy day or entity still spreads over many files. Parquet gets bloom filters of the entity ids.
    """
    if (path is None) == (database is None):
        raise ValueError("give either a path or a database")
    names = {**TABLE_NAMES, **(names or {})}
    frames = {"spend": tables.spend, "conversions": tables.conversions, "entities": tables.entities}
    if cluster:
        frames |= {key: clustered(frames[key], *columns) for key, columns in CLUSTERED_BY.items()}
    for key, df in frames.items():
        if by_month and key in DAYS:
            df = df.withColumn(STORED_MONTH, F.trunc(DAYS[key], "MM"))
        writer = df.write.format(fmt).mode("overwrite")
        if fmt == "csv":
            writer = writer.option("header", True)
        if fmt == "parquet":
            writer = entity_filters(writer)
        if by_month and key in DAYS:
            writer = writer.partitionBy(STORED_MONTH)
        if database is None:
            writer.save(f"{path.rstrip('/')}/{names[key]}")
        else:
            writer.saveAsTable(f"{database}.{names[key]}")


def publish_tables(tables: FunnelTables, path: str, **options: Any) -> str:
    """Write the tables as a new version below ``path`` and make it the current one; returns its name.

    Readers see the old version until all three tables are complete, and then only the new one.
    Earlier versions stay, so that running readers can finish. ``options`` are those of ``write_tables``.
    """
    version = uuid.uuid4().hex
    write_tables(tables, version_folder(path, version), **options)
    make_current(tables.spend.sparkSession, path, version)
    return version


def replace_months(tables: FunnelTables, path: str, fmt: str = "parquet", names: dict[str, str] | None = None) -> None:
    """Replace those months of each stored fact that occur in the given one; all others stay untouched.

    The stored facts must have been written with ``by_month``. Rows without a date are a month of
    their own. A month is replaced when its whole job has succeeded; a job that fails changes
    nothing. The facts are replaced one after the other; entities are left alone.
    """
    names = {**TABLE_NAMES, **(names or {})}
    version = current_version(tables.spend.sparkSession, path)
    folder = path.rstrip("/") if version is None else version_folder(path, version)
    for key, df in (("spend", tables.spend), ("conversions", tables.conversions)):
        location = f"{folder}/{names[key]}"
        stored = df.sparkSession.read.format(fmt).load(location).columns
        if STORED_MONTH not in stored:
            raise ValueError(f"table {names[key]!r} at {location} is not stored by month")
        dated = clustered(df, *CLUSTERED_BY[key]).withColumn(STORED_MONTH, F.trunc(DAYS[key], "MM"))
        writer = dated.write.format(fmt).mode("overwrite").option("partitionOverwriteMode", "dynamic")
        if fmt == "csv":
            writer = writer.option("header", True)
        if fmt == "parquet":
            writer = entity_filters(writer)
        writer.partitionBy(STORED_MONTH).save(location)


def entity_filters(writer: DataFrameWriter) -> DataFrameWriter:
    """Parquet with a bloom filter of the entity ids in each row group, sized by the ids that occur.

    A query for one entity then skips row groups without it where their range of ids covers it.
    """
    return writer.option("parquet.bloom.filter.enabled#hotel_id", "true").option(
        "parquet.bloom.filter.adaptive.enabled#hotel_id", "true"
    )


def clustered(df: DataFrame, *columns: str) -> DataFrame:
    """Range-partitioned and sorted, for files and row groups of narrow ranges."""
    return df.repartitionByRange(*columns).sortWithinPartitions(*columns)

