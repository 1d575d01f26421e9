"""Facts stored in buckets by entity: rollups by entity need no shuffle, one entity is one bucket."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trichter.sources import schemas
from trichter.sources.tables import (
    CLUSTERED_BY,
    DAYS,
    TABLE_NAMES,
    FunnelTables,
    clustered,
    declared,
    entity_filters,
    load_tables,
    write_tables,
)
from trichter.sources.versions import current_version, make_current, version_folder

BUCKETED_BY = "hotel_id"
ROWS_A_BUCKET = 1_000_000
_FINEST = 65_536
LAYOUT = "layout"
_FACTS = {"spend": schemas.SPEND, "conversions": schemas.CONVERSIONS}


def publish_colocated(
    tables: FunnelTables,
    path: str,
    buckets: int,
    *,
    database: str = "default",
    most_uneven: float = 4.0,
    rows_a_bucket: int = ROWS_A_BUCKET,
) -> str:
    """Write a new version of the tables with both facts in the same buckets by entity; returns its name.

    Within a bucket, rows are sorted by entity and day. A bucket is written and later read by one
    task, so their number grows with the facts: ``buckets`` is the least one, doubled (up to about
    65,536) until the larger fact has at most ``rows_a_bucket`` rows a bucket. A fact whose largest bucket
    would hold more than ``most_uneven`` times the mean (an entity with a large share of the
    rows, or fewer entities than buckets) is stored by day instead, spread over many files:
    reading stays even, and its rollups shuffle partial sums. The layout is stored with the
    version. Rows without an entity are a bucket's like all others. ``load_tables`` reads the
    same files without their buckets.
    """
    if buckets < 1:
        raise ValueError("at least one bucket is needed")
    if rows_a_bucket < 1:
        raise ValueError("a bucket holds at least one row")
    spark = tables.spend.sparkSession
    version = uuid.uuid4().hex
    folder = version_folder(path, version)
    layout = []
    finest = buckets
    while 2 * finest <= _FINEST:
        finest *= 2
    sizes = {key: _bucket_sizes(getattr(tables, key), finest).persist() for key in _FACTS}
    most = max(df.agg(F.sum("rows")).first()[0] or 0 for df in sizes.values())
    while buckets < finest and buckets * rows_a_bucket < most:
        buckets *= 2
    for key in _FACTS:
        df, name = getattr(tables, key), TABLE_NAMES[key]
        even = _even(sizes[key], buckets, most_uneven)
        sizes[key].unpersist()
        layout.append((key, buckets if even else 0))
        if even:
            writer = entity_filters(df.repartition(buckets, BUCKETED_BY).write.format("parquet"))
            writer = writer.option("path", f"{folder}/{name}").bucketBy(buckets, BUCKETED_BY)
            writer.sortBy(BUCKETED_BY, DAYS[key]).saveAsTable(_table(database, version, name))
        else:
            entity_filters(clustered(df, *CLUSTERED_BY[key]).write).parquet(f"{folder}/{name}")
    entity_filters(tables.entities.write).parquet(f"{folder}/{TABLE_NAMES['entities']}")
    spark.createDataFrame(layout, "fact string, buckets int").coalesce(1).write.parquet(f"{folder}/{LAYOUT}")
    make_current(spark, path, version)
    return version


def load_colocated(spark: SparkSession, path: str, *, database: str = "default") -> FunnelTables:
    """The current version below ``path``, with its buckets where the facts have any.

    Buckets are known to the session by a table of its catalogue; where another session wrote the
    version, the table is declared over its files. Tables without a layout are read plainly.
    """
    plain = load_tables(spark, path)
    version = current_version(spark, path)
    layout = {} if version is None else _layout(spark, version_folder(path, version))
    facts = {}
    for key, schema in _FACTS.items():
        if layout.get(key):
            name = TABLE_NAMES[key]
            table = _table(database, version, name)
            if not spark.catalog.tableExists(table):
                _declare(spark, table, f"{version_folder(path, version)}/{name}", layout[key], DAYS[key])
            facts[key] = declared(spark.table(table), schema, name)
    return replace(plain, **facts)


def _bucket_sizes(df: DataFrame, buckets: int) -> DataFrame:
    """Rows per bucket that occurs, by the hash Spark buckets with."""
    bucket = F.pmod(F.hash(BUCKETED_BY), F.lit(buckets))
    return df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("rows"))


def _even(sizes: DataFrame, buckets: int, most_uneven: float) -> bool:
    """Whether no bucket holds more than ``most_uneven`` times the mean; ``sizes`` may count a multiple of ``buckets``.

    Not so for an empty table, of which buckets would leave no file, and so no columns.
    """
    whole = sizes.groupBy(F.pmod("bucket", F.lit(buckets)).alias("bucket")).agg(F.sum("rows").alias("rows"))
    row = whole.agg(F.max("rows").alias("largest"), F.sum("rows").alias("total")).first()
    return row.total is not None and row.largest * buckets <= most_uneven * row.total


def even_buckets(df: DataFrame, buckets: int, most_uneven: float) -> bool:
    """``_even`` for the rows of a fact."""
    return _even(_bucket_sizes(df, buckets), buckets, most_uneven)


def _layout(spark: SparkSession, folder: str) -> dict[str, int]:
    try:
        rows = spark.read.schema("fact string, buckets int").parquet(f"{folder}/{LAYOUT}").collect()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return {}
        raise
    return {row.fact: row.buckets for row in rows}


def _table(database: str, version: str, name: str) -> str:
    return f"{database}.{name}_{version}"


def _declare(spark: SparkSession, table: str, location: str, buckets: int, day: str) -> None:
    columns = ", ".join(
        f"`{field.name.replace('`', '``')}` {field.dataType.simpleString()}"
        for field in spark.read.parquet(location).schema
    )
    place = location.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet "
        f"CLUSTERED BY ({BUCKETED_BY}) SORTED BY ({BUCKETED_BY}, `{day}`) INTO {buckets} BUCKETS LOCATION '{place}'"
    )
