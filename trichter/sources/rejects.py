"""CSV whose broken lines are set aside with their text and file, in place of nulls or a failed job."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv_with_rejects(
    spark: SparkSession, location: str | list[str], columns: Iterable[str] | None = None, **options: Any
) -> tuple[DataFrame, DataFrame]:
    """Whole lines as text columns, and the broken ones as (``line``, ``file``).

    A line is broken if it has fewer or more fields than the header. Files carry a header unless
    ``columns`` names the fields. Values stay text, also empty ones as nulls: the cleaning step gives them their types.
    Both results are lazy and read the files by themselves; each is one scan without a shuffle.
    """
    if columns is None:
        reader = spark.read.options(**options).option("header", True)
        names = reader.csv(location).columns
    else:
        names = list(columns)
    broken = "broken_line"
    while broken in names:
        broken += "_"
    schema = T.StructType([T.StructField(name, T.StringType()) for name in [*names, broken]])
    df = (
        spark.read.options(**options)
        .schema(schema)
        .option("header", columns is None)
        .option("enforceSchema", columns is not None)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", broken)
        # Fields are counted in whole lines only.
        .option("columnPruning", False)
        .csv(location)
    )
    marked = F.col(f"`{broken}`")
    # Spark refuses to read broken lines without any field, so this condition, which always holds, reads one.
    df = df.where(F.length(F.concat_ws("", F.col(f"`{names[0]}`"))) >= 0)
    rejected = df.where(marked.isNotNull()).select(marked.alias("line"), F.col("_metadata.file_path").alias("file"))
    return df.where(marked.isNull()).drop(broken), rejected
