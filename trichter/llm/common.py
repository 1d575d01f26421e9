"""Shared folder, written intermediate tables and id-safe joins for the operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, as in local tests, a temporary folder takes its place. On a cluster such a
    folder would be another one on each machine, so there the setting is needed.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="trichter-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder, read back with a cut lineage.

    Unlike a checkpoint the copy is compressed, and later scans read single columns of it.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the files of a table made by ``written`` that no later step reads."""
    spark = df.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        remove_path(spark, folder)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that are no longer referenced.

    It does so when the driver collects its garbage, which a driver with little to do rarely does,
    and a moment later: the next step would write its own files before these are gone.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(1)


def row_key(id_column: str, text: str) -> Column:
    """Tells rows apart that share an id but not the text; nulls count as values."""
    return F.xxhash64(F.col(id_column).cast("string"), F.col(text))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def hash_sample(df: DataFrame, by: Column, rows: int, total: int) -> DataFrame:
    """At most ``rows`` rows in the order of the hash of ``by``, of a table of about ``total`` rows.

    Hashes above a bound are passed over in the scan, so that few more rows than asked for are
    ordered, however many tasks read the table.
    """
    bound = int(min(1.0, 2.0 * rows / max(1, total) + 64.0 / max(1, total)) * 2**31)
    return df.filter(F.pmod(F.xxhash64(F.lit(3), by), F.lit(2**31)) < bound).orderBy(F.xxhash64(F.lit(3), by)).limit(rows)


def salt_of(column: str, salts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(5), F.col(column)), F.lit(salts)).cast("int")


def with_group_min(df: DataFrame, key: str, value: str, out: str, spread_by: str, salts: int = 16) -> DataFrame:
    """Add the smallest ``value`` of each ``key`` to its rows, also where one key holds most rows.

    Minima are taken per (key, salt) first, and the rows meet their minimum under (key, salt)
    again, so a hot key is dealt to ``salts`` tasks at both ends.
    """
    salted = df.withColumn("_salt", salt_of(spread_by, salts))
    parts = salted.groupBy(key, "_salt").agg(F.min(value).alias("_least"))
    # A window over at most ``salts`` rows per key.
    whole = parts.select(key, "_salt", F.min("_least").over(Window.partitionBy(key)).alias(out))
    return salted.join(whole, [key, "_salt"]).drop("_salt")


def with_lookup(df: DataFrame, key: str, table: DataFrame, value: str, spread_by: str, salts: int = 16) -> DataFrame:
    """Add ``value`` of ``table`` (one row per ``key``) to the rows, null where it has none.

    Only (key, salt) pairs that occur meet the table, so a hot key is dealt to ``salts`` tasks.
    """
    salted = df.withColumn("_salt", salt_of(spread_by, salts))
    parts = salted.select(key, "_salt").distinct().join(table.select(key, value), key)
    return salted.join(parts, [key, "_salt"], "left").drop("_salt")


_FREQUENT = 1000


def joined_by_frequency(df: DataFrame, keys: list[str], table: DataFrame) -> DataFrame:
    """Left join of a written ``df`` with ``table`` (one row per key, none of the key columns null).

    Keys with more than one in ``_FREQUENT`` rows are at most that many, whatever the data, so their
    rows of the table are broadcast. Every other key is small enough for a task of a plain join.
    """
    total = df.count()
    frequent = df.groupBy(*keys).count().filter(F.col("count") * _FREQUENT > total).drop("count")
    frequent = written(frequent, "frequent")
    hot = written(table.join(F.broadcast(frequent), keys, "left_semi"), "frequent-values")
    met = df.join(F.broadcast(frequent), keys, "left_semi").join(F.broadcast(hot), keys, "left")
    rest = df.join(F.broadcast(frequent), keys, "left_anti").join(table, keys, "left")
    return met.unionByName(rest)
