from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from trichter.operators.tiles import with_ntiles


def expected(df, k, score, by=()):
    return df.select("id", F.ntile(k).over(Window.partitionBy(*by).orderBy(score, "id")).alias("tile"))


@pytest.mark.parametrize("k", [1, 4, 7, 50])
@pytest.mark.parametrize("n", [3, 19, 1003])
def test_equals_builtin_with_heavy_ties(spark, n, k):
    df = spark.range(n).select(F.col("id").cast("string").alias("id"), (F.col("id") % 5).alias("score"))
    got = with_ntiles(df.repartition(5), k, {"tile": "score"}, "id").select("id", "tile")
    assert sorted(got.collect()) == sorted(expected(df, k, "score").collect())


def test_one_score_holds_almost_all_rows_of_one_group(spark):
    df = spark.range(5000).select(
        F.col("id").cast("string").alias("id"),
        F.when(F.col("id") % 10 < 9, 0.0).otherwise(F.rand(7)).alias("score"),
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 40)).alias("grp"),
    ).cache()
    got = with_ntiles(df, 4, {"tile": "score"}, "id", by=["grp"]).select("id", "tile")
    assert sorted(got.collect()) == sorted(expected(df, 4, "score", ["grp"]).collect())


def test_ties_follow_the_text_of_the_id(spark):
    df = spark.createDataFrame([("9", 1.0), ("10", 1.0)], "id string, score double")
    got = {r.id: r.tile for r in with_ntiles(df, 2, {"tile": "score"}, "id").collect()}
    assert got == {"10": 1, "9": 2}


def test_sizes_and_payload(spark):
    df = spark.range(19).select(F.col("id").cast("string").alias("id"), F.col("id").alias("score"), F.lit("x").alias("note"))
    rows = with_ntiles(df, 4, {"a": "score", "b": "score"}, "id").collect()
    assert [sum(r.a == t for r in rows) for t in (1, 2, 3, 4)] == [5, 5, 5, 4]
    assert all(r.a == r.b and r.note == "x" for r in rows)


def test_rows_that_take_no_part_are_kept(spark):
    df = spark.range(10).select(F.col("id").cast("string").alias("id"), F.col("id").alias("score"))
    rows = with_ntiles(df, 4, {"tile": "score"}, "id", takes_part=F.col("score") > 5).collect()
    assert {r.id: r.tile for r in rows if r.tile} == {"6": 1, "7": 2, "8": 3, "9": 4}
    assert len(rows) == 10


@pytest.mark.parametrize("kind", ["bigint", "decimal(38,4)", "string"])
def test_scores_keep_their_type(spark, kind):
    """Neighbours above 2**53 are one number as doubles; text has its own order."""
    rows = [(str(i), str(2**53 + (i * 7) % 50)) for i in range(50)]
    df = spark.createDataFrame(rows, "id string, score string").withColumn("score", F.col("score").cast(kind))
    got = with_ntiles(df, 10, {"tile": "score"}, "id").select("id", "tile")
    assert sorted(got.collect()) == sorted(expected(df, 10, "score").collect())
