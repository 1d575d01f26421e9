from __future__ import annotations

from pathlib import Path

import duckdb
import pytest


@pytest.fixture(scope="package", autouse=True)
def few_partitions(spark):
    """The frames here are tiny and the operators have many stages."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for file in Path("/root/testdata/sf0.01").glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    yield con
    con.close()
