"""Every registered query equals its SQL counterpart: names, types and all values."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from oracles import STATEMENTS
from trichter.plans.registered import QUERIES

DATA = Path("/root/testdata/sf0.01")
TYPES = {"BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date", "BOOLEAN": "boolean"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    yield con
    con.close()


def _key(row: tuple) -> list:
    return [(value is None, str(value)) for value in row]


def test_every_query_has_a_statement():
    assert sorted(QUERIES) == sorted(STATEMENTS)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches(spark, duck, name):
    got = QUERIES[name](spark, str(DATA))
    columns = sorted(got.columns)
    ran = duck.execute(STATEMENTS[name])
    described = {d[0]: str(d[1]) for d in ran.description}
    assert sorted(described) == columns
    names = [d[0] for d in ran.description]
    want = [tuple(row[names.index(c)] for c in columns) for row in ran.fetchall()]
    rows = [tuple(row) for row in got.select(*columns).collect()]
    assert {c: got.schema[c].dataType.simpleString() for c in columns} == {
        c: TYPES.get(described[c], described[c]) for c in columns
    }
    assert len(rows) == len(want)
    for mine, theirs in zip(sorted(rows, key=_key), sorted(want, key=_key)):
        assert mine == theirs
