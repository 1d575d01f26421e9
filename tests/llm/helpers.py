"""Comparisons with SQL and small frames."""

from __future__ import annotations

DATA = "/root/testdata/sf0.01"


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


def assert_same_as_sql(frame, duck, statement):
    columns = sorted(frame.columns)
    ran = duck.execute(statement)
    names = [d[0] for d in ran.description]
    assert sorted(names) == columns
    want = [tuple(row[names.index(c)] for c in columns) for row in ran.fetchall()]
    assert ordered(frame.select(*columns).collect()) == ordered(want)
