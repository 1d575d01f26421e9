from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from trichter.llm import banding, lines
from trichter.llm.components import union_find
from trichter.llm.lines import dedup_lines
from trichter.llm.registered import QUERIES

from .helpers import ordered
from .test_near_duplicates import least_reachable


def shingles(line):
    return {line[i : i + 8] for i in range(max(1, len(line) - 7))}


def brute(rows, similarity=75):
    """{(id, text): (lines, dropped)} for rows of (id, text)."""
    spots = sorted(
        {(d is None, d or 0, n, t) for d, t in rows if t for n, line in enumerate(t.split("\n")) if line.strip(" \t\r")}
    )
    lines = sorted({t.split("\n")[n].strip(" \t\r") for _, _, n, t in spots})
    sets = [shingles(line) for line in lines]
    links = [
        (a, b)
        for a in range(len(lines))
        for b in range(a)
        if 100 * len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])
    ]
    group = least_reachable(range(len(lines)), links)
    number = {line: n for n, line in enumerate(lines)}
    seen, found = set(), {}
    for last, d, n, t in spots:
        mark = group[number[t.split("\n")[n].strip(" \t\r")]]
        count, dropped = found.setdefault((None if last else d, t), (0, []))
        found[(None if last else d, t)] = (count + 1, dropped + [n] if mark in seen else dropped)
        seen.add(mark)
    return found


def check(rows, got):
    want = brute([(d, t) for d, t in rows])
    expected = []
    for d, t in rows:
        count, dropped = want.get((d, t), (0, []))
        text = t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in dropped)
        expected.append((d, count, count - len(dropped), dropped, text))
    assert ordered((r.doc_id, r.lines, r.kept_lines, r.dropped, r.text) for r in got) == ordered(expected)


def test_random_documents_equal_brute_force(spark):
    rng = random.Random(8)
    pool = ["".join(rng.choice("abcdefgh ") for _ in range(rng.choice([3, 9, 40, 120, 300]))) for _ in range(80)]
    rows = []
    for d in range(150):
        lines = []
        for _ in range(rng.randrange(0, 6)):
            line = rng.choice(pool)
            for _ in range(rng.randrange(0, 4)):
                at = rng.randrange(len(line))
                line = line[:at] + rng.choice("xyz") + line[at + 1 :]
            lines.append(rng.choice(["", " ", "\t"]) + line)
        rows.append((d, "\n".join(lines)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    check(rows, dedup_lines(frame).collect())


def test_edge_rows(spark):
    long_text = "\n".join(["the very same line of some length"] * 20_000)
    rows = [
        (1, None),
        (2, ""),
        (3, " \n\n\t"),
        (4, "a\nb\na"),
        (4, "a\nb\na"),
        (4, "b\nanother text of id four"),
        (None, "a\nonly here, without an id"),
        (5, long_text),
        (6, "the very same line of some length\r\nGröße und Maße der Straße"),
        (7, "Größe und Maße der Strasse!"),
    ]
    frame = spark.createDataFrame([(d, t, -1, 0) for d, t in rows], "doc_id long, text string, lines int, _n int").drop("_n")
    check(rows, dedup_lines(frame).collect())
    kept = dedup_lines(frame.drop("lines"), drop_emptied=True).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 2, 3, 4, 4, 4, 5, 6, 7]
    gone = spark.createDataFrame([(1, "same line here"), (2, "same line here")], "doc_id long, text string")
    assert [r.doc_id for r in dedup_lines(gone, drop_emptied=True).collect()] == [1]
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_union_find(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(40)] + [(99, i) for i in range(200, 400)] + [(77, 77)]
    edges += [(rng.randrange(500, 560), rng.randrange(500, 560)) for _ in range(50)]
    got = {r.node: r.component for r in union_find(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: c for n, c in least_reachable({n for e in edges for n in e}, edges).items() if n in linked}


def test_query_matches_brute_force_on_exact_lines(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    check(rows, QUERIES["op2_line_dedup"](spark, folder).collect())


def _near_lines(count):
    rng = random.Random(3)
    base = "".join(rng.choice("abcdefghijklmnop ") for _ in range(90))
    rows = []
    for d in range(count):
        line = list(base)
        for _ in range(rng.randrange(0, 6)):
            line[rng.randrange(90)] = rng.choice("QRSTUVWXYZ")
        rows.append((d, "".join(line)))
    return rows


def test_blocks_of_a_large_bucket_meet(spark, monkeypatch):
    """Many lines of one bucket in several components, in blocks of two."""
    monkeypatch.setattr(banding, "_BLOCK", 2)
    rows = _near_lines(120)
    check(rows, dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())


def test_columns_of_any_name_stay(spark):
    names = ["_match", "_text", "_key", "_id", "key", "key2", "row", "id", "n", "place", "line", "gone", "node"]
    rows = [(1, "one line of text\nanother line"), (2, "one line of text!")]
    frame = spark.createDataFrame([(*r, *names) for r in rows], ["doc_id", "text", *names])
    got = dedup_lines(frame).collect()
    check(rows, got)
    assert all(r[name] == name for r in got for name in names)


def test_lines_that_share_a_node_are_told_apart(spark, monkeypatch):
    """With a few bits of hash, no line is dropped that is not like another one."""
    monkeypatch.setattr(lines, "_line_digest", lambda line: (F.pmod(F.xxhash64(line), F.lit(3)), F.xxhash64(F.lit(1), line)))
    rows = [(d, f"{'abcdefgh'[d] * 30} {d}") for d in range(8)] + [(8, f"{'c' * 30} 2"), (9, f"{'e' * 30} 4")]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got if r.dropped) == [8, 9]


def test_compared_lines_travel_as_text(spark, monkeypatch):
    """What the search carries of a line is no larger than the line (op2_line_dedup: disk and shuffle of round 3)."""
    carried = []

    def recording(df, name):
        table = written(df, name)
        if name == "sets":
            carried.append(table.agg(F.sum(F.octet_length("hashes"))).first()[0])
        return table

    written = banding.written
    monkeypatch.setattr(banding, "written", recording)
    rows = _near_lines(30)
    check(rows, dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect())
    assert 0 < carried[0] <= sum(len(text.encode()) for _, text in rows)


def test_packed_entries_meet_as_in_one_place():
    """Members of shared buckets, whatever the tasks and slices they come from; two entries of a bucket per task at most meet."""
    rng = np.random.default_rng(0)
    buckets = rng.integers(-(1 << 62), 1 << 62, 900)[rng.integers(0, 900, 4000)]
    buckets[:500], nodes = 77, rng.integers(0, 400, 4000)
    held = {}
    for bucket, node in zip(buckets.tolist(), nodes.tolist()):
        held.setdefault(bucket, set()).add(node)
    expected = {(b, n) for b, some in held.items() if len(some) > 1 for n in some}
    dealt = [row for part in np.array_split(np.arange(4000), 7) for row in banding._dealt(buckets[part], nodes[part], 5)]
    found = {}
    for number in range(5):
        batches = [row.filter(pa.array(row.column("slice").to_numpy() == number)) for row in dealt]
        for out in banding._met_buckets(b for b in batches if b.num_rows):
            for bucket, node, hub in zip(*(out.column(c).to_pylist() for c in ("bucket", "node", "hub"))):
                found.setdefault((bucket, node), set()).add(hub)
    assert set(found) == expected
    assert all(hub in held[bucket] and hub <= node for (bucket, node), hubs in found.items() for hub in hubs)


def test_sets_read_and_compared_at_once_equal_single_ones(monkeypatch):
    monkeypatch.setattr(banding, "_CELLS", 200)
    texts = [text for _, text in _near_lines(40)] + ["a", "abcdefgh", "Größe", "aaaaaaaaaaaaaaaaaa"]
    sets = lines._line_sets([pa.py_buffer(text.encode()) for text in texts])
    assert [len(x) for x in sets] == [len(shingles(text)) for text in texts]
    held = dict(enumerate(sets))
    pairs = [(a, b) for a in held for b in range(a)]
    alike = banding._alike_pairs(pairs, held, 75)
    brute_force = [
        100 * len(x & y) >= 75 * len(x | y) for x, y in ((shingles(texts[a]), shingles(texts[b])) for a, b in pairs)
    ]
    assert [alike(at) for at in range(len(pairs))] == brute_force
    assert [banding._alike(held[a], held[b], 75) for a, b in pairs] == brute_force
