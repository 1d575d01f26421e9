from __future__ import annotations

import itertools
import math
import random

import numpy as np

from trichter.llm.neighbours import nearest_neighbours, walk
from trichter.llm.registered import QUERIES

from .helpers import DATA


def brute(vectors, k=10, every=100):
    """Exact (query, rank, id, distance) over {id: vector}."""
    ids = sorted(vectors)
    points = np.array([vectors[i] for i in ids], float)
    found = {}
    for q in (i for i in ids if i % every == 0):
        gap = np.sqrt(((points - np.array(vectors[q], float)) ** 2).sum(1))
        near = sorted((d, i) for d, i in zip(gap, ids) if i != q)[:k]
        found[q] = [(i, d) for d, i in near]
    return found


def by_query(rows):
    found = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(found.setdefault(r.query_id, [])) + 1
        found[r.query_id].append((r.vec_id, r.score))
    return found


def test_walk_is_in_order_and_complete():
    rng = np.random.default_rng(3)
    a, b = rng.random(7), rng.random(9)
    b[4] = b[5]
    pairs = list(walk(a, b))
    sums = [a[i] + b[j] for i, j in pairs]
    assert sums == sorted(sums)
    assert sorted(pairs) == list(itertools.product(range(7), range(9)))


def test_query_reaches_recall(spark):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    got, want = by_query(QUERIES["op8_inverted_multi_index"](spark, DATA).collect()), brute(vectors)
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    exact = {q: dict(brute_all) for q, brute_all in brute(vectors, k=len(vectors)).items()}
    for q, found in got.items():
        assert len(found) == len(want[q])
        assert all(math.isclose(score, exact[q][i], rel_tol=1e-12, abs_tol=1e-12) for i, score in found)
        assert found == sorted(found, key=lambda x: (x[1], x[0]))


def test_hot_vectors_ties_and_bad_rows(spark):
    rng = random.Random(1)
    hot = [1.0, 2.0, 3.0, 4.0]
    rows = [(i, hot if i % 3 == 0 else [rng.choice([-1.0, 0.0, 2.0]) for _ in range(3)] + [1.0]) for i in range(600)]
    good = dict(rows)
    bad = [
        (None, hot),
        (700, None),
        (800, [0.0] * 4),
        (900, [1.0, float("nan"), 0.0, 0.0]),
        (1000, [1.0, float("inf"), 0.0, 0.0]),
        (1100, [1.0, None, 0.0, 0.0]),
        (1200, [1.0]),
        (1300, []),
        (3, hot),
    ]
    frame = spark.createDataFrame([(i, v, 0.0) for i, v in rows + bad], "vec_id long, embedding array<float>, score double")
    got = by_query(nearest_neighbours(frame, recall=1.0).collect())
    want = brute(good)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]


def test_fewer_candidates_than_k_and_empty(spark):
    schema = "vec_id long, embedding array<double>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (5, [0.0, 1.0]), (6, [1.0, 1.0])], schema)
    assert {r.vec_id for r in nearest_neighbours(few).collect()} == {5, 6}
    assert nearest_neighbours(spark.createDataFrame([], schema)).count() == 0
    assert nearest_neighbours(few.filter("vec_id = 0")).count() == 0
