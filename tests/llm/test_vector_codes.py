from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from trichter.llm.registered import QUERIES
from trichter.llm.statements import STATEMENTS
from trichter.llm.vector_codes import Codebooks, assign, compress_vectors, squared

from .helpers import DATA, assert_same_as_sql, ordered


def brute(rows, parts=4, entries=256, rounds=4):
    """Plain rounds over rows of (id, vector, label), in whole numbers."""
    kept = [
        (i, [math.floor(1024 * x) for x in v], label)
        for i, v, label in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for c in cut:
                held.setdefault(nearest(c[p], books[p])[1], []).append(c[p])
            for e, members in held.items():
                books[p][e] = [sum(column) // len(members) for column in zip(*members)]
    digest = hashlib.sha256(",".join(str(y) for book in books for c in book for y in c).encode()).hexdigest()
    coded = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in found) for found in coded]
    by_label = {}
    for (_, _, label), error in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + error
    return [
        (i, "".join(f"{e:02x}" for _, e in found), error, by_label[label], digest)
        for (i, _, label), found, error in zip(kept, coded, errors)
    ]


def test_query_matches_sql(spark, duck):
    assert_same_as_sql(QUERIES["op13_vector_codes"](spark, DATA), duck, STATEMENTS["op13_vector_codes"])


def test_edge_rows(spark):
    rng = random.Random(4)
    near = [[round(rng.gauss(0, 1), 2) for _ in range(8)] for _ in range(30)]
    rows = [(i, [x + rng.choice([0, 0, 0.01, -0.2]) for x in rng.choice(near)], rng.choice([1, 2, None])) for i in range(400)]
    rows += [(500 + n, near[0], 1) for n in range(120)]
    rows += [(7, near[3], 2), (7, near[3], 2), (None, near[5], None), (None, near[6], 3), (-5, near[7], 1)]
    rows += [(901, None, 1), (902, near[1][:7] + [None], 1), (903, near[1][:7] + [math.inf], 1), (904, near[1][:7] + [math.nan], 1)]
    schema = "vec_id long, embedding array<double>, label int, code string, error int, id string, v int, key string"
    frame = spark.createDataFrame([(*r, None, 1, "x", 2, "y") for r in rows], schema).repartition(5)
    for entries in (1, 7, 256):
        got = compress_vectors(frame, entries=entries).drop("label").collect()
        assert ordered(got) == ordered(brute(rows, entries=entries)), entries


def test_few_none_and_unfit_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"

    def codes(rows, **options):
        return ordered(compress_vectors(spark.createDataFrame(rows, schema), **options).drop("label").collect())

    few = [(3, [1.0, 2.0, -3.5, 0.0], None), (9, [-1.0, 2.0, 3.5, 1e-9], None)]
    assert codes(few) == ordered(brute(few))
    assert codes([]) == codes([(1, None, 1), (2, [math.nan] * 4, None)]) == []
    large = [(1, [30_000.0, 1.0, 1.0, -1.0], 1), (2, [-30_000.5, 0.5, 1.0, 1.0], 1), (3, [-29_999.0, 2.0, 1.0, 1.0], 2)]
    assert codes(large, entries=2) == ordered(brute(large, entries=2))
    for bad in ([(1, [1.0] * 6, 1)], [(1, [1.0] * 8, 1), (2, [1.0] * 4, 1)], [(1, [1e30] * 4, 1)], [(1, [], 1)]):
        with pytest.raises(ValueError):
            codes(bad)


def test_bounds_leave_groups_out_and_change_nothing():
    """Assignments under bounds equal full comparisons in every round, with fewer distances measured."""
    rng = np.random.default_rng(8)
    centres = rng.integers(-4000, 4000, (40, 6))
    x = (centres[rng.integers(0, 40, 3000)] + rng.integers(-60, 60, (3000, 6))).astype(np.float64)
    books = Codebooks(x[None, :64].astype(np.int64), True)
    own, bound, stamp = np.zeros(3000, np.int64), np.zeros((3000, 16), np.float32), np.zeros((3000, 16), np.uint8)
    measured = []
    for _ in range(6):
        book = books.history[-1][0].astype(np.float64)
        best = assign(x, own, bound, stamp, book, books.group[0], books.drops()[0])
        full = squared(x, book)
        assert (own == full.argmin(1)).all() and (best == full.min(1)).all()
        measured.append((stamp == len(books.history) - 1).mean())
        rest = np.where(np.arange(64) == own[:, None], np.inf, full)
        for g in range(16):
            fallen = bound[:, g] - books.drops()[0][stamp[:, g], g]
            assert (np.maximum(fallen, 0) ** 2 <= rest[:, books.group[0] == g].min(1, initial=np.inf)).all()
        latest = books.history[-1].copy()
        for e in set(own):
            latest[0, e] = np.floor(x[own == e].mean(0))
        books.history.append(latest)
    assert measured[0] == 1 and measured[-1] < 0.3


def test_net_displacement_is_no_more_than_the_accumulated_one():
    start = np.zeros((1, 2, 2), np.int64)
    books = Codebooks(start, True)
    for move in ((30, 40), (0, 0)):
        books.history.append(np.array([[move, (0, 0)]], np.int64))
    assert books.drops()[0, 0].max() == 0  # there and back again
    assert abs(books.drops()[0, 1].max() - 50) < 1e-6
