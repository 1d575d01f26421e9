from __future__ import annotations

import random

from trichter.llm.components import star_components
from trichter.llm.near_duplicates import near_duplicates
from trichter.llm.registered import QUERIES, STATEMENTS

from .helpers import DATA, assert_same_as_sql


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def least_reachable(nodes, links):
    found = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(found[a], found[b])
            if found[a] != low or found[b] != low:
                found[a] = found[b] = low
                changed = True
    return found


def brute(texts):
    sets = {d: shingles(t) for d, t in texts.items()}
    ids = sorted(sets)
    links = [
        (a, b)
        for n, a in enumerate(ids)
        for b in ids[n + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    return sets, least_reachable(ids, links)


def edited(rng, words, share):
    return [w if rng.random() > share else f"x{rng.randrange(10**6)}" for w in words]


def test_groups_chains_and_shared_passages_equal_brute_force(spark):
    """Near copies of a base that are not all linked with one another, and a passage in many documents."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = {}
    for group in range(6):
        base = rng.choices(vocabulary, k=rng.choice([30, 80, 200]))
        for copy in range(30):
            texts[len(texts)] = " ".join(edited(rng, base, rng.choice([0.0, 0.01, 0.02, 0.03, 0.04])))
    passage = rng.choices(vocabulary, k=60)
    for _ in range(120):
        texts[len(texts)] = " ".join(rng.choices(vocabulary, k=rng.randrange(3, 40)) + passage)
    chain = rng.choices(vocabulary, k=100)
    for step in range(25):
        texts[len(texts)] = " ".join(chain[step * 3 :] + [f"c{i}" for i in range(step * 3)])
    order = list(texts)
    rng.shuffle(order)
    texts = {i: texts[k] for i, k in enumerate(order)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    sets, component = brute(texts)
    got = {r.doc_id: r for r in near_duplicates(frame).collect()}
    assert {d: (r.n_shingles, r.component_id, r.kept) for d, r in got.items()} == {
        d: (len(sets[d]), component[d], component[d] == d) for d in texts
    }


def test_edge_rows(spark):
    long_text = " ".join(f"v{i}" for i in range(60_000))
    rows = [
        (9, None, True),
        (8, "", True),
        (7, " \n\t ", True),
        (None, "one two three four five six", True),
        (6, "one two three four five six", True),
        (5, "ONE  two\nthree four five six", True),
        (4, "short text", True),
        (3, "Short Text", True),
        (3, "Short Text", True),
        (2, "text short", True),
        (11, long_text, True),
        (10, long_text + " tail", True),
        (12, "one two ÄÖ", True),
        (13, "one two äö", True),
    ]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, kept boolean")).collect()
    found = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=str)
    assert found == sorted(
        [
            (9, 0, 9, True),
            (8, 0, 8, True),
            (7, 0, 7, True),
            (None, 2, None, True),
            (6, 2, 5, False),
            (5, 2, 5, True),
            (4, 1, 3, False),
            (3, 1, 3, True),
            (3, 1, 3, True),
            (2, 1, 2, True),
            (11, 59_996, 10, False),
            (10, 59_997, 10, True),
            (12, 1, 12, True),
            (13, 1, 13, True),
        ],
        key=str,
    )
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(1000, 1200)] + [(5, 5)]
    edges += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    nodes = {n for a, b in edges for n in (a, b) if a != b}
    got = {r.node: r.component for r in star_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: c for n, c in least_reachable({n for e in edges for n in e}, edges).items() if n in nodes}


def test_query_matches_sql(spark, duck):
    assert_same_as_sql(QUERIES["op4_minhash_near_dedup"](spark, DATA), duck, STATEMENTS["op4_minhash_near_dedup"])
