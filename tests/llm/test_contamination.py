from __future__ import annotations

import random

from trichter.llm.contamination import _functions, find_contamination
from trichter.llm.registered import QUERIES, STATEMENTS

from .helpers import DATA, assert_same_as_sql
from .test_near_duplicates import shingles


def windows(text, length):
    """Windows of the length of a short item, as ``shingles`` spells them."""
    words = text.lower().encode().split()
    return {tuple(words[i : i + length]) for i in range(len(words) - length + 1)} if length < 5 else set()


def test_partial_items_in_long_documents(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(500)]
    items = {i: rng.choices(vocabulary, k=rng.randrange(1, 60)) for i in range(60)}
    docs = {}
    for d in range(80):
        words = rng.choices(vocabulary, k=rng.choice([0, 3, 20, 4000]))
        for i in rng.sample(sorted(items), 3):
            part = items[i][: max(1, round(len(items[i]) * rng.choice([0.5, 0.7, 0.8, 0.9, 1.0])))]
            at = rng.randrange(len(words) + 1)
            words[at:at] = part
        docs[d] = " ".join(words).title()
    docs[99] = " ".join(items[5])
    got = find_contamination(
        spark.createDataFrame(list(docs.items()), "doc_id long, text string"),
        spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string"),
    ).collect()
    want = {}
    for d, text in docs.items():
        for i, w in items.items():
            item = shingles(" ".join(w))
            shared = len(item & (shingles(text) | windows(text, len(w))))
            if shared >= 0.75 * len(item):
                want[d, i] = (shared, len(item))
    assert {(r.doc_id, r.item_id): (r.shared, r.item_shingles) for r in got} == want
    assert len(want) > 60


def test_edge_rows(spark):
    text = "one two three four five six"
    docs = [(1, None, 0), (2, "", 0), (None, text, 0), (3, text, 0), (3, text, 0), (3, text + " seven", 0), (4, "one two", 0)]
    items = [(10, None), (11, ""), (12, text), (12, text), (None, "ONE\ttwo")]
    got = find_contamination(
        spark.createDataFrame(docs, "doc_id long, text string, item_id int"),
        spark.createDataFrame(items, "item_id long, text string"),
    ).collect()
    found = sorted(((r.doc_id, r.item_id, r.shared, r.item_shingles) for r in got), key=str)
    # The short item stands in every text that begins with its words.
    assert found == [(3, 12, 2, 2), (3, None, 1, 1), (4, None, 1, 1), (None, 12, 2, 2), (None, None, 1, 1)]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert find_contamination(none, spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_short_items_in_longer_documents(spark, duck):
    docs = [
        (1, "The CAPITAL of\tFrance is large"),
        (2, "capital of france"),
        (3, "of france capital and a capital of spain"),
        (4, "france"),
        (5, ""),
        (6, None),
        (7, "one two three four five six"),
    ]
    items = [(10, "capital of France"), (11, "France"), (12, "two three four five"), (13, "one two three four five six"), (14, "")]
    found = find_contamination(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    want = {(1, 10), (2, 10), (1, 11), (2, 11), (3, 11), (4, 11), (7, 12), (7, 13)}
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want
    small = duck.cursor()
    small.execute("CREATE TEMP TABLE documents (doc_id BIGINT, text VARCHAR)")
    small.execute("CREATE TEMP TABLE benchmark (item_id BIGINT, text VARCHAR)")
    small.executemany("INSERT INTO temp.documents VALUES (?, ?)", docs)
    small.executemany("INSERT INTO temp.benchmark VALUES (?, ?)", items)
    sql = STATEMENTS["op7_benchmark_decontamination"]
    sql = sql.replace("FROM documents", "FROM temp.documents").replace("FROM benchmark", "FROM temp.benchmark")
    assert_same_as_sql(found, small, sql)


def test_functions_per_size():
    assert [_functions(p, 0.75, 1e-9) for p in (0, 1, 2, 6, 20)] == [1, 1, 15, 15, 15]


def test_query_matches_sql(spark, duck):
    found = QUERIES["op7_benchmark_decontamination"](spark, DATA)
    assert_same_as_sql(found, duck, STATEMENTS["op7_benchmark_decontamination"])
