from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np

from trichter.llm import ranked_search
from trichter.llm.ranked_search import Block, Bounds, Scores, search, sketch, terms_of
from trichter.llm.registered import QUERIES
from trichter.llm.statements import STATEMENTS

from .helpers import DATA, assert_same_as_sql, ordered

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return _TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    """Scores of all pairs."""
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c, c.total()) for d, c in counts if c]
    n, total = len(counts), sum(size for _, _, size in counts)
    df = Counter(term for _, c, _ in counts for term in c)
    found = []
    for item, text in items:
        scores = []
        for d, c, size in counts:
            m = 25 + (75 * size * n) // total
            score = 0
            for term in terms(text):
                if c[term]:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[term] + 1)))
                    score += w * ((1_000_000_000 * c[term]) // (1000 * c[term] + 8 * m))
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        found += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:k], 1)]
    return ordered(found)


def frames(spark, docs, items):
    left = spark.createDataFrame([(d, t, 1, None, 2, "z") for d, t in docs], "doc_id long, text string, n int, key string, score int, id string")
    right = spark.createDataFrame([(i, t, 3, 4) for i, t in items], "item_id long, text string, rank int, item int")
    return left.repartition(4), right


def test_query_matches_sql(spark, duck):
    assert_same_as_sql(QUERIES["op11_ranked_search"](spark, DATA), duck, STATEMENTS["op11_ranked_search"])


def test_terms_are_the_matches_of_the_pattern():
    rng = random.Random(5)
    signs = [chr(n) for n in range(128)] + list("éÄ中  \U0001f600")
    for _ in range(200):
        text = "".join(rng.choice(signs) for _ in range(60))
        assert [t.decode() for t in terms_of(text.encode())] == terms(text)


def test_random_documents_equal_brute_force(spark, monkeypatch):
    rng = random.Random(12)
    words = [f"w{n}" for n in range(400)]
    draw = lambda size: " ".join(words[min(399, int(rng.expovariate(0.02)))] for _ in range(size))
    docs = [(d, draw(rng.choice([3, 30, 80, 400]))) for d in range(300)]
    docs += [(1000 + n, docs[7][1]) for n in range(60)]  # ties over the threshold
    items = [(i, draw(rng.choice([1, 5, 40]))) for i in range(25)] + [(90, docs[7][1]), (91, docs[7][1] + " " + docs[9][1])]
    assert ordered(search(*frames(spark, docs, items)).collect()) == brute(docs, items)
    # Several blocks, and the way beyond the broadcast.
    monkeypatch.setattr(ranked_search, "_BLOCK_TERMS", 100)
    monkeypatch.setattr(ranked_search, "_BROADCAST_KEYS", 0)
    monkeypatch.setattr(ranked_search, "_SLICE_BYTES", 500)
    monkeypatch.setattr(ranked_search, "_CHUNK_CELLS", 300)
    assert ordered(search(*frames(spark, docs, items), k=3).collect()) == brute(docs, items, k=3)


def test_edge_rows(spark):
    docs = [
        (1, None),
        (2, ""),
        (3, " .,;\x00"),
        (4, "Alpha beta-BETA, gamma"),
        (4, "Alpha beta-BETA, gamma"),
        (4, "another text of id four: alpha"),
        (None, "no id, alpha"),
        (None, "no id, alpha"),
        (5, "alpha " * 40_000 + "delta"),
        (6, "ÄPFEL äpfel Äpfel 中文 naïve"),
        (7, "nothing in common"),
        *((n, f"filler number{n}") for n in range(100, 140)),
    ]
    items = [
        (1, "ALPHA beta"), (1, "gamma"), (2, None), (3, ""), (4, "unseen words"), (None, "delta alpha alpha"), (5, "äpfel 中文"), (5, "äpfel 中文"), (6, "filler"),
    ]
    assert ordered(search(*frames(spark, docs, items)).collect()) == brute(docs, items)
    left, right = frames(spark, docs, items)
    assert search(left.limit(0), right).collect() == []
    assert search(left, right.limit(0)).collect() == []
    assert search(left.filter("doc_id <= 3"), right).collect() == []


def test_bounds_are_never_below_the_scores():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("xyz0123") for _ in range(size)) for size in (1, 5, 40, 300, 900)]
    block = Block([(n, Counter(terms_of(t.encode()))) for n, t in enumerate(texts)])
    block.weigh({n: rng.randrange(1, 5) for n in range(len(block.terms))}, 5)
    total = sum(len(t.split()) for t in texts)
    scores, bounds = Scores(block, 5, total), Bounds(block, 5, total)
    for text in [*texts, "ax " * 700, "bz " * 254]:
        words = terms_of(text.encode())
        span = np.array([25 + 75 * len(words) * 5 // total])
        bound = bounds._bounds(sketch(Counter(words))[None, :], span)[0]
        assert (bound >= scores.of(text.encode())).all()
