from __future__ import annotations

import random
import re

from trichter.llm.licenses import PHRASES, TEMPLATES, Scanner, scan_licenses, words_of
from trichter.llm.registered import QUERIES

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return WORD.findall(folded.encode())


def brute_base(text):
    words = plain_words(text)
    found = []
    for label, phrase in PHRASES:
        part = phrase.encode().split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(part)] == part]
    return len(words), sorted(found)


def scanner(**changes):
    return Scanner(PHRASES, TEMPLATES, **{"min_match": 4, "max_gap": 4, "min_cover": 0.6, **changes})


def test_matching_statistics_equal_brute_force():
    rng = random.Random(5)
    runs = [[rng.randrange(4) for _ in range(rng.randrange(1, 14))] for _ in range(9)]
    from trichter.llm.licenses import SuffixAutomaton

    automaton = SuffixAutomaton(runs)
    known = {tuple(r[i:j]) for r in runs for i in range(len(r)) for j in range(i + 1, len(r) + 1)}
    text = [rng.randrange(5) for _ in range(400)]
    for end, (_, size) in enumerate(automaton.statistics(text), 1):
        want = max((n for n in range(end + 1) if n == 0 or tuple(text[end - n : end]) in known), default=0)
        assert size == want


def test_chain_bridges_edits_and_reports_the_span():
    full = next(t for label, t in TEMPLATES if label == "mit")
    words = full.split()
    edited = " ".join(["intro"] * 7 + words[:20] + ["really", "all"] + words[20:40] + words[42:])
    n_words, spans = scanner().scan(edited)
    assert n_words == len(edited.split())
    (span,) = [s for s in spans if s[3] > 0.9]
    assert span[0] == 7 and span[0] + span[1] == n_words and span[2] == "mit" and span[3] < 1
    assert not [s for s in scanner().scan(" ".join(words[:12]))[1] if s[3] >= 0.6]


def test_words_fold_ascii_only():
    assert words_of("Straße ÄRGER_a1 X\x7fy\x00z") == ["straße".encode(), "Ärger".encode(), b"a1", b"x", b"y", b"z"]


def test_edge_rows(spark):
    rows = [
        (1, None, "s"),
        (1, "", "s"),
        (None, "under the MIT license under-the.mit,license", "s"),
        (3, "cc by nc " * 30_000, "s"),
        (4, "nothing of the kind", "s"),
        (4, "nothing of the kind", "s"),
    ]
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, labels string")).collect()
    assert [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word) for r in got] == [
        (1, 0, 0, None, None),
        (1, 0, 0, None, None),
        (None, 8, 2, 0, 4),
        (3, 90_000, 30_000, 0, 89_997),
        (4, 4, 0, None, None),
        (4, 4, 0, None, None),
    ]
    assert [r.base_labels for r in got] == ["", "", "mit", "cc-by-nc", "", ""]
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_matches_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op9_license_scan"](spark, folder).collect()
    assert len(rows) == len(texts)
    assert any(r.labels and not r.base_labels for r in rows)
    for r in rows:
        n_words, base = brute_base(texts[r.doc_id] or "")
        starts = [i for i, _ in base]
        assert (r.n_words, r.n_base) == (n_words, len(base))
        assert (r.first_word, r.last_word) == (min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({label for _, label in base}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
