from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from trichter.llm.quality import classify_quality, votes

FOLDER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def held_out(spark):
    """Accepted documents by (language, toxic): words are learned from one half of the labels, the rest is counted."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    half = F.pmod(F.xxhash64(F.lit(41), "doc_id"), F.lit(2)) == 0
    rows = classify_quality(docs, labels.filter(half)).select("doc_id", "accepted")
    seen = rows.join(docs.select("doc_id", "lang"), "doc_id").join(labels.filter(~half), "doc_id").filter("quality = 1")
    found = {}
    for r in seen.collect():
        found.setdefault((r.lang, r.toxic), []).append(r.accepted)
    return found


@pytest.mark.parametrize("lang", ["en", "de", "fr", "es"])
def test_toxic_documents_of_every_language_are_rejected(held_out, lang):
    assert np.mean(held_out[lang, 1]) <= 0.3  # few Spanish toxic documents to learn from
    assert np.mean(held_out[lang, 0]) >= 0.98


def test_learned_words_need_several_hits_in_a_long_text():
    toxic = frozenset({"gemein"})
    clean = "ein schlichter Satz aus vielen Worten und noch einer. " * 200
    assert votes(clean + "gemein", toxic) == votes(clean)
    assert votes("das ist gemein und so gemein", toxic)[-2:] == "11"


def test_no_labels_and_unknown_languages(spark):
    rude = [(i, f"wort {i} und {i * 7} schlimm {i * 3} dann {i * 11} fies", "xx", 1) for i in range(20)]
    kind = [(i, f"wort {i} und {i * 7} freundlich {i * 3} dann {i * 11} nett", "xx", 0) for i in range(20, 220)]
    other = [(900, "wort schlimm und fies", None, None), (901, "wort freundlich und nett", None, None)]
    docs = spark.createDataFrame(rude + kind + other, "doc_id long, text string, lang string, toxic int")
    labels = docs.filter("toxic IS NOT NULL").select("doc_id", "toxic")
    got = {r.doc_id: r.votes[6] for r in classify_quality(docs, labels).collect()}
    assert {got[i] for i in range(20)} == {"0"} and {got[i] for i in range(20, 220)} == {"1"}
    assert got[900] == "0" and got[901] == "1"
    none = classify_quality(docs, labels.limit(0)).collect()
    assert len(none) == len(got) and {r.votes[6] for r in none} == {"1"}


def test_one_insult_in_a_long_clean_text(spark):
    prose = "A plain sentence of several words, and then another one. "
    long = prose * 2000 + "Take out the trash."
    assert votes(long) == votes(prose * 2000)
    assert votes("you are an idiot and a moron")[5] == "0" and votes(prose * 20 + "you idiot, you moron")[5] == "0"
    rows = [(i, f"{prose}{i}") for i in range(30)] + [(i, f"{prose}you idiot, you moron {i}") for i in range(50, 55)] + [(100, long)]
    got = {r.doc_id: r.accepted for r in classify_quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] and not any(got[i] for i in range(50, 55)) and all(got[i] for i in range(30))
