from __future__ import annotations

import random

import numpy as np

from trichter.llm.quality import LABELLERS, classify_quality, fit_weak_labels, votes
from trichter.llm.registered import QUERIES

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    """Labels are used for this comparison only. Toxic words occur in English texts."""
    rows = {r.doc_id: r.accepted for r in QUERIES["op6_weak_label_quality"](spark, FOLDER).collect()}
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert rows.keys() == lang.keys()
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").collect()
    clean = [rows[r.doc_id] for r in labels if r.quality == 1 and r.toxic == 0]
    junk = [rows[r.doc_id] for r in labels if r.quality == 0]
    toxic = [rows[r.doc_id] for r in labels if r.quality == 1 and r.toxic == 1 and lang[r.doc_id] == "en"]
    assert np.mean(clean) >= 0.99
    assert np.mean(junk) <= 0.05
    assert np.mean(toxic) <= 0.05


def test_em_finds_the_accuracies_of_simulated_labellers():
    rng = random.Random(9)
    accuracy = [0.95, 0.8, 0.7, 0.9]
    counts, truth = {}, {}
    for _ in range(20_000):
        good = rng.random() < 0.8
        pattern = "".join(
            "1" if rng.random() < 0.3 else str(2 * ((rng.random() < a) == good)) for a in accuracy
        )
        counts[pattern] = counts.get(pattern, 0) + 1
        truth.setdefault(pattern, []).append(good)
    model = fit_weak_labels(counts, rounds=300)
    found = model.chances[1, :, 2] / (model.chances[1, :, 0] + model.chances[1, :, 2])
    assert abs(model.good - 0.8) < 0.05
    assert np.allclose(found, accuracy, atol=0.05)


def test_votes():
    prose = "A plain sentence of several words, and then another one."
    assert votes(prose)[-2:] == "22"
    names = [name for name, _ in LABELLERS]
    for name, text in {
        "empty": " \n",
        "signs": "one%%% two### three*** four$$$ five&&&",
        "bars": "one | two | three | four | five | six",
        "shouting": "THIS IS ALL IN CAPITALS, EVERY WORD OF IT",
        "stutter": "again again again again and again again again again",
        "insults": "you are an idiot, that is clear",
    }.items():
        assert votes(text)[names.index(name)] == "0", name


def test_edge_rows(spark):
    prose = "A plain sentence of several words, and then another one. "
    rows = [(i, f"{prose}{i}", "s") for i in range(30)] + [(100, None, "s"), (101, "", "s"), (None, prose, "s")]
    rows += [(102, prose * 2000, "s"), (103, prose, "s"), (103, prose, "s"), (104, "x%%% " * 30, "s")]
    got = {}
    for r in classify_quality(spark.createDataFrame(rows, "doc_id long, text string, score string")).collect():
        got.setdefault(r.doc_id, []).append((r.accepted, r.score))
    assert sum(map(len, got.values())) == len(rows)
    assert not got[100][0][0] and not got[101][0][0] and not got[104][0][0]
    assert got[None][0][0] and got[102][0][0] and got[103][0] == got[103][1] == got[None][0]
    assert all(got[i][0][0] for i in range(30))
    empty = classify_quality(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.columns == ["doc_id", "votes", "label", "score", "accepted"] and empty.count() == 0
