from __future__ import annotations

import corpus_pipeline
from trichter.llm.quality import classify_quality

from .test_contamination import shingles
from .test_lines import brute as brute_lines
from .test_near_duplicates import brute as brute_groups
from .test_packing import _check, _whole_ids

FOLDER = "/root/testdata/sf0.001"


def test_run_equals_brute_force_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    accepted = {r.doc_id for r in classify_quality(docs).filter("accepted").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in accepted]
    left = {}
    marks = brute_lines(rows)
    for d, text in rows:
        count, dropped = marks.get((d, text), (0, []))
        if not count or len(dropped) < count:
            left[d] = "\n".join(x for n, x in enumerate(text.split("\n")) if n not in set(dropped))
    _, group = brute_groups(left)
    left = {d: t for d, t in left.items() if group[d] == d}
    items = [shingles(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    left = {d: t for d, t in left.items() if not any(i and len(i & shingles(t)) >= 0.75 * len(i) for i in items)}
    pieces = corpus_pipeline.run(spark, FOLDER).collect()
    want = dict(zip(left, _whole_ids(list(left.values()))))
    _check(pieces, want.values(), 4096)
    got = {}
    for p in sorted(pieces, key=lambda p: p.start):
        got[p.doc_id] = got.get(p.doc_id, b"") + bytes(p.ids)
    assert got == {d: ids.tobytes() for d, ids in want.items()}


def test_stages_keep_columns_and_take_empty_tables(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        assert out.count() == 0
        assert name == "packing" or out.columns == docs.columns
