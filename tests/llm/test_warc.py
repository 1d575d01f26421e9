from __future__ import annotations

import gzip
import json

from trichter.llm import warc
from trichter.llm.registered import QUERIES, STATEMENTS

from .helpers import DATA, assert_same_as_sql, ordered

PAGES = [
    (1, "http://a.example/ x\r\nInjected: 1", "<p>same</p>", "r"),
    (2, None, "<p>same</p>", "r"),
    (None, "http://n.example/", "<p>same</p>", "r"),
    (2, "http://b.example/", "<p>same</p>", "r"),
    (3, "http://c.example/", None, "r"),
    (4, "http://d.example/", "", "r"),
    (5, "http://e.example/", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n", "r"),
    (6, "http://f.example/", "ü" * 700_000, "r"),
    (7, "http://g.example/", "only", "r"),
    (7, "http://g.example/", "only", "r"),
    (None, "http://h.example/", "nobody", "r"),
    (None, "http://i.example/", "nobody", "r"),
]
SCHEMA = "page_id long, url string, html string, record_type string"


def test_fixture_round_trip(spark):
    rows = warc.archive_pages(spark.createDataFrame(PAGES, SCHEMA).repartition(4)).collect()
    got = ordered((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, r.html) for r in rows)
    revisits = [(2, 1, "<p>same</p>"), (2, 1, "<p>same</p>"), (None, 1, "<p>same</p>"), (4, 3, "")]
    want = []
    for page_id, _, html, _ in PAGES:
        payload = (html or "").encode()
        hit = next((r for r in revisits if (r[0], r[2]) == (page_id, html or "")), None)
        want.append(
            (page_id, "revisit" if hit else "response", hit and hit[1], len(payload), warc.payload_digest(payload), None if hit else html or "")
        )
    assert got == ordered(want)


def test_every_record_is_a_member_and_the_index_finds_it(spark, tmp_path):
    frame = spark.createDataFrame(PAGES, SCHEMA).coalesce(1)
    whole = warc.write_archives(warc.mark_revisits(frame), f"{tmp_path}/whole", file_bytes=400)
    assert whole.count() > 1
    files = warc.normalise(whole, f"{tmp_path}/records").collect()
    assert sum(f.n_records for f in files) == len(PAGES)
    for f in files:
        data = open(f.path, "rb").read()
        ends = 0
        for line in open(f.path + ".cdxj"):
            entry = json.loads(line)
            assert entry["offset"] == ends
            ends += entry["length"]
            assert gzip.decompress(data[entry["offset"] : ends]).startswith(b"WARC/1.1\r\n")
        assert ends == len(data) == f.n_bytes


def test_small_payloads_stay_responses(spark):
    marked = warc.mark_revisits(spark.createDataFrame(PAGES, SCHEMA), min_bytes=5).collect()
    assert {r.page_id for r in marked if r.refers_to is not None} == {2, None}


def test_empty_table(spark):
    assert warc.archive_pages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_matches_sql(spark, duck):
    assert_same_as_sql(QUERIES["op10_warc_normaliser"](spark, DATA), duck, STATEMENTS["op10_warc_normaliser"])
