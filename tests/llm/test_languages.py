from __future__ import annotations

import math

import numpy as np

from trichter.llm.languages import TextModel, address_of, identify_languages, visible_text
from trichter.llm.registered import QUERIES

FOLDER = "/root/testdata/sf0.01"
LABELLED = [(n, "en", "the house and the garden of this street with that tree " * 3) for n in range(5)] + [
    (n, "de", "das Haus und der Garten dieser Straße mit jenem Baum " * 3) for n in range(5, 10)
]


def page(text, lang=None):
    attribute = f' lang="{lang}"' if lang else ""
    return f"<!DOCTYPE html><html{attribute}><head><script>var x='der die das';</script></head><body><p>{text}</p></body></html>"


def labelled(spark):
    return spark.createDataFrame(LABELLED, "doc_id long, lang string, text string")


def test_held_out_texts(spark):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").collect()]
    model = TextModel(rows[:600])
    held_out = [r for r in rows[600:] if len(r[1]) > 100]
    hits = [model.languages[int(np.argmax(model.chances(text, 20.0)))] == lang for lang, text in held_out]
    assert np.mean(hits) >= 0.98


def test_parts_of_pages():
    assert address_of("https://M.Shop.example.de:80/fr/1?x") == ("m.shop.example.de", "example.de", "de", "fr")
    assert address_of(None) == ("", "", "", "") == address_of("http://[bad")
    assert visible_text("<nav>no</nav>a<!-- no -->b &amp; c<style>p{}</style>").split() == ["a", "b", "&", "c"]


def test_evidence_decides_where_text_does_not(spark):
    english, german = LABELLED[0][2], LABELLED[5][2]
    rows = [(n, f"http://a.example.com/{n}", page(english)) for n in range(40)]
    rows += [(100 + n, f"http://b.example.com/{n}", page(german, "de")) for n in range(40)]
    rows += [(200, "http://a.example.com/x", page("")), (201, "http://b.example.com/x", page("")), (202, "http://a.example.com/y", page(german))]
    rows += [(203, "http://c.example.com/y", page("", "de"))]
    got = {r.page_id: r for r in identify_languages(spark.createDataFrame(rows, "page_id long, url string, html string"), labelled(spark)).collect()}
    assert {got[n].language for n in range(40)} == {"en"} and {got[100 + n].language for n in range(40)} == {"de"}
    assert [got[n].language for n in (200, 201, 202, 203)] == ["en", "de", "de", "de"]
    assert all(math.isclose(sum(r.posterior.values()), 1) and r.posterior[r.language] == max(r.posterior.values()) for r in got.values())
    assert all(math.isclose(r.probability, r.posterior[r.language]) for r in got.values())


def test_edge_rows(spark):
    rows = [(1, None, None, "x"), (1, None, None, "x"), (None, "", "", "x"), (2, "not a url", "<" * 9, "x"), (3, "http://h/", page("und " * 60_000), "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = identify_languages(frame, labelled(spark)).collect()
    assert sorted(str(r.page_id) for r in got) == ["1", "1", "2", "3", "None"]
    assert next(r for r in got if r.page_id == 3).language == "de"
    none = identify_languages(frame, labelled(spark).limit(0)).collect()
    assert len(none) == 5 and {r.language for r in none} == {None}
    assert identify_languages(frame.limit(0), labelled(spark)).count() == 0


def test_query_keeps_every_page(spark):
    rows = QUERIES["op5_language_fusion"](spark, FOLDER).collect()
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    assert sorted(r.page_id for r in rows) == sorted(r.page_id for r in pages.select("page_id").collect())
    assert all(0 < r.probability <= 1 + 1e-9 for r in rows)
