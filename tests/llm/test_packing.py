from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest

from trichter.llm import packing
from trichter.llm.packing import WordTokens, pack
from trichter.llm.registered import QUERIES, tokenizer_path

FIXTURE = [
    (1, "The quick brown fox. Don't stop, it's 2024!", "x"),
    (2, None, "x"),
    (3, "", "x"),
    (None, "an id that is missing", "x"),
    (4, "<|endoftext|> inside text with \x1c odd\x85spaces é café \U0001f600", "x"),
    (5, "word " * 9000, "x"),
    (6, "same", "x"),
    (6, "same", "x"),
    (7, "ÅNGSTRÖM Straße İstanbul ΟΔΟΣ", "x"),
]


def _whole_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    return [np.array([*e.ids, 2], "<u4") for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def _check(pieces, docs, capacity):
    """Every id in one piece, sequences without gaps and of full or power-of-two length."""
    per_seq = {}
    for p in pieces:
        per_seq.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for places in per_seq.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity and end & (end - 1) == 0
    assert len(pieces) and sum(p.length for p in pieces) == sum(len(ids) for ids in docs)


def test_fixture_round_trip(spark):
    frame = spark.createDataFrame(FIXTURE, "doc_id long, text string, start string").repartition(3)
    pieces = pack(frame, tokenizer_path(), capacity=512).collect()
    want = _whole_ids([t or "" for _, t, _ in FIXTURE])
    _check(pieces, want, 512)
    for (doc, _, _), ids in zip(FIXTURE, want):
        got = {p.start: bytes(p.ids) for p in pieces if p.doc_id == doc}
        assert b"".join(v for _, v in sorted(got.items())) == ids.tobytes()
        assert all(p.doc_tokens == len(ids) for p in pieces if p.doc_id == doc)


def test_query_over_the_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    pieces = QUERIES["op1_harmonic_packing"](spark, folder).collect()
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], _whole_ids([r.text or "" for r in rows])))
    _check(pieces, want.values(), 4096)
    for p in pieces:
        part = want[p.doc_id][p.start : p.start + p.length]
        assert (zlib.crc32(part.tobytes()), p.doc_tokens) == (p.ids_crc32, len(want[p.doc_id]))


def test_empty_table_and_bad_capacity(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pack(empty, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    with pytest.raises(ValueError):
        pack(empty, "", capacity=1000)


def test_text_without_spaces_does_not_fill_the_memo():
    from tokenizers import Tokenizer

    words = WordTokens(tokenizer_path())
    whole = Tokenizer.from_file(tokenizer_path())
    texts = ["\u6c34\u706b" * 400 + str(n) for n in range(50)] + ["ab" * 3000, "x" * 41 + "!" * 90, "Word, word,"]
    for text in texts:
        assert words.of(text) == b"".join(i.to_bytes(4, "little") for i in whole.encode(text, add_special_tokens=False).ids)
    assert max(map(len, words)) <= 40 and max(map(len, words._stems), default=0) <= 80 and len(words) < 10


def test_a_full_memo_starts_again(monkeypatch):
    monkeypatch.setattr(packing, "_MEMO_WORDS", 3)
    words, other = WordTokens(tokenizer_path()), WordTokens(tokenizer_path())
    text = "one two, three; four five six? one two"
    assert words.of(text) == b"".join(other.of(w) for w in text.split()) and len(words) <= 4
