from __future__ import annotations

import random

import pytest

from trichter.llm import token_counts
from trichter.llm.registered import QUERIES, tokenizer_path
from trichter.llm.token_counts import count_tokens, tokenizer_version

from .helpers import DATA, ordered


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def brute(tokenizer, rows, limit=2048):
    found = []
    for doc, text in rows:
        count = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        found.append((doc, len((text or "").encode()), count, count > limit))
    return ordered(found)


def test_query_equals_the_library(spark, tokenizer):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert ordered(QUERIES["op12_token_counts"](spark, DATA).collect()) == brute(tokenizer, rows)


ROWS = [
    (1, None),
    (2, ""),
    (3, " \t\n\x0b\r\f"),
    (4, "Two  words\nand\tmore"),
    (4, "Two words and more"),
    (4, "Two words and more"),
    (None, "No id, it's here"),
    (5, "a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|>"),
    (6, "x ́y  z q \x85 é Å ΣΣ 中文 12345 \U0001f600‍"),
    (7, "word " * 30_000),
    (8, "unbroken" * 10_000),
    (9, "' s 's\n't we 'll"),
]


def test_edge_rows(spark, tokenizer):
    frame = spark.createDataFrame([(d, t, 1, 2, None) for d, t in ROWS], "doc_id long, text string, n_bytes int, content int, form string")
    assert ordered(count_tokens(frame, tokenizer_path()).collect()) == brute(tokenizer, ROWS)
    assert count_tokens(frame.limit(0), tokenizer_path()).collect() == []


def test_other_tokenizers_count_the_text_itself(spark):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    frame = spark.createDataFrame(ROWS, "doc_id long, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert not tokenizer_version(path)[1]
    assert ordered(count_tokens(frame, path).collect()) == brute(Tokenizer.from_file(path), ROWS)
    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    want = ordered((d, len((t or "").encode()), n, n > 2048) for d, t in ROWS for n in [len(pieces.encode(t or ""))])
    assert ordered(count_tokens(frame, path).collect()) == want


def test_long_texts_are_cut_at_blanks(spark, tokenizer, monkeypatch):
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("aB1.'é<|") for _ in range(rng.randrange(1, 9))) for _ in range(3000))
    whole = len(tokenizer.encode(text, add_special_tokens=False).ids)
    monkeypatch.setattr(token_counts, "_MEMO_WORDS", 500)
    monkeypatch.setattr(token_counts, "_MEMO_LENGTH", 4)
    count = token_counts.counter(tokenizer_path(), True)
    assert token_counts.counter(tokenizer_path())([text]) == [whole]
    for length in (1, 7, 100, 5000):
        pieces = list(token_counts._pieces(text, True, length))
        assert "".join(pieces) == text
        assert sum(count(pieces)) == whole
    assert list(token_counts._pieces(text, False, 5)) == [text]


def test_cache_is_read_and_only_misses_are_encoded(spark, tokenizer, tmp_path, monkeypatch):
    cache = f"file://{tmp_path}/cache"
    asked = []
    plain = token_counts.encoded

    def noted(texts, path, words):
        asked.append(sorted(r.form for r in texts.collect()))
        return plain(texts, path, words)

    monkeypatch.setattr(token_counts, "encoded", noted)

    def run(rows):
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        return ordered(count_tokens(frame, tokenizer_path(), cache=cache).collect())

    first = [(1, "some text"), (2, "some  text "), (3, "another")]
    assert run(first) == brute(tokenizer, first)
    assert asked.pop() == ["another", "some text"]
    assert run(first) == brute(tokenizer, first)
    assert asked == []
    more = first + [(4, "new one"), (5, "new\none")]
    assert run(more) == brute(tokenizer, more)
    assert asked.pop() == ["new one"]
    monkeypatch.setattr(token_counts, "_BROADCAST_DIGESTS", 0)
    even_more = more + [(6, "and another new one")]
    assert run(even_more) == brute(tokenizer, even_more)
    assert asked.pop() == ["and another new one"]
    version, _ = tokenizer_version(tokenizer_path())
    stored = spark.read.parquet(f"{cache}/{version}")
    assert stored.count() == stored.select("content").distinct().count() == 4
    # An entry that two runs appended counts once.
    stored.write.mode("append").parquet(f"{cache}/{version}")
    assert run(even_more) == brute(tokenizer, even_more)
