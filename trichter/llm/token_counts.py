"""Token counts by a cache of digests."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trichter.llm.common import fresh_path, joined_by_frequency, path_exists, written

_SLICE_BYTES = 2_000_000  # of text, tokenized at once
_MEMO_WORDS, _MEMO_LENGTH = 300_000, 64
_BROADCAST_DIGESTS = 100_000
_BLANKS = "[ \\t\\n\\x0B\\f\\r]+"
_CACHE = "content binary, n_tokens long"


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 2048,
    cache: str | None = None,
) -> DataFrame:
    """The number of tokens of every text, from a cache that is filled with what it lacks.

    A text is known by the SHA-256 of its normal form, and a tokenizer by the SHA-256 of its file,
    library, library version and normal form. The cache is a folder with one table per tokenizer
    digest, ``content`` and ``n_tokens``. Texts whose digest it lacks are reduced to one per digest
    (before they are shuffled, so a text that many rows repeat travels once per task), tokenized
    there, and appended to the cache; then all rows read their counts from it. ``cache`` is a folder
    that driver and executors share and that later calls use again; without it the cache lives in
    the shared folder for this call only.

    The normal form of a tokenizer that drops white space collapses runs of ASCII white space; that
    of any other is the text itself. ``tokenizer_path`` is a ``.json`` of tokenizers or a ``.model``
    of sentencepiece. No begin, end or other special tokens are added; their strings inside a text
    count as the library counts them.

    Returns per row the id, ``n_bytes`` (of the text itself in UTF-8), ``n_tokens`` and
    ``over_limit`` (more tokens than ``limit``). Null texts are empty: no byte, no token. Rows are
    independent: repeated rows and null ids get a row each. Other columns are ignored. An empty
    table gives no rows. Texts are tokenized in slices of bounded length; a long text is taken apart
    at white space where the tokenizer drops it, and is otherwise a slice of its own. Two runs that
    append the same digest at once do no harm: equal digests count once. Where blanks stand between
    tokens, words are tokenized once per task while a bounded memo holds them.
    """
    spark = docs.sparkSession
    version, words = tokenizer_version(tokenizer_path)
    folder = f"{(cache or fresh_path(spark, 'token-cache')).rstrip('/')}/{version}"
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    content = _normal(text) if words else text
    source = docs.select(docs[id_col].alias("id"), text.alias("text"), content.alias("form"))
    source = source.select("id", F.octet_length("text").cast("long").alias("n_bytes"), "form", _digest("form").alias("content"))

    keyed = written(source.drop("form"), "token-digests")
    texts = source.select("content", "form")
    missing = keyed.select("content").distinct()
    if path_exists(spark, folder):
        missing = written(missing.join(_cached(spark, folder), "content", "left_anti"), "token-misses")
        count = missing.count()
        if count <= _BROADCAST_DIGESTS:
            texts = _one_each(texts.join(F.broadcast(missing), "content", "left_semi"))
        else:
            texts = _one_each(texts).join(missing, "content", "left_semi")
        wanted = count > 0
    else:
        wanted = True
        texts = _one_each(texts)
    if wanted:
        encoded(texts, tokenizer_path, words).write.mode("append").parquet(folder)

    counted = joined_by_frequency(keyed, ["content"], _cached(spark, folder))
    return counted.select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )


def _normal(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, _BLANKS, " "))


def _digest(column: str) -> Column:
    return F.unhex(F.sha2(F.col(column), 256))


def _one_each(texts: DataFrame) -> DataFrame:
    return texts.groupBy("content").agg(F.first("form").alias("form"))


def _cached(spark: SparkSession, folder: str) -> DataFrame:
    table = spark.read.schema(_CACHE).parquet(folder)
    return table.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def encoded(texts: DataFrame, tokenizer_path: str, words: bool) -> DataFrame:
    """``content, n_tokens`` of texts in normal form (``content, form``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_path, words)
        for batch in batches:
            found = []
            for slice_ in _slices(batch.column("form"), words):
                for (row, _), tokens in zip(slice_, count([piece for _, piece in slice_])):
                    if row == len(found):
                        found.append(tokens)
                    else:
                        found[row] += tokens
            yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array(found, pa.int64())], ["content", "n_tokens"])

    return texts.mapInArrow(run, _CACHE)


def _slices(texts: pa.Array, words: bool) -> Iterator[list[tuple[int, str]]]:
    """Lists of (row, text or piece of it), in order, of bounded length together."""
    held, size = [], 0
    for row in range(len(texts)):
        for piece in _pieces(texts[row].as_py(), words):
            held.append((row, piece))
            size += len(piece)
            if size >= _SLICE_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def _pieces(text: str, words: bool, length: int = _SLICE_BYTES) -> Iterator[str]:
    """The text, cut at the first blank behind every ``length`` signs where blanks stand between tokens."""
    start = 0
    while words and len(text) - start > length:
        cut = text.find(" ", start + length)
        if cut < 0:
            break
        yield text[start:cut]
        start = cut
    yield text[start:] if start else text


# Tokenizers


def counter(path: str, words: bool = False):
    """A function from texts to their numbers of tokens, with ``words`` as the sum over what stands between blanks."""
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in pieces.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def whole(texts: list[str]) -> list[int]:
        return [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    return WordCounts(whole) if words else whole


class WordCounts:
    """Counts texts word by word. Short words are tokenized once while the memo holds them."""

    def __init__(self, whole) -> None:
        self._whole = whole
        self._memo: dict[str, int] = {}

    def __call__(self, texts: list[str]) -> list[int]:
        split = [text.split(" ") for text in texts]
        if len(self._memo) > _MEMO_WORDS:
            self._memo.clear()
        known = self._memo
        new = list(set().union(*split).difference(known))
        found = dict(zip(new, self._whole(new)))
        known.update((word, count) for word, count in found.items() if len(word) <= _MEMO_LENGTH)
        if any(len(word) > _MEMO_LENGTH for word in new):
            known = {**known, **found}
        return [sum(map(known.__getitem__, words)) for words in split]


def tokenizer_version(path: str) -> tuple[str, bool]:
    """The digest of a tokenizer, and whether it drops white space."""
    with open(path, "rb") as file:
        data = file.read()
    if path.endswith(".model"):
        import sentencepiece as library

        words = False
    else:
        import tokenizers as library

        words = _drops_blanks(json.loads(data))
    named = f"{library.__name__} {library.__version__} {'words' if words else 'text'}\n".encode()
    return hashlib.sha256(named + data).hexdigest(), words


def _drops_blanks(config: dict) -> bool:
    """White space becomes one blank, and the blank is split off and removed; added tokens hold none."""
    normalizer = config.get("normalizer") or {}
    steps = normalizer.get("normalizers", [normalizer])
    collapses = any(s.get("type") == "Replace" and s.get("pattern") == {"Regex": "\\s+"} and s.get("content") == " " for s in steps)
    splitter = config.get("pre_tokenizer") or {}
    first = splitter.get("pretokenizers", [splitter])[0]
    removes = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
    added = config.get("added_tokens") or []
    plain = not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
    return collapses and removes and plain and _splits_blanks(config)


def _splits_blanks(config: dict) -> bool:
    """Words and signs stand for themselves between blanks, as the tokenizer counts them."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(json.dumps(config))

    def size(text: str) -> int:
        return len(tokenizer.encode(text, add_special_tokens=False).ids)

    probes = ["word", "Word2word", "it's", "'s", "...", "1 2", "́x", "Σ"]
    return size(" \t\n\x0b\f\r ") == 0 and all(
        size(f"{a}{blank}{b}") == size(a) + size(b) for a in probes for b in probes for blank in (" ", "\n", "\x0b\t ")
    )
