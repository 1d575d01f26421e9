"""Quality classifier: heuristic labellers, a weak-label model, and a hashed linear scorer."""

from __future__ import annotations

import math
import re
import sys
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, MapType, StringType, StructField, StructType

from trichter.llm.common import hash_sample, written

BAD, NONE, GOOD = 0, 1, 2

# Common insults.
INSULTS = frozenset(
    "clown disgusting dumb fool garbage idiot imbecile jerk loser moron pathetic scum stupid trash vermin "
    "worthless".split()
)

_ENDS = ".,;:!?\"')]}»”’…"
_WORD = re.compile(r"[^\W_]+")
_SHINGLE = 5
_LEAST, _SHARE, _TIMES, _SURE = 3, 0.03, 10, 15.0  # of a toxic word, see learn_toxic_words
_MEMO_WORDS = 300_000
_IMAGINED = 0.05


@cache
def _kinds() -> np.ndarray:
    """Per code point: 1 for a letter, 2 more for a capital."""
    return np.array([c.isalpha() + 2 * c.isupper() for c in map(chr, range(sys.maxunicode + 1))], np.uint8)


def signals(text: str, toxic: frozenset[str] = frozenset()) -> dict[str, float]:
    """What the labellers look at, as shares of the words (``insults`` and ``toxic`` are numbers)."""
    words = text.split()
    n = max(1, len(words))
    bare = [w.rstrip(_ENDS) for w in words]
    kinds = _kinds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    letters = int(np.count_nonzero(kinds & 1))
    plain = _WORD.findall(text.lower())
    return {
        "words": len(words),
        "signs": sum(1 for w in bare if w and w[0].isalnum() and not w[-1].isalnum()) / n,
        "bars": sum(1 for w in bare if w and not any(map(str.isalnum, w))) / n,
        "upper": int(np.count_nonzero(kinds & 2)) / max(1, letters),
        "again": (again if (again := sum(1 for a, b in zip(words, words[1:]) if a == b)) > 2 else 0) / n,
        "letters": sum(1 for w in bare if w.isalpha()) / n,
        "insults": sum(map(INSULTS.__contains__, plain)),
        "toxic": sum(map(toxic.__contains__, plain)),
        "plain": len(plain),
    }


def _heavy(hits: float, words: float) -> bool:
    """So many hits for the length that they are not an accident: 2 %, or several and 0.3 %."""
    return hits >= 0.02 * words if hits == 1 else hits > 1 and hits >= 0.003 * words


# One labeller per line: it votes bad, good or not at all.
LABELLERS: tuple[tuple[str, object], ...] = (
    ("empty", lambda s: BAD if s["words"] == 0 else NONE),
    ("signs", lambda s: BAD if s["signs"] > 0.05 and s["words"] >= 5 else NONE),
    ("bars", lambda s: BAD if s["bars"] > 0.1 and s["words"] >= 5 else NONE),
    ("shouting", lambda s: BAD if s["upper"] > 0.5 and s["words"] >= 5 else NONE),
    ("stutter", lambda s: BAD if s["again"] > 0.1 and s["words"] >= 8 else NONE),
    ("insults", lambda s: BAD if _heavy(s["insults"], s["plain"]) else NONE),
    ("toxic", lambda s: BAD if _heavy(s["toxic"], s["plain"]) else NONE),
    ("prose", lambda s: GOOD if s["letters"] > 0.6 and s["upper"] < 0.4 and not _rude(s) else NONE),
    ("varied", lambda s: GOOD if s["again"] < 0.06 and s["signs"] < 0.04 and s["bars"] < 0.08 and not _rude(s) else NONE),
)


def _rude(s: dict[str, float]) -> bool:
    return _heavy(s["insults"], s["plain"]) or _heavy(s["toxic"], s["plain"])


def votes(text: str, toxic: frozenset[str] = frozenset()) -> str:
    """``toxic`` holds the toxic words of the text's language."""
    found = signals(text, toxic)
    return "".join(str(rule(found)) for _, rule in LABELLERS)


@dataclass(frozen=True)
class ToxicWords:
    """Toxic words per declared language; a text of no such language meets those of all."""

    by_language: dict[str, frozenset[str]]
    every: frozenset[str] = frozenset()

    def of(self, language: str | None) -> frozenset[str]:
        return self.by_language.get(language or "", self.every)


def learn_toxic_words(docs: DataFrame, labels: DataFrame, sample_rows: int = 1000) -> ToxicWords:
    """Words far more frequent in toxic than in clean documents, per language.

    ``docs`` has ``id, text, lang`` and ``labels`` has ``id, toxic`` (0 or 1; of several labels of an id
    the largest counts). About ``sample_rows`` toxic and as many clean labelled documents of each
    language, by the hash of the id, are looked at. Texts whose smallest shingle of five
    words is the same, as in copies, count once. A toxic word is in at least three and 3 % of the toxic
    texts, ten times the share of the clean ones, with a log-likelihood ratio of 15 (a chance
    of about 1e-4). Words are counted on the executors, and only toxic ones reach the driver.
    """
    lang = F.coalesce("lang", F.lit("")).alias("lang")
    marked = labels.filter("toxic IS NOT NULL").groupBy("id").agg((F.max("toxic") > 0).alias("toxic"))
    known = docs.select("id", lang).join(marked, "id").distinct()
    sizes = known.groupBy("lang", "toxic").agg(F.count(F.lit(1)).alias("size"))
    place = F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(2**31)) / F.lit(2.0**31)
    chosen = known.join(F.broadcast(sizes), ["lang", "toxic"]).filter(place * F.col("size") < sample_rows)
    texts = docs.select("id", "text", lang).join(F.broadcast(chosen.select("id", "lang", "toxic")), ["id", "lang"])
    worded = texts.select("lang", "toxic", "text").mapInArrow(_word_sets, "lang string, toxic boolean, sketch long, words array<string>")
    once = worded.groupBy("lang", "toxic", "sketch").agg(F.min("words").alias("words"))
    # The empty word counts the texts.
    every = F.explode(F.concat("words", F.array(F.lit("")))).alias("word")
    counts = once.select("lang", "toxic", every).groupBy("lang", "word")
    counts = written(counts.agg(F.count_if("toxic").alias("bad"), F.count_if(~F.col("toxic")).alias("clean")), "toxic-counts")
    totals = counts.filter("word = ''").select("lang", F.col("bad").alias("all_bad"), F.col("clean").alias("all_clean"))
    far = (F.col("bad") + 0.5) / (F.col("all_bad") + 1) >= _TIMES * (F.col("clean") + 0.5) / (F.col("all_clean") + 1)
    frequent = (F.col("bad") >= _LEAST) & (F.col("bad") >= _SHARE * F.col("all_bad"))
    found: dict[str, set[str]] = {}
    for r in counts.join(F.broadcast(totals), "lang").filter("word <> ''").filter(frequent & far).collect():
        if _likelihood_ratio(r.bad, r.all_bad, r.clean, r.all_clean) >= _SURE:
            found.setdefault(r.lang, set()).add(r.word)
    return ToxicWords({k: frozenset(v) for k, v in found.items()}, frozenset().union(*found.values()))


def _likelihood_ratio(k: int, n: int, j: int, m: int) -> float:
    """Twice the logarithm of how much likelier two shares, k of n and j of m, are than a common one."""

    def log(hits: int, of: int, share: float) -> float:
        return sum(c * math.log(p) for c, p in ((hits, share), (of - hits, 1 - share)) if c)

    common = (k + j) / (n + m)
    return 2 * (log(k, n, k / n) + log(j, m, j / max(1, m)) - log(k, n, common) - log(j, m, common))


def _word_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of every text, and the smallest hash of its shingles."""
    for batch in batches:
        sketches, sets = [], []
        for text in batch.column("text").to_pylist():
            words = _WORD.findall((text or "").lower())
            shingles = (" ".join(words[i : i + _SHINGLE]) for i in range(max(1, len(words) - _SHINGLE + 1)))
            sketches.append(min(zlib.crc32(s.encode("utf-8", "surrogatepass")) for s in shingles))
            sets.append(sorted(set(words)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), batch.column("toxic"), pa.array(sketches, pa.int64()), pa.array(sets, pa.list_(pa.string()))],
            ["lang", "toxic", "sketch", "words"],
        )


@dataclass(frozen=True)
class WeakLabels:
    """Share of good documents, and per class and labeller the chance of each vote."""

    good: float
    chances: np.ndarray  # class (bad, good) x labeller x vote

    def posterior(self, patterns: Sequence[str]) -> np.ndarray:
        """Chance of good per pattern of votes."""
        logs = np.log([[1 - self.good], [self.good]]) * np.ones((1, len(patterns)))
        for n in range(self.chances.shape[1]):
            logs += np.log(self.chances[:, n, [int(p[n]) for p in patterns]])
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit_weak_labels(counts: dict[str, int], rounds: int = 50) -> WeakLabels:
    """Expectation-maximisation over counted vote patterns.

    Votes are independent given the class; not voting is an outcome too. The start takes a
    document with a bad vote for bad, so the classes keep their meaning. A small part of an
    imagined document per class and vote keeps every chance above zero.
    """
    patterns = sorted(counts)
    weight = np.array([counts[p] for p in patterns], float)
    codes = np.array([[int(c) for c in p] for p in patterns])
    good = np.array([0.1 if str(BAD) in p else 0.9 for p in patterns])
    for _ in range(rounds):
        chances = np.empty((2, codes.shape[1], 3))
        for c, share in enumerate((1 - good, good)):
            for vote in range(3):
                chances[c, :, vote] = _IMAGINED + ((codes == vote) * (share * weight)[:, None]).sum(0)
        chances /= chances.sum(2, keepdims=True)
        model = WeakLabels(float(np.clip((good * weight).sum() / weight.sum(), 1e-6, 1 - 1e-6)), chances)
        good = model.posterior(patterns)
    return model


@dataclass(frozen=True)
class Scorer:
    weights: np.ndarray
    bias: float


class Features:
    """Hashed features: words without case and signs as shares of the text, and the labellers' votes as ones."""

    def __init__(self, bits: int) -> None:
        self._size = 1 << bits
        self._memo: dict[str, int] = {}

    def _bucket(self, token: str) -> int:
        found = self._memo.get(token)
        if found is None:
            if len(self._memo) >= _MEMO_WORDS:
                self._memo.clear()
            found = self._memo[token] = zlib.crc32(token.encode("utf-8", "surrogatepass")) % self._size
        return found

    def of(self, text: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
        words = text.lower().split()
        at = np.fromiter(map(self._bucket, words), np.int64, len(words))
        own = [self._bucket(f"vote {n} {vote}") for n, vote in enumerate(pattern)]
        return np.concatenate((at, own)), np.concatenate((np.full(len(at), 1 / max(1, len(at))), np.ones(len(own))))


def fit_scorer(rows: Sequence[tuple[str, str, float]], bits: int, rounds: int = 100, penalty: float = 1e-3) -> Scorer:
    """Logistic regression on (text, votes, chance of good) by gradient descent with the full sample per step."""
    features = Features(bits)
    found = [features.of(text, pattern) for text, pattern, _ in rows]
    at = np.concatenate([a for a, _ in found])
    value = np.concatenate([v for _, v in found])
    row = np.repeat(np.arange(len(rows)), [len(a) for a, _ in found])
    target = np.array([chance for _, _, chance in rows])
    used, at = np.unique(at, return_inverse=True)
    weights, bias = np.zeros(len(used)), 0.0
    scale = np.full(len(used), 1e-8)
    for _ in range(rounds):
        score = bias + np.bincount(row, weights[at] * value, len(rows))
        error = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - target
        slope = np.bincount(at, error[row] * value, len(used)) / len(rows) + penalty * weights
        scale += slope * slope
        weights -= 0.5 * slope / np.sqrt(scale)
        bias -= 0.5 * error.mean()
    whole = np.zeros(1 << bits, np.float32)
    whole[used] = weights
    return Scorer(whole, float(bias))


def classify_quality(
    docs: DataFrame,
    labels: DataFrame | None = None,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_rows: int = 4096,
    bits: int = 18,
    threshold: float = 0.5,
) -> DataFrame:
    """The chance of every document to be good, and whether it is accepted.

    Overlapping heuristic labellers vote good, bad or not at all on each document (signs behind
    words, words of signs, capitals, stutter, insults, toxic words of the language, empty texts; plain
    and varied prose). Toxic words are learned from ``labels`` (the id and ``toxic``), see
    ``learn_toxic_words``; without labels there are none. Without ``lang_col`` all documents count as one language. The number of
    documents per pattern of votes is counted over all documents, and expectation-maximisation
    estimates how often each labeller votes so for good and bad documents. The posterior labels of
    at most ``sample_rows`` documents, taken by the hash of id and text, train a logistic
    scorer over 2**``bits`` hashed features: words and votes. It scores every document.

    Returns per row the id, ``votes``, ``label`` (posterior chance of good from the votes),
    ``score`` (of the scorer) and ``accepted`` (score at ``threshold`` or above). Null texts are
    empty, and texts without a word are never accepted. Rows are independent: repeated rows and null ids get a row
    each, equal texts the same score. Other columns are ignored; an empty table gives no rows.
    """
    source = _source(docs, id_col, text_col, lang_col)
    source = source.withColumn("_spread", F.xxhash64(F.col("id").cast("string"), "text"))
    judge = _fit(source, _toxic_words(source, labels, id_col), sample_rows, bits)
    if judge is None:
        return source.select(
            F.col("id").alias(id_col),
            F.lit("").alias("votes"),
            F.lit(0.0).alias("label"),
            F.lit(0.0).alias("score"),
            F.lit(False).alias("accepted"),
        )
    schema = StructType(
        [
            StructField(id_col, source.schema["id"].dataType),
            StructField("votes", StringType()),
            StructField("label", DoubleType()),
            StructField("score", DoubleType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(bits)
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            rows = [judge.of(text or "", lang, features) for text, lang in zip(texts, langs)]
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.float64())],
                schema.names,
            )

    not_empty = ~F.startswith("votes", F.lit(str(BAD)))
    return source.drop("_spread").mapInArrow(run, schema).withColumn("accepted", not_empty & (F.col("score") >= threshold))


def keep_good(
    docs: DataFrame,
    labels: DataFrame | None = None,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_rows: int = 4096,
    bits: int = 18,
    threshold: float = 0.5,
) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``classify_quality`` accepts; one pass without a shuffle.

    With ``labels`` the toxic words are learned before, from ids and a sample of the texts.
    """
    plain = [f.name for f in docs.schema if not isinstance(f.dataType, (ArrayType, MapType, StructType))]
    source = _source(docs, id_col, text_col, lang_col, F.xxhash64(*plain).alias("_spread"))
    judge = _fit(source, _toxic_words(source, labels, id_col), sample_rows, bits)
    if judge is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(bits)
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            langs = batch.column(lang_col).to_pylist() if lang_col in batch.schema.names else [None] * len(texts)
            found = [judge.of(text or "", lang, features) for text, lang in zip(texts, langs)]
            yield batch.filter(pa.array([p[0] != str(BAD) and score >= threshold for p, _, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


@dataclass(frozen=True)
class Judge:
    """Learned toxic words, a fitted weak-label model and scorer; sent to every task."""

    toxic: ToxicWords
    posterior: dict[str, float]
    scorer: Scorer

    def of(self, text: str, lang: str | None, features: Features) -> tuple[str, float, float]:
        """Votes, posterior label and score."""
        pattern = votes(text, self.toxic.of(lang))
        at, value = features.of(text, pattern)
        score = self.scorer.bias + float((self.scorer.weights[at] * value).sum())
        return pattern, self.posterior[pattern], 1 / (1 + float(np.exp(-np.clip(score, -30, 30))))


def _source(docs: DataFrame, id_col: str, text_col: str, lang_col: str, *more: Column) -> DataFrame:
    """``id, text, lang`` and further columns; the id is null where there is none, and so is the language."""
    none = F.lit(None).cast("string")
    ids = docs[id_col] if id_col in docs.columns else none
    lang = docs[lang_col].cast("string") if lang_col in docs.columns else none
    return docs.select(ids.alias("id"), docs[text_col].cast("string").alias("text"), lang.alias("lang"), *more)


def _toxic_words(source: DataFrame, labels: DataFrame | None, id_col: str) -> ToxicWords:
    if labels is None:
        return ToxicWords({})
    return learn_toxic_words(source.select("id", "text", "lang"), labels.select(F.col(id_col).alias("id"), "toxic"))


def _fit(source: DataFrame, toxic: ToxicWords, sample_rows: int, bits: int) -> Judge | None:
    """Count votes over all texts and fit both models; nothing for an empty table."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            found = [votes(text or "", toxic.of(lang)) for text, lang in zip(texts, langs)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["votes"])

    voted = source.select("text", "lang").mapInArrow(vote, "votes string")
    counts = {r.votes: r["count"] for r in voted.groupBy("votes").count().collect()}  # at most three to the labellers
    if not counts:
        return None
    labels = fit_weak_labels(counts)
    posterior = dict(zip(counts, labels.posterior(list(counts)).tolist()))
    text = F.coalesce("text", F.lit(""))
    sample = hash_sample(source.select(text.alias("text"), "lang", "_spread"), F.col("_spread"), sample_rows, sum(counts.values()))
    rows = [(r.text, votes(r.text, toxic.of(r.lang))) for r in sample.collect()]
    scorer = fit_scorer([(t, p, posterior[p]) for t, p in rows], bits)
    return Judge(toxic, posterior, scorer)
