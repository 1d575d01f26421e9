"""Language of web pages by fusing text, declared language, address and host evidence."""

from __future__ import annotations

import html as html_module
import re
from collections.abc import Iterator, Sequence
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from trichter.llm.common import with_lookup, written

_BITS = 16
_SILENT = re.compile(r"(?is)<(script|style|nav|noscript|template)\b.*?</\1\s*>|<!--.*?-->")
_TAG = re.compile(r"(?s)<[^>]*>")
_DECLARED = re.compile(r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?\s*([a-z]{2,3})\b""")
_SEGMENT = re.compile(r"(?i)^/([a-z]{2,3})(?:[/_-]|$)")


class TextModel:
    """Naive Bayes over hashed byte trigrams; one row of log chances per language."""

    def __init__(self, texts: Sequence[tuple[str, str]], smoothing: float = 0.5) -> None:
        self.languages = sorted({language for language, _ in texts})
        counts = np.full((len(self.languages), 1 << _BITS), smoothing)
        for language, text in texts:
            counts[self.languages.index(language)] += np.bincount(_trigrams(text), minlength=1 << _BITS)
        self.logs = np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)

    def chances(self, text: str, temper: float) -> np.ndarray:
        """Posterior under equal priors. Trigrams overlap and follow from one another, so their
        evidence is divided by ``temper``."""
        grams = _trigrams(text)
        if not len(grams):
            return np.full(len(self.languages), 1 / len(self.languages))
        return softmax(self.logs[:, grams].sum(1, dtype=np.float64) / temper)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def _trigrams(text: str) -> np.ndarray:
    raw = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-8", "surrogatepass"), np.uint8)
    if len(raw) < 5:
        return np.empty(0, np.int64)
    codes = raw.astype(np.uint32)
    mixed = (codes[:-2] * np.uint32(65_599) + codes[1:-1]) * np.uint32(65_599) + codes[2:]
    return ((mixed * np.uint32(0x9E3779B1)) >> np.uint32(32 - _BITS)).astype(np.int64)


def visible_text(page: str) -> str:
    return html_module.unescape(_TAG.sub(" ", _SILENT.sub(" ", page)))


def address_of(url: str | None) -> tuple[str, str, str, str]:
    """Host, registered part (its last two labels), last label, and language-like first path segment."""
    try:
        parts = urlsplit(url or "")
        host = (parts.hostname or "").rstrip(".")
    except ValueError:
        return "", "", "", ""
    labels = host.split(".")
    segment = _SEGMENT.match(parts.path)
    return host, ".".join(labels[-2:]), labels[-1], segment[1].lower() if segment else ""


def identify_languages(
    pages: DataFrame,
    labelled: DataFrame,
    *,
    id_col: str = "page_id",
    sample_per_language: int = 500,
    temper: float = 20.0,
    strength: float = 5.0,
) -> DataFrame:
    """The language of every page (``url``, ``html``), by Bayes' rule over four kinds of evidence.

    Text: naive Bayes over byte trigrams of the visible text, trained on at most
    ``sample_per_language`` texts per language of ``labelled`` (``doc_id``, ``lang``, ``text``;
    taken by the hash of the id). Declared language of the markup and address suffix (last label
    of the host with the language-like first segment of the path): likelihoods per language.
    Host: a prior, smoothed towards its domain, which is smoothed towards all pages, with
    ``strength`` imagined pages each. These three are grouped aggregates of the text posteriors
    over all pages; a page's own text is taken out of the host's counts. Groups are aggregated
    before the shuffle, and rows meet their group under a salt, so a hot host is dealt out.

    Returns per row the id, ``language``, ``probability``, ``text_language``, ``declared``,
    ``host`` and ``posterior`` (language to chance). Null html and urls are empty: a page without
    any evidence gets the overall shares. Ties go to the first language in alphabetical order.
    Rows are kept one by one, also repeated ones and such with null ids; other columns are
    ignored; an empty table gives no rows. Without any labelled text there is no language: null.
    """
    spark = pages.sparkSession
    found = _samples(labelled, sample_per_language)
    kind = pages.schema[id_col].dataType
    if not found:
        nothing = F.lit(None)
        empty = {"language": "string", "probability": "double", "text_language": "string", "declared": "string", "host": "string"}
        return pages.select(
            id_col, *[nothing.cast(t).alias(c) for c, t in empty.items()], nothing.cast("map<string,double>").alias("posterior")
        )
    model = TextModel(found)
    names = model.languages
    source = pages.select(pages[id_col].alias(id_col), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    fields = ["host", "domain", "suffix", "declared"]
    schema = StructType(
        [StructField(id_col, kind), *[StructField(f, StringType()) for f in fields], StructField("text", ArrayType(DoubleType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
                host, domain, last, segment = address_of(url)
                stated = _DECLARED.search(page or "")
                declared = stated[1].lower() if stated else ""
                chances = model.chances(visible_text(page or ""), temper)
                segment = segment if segment in names else ""
                rows.append((host, domain, f"{last}/{segment}", declared if declared in names else "", chances))
            columns = list(zip(*rows)) or [()] * 5
            arrays = [pa.array(c, pa.string()) for c in columns[:4]] + [pa.array(columns[4], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], schema.names)

    base = written(source.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "language-evidence")
    sums = [F.sum(F.get("text", n)).alias(f"s{n}") for n in range(len(names))]
    again = [F.sum(f"s{n}").alias(f"s{n}") for n in range(len(names))]
    packed = F.array(*[F.col(f"s{n}") for n in range(len(names))])

    hosts = written(base.groupBy("host", "domain").agg(*sums), "language-hosts")
    overall = hosts.agg(*again).first()
    totals = [float(x or 0.0) for x in overall]
    if not sum(totals):
        totals = [1.0] * len(names)
    shares = F.array(*[F.lit(t / sum(totals)) for t in totals])
    domains = hosts.groupBy("domain").agg(*again).select("domain", _smoothed(packed, shares, strength).alias("prior"))
    host_table = hosts.join(domains, "domain").select(
        "host", F.struct(packed.alias("sums"), F.col("prior").alias("above")).alias("known")
    )

    def likelihoods(column: str, out: str) -> DataFrame:
        """log P(value | language), smoothed by ``strength`` imagined pages of the overall shares."""
        groups = base.groupBy(column).agg(*sums)
        logs = F.array(*[F.log((F.col(f"s{n}") + strength * totals[n] / sum(totals)) / (totals[n] + strength)) for n in range(len(names))])
        return groups.select(column, logs.alias(out))

    joined = with_lookup(base, "host", host_table, "known", "row")
    joined = with_lookup(joined, "suffix", likelihoods("suffix", "from_suffix"), "from_suffix", "row")
    joined = with_lookup(joined, "declared", likelihoods("declared", "from_declared"), "from_declared", "row")

    others = F.zip_with("known.sums", "text", lambda s, own: F.greatest(s - own, F.lit(0.0)))
    prior = _smoothed(others, F.col("known.above"), strength)
    logs = F.transform(
        F.sequence(F.lit(0), F.lit(len(names) - 1)),
        lambda n: F.log(F.greatest(F.get("text", n), F.lit(1e-300)))
        + F.log(F.greatest(F.get("prior", n), F.lit(1e-12)))
        + F.get("from_suffix", n)
        + F.get("from_declared", n),
    )
    listed = F.array(*[F.lit(name) for name in names])
    scored = joined.withColumn("prior", prior).withColumn("logs", logs)
    scored = scored.withColumn("raised", F.transform("logs", lambda x: F.exp(x - F.array_max("logs"))))
    total = F.aggregate("raised", F.lit(0.0), lambda a, b: a + b)
    best = lambda chances: F.get(listed, (F.array_position(chances, F.array_max(chances)) - 1).cast("int"))
    return scored.select(
        id_col,
        best(F.col("logs")).alias("language"),
        (F.lit(1.0) / total).alias("probability"),
        best(F.col("text")).alias("text_language"),
        F.nullif("declared", F.lit("")).alias("declared"),
        F.nullif("host", F.lit("")).alias("host"),
        F.map_from_arrays(listed, F.transform("raised", lambda x: x / total)).alias("posterior"),
    )


def _smoothed(counts: Column, above: Column, strength: float) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, b: a + b)
    return F.zip_with(counts, above, lambda c, a: (c + F.lit(strength) * a) / (total + F.lit(strength)))


def _samples(labelled: DataFrame, per_language: int) -> list[tuple[str, str]]:
    """At most ``per_language`` (language, text) of each language, by the hash of the id.

    Ranks are limited per task before the shuffle, and texts are fetched for the chosen ids only.
    """
    rows = labelled.select("doc_id", "lang", "text").filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = rows.select("doc_id", "lang").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_language)
    chosen = chosen.select("doc_id", "lang").distinct()
    met = rows.join(F.broadcast(chosen), ["doc_id", "lang"])  # languages times per_language rows at most
    return [(r.lang, r.text) for r in met.collect()]
