"""Benchmark decontamination: MinHash containment search for short items inside long documents."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trichter.llm.common import row_key, written

SHINGLE = 5
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BROADCAST_ROWS = 1_000_000
_BROADCAST_NUMBERS = 8_000_000
_SEED_STEP = 62_089_911


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    containment: float = 0.75,
    miss: float = 1e-9,
) -> DataFrame:
    """Pairs of a document and a test item of which it holds at least the share ``containment``.

    Sets hold distinct five-word shingles (words between ASCII white space, A-Z in lower case; the
    whole sequence where there are fewer words), and containment is the share of the item's set
    found in the document's. An item of one to four words is held by every document in which these
    words stand one after the other: windows of the lengths that occur among such items join the
    documents' sets. MinHash containment: under a universal hash function the smallest
    shingle of an item lies in a document with a chance equal to the containment, however long
    the document is, so signatures of the items suffice. Items are partitioned by the size of
    their sets; a partition has as many hash functions as keep the chance to miss an item at the
    bound under ``miss``. The shingles of a document are looked up among these minima, a document
    smaller than any item of a partition allows is not looked up there, and every candidate is
    verified by exact shingle containment. All of it are DataFrame expressions. Minima and item
    sets are counted, and broadcast only up to a fixed number of them, else joined by shuffle.

    Returns ``id, item_id, shared, item_shingles, containment`` per pair. Null and empty texts
    hold nothing and are held by nothing. Repeated rows give one pair; rows that share an id
    count as documents of their own, the largest share is reported. Null ids are reported as
    null. Other columns are ignored; empty tables give no rows.
    """
    spark = docs.sparkSession
    sized = _with_shingles(items.select(items[item_id_col].alias("item_id"), items[item_text_col].alias("text")))
    sized = sized.filter(F.size("shingles") > 0).select(
        "item_id",
        "shingles",
        F.size("shingles").alias("item_shingles"),
        F.size(words(F.col("text"))).alias("length"),
        row_key("item_id", "text").alias("item_key"),
    )
    sized = written(sized.dropDuplicates(["item_key"]), "benchmark-sets")
    lengths = sorted(r[0] for r in sized.filter(F.col("length") < SHINGLE).select("length").distinct().collect())
    minima = written(_minima(sized, containment, miss), "benchmark-minima")
    small = minima.count() <= _BROADCAST_ROWS
    numbers = sized.agg(F.sum("item_shingles")).first()[0] or 0

    source = docs.select(
        docs[id_col].alias("doc_id"), docs[text_col].alias("text"), row_key(id_col, text_col).alias("doc_key")
    )
    found = _with_shingles(source, lengths).select("doc_key", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    met = found.join(F.broadcast(minima) if small else minima, "shingle").filter("n >= least")
    candidates = written(met.select("doc_key", "item_key").distinct(), "benchmark-candidates")

    chosen = source.join(candidates.select("doc_key").distinct(), "doc_key", "left_semi").dropDuplicates(["doc_key"])
    chosen = _with_shingles(chosen, lengths).select("doc_key", "doc_id", F.col("shingles").alias("held"))
    pairs = candidates.join(chosen, "doc_key").join(
        F.broadcast(sized) if numbers <= _BROADCAST_NUMBERS else sized, "item_key"
    )
    shared = F.size(F.array_intersect("shingles", "held"))
    return (
        pairs.select("doc_id", "item_id", shared.alias("shared"), "item_shingles")
        .filter(F.col("shared") >= F.lit(containment) * F.col("item_shingles"))
        .withColumn("containment", F.col("shared") / F.col("item_shingles"))
        .groupBy("doc_id", "item_id")
        .agg(F.max(F.struct("containment", "shared", "item_shingles")).alias("best"))
        .select(
            F.col("doc_id").alias(id_col),
            F.col("item_id").alias(item_id_col),
            F.col("best.shared").cast("long").alias("shared"),
            F.col("best.item_shingles").cast("long").alias("item_shingles"),
            F.col("best.containment").alias("containment"),
        )
    )


def words(text: Column) -> Column:
    """Words between ASCII white space, with A-Z in lower case; none for null."""
    folded = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    return F.filter(F.split(folded, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def _with_shingles(df: DataFrame, lengths: Sequence[int] = ()) -> DataFrame:
    """Add the distinct hashes of the shingles of ``text``, and of its windows of the ``lengths``.

    Words are hashed once and bound to a lambda's variable, and the result passes a generator of
    one row: both keep the optimizer from writing the expression out at every use.
    """
    hashed = F.transform(words(F.col("text")), lambda w: F.xxhash64(w))
    none = F.array().cast("array<bigint>")

    def windows(h: Column, length: int) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - F.lit(length))
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + n) for n in range(length)]))

    def shingles(h: Column) -> Column:
        # The hash of an array is that of its elements as columns: a short item equals its window.
        one = F.when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(none)
        parts = [F.when(F.size(h) >= F.lit(SHINGLE), windows(h, SHINGLE)).otherwise(one)]
        parts += [F.when(F.size(h) >= F.lit(n), windows(h, n)).otherwise(none) for n in lengths]
        return F.array_distinct(F.concat(*parts) if lengths else parts[0])

    return df.select("*", F.explode(F.transform(F.array(hashed), shingles)).alias("shingles"))


def _functions(part: int, containment: float, miss: float) -> int:
    """Hash functions for sets of 2**part to 2**(part + 1) - 1 shingles.

    A small set meets the bound only with a whole number of shingles, so its share is larger.
    """
    sizes = range(1 << part, 2 << part) if part < 10 else ()
    share = min((math.ceil(containment * n) / n for n in sizes), default=containment)
    return 1 if share >= 1 else math.ceil(math.log(miss) / math.log(1 - share))


def _minima(items: DataFrame, containment: float, miss: float) -> DataFrame:
    """``shingle, item_key, least``: the minima of every item, with the least size of a document that can hold it."""
    part = F.floor(F.log2("item_shingles")).cast("int")
    functions = F.array(*[F.lit(_functions(p, containment, miss)) for p in range(31)])
    hashed = items.select(
        "item_key",
        F.ceil(F.lit(containment) * F.pow(F.lit(2), part)).cast("int").alias("least"),
        F.explode(F.sequence(F.lit(1), functions[part])).alias("function"),
        "shingles",
    )
    ranked = F.transform(
        "shingles",
        lambda s: F.struct(F.xxhash64(F.col("function") * _SEED_STEP, s).alias("rank"), s.alias("shingle")),
    )
    return hashed.select(F.array_min(ranked)["shingle"].alias("shingle"), "item_key", "least").distinct()
