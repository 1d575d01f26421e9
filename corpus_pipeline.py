"""From raw documents to packed training sequences, in five stages.

Every stage takes all that its predecessor kept. ``run`` writes each result as Parquet to the
shared folder and reads it again as the next stage's documents. All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trichter.llm.common import free_shuffles, joined_by_frequency, read_table, written
from trichter.llm.contamination import find_contamination
from trichter.llm.lines import dedup_lines
from trichter.llm.near_duplicates import near_duplicates
from trichter.llm.packing import pack
from trichter.llm.quality import keep_good
from trichter.llm.registered import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and documents of which nothing is left. ``n_chars`` follows the text."""
    cleaned = dedup_lines(docs, drop_emptied=True)
    if "n_chars" in docs.columns:
        shorter = F.size("dropped") > 0
        cleaned = cleaned.withColumn("n_chars", F.when(shorter, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return cleaned.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one of smallest id, null ids last.

    Rows are numbered first, so rows that share an id, or have none, are documents of their own.
    """
    numbered = written(docs.select(F.monotonically_increasing_id().alias("number"), F.struct("*").alias("doc")), "near-rows")
    found = near_duplicates(numbered.select("number", F.col("doc.text").alias("text")), id_col="number")
    place = F.struct(F.col("id").isNull().alias("last"), "id", "number").alias("place")
    ids = numbered.select("number", F.col("doc.doc_id").alias("id"))
    members = written(found.join(ids, "number").select("component_id", place), "near-members")
    firsts = members.groupBy("component_id").agg(F.min("place").alias("first"))
    gone = joined_by_frequency(members, ["component_id"], firsts).filter("place <> first").select("place.number")
    return numbered.join(gone, "number", "left_anti").select("doc.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Rows are told apart by 128 bits of id and text."""
    doc_id = F.col("doc_id").cast("string")
    key = F.concat_ws(" ", F.xxhash64(doc_id, "text"), F.xxhash64(F.lit(1), doc_id, "text")).alias("key")
    keyed = docs.select(key, F.col("text"), F.struct("*").alias("doc"))
    found = find_contamination(keyed.select("key", "text"), read_table(spark, sf_dir, "benchmark"), id_col="key")
    return keyed.join(found.select("key"), "key", "left_anti").select("doc.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their places in sequences."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

# Posterior labels, fuzzy lines and token ids have no SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the whole table of documents."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        free_shuffles(spark)
    return docs
