"""The operators as queries over the test tables, with production parameters."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trichter.llm.common import read_table
from trichter.llm.contamination import find_contamination
from trichter.llm.languages import identify_languages
from trichter.llm.licenses import scan_licenses
from trichter.llm.lines import dedup_lines
from trichter.llm.near_duplicates import near_duplicates
from trichter.llm.neighbours import nearest_neighbours
from trichter.llm.packing import pack
from trichter.llm.pseudonyms import pseudonymise
from trichter.llm.quality import classify_quality
from trichter.llm.ranked_search import search
from trichter.llm.statements import STATEMENTS
from trichter.llm.token_counts import count_tokens
from trichter.llm.vector_codes import compress_vectors
from trichter.llm.warc import archive_pages

Query = Callable[[SparkSession, str], DataFrame]

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place."""
    pieces = pack(read_table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated lines."""
    found = dedup_lines(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "lines", "kept_lines", "dropped", "text")


def feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with pseudonyms in place of personal numbers and dates.

    ``trichter.pseudonym.secret`` holds the key; Spark redacts settings of such names. Without it a
    key is drawn for this query alone, so its pseudonyms are linked to those of no other run.
    """
    key = spark.conf.get("trichter.pseudonym.secret", None) or secrets.token_hex(32)
    return pseudonymise(read_table(spark, sf_dir, "documents"), key).select("doc_id", "text", "pseudonyms")


def minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document."""
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page."""
    found = identify_languages(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "documents"))
    return found.drop("posterior")


def weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and decision of every document."""
    return classify_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a test item that it holds."""
    return find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows found for every hundredth vector."""
    return nearest_neighbours(read_table(spark, sf_dir, "embeddings"))


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence mentions of every document."""
    found = scan_licenses(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"
    )


def warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as read back from the normalised archives."""
    found = archive_pages(read_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token count of every document. ``trichter.token.cache`` names a cache that outlives the query."""
    cache = spark.conf.get("trichter.token.cache", None)
    return count_tokens(read_table(spark, sf_dir, "documents"), tokenizer_path(), cache=cache)


def vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every vector."""
    return compress_vectors(read_table(spark, sf_dir, "embeddings")).drop("label")


def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents of highest score for every test item."""
    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    "op1_harmonic_packing": harmonic_packing,
    "op2_line_dedup": line_dedup,
    "op3_feistel_pseudonyms": feistel_pseudonyms,
    "op4_minhash_near_dedup": minhash_near_dedup,
    "op5_language_fusion": language_fusion,
    "op6_weak_label_quality": weak_label_quality,
    "op7_benchmark_decontamination": benchmark_decontamination,
    "op8_inverted_multi_index": inverted_multi_index,
    "op9_license_scan": license_scan,
    "op10_warc_normaliser": warc_normaliser,
    "op11_ranked_search": ranked_search,
    "op12_token_counts": token_counts,
    "op13_vector_codes": vector_codes,
}

__all__ = ["QUERIES", "STATEMENTS"]
