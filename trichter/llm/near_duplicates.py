"""Near-duplicate documents by MinHash over word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from trichter.llm.banding import linked_components
from trichter.llm.common import salt_of, written
from trichter.llm.components import star_components

BANDS, ROWS = 40, 5
SHINGLE = 5
_SALTS = 8
_MEMO_WORDS = 400_000
_CHUNK_WORDS = 150_000

_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: int = 75
) -> DataFrame:
    """Groups of documents linked by a Jaccard similarity of their word shingles of ``similarity`` per cent.

    Words are separated by ASCII white space, with A-Z in lower case; a document's set holds its
    distinct shingles of five words, or the whole sequence where it has fewer. Two documents are
    linked if 100 * intersection >= ``similarity`` * union; documents without a word are linked
    with nothing.

    One pass over the texts computes 200 universal hash minima per document. Documents of equal
    sets form a class, and one of each class goes on. 40 bands of five minima put two documents of
    75 % into a common bucket with a chance of 0.99998. Pairs of a bucket are screened by their
    signatures (five standard deviations below the bound) and confirmed on their full sets. Not all
    pairs of a bucket are made: a document first meets the smallest one of its buckets, then one
    of another component, and only members that are still in different components meet one
    another, in blocks. So a large group of copies costs a few comparisons per member, while no
    link is missed that would join two components. Components come from alternating large-star
    and small-star.

    Returns per row the id, ``n_shingles``, ``component_id`` (smallest id reachable) and ``kept``
    (the document is the smallest of its component). Null texts are empty. Rows with a null id
    are linked with nothing: null component, kept. Rows that share an id count as one document
    with several texts: repeated rows get the same result. Other columns are ignored; an empty
    table gives no rows.
    """
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    signed = written(_signatures(source), "minhash")
    linkable = signed.filter("doc_id IS NOT NULL AND n_shingles > 0")
    rows = linkable.select("doc_id", "digest").withColumn("salt", salt_of("doc_id", _SALTS))
    parts = rows.groupBy("digest", "salt").agg(F.min("doc_id").alias("least"))
    classes = written(parts.groupBy("digest").agg(F.min("least").alias("node")), "minhash-classes")

    firsts = linkable.join(classes, (F.col("doc_id") == F.col("node")) & (signed.digest == classes.digest)).select("node", F.col("bands").alias("buckets"))
    components = linked_components(
        firsts,
        lambda wanted: _sets(source.join(wanted, source.doc_id == wanted.node, "left_semi")),
        star_components,
        similarity=similarity,
        minima=BANDS * ROWS,
    )

    placed = classes.join(components, "node", "left").select(
        "digest", F.coalesce("component", "node").alias("component")
    )
    by_part = parts.select("digest", "salt").join(placed, "digest")
    found = (
        signed.select("doc_id", "n_shingles", "digest")
        .withColumn("salt", salt_of("doc_id", _SALTS))
        .join(by_part, ["digest", "salt"], "left")
    )
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return found.select(
        F.col("doc_id").alias(id_col),
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


# Shingles and signatures


class ShingleSets:
    """Sorted distinct 64-bit shingle hashes of texts. A word is hashed once while the memo holds it."""

    def __init__(self, shingle: int = SHINGLE) -> None:
        self._memo: dict[bytes, int] = {}
        self._factors = np.random.default_rng(11).integers(1, 1 << 63, shingle, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        words = [text.encode("utf-8", "surrogatepass").translate(_LOWER).split() for text in texts]
        memo = self._memo
        if len(memo) > _MEMO_WORDS:
            memo.clear()
        for word in set().union(*words).difference(memo):
            memo[word] = xxhash.xxh3_64_intdigest(word)
        total = sum(map(len, words))
        hashes = np.fromiter((h for doc in words for h in map(memo.__getitem__, doc)), np.uint64, total)
        width = len(self._factors)
        whole = np.zeros(max(0, total - width + 1), np.uint64)
        for place, factor in enumerate(self._factors):
            whole += hashes[place : place + len(whole)] * factor
        sets, start = [], 0
        for doc in words:
            count = len(doc)
            if count >= width:
                sets.append(np.unique(whole[start : start + count - width + 1]))
            else:
                short = (hashes[start : start + count] * self._factors[:count]).sum(dtype=np.uint64)
                sets.append(np.array([short] if count else [], np.uint64))
            start += count
        return sets


class MinHash:
    """Minima of ``a * x + b`` modulo 2**64 with odd ``a`` over sets of hashes."""

    def __init__(self, count: int = BANDS * ROWS) -> None:
        rng = np.random.default_rng(23)
        self._a = rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self._b = rng.integers(0, 1 << 63, count, dtype=np.uint64)
        self._mix = rng.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def minima(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row per (not empty) set."""
        values = np.concatenate(sets)
        starts = np.cumsum([0, *map(len, sets[:-1])])
        found = np.empty((len(self._a), len(sets)), np.uint64)
        buffer = np.empty_like(values)
        for n, (a, b) in enumerate(zip(self._a, self._b)):
            np.multiply(values, a, out=buffer)
            np.add(buffer, b, out=buffer)
            found[n] = np.minimum.reduceat(buffer, starts)
        return found.T

    def bands(self, minima: np.ndarray) -> np.ndarray:
        """A bucket number per band, different between bands."""
        groups = (minima.reshape(len(minima), BANDS, ROWS) * self._mix).sum(2, dtype=np.uint64)
        groups += np.arange(groups.shape[1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return _mixed(groups).view(np.int64)

    def bytes_of(self, minima: np.ndarray) -> np.ndarray:
        """Eight bits of each minimum, enough to compare signatures."""
        return (_mixed(minima) >> np.uint64(56)).astype(np.uint8)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def text_slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch with about ``_CHUNK_WORDS`` words, one text at least."""
    start, size, texts = 0, 0, []
    for n, text in enumerate(batch.column(column)):
        texts.append(text.as_py() or "")
        size += len(texts[-1]) // 6
        if size >= _CHUNK_WORDS:
            yield batch.slice(start, n + 1 - start), texts
            start, size, texts = n + 1, 0, []
    if texts:
        yield batch.slice(start), texts


def _signatures(source: DataFrame) -> DataFrame:
    schema = StructType(
        [
            StructField("doc_id", LongType()),
            StructField("n_shingles", LongType()),
            StructField("digest", BinaryType()),
            StructField("bands", BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, minhash = ShingleSets(), MinHash()
        for batch in batches:
            for part, texts in text_slices(batch):
                sets = shingles(texts)
                full = [s for s in sets if len(s)]
                minima = minhash.minima(full) if full else np.empty((0, BANDS * ROWS), np.uint64)
                bands = iter(minhash.bands(minima))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                        pa.array([next(bands).tobytes() if len(s) else b"" for s in sets], pa.binary()),
                    ],
                    schema.names,
                )

    return source.mapInArrow(run, schema)


def _sets(source: DataFrame) -> DataFrame:
    """The signatures and full sets of documents with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, minhash = ShingleSets(), MinHash()
        for batch in batches:
            for part, texts in text_slices(batch):
                pairs = [(d, s) for d, s in zip(part.column("doc_id").to_pylist(), shingles(texts)) if len(s)]
                if pairs:
                    lines = minhash.bytes_of(minhash.minima([s for _, s in pairs]))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([d for d, _ in pairs], pa.int64()),
                            pa.array([line.tobytes() for line in lines], pa.binary()),
                            pa.array([s.tobytes() for _, s in pairs], pa.binary()),
                        ],
                        ["node", "minima", "hashes"],
                    )

    return source.mapInArrow(run, "node long, minima binary, hashes binary")
