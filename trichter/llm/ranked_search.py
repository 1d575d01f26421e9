"""Ranked lexical search by hashed max-sketches and exact rescoring."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from trichter.llm.common import drop_written, written

_BLOCK_TERMS = 50_000  # of items searched at once
_SPREAD = 4  # coordinates of a sketch per distinct term, at least
_SATURATED = 255
_FIRST = 32  # documents an item rescores for its threshold
_BROADCAST_KEYS = 100_000
_CHUNK_CELLS = 4_000_000
_SLICE_BYTES = 4_000_000

# Bytes that separate terms become blanks, A-Z become lower case, all others stay.
_TERM_BYTES = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


def search(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    k: int = 10,
) -> DataFrame:
    """The ``k`` documents of highest score for each item.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z in lower
    case. With N documents that have a term, L terms in all, n in a document and a term in df
    documents, the term weighs w = floor(1000 * ln((2N + 2) / (2df + 1))), the document has
    m = 25 + (75 * n * N) div L, and a term that occurs tf times in it has the impact
    (10**9 * tf) div (1000 * tf + 8 * m). A score is the sum of w times impact over the item's terms,
    with repeats; all of it is in whole numbers.

    One pass makes a sketch per document: each distinct term has two coordinates by hash, and a
    coordinate keeps the maximum. It keeps tf, from which the impact follows monotonously for the
    document's m, so sketches do not change when other documents come and N or L move. A sketch has
    four to eight coordinates per distinct term of its document. The items are looked up in batches:
    the lesser of a term's two coordinates bounds its impact, and the weighted sum bounds the score.

    Bounds are visited in descending order in two steps. The documents of the highest 32 bounds of
    an item are scored exactly from their texts, which gives a threshold: the k-th score so far.
    All documents with a bound of at least the threshold of any item are then scored exactly. A
    document left out has a bound, and so a score, below k others; ties at the threshold are kept.

    Returns ``item_id``, ``rank`` (from 1), ``doc_id`` and ``score`` of scores above 0; equal scores
    by ascending id, null ids last. Null and empty texts have no terms: as documents they count
    nowhere, as items they find nothing. Rows that share an id are separate documents (and items);
    repeated rows get a rank each. Other columns are ignored; an empty table on either side gives no
    rows. Items are the stated query set: they reach the driver in blocks of a bounded number of
    terms, and every block is searched in all documents. A task holds one slice of texts or sketches
    and the best of each item; a very long text is a slice of its own.
    """
    spark = docs.sparkSession
    source = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).filter("text IS NOT NULL")
    source = source.select("id", F.col("text").cast("binary").alias("text"), _row_digest().alias("key"))
    asked = items.select(items[item_col].alias("item"), items[item_text_col].cast("string").cast("binary").alias("text"))
    index = written(sketches(source.select("key", "text")), "sketches")
    totals = index.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
    rank, score = StructField("rank", IntegerType()), StructField("score", LongType())
    found = spark.createDataFrame([], StructType([asked.schema["item"], rank, source.schema["id"], score]))
    if totals.n:
        for block in _blocks(asked.filter("text IS NOT NULL").orderBy("item", "text")):
            ranked = _ranked(source, index, block, totals.n, totals.l, k)
            numbered = StructType([StructField("at", LongType()), asked.schema["item"]])
            names = spark.createDataFrame(list(enumerate(block.ids)), numbered)
            found = found.unionByName(ranked.join(F.broadcast(names), "at").select("item", "rank", "id", "score"))
    drop_written(index)
    return found.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def _row_digest() -> Column:
    """128 bits of a row's id and text."""
    named = F.concat(F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit("\n"), F.col("text"))
    return F.unhex(F.md5(named))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


# Items


class Block:
    """Items searched together, as slots: one per distinct term of an item."""

    def __init__(self, items: list[tuple[object, Counter]]) -> None:
        self.ids = [item for item, _ in items]
        slots = [(term, at, repeats) for at, (_, counts) in enumerate(items) for term, repeats in counts.items()]
        self.terms = sorted({term for term, _, _ in slots})
        number = {term: n for n, term in enumerate(self.terms)}
        self.term = np.array([number[term] for term, _, _ in slots], np.int64)
        self.item = np.array([at for _, at, _ in slots], np.int64)
        self.repeats = np.array([repeats for _, _, repeats in slots], np.int64)
        hashes = np.array([xxhash.xxh3_64_intdigest(term) for term in self.terms], np.uint64)[self.term]
        self.low, self.high = (hashes & np.uint64(0xFFFFFFFF)).astype(np.int64), (hashes >> np.uint64(32)).astype(np.int64)
        self.weight = np.zeros(len(slots), np.int64)

    def weigh(self, frequency: dict[int, int], n: int) -> None:
        """Weights by document frequency; a term of no document finds nothing."""
        weights = np.zeros(len(self.terms), np.int64)
        for term, count in frequency.items():
            weights[term] = math.floor(1000 * math.log((2 * n + 2) / (2 * count + 1)))
        self.weight = weights[self.term] * self.repeats


def _blocks(items: DataFrame) -> Iterator[Block]:
    held, size = [], 0
    for row in items.toLocalIterator():
        counts = Counter(terms_of(bytes(row.text)))
        if counts:
            held.append((row.item, counts))
            size += len(counts)
        if size >= _BLOCK_TERMS:
            yield Block(held)
            held, size = [], 0
    if held:
        yield Block(held)


# Passes over texts and sketches


def _text_slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of a batch with about ``_SLICE_BYTES`` of text, one row at least."""
    start, size, texts = 0, 0, []
    for row, text in enumerate(batch.column("text")):
        texts.append(text.as_py())
        size += len(texts[-1])
        if size >= _SLICE_BYTES:
            yield batch.slice(start, row + 1 - start), texts
            start, size, texts = row + 1, 0, []
    if texts:
        yield batch.slice(start), texts


def sketches(source: DataFrame) -> DataFrame:
    """``key, n, sketch`` of the texts with a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _text_slices(batch):
                keys, sizes, found = [], [], []
                for key, text in zip(part.column("key").to_pylist(), texts):
                    words = terms_of(text)
                    if words:
                        keys.append(key)
                        sizes.append(len(words))
                        found.append(sketch(Counter(words)).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(found, pa.binary())], ["key", "n", "sketch"]
                )

    return source.mapInArrow(run, "key binary, n long, sketch binary")


def sketch(counts: Counter) -> np.ndarray:
    """Coordinatewise maxima of the terms' frequencies, at most ``_SATURATED``."""
    width = 1 << (_SPREAD * len(counts) - 1).bit_length()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, counts), np.uint64, len(counts))
    tf = np.minimum(np.fromiter(counts.values(), np.int64, len(counts)), _SATURATED).astype(np.uint8)
    found = np.zeros(width, np.uint8)
    np.maximum.at(found, (hashes & np.uint64(0xFFFFFFFF) & np.uint64(width - 1)).astype(np.int64), tf)
    np.maximum.at(found, ((hashes >> np.uint64(32)) & np.uint64(width - 1)).astype(np.int64), tf)
    return found


def _frequencies(source: DataFrame, terms: list[bytes]) -> dict[int, int]:
    """In how many texts each of the terms occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {term: n for n, term in enumerate(terms)}
        wanted, counts = frozenset(terms), Counter()
        for batch in batches:
            for text in batch.column("text"):
                counts.update(wanted.intersection(terms_of(text.as_py())))
        rows = [(number[term], count) for term, count in counts.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([n for n, _ in rows], pa.int64()), pa.array([c for _, c in rows], pa.int64())], ["term", "docs"]
        )

    counted = source.select("text").mapInArrow(run, "term long, docs long").groupBy("term").agg(F.sum("docs").alias("docs"))
    return {row.term: row.docs for row in counted.collect()}


class Bounds:
    """Upper bounds of scores from sketches."""

    def __init__(self, block: Block, n: int, total: int) -> None:
        used = np.flatnonzero(block.weight)
        self._low, self._high = block.low[used], block.high[used]
        self._item, self._weight = block.item[used], block.weight[used]
        self._items, self._n, self._total = len(block.ids), n, total

    def of(self, batch: pa.RecordBatch) -> Iterator[tuple[list[bytes], np.ndarray]]:
        """Keys and (documents, items) bounds, in portions of documents with sketches of one width."""
        by_width: dict[int, list[int]] = {}
        held = batch.column("sketch")
        for row, width in enumerate(pc.binary_length(held).to_pylist()):
            by_width.setdefault(width, []).append(row)
        keys = batch.column("key").to_pylist()
        spans = np.array([_span(n, self._n, self._total) for n in batch.column("n").to_pylist()], np.int64)
        portion = max(1, _CHUNK_CELLS // max(1, len(self._low), self._items))
        for width, rows in by_width.items():
            for first in range(0, len(rows), portion):
                part = rows[first : first + portion]
                cells = np.frombuffer(b"".join([held[row].as_py() for row in part]), np.uint8).reshape(len(part), width)
                yield [keys[row] for row in part], self._bounds(cells, spans[part])

    def _bounds(self, cells: np.ndarray, spans: np.ndarray) -> np.ndarray:
        mask = cells.shape[1] - 1
        least = np.minimum(cells[:, self._low & mask], cells[:, self._high & mask])
        doc, slot = np.nonzero(least)
        tf = least[doc, slot].astype(np.int64)
        impact = np.where(tf == _SATURATED, 1_000_000, _impact(tf, spans[doc]))
        found = np.zeros(len(cells) * self._items, np.int64)
        np.add.at(found, doc * self._items + self._item[slot], self._weight[slot] * impact)
        return found.reshape(len(cells), self._items)


def _span(n: int, documents: int, total: int) -> int:
    """m of a document with ``n`` terms."""
    return 25 + 75 * n * documents // total


def _impact(tf: np.ndarray, span: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * span)


class Scores:
    """Exact scores of texts."""

    def __init__(self, block: Block, n: int, total: int) -> None:
        self._number = {term: at for at, term in enumerate(block.terms)}
        self._wanted = frozenset(block.terms)
        order = np.argsort(block.term, kind="stable")
        self._item, self._weight = block.item[order], block.weight[order]
        self._start = np.searchsorted(block.term[order], np.arange(len(block.terms) + 1))
        self._items, self._n, self._total = len(block.ids), n, total

    def of(self, text: bytes) -> np.ndarray:
        words = terms_of(text)
        found = np.zeros(self._items, np.int64)
        counts = Counter(filter(self._wanted.__contains__, words))
        if counts:
            tf = np.fromiter(counts.values(), np.int64, len(counts))
            impacts = _impact(tf, np.int64(_span(len(words), self._n, self._total)))
            for term, impact in zip(counts, impacts):
                at = self._number[term]
                slots = slice(self._start[at], self._start[at + 1])
                found[self._item[slots]] += self._weight[slots] * impact  # an item has one slot per term
        return found


class Best:
    """The ``k`` highest values of each item above a floor, by value and then by name."""

    def __init__(self, k: int, floors: np.ndarray) -> None:
        self._k, self.floors = k, floors.astype(np.int64).copy()
        self._held: list[list[tuple]] = [[] for _ in floors]

    def add(self, values: np.ndarray, names: list) -> None:
        if len(values) >= self._k:
            kth = len(values) - self._k
            self.floors = np.maximum(self.floors, np.partition(values, kth, axis=0)[kth])
        for row, item in zip(*map(np.ndarray.tolist, np.nonzero(values >= self.floors))):
            name = names[row]
            held = self._held[item]
            held.append((-int(values[row, item]), name is None, 0 if name is None else name, name))
            if len(held) >= 8 * self._k:
                self._cut(item)

    def _cut(self, item: int) -> None:
        held = heapq.nsmallest(self._k, self._held[item], key=lambda entry: entry[:3])
        self._held[item] = held
        if len(held) == self._k:
            self.floors[item] = max(self.floors[item], -held[-1][0])

    def rows(self) -> Iterator[tuple[int, object, int]]:
        for item in range(len(self._held)):
            self._cut(item)
            for entry in self._held[item]:
                yield item, entry[3], -entry[0]


def _best_rows(best: Best, schema: StructType, kind: pa.DataType) -> pa.RecordBatch:
    rows = list(best.rows())
    columns = [pa.array([r[n] for r in rows], t) for n, t in enumerate((pa.int64(), kind, pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, schema.names)


# Search of one block


def _ranked(source: DataFrame, index: DataFrame, block: Block, n: int, total: int, k: int) -> DataFrame:
    """``at, rank, id, score`` of a block's items (``at`` counts the items), written."""
    block.weigh(_frequencies(source, block.terms), n)
    bounds = Bounds(block, n, total)
    ones = np.ones(len(block.ids), np.int64)
    bound_schema = StructType([StructField("at", LongType()), StructField("key", BinaryType()), StructField("score", LongType())])

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(_FIRST, ones)
        for batch in batches:
            for keys, found in bounds.of(batch):
                best.add(found, keys)
        yield _best_rows(best, bound_schema, pa.binary())

    first = _top(index.mapInArrow(highest, bound_schema), _FIRST, "key").select("key").distinct()
    first = written(first, "search-first")  # at most _FIRST keys per item of the block
    scored = _scored(source.join(F.broadcast(first), "key", "left_semi"), block, n, total, ones, k)
    floors = ones.copy()
    for row in _top(scored, k, "id").groupBy("at").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).collect():
        if row.n == k:
            floors[row["at"]] = row.least

    def reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, found in bounds.of(batch):
                rows = np.flatnonzero((found >= floors).any(1))
                yield pa.RecordBatch.from_arrays([pa.array([keys[row] for row in rows], pa.binary())], ["key"])

    reached = written(index.mapInArrow(reaching, "key binary"), "search-reached")
    if reached.count() <= _BROADCAST_KEYS:
        reached = F.broadcast(reached)
    candidates = source.join(reached, "key", "left_semi")
    return written(_top(_scored(candidates, block, n, total, floors, k), k, "id"), "search-ranked")


def _top(rows: DataFrame, k: int, name: str) -> DataFrame:
    order = Window.partitionBy("at").orderBy(F.col("score").desc(), F.col(name).asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _scored(texts: DataFrame, block: Block, n: int, total: int, floors: np.ndarray, k: int) -> DataFrame:
    """``at, id, score``: the ``k`` highest exact scores per item and task that reach the item's floor."""
    schema = StructType([StructField("at", LongType()), texts.schema["id"], StructField("score", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, best, kind = Scores(block, n, total), Best(k, floors), None
        for batch in batches:
            kind = batch.schema.field("id").type
            for part, slice_ in _text_slices(batch):
                rows = max(1, _CHUNK_CELLS // len(floors))
                names = part.column("id").to_pylist()
                for start in range(0, len(slice_), rows):
                    found = np.stack([scores.of(text) for text in slice_[start : start + rows]])
                    best.add(found, names[start : start + rows])
        if kind is not None:
            yield _best_rows(best, schema, kind)

    return texts.select("id", "text").mapInArrow(run, schema)
