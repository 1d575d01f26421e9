"""Fuzzy line deduplication by MinHash over character shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StringType, StructField, StructType

from trichter.llm.banding import linked_components
from trichter.llm.common import drop_written, free_shuffles, joined_by_frequency, written
from trichter.llm.components import union_find

BANDS, ROWS = 16, 4
SHINGLE = 8
_CHUNK_CHARS = 80_000
_SEEN_LINES = 200_000
_OUTER = " \t\r"


def dedup_lines(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: int = 75,
    drop_emptied: bool = False,
) -> DataFrame:
    """Documents without the lines that repeat a line before them, exactly or nearly.

    Lines end at line feeds; blanks, tabs and carriage returns around a line do not count. A
    line's set holds its distinct shingles of eight characters (the whole line if it is shorter),
    and two lines are alike at a Jaccard similarity of ``similarity`` per cent. 64 minima in 16
    bands of four put two lines of 75 % into a common bucket with a chance of 0.998 and two of
    85 % with 0.99999; every link is confirmed on the full sets. Components come from a
    distributed union-find, and of each the line that comes first (by id, line number, text)
    stays. Lines of blanks are neither dropped nor counted.

    Returns the columns of ``docs`` with the new text and three more, ``lines``, ``kept_lines``
    and ``dropped`` (numbers of the lines dropped, from 0). Input columns of these names are
    replaced. Null texts stay null with no line. Rows with a null id come after all others. Rows
    that agree in id and text are one document: what is dropped from one is dropped from all.
    With ``drop_emptied`` documents that have lost all of their lines go. An empty table stays
    empty. Documents and lines are known by 128 bits of two hashes. Where different lines agree in
    the first 64 bits, only one of them takes part in the search for similar lines (of 10**12 lines
    about one in 10**7); all are compared for equality. Other columns may have any name.
    """
    docs = docs.drop("lines", "kept_lines", "dropped")
    keyed = docs.select(F.struct("*").alias("row"), docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    keyed = keyed.withColumns({"key": F.xxhash64(F.col("id").cast("string"), "text"), "key2": F.xxhash64(F.lit(1), F.col("id").cast("string"), "text")})
    every = _numbered(keyed.select("id", "key", "key2", "text").filter("text IS NOT NULL"))
    every = every.withColumns(dict(zip(("node", "check"), _line_digest("line"))))
    spots = written(every.drop("line"), "line-places")

    counts = spots.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("check").alias("least"), F.max("check").alias("most"))
    repeated = written(counts.filter("n > 1").select("node", "least", "most"), "line-repeats")
    # Of different lines that share a node, one (the least check) takes part in the search.
    searched = spots.filter("buckets IS NOT NULL")
    shared = repeated.filter("least < most").select("node", "least")
    if not shared.isEmpty():
        searched = searched.join(shared, "node", "left").filter("least IS NULL OR least = check")
    labels = similar_lines(searched, keyed.select("key", "key2", "text"), similarity)

    # Only lines that repeat or are like another one can go: a group is a component, or a line that was not searched.
    involved = repeated.select("node", "least").join(labels, "node", "full").withColumn("component", F.coalesce("component", "node"))
    led = F.col("least").isNull() | (F.col("least") == F.col("check"))
    place = F.struct(F.col("id").isNull().alias("last"), "id", "n", "key", "key2").alias("place")
    group = [F.when(led, F.col("component")).otherwise(F.col("node")).alias("component"), F.when(led, 0).otherwise(F.col("check")).alias("other")]
    hits = written(spots.join(involved, "node").select(place, *group, led.alias("led")), "line-hits")
    counted = written(spots.groupBy("key", "key2").agg(F.max("lines").alias("lines")), "line-counts")
    for table in (spots, repeated):
        drop_written(table)
    free_shuffles(docs.sparkSession)
    same = ["component", "led", "other"]
    groups = hits.groupBy(*same).agg(F.min("place").alias("least"), F.count(F.lit(1)).alias("size")).filter("size > 1").drop("size")
    repeats = joined_by_frequency(hits, same, written(groups, "line-least")).filter("place <> least").select("place.*")
    drops = repeats.groupBy("key", "key2").agg(F.sort_array(F.collect_set("n")).alias("gone"))

    changes = written(counted.join(drops, ["key", "key2"], "left"), "line-changes")
    met = keyed.select("row", "key", "key2").join(changes.hint("shuffle_hash"), ["key", "key2"], "left").withColumn("text", F.col("row")[text_col].cast("string"))
    none = F.array().cast("array<int>")
    rest = F.when(F.col("gone").isNull(), F.col("text")).otherwise(_without(F.when(F.col("gone").isNotNull(), F.col("text")), F.col("gone")))
    lines = F.coalesce("lines", F.lit(0))
    dropped = F.coalesce("gone", none)
    columns = [rest.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    cleaned = met.select(*columns, lines.alias("lines"), (lines - F.size(dropped)).alias("kept_lines"), dropped.alias("dropped"))
    return cleaned.filter("kept_lines > 0 OR lines = 0") if drop_emptied else cleaned


def _line_digest(line: str) -> tuple[Column, Column]:
    """The node of a line, and 64 more bits that tell lines of one node apart."""
    return F.xxhash64(line), F.xxhash64(F.lit(1), line)


@F.pandas_udf(StringType())
def _without(texts: pd.Series, dropped: pd.Series) -> pd.Series:
    """The lines whose numbers are not listed."""

    def rest(text: str | None, gone: list[int] | None) -> str | None:
        if text is None:
            return None
        numbers = set(gone)
        return "\n".join(line for n, line in enumerate(text.split("\n")) if n not in numbers)

    return pd.Series([rest(text, gone) for text, gone in zip(texts, dropped)])


def similar_lines(searched: DataFrame, texts: DataFrame, similarity: int) -> DataFrame:
    """``node, component`` of the lines that are like a different one.

    ``searched`` has ``key, key2, n, node, buckets``, a line more than once perhaps, and ``texts`` the text of each key.
    """

    def describe(wanted: DataFrame) -> DataFrame:
        # Of each line one place is looked up, and a document is met once for all of its lines.
        spots = searched.join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.struct("key", "key2", "n")).alias("at"))
        asked = spots.groupBy("at.key", "at.key2").agg(F.collect_list(F.struct("at.n", "node")).alias("asked"))
        return texts.join(asked.hint("shuffle_hash"), ["key", "key2"]).select("text", "asked").mapInArrow(_describe, "node long, minima binary, hashes binary")

    return linked_components(
        searched, describe, union_find, similarity=similarity, minima=BANDS * ROWS, numbers=_line_sets, small=True
    )


def _portions(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows that end in a line, in portions of bounded length."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= _CHUNK_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _numbered(texts: DataFrame) -> DataFrame:
    """``id, key, key2, lines, n, line, buckets`` of all lines that are not blank, with how many the document has.

    Where a task meets a line again, its buckets are null.
    """
    fields = [*texts.select("id", "key", "key2").schema, StructField("lines", IntegerType()), StructField("n", IntegerType()), StructField("line", StringType()), StructField("buckets", BinaryType())]

    def lines_of(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, str]]:
        for row, text in enumerate(batch.column("text")):
            lines = [(n, line) for n, line in enumerate(x.strip(_OUTER) for x in text.as_py().split("\n")) if line]
            yield from ((row, len(lines), n, line) for n, line in lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = LineHash()
        seen: set[int] = set()
        for batch in batches:
            for held in _portions(lines_of(batch)):
                rows, counts, numbers, lines = zip(*held)
                if len(seen) >= _SEEN_LINES:
                    seen.clear()
                found: dict[int, int] = {}
                for at, line in enumerate(lines):
                    if (digest := xxhash.xxh3_64_intdigest(line)) not in seen:
                        found.setdefault(digest, at)
                seen.update(found)
                buckets: list[bytes | None] = [None] * len(lines)
                if found:
                    for at, numbered in zip(found.values(), minhash.bands(minhash.minima([lines[at] for at in found.values()]))):
                        buckets[at] = numbered.tobytes()
                taken = pa.array(rows, pa.int32())
                columns = [batch.column(c).take(taken) for c in ("id", "key", "key2")]
                columns += [pa.array(counts, pa.int32()), pa.array(numbers, pa.int32()), pa.array(lines, pa.string()), pa.array(buckets, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return texts.mapInArrow(run, StructType(fields))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    minhash = LineHash()
    seen: set[int] = set()

    def lines_of(batch: pa.RecordBatch) -> Iterator[tuple[int, str]]:
        for text, asked in zip(batch.column("text"), batch.column("asked")):
            lines = text.as_py().split("\n")
            for wanted in asked.as_py():
                if wanted["node"] not in seen:
                    seen.add(wanted["node"])
                    yield wanted["node"], lines[wanted["n"]].strip(_OUTER)
            if len(seen) >= _SEEN_LINES:
                seen.clear()

    for batch in batches:
        for held in _portions(lines_of(batch)):
            nodes, lines = zip(*held)
            minima = minhash.bytes_of(minhash.minima(lines))
            columns = [pa.array(nodes, pa.int64()), pa.array([m.tobytes() for m in minima], pa.binary()), pa.array([x.encode() for x in lines], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["node", "minima", "hashes"])


def _line_sets(payloads: list[pa.Buffer]) -> list[np.ndarray]:
    """The hashes of the lines' shingles, from the lines."""
    if not payloads:
        return []
    hashes, starts = _shingles([payload.to_pybytes().decode() for payload in payloads])
    sizes = np.diff(np.append(starts, len(hashes)))
    by_line = np.repeat(np.arange(len(payloads), dtype=np.uint64) << np.uint64(32), sizes) | hashes
    by_line.sort()
    by_line = by_line[np.append(True, by_line[1:] != by_line[:-1])]
    ends = np.searchsorted(by_line, np.arange(1, len(payloads), dtype=np.uint64) << np.uint64(32))
    return np.split(by_line.astype(np.uint32), ends)


def _shingles(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all shingles of the lines, with the place where those of each line start."""
    padded = [line if len(line) >= SHINGLE else line.ljust(SHINGLE, "\0") for line in lines]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    hashes = _rolled(codes)
    sizes = np.array([len(line) for line in padded])
    starts = np.cumsum(sizes) - sizes
    # Shingles that reach into the next line are left out.
    own = np.ones(len(codes), bool)
    for back in range(1, SHINGLE):
        own[starts + sizes - back] = False
    return hashes[own[: len(hashes)]], starts - np.arange(len(padded)) * (SHINGLE - 1)


_BASE = [np.uint32(f) for f in (0x01000193, 0x85EBCA6B, 0xC2B2AE35)]


def _rolled(codes: np.ndarray) -> np.ndarray:
    """A hash of the eight characters from each place on, by doubling the width three times."""
    hashes = codes
    for factor, width in zip(_BASE, (1, 2, 4)):
        hashes = hashes[:-width] * factor + hashes[width:]
        hashes ^= hashes >> np.uint32(15)
    return hashes * np.uint32(0x2C1B3C6D)


class LineHash:
    """Minima of ``a * x + b`` modulo 2**32 over the shingle hashes of lines."""

    def __init__(self) -> None:
        rng = np.random.default_rng(31)
        self._a = rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self._b = rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
        self._mix = rng.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def minima(self, lines: list[str]) -> np.ndarray:
        """One row per line."""
        hashes, starts = _shingles(lines)
        found = np.empty((len(self._a), len(lines)), np.uint32)
        buffer = np.empty_like(hashes)
        for n, (a, b) in enumerate(zip(self._a, self._b)):
            np.multiply(hashes, a, out=buffer)
            np.add(buffer, b, out=buffer)
            found[n] = np.minimum.reduceat(buffer, starts)
        return found.T

    def bands(self, minima: np.ndarray) -> np.ndarray:
        groups = (minima.reshape(len(minima), BANDS, ROWS).astype(np.uint64) * self._mix).sum(2, dtype=np.uint64)
        groups += np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        groups = (groups ^ (groups >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (groups ^ (groups >> np.uint64(32))).view(np.int64)

    def bytes_of(self, minima: np.ndarray) -> np.ndarray:
        mixed = minima * np.uint32(0x9E3779B1)
        return (mixed >> np.uint32(24)).astype(np.uint8)
