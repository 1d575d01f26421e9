"""Product codes of vectors, with codebooks refined under norm-of-sum bounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from trichter.llm.common import drop_written, joined_by_frequency, written

_GROUPS = 16
_ROWS = 2048
_EXACT = 1 << 53  # whole numbers that a double holds


def compress_vectors(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
    scale: int = 1024,
) -> DataFrame:
    """Codes of vectors: the nearest entry of a codebook for each of ``parts`` equal parts.

    Components become whole numbers, floor(``scale`` * x). The codebook of a part starts as that
    part of the ``entries`` vectors of smallest id. Each of ``rounds`` rounds assigns all parts to
    the nearest entry (squared Euclidean distance, ties to the lower index) and replaces each entry
    by the floor of the mean of its parts; an entry without a part stays. A last pass assigns again.

    A part is not compared with all entries in every round. Entries form groups, and a part keeps
    for each group a lower bound of its distance to the group's entries (other than its own) with
    the round the bound was measured in. All earlier codebooks are kept, so in a later round the
    bound falls by the largest true displacement of the group's entries between the two codebooks,
    the norm of the sum of their moves, and not by the sum of the norms of all moves between. Only
    groups whose bound does not exceed the exact distance to the part's own entry are measured
    again. All decisions are exact: distances are whole numbers, and bounds are rounded down.

    A round is one pass over a table of the shared folder that holds vectors and bounds; it writes
    the next one, and partial sums per task that Spark adds up. What reaches the driver is the size
    of the codebooks.

    Returns the id, ``code`` (index of each part in order, two hex digits each), ``error`` (squared
    distances summed over the parts), ``label_error`` (errors summed over equal labels, nulls
    together), ``codebooks_sha256`` (over all final components in decimal by part, entry and place,
    joined by commas) and the label. Rows whose vector is null or holds null or non-finite components
    are left out. Rows that share an id are separate vectors; null ids come last when the first
    entries are chosen, and equal ids by vector. Fewer vectors than ``entries`` give as many
    entries. Other columns are ignored. A table without such a vector gives no rows. Vectors of
    different lengths, of a length that has no such parts, or with components so large that a
    squared distance exceeds 64 bits raise a ValueError.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be between 1 and 256: a code has one byte per part")
    given = vectors.select(
        vectors[id_col].alias("id"), vectors[label_col].alias("label"), vectors[vector_col].cast("array<double>").alias("v")
    )
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    kept = given.filter(F.col("v").isNotNull() & finite).select("id", "label", scaled.alias("v"))
    current = written(kept, "codes-vectors")
    size = current.agg(
        F.min(F.size("v")).alias("least"),
        F.max(F.size("v")).alias("most"),
        F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))).alias("top"),
    ).first()
    if size.most is None:
        return _result(current.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), id_col, "", label_col)
    if size.least != size.most or size.most % parts or not size.most:
        raise ValueError(f"vectors of {size.least} to {size.most} components cannot be cut into {parts} equal parts")
    width = size.most // parts
    top = int(size.top)
    if 4 * (top + 1) ** 2 * size.most >= 1 << 63:
        raise ValueError("components are too large: squared distances exceed 64 bits")

    # The first entries: as many rows as a codebook has, whatever the table's size.
    first = current.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    start = np.array([row.v for row in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
    books = Codebooks(start, exact_in_double=8 * (top + 1) ** 2 * size.most < _EXACT)
    for _ in range(rounds):
        following = written(_assigned(current, books, sums=True), "codes-vectors")
        moved = (
            following.filter("entry IS NOT NULL")
            .select("entry", "n", F.posexplode("v").alias("place", "part_sum"))
            .groupBy("entry", "place")
            .agg(F.sum(F.col("part_sum").cast("decimal(28,0)")).alias("total"), F.sum("n").alias("n"))
        )
        books.move(moved.collect())
        drop_written(current)
        current = following.filter("entry IS NULL")
    last = written(_assigned(current, books, sums=False).select("id", "label", F.lower(F.hex("code")).alias("code"), "error"), "codes")
    drop_written(current)
    return _result(last, id_col, books.digest(), label_col)


def _result(coded: DataFrame, id_col: str, digest: str, label_col: str) -> DataFrame:
    """The label's error joins through its text and a flag for null."""
    keyed = coded.select(
        "*", F.col("label").isNull().alias("no_label"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("key")
    )
    sums = keyed.groupBy("no_label", "key").agg(F.sum("error").alias("label_error"))
    found = joined_by_frequency(keyed, ["no_label", "key"], sums)
    return found.select(
        F.col("id").alias(id_col),
        "code",
        "error",
        "label_error",
        F.lit(digest).alias("codebooks_sha256"),
        F.col("label").alias(label_col),
    )


class Codebooks:
    """The codebooks of all rounds, the groups of their entries, and how far the entries have moved."""

    def __init__(self, start: np.ndarray, exact_in_double: bool) -> None:
        self.history = [start]  # each (parts, entries, width)
        self.kind = np.float64 if exact_in_double else np.int64
        parts, entries, _ = start.shape
        seeds = min(_GROUPS, entries)
        self.group = np.empty((parts, entries), np.int64)
        for p in range(parts):
            self.group[p] = squared(start[p].astype(self.kind), start[p, :seeds].astype(self.kind)).argmin(1)
        self.groups = seeds

    def move(self, rows: list) -> None:
        """The next codebooks from sums of components; ``entry`` counts through the parts."""
        latest = self.history[-1].copy()
        parts, entries, _ = latest.shape
        for row in rows:
            latest[row.entry // entries, row.entry % entries, row.place] = int(row.total) // row.n
        self.history.append(latest)

    def drops(self) -> np.ndarray:
        """(part, round, group): the largest displacement of an entry of the group from a round to the latest."""
        now = self.history[-1]
        parts, entries, _ = now.shape
        found = np.zeros((parts, len(self.history), self.groups))
        for t, then in enumerate(self.history):
            moved = np.sqrt(((now - then).astype(np.float64) ** 2).sum(2)) * (1 + 1e-9)
            for p in range(parts):
                np.maximum.at(found[p, t], self.group[p], moved[p])
        return found

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.history[-1].ravel().tolist())).encode()).hexdigest()


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances, (rows, entries): sums of whole numbers that ``kind`` holds."""
    if x.dtype == np.float64:
        return (x * x).sum(1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(1)
    return np.stack([((x - entry) ** 2).sum(1) for entry in entries], axis=1)


def assign(x: np.ndarray, own: np.ndarray, bound: np.ndarray, stamp: np.ndarray, book: np.ndarray, group: np.ndarray, drops: np.ndarray):
    """The nearest entries of the parts ``x``, and their squared distances.

    ``own`` (the entries so far), ``bound`` (float32, rows x groups) and ``stamp`` (the rounds of
    the bounds) are updated in place; ``drops`` is (round, group).
    """
    now = len(drops) - 1
    if x.dtype == np.float64:
        best = ((x - book[own]) ** 2).sum(1)
    else:
        best = np.array([((a - b) ** 2).sum() for a, b in zip(x, book[own])], x.dtype)
    before, was = own.copy(), best.copy()
    lower = bound.astype(np.float64) - drops[stamp, np.arange(drops.shape[1])]
    open_ = lower <= (np.sqrt(best.astype(np.float64)) * (1 + 1e-9))[:, None]
    measured: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
    for g in range(drops.shape[1]):
        members = np.flatnonzero(group == g)
        at = np.flatnonzero(open_[:, g])
        if not len(at) or not len(members):
            continue
        distance = squared(x[at], book[members])
        nearest = distance.argmin(1)  # the first of equals: members ascend
        least = distance[np.arange(len(at)), nearest]
        entry = members[nearest]
        better = (least < best[at]) | ((least == best[at]) & (entry < own[at]))
        best[at[better]], own[at[better]] = least[better], entry[better]
        measured.append((g, at, members, distance))
    for g, at, members, distance in measured:
        # The bound is over the group without the part's own entry.
        distance = np.where(members[None, :] == own[at][:, None], np.inf, distance.astype(np.float64))
        bound[at, g] = np.nextafter(np.sqrt(distance.min(1)).astype(np.float32), np.float32(-np.inf))
        stamp[at, g] = now
    # An entry left behind counts in its group's bound, whether that was measured or not.
    left = np.flatnonzero(own != before)
    behind = group[before[left]]
    stale = stamp[left, behind] != now
    kept = np.where(stale, lower[left, behind], bound[left, behind].astype(np.float64))
    least = np.minimum(kept, np.sqrt(was[left].astype(np.float64)))
    bound[left, behind] = np.nextafter(least.astype(np.float32), np.float32(-np.inf))
    stamp[left, behind] = now
    return best


def _assigned(table: DataFrame, books: Codebooks, sums: bool) -> DataFrame:
    """The table with new codes, bounds and errors; with ``sums`` also rows of partial sums (``entry`` not null) per task."""
    for name in ("code", "bound", "stamp"):
        if name not in table.columns:
            table = table.withColumn(name, F.lit(None).cast("binary"))
    schema = StructType(
        [
            *(table.schema[name] for name in ("id", "label", "v", "code", "bound", "stamp")),
            StructField("error", LongType()),
            StructField("entry", LongType()),
            StructField("n", LongType()),
        ]
    )
    drops = books.drops()
    exact = books.history[-1]
    parts, entries, width = exact.shape
    groups = books.groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = exact.astype(books.kind)
        total = np.zeros((parts * entries, width), np.int64)
        count = np.zeros(parts * entries, np.int64)
        kinds = None
        for whole in batches:
            kinds = whole.schema.field("id").type, whole.schema.field("label").type
            for first in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(first, _ROWS)
                n = batch.num_rows
                x = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, parts, width)
                code = _numbers(batch.column("code"), np.uint8, (n, parts))
                bound = _numbers(batch.column("bound"), np.float32, (n, parts, groups))
                stamp = _numbers(batch.column("stamp"), np.uint8, (n, parts, groups))
                error = np.zeros(n, np.int64)
                for p in range(parts):
                    own, b, s = code[:, p].astype(np.int64), bound[:, p].copy(), stamp[:, p].copy()
                    best = assign(x[:, p].astype(books.kind), own, b, s, book[p], books.group[p], drops[p])
                    code[:, p], bound[:, p], stamp[:, p] = own, b, s
                    error += best.astype(np.int64)
                    if sums:
                        np.add.at(total, p * entries + own, x[:, p])
                        count += np.bincount(p * entries + own, minlength=parts * entries)
                yield _batch(
                    [
                        batch.column("id"), batch.column("label"), batch.column("v"), _bytes(code), _bytes(bound), _bytes(stamp),
                        pa.array(error), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()),
                    ],
                    schema.names,
                )
        used = np.flatnonzero(count)
        if sums and len(used):
            lists = pa.ListArray.from_arrays(np.arange(len(used) + 1, dtype=np.int32) * width, total[used].ravel())
            nothing = pa.nulls(len(used), pa.binary())
            yield _batch(
                [
                    pa.nulls(len(used), kinds[0]), pa.nulls(len(used), kinds[1]), lists, nothing, nothing, nothing,
                    pa.nulls(len(used), pa.int64()), pa.array(used), pa.array(count[used]),
                ],
                schema.names,
            )

    return table.select(*schema.names[:6]).mapInArrow(run, schema)


def _batch(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names)


def _numbers(column: pa.Array, kind: type, shape: tuple[int, ...]) -> np.ndarray:
    """The state of a batch, zero before the first round."""
    if column.null_count:
        return np.zeros(shape, kind)
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(shape).copy()


def _bytes(values: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in values], pa.binary())
