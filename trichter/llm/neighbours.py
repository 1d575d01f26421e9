"""Approximate nearest neighbours with an inverted multi-index."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from trichter.llm.common import hash_sample, written

_QUERY_BLOCK = 64
_VECTOR_BLOCK = 256
_SALTS = 8
_HELD_QUERIES = 20_000


def nearest_neighbours(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 10,
    query_every: int = 100,
    sample_rows: int = 16_384,
    entries_per_cell: int = 64,
    max_centroids: int = 1024,
    tuning_queries: int = 64,
    recall: float = 0.97,
) -> DataFrame:
    """The ``k`` nearest rows found for every row whose id is divisible by ``query_every``.

    Inverted multi-index: k-means learns one codebook per half of the vector from at most
    ``sample_rows`` vectors; every vector is entered under its pair of nearest centroids. A query
    walks the pairs in order of their summed distance with a heap until it has passed enough
    entries, and these are reranked by Euclidean distance in double precision. How many entries
    are enough is measured: the exact neighbours of at most ``tuning_queries`` queries are looked
    up, and the walk goes as far as ``recall`` of them need. So the share of rows that a query
    reads follows from how well the vectors cluster, and recall holds at every size. The number
    of centroids grows with the root of the number of vectors, up to ``max_centroids``.

    Equal vectors are one entry that carries its ``k`` + 1 smallest ids, which is all that any
    result can hold, and equal queries are searched once, so a frequent vector costs no more than
    a rare one. Cells are cut into blocks of bounded size; blocks of queries meet blocks of
    entries by (cell, block), so neither a large cell nor a much-visited one gathers in a task.

    Returns ``query_id, rank, vec_id, score``, nearest first, ties to the smaller id; all
    candidates if there are fewer than ``k``. Rows take no part if the id is null or the vector is
    null, zero, holds null, NaN or infinite components, or differs in length from most vectors.
    Of rows that share an id but not the vector the smallest vector counts. Other columns are
    ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].alias("vector"))
    rows = rows.filter(F.col("vec_id").isNotNull() & _usable(F.col("vector")))
    common = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = common.dim
    rows = rows.filter(F.size("vector") == dim).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    rows = written(rows.withColumn("key", _vector_key(F.col("vector"))), "imi-rows")

    first = Window.partitionBy("key").orderBy("vec_id")
    entries = (
        rows.withColumn("place", F.row_number().over(first))
        .filter(F.col("place") <= k + 1)
        .groupBy("key")
        .agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.min("vector").alias("vector"))
    )
    entries = written(entries, "imi-entries")
    codebooks = _codebooks(entries, dim, sample_rows, entries_per_cell, max_centroids)
    index = written(_with_cell(entries, codebooks), "imi-index")
    counts = {r.cell: r["count"] for r in index.groupBy("cell").count().collect()}  # at most centroids squared

    asked = rows.filter(F.col("vec_id") % query_every == 0)
    queries = asked.groupBy("key").agg(F.min("vector").alias("vector"))
    enough = _entries_needed(index, queries, codebooks, counts, k, tuning_queries, recall)
    found = _rerank(_visits(queries, codebooks, counts, enough), index, counts, dim, k + 1)

    salts = F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))
    results = found.select("key", "vec_id", "score", salts.alias("salt"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        asked.select(F.col("vec_id").alias("query_id"), "key", F.pmod(F.xxhash64("vec_id"), F.lit(_SALTS)).alias("salt"))
        .join(results, ["key", "salt"])
        .filter(F.col("vec_id") != F.col("query_id"))
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def _plus_cell(df: DataFrame) -> StructType:
    return StructType([*df.schema.fields, StructField("cell", LongType())])


def _vector_key(vector: Column) -> Column:
    """128 bits that stand for an exact vector; both zeros count as one."""
    plain = F.transform(vector, lambda x: x + F.lit(0).cast("float"))
    return F.concat(F.hex(F.xxhash64(F.lit(1), plain)), F.lit("-"), F.hex(F.xxhash64(F.lit(2), plain)))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def _kmeans(points: np.ndarray, count: int, rounds: int = 12) -> np.ndarray:
    centres = points[np.random.default_rng(7).permutation(len(points))[:count]].copy()
    for _ in range(rounds):
        nearest = _squared(points, centres).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        sizes = np.bincount(nearest, minlength=len(centres))
        centres[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centres


def _codebooks(entries, dim, sample_rows, entries_per_cell, max_centroids) -> tuple[np.ndarray, np.ndarray]:
    """A codebook per half, from a sample of bounded size taken by the hash in the key."""
    total = entries.count()
    want = 1 << max(0, round(math.log2(max(1.0, math.sqrt(total / entries_per_cell)))))
    rows = hash_sample(entries.select("key", "vector"), F.col("key"), sample_rows, total).collect()
    sample = np.array([r.vector for r in rows], float)
    count = min(want, max_centroids, len(sample))
    half = dim // 2
    return _kmeans(sample[:, :half], count), _kmeans(sample[:, half:], count)


def _halves(points: np.ndarray, codebooks) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of both halves to their centroids."""
    half = codebooks[0].shape[1]
    return _squared(points[:, :half], codebooks[0]), _squared(points[:, half:], codebooks[1])


def _with_cell(entries: DataFrame, codebooks) -> DataFrame:
    dim = codebooks[0].shape[1] + codebooks[1].shape[1]
    width = len(codebooks[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                first, second = _halves(_matrix(part.column("vector"), dim), codebooks)
                cell = first.argmin(1) * width + second.argmin(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell, pa.int64())], [*part.schema.names, "cell"])

    return entries.mapInArrow(run, _plus_cell(entries))


def walk(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of centroids in order of the sum of their distances: the multi-sequence algorithm."""
    rows, columns = first.argsort(kind="stable"), second.argsort(kind="stable")
    a, b = first[rows], second[columns]
    heap = [(a[0] + b[0], 0, 0)]
    reached = np.full(len(a), -1)  # by row: the last column passed
    while heap:
        _, i, j = heapq.heappop(heap)
        yield int(rows[i]), int(columns[j])
        reached[i] = j
        if j + 1 < len(b) and (i == 0 or reached[i - 1] > j):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if i + 1 < len(a) and reached[i + 1] == j - 1:
            heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))


def _visits(queries: DataFrame, codebooks, counts: dict[int, int], enough: int) -> DataFrame:
    """``key, vector, cell`` for every cell that a query visits."""
    dim = codebooks[0].shape[1] + codebooks[1].shape[1]
    width = len(codebooks[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                first, second = _halves(_matrix(part.column("vector"), dim), codebooks)
                taken, cells = [], []
                for q in range(part.num_rows):
                    passed = 0
                    for i, j in walk(first[q], second[q]):
                        cell = i * width + j
                        if cell in counts:
                            taken.append(q)
                            cells.append(cell)
                            passed += counts[cell]
                            if passed >= enough:
                                break
                rows = part.take(pa.array(taken, pa.int64()))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cells, pa.int64())], [*part.schema.names, "cell"])

    return queries.mapInArrow(run, _plus_cell(queries))


def _entries_needed(index, queries, codebooks, counts, k, tuning_queries, recall) -> int:
    """How many entries a walk has to pass so that ``recall`` of the exact neighbours of sampled queries are met."""
    asked = queries.orderBy("key").limit(tuning_queries).collect()
    if not asked:
        return 1
    points = np.array([r.vector for r in asked], float)
    own = [r.key for r in asked]
    dim, width = points.shape[1], len(codebooks[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [[] for _ in own]
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                keys, cells = part.column("key").to_pylist(), part.column("cell").to_numpy()
                distance = _squared(points, _matrix(part.column("vector"), dim))
                for q, line in enumerate(distance):
                    near = np.argpartition(line, min(k, len(line) - 1))[: k + 1]
                    best[q] = heapq.nsmallest(
                        k, best[q] + [(line[v], int(cells[v])) for v in near if keys[v] != own[q]]
                    )
        flat = [(q, d, cell) for q, found in enumerate(best) for d, cell in found]
        if flat:
            q, d, cell = zip(*flat)
            yield pa.RecordBatch.from_arrays(
                [pa.array(q, pa.int64()), pa.array(d, pa.float64()), pa.array(cell, pa.int64())], ["q", "d", "cell"]
            )

    near = index.select("key", "vector", "cell").mapInArrow(run, "q long, d double, cell long")
    nearest = Window.partitionBy("q").orderBy("d")
    exact = near.withColumn("n", F.row_number().over(nearest)).filter(F.col("n") <= k).collect()
    first, second = _halves(points, codebooks)
    needed = []
    for q in range(len(own)):
        passed, at = 0, {}
        for i, j in walk(first[q], second[q]):
            cell = i * width + j
            if cell in counts:
                passed += counts[cell]
                at[cell] = passed
        needed += [at[r.cell] for r in exact if r.q == q]
    needed.sort()
    return needed[min(len(needed) - 1, math.ceil(recall * len(needed)))] if needed else 1


def _rerank(visits: DataFrame, index: DataFrame, counts: dict[int, int], dim: int, keep: int) -> DataFrame:
    """The ``keep`` nearest (distance, id) of every query over the entries of the cells it visits."""
    spark = index.sparkSession
    blocks = {cell: -(-n // _VECTOR_BLOCK) for cell, n in counts.items()}
    table = spark.createDataFrame(list(blocks.items()), "cell long, blocks int")
    entries = (
        index.join(F.broadcast(table), "cell")
        .withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
        .groupBy("cell", "block")
        .agg(F.collect_list("ids").alias("ids"), F.flatten(F.collect_list("vector")).alias("vectors"))
    )
    # A block of queries is cut by the hash of its key; how many blocks a cell needs follows from its visits.
    visits = written(visits, "imi-visits")
    asked = visits.groupBy("cell").count().collect()  # at most centroids squared
    shares = spark.createDataFrame(
        [(r.cell, -(-r["count"] // _QUERY_BLOCK)) for r in asked] or [(-1, 1)], "cell long, shares int"
    )
    questions = (
        visits.join(F.broadcast(shares), "cell")
        .withColumn("share", F.pmod(F.xxhash64("key"), F.col("shares")).cast("int"))
        .groupBy("cell", "share")
        .agg(F.collect_list("key").alias("keys"), F.flatten(F.collect_list("vector")).alias("points"))
        .join(F.broadcast(table), "cell")
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    )
    pairs = questions.join(entries, ["cell", "block"]).select("keys", "points", "ids", "vectors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                keys = batch.column("keys")[row].as_py()
                points = batch.column("points")[row].values.to_numpy().astype(np.float64).reshape(-1, dim)
                vectors = batch.column("vectors")[row].values.to_numpy().astype(np.float64).reshape(-1, dim)
                ids = batch.column("ids")[row].as_py()
                for key, point in zip(keys, points):
                    best[key] = _merged(best.get(key), point, vectors, ids, keep)
                if len(best) >= _HELD_QUERIES:
                    yield _flat(best)
                    best = {}
        if best:
            yield _flat(best)

    near = pairs.mapInArrow(run, "key string, vec_id long, score double")
    order = Window.partitionBy("key").orderBy("score", "vec_id")
    return near.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= keep).drop("n")


def _merged(held, point: np.ndarray, vectors: np.ndarray, ids: list[list[int]], keep: int):
    gap = vectors - point
    distance = np.sqrt((gap * gap).sum(1))
    limit = np.partition(distance, keep - 1)[keep - 1] if len(distance) > keep else np.inf
    if held is not None and len(held[0]) == keep:
        limit = min(limit, held[0][-1])
    near = np.flatnonzero(distance <= limit)
    scores = np.repeat(distance[near], [len(ids[v]) for v in near])
    numbers = np.array([i for v in near for i in ids[v]], dtype=np.int64)
    if held is not None:
        scores, numbers = np.concatenate((held[0], scores)), np.concatenate((held[1], numbers))
    order = np.lexsort((numbers, scores))[:keep]
    return scores[order], numbers[order]


def _flat(best) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([key for key, (scores, _) in best.items() for _ in scores]),
            pa.array(np.concatenate([numbers for _, numbers in best.values()]), pa.int64()),
            pa.array(np.concatenate([scores for scores, _ in best.values()]), pa.float64()),
        ],
        ["key", "vec_id", "score"],
    )
