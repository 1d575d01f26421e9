"""Links between sets that share a MinHash bucket, confirmed on the full sets, and their components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trichter.llm.common import drop_written, free_shuffles, written

Numbers = Callable[[list[pa.Buffer]], list[np.ndarray]]


def stored_numbers(payloads: list[pa.Buffer]) -> list[np.ndarray]:
    """Full sets that are kept as their numbers of 64 bits."""
    return [np.frombuffer(payload, np.uint64) for payload in payloads]


_BLOCK, _BLOCK_BYTES = 256, 4_000_000
_PAIRS_A_SHARE = 2000
_SCREEN = 64  # minima that blocks carry
_HELD_COMPONENTS = 500_000
_HELD_ENTRIES, _SLICE_ENTRIES = 800_000, 500_000
_EMITTED = 100_000
_CELLS = 8_000_000
_AT_ONCE = 1000  # sets that are read together

_DEALT = "slice int, buckets binary, nodes binary, hubs binary"


def _shared(signed: DataFrame) -> DataFrame:
    """``bucket, node, hub`` of the members of buckets with several nodes, from ``node, buckets`` (packed numbers).

    Entries travel packed, a row per task and slice of the bucket numbers. Of the nodes that share a
    bucket in a task only the two smallest travel to the bucket's slice; the others name the smallest as
    their hub and are dealt out by node. So a slice meets two entries of a bucket per task, however many
    nodes the bucket has.
    """
    entries = signed.agg(F.sum(F.octet_length("buckets"))).first()[0] or 0
    slices = max(1, -(-entries // (8 * _SLICE_ENTRIES)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            lists = batch.column("buckets").to_pylist()
            buckets = np.frombuffer(b"".join(lists), np.int64)
            nodes = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), [len(x) // 8 for x in lists])
            held.append((buckets, nodes))
            size += len(buckets)
            if size >= _HELD_ENTRIES:
                yield from _dealt(*map(np.concatenate, zip(*held)), slices)
                held, size = [], 0
        if size:
            yield from _dealt(*map(np.concatenate, zip(*held)), slices)

    dealt = signed.select("node", "buckets").mapInArrow(deal, _DEALT).repartition(slices, "slice")
    return dealt.mapInArrow(_met_buckets, "bucket long, node long, hub long")


def _dealt(buckets: np.ndarray, nodes: np.ndarray, slices: int) -> Iterator[pa.RecordBatch]:
    alone, (buckets, nodes) = _parted(buckets, nodes)
    buckets, nodes, rank, hubs, _ = _ranked(buckets, nodes)
    near, apart = rank < 2, rank > 1
    for met in (alone, (buckets[near], nodes[near])):
        if len(met[0]):
            yield _packed(_slice_of(met[0], slices), *met)
    if apart.any():
        by = _slice_of(nodes[apart] * np.int64(-7046029254386353131), slices)
        order = np.argsort(by, kind="stable")
        yield _packed(by[order], buckets[apart][order], nodes[apart][order], hubs[apart][order])


def _slice_of(numbers: np.ndarray, slices: int) -> np.ndarray:
    """The number's part of the range of 64 bits, of ``slices`` equal ones."""
    return (((numbers >> np.int64(32)) + np.int64(1 << 31)) * np.int64(slices)) >> np.int64(32)


def _packed(by: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    starts = np.flatnonzero(np.append(True, by[1:] != by[:-1]))
    spans = [*zip(starts.tolist(), [*starts[1:].tolist(), len(by)])]
    packed = [pa.array([c[a:b].tobytes() for a, b in spans], pa.binary()) for c in columns]
    packed += [pa.nulls(len(spans), pa.binary())] * (3 - len(packed))
    return pa.RecordBatch.from_arrays([pa.array(by[starts], pa.int32()), *packed], ["slice", "buckets", "nodes", "hubs"])


def _parted(buckets: np.ndarray, nodes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The pairs by bucket: first those of buckets that come once, then the others."""
    order = np.argsort(buckets)
    buckets, nodes = buckets[order], nodes[order]
    once = np.ones(len(buckets), bool)
    once[1:] &= buckets[1:] != buckets[:-1]
    once[:-1] &= buckets[1:] != buckets[:-1]
    return [(buckets[some], nodes[some]) for some in (once, ~once)]


def _ranked(buckets: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs by bucket and node, with the rank in the bucket, its smallest node and its size."""
    order = np.lexsort((nodes, buckets))
    buckets, nodes = buckets[order], nodes[order]
    new = np.ones(len(buckets), bool)
    new[1:] = (buckets[1:] != buckets[:-1]) | (nodes[1:] != nodes[:-1])
    buckets, nodes = buckets[new], nodes[new]
    at = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1])[: len(buckets)])
    sizes = np.diff(np.append(at, len(buckets)))
    return buckets, nodes, np.arange(len(buckets)) - np.repeat(at, sizes), np.repeat(nodes[at], sizes), np.repeat(sizes, sizes)


def _met_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of shared buckets, from the packed entries of some slices."""
    meeting, apart = [], []
    for batch in batches:
        for buckets, nodes, hubs in zip(batch.column("buckets"), batch.column("nodes"), batch.column("hubs")):
            numbers = [np.frombuffer(x.as_buffer(), np.int64) for x in (buckets, nodes, hubs) if x.is_valid]
            (meeting if len(numbers) == 2 else apart).append(numbers)
    if meeting:
        _, several = _parted(*map(np.concatenate, zip(*meeting)))
        buckets, nodes, _, hubs, sizes = _ranked(*several)
        yield from _emitted(*(x[sizes > 1] for x in (buckets, nodes, hubs)))
    if apart:
        buckets, nodes, hubs = map(np.concatenate, zip(*apart))
        order = np.lexsort((hubs, nodes, buckets))
        buckets, nodes, hubs = buckets[order], nodes[order], hubs[order]
        new = np.append(True, (buckets[1:] != buckets[:-1]) | (nodes[1:] != nodes[:-1]))
        yield from _emitted(buckets[new], nodes[new], hubs[new])


def _emitted(*columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    for start in range(0, len(columns[0]), _EMITTED):
        part = [pa.array(c[start : start + _EMITTED]) for c in columns]
        yield pa.RecordBatch.from_arrays(part, ["bucket", "node", "hub"])


def linked_components(
    signed: DataFrame,
    describe: Callable[[DataFrame], DataFrame],
    components_of: Callable[[DataFrame], DataFrame],
    *,
    similarity: int,
    minima: int,
    numbers: Numbers = stored_numbers,
    small: bool = False,
) -> DataFrame:
    """``node, component`` of all nodes linked by a Jaccard similarity of ``similarity`` per cent.

    ``signed`` has ``node, buckets``: the numbers of the node's buckets, 64 bits each, packed; a node may
    come more than once. ``describe`` gets the nodes of buckets with several members and returns
    ``node, minima, hashes``: a byte of each of the ``minima`` minima, and what ``numbers`` turns into the
    full set as sorted unsigned numbers; a node may come more than once. ``small`` tells that this is
    hardly larger than the minima, so that both travel together. Every node first meets the smallest hub of its buckets, then, in each bucket that holds another
    component, one node of that; those still in different components meet one another, in blocks.
    So a group of many copies costs a few comparisons per member, and no link that joins two
    components is missed. Every link is confirmed on the full sets.
    """
    spark = signed.sparkSession
    members = written(_shared(signed), "buckets")
    free_shuffles(spark)
    sets = written(describe(members.select("node").distinct()), "sets")
    free_shuffles(spark)

    hubs = members.filter("node <> hub").groupBy("node").agg(F.min("hub").alias("a"))
    tried = _confirmed(hubs.select("a", F.col("node").alias("b")), sets, similarity, minima, numbers, small)
    components = components_of(tried.filter("linked").select("a", "b"))

    mixed = _mixed_buckets(members, components)
    pair = F.struct(F.least("far_node", "node").alias("a"), F.greatest("far_node", "node").alias("b")).alias("pair")
    far = mixed.filter("component <> far_component").select(pair).select("pair.*").distinct()
    found = _confirmed(far.join(tried.select("a", "b"), ["a", "b"], "left_anti"), sets, similarity, minima, numbers, small)
    following = _joined(components, found, components_of)
    for table in (mixed, tried, found):
        drop_written(table)

    mixed = _mixed_buckets(members, following)
    drop_written(members)
    free_shuffles(spark)
    links = _across(mixed, sets, similarity, minima, numbers)
    components = _joined(following, links, components_of)
    for table in (mixed, links, sets):
        drop_written(table)
    return components


def _joined(components: DataFrame, found: DataFrame, components_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Components with further links: the nodes of each, as a star, and the new links."""
    links = found.filter("linked").select("a", "b")
    if links.isEmpty():
        return components
    return components_of(components.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))


def _mixed_buckets(members: DataFrame, components: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one component, with one node of the bucket's last component.

    Both sides of the joins are read from written tables, so adaptive execution can split a bucket of very many members.
    """
    known = members.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    known = written(known.select("bucket", "node", "component"), "known")
    far = F.max("component").alias("far_component"), F.max_by("node", "component").alias("far_node")
    mixed = (
        known.groupBy("bucket")
        .agg(F.min("component").alias("near_component"), *far, F.count(F.lit(1)).alias("size"))
        .filter("near_component < far_component")
        .drop("near_component")
    )
    found = known.join(written(mixed, "mixed-buckets"), "bucket")
    found = written(found.select("bucket", "node", "size", "component", "far_component", "far_node"), "mixed")
    drop_written(known)
    return found


def _least_equal(similarity: int, minima: int) -> int:
    """How many minima of two signatures agree at least: five standard deviations below the mean."""
    p = similarity / 100
    return int(minima * p - 5 * (minima * p * (1 - p)) ** 0.5)


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: int, minima: int, numbers: Numbers, small: bool) -> DataFrame:
    """``a, b, linked`` of the pairs, or, unless ``small``, of those whose signatures agree often enough; written."""
    asked = written(pairs, "asked")
    if small:
        found = written(_confirm(asked, sets, similarity, numbers, minima), "pairs")
        drop_written(asked)
        return found
    screened = written(_screen(asked, sets, similarity, minima), "screened")
    drop_written(asked)
    found = written(_confirm(screened, sets, similarity, numbers), "pairs")
    drop_written(screened)
    return found


def _with_both(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """Pairs with columns of both sets, ``one_...`` and ``two_...``. A side ``a`` of many pairs is dealt out by their number."""
    shares = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / _PAIRS_A_SHARE).cast("int").alias("shares"))
    left = sets.join(shares.withColumnRenamed("a", "node"), "node").select(
        F.col("node").alias("a"), *(F.col(c).alias(f"one_{c}") for c in columns), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("salt")
    )
    right = sets.select(F.col("node").alias("b"), *(F.col(c).alias(f"two_{c}") for c in columns))
    dealt = pairs.join(shares, "a").withColumn("salt", F.pmod(F.xxhash64(F.lit(5), "b"), F.col("shares")).cast("int"))
    return dealt.join(right, "b").join(left, ["a", "salt"]).drop("shares", "salt")


def _agreeing(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """How many minima agree in each row."""
    return (_bytes(batch.column("one_minima"), width) == _bytes(batch.column("two_minima"), width)).sum(1)


def _screen(pairs: DataFrame, sets: DataFrame, similarity: int, width: int) -> DataFrame:
    """Pairs whose signatures agree often enough."""
    least = _least_equal(similarity, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.select(["a", "b"]).filter(pa.array(_agreeing(batch, width) >= least))

    return _with_both(pairs, sets, "minima").select("a", "b", "one_minima", "two_minima").mapInArrow(run, "a long, b long")


def _confirm(pairs: DataFrame, sets: DataFrame, similarity: int, numbers: Numbers, screened: int = 0) -> DataFrame:
    """``a, b, linked``: the similarity of the full sets reaches the bound. With ``screened`` minima these are compared first."""
    least = _least_equal(similarity, screened) if screened else 0
    both = _with_both(pairs, sets, "hashes", *(["minima"] if screened else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fit = _agreeing(batch, screened) >= least if screened and batch.num_rows else np.ones(batch.num_rows, bool)
            linked, rows = fit.copy(), np.flatnonzero(fit).tolist()
            one, two = batch.column("one_hashes"), batch.column("two_hashes")
            for start in range(0, len(rows), _AT_ONCE):
                part = rows[start : start + _AT_ONCE]
                sets = numbers([side[row].as_buffer() for side in (one, two) for row in part])
                linked[part] = [_alike(x, y, similarity) for x, y in zip(sets, sets[len(part) :])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"]
            )

    found = both.mapInArrow(run, "a long, b long, linked boolean")
    return found.groupBy("a", "b").agg(F.max("linked").alias("linked"))


def _sizes_fit(n: int, m: int, similarity: int) -> bool:
    return 100 * min(n, m) >= similarity * max(n, m)


def _across(mixed: DataFrame, sets: DataFrame, similarity: int, width: int, numbers: Numbers) -> DataFrame:
    """``a, b, linked``: links that join the components of mixed buckets, confirmed on the full sets; written.

    Members of a bucket are packed in blocks, and two blocks meet as one row unless both hold the
    same component alone. In a first round blocks carry signatures only, and members go on that
    agree often enough with one of another component. In the second they carry their full sets; a
    task compares the members that it does not yet know to be joined and notes each link it
    confirms in a union-find of its own. So what is emitted grows with the members, and not with
    the pairs. A bucket of two members has been tried before.
    """
    screened = min(width, _SCREEN)
    least = _least_equal(similarity, screened)

    def agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets, nodes, groups = [], [], []
            for row, (left, a, right, b) in _met(batch, screened):
                bucket = batch.column("bucket")[row].as_py()
                fit = left.groups[a][:, None] != right.groups[b][None, :]
                fit &= (left.signs[a][:, None, :] == right.signs[b][None, :, :]).sum(2) >= least
                for side, span, any_ in ((left, a, fit.any(1)), (right, b, fit.any(0))):
                    nodes.append(side.nodes[span][any_])
                    groups.append(side.groups[span][any_])
                    buckets.append(np.full(int(any_.sum()), bucket, np.int64))
            columns = [pa.array(np.concatenate(c)) if c else pa.array([], pa.int64()) for c in (buckets, nodes, groups)]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "node", "component"])

    signed = sets.select("node", F.substring("minima", 1, screened).alias("signature"))
    members = mixed.filter("size > 2").select("bucket", "node", "component", F.lit(screened + 24).alias("weight"))
    meetings, used = _meetings(members, signed)
    near = written(meetings.mapInArrow(agreeing, "bucket long, node long, component long").distinct(), "near")
    for table in used:
        drop_written(table)

    def joining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[int, int] = {}

        def root(component: int) -> int:
            while (parent := above.get(component, component)) != component:
                above[component] = above.get(parent, parent)
                component = parent
            return component

        def joined(rows: list[tuple[_Members, _Members, list[list[int]]]]) -> Iterator[list[int]]:
            """Links of some meetings, whose sets are read at once."""
            wanted: dict[int, pa.Buffer] = {}
            for left, right, close in rows:
                for m, n in close:
                    for side, at in ((left, m), (right, n)):
                        if (node := int(side.nodes[at])) not in wanted:
                            wanted[node] = side.payload(at)
            sets = dict(zip(wanted, numbers([*wanted.values()])))
            for left, right, close in rows:
                alike = _alike_pairs([(int(left.nodes[m]), int(right.nodes[n])) for m, n in close], sets, similarity)
                for at, (m, n) in enumerate(close):
                    x, y = root(int(left.groups[m])), root(int(right.groups[n]))
                    if x != y and alike(at):
                        above[max(x, y)] = min(x, y)
                        yield sorted((int(left.nodes[m]), int(right.nodes[n])))

        for batch in batches:
            links, held, size = [], [], 0
            for _, (left, a, right, b) in _met(batch, screened):
                if len(above) > _HELD_COMPONENTS:
                    above.clear()
                equal = (left.signs[a][:, None, :] == right.signs[b][None, :, :]).sum(2)
                equal[left.groups[a][:, None] == right.groups[b][None, :]] = 0
                if left is right:
                    equal = np.triu(equal)
                close = np.argwhere(equal >= least)
                close = (close[np.argsort(-equal[tuple(close.T)], kind="stable")] + (a.start, b.start)).tolist()
                close = [(m, n) for m, n in close if root(int(left.groups[m])) != root(int(right.groups[n]))]
                if close:
                    held.append((left, right, close))
                    size += min(2 * len(close), a.stop - a.start + b.stop - b.start)
                if size >= _AT_ONCE:
                    links += joined(held)
                    held, size = [], 0
            links += joined(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in links], pa.int64()), pa.array([p[1] for p in links], pa.int64())], ["a", "b"]
            )

    members = near.join(sets.select("node", (F.octet_length("hashes") + screened + 24).alias("weight")), "node")
    first = F.substring("minima", 1, screened).alias("signature")
    meetings, used = _meetings(members, sets.select("node", first, F.col("hashes").alias("payload")))
    links = written(meetings.mapInArrow(joining, "a long, b long").withColumn("linked", F.lit(True)), "links")
    for table in (near, *used):
        drop_written(table)
    return links


def _meetings(members: DataFrame, carried: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``bucket, left_members, right_members``: the blocks of each bucket that hold different components.

    ``members`` has ``bucket, node, component, weight`` (bytes), ``carried`` what a node brings along.
    A block is bounded by members and bytes. A component with many members in a bucket has blocks of
    its own, the others share blocks. Blocks are laid out on numbers alone; then each member travels
    once to its block, and only blocks of buckets with several blocks travel on to meet the others.
    Right members are null where a block meets itself. The tables returned next are to be dropped
    when the meetings have been read.
    """
    sizes = members.groupBy("bucket", "component").agg(_blocks(F.col("weight")).alias("own"))
    shares = sizes.groupBy("bucket").agg(
        F.ceil(F.sum(F.when(F.col("own") < 1, F.col("own")).otherwise(0))).alias("pooled"), F.count(F.lit(1)).alias("groups")
    )
    layout = sizes.join(shares.filter("groups > 1"), "bucket")
    spread = F.pmod(F.xxhash64(F.lit(9), "node"), F.greatest(F.ceil("own"), F.lit(1)))
    block = F.when(F.col("own") < 1, F.pmod(F.xxhash64(F.lit(7), "component"), F.greatest("pooled", F.lit(1)))).otherwise(
        F.xxhash64("component", spread)
    )
    placed = members.join(layout, ["bucket", "component"]).select("bucket", "node", "component", block.alias("block"))
    placed = written(placed, "placed")
    ends = placed.groupBy("bucket", "block").agg(F.min("component").alias("first"), F.max("component").alias("last"))
    several = written(ends.groupBy("bucket").agg(F.count(F.lit(1)).alias("blocks")).filter("blocks > 1"), "several")

    def packed(rows: DataFrame) -> DataFrame:
        row = F.struct("node", "component", *(c for c in carried.columns if c != "node"))
        held = F.collect_list(row).alias("members"), F.min("component").alias("first"), F.max("component").alias("last")
        return rows.join(carried, "node").groupBy("bucket", "block").agg(*held)

    own = packed(placed).filter("first < last").select("bucket", F.col("members").alias("left_members"))
    own = own.withColumn("right_members", F.lit(None).cast(own.schema["left_members"].dataType))
    if several.isEmpty():
        return own, [placed, several]
    blocks = written(packed(placed.join(several, "bucket", "left_semi")), "blocks")
    ends = blocks.select("bucket", "block", "first", "last")
    left = ends.select("bucket", F.col("block").alias("one"), F.col("first").alias("first_one"), F.col("last").alias("last_one"))
    right = ends.select("bucket", F.col("block").alias("two"), F.col("first").alias("first_two"), F.col("last").alias("last_two"))
    differ = "one < two AND NOT (first_one = last_one AND first_two = last_two AND first_one = first_two)"
    pairs = left.join(right, "bucket").filter(differ).select("bucket", "one", "two")
    crossed = (
        pairs.join(blocks.select("bucket", F.col("block").alias("one"), F.col("members").alias("left_members")), ["bucket", "one"])
        .join(blocks.select("bucket", F.col("block").alias("two"), F.col("members").alias("right_members")), ["bucket", "two"])
        .select("bucket", "left_members", "right_members")
    )
    return own.unionByName(crossed), [placed, several, blocks]


def _blocks(weight: Column) -> Column:
    """How many blocks the rows of a group fill, as a fraction."""
    return F.greatest(F.count(F.lit(1)) / _BLOCK, F.sum(weight) / _BLOCK_BYTES)


class _Members:
    """One side of the meetings of a batch, as flat arrays with the span of each row."""

    def __init__(self, batch: pa.RecordBatch, name: str, width: int) -> None:
        lists = batch.column(name)
        self._ends = [0, *np.cumsum([n or 0 for n in pc.list_value_length(lists).to_pylist()]).tolist()]
        values = lists.flatten()
        self._values = values
        self.nodes = values.field("node").to_numpy(zero_copy_only=False)
        self.groups = values.field("component").to_numpy(zero_copy_only=False)
        self.signs = _bytes(values.field("signature"), width)

    def span(self, row: int) -> slice:
        return slice(self._ends[row], self._ends[row + 1])

    def payload(self, at: int) -> pa.Buffer:
        return self._values.field("payload")[at].as_buffer()


def _alike_pairs(pairs: list[tuple[int, int]], sets: dict[int, np.ndarray], similarity: int) -> Callable[[int], bool]:
    """Whether the pair of a number is alike. Where many pairs are made of few nodes, all are counted at once."""
    nodes = {node: at for at, node in enumerate(dict.fromkeys(n for pair in pairs for n in pair))}
    if len(pairs) <= 2 * len(nodes):
        return lambda at: _alike(sets[pairs[at][0]], sets[pairs[at][1]], similarity)
    sizes = np.array([len(sets[node]) for node in nodes])
    common = _common([sets[node] for node in nodes], sizes)
    fit = 100 * common >= similarity * (sizes[:, None] + sizes[None, :] - common)
    return lambda at: bool(fit[nodes[pairs[at][0]], nodes[pairs[at][1]]])


def _common(sets: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """How many numbers each two sets have in common: products of their incidence matrix, some columns at a time."""
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.int64)
    step = max(1, _CELLS // len(sets))
    for start in range(0, len(values), step):
        a, b = np.searchsorted(column, (start, start + step))
        part = np.zeros((len(sets), min(step, len(values) - start)), np.float32)
        part[row[a:b], column[a:b] - start] = 1
        common += (part @ part.T).astype(np.int64)
    return common


def _met(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, tuple[_Members, slice, _Members, slice]]]:
    """Both sides of each row; a row without right members meets itself."""
    left, right = _Members(batch, "left_members", width), _Members(batch, "right_members", width)
    itself = pc.is_null(batch.column("right_members")).to_pylist()
    for row in range(batch.num_rows):
        a = left.span(row)
        yield row, ((left, a, left, a) if itself[row] else (left, a, right, right.span(row)))


def _alike(x: np.ndarray, y: np.ndarray, similarity: int) -> bool:
    if not _sizes_fit(len(x), len(y), similarity):
        return False
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= similarity * (len(x) + len(y) - common)
