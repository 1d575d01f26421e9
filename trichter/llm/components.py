"""Connected components of a graph of numbered nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trichter.llm.common import drop_written, with_group_min, written


def star_components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) of every node that has an edge.

    Alternates large-star (every node links its larger neighbours to the smallest node it knows)
    and small-star (the same for smaller neighbours and itself) until the edges stay the same; the
    graph is then one star per component. ``edges`` has the long columns ``a`` and ``b``. Every
    round is written to the shared folder, and a node with very many edges is dealt out by salt.
    """
    current = written(_simple(edges.select("a", "b")), "star-edges")
    state = _state(current)
    while state[0]:
        following = written(_small_star(_large_star(current)), "star-edges")
        new_state = _state(following)
        drop_written(current)
        current = following
        if new_state == state:
            break
        state = new_state
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _simple(edges: DataFrame) -> DataFrame:
    """Each edge once, from its larger to its smaller node."""
    larger, smaller = F.greatest("a", "b"), F.least("a", "b")
    return edges.filter("a <> b").select(larger.alias("a"), smaller.alias("b")).distinct()


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row.n, row.x


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    known = with_group_min(both, "a", "b", "least", "b")
    return known.filter("b > a").select(F.col("b").alias("a"), F.least("a", "least").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    known = with_group_min(_simple(edges), "a", "b", "least", "b")
    ends = F.explode(F.array("a", "b")).alias("a")
    return known.select(ends, F.col("least").alias("b")).filter("a <> b").distinct()


def union_find(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) of every node that has an edge.

    Distributed union-find: every root is hooked to the smallest root it shares an edge with,
    paths are halved until all nodes point to a root, and the edges are contracted to edges
    between roots, until none is left. Joins read written tables on both sides, so adaptive
    execution can split a root with very many nodes.
    """
    rest = written(_simple(edges.select("a", "b")), "union-edges")
    nodes = rest.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    parents = written(nodes.withColumn("component", F.col("node")), "union-parents")
    while not rest.isEmpty():
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root"))
        roots = _flattened(written(hooks, "union-hooks"))
        moved = parents.join(roots.withColumnRenamed("node", "component"), "component", "left")
        following = written(moved.select("node", F.coalesce("root", "component").alias("component")), "union-parents")
        root_of_a = roots.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
        root_of_b = roots.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
        contracted = rest.join(root_of_a, "a").join(root_of_b, "b").select(
            F.col("root_a").alias("a"), F.col("root_b").alias("b")
        )
        shrunk = written(_simple(contracted), "union-edges")
        for old in (rest, parents, roots):
            drop_written(old)
        rest, parents = shrunk, following
    return parents


def _flattened(hooks: DataFrame) -> DataFrame:
    """Pointer jumping: ``node, root`` with every root pointing to itself. A parent is always smaller."""
    current = hooks
    while True:
        above = current.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = current.join(above, "root", "left")
        following = written(
            jumped.select("node", F.coalesce("above", "root").alias("root"), (F.col("above") < F.col("root")).alias("moved")),
            "union-hooks",
        )
        drop_written(current)
        current = following.select("node", "root")
        if following.filter("moved").isEmpty():
            return current
