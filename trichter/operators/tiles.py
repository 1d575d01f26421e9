"""Exact NTILE over all rows without gathering them in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trichter.session import durable

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number below the partition number
_IDLE = ""  # slot of rows that take part in no ranking


def with_ntiles(
    df: DataFrame,
    k: int,
    scores: dict[str, str],
    tie: str,
    by: Sequence[str] = (),
    takes_part: Column | None = None,
) -> DataFrame:
    """Add one ``NTILE(k)`` column per entry of ``scores`` (output name to score column).

    Rows are ranked by (score, ``tie``) ascending within ``by``; (``by``, ``tie``) must be
    unique. Rows where ``takes_part`` is false keep null tiles.

    ``ntile`` over an unpartitioned window would move every row to one task. Here all rankings
    are stacked and range-sorted once. Since the tie-breaker is part of the range key, neither a
    large group nor a frequent score forces rows together. The sorted rows are written to the
    checkpoint folder together with their position, because a recomputed range sort could cut
    its partitions elsewhere. Global ranks then follow from one row count per partition, and
    the stack folds back by key: no row set is ever joined with itself.
    """
    names = list(scores)
    keys = [*by, tie]
    payload_columns = [c for c in df.columns if c not in keys]
    payload = F.struct(*payload_columns)
    empty = F.lit(None).cast(df.select(payload.alias("p")).schema["p"].dataType)

    kinds = {n: df.schema[scores[n]].dataType for n in names}
    ranks = [f"score_{i}" for i in range(len(names))]

    def slot(name: str, carried: Column) -> Column:
        """Each score keeps its type in a field of its own, null in the slots of the others."""
        fields = [
            (F.col(scores[n]) if n == name else F.lit(None)).cast(kinds[n]).alias(field)
            for n, field in zip(names, ranks)
        ]
        return F.struct(F.lit(name).alias("slot"), *fields, carried.alias("payload"))

    ranked = F.array(*[slot(n, payload if n == names[0] else empty) for n in names])
    idle = F.array(slot(_IDLE, payload))
    slots = ranked if takes_part is None else F.when(takes_part, ranked).otherwise(idle)

    group = ["slot", *by]
    order = [*group, *ranks, tie]
    stacked = df.select(*keys, F.inline(slots))
    placed = durable(
        stacked.repartitionByRange(*[F.col(c).asc_nulls_last() for c in order])
        .sortWithinPartitions(*[F.col(c).asc_nulls_last() for c in order])
        .withColumn("place", F.monotonically_increasing_id())
        .withColumn("part", F.shiftright("place", _ROW_BITS))
    )

    # One row per partition and group; its size is bounded by the number of partitions.
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        placed.groupBy(*group, "part")
        .agg(F.count(F.lit(1)).alias("rows"), F.min("place").alias("start"))
        .select(
            *[F.col(c).alias(f"_{c}") for c in [*group, "part"]],
            "start",
            F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"),
            F.sum("rows").over(Window.partitionBy(*group)).alias("total"),
        )
    )
    same = F.lit(True)
    for c in [*group, "part"]:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    index = F.col("place") - F.col("start") + F.col("before")
    tiled = placed.join(counts, same).withColumn("tile", _tile(index, F.col("total"), k))

    folded = tiled.groupBy(*keys).agg(
        F.first("payload", ignorenulls=True).alias("payload"),
        *[F.max(F.when(F.col("slot") == name, F.col("tile"))).alias(name) for name in names],
    )
    return folded.select(
        *[F.col(c) if c in keys else F.col(f"payload.{c}").alias(c) for c in df.columns], *names
    )


def _tile(index: Column, total: Column, k: int) -> Column:
    """Tile of the 0-based ``index`` among ``total`` rows: the first ``total % k`` tiles hold one
    row more than the others."""
    size = F.floor(total / k)
    spare = total % k
    wide_rows = spare * (size + 1)
    wide = F.floor(index / (size + 1)) + 1
    narrow = spare + F.floor((index - wide_rows) / F.nullif(size, F.lit(0))) + 1
    return F.when(index < wide_rows, wide).otherwise(narrow).cast("long")
