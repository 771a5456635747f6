"""Ordinals over a total order, without a window over one partition.

The rows are dealt by ranges of the order, sorted inside each partition and
numbered there; the sizes of the partitions, one number each, give where every
partition starts.  ``row_number() over (order by ...)`` would read all rows in
a single task.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.shared import cut

_LOCAL_BITS = 33  # of monotonically_increasing_id

#: Up to so many keys are broadcast; sizes of files do not tell, as sorted numbers compress to next to nothing.
FEW_KEYS = 100_000


def with_ordinal(df: DataFrame, *order: str | Column, name: str = "idx") -> DataFrame:
    """``df`` with the 0-based position of each row in ``order`` as a long column.

    The order should be total: ties get neighbouring numbers in no defined order.
    """
    marked = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    fixed = cut(marked)
    part = F.shiftright("_id", _LOCAL_BITS)
    sizes = sorted((r[0], r[1]) for r in fixed.groupBy(part.alias("p")).count().collect())  # one row a partition
    starts = dict(zip((p for p, _ in sizes), accumulate((n for _, n in sizes), initial=0), strict=False))
    start = F.get(F.lit([starts.get(p, 0) for p in range(max(starts, default=-1) + 1)] or [0]).cast("array<bigint>"), part.cast("int"))
    return fixed.withColumn(name, start + F.col("_id").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))).drop("_id")


def with_rank_in(df: DataFrame, key: str, *order: str, name: str = "rank") -> DataFrame:
    """``df`` with the 0-based position of each row among those of its ``key``.

    A key that holds a large share of the rows is spread over many tasks.  Null
    keys are one key.  The keys are counted first: many of them are not broadcast.
    """
    ordered = with_ordinal(df, key, *order, name="_at")
    first = ordered.groupBy(F.col(key).alias("_key")).agg(F.min("_at").alias("_first"))
    first = F.broadcast(first) if first.count() <= FEW_KEYS else first.hint("merge")
    joined = ordered.join(first, F.col(key).eqNullSafe(F.col("_key")))
    return joined.withColumn(name, F.col("_at") - F.col("_first")).drop("_at", "_key", "_first")


def with_previous(df: DataFrame, key: str, *order: str, values: dict[str, str]) -> DataFrame:
    """``df`` with values of the row before among those of its ``key``: new name -> column; null for the first.

    Neighbours meet by their ordinals, so a hot key is spread over many tasks.
    Both sides are all rows: neither is broadcast.
    """
    placed = with_ordinal(df, key, *order, name="_at")
    before = placed.select((F.col("_at") + 1).alias("_at"), F.col(key).alias("_key"), *(F.col(c).alias(n) for n, c in values.items()))
    joined = placed.join(before.hint("merge"), "_at", "left")
    same = F.col(key).eqNullSafe(F.col("_key"))
    return joined.select(*df.columns, *(F.when(same, F.col(n)).alias(n) for n in values))


def with_running_max(df: DataFrame, key: str, *order: str, value: str, name: str, stretch: int = 100_000) -> DataFrame:
    """``df`` with the greatest ``value`` of its ``key`` so far: in stretches of the order, each of which starts from those before."""
    placed = with_ordinal(df, key, *order, name="_at").withColumn("_part", F.floor(F.col("_at") / stretch))
    tops = placed.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_p")).agg(F.max(value).alias("_top"))
    before = tops.withColumn("_before", F.max("_top").over(Window.partitionBy("_key").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).drop("_top")
    own = Window.partitionBy(key, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.withColumn("_own", F.max(value).over(own)).join(before, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_p")))
    return joined.select(*df.columns, F.greatest("_own", "_before").alias(name))
