"""Positions, running totals and neighbours over one global order.

``row_number() over (order by ...)`` without a partition key sends every row to
one task. Here rows are range-partitioned and sorted, staged once, and only one
summary row per partition is folded in a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismatch.session import shuffle_width, stage

_PART, _ROW, _BASE = "__part", "__row", "__base"
_ROW_BITS = 33  # low bits of monotonically_increasing_id hold the row within its partition


def sorted_stage(df: DataFrame, order: Sequence[Column], partitions: int | None = None) -> DataFrame:
    """Range-sorted copy with the partition and the row within it as columns.

    ``order`` must end in a unique column; otherwise a frequent key would stay
    in one range and the order would not be repeatable.
    """
    n = partitions or shuffle_width(df.sparkSession)
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    mid = F.monotonically_increasing_id()
    return stage(
        ranged.withColumn(_ROW, mid)
        .withColumn(_PART, F.shiftright(_ROW, _ROW_BITS))
        .withColumn(_ROW, F.col(_ROW).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))),
        "sorted",
    )


def _base(staged: DataFrame, value: Column) -> DataFrame:
    """Exclusive prefix of ``value`` per partition (one row per partition)."""
    per_part = staged.groupBy(_PART).agg(value.alias("__v"))
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select(_PART, F.coalesce(F.sum("__v").over(before), F.lit(0)).alias(_BASE))


def with_position(df: DataFrame, order: Sequence[Column], name: str = "position", start: int = 0) -> DataFrame:
    """Add the row's place in the global order."""
    staged = sorted_stage(df, order)
    base = F.broadcast(_base(staged, F.count(F.lit(1))))  # one row per partition
    return staged.join(base, _PART).select(*df.columns, (F.col(_BASE) + F.col(_ROW) + start).cast("bigint").alias(name))


def with_running_total(
    df: DataFrame, order: Sequence[Column], value: str, name: str = "running", inclusive: bool = True
) -> DataFrame:
    """Add the sum of ``value`` over the global order up to (and with) each row."""
    staged = sorted_stage(df, order)
    base = F.broadcast(_base(staged, F.sum(value)))
    inside = Window.partitionBy(_PART).orderBy(_ROW).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum(value).over(inside)
    out = staged.withColumn("__in", total).join(base, _PART)
    result = F.col(_BASE) + F.col("__in")
    if not inclusive:
        result = result - F.col(value)
    return out.select(*df.columns, result.alias(name))


def with_earlier_max(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, name: str = "earlier_max") -> DataFrame:
    """Add the largest ``value`` of the earlier rows of the same key (null on a key's first row).

    A key may span partitions: only keys that open a partition can have earlier
    rows elsewhere, so one maximum per partition is carried over for them.
    """
    keys = list(keys)
    staged = sorted_stage(df, [*[F.col(k) for k in keys], *order])
    opening = F.broadcast(staged.where(F.col(_ROW) == 0).select(*keys).distinct())  # at most one key per partition
    per = staged.join(opening, keys, "left_semi").groupBy(_PART, *keys).agg(F.max(value).alias("__m"))
    before = Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = per.select(_PART, *keys, F.max("__m").over(before).alias("__carry"))
    inside = Window.partitionBy(_PART, *keys).orderBy(_ROW).rowsBetween(Window.unboundedPreceding, -1)
    out = staged.withColumn("__in", F.max(value).over(inside)).join(F.broadcast(carried), [_PART, *keys], "left")
    return out.select(*df.columns, F.greatest("__in", "__carry").alias(name))


def with_previous(df: DataFrame, order: Sequence[Column], columns: Sequence[str], prefix: str = "prev_") -> DataFrame:
    """Add the given columns of the preceding row in the global order (null on the first)."""
    staged = sorted_stage(df, order)
    packed = F.struct(*columns)
    last = staged.groupBy(_PART).agg(F.max_by(packed, F.col(_ROW)).alias("__last"))
    carried = last.select(_PART, F.lag("__last").over(Window.orderBy(_PART)).alias("__carry"))
    inside = Window.partitionBy(_PART).orderBy(_ROW)
    out = (
        staged.withColumn("__prev", F.lag(packed).over(inside))
        .join(F.broadcast(carried), _PART)
        .withColumn("__prev", F.coalesce("__prev", "__carry"))
    )
    return out.select(*df.columns, *[F.col(f"__prev.{c}").alias(prefix + c) for c in columns])


def int_quantiles(
    df: DataFrame, value: str, ranks: dict[str, Column], group: Sequence[str] = (), width: int = 4096
) -> DataFrame:
    """Exact order statistics of a non-negative integer column.

    ``ranks`` maps an output name to a 0-based place as an expression of the
    group size ``n``. Values are counted, the counts are summed in blocks of
    ``width`` values, and only the block that holds a place is searched, so no
    task sees the values themselves.
    """
    group = list(group)
    hist = (
        df.where(F.col(value).isNotNull())
        .groupBy(*group, F.col(value).cast("bigint").alias("__v"))
        .agg(F.count(F.lit(1)).alias("__c"))
        .withColumn("__b", F.floor(F.col("__v") / width))
    )
    block = hist.groupBy(*group, "__b").agg(F.sum("__c").alias("__bc"))
    keys = group or [F.lit(0)]
    upto = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    block = block.withColumn("__before", F.coalesce(F.sum("__bc").over(upto), F.lit(0))).withColumn(
        "n", F.sum("__bc").over(Window.partitionBy(*keys))
    )
    wanted = F.array(*[F.struct(F.lit(k).alias("k"), e.cast("bigint").alias("at")) for k, e in ranks.items()])
    block = (
        block.withColumn("__w", F.explode(wanted))
        .where((F.col("__w.at") >= F.col("__before")) & (F.col("__w.at") < F.col("__before") + F.col("__bc")))
        .select(*group, "__b", "__before", F.col("__w.k").alias("__k"), F.col("__w.at").alias("__at"))
    )
    fine = hist.join(block, [*group, "__b"])
    within = Window.partitionBy(*keys, "__k").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fine = fine.withColumn("__cum", F.col("__before") + F.sum("__c").over(within)).where(F.col("__cum") > F.col("__at"))
    names = list(ranks)
    return fine.groupBy(*group).agg(
        *[F.min(F.when(F.col("__k") == k, F.col("__v"))).alias(k) for k in names]
    )
