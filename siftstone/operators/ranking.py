"""Ranks and running totals inside groups of any size, without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftstone.operators.scratch import written


#: Rows of a group that one slice should hold, and the least number of slices.
SLICE_ROWS, LEAST_SLICES = 100_000, 64


def slices_for(rows: int) -> int:
    """Slices for a group of this many rows: their number follows the group, so a slice's window stays the same size."""
    return max(LEAST_SLICES, -(-rows // SLICE_ROWS))


def grouped_position(rows: DataFrame, group: list[str], order_hash: Column, weight: Column, slices: int) -> DataFrame:
    """Adds ``position`` (rows before) and ``before`` (weight before) of each row in its group.

    Rows stand in the order of ``order_hash`` (a 64-bit hash that differs from
    row to row), cut into ``slices`` equal ranges. Each (group, slice) is summed
    with partial aggregation; the sums, groups x slices rows at most, give each
    slice its offset; within a slice a window counts on. A group with a third of
    all rows so spreads over all its slices. Every row keeps all its columns;
    ``__h`` and ``__slice`` are removed.
    """
    h = F.shiftrightunsigned(order_hash, 1)
    keyed = rows.withColumn("__h", order_hash).withColumn("__slice", F.floor(h / F.lit(float(1 << 63) / slices)).cast("int")).withColumn("__w", weight)
    sums = keyed.groupBy(*group, "__slice").agg(F.count(F.lit(1)).alias("__n"), F.sum("__w").alias("__t"))
    upto = Window.partitionBy(*group).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*group, "__slice", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__n0"), F.coalesce(F.sum("__t").over(upto), F.lit(0)).alias("__t0"))
    inside = Window.partitionBy(*group, "__slice").orderBy(F.shiftrightunsigned("__h", 1), "__h")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    return (
        keyed.join(offsets, [*group, "__slice"])
        .withColumn("position", F.col("__n0") + F.row_number().over(inside) - 1)
        .withColumn("before", F.col("__t0") + F.coalesce(F.sum("__w").over(before), F.lit(0)))
        .drop("__h", "__slice", "__w", "__n0", "__t0")
    )


def sequential_ids(df: DataFrame, order: str, name: str) -> DataFrame:
    """Adds 0, 1, 2, ... in the order of a column, by range partitions and their counts instead of one global window.

    Ties may stand in any order; nulls come first. The counts of the partitions
    (one number each) are the only thing the driver sees.
    """
    ordered = written(df.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("__p", F.spark_partition_id()).withColumn("__k", F.monotonically_increasing_id()), "ordered")
    counts = ordered.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"), F.min("__k").alias("__k0"))
    offsets = counts.select("__p", "__k0", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__o"))
    return ordered.join(F.broadcast(offsets), "__p").withColumn(name, F.col("__o") + F.col("__k") - F.col("__k0")).drop("__p", "__k", "__k0", "__o")
