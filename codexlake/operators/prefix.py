"""Running totals over large groups without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexlake.runtime import durable


#: Rows that a range should hold, and bits of the range number at most: totals of a group are summed in one task.
RANGE_ROWS = 200_000
MOST_BITS = 20


def prefix_sum(df: DataFrame, by: Sequence[str], order: str, value: str, name: str, rows: int | None = None) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows before each one, in the order of a hash column.

    ``order`` is a bigint spread evenly, such as ``xxhash64``; ties are broken by nothing, so it should be
    unique within ``by``.  A group is cut into ranges of the hash: totals of the ranges are summed up first, then
    each range on its own, so a group holding a third of all rows still spreads over many tasks.  ``rows``: rows of
    the largest group, if known; there are as many ranges as leave about ``RANGE_ROWS`` rows to each, 256 at least.
    Null values count as 0.
    """
    bits = min(MOST_BITS, max(8, ((rows or 0) // RANGE_ROWS).bit_length()))
    # The sign bit is flipped so that the unsigned range number follows the signed order.
    ranged = df.withColumn("__range", F.shiftrightunsigned(F.col(order).bitwiseXOR(F.lit(-(2**63)).cast("bigint")), 64 - bits)).withColumn("__value", F.coalesce(F.col(value), F.lit(0)).cast("bigint"))
    totals = ranged.groupBy(*by, "__range").agg(F.sum("__value").alias("__total"))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*by, "__range", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*by, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("__inside", F.coalesce(F.sum("__value").over(inside), F.lit(0)))
    return summed.join(starts, [*by, "__range"]).withColumn(name, F.col("__start") + F.col("__inside")).drop("__range", "__value", "__start", "__inside")


def running_number(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], name: str) -> DataFrame:
    """Adds ``name``: number of the row in its group from 0, in the given order (ties must be broken by it).

    Rows are cut into ranges of (group, order), counted by range and then numbered inside each, so a group
    holding a third of all rows still spreads over the ranges.
    """
    ranged = durable(df.repartitionByRange(*[F.col(c) for c in by], *order).withColumn("__range", F.spark_partition_id()))
    totals = ranged.groupBy(*by, "__range").agg(F.count(F.lit(1)).alias("__total"))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__range").alias("__r"), F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy(*by, "__range").orderBy(*order))
    same = F.col("__range") == F.col("__r")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    numbered = ranged.withColumn("__inside", inside).join(starts, same)
    return numbered.withColumn(name, (F.col("__start") + F.col("__inside") - 1).cast("int")).drop("__range", "__r", "__start", "__inside", *[f"__{c}" for c in by])
