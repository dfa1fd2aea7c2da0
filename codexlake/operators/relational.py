"""Relational building blocks: pages of results, newest rows, differences, overlays, islands, calendars."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyset_page(df: DataFrame, keys: Sequence[str], after: Sequence[object] | None, limit: int, descending: bool = True) -> DataFrame:
    """One page in key order that begins after a key, plus one probe row that tells whether more follow.

    ``has_more`` is true on every row of a page with a successor.  Keys compare as a row value.
    """
    if after is not None:
        left, right = F.struct(*keys), F.struct(*[F.lit(v).cast(dict(df.dtypes)[k]).alias(k) for k, v in zip(keys, after, strict=True)])
        df = df.where(left < right if descending else left > right)
    order = [F.desc(k) if descending else F.asc(k) for k in keys]
    probe = df.orderBy(*order).limit(limit + 1)
    numbered = probe.withColumn("__n", F.row_number().over(Window.orderBy(*order)))
    more = F.max("__n").over(Window.partitionBy(F.lit(0))) > limit
    return numbered.withColumn("has_more", more).where(F.col("__n") <= limit).drop("__n")


def latest_per_group(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each group, with partial aggregation before the shuffle instead of a window."""
    rest = [c for c in df.columns if c not in group]
    best = F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("r")
    return df.groupBy(*group).agg(best).select(*group, *[F.col(f"r.{c}").alias(c) for c in rest])


def keep_newest(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The ``n`` newest rows of each group, with their ``rank``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= n)


def calendar(df: DataFrame, day: str) -> DataFrame:
    """All days from the first to the last of a date column."""
    return df.agg(F.min(day).alias("a"), F.max(day).alias("b")).select(F.explode(F.sequence("a", "b")).alias(day))


def zero_filled(df: DataFrame, day: str, counts: Mapping[str, Column]) -> DataFrame:
    """Conditional counts of each calendar day, 0 where a day has no rows."""
    facts = df.groupBy(day).agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
    return calendar(df, day).join(facts, day, "left").fillna(0, list(counts))


def ratio(part: Column, whole: Column, digits: int = 4, empty: float | None = None) -> Column:
    """``part/whole`` rounded; ``empty`` where the whole is 0 (null unless given)."""
    return F.when(whole > 0, F.round(part / whole, digits)).otherwise(F.lit(empty).cast("double"))


def full_outer_diff(left: DataFrame, right: DataFrame, keys: Sequence[str], digest: str) -> DataFrame:
    """``keys`` with ``change``: ``unchanged``, ``changed``, ``deleted`` (left only) or ``added``."""
    a = left.select(*keys, F.struct(F.col(digest).alias("d")).alias("l"))
    b = right.select(*keys, F.struct(F.col(digest).alias("d")).alias("r"))
    kind = F.when(F.col("r").isNull(), "deleted").when(F.col("l").isNull(), "added").when(F.col("l").eqNullSafe(F.col("r")), "unchanged").otherwise("changed")
    return a.join(b, list(keys), "full_outer").select(*keys, kind.alias("change"))


def overlay(base: DataFrame, updates: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Bulk replace: rows of ``updates``; a null column keeps the base value, rows missing there are deleted."""
    old = base.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    return updates.join(old, list(keys), "left").select(*keys, *[F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) for c in columns])


def first_hit(df: DataFrame, key: Sequence[str], candidates: Sequence[DataFrame], value: str) -> DataFrame:
    """Priority fallback: the value of the first candidate that has the row's key.

    Each candidate: the columns it is keyed by (a part of ``df``'s columns) and ``value``.
    """
    out = df
    names = []
    for i, c in enumerate(candidates):
        names.append(f"__{i}")
        out = out.join(c.withColumnRenamed(value, f"__{i}"), [k for k in c.columns if k != value], "left")
    return out.select(*key, F.coalesce(*names).alias(value), F.coalesce(*[F.when(F.col(n).isNotNull(), F.lit(i)) for i, n in enumerate(names)]).alias("priority"))


def islands(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Runs of equal neighbouring values: ``group``, ``run`` (from 0), ``value``, ``n``, by gaps and islands."""
    w = Window.partitionBy(*group).orderBy(*order)
    change = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    runs = df.withColumn("__c", change).withColumn("run", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return runs.groupBy(*group, "run").agg(F.first(value).alias(value), F.count(F.lit(1)).alias("n"))


def within_window(df: DataFrame, group: Sequence[str], at: str, seconds: int) -> Column:
    """Number of rows of the group in the ``seconds`` up to and including the row."""
    w = Window.partitionBy(*group).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return F.count(F.lit(1)).over(w)
