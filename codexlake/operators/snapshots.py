"""What changed between consecutive full snapshots: Merkle-tree comparison over hashed key ranges.

Every snapshot of a group (a page, a table partition, ...) is summarised as a Merkle tree.  Its leaves
are ranges of the hashed row key; the digest of a leaf covers the keys and row digests in its range and
the digest of an inner node covers its children.  The depth of a group's tree follows from its largest
snapshot, so a page of a few lines is one leaf and a table of billions of rows has leaves of a few dozen.
Two consecutive snapshots are compared from the root down: below a node whose digests agree nothing is read
any more, and rows are compared only in leaves that differ.  Rows are laid out once, by group and leaf, and
stay so; nothing is gathered by the group alone, so a group holding a third of all rows is spread over its
key ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexlake.operators.prefix import running_number
from codexlake.runtime import durable

#: Each level of the tree has 2**FANOUT_BITS children a node; a leaf holds about LEAF_ROWS rows of a snapshot.
FANOUT_BITS = 4
LEAF_ROWS = 32
MOST_LEVELS = 12


def _depth(rows: Column) -> Column:
    """Levels of the tree of a group whose largest snapshot has so many rows."""
    out = F.lit(0)
    for level in range(MOST_LEVELS):
        out = F.when(rows > LEAF_ROWS << (FANOUT_BITS * level), level + 1).otherwise(out)
    return out


def _changes(entries: str, last: str) -> Column:
    """``(pair, earlier, later)`` where a key's or node's values differ between consecutive versions.

    ``entries``: array of ``(version, value)`` in rising order, one a version; ``last``: the group's last version.
    """
    e = F.col(entries)

    def around(x: Column, i: Column) -> Column:
        before, after = F.get(e, i - 1), F.get(e, i + 1)
        came = F.when((x["version"] > 0) & (before.isNull() | (before["version"] != x["version"] - 1)), F.struct(x["version"].alias("pair"), F.lit(None).cast("struct<n:bigint,d:string>").alias("earlier"), x["value"].alias("later")))
        went = F.when((x["version"] < F.col(last)) & (after.isNull() | (after["version"] != x["version"] + 1)), F.struct((x["version"] + 1).alias("pair"), x["value"].alias("earlier"), F.lit(None).cast("struct<n:bigint,d:string>").alias("later")))
        other = F.when((after["version"] == x["version"] + 1) & (after["value"] != x["value"]), F.struct(after["version"].alias("pair"), x["value"].alias("earlier"), after["value"].alias("later")))
        return F.array(came, went, other)

    return F.filter(F.flatten(F.transform(e, around)), lambda x: x.isNotNull())


def _by_version(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``entries`` of each key, and the group's ``last`` version."""
    entry = F.struct("version", F.struct("n", "d").alias("value"))
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("entries"), F.max("last").alias("last"))


def merkle_diff(rows: DataFrame, versions: DataFrame, group: Sequence[str], version: str = "version", key: str = "row_key", digest: str = "digest", levels: int | None = None) -> DataFrame:
    """Added, removed and changed keys of each pair of consecutive snapshots.

    ``rows``: ``group`` columns, ``version`` (int, dense from 0 in each group), ``key`` (string) and
    ``digest`` (string) of the row's content.  ``versions``: ``group`` columns and ``version`` of all
    snapshots, those without rows too.  ``levels``: depth of all trees, where it shall not follow from the rows.

    Returns ``group`` columns, ``pair`` (version of the later snapshot), ``key``, ``change_kind``
    (``added``, ``removed``, ``changed``) and the number of rows on either side, ``n_earlier`` and
    ``n_later``.  Defined cases: a null key or group is skipped; a null digest is a content like any other;
    a key that is repeated within a snapshot is compared as the multiset of its digests; the first
    snapshot of a group gives nothing; empty tables give an empty result; extra columns are ignored.
    """
    g = list(group)
    read = rows.select(*g, F.col(version).alias("version"), F.col(key).alias("row_key"), F.coalesce(F.col(digest), F.lit("null")).alias("d")).where(F.col("row_key").isNotNull())
    lasts = versions.groupBy(*g).agg(F.max(version).alias("last"))
    if levels is None:
        sizes = read.groupBy(*g, "version").agg(F.count(F.lit(1)).alias("n")).groupBy(*g).agg(_depth(F.max("n")).alias("levels"))
        lasts = lasts.join(sizes, g, "left").withColumn("levels", F.coalesce("levels", F.lit(0)))
    else:
        lasts = lasts.withColumn("levels", F.lit(levels))
    lasts = durable(lasts)
    most = lasts.agg(F.max("levels")).first()[0]
    if most is None:
        return read.select(*g, F.lit(0).alias("pair"), F.col("row_key").alias(key), F.lit("").alias("change_kind"), F.lit(0).cast("bigint").alias("n_earlier"), F.lit(0).cast("bigint").alias("n_later")).where(F.lit(False))
    # A leaf's number has all bits of the deepest tree, of which a shallower one uses the first.
    bits = FANOUT_BITS * most
    node = F.shiftrightunsigned(F.xxhash64("row_key"), 64 - bits) if bits else F.lit(0).cast("bigint")
    spare = (bits - FANOUT_BITS * F.col("levels")).cast("int")
    placed = read.join(lasts, g).withColumn("node", node).withColumn("__s", spare).withColumn("node", F.expr("shiftleft(shiftrightunsigned(node, __s), __s)")).drop("__s")
    # Repeated keys: an order-free digest of all their contents, in bounded space.
    sums = [F.sum(F.xxhash64("d", F.lit(i)).cast("decimal(20,0)")).cast("string") for i in (0, 1)]
    one = placed.repartition(*g, "node").groupBy(*g, "node", "version", "row_key").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("d"), F.concat_ws("|", *sums).alias("all"), F.first("last").alias("last"), F.first("levels").alias("levels"))
    one = durable(one.withColumn("d", F.when(F.col("n") == 1, F.col("d")).otherwise(F.col("all"))).drop("all"))

    # From the leaves up: one table of digests a level, each for the trees that are deep enough.
    def digests(df: DataFrame, own: Column) -> DataFrame:
        both = [F.expr("bit_xor(xxhash64(own, d, n))"), F.expr("bit_xor(xxhash64(d, n, own))")]
        return df.withColumn("own", own).groupBy(*g, "node", "version").agg(F.sum("n").alias("n"), F.concat_ws("|", *[b.cast("string") for b in both]).alias("d"), F.first("last").alias("last"), F.first("levels").alias("levels"))

    leaves = digests(one, F.col("row_key"))
    if most:
        leaves = durable(leaves)
    tree = {most: leaves}
    for depth in range(most - 1, -1, -1):
        shift = FANOUT_BITS * (most - depth)
        tree[depth] = digests(tree[depth + 1].withColumn("child", F.col("node")).withColumn("node", F.shiftleft(F.shiftrightunsigned("node", shift), shift)), F.col("child"))

    # From the root down: the nodes that differ in some pair, each level below those of the level above.
    open_nodes = None
    for depth in range(most + 1):
        nodes = tree[depth]
        if open_nodes is not None:
            shift = FANOUT_BITS * (most - depth + 1)
            above = open_nodes.select(*g, F.col("node").alias("up"))
            nodes = nodes.withColumn("up", F.shiftleft(F.shiftrightunsigned("node", shift), shift)).join(above, [*g, "up"], "left_semi").drop("up")
        open_nodes = _by_version(nodes, [*g, "node"]).where(F.size(_changes("entries", "last")) > 0).select(*g, "node")

    # Rows of the leaves that differ.
    found = _by_version(one.join(open_nodes, [*g, "node"], "left_semi"), [*g, "node", "row_key"]).select(*g, "row_key", F.explode(_changes("entries", "last")).alias("c"))
    kind = F.when(F.col("c.earlier").isNull(), "added").when(F.col("c.later").isNull(), "removed").otherwise("changed")
    return found.select(*g, F.col("c.pair").alias("pair"), F.col("row_key").alias(key), kind.alias("change_kind"), F.coalesce("c.earlier.n", F.lit(0)).alias("n_earlier"), F.coalesce("c.later.n", F.lit(0)).alias("n_later"))


def number_versions(snapshots: DataFrame, group: Sequence[str], order: Sequence[str], version: str = "version") -> DataFrame:
    """Number the snapshots of each group from 0 in the given order (ties must be broken by ``order``).

    ``snapshots`` should hold keys only: one small row for each snapshot, not its content.
    """
    return running_number(snapshots, group, order, version)
