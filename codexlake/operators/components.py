"""Connected components of a bipartite record-entity graph by minimum labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexlake.runtime import durable, release


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Component of every entity of the bipartite graph ``edges(record, entity)``: ``entity``, ``component``.

    Minimum labels go from entities to records and back, then every label is replaced by its own label
    (which halves long chains), until nothing changes.  The component's name is its least entity.  Records
    with the same entities should be merged beforehand; null records and entities are skipped; an entity of
    a single record is a component; an empty table gives an empty result.  More than ``max_rounds`` rounds
    raise an error instead of returning unfinished labels.
    """
    edges = durable(edges.where(F.col("record").isNotNull() & F.col("entity").isNotNull()).select("record", "entity").distinct())
    labels = edges.select("entity").distinct().withColumn("component", F.col("entity"))
    before = None
    for _ in range(max_rounds):
        of_record = edges.join(labels, "entity").groupBy("record").agg(F.min("component").alias("component"))
        spread = edges.join(of_record, "record").groupBy("entity").agg(F.min("component").alias("component"))
        leader = spread.select(F.col("entity").alias("component"), F.col("component").alias("further"))
        jumped = spread.join(leader, "component", "left").select("entity", F.least("component", F.coalesce("further", "component")).alias("component"))
        changed = jumped.join(labels.withColumnRenamed("component", "old"), "entity").withColumn("moved", F.col("old") != F.col("component"))
        changed = durable(changed)
        labels = changed.select("entity", "component")
        if before is not None:
            release(before)
        before = changed
        if changed.where("moved").isEmpty():
            release(edges)
            return labels
    raise RuntimeError(f"labels still change after {max_rounds} rounds")
