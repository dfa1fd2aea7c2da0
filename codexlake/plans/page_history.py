"""Snapshot differences of pages: saved history states, and segmentation runs against live lines."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codexlake.operators.snapshots import merkle_diff, number_versions
from codexlake.plans.catalog import query
from codexlake.runtime import durable, table

#: Fields of a line that may differ without the line having changed.
IGNORED_FIELDS = ("id", "order", "source_metadata")


def _canonical(value: object) -> object:
    """Numbers by value, null members of objects left out, key order settled by the dump."""
    if isinstance(value, dict):
        return {k: _canonical(v) for k, v in value.items() if v is not None}
    if isinstance(value, list):
        return [_canonical(v) for v in value]
    if isinstance(value, int) and not isinstance(value, bool):
        return float(value) if abs(value) < 2**53 else value
    return value


def line_digests(state: str | None) -> list[dict] | None:
    """``[{line_key, digest}]`` of a JSON state; None if it is null or not a JSON object."""
    try:
        parsed = json.loads(state) if state is not None else None
    except ValueError:
        return None
    if not isinstance(parsed, dict):
        return None
    lines = parsed.get("lines")
    out = []
    for line in lines if isinstance(lines, list) else []:
        if isinstance(line, dict) and line.get("id") is not None:
            content = _canonical({k: v for k, v in line.items() if k not in IGNORED_FIELDS})
            text = json.dumps(content, sort_keys=True, ensure_ascii=True, separators=(",", ":"))
            out.append({"line_key": str(line["id"]), "digest": hashlib.blake2b(text.encode(), digest_size=16).hexdigest()})
    return out


def _line_digests(column: str) -> Column:
    def digests(states: pd.Series) -> pd.Series:
        return states.map(line_digests)

    return F.pandas_udf(digests, "array<struct<line_key:string,digest:string>>")(column)


def history_changes(snapshots: DataFrame) -> DataFrame:
    """Changed lines of consecutive history snapshots: ``later_id``, ``line_key``, ``change_kind``.

    Snapshots whose state is null or no JSON object are passed over; a repeated delivery counts once
    (the content of the earliest ``received_at`` holds); snapshots of a part are ordered by
    ``created_at``, then id.  A null part is a group of its own.  A state without lines is an empty snapshot.
    """
    parsed = snapshots.where(F.col("state").isNotNull() & F.col("id").isNotNull()).select("id", "part_id", "created_at", F.coalesce("received_at", "created_at").alias("at"), _line_digests("state").alias("lines"))
    parsed = durable(parsed.where(F.col("lines").isNotNull()))
    first = parsed.groupBy("id").agg(F.min(F.struct(F.col("at"), F.col("created_at"), F.coalesce("part_id", F.lit("")).alias("part"))).alias("f"))
    versions = number_versions(first.select("id", F.col("f.part").alias("part"), F.col("f.created_at").alias("created_at"), F.col("f.at").alias("at")), ["part"], ["created_at", "id"])
    rows = (
        parsed.join(versions.select("id", "at", "part", "version"), ["id", "at"])
        .select("part", "version", "id", F.explode("lines").alias("line"))
        .select("part", "version", F.col("line.line_key").alias("row_key"), F.col("line.digest").alias("digest"))
        .distinct()
    )
    found = merkle_diff(rows, versions, ["part"])
    return found.join(versions.select("part", F.col("version").alias("pair"), F.col("id").alias("later_id")), ["part", "pair"]).select("later_id", F.col("row_key").alias("line_key"), "change_kind")


def run_changes(runs: DataFrame, live: DataFrame) -> DataFrame:
    """Changes between each part's newest run and its live lines: ``later_id``, ``line_key``, ``change_kind``.

    The run is the earlier snapshot, keyed by ``external_id``; a live line stands under the external id
    it came from, or under its own id if it came from no line of this run.  Repeated deliveries of a run
    or a line count once; among runs of the same time the greatest id is the newest; null ids are skipped.
    """
    part = F.coalesce("part_id", F.lit("")).alias("part")
    points = F.sha2(F.coalesce(F.to_json("points"), F.lit("null")), 256).alias("digest")
    run_key = F.struct(F.col("created_at"), F.col("id"))
    newest = runs.where(F.col("id").isNotNull()).groupBy(part).agg(F.max(run_key).alias("r")).select("part", F.col("r.id").alias("run_id"))
    listed = (
        runs.select(F.col("id").alias("run_id"), part, F.explode("run_lines").alias("l"))
        .join(newest, ["part", "run_id"], "left_semi")
        .select("part", "run_id", F.col("l.external_id").alias("external_id"), F.col("l.points").alias("points"))
        .where(F.col("external_id").isNotNull())
        .select("part", "run_id", "external_id", points)
        .distinct()
    )
    lines = live.where(F.col("id").isNotNull()).select("id", part, "segmentation_run_id", "run_external_id", points).dropDuplicates(["id"])
    lines = lines.join(newest.select("part"), ["part"], "left_semi")
    origin = listed.select("part", F.col("run_id").alias("segmentation_run_id"), F.col("external_id").alias("run_external_id"), F.lit(True).alias("listed")).distinct()
    placed = lines.join(origin, ["part", "segmentation_run_id", "run_external_id"], "left")
    key = F.when(F.col("listed"), F.concat(F.lit("x"), "run_external_id")).otherwise(F.concat(F.lit("l"), "id"))
    rows = durable(listed.select("part", F.lit(0).alias("version"), F.concat(F.lit("x"), "external_id").alias("row_key"), "digest").unionByName(placed.select("part", F.lit(1).alias("version"), key.alias("row_key"), "digest")))
    versions = newest.select("part", F.explode(F.array(F.lit(0), F.lit(1))).alias("version"))
    found = merkle_diff(rows, versions, ["part"]).join(newest, ["part"])
    return found.select(F.col("run_id").alias("later_id"), F.expr("substring(row_key, 2)").alias("line_key"), "change_kind")


@query()
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = history_changes(table(spark, sf_dir, "annotation_history_snapshots")).withColumn("scope", F.lit("history"))
    run = run_changes(table(spark, sf_dir, "segmentation_runs"), table(spark, sf_dir, "live_lines")).withColumn("scope", F.lit("run"))
    return history.unionByName(run).select("scope", "later_id", "line_key", "change_kind").distinct()


_NEWEST = "SELECT part_id, max(struct_pack(created_at := created_at, id := id)).id AS run_id FROM (SELECT coalesce(part_id, '') AS part_id, created_at, id FROM segmentation_runs WHERE id IS NOT NULL) GROUP BY 1"


@query(f"""
WITH n AS ({_NEWEST}), r AS (SELECT DISTINCT n.part_id, n.run_id, l.external_id AS ext, l.points AS points FROM n JOIN (SELECT id, coalesce(part_id, '') AS part_id, unnest(run_lines) AS l FROM segmentation_runs) s ON s.id = n.run_id AND s.part_id = n.part_id WHERE l.external_id IS NOT NULL),
v AS (SELECT DISTINCT id, coalesce(part_id, '') AS part_id, segmentation_run_id AS run_id, run_external_id AS ext, points FROM live_lines WHERE id IS NOT NULL),
p AS (SELECT v.part_id, n.run_id, v.id, v.points, r.ext FROM v JOIN n USING (part_id) LEFT JOIN (SELECT DISTINCT part_id, run_id, ext FROM r) r ON r.part_id = v.part_id AND r.run_id = v.run_id AND r.ext = v.ext),
a AS (SELECT part_id, run_id, ext, count(*) AS k, min(points) AS p FROM r GROUP BY 1, 2, 3), b AS (SELECT part_id, ext, count(*) AS k, min(points) AS p FROM p WHERE ext IS NOT NULL GROUP BY 1, 2)
SELECT a.run_id AS later_id, a.ext AS line_key, CASE WHEN b.ext IS NULL THEN 'removed' ELSE 'changed' END AS change_kind FROM a LEFT JOIN b ON a.part_id = b.part_id AND a.ext = b.ext WHERE b.ext IS NULL OR a.k <> b.k OR a.p IS DISTINCT FROM b.p
UNION SELECT run_id, id, 'added' FROM p WHERE ext IS NULL
""")
def p1_run_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of ``p1_found`` on newest runs against live lines."""
    return run_changes(table(spark, sf_dir, "segmentation_runs"), table(spark, sf_dir, "live_lines")).select("later_id", "line_key", "change_kind").distinct()


@query("""
WITH s AS (SELECT id, coalesce(part_id, '') AS part, created_at, state FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY received_at, created_at) AS r FROM annotation_history_snapshots WHERE state IS NOT NULL AND id IS NOT NULL) WHERE r = 1),
v AS (SELECT id, part, row_number() OVER (PARTITION BY part ORDER BY created_at, id) AS v FROM s),
k AS (SELECT DISTINCT v.part, v.v, json_extract_string(x, '$.id') AS line_key FROM v JOIN (SELECT id, unnest(CAST(json_extract(state, '$.lines') AS JSON[])) AS x FROM s WHERE json_type(state, '$.lines') = 'ARRAY') l USING (id) WHERE json_extract_string(x, '$.id') IS NOT NULL),
o AS (SELECT v.id AS later_id, k.line_key FROM v JOIN k ON k.part = v.part AND k.v = v.v - 1), n AS (SELECT v.id AS later_id, k.line_key FROM v JOIN k ON k.part = v.part AND k.v = v.v WHERE v.v > 1)
SELECT later_id, line_key, 'removed' AS change_kind FROM (SELECT * FROM o EXCEPT SELECT * FROM n) UNION ALL SELECT later_id, line_key, 'added' FROM (SELECT * FROM n EXCEPT SELECT * FROM o)
""")
def p1_history_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of ``p1_found`` on lines that came or went between history snapshots."""
    found = history_changes(table(spark, sf_dir, "annotation_history_snapshots")).where("change_kind <> 'changed'")
    return found.select("later_id", "line_key", "change_kind").distinct()
