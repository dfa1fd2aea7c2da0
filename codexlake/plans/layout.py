"""Layout analytics of pages: boxes, areas, overlaps, spacing, columns, matching of segmentation to lines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codexlake.functions.geometry import box, hull_area, overlaps, shoelace
from codexlake.operators.matching import box_pairs, greedy_match, cluster_centres, optimal_match, reading_order
from codexlake.plans.catalog import query
from codexlake.runtime import table

_LIVE = "SELECT id, max(part_id) AS part_id, max(points) AS points FROM live_lines WHERE id IS NOT NULL AND points IS NOT NULL GROUP BY 1"
_BOXES = f"SELECT id, part_id, list_min(list_transform(points, lambda p: p[1])) AS x0, list_min(list_transform(points, lambda p: p[2])) AS y0, list_max(list_transform(points, lambda p: p[1])) AS x1, list_max(list_transform(points, lambda p: p[2])) AS y1 FROM ({_LIVE})"


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live lines, each once."""
    return table(spark, sf_dir, "live_lines").where("id IS NOT NULL AND points IS NOT NULL").groupBy("id").agg(F.max("part_id").alias("part_id"), F.max("points").alias("points"))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _live(spark, sf_dir).select("id", "part_id", *[c.alias(n) for n, c in box("points").items()])


@query(_BOXES)
def line_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir)


@query(f"""
SELECT id, round(abs(list_sum(list_transform(range(1, len(points) + 1), lambda i: points[i][1] * points[i % len(points) + 1][2] - points[i % len(points) + 1][1] * points[i][2]))) / 2, 3) AS area FROM ({_LIVE}) WHERE len(points) >= 3
""")
def polygon_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _live(spark, sf_dir).where(F.size("points") >= 3).select("id", F.round(shoelace("points"), 3).alias("area"))


@query()
def convex_hulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area of each line's hull beside its own."""
    return _live(spark, sf_dir).select("id", F.round(shoelace("points"), 3).alias("area"), F.round(hull_area("points"), 3).alias("hull_area"))


@query(f"""
WITH b AS ({_BOXES}) SELECT a.part_id, a.id AS a, b.id AS b, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS shared
FROM b a JOIN b ON a.part_id = b.part_id AND a.id < b.id WHERE greatest(a.x0, b.x0) < least(a.x1, b.x1) AND greatest(a.y0, b.y0) < least(a.y1, b.y1)
""")
def spatial_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return box_pairs(_boxes(spark, sf_dir), ["part_id"], "id")


@query(f"""
WITH b AS ({_BOXES}) SELECT part_id, count(gap) AS n_gaps, round(median(gap), 3) AS spacing FROM (SELECT part_id, lead(y0) OVER (PARTITION BY part_id ORDER BY y0, id) - y0 AS gap FROM b) WHERE gap > 0 GROUP BY 1
""")
def line_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("part_id").orderBy("y0", "id")
    gaps = _boxes(spark, sf_dir).select("part_id", (F.lead("y0").over(w) - F.col("y0")).alias("gap")).where("gap > 0")
    return gaps.groupBy("part_id").agg(F.count(F.lit(1)).alias("n_gaps"), F.round(F.median("gap"), 3).alias("spacing"))


@query(f"""
WITH b AS ({_BOXES}), c AS (SELECT part_id, unnest(range(CAST(floor(x0 / 50) AS BIGINT), CAST(floor(x1 / 50) AS BIGINT) + 1)) AS slice FROM b), n AS (SELECT part_id, slice, count(*) AS n FROM c GROUP BY 1, 2),
f AS (SELECT *, slice - row_number() OVER (PARTITION BY part_id ORDER BY slice) AS island FROM n WHERE n >= 2)
SELECT part_id, min(slice) AS first_slice, max(slice) AS last_slice, CAST(max(n) AS BIGINT) AS peak FROM f GROUP BY part_id, island
""")
def column_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of slices that two or more lines cover: coverage profile, then runs above the floor."""
    slices = F.explode(F.sequence(F.floor(F.col("x0") / 50), F.floor(F.col("x1") / 50))).alias("slice")
    n = _boxes(spark, sf_dir).select("part_id", slices).groupBy("part_id", "slice").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    island = F.col("slice") - F.row_number().over(Window.partitionBy("part_id").orderBy("slice"))
    return n.withColumn("island", island).groupBy("part_id", "island").agg(F.min("slice").alias("first_slice"), F.max("slice").alias("last_slice"), F.max("n").alias("peak")).drop("island")


@query(f"""
WITH b AS ({_BOXES}), m AS (SELECT part_id, median(y1 - y0) AS h, median(x1 - x0) AS w FROM b GROUP BY 1)
SELECT id, CASE WHEN y1 - y0 > 2 * h THEN 'tall' WHEN x1 - x0 < 0.2 * w THEN 'fragment' ELSE 'normal' END AS finding FROM b JOIN m USING (part_id)
""")
def segment_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines far from their page's medians."""
    b = _boxes(spark, sf_dir)
    m = b.groupBy("part_id").agg(F.median(F.col("y1") - F.col("y0")).alias("h"), F.median(F.col("x1") - F.col("x0")).alias("w"))
    finding = F.when(F.col("y1") - F.col("y0") > 2 * F.col("h"), "tall").when(F.col("x1") - F.col("x0") < 0.2 * F.col("w"), "fragment").otherwise("normal")
    return b.join(m, "part_id").select("id", finding.alias("finding"))


@query(f"""
WITH b AS ({_BOXES}) SELECT a.id AS a, b.id AS b FROM b a JOIN b ON a.part_id = b.part_id AND a.id < b.id
WHERE least(a.x1, b.x1) - greatest(a.x0, b.x0) >= 0.5 * least(a.x1 - a.x0, b.x1 - b.x0) AND abs((a.y0 + a.y1) - (b.y0 + b.y1)) / 2 <= 60
""")
def interval_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a page that share half their x range and lie within 60 px: a hash join on page and y band.

    A line meets lines of its own and the neighbouring bands of 60 px only, never its whole page.
    """
    b = _boxes(spark, sf_dir).withColumn("mid", (F.col("y0") + F.col("y1")) / 2).withColumn("band", F.floor(F.col("mid") / 60))
    left = b.select("part_id", F.col("id").alias("a"), F.col("x0").alias("ax0"), F.col("x1").alias("ax1"), F.col("mid").alias("am"), F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    right = b.select("part_id", F.col("id").alias("b"), F.col("x0").alias("bx0"), F.col("x1").alias("bx1"), F.col("mid").alias("bm"), "band")
    shared = F.least("ax1", "bx1") - F.greatest("ax0", "bx0")
    near = (shared >= 0.5 * F.least(F.col("ax1") - F.col("ax0"), F.col("bx1") - F.col("bx0"))) & (F.abs(F.col("am") - F.col("bm")) <= 60)
    return left.join(right, ["part_id", "band"]).where(near & (F.col("a") < F.col("b"))).select("a", "b")


def _points(values: pd.Series) -> list[np.ndarray]:
    return [np.array([list(p) for p in v], dtype=float) for v in values]


def _matched(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    if not len(left):
        return pd.DataFrame(columns=["part_id", "n_run", "n_live", "greedy", "optimal", "best"])
    scores = overlaps(_points(left["points"]), _points(right["points"]) if len(right) else [])
    pairs, best = greedy_match(scores, 0.5), optimal_match(scores, 0.5)
    return pd.DataFrame([(left["part_id"].iloc[0], *scores.shape, len(pairs), len(best), round(float(sum(scores[i, j] for i, j in best)), 4))], columns=["part_id", "n_run", "n_live", "greedy", "optimal", "best"])


def _newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "segmentation_runs").where("part_id IS NOT NULL").groupBy("part_id").agg(F.max(F.struct("created_at", "id", "run_lines")).alias("r"))
    return runs.select("part_id", F.explode("r.run_lines").alias("l")).select("part_id", F.col("l.points").alias("points")).where("points IS NOT NULL")


@query()
def match_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of the newest runs against the live lines, greedy and optimal.  Pages are small."""
    per_page = _newest(spark, sf_dir).groupBy("part_id").cogroup(_live(spark, sf_dir).select("part_id", "points").groupBy("part_id")).applyInPandas(_matched, "part_id string, n_run long, n_live long, greedy long, optimal long, best double")
    s = per_page.agg(*[F.sum(c).alias(c) for c in ("n_run", "n_live", "greedy", "optimal")])
    p, r = F.col("greedy") / F.col("n_run"), F.col("greedy") / F.col("n_live")
    return s.select("n_run", "n_live", "greedy", "optimal", F.round(p, 4).alias("match_precision"), F.round(r, 4).alias("match_recall"), F.round(2 * p * r / (p + r), 4).alias("f1"))


@query()
def page_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading order of the live lines of each page."""

    def order(page: pd.DataFrame) -> pd.DataFrame:
        at = reading_order(page[["x0", "y0", "x1", "y1"]].to_numpy(float))
        return pd.DataFrame({"id": page["id"].to_numpy()[at], "position": range(len(at))})

    return _boxes(spark, sf_dir).where("part_id IS NOT NULL").groupBy("part_id").applyInPandas(order, "id string, position long")


@query()
def column_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two centres of the lines' left edges on each page."""

    def centres(page: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part_id": [page["part_id"].iloc[0]], "centres": [[round(c, 2) for c in cluster_centres(sorted(page["x0"]), 2)]]})

    return _boxes(spark, sf_dir).where("part_id IS NOT NULL").groupBy("part_id").applyInPandas(centres, "part_id string, centres array<double>")
