"""Layout of whole pages: reading order, fragments, overlaps and defects; intervals and bands; PAGE XML as pages.

A page's lines are one small group (thousands at most), so a page is worked on in one piece; what can be said by boxes
alone stays in joins on page and band.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codexlake.functions.outlines import default_baseline, padded_box
from codexlake.functions.pagexml import page_lines, page_problems
from codexlake.operators.matching import box_pairs
from codexlake.operators.pagelayout import Page, defects, inserted_order, line_order, resolve_overlaps, row_runs, suppressed
from codexlake.plans.catalog import query
from codexlake.plans.layout import _BOXES, _boxes, _live
from codexlake.runtime import table


def _paged(lines: DataFrame, of: Callable[[list, list[np.ndarray]], list[tuple]], schema: str) -> DataFrame:
    """``of(ids, outlines)`` for each page of ``part_id``, ``id``, ``points``; lines in the order of their ids."""
    columns = [c.split()[0] for c in schema.split(", ")]

    def page(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        outlines = [np.array([tuple(p) for p in v], dtype=float).reshape(-1, 2) for v in rows["points"]]
        return pd.DataFrame(of(rows["id"].tolist(), outlines), columns=columns)

    return lines.where("part_id IS NOT NULL AND size(points) > 0").groupBy("part_id").applyInPandas(page, schema)


def _box_array(outlines: list[np.ndarray]) -> np.ndarray:
    return np.array([[*o.min(axis=0), *o.max(axis=0)] for o in outlines]).reshape(-1, 4)


@query()
def page_line_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading order of each page by columns, rows and spanning lines."""
    return _paged(_live(spark, sf_dir), lambda ids, outlines: [(ids[i], k) for k, i in enumerate(line_order(_box_array(outlines)))], "id string, position bigint")


@query()
def row_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by run of fragments in a row: the run's first line, the place in it and its length."""

    def runs(ids: list, outlines: list[np.ndarray]) -> list[tuple]:
        return [(ids[i], ids[run[0]], k, len(run)) for run in row_runs(_box_array(outlines)) for k, i in enumerate(run)]

    return _paged(_live(spark, sf_dir), runs, "id string, run string, place bigint, n bigint")


@query()
def overlap_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each page after overlaps are cut apart: dropped ones, unresolved ones and the area that is left."""

    def resolve(ids: list, outlines: list[np.ndarray]) -> list[tuple]:
        heights = np.array([np.ptp(o[:, 1]) for o in outlines])
        shapes, dropped, stuck = resolve_overlaps(outlines, [default_baseline(o) for o in outlines], np.ones(len(ids)), float(np.median(heights)))
        areas = [abs(float(np.dot(s[:, 0], np.roll(s[:, 1], -1)) - np.dot(s[:, 1], np.roll(s[:, 0], -1)))) / 2 for s in shapes]
        return [(i, bool(d), bool(s), round(a, 3)) for i, d, s, a in zip(ids, dropped, stuck, areas, strict=True)]

    return _paged(_live(spark, sf_dir), resolve, "id string, dropped boolean, unresolved boolean, area double")


@query()
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that repeat a longer one of their page, as tiles that overlap produce them."""

    def repeats(ids: list, outlines: list[np.ndarray]) -> list[tuple]:
        gone = suppressed([default_baseline(o) for o in outlines], float(np.median([np.ptp(o[:, 1]) for o in outlines])))
        return [(i, bool(g)) for i, g in zip(ids, gone, strict=True)]

    return _paged(_live(spark, sf_dir), repeats, "id string, repeated boolean")


@query()
def page_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suspects, lines over several columns, fragments, overlaps and duplicates of every page; lines without a run are drawn by hand."""
    by_hand = table(spark, sf_dir, "live_lines").where("id IS NOT NULL").groupBy("id").agg(F.max("segmentation_run_id").isNull().alias("manual"))

    def page(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        outlines = [np.array([tuple(p) for p in v], dtype=float).reshape(-1, 2) for v in rows["points"]]
        width = max((float(o[:, 0].max()) for o in outlines), default=0.0)
        found = defects(Page(rows["id"].tolist(), outlines, [default_baseline(o) for o in outlines], rows["manual"].to_numpy(bool), np.zeros(len(rows), dtype=bool), width))
        return pd.DataFrame(found, columns=["finding", "id", "other", "value"])

    lines = _live(spark, sf_dir).where("part_id IS NOT NULL AND size(points) > 0").join(by_hand, "id")
    return lines.groupBy("part_id").applyInPandas(page, "finding string, id string, other string, value double")


@query()
def model_lines_inserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order of each page when lines without origin are kept in place and those of a run are put in between."""
    origin = table(spark, sf_dir, "live_lines").where("id IS NOT NULL").groupBy("id").agg(F.max("segmentation_run_id").isNotNull().alias("new"), F.min("line_order").alias("line_order"))

    def page(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["new", "line_order", "id"])
        boxes = rows[["x0", "y0", "x1", "y1"]].to_numpy(float)
        n = int((~rows["new"]).sum())
        order = inserted_order(boxes[:n], boxes[n:])
        return pd.DataFrame({"id": rows["id"].to_numpy()[order], "position": range(len(order))})

    return _boxes(spark, sf_dir).where("part_id IS NOT NULL AND x0 IS NOT NULL").join(origin, "id").groupBy("part_id").applyInPandas(page, "id string, position bigint")


_AREA = "(x1 - x0) * (y1 - y0)"


@query(f"""
WITH b AS ({_BOXES}) SELECT a.id AS a, b.id AS b, round((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) / least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)), 4) AS ratio
FROM b a JOIN b ON a.part_id = b.part_id AND a.id < b.id WHERE greatest(a.x0, b.x0) < least(a.x1, b.x1) AND greatest(a.y0, b.y0) < least(a.y1, b.y1)
AND (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) >= 0.2 * least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0))
""")
def shared_ratio_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of lines whose boxes share a fifth of the smaller one: a grid join, then the ratio."""
    b = _boxes(spark, sf_dir)
    sizes = b.select("id", F.expr(_AREA).alias("size"))
    pairs = box_pairs(b, ["part_id"], "id")
    for side in ("a", "b"):
        pairs = pairs.join(sizes.select(F.col("id").alias(side), F.col("size").alias(f"{side}_size")), side)
    ratio = F.col("shared") / F.least("a_size", "b_size")
    return pairs.where(F.col("shared") >= 0.2 * F.least("a_size", "b_size")).select("a", "b", F.round(ratio, 4).alias("ratio"))


_PITCH = f"SELECT part_id, median(gap) AS pitch FROM (SELECT part_id, lead(y0) OVER (PARTITION BY part_id ORDER BY y0, id) - y0 AS gap FROM ({_BOXES})) WHERE gap > 0 GROUP BY 1"


def _pitch(boxes: DataFrame) -> DataFrame:
    gap = F.lead("y0").over(Window.partitionBy("part_id").orderBy("y0", "id")) - F.col("y0")
    return boxes.select("part_id", gap.alias("gap")).where("gap > 0").groupBy("part_id").agg(F.median("gap").alias("pitch"))


@query(f"""
WITH b AS ({_BOXES}), p AS ({_PITCH}) SELECT a.id AS a, b.id AS b, abs((a.y0 + a.y1) - (b.y0 + b.y1)) / 2 <= 0.3 * p.pitch AS strict FROM b a JOIN b ON a.part_id = b.part_id AND a.id < b.id JOIN p ON p.part_id = a.part_id
WHERE least(a.x1, b.x1) - greatest(a.x0, b.x0) >= 0.5 * least(a.x1 - a.x0, b.x1 - b.x0) AND abs((a.y0 + a.y1) - (b.y0 + b.y1)) / 2 <= 0.6 * p.pitch
""")
def pitch_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that share half their x range within 0.6 of the page's own pitch, strict within 0.3: a hash join on page and band.

    The band is as high as the loose bound, so a line meets its own and the neighbouring bands only.
    """
    b = _boxes(spark, sf_dir)
    b = b.join(_pitch(b), "part_id").withColumn("mid", (F.col("y0") + F.col("y1")) / 2).withColumn("band", F.floor(F.col("mid") / (0.6 * F.col("pitch"))))
    left = b.select("part_id", "pitch", F.col("id").alias("a"), F.col("x0").alias("ax0"), F.col("x1").alias("ax1"), F.col("mid").alias("am"), F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    right = b.select("part_id", F.col("id").alias("b"), F.col("x0").alias("bx0"), F.col("x1").alias("bx1"), F.col("mid").alias("bm"), "band")
    shared = F.least("ax1", "bx1") - F.greatest("ax0", "bx0")
    apart = F.abs(F.col("am") - F.col("bm"))
    near = (shared >= 0.5 * F.least(F.col("ax1") - F.col("ax0"), F.col("bx1") - F.col("bx0"))) & (apart <= 0.6 * F.col("pitch"))
    return left.join(right, ["part_id", "band"]).where(near & (F.col("a") < F.col("b"))).select("a", "b", (apart <= 0.3 * F.col("pitch")).alias("strict"))


_HALVES = "SELECT part_id, min(x0) AS low, max(x1) AS high FROM b GROUP BY 1"


def _halves(boxes: DataFrame) -> DataFrame:
    """Two columns of each page, its left and right half."""
    page = boxes.groupBy("part_id").agg(F.min("x0").alias("low"), F.max("x1").alias("high"))
    middle = (F.col("low") + F.col("high")) / 2
    bands = F.array(F.struct(F.lit(0).alias("band"), F.col("low").alias("a"), middle.alias("b")), F.struct(F.lit(1).alias("band"), middle.alias("a"), F.col("high").alias("b")))
    return page.select("part_id", F.explode(bands).alias("c")).select("part_id", "c.band", F.col("c.a").alias("a"), F.col("c.b").alias("b"))


@query(f"""
WITH b AS ({_BOXES}), h AS ({_HALVES}), c AS (SELECT part_id, 0 AS band, low AS a, (low + high) / 2 AS z FROM h UNION ALL SELECT part_id, 1, (low + high) / 2, high FROM h),
o AS (SELECT id, x1 - x0 AS w, band, greatest(0, least(x1, z) - greatest(x0, a)) AS held, greatest(0, a - x1, x0 - z) AS gap FROM b JOIN c USING (part_id)),
r AS (SELECT id, w, arg_max(band, (held, -band)) AS best, max(held) AS held, arg_min(band, (gap, band)) AS nearest FROM o GROUP BY 1, 2)
SELECT id, CASE WHEN held > 0 AND held >= 0.5 * w THEN CAST(best AS INTEGER) END AS band, CAST(nearest AS INTEGER) AS nearest FROM r
""")
def band_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column that holds at least half of each line, and the nearest one, of two halves of the page."""
    b = _boxes(spark, sf_dir)
    met = b.select("part_id", "id", "x0", "x1").join(_halves(b), "part_id")
    held = F.greatest(F.lit(0.0), F.least("x1", "b") - F.greatest("x0", "a"))
    gap = F.greatest(F.lit(0.0), F.col("a") - F.col("x1"), F.col("x0") - F.col("b"))
    r = met.groupBy("id", (F.col("x1") - F.col("x0")).alias("w")).agg(F.max(F.struct(held.alias("held"), (-F.col("band")).alias("band"))).alias("m"), F.min(F.struct(gap.alias("gap"), "band")).alias("n"))
    return r.select("id", F.when((F.col("m.held") > 0) & (F.col("m.held") >= 0.5 * F.col("w")), -F.col("m.band")).alias("band"), F.col("n.band").alias("nearest"))


_RUN_BOXES = """SELECT r.part_id, l.external_id AS ext, list_min(list_transform(l.points, lambda p: p[1])) AS x0, list_min(list_transform(l.points, lambda p: p[2])) AS y0, list_max(list_transform(l.points, lambda p: p[1])) AS x1, list_max(list_transform(l.points, lambda p: p[2])) AS y1
FROM (SELECT part_id, unnest(max(struct_pack(created_at := created_at, id := id, run_lines := run_lines)).run_lines) AS l FROM segmentation_runs WHERE part_id IS NOT NULL GROUP BY 1) r WHERE l.external_id IS NOT NULL AND l.points IS NOT NULL"""


def _run_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of the lines of each page's newest run."""
    from codexlake.functions.geometry import box

    runs = table(spark, sf_dir, "segmentation_runs").where("part_id IS NOT NULL").groupBy("part_id").agg(F.max(F.struct("created_at", "id", "run_lines")).alias("r"))
    lines = runs.select("part_id", F.explode("r.run_lines").alias("l")).select("part_id", F.col("l.external_id").alias("ext"), F.col("l.points").alias("points")).where("ext IS NOT NULL AND points IS NOT NULL")
    return lines.select("part_id", "ext", *[c.alias(n) for n, c in box("points").items()])


_MEET = "least(l.x1, r.x1) > greatest(l.x0, r.x0) AND least(l.y1, r.y1) > greatest(l.y0, r.y0)"
_SHARED = "(least(l.x1, r.x1) - greatest(l.x0, r.x0)) * (least(l.y1, r.y1) - greatest(l.y0, r.y0))"
_RUN_PAIRS = f"SELECT l.part_id, l.id, r.ext, {_SHARED} AS shared, (l.x1 - l.x0) * (l.y1 - l.y0) AS l_size, (r.x1 - r.x0) * (r.y1 - r.y0) AS r_size FROM l JOIN r ON l.part_id = r.part_id AND {_MEET}"


def _run_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Live boxes, run boxes and the pairs of a page that meet, in bands of y."""
    live, run = _boxes(spark, sf_dir), _run_boxes(spark, sf_dir)

    def spread(df: DataFrame, side: str, key: str) -> DataFrame:
        cells = F.explode(F.sequence(F.floor(F.col("y0") / 128), F.floor(F.col("y1") / 128))).alias("cell")
        return df.select("part_id", F.col(key), *[F.col(c).alias(f"{side}_{c}") for c in ("x0", "y0", "x1", "y1")], cells)

    top, bottom = F.greatest("l_y0", "r_y0"), F.least("l_y1", "r_y1")
    wide = F.least("l_x1", "r_x1") - F.greatest("l_x0", "r_x0")
    met = spread(live, "l", "id").join(spread(run, "r", "ext"), ["part_id", "cell"]).where((wide > 0) & (bottom > top) & (F.floor(top / 128) == F.col("cell")))
    size = {s: ((F.col(f"{s}_x1") - F.col(f"{s}_x0")) * (F.col(f"{s}_y1") - F.col(f"{s}_y0"))).alias(f"{s}_size") for s in "lr"}
    return live, run, met.select("part_id", "id", "ext", (wide * (bottom - top)).alias("shared"), *size.values())


@query(f"""
WITH l AS ({_BOXES}), r AS ({_RUN_BOXES}), p AS ({_RUN_PAIRS}) SELECT l.id, coalesce(max(p.shared / p.l_size), 0) >= 0.5 AS covered, round(coalesce(max(p.shared / p.l_size), 0), 4) AS best FROM l LEFT JOIN p ON p.id = l.id WHERE l.part_id IN (SELECT part_id FROM r) GROUP BY 1
""")
def covered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live lines that a single line of the newest run covers by half: a merge skips them as redrawn."""
    live, run, pairs = _run_pairs(spark, sf_dir)
    best = pairs.groupBy("id").agg(F.max(F.col("shared") / F.col("l_size")).alias("best"))
    b = F.coalesce("best", F.lit(0.0))
    return live.join(run.select("part_id").distinct(), "part_id", "left_semi").join(best, "id", "left").select("id", (b >= 0.5).alias("covered"), F.round(b, 4).alias("best"))


_IOU = "shared / (l_size + r_size - shared)"


@query(f"""
WITH l AS ({_BOXES}), r AS ({_RUN_BOXES}), p AS ({_RUN_PAIRS}), b AS (SELECT r.part_id, r.ext, coalesce(max({_IOU}), 0) AS iou FROM r LEFT JOIN p ON p.part_id = r.part_id AND p.ext = r.ext GROUP BY 1, 2)
SELECT count(*) AS n, round(avg(iou), 4) AS mean_iou, round(median(iou), 4) AS median_iou, round(avg(CAST(iou >= 0.5 AS DOUBLE)), 4) AS at_50, round(avg(CAST(iou >= 0.7 AS DOUBLE)), 4) AS at_70, count(*) FILTER (WHERE iou = 0) AS unmatched FROM b
""")
def iou_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best box overlap of every line of the newest runs: mean, median and shares."""
    _, run, pairs = _run_pairs(spark, sf_dir)
    best = pairs.groupBy("part_id", "ext").agg(F.max(F.expr(_IOU)).alias("iou"))
    b = run.select("part_id", "ext").distinct().join(best, ["part_id", "ext"], "left").select(F.coalesce("iou", F.lit(0.0)).alias("iou"))
    share = [F.round(F.avg((F.col("iou") >= t).cast("double")), 4).alias(n) for t, n in ((0.5, "at_50"), (0.7, "at_70"))]
    return b.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("iou"), 4).alias("mean_iou"), F.round(F.median("iou"), 4).alias("median_iou"), *share, F.count_if(F.col("iou") == 0).alias("unmatched"))


@query(f"""
WITH l AS ({_BOXES}), r AS ({_RUN_BOXES}), p AS (SELECT * FROM ({_RUN_PAIRS}) WHERE shared >= 0.5 * least(l_size, r_size)),
pages AS (SELECT DISTINCT part_id FROM r), a AS (SELECT l.part_id, l.id, count(DISTINCT p.ext) AS n FROM l JOIN pages USING (part_id) LEFT JOIN p ON p.id = l.id GROUP BY 1, 2), c AS (SELECT r.part_id, r.ext, count(DISTINCT p.id) AS n FROM r LEFT JOIN p ON p.part_id = r.part_id AND p.ext = r.ext GROUP BY 1, 2)
SELECT coalesce(x.part_id, y.part_id) AS part_id, coalesce(missed, 0) AS missed, coalesce(duplicates, 0) AS duplicates, coalesce(spurious, 0) AS spurious, coalesce(merges, 0) AS merges
FROM (SELECT part_id, count(*) FILTER (WHERE n = 0) AS missed, count(*) FILTER (WHERE n > 1) AS duplicates FROM a GROUP BY 1) x FULL OUTER JOIN (SELECT part_id, count(*) FILTER (WHERE n = 0) AS spurious, count(*) FILTER (WHERE n > 1) AS merges FROM c GROUP BY 1) y ON x.part_id = y.part_id
""")
def detection_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of each page's newest run against its live lines: missed and doubly found lines, spurious and merged ones."""
    live, run, pairs = _run_pairs(spark, sf_dir)
    met = pairs.where(F.col("shared") >= 0.5 * F.least("l_size", "r_size")).select("part_id", "id", "ext").distinct()
    n = F.count(F.lit(1)).alias("n")
    a = live.select("part_id", "id").join(run.select("part_id").distinct(), "part_id", "left_semi").join(met.groupBy("part_id", "id").agg(n), ["part_id", "id"], "left")
    c = run.select("part_id", "ext").distinct().join(met.groupBy("part_id", "ext").agg(n), ["part_id", "ext"], "left")
    x = a.groupBy("part_id").agg(F.count_if(F.col("n").isNull()).alias("missed"), F.count_if(F.col("n") > 1).alias("duplicates"))
    y = c.groupBy("part_id").agg(F.count_if(F.col("n").isNull()).alias("spurious"), F.count_if(F.col("n") > 1).alias("merges"))
    return x.join(y, "part_id", "full_outer").fillna(0)


@query(f"""
WITH b AS ({_BOXES}), n AS (SELECT part_id, y1 - y0 AS h, greatest(0, y1 - lead(y0) OVER w) AS lap, lead(y1) OVER w - lead(y0) OVER w AS h2 FROM b WINDOW w AS (PARTITION BY part_id ORDER BY y0, id))
SELECT part_id, count(*) AS n_pairs, round(avg(lap / least(h, h2)), 4) AS mean_overlap FROM n WHERE h2 IS NOT NULL AND least(h, h2) > 0 GROUP BY 1
""")
def adjacent_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean overlap of each line with the next one down its page, against the lower of the two."""
    w = Window.partitionBy("part_id").orderBy("y0", "id")
    height = F.col("y1") - F.col("y0")
    n = _boxes(spark, sf_dir).select("part_id", height.alias("h"), F.greatest(F.lit(0.0), F.col("y1") - F.lead("y0").over(w)).alias("lap"), F.lead(height).over(w).alias("h2"))
    lower = F.least("h", "h2")
    return n.where(F.col("h2").isNotNull() & (lower > 0)).groupBy("part_id").agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.avg(F.col("lap") / lower), 4).alias("mean_overlap"))


@query(f"""
WITH b AS ({_BOXES}), m AS (SELECT part_id, median(y1 - y0) AS h, median(x1 - x0) AS w FROM b GROUP BY 1), o AS (SELECT DISTINCT id, max(segmentation_run_id) IS NULL AS manual FROM live_lines WHERE id IS NOT NULL GROUP BY 1)
SELECT rule, count(*) AS removed, count(*) FILTER (WHERE manual) AS false_deletes FROM (SELECT id, CASE WHEN y1 - y0 > 1.2 * h THEN 'tall' WHEN x1 - x0 < 0.6 * w THEN 'narrow' WHEN y1 - y0 < 0.8 * h THEN 'low' END AS rule FROM b JOIN m USING (part_id)) JOIN o USING (id) WHERE rule IS NOT NULL GROUP BY 1
""")
def filter_damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each filter of a chain would remove, and how many lines drawn by hand are among it."""
    b = _boxes(spark, sf_dir)
    m = b.groupBy("part_id").agg(F.median(F.col("y1") - F.col("y0")).alias("h"), F.median(F.col("x1") - F.col("x0")).alias("w"))
    tall, wide = F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")
    rule = F.when(tall > 1.2 * F.col("h"), "tall").when(wide < 0.6 * F.col("w"), "narrow").when(tall < 0.8 * F.col("h"), "low")
    hand = table(spark, sf_dir, "live_lines").where("id IS NOT NULL").groupBy("id").agg(F.max("segmentation_run_id").isNull().alias("manual"))
    return b.join(m, "part_id").select("id", rule.alias("rule")).where("rule IS NOT NULL").join(hand, "id").groupBy("rule").agg(F.count(F.lit(1)).alias("removed"), F.count_if("manual").alias("false_deletes"))


@query("""
SELECT line_id, [greatest(0, list_min(list_transform(polygon, lambda p: p[1])) - 8), greatest(0, list_min(list_transform(polygon, lambda p: p[2])) - 8), least(page_width, list_max(list_transform(polygon, lambda p: p[1])) + 8), least(page_height, list_max(list_transform(polygon, lambda p: p[2])) + 8)] AS crop
FROM (SELECT line_id, max(polygon) AS polygon, max(page_width) AS page_width, max(page_height) AS page_height FROM release_lines WHERE line_id IS NOT NULL AND polygon IS NOT NULL GROUP BY 1)
""")
def crop_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crop of each line: its box with a margin of 8, inside the page."""
    lines = table(spark, sf_dir, "release_lines").where("line_id IS NOT NULL AND polygon IS NOT NULL").groupBy("line_id").agg(*[F.max(c).alias(c) for c in ("polygon", "page_width", "page_height")])
    return lines.select("line_id", padded_box("polygon", 8, "page_width", "page_height").alias("crop"))


def _from_xml(spark: SparkSession, sf_dir: str, of: Callable[[str], list[tuple] | None], schema: str) -> DataFrame:
    """Rows of ``of`` for each bundle, in one narrow pass."""
    columns = [c.split()[0] for c in schema.split(", ")]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(stem, *row) for stem, xml in zip(batch["stem"], batch["xml"], strict=True) for row in of(xml) or ()], columns=["stem", *columns])

    bundles = table(spark, sf_dir, "page_xml_bundles").where("xml IS NOT NULL").select("stem", "xml").distinct()
    return bundles.mapInPandas(rows, "stem string, " + schema)


@query()
def page_xml_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation report of every page file: what a strict reader would stumble over, and where."""
    return _from_xml(spark, sf_dir, page_problems, "problem string, element string").distinct()


@query()
def page_xml_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with text and outline in the reading order that the file names."""
    return _from_xml(spark, sf_dir, lambda xml: [(*row, k) for k, row in enumerate(page_lines(xml) or ())], "region_id string, line_id string, text string, corners int, position int")


@query()
def page_xml_geometric_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines by the height and x of their outlines, whatever the file says."""
    return _from_xml(spark, sf_dir, lambda xml: [(*row, k) for k, row in enumerate(page_lines(xml, by_place=True) or ())], "region_id string, line_id string, text string, corners int, position int")
