"""Merges and edits of layers as pure transitions: run lines into live ones, callbacks, line merges, reorders, states.

There are no row locks: who may write is decided outside, a transition says what the rows are afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codexlake.functions.geometry import inside
from codexlake.functions.outlines import default_baseline
from codexlake.functions.recognition import decoded, label_runs
from codexlake.functions.text import artifact_ref, barred_expansions, decode_cursor, encode_cursor, redact_log, sigma_spaces, version_key, version_verdict
from codexlake.operators.pagelayout import merged_line, row_runs
from codexlake.plans.catalog import query
from codexlake.plans.layout import _live
from codexlake.plans.pages import _run_pairs
from codexlake.runtime import table


@query()
def segment_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live lines after the newest run is merged in: lines drawn by hand stay, machine lines are replaced by those of the run
    that no kept line covers by half, and all are numbered anew from the top of the page."""
    live, run, pairs = _run_pairs(spark, sf_dir)
    by_hand = table(spark, sf_dir, "live_lines").where("id IS NOT NULL").groupBy("id").agg(F.max("segmentation_run_id").isNull().alias("manual")).where("manual").select("id")
    kept = live.join(by_hand, "id", "left_semi")
    covered = pairs.join(by_hand, "id", "left_semi").where(F.col("shared") >= 0.5 * F.col("r_size")).select("part_id", "ext").distinct()
    new = run.join(covered, ["part_id", "ext"], "left_anti").dropDuplicates(["part_id", "ext"])
    rest = live.join(by_hand, "id", "left_anti").join(run.select("part_id").distinct(), "part_id", "left_anti")
    parts = [kept.select("part_id", F.col("id").alias("line"), "x0", "y0", F.lit("kept").alias("origin")), rest.select("part_id", F.col("id").alias("line"), "x0", "y0", F.lit("no run").alias("origin")), new.select("part_id", F.concat(F.lit("run:"), "ext").alias("line"), "x0", "y0", F.lit("run").alias("origin"))]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2])
    order = F.row_number().over(Window.partitionBy("part_id").orderBy("y0", "x0", "line")) - 1
    return merged.select("part_id", "line", "origin", order.cast("bigint").alias("position"))


@query("""
WITH r AS (SELECT response_id, line_id, max(text) AS text, max(len(character_confidences)) AS n FROM transcribe_responses GROUP BY 1, 2), k AS (SELECT DISTINCT line_id FROM release_lines WHERE line_id IS NOT NULL)
SELECT r.response_id, r.line_id, CASE WHEN r.line_id IS NULL OR k.line_id IS NULL THEN 'unknown line' WHEN text IS NULL OR length(trim(text)) = 0 THEN 'no text' WHEN n IS NULL THEN 'no scores' WHEN n <> length(text) THEN 'scores dropped' ELSE 'written' END AS outcome FROM r LEFT JOIN k ON k.line_id = r.line_id
""")
def callback_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a callback does with each result: validated against the lines there are, its text and its scores."""
    r = table(spark, sf_dir, "transcribe_responses").groupBy("response_id", "line_id").agg(F.max("text").alias("text"), F.max(F.when(F.col("character_confidences").isNotNull(), F.size("character_confidences"))).alias("n"))
    known = table(spark, sf_dir, "release_lines").where("line_id IS NOT NULL").select("line_id", F.lit(True).alias("there")).distinct()
    outcome = F.when(F.col("there").isNull(), "unknown line").when(F.coalesce(F.length(F.trim("text")), F.lit(0)) == 0, "no text").when(F.col("n").isNull(), "no scores").when(F.col("n") != F.length("text"), "scores dropped").otherwise("written")
    return r.join(known, "line_id", "left").select("response_id", "line_id", outcome.alias("outcome"))


@query()
def line_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines after the fragments of each row are merged: the widest survives with one outline and baseline around all."""

    def page(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        shapes = [np.array([tuple(p) for p in v], dtype=float) for v in rows["points"]]
        boxes = np.array([[*s.min(axis=0), *s.max(axis=0)] for s in shapes]).reshape(-1, 4)
        out = []
        for run in row_runs(boxes):
            widest = max(run, key=lambda i: (boxes[i, 2] - boxes[i, 0], -i))
            outline, base = merged_line([shapes[i] for i in run], [default_baseline(shapes[i]) for i in run]) if len(run) > 1 else (shapes[run[0]], default_baseline(shapes[run[0]]))
            out.append((rows["id"].iloc[widest], len(run), outline.round(2).tolist(), base.round(2).tolist()))
        return pd.DataFrame(out, columns=["id", "n_merged", "points", "baseline"])

    return _live(spark, sf_dir).where("part_id IS NOT NULL AND size(points) > 0").groupBy("part_id").applyInPandas(page, "id string, n_merged bigint, points array<array<double>>, baseline array<array<double>>")


def guarded_update(base: DataFrame, edits: DataFrame, key: str, value: str) -> DataFrame:
    """Edits whose ``expected`` value is still there win; others change nothing: ``key``, ``value``, ``applied`` (null: no edit)."""
    e = edits.select(key, F.col(value).alias("__new"), "expected", F.lit(True).alias("__sent"))
    same = F.col(value).eqNullSafe(F.col("expected"))
    j = base.join(e, key, "left")
    return j.select(key, F.when(F.col("__sent") & same, F.col("__new")).otherwise(F.col(value)).alias(value), F.when(F.col("__sent"), same).alias("applied"))


@query("""
WITH b AS (SELECT line_id, max(text) AS text FROM release_lines WHERE line_id IS NOT NULL GROUP BY 1), e AS (SELECT line_id, max_by(coalesce(text, ''), response_id) AS new, min_by(coalesce(text, ''), response_id) AS expected FROM transcribe_responses WHERE line_id IS NOT NULL GROUP BY 1)
SELECT b.line_id, CASE WHEN e.line_id IS NOT NULL AND b.text IS NOT DISTINCT FROM e.expected THEN e.new ELSE b.text END AS text, CASE WHEN e.line_id IS NOT NULL THEN b.text IS NOT DISTINCT FROM e.expected END AS applied FROM b LEFT JOIN e USING (line_id)
""")
def guarded_text_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text edits that count only where the text is still the one they were made on."""
    b = table(spark, sf_dir, "release_lines").where("line_id IS NOT NULL").groupBy("line_id").agg(F.max("text").alias("text"))
    own = F.coalesce("text", F.lit(""))
    e = table(spark, sf_dir, "transcribe_responses").where("line_id IS NOT NULL").groupBy("line_id").agg(F.max_by(own, "response_id").alias("text"), F.min_by(own, "response_id").alias("expected"))
    return guarded_update(b, e, "line_id", "text")


@query("""
SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END, o_orderdate, o_orderkey) AS position FROM orders
""")
def reordered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New positions of each owner's pages from a wanted order, those it doesn't name after the others."""
    wanted = F.when(F.col("o_orderpriority") == "1-URGENT", 0).otherwise(1)
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(wanted, "o_orderdate", "o_orderkey")).cast("bigint").alias("position"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) = 1) GROUP BY 1, 2")
def single_blocks_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines after groups of a single one are removed: a count, then an anti-join."""
    lines = table(spark, sf_dir, "lineitem")
    single = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).where("n = 1")
    return lines.join(single, "l_orderkey", "left_anti").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id FROM events WHERE NOT (event_type IN ('purchase', 'signup') AND user_id = 7)")
def own_jobs_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs after the ended ones of one user are deleted; rows whose type or user is null stay."""
    ended = F.coalesce(F.col("event_type").isin("purchase", "signup") & (F.col("user_id") == 7), F.lit(False))
    return table(spark, sf_dir, "events").where(~ended).select("event_id")


@query("SELECT count(*) FILTER (WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 20 DAY AND event_type = 'signup') AS expired, count(*) FILTER (WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 20 DAY OR event_type <> 'signup') AS live FROM events")
def expired_pairings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished pairings past the cutoff, and what is left."""
    events = table(spark, sf_dir, "events")
    last = events.agg(F.max("ts").alias("last"))
    gone = (F.col("ts") < F.col("last") - F.expr("INTERVAL 20 DAYS")) & (F.col("event_type") == "signup")
    return events.join(F.broadcast(last)).agg(F.count_if(gone).alias("expired"), F.count_if(~gone).alias("live"))


@query()
def region_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region of each live line by where the mean of its corners lies, the first of two halves of its page that holds it."""

    def page(rows: pd.DataFrame) -> pd.DataFrame:
        shapes = [np.array([tuple(p) for p in v], dtype=float) for v in rows["points"]]
        low, high = np.min([s.min(axis=0) for s in shapes], axis=0), np.max([s.max(axis=0) for s in shapes], axis=0)
        middle = (low[0] + high[0]) / 2
        regions = [np.array([[a, low[1] - 1], [b, low[1] - 1], [b, high[1] + 1], [a, high[1] + 1]]) for a, b in ((low[0] - 1, middle), (middle, high[0] + 1))]
        found = [next((k for k, r in enumerate(regions) if inside(tuple(s.mean(axis=0)), r)), None) for s in shapes]
        return pd.DataFrame({"id": rows["id"], "region": pd.array(found, dtype="Int64")})

    return _live(spark, sf_dir).where("part_id IS NOT NULL AND size(points) > 0").groupBy("part_id").applyInPandas(page, "id string, region bigint")


# Rules of the filter chain, in their order; each sees what the ones before it left.
FILTERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def filter_rule(name: str) -> Callable:
    def enter(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        FILTERS[name] = f
        return f

    return enter


@filter_rule("flat")
def _flat(boxes: DataFrame) -> DataFrame:
    return boxes.where("y1 - y0 >= 20")


@filter_rule("narrow")
def _narrow(boxes: DataFrame) -> DataFrame:
    m = boxes.groupBy("part_id").agg(F.median(F.col("x1") - F.col("x0")).alias("w"))
    return boxes.join(m, "part_id").where("x1 - x0 >= 0.5 * w").drop("w")


@filter_rule("outlying")
def _outlying(boxes: DataFrame) -> DataFrame:
    m = boxes.groupBy("part_id").agg(F.median("x0").alias("x"))
    return boxes.join(m, "part_id").where("abs(x0 - x) <= 400").drop("x")


def filtered(boxes: DataFrame, rules: Sequence[str]) -> DataFrame:
    """Boxes after a chain of named rules; an unknown name is an error."""
    for name in rules:
        if name not in FILTERS:
            raise ValueError(f"unknown filter {name!r}")
        boxes = boxes.transform(FILTERS[name])
    return boxes


_BOX_SQL = "SELECT id, max(part_id) AS part_id, list_min(list_transform(max(points), lambda p: p[1])) AS x0, list_min(list_transform(max(points), lambda p: p[2])) AS y0, list_max(list_transform(max(points), lambda p: p[1])) AS x1, list_max(list_transform(max(points), lambda p: p[2])) AS y1 FROM live_lines WHERE id IS NOT NULL AND points IS NOT NULL GROUP BY 1"


@query(f"""
WITH b AS ({_BOX_SQL}), f1 AS (SELECT * FROM b WHERE y1 - y0 >= 20), f2 AS (SELECT f1.* FROM f1 JOIN (SELECT part_id, median(x1 - x0) AS w FROM f1 GROUP BY 1) m USING (part_id) WHERE x1 - x0 >= 0.5 * w), f3 AS (SELECT f2.* FROM f2 JOIN (SELECT part_id, median(x0) AS x FROM f2 GROUP BY 1) m USING (part_id) WHERE abs(x0 - x) <= 400)
SELECT id FROM f3
""")
def filter_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that a chain of three filters leaves, each measured on what the one before left."""
    from codexlake.plans.layout import _boxes

    return filtered(_boxes(spark, sf_dir), ["flat", "narrow", "outlying"]).select("id")


@query("""
WITH b AS (SELECT manuscript, page_index, min(bbox[1]) AS x0, min(bbox[2]) AS y0, max(bbox[3]) AS x1, max(bbox[4]) AS y1 FROM release_lines WHERE manuscript IS NOT NULL AND page_index IS NOT NULL AND bbox IS NOT NULL GROUP BY 1, 2),
t AS (SELECT *, unnest(range(0, CAST(greatest(1, ceil((y1 - y0) / 600.0)) AS BIGINT))) AS tile FROM b)
SELECT manuscript, page_index, CAST(tile AS BIGINT) AS tile, x0 - 20 AS left_x, CAST(y0 + 600 * tile - 100 AS BIGINT) AS top_y, x1 + 20 AS right_x, CAST(y0 + 600 * (tile + 1) + 100 AS BIGINT) AS bottom_y FROM t
""")
def page_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping tiles down the padded box around each page's lines."""
    b = F.col("bbox")
    pages = table(spark, sf_dir, "release_lines").where("manuscript IS NOT NULL AND page_index IS NOT NULL AND bbox IS NOT NULL").groupBy("manuscript", "page_index").agg(F.min(b[0]).alias("x0"), F.min(b[1]).alias("y0"), F.max(b[2]).alias("x1"), F.max(b[3]).alias("y1"))
    tiles = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(1), F.ceil((F.col("y1") - F.col("y0")) / 600.0)).cast("bigint") - 1)).alias("tile")
    t = pages.select("*", tiles)
    return t.select("manuscript", "page_index", "tile", (F.col("x0") - 20).alias("left_x"), (F.col("y0") + 600 * F.col("tile") - 100).alias("top_y"), (F.col("x1") + 20).alias("right_x"), (F.col("y0") + 600 * (F.col("tile") + 1) + 100).alias("bottom_y"))


def json_depth(column: str) -> Column:
    """Greatest nesting of a JSON text, by its brackets outside strings; null stays null."""
    bare = F.regexp_replace(F.regexp_replace(column, r'"(?:[^"\\]|\\.)*+"', ""), r"[^\[\]{}]", "")
    steps = F.transform(F.filter(F.split(bare, ""), lambda c: c != ""), lambda c: F.when(c.isin("[", "{"), 1).otherwise(-1))
    end = F.aggregate(steps, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda a, s: F.struct((a["now"] + s).alias("now"), F.greatest(a["most"], a["now"] + s).alias("most")))
    return end["most"]


@query()
def state_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved states by whether they pass the bounds of size and depth."""
    s = table(spark, sf_dir, "annotation_history_snapshots").where("state IS NOT NULL").select("id", "state").distinct()
    verdict = F.when(F.length("state") > 1_000_000, "too long").when(json_depth("state") > 12, "too deep").when(F.try_parse_json("state").isNull(), "malformed").otherwise("admitted")
    return s.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"), F.max(json_depth("state")).alias("deepest"))


STATE_SCHEMA = "lines array<struct<id: string, line_order: int, points: array<array<double>>, run_external_id: string>>"


def built_states(lines: DataFrame) -> DataFrame:
    """One JSON state for each page out of its live lines, in line order."""
    entry = F.struct("line_order", "id", "points", "run_external_id")
    rows = lines.where("part_id IS NOT NULL AND id IS NOT NULL").dropDuplicates(["id"]).groupBy("part_id").agg(F.array_sort(F.collect_list(entry)).alias("l"))
    ordered = F.transform("l", lambda x: F.struct(x["id"].alias("id"), x["line_order"].alias("line_order"), x["points"].alias("points"), x["run_external_id"].alias("run_external_id")))
    return rows.select("part_id", F.to_json(F.struct(ordered.alias("lines"))).alias("state"))


def restored_lines(states: DataFrame) -> DataFrame:
    """The lines of JSON states as rows; states that aren't readable give nothing."""
    return states.select("part_id", F.inline(F.from_json("state", STATE_SCHEMA)["lines"])).select("part_id", "id", "line_order", "points", "run_external_id")


@query("SELECT part_id, id, line_order, len(points) AS n_points FROM (SELECT id, max(part_id) AS part_id, max(line_order) AS line_order, max(points) AS points FROM live_lines WHERE id IS NOT NULL AND part_id IS NOT NULL GROUP BY 1)")
def state_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live lines saved as states and restored from them."""
    back = restored_lines(built_states(table(spark, sf_dir, "live_lines")))
    return back.select("part_id", "id", "line_order", F.size("points").cast("bigint").alias("n_points"))


@query("""
WITH f AS (SELECT user_id, event_id, CAST(json_extract(props, '$.k') AS BIGINT) % 4 AS label, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
c AS (SELECT *, CASE WHEN label IS NOT DISTINCT FROM lag(label) OVER (PARTITION BY user_id ORDER BY i) AND i > 1 THEN 0 ELSE 1 END AS new FROM f), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT user_id, CAST(run - 1 AS BIGINT) AS run, label, CAST(min(i) - 1 AS BIGINT) AS start, CAST(max(i) - 1 AS BIGINT) AS stop, round(avg(value), 4) AS mean, CAST(arg_min(i, (value, i)) - 1 AS BIGINT) AS weakest FROM g GROUP BY user_id, run, label
""")
def ctc_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal labels of each sequence with mean score and weakest frame."""
    label = (F.get_json_object("props", "$.k").cast("bigint") % 4).alias("label")
    seq = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", label, F.col("value").alias("score")))).alias("s"))
    runs = seq.select("user_id", F.transform("s", lambda x: x["label"]).alias("l"), F.transform("s", lambda x: x["score"]).alias("p")).select("user_id", F.posexplode(label_runs("l", "p")).alias("run", "r"))
    return runs.select("user_id", F.col("run").cast("bigint").alias("run"), F.col("r.label").alias("label"), F.col("r.start").cast("bigint").alias("start"), F.col("r.stop").cast("bigint").alias("stop"), F.round("r.mean", 4).alias("mean"), F.col("r.weakest").cast("bigint").alias("weakest"))


@query()
def ctc_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy decoding of each sequence of labels, with mean and least confidence."""
    label = (F.get_json_object("props", "$.k").cast("int") % 4).alias("label")
    seq = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", label, F.col("value").alias("score")))).alias("s"))
    d = seq.select("user_id", decoded(F.transform("s", lambda x: x["label"]), F.transform("s", lambda x: x["score"]), "abc").alias("d"))
    return d.select("user_id", "d.text", F.round("d.mean", 4).alias("mean"), F.col("d.least").alias("least"))


@query("""
WITH v AS (SELECT p_partkey, (p_partkey % 4) || '.' || (p_size % 12) || '.' || (p_partkey % 10) AS v FROM part), n AS (SELECT *, CAST(split_part(v, '.', 1) AS BIGINT) * 10000 + CAST(split_part(v, '.', 2) AS BIGINT) * 100 + CAST(split_part(v, '.', 3) AS BIGINT) AS k FROM v)
SELECT p_partkey, v AS version, CASE WHEN k < 10905 THEN 'below floor' WHEN k < 21000 THEN 'outdated' ELSE 'current' END AS verdict FROM n
""")
def version_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions judged by number, not by alphabet, against a floor and the latest one."""
    v = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(".", (F.col("p_partkey") % 4).cast("string"), (F.col("p_size") % 12).cast("string"), (F.col("p_partkey") % 10).cast("string")).alias("version"))
    return v.select("p_partkey", "version", version_verdict("version", "1.9.5", "2.10.0").alias("verdict"))


@query("SELECT p_partkey, lower(p_brand) AS id, CASE WHEN p_size % 3 = 0 THEN 'stable' ELSE 'v' || p_size END AS tag FROM part WHERE p_brand IS NOT NULL")
def artifact_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry references taken apart; the tag is ``stable`` where none is given."""
    brand = F.regexp_replace(F.lower("p_brand"), "#", "%23")
    ref = F.concat(F.lit("registry://"), brand, F.when(F.col("p_size") % 3 != 0, F.concat(F.lit("?tag=v"), F.col("p_size").cast("string"))).otherwise(F.lit("")))
    parts = table(spark, sf_dir, "part").where("p_brand IS NOT NULL").select("p_partkey", ref.alias("ref")).select("p_partkey", artifact_ref("ref").alias("a"))
    return parts.select("p_partkey", F.regexp_replace("a.id", "%23", "#").alias("id"), F.col("a.tag").alias("tag"))


@query("SELECT o_orderkey, o_totalprice FROM orders")
def cursor_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of every order through the opaque cursor and back."""
    c = table(spark, sf_dir, "orders").select(encode_cursor("o_orderkey", "o_totalprice").alias("c"))
    return c.select(decode_cursor("c", "o_orderkey bigint, o_totalprice double").alias("k")).select("k.*")


@query()
def redacted_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes as log lines, without control characters, addresses, ids, tokens and home paths."""
    notes = table(spark, sf_dir, "feedback").where("id IS NOT NULL").select("id", F.concat_ws(" ", "message", "page_path").alias("line")).distinct()
    return notes.select("id", redact_log("line").alias("line"))


@query()
def ink_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that editorial expansions or missing spaces change, in the form of the ink."""
    lines = table(spark, sf_dir, "release_lines").where("text IS NOT NULL").select("line_id", "text").distinct()
    ink = sigma_spaces(barred_expansions("text"))
    return lines.select("line_id", "text", ink.alias("ink")).where("ink <> text").select("line_id", "ink")


def newest_version(df: DataFrame, column: str) -> DataFrame:
    """The greatest version of a column by number."""
    return df.select(F.max_by(column, version_key(column)).alias(column))
