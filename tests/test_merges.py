"""Merges, guarded edits, models as table functions."""

import json

import duckdb
import pytest
from codexlake.operators import models
from codexlake.plans import merges as m
from codexlake.plans import registry
from pyspark.sql import functions as F


def test_segment_merge_keeps_hand_drawn_lines(spark, tmp_path, collected):
    def box(x0, y0, x1, y1):
        return [[float(x0), float(y0)], [float(x1), float(y0)], [float(x1), float(y1)], [float(x0), float(y1)]]

    live = [("hand", "p", 0, box(0, 50, 100, 60), None, None), ("old", "p", 1, box(0, 0, 100, 10), "r", "e"), ("other", "q", 0, box(0, 0, 9, 9), "gone", "e")]
    spark.createDataFrame(live, "id string, part_id string, line_order int, points array<array<double>>, segmentation_run_id string, run_external_id string").write.parquet(str(tmp_path / "live_lines.parquet"))
    runs = [("r1", "p", [("a", 0, box(0, 1, 100, 11)), ("b", 1, box(2, 51, 90, 60)), ("c", 2, box(0, 80, 100, 90))], 1)]
    spark.createDataFrame(runs, "id string, part_id string, run_lines array<struct<external_id: string, line_order: int, points: array<array<double>>>>, t int").selectExpr("id", "part_id", "run_lines", "timestamp_seconds(t) AS created_at").write.parquet(str(tmp_path / "segmentation_runs.parquet"))
    assert collected(m.segment_merge(spark, str(tmp_path))) == [("p", "hand", "kept", 1), ("p", "run:a", "run", 0), ("p", "run:c", "run", 2), ("q", "other", "no run", 0)]


def test_guarded_update(spark, collected):
    base = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (4, "d")], "k int, v string")
    edits = spark.createDataFrame([(1, "x", "a"), (2, "y", None), (3, "z", "other"), (9, "n", None)], "k int, v string, expected string")
    assert collected(m.guarded_update(base, edits, "k", "v")) == [(1, "x", True), (2, "y", True), (3, "c", False), (4, "d", None)]


def test_merged_lines_keep_every_line(spark, small):
    n = m.line_merges(spark, small).agg(F.sum("n_merged"), F.min(F.size("points"))).first()
    assert n[0] == duckdb.sql(f"SELECT count(DISTINCT id) FROM '{small}/live_lines.parquet' WHERE id IS NOT NULL AND part_id IS NOT NULL AND len(points) > 0").fetchall()[0][0] and n[1] >= 3


def test_filters_and_depth(spark):
    with pytest.raises(ValueError, match="unknown filter"):
        m.filtered(spark.range(1), ["none"])
    texts = ["1", "[]", '{"a": [1, {"b": "]]]["}]}', '"[[["', None, r'{"a": "\"[["}', json.dumps([[[[]]]])]
    assert [r.d for r in spark.createDataFrame([(t,) for t in texts], "s string").select(m.json_depth("s").alias("d")).collect()] == [0, 1, 3, 0, None, 1, 4]


def test_states_restore_their_lines(spark, collected):
    lines = spark.createDataFrame([("b", "p", 1, [[1.0, 2.0]], None), ("a", "p", 0, [[1.5, 2.0]], "e"), ("a", "p", 0, [[1.5, 2.0]], "e"), (None, "p", 3, None, None), ("c", None, 3, None, None)], "id string, part_id string, line_order int, points array<array<double>>, run_external_id string")
    states = m.built_states(lines)
    assert [x["id"] for x in json.loads(states.first().state)["lines"]] == ["a", "b"]
    assert collected(m.restored_lines(states)) == [("p", "a", 0, [[1.5, 2.0]], "e"), ("p", "b", 1, [[1.0, 2.0]], None)]
    assert m.restored_lines(spark.createDataFrame([("p", "{"), ("q", None)], "part_id string, state string")).count() == 0


def test_models_isolate_bad_rows(spark, collected):
    @models.loader("reverse")
    def load(params):
        def run(text):
            if text == "bad":
                raise ValueError("no")
            return text[::-1] * int(params.get("times", 1))

        return run

    df = spark.createDataFrame([("p", "ab"), ("p", "bad"), ("q", "bad"), ("q", None)], "page string, text string")
    out = models.run_model(df, "reverse", "text", {"times": "2"})
    assert collected(out.select("page", "output", "error")) == [("p", "baba", None), ("p", None, "ValueError: no"), ("q", None, "ValueError: no"), ("q", None, None)]
    assert models.some_succeeded(out.where("page = 'p'"), "page").count() == 2
    with pytest.raises(Exception, match="all rows failed"):
        models.some_succeeded(out, "page").collect()
    assert models.checked({"a": "1"}, {"a": (0, 2)}) == {"a": "1"}
    for params in ({"b": "1"}, {"a": "3"}):
        with pytest.raises(ValueError, match="unknown parameter|is not between"):
            models.checked(params, {"a": (0, 2)})


def test_newest_version(spark):
    df = spark.createDataFrame([("1.9.0",), ("1.10.0",), ("x",)], "v string")
    assert m.newest_version(df.where("v <> 'x'"), "v").first().v == "1.10.0"


def test_regions_hold_every_line(spark, small):
    out = registry.QUERIES["region_membership"](spark, small)
    assert out.where("region IS NULL").count() == 0 and out.select("region").distinct().count() == 2
