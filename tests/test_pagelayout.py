"""Layout of pages on small made pages with known answers, and against plain searches."""

import itertools
import random

import numpy as np
import pytest
from codexlake.functions import geometry as g
from codexlake.functions import outlines as o
from codexlake.functions import pagexml as x
from codexlake.operators import pagelayout as p
from pyspark.sql import functions as F


def box(x0, y0, x1, y1):
    return np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1]], dtype=float)


def test_heights_extents_and_shared_areas():
    line = [(0, 0), (10, 10), (10, 30), (20, 20)]
    assert o.heights_at(line, np.array([-5, 5, 10, 15, 99])).tolist() == [0, 5, 10, 15, 20]
    assert o.baseline_gap([(0, 0), (10, 0)], [(20, 3), (30, 3)]) == 3 and o.baseline_gap([(0, 0)], [(1, 1), (2, 2)]) == float("inf")
    assert o.baseline_relation([(0, 0), (10, 0)], [(5, 2), (15, 2)]) == (0.5, 2.0)
    top, bottom = o.extents_at(box(0, 0, 4, 2), np.array([-1.0, 0, 2]))
    assert np.isnan(top[0]) and top[1:].tolist() == [0, 0] and bottom[1:].tolist() == [2, 2]
    assert o.shared_by_columns(box(0, 0, 4, 2), box(2, 1, 6, 3)) == 2 and o.shared_by_columns(box(0, 0, 1, 1), box(2, 2, 3, 3)) == 0
    rng = np.random.default_rng(2)
    for _ in range(20):
        a, b = (g.hull(rng.random((7, 2)) * 10) for _ in range(2))
        assert o.shared_by_columns(a, b, 60) == pytest.approx(g.area(g.clip(a, b)), abs=0.05)


def test_cuts_and_merges():
    assert g.area(o.cut(box(0, 0, 4, 2), 1, 0, below=True)) == 2 and g.area(o.cut(box(0, 0, 4, 2), 0.5, 1, below=False)) == 6 and len(o.cut(box(0, 0, 1, 1), 5, 0, below=False)) == 0
    assert o.cut_baseline([(0, 0), (40, 40)], 10, 30).tolist() == [[10, 10], [30, 30]] and len(o.cut_baseline([(0, 0), (40, 40)], 10, 15)) == 0
    assert g.area(o.merged_outline([box(0, 0, 4, 2), box(3, 1, 6, 3)])) == pytest.approx(4 * 2 + 3 * 2 - 1, abs=0.01)
    assert g.area(o.merged_outline([box(0, 0, 1, 1), box(3, 0, 4, 1)])) == 4 and len(o.merged_outline([])) == 0
    assert o.merged_baseline([[(0, 0), (10, 0)], [(2, 1), (12, 1)]])[:, 0].tolist() == [0, 12]
    assert o.default_baseline(box(0, 0, 4, 2)).tolist() == [[0, 1.5], [4, 1.5]] and len(o.without_repeats([(0, 0), (0, 0), (1, 1), (0, 0)])) == 2
    assert o.page_baseline([(9.6, 3.2), (-4, 2), (9.9, 3)], box(0, 0, 20, 8), 10, 10).tolist() == [[0, 2], [9, 3]]
    assert o.page_baseline([], box(0, 0, 20, 8), 100, 100).tolist() == [[0, 6], [20, 6]] and np.allclose(o.softmax([[0.0, 0.0]]), 0.5)


def test_column_expressions(spark):
    df = spark.createDataFrame([([[1.0, 2.0]], [[1.5, 5.0]], 9, 7), ([[1.0, 2.0]], [], 9, 7)], "a array<array<double>>, b array<array<double>>, w int, h int")
    assert [r.d for r in df.select(o.greatest_difference("a", "b").alias("d")).collect()] == [3.0, None]
    assert df.select(o.padded_box("a", 3, "w", "h").alias("c")).first().c == [0, 0, 4, 5]


def two_columns():
    left, right = [(0, 10 * i, 40, 10 * i + 8) for i in range(1, 6)], [(50, 10 * i, 90, 10 * i + 8) for i in range(1, 6)]
    return left, right


def test_reading_order_of_columns_and_bands():
    left, right = two_columns()
    boxes = [*right, *left, (0, 0, 90, 8), (0, 90, 90, 98)]
    order = [boxes[i] for i in p.line_order(np.array(boxes))]
    assert order == [(0, 0, 90, 8), *left, *right, (0, 90, 90, 98)]
    assert [boxes[i] for i in p.line_order(np.array(boxes), rtl=True)] == [(0, 0, 90, 8), *right, *left, (0, 90, 90, 98)]
    assert p.line_order(np.zeros((0, 4))) == []
    for seed in range(5):
        random.Random(seed).shuffle(boxes)
        assert [boxes[i] for i in p.line_order(np.array(boxes))] == order


def test_notes_and_initials_join_a_column():
    left, right = two_columns()
    boxes = [*left, *right, (42, 10, 46, 14), (-8, 10, -1, 38)]
    layout = p.columns_and_rows(np.array(boxes))
    assert len(layout.rows) == 2 and not layout.spanning
    assert sorted(i for rows in layout.rows for row in rows for i in row) == list(range(12)) and layout.rows[0][0] == [11, 0, 10]


def test_row_runs_merge_side_by_side_pieces():
    boxes = np.array([(0, 0, 42, 10), (43, 0, 80, 10), (0, 20, 80, 30), (0, 32, 80, 42), (0, 44, 30, 54), (40, 44, 80, 54), (0, 60, 40, 70), (41, 58, 60, 81), *[(0, 90 + 12 * i, 80, 100 + 12 * i) for i in range(7)]])
    runs = {tuple(r) for r in p.row_runs(boxes)}
    # A gap of 10 is too wide at a height of 10, and a line of more than twice the height is no fragment.
    assert runs == {(0, 1), *[(i,) for i in range(2, 15)]} and p.row_runs(np.zeros((0, 4))) == []


def test_overlaps_are_cut_or_dropped():
    shapes = [box(0, 0, 100, 12), box(0, 8, 100, 20), box(0, 40, 100, 52), box(1, 40, 100, 52), box(0, 80, 100, 90)]
    lines = [np.array([[0, y], [100, y]], dtype=float) for y in (8, 17, 49, 49.5, 88)]
    out, dropped, stuck = p.resolve_overlaps(shapes, lines, np.array([1, 1, 1, 2, 1.0]), 10)
    assert dropped.tolist() == [False, False, True, False, False] and not stuck.any()
    assert g.area(g.clip(out[0], out[1])) == pytest.approx(0, abs=1e-9) and [g.area(out[0]), g.area(out[1])] == pytest.approx([1200, 750])  # cut at 12.5, midway between the baselines
    inner, _, stuck = p.resolve_overlaps([box(0, 0, 100, 12), box(40, 2, 60, 10)], [lines[0], np.array([[40, 8], [60, 8.0]])], np.ones(2), 10)
    assert stuck.all() and len(inner) == 2
    assert p.resolve_overlaps([], [], np.zeros(0), 1)[1].tolist() == []


def test_many_stacked_lines_resolve_quickly():
    n = 600
    shapes = [box(0, 10 * i, 500, 10 * i + 13) for i in range(n)]
    lines = [np.array([[0, 10 * i + 9.0], [500, 10 * i + 9.0]]) for i in range(n)]
    out, dropped, stuck = p.resolve_overlaps(shapes, lines, np.ones(n), 10)
    assert not dropped.any() and not stuck.any() and all(g.area(g.clip(a, b)) < 0.2 * 5000 for a, b in itertools.pairwise(out))


def test_suppression_keeps_the_longest():
    lines = [np.array([[0, 0], [100, 0]]), np.array([[60, 1], [110, 1]]), np.array([[0, 40], [100, 40]]), np.array([[200, 0], [220, 0]])]
    assert p.suppressed(lines, 20).tolist() == [False, True, False, False] and p.suppressed([], 1).tolist() == []


def test_topological_order_and_insertion():
    before = np.zeros((4, 4), dtype=bool)
    before[2, 0] = before[0, 1] = True
    assert p.topological_order(before) == [2, 0, 1, 3]
    before[1, 2] = True  # a cycle
    assert sorted(p.topological_order(before)) == [0, 1, 2, 3]
    kept, new = [(0, 0, 10, 5), (0, 20, 10, 25)], [(0, 10, 10, 15), (50, 0, 60, 5), (0, -9, 10, -5)]
    assert p.inserted_order(kept, new) == [4, 0, 2, 1, 3] and p.inserted_order([], new) == [2, 1, 0] and p.inserted_order(kept, []) == [0, 1]


def test_defects_of_a_made_page():
    left, right = two_columns()
    shapes = [box(*b) for b in [*left, *right]]
    names = [f"l{i}" for i in range(5)] + [f"r{i}" for i in range(5)]
    extra = {"span": box(0, 70, 90, 78), "speck": box(44, 30, 45, 33), "piece": box(41, 30.5, 44, 37.5), "lap": box(0, 55, 40, 64), "twice": box(0.5, 10, 40, 18), "hand": box(44, 60, 45, 61)}
    ids = names + list(extra)
    shapes += list(extra.values())
    manual = np.array([i == "hand" for i in ids])
    found = p.defects(p.Page(ids, shapes, [o.default_baseline(s) for s in shapes], manual, np.zeros(len(ids), dtype=bool), 90.0))
    by = {(f, a) for f, a, *_ in found}
    assert {("spanning", "span"), ("suspect", "speck"), ("overlap", "l4")} <= by and "hand" not in {a for _, a in by}
    assert {tuple(sorted((a, b))) for f, a, b, _ in found if f == "duplicate"} == {("l0", "twice")}
    assert p.defects(p.Page([], [], [], np.zeros(0, dtype=bool), np.zeros(0, dtype=bool), 0.0)) == []


PAGE = """<PcGts xmlns="{ns}"><Page imageFilename="i.png"><ReadingOrder><OrderedGroup><RegionRefIndexed regionRef="b"/><RegionRefIndexed regionRef="zz"/></OrderedGroup></ReadingOrder>
<TextRegion id="a"><Coords points="0,0 9,0 9,9"/><TextLine id="a1" custom="nonsense"><Coords points="0,0 9,0 9,9"/><Baseline points="5,5 1,5"/><TextEquiv><Unicode>one</Unicode></TextEquiv></TextLine></TextRegion>
<TextRegion id="b"><TextLine id="b1" custom="readingOrder {{index:2;}}"><Coords points="0,50 9,50 9,59"/><Baseline points="1,55 8,55"/><TextEquiv><Unicode>two</Unicode></TextEquiv></TextLine>
<TextLine id="b2" custom="readingOrder {{index:1;}}"><Coords points="0,20.5 9,20 9,29"/><Baseline points="1,99 8,99"/><TextEquiv><Unicode>three</Unicode></TextEquiv></TextLine><TextLine id="b3"><Coords points="0,0 1,1"/></TextLine></TextRegion></Page></PcGts>"""


def test_page_xml_order_and_problems():
    text = PAGE.format(ns=x.NAMESPACE)
    assert [r[1] for r in x.page_lines(text)] == ["b2", "b1", "a1"] and [r[1] for r in x.page_lines(text, by_place=True)] == ["a1", "b2", "b1"]
    found = set(x.page_problems(text))
    assert found == {
        ("reading order names no region", "zz"), ("reading order leaves a region out", "a"), ("custom is no list of tags", "a1"), ("baseline doesn't run from left to right", "a1"), ("region has no outline", "b"),
        ("custom has a tag that readers act upon", "b1"), ("custom has a tag that readers act upon", "b2"), ("coordinate is no whole number", "b2"), ("baseline leaves its outline", "b2"), ("outline has fewer than 3 points", "b3"), ("no baseline", "b3"), ("no text element", "b3"),
    }
    assert x.page_problems("<a") == [("not well-formed", "")] and x.page_problems(PAGE.format(ns="other"))[0][0].startswith("root is no") and x.page_problems(None) is None
    assert x.page_lines("<a") is None and x.page_lines(None) is None


@pytest.mark.parametrize("name", ["page_line_order", "row_fragments", "overlap_resolution", "repeated_lines", "model_lines_inserted"])
def test_every_line_comes_out_once(name, spark, small):
    from codexlake.plans import registry

    lines = spark.read.parquet(f"{small}/live_lines.parquet").where("id IS NOT NULL AND part_id IS NOT NULL AND size(points) > 0").agg(F.countDistinct("id")).first()[0]
    out = registry.QUERIES[name](spark, small)
    assert out.count() == out.select("id").distinct().count() == lines
