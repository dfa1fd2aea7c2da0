import itertools
import random

import numpy as np
import pytest
from codexlake.functions import geometry as g
from codexlake.functions import metrics as m
from codexlake.functions import text as t
from codexlake.operators import matching, splitting
from codexlake.operators.components import components
from codexlake.operators.prefix import prefix_sum
from codexlake.operators.relational import islands, keyset_page, latest_per_group, overlay, within_window
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first().y


@pytest.mark.parametrize(
    ("function", "given_", "expected"),
    [
        (t.greek_gt, "Aß· 'b::ˑ–;", "Αϛ· ᾽b:-;".replace("·", "·").replace("᾽", "᾽").replace(";", ";")),
        (t.armenian_gt, "ա-եւ  բ ", "ա֊և բ"),
        (t.armenian_print, "ա.բ:", "ա․բ։"),
        (t.armenian_diplomatic, "ա[բգ]դ ~[աշխարհ] ե{զ]", "ադ՟ ~ ե՟"),
        (t.coptic_gt, " ⲁ ⲃ….ⲅ̄ ", "ⲁ ⲃ·ⲅ︦"),
        (t.syriac_gt, "ܐܰ ܒ.ـܓܺ", "ܐܲ ܒ܁ܓ̣"),
        (t.word_final_sigma, "λόγοσ καὶ σοφόσ́.", "λόγος καὶ σοφός́."),
        (t.loose_key, "Ἀ-b, ϗ ß!", "αbss"),
        (t.slug, "  MS. Gr. 7 ", "ms_gr_7"),
    ],
)
def test_text_functions(spark, function, given_, expected):
    assert one(spark, function("x"), given_) == expected
    assert one(spark, function("x"), None) is None


def test_editorial_rules_collapse_only_touched_rows(spark):
    text, counts = t.greek_editorial("x")
    assert one(spark, text, "α  [12]  <+> <3>¯") == "α ϗ γ̅̅" and one(spark, text, "α  β ") == "α  β "
    assert one(spark, counts["kai"], "<+><++><+>") == 2


@settings(max_examples=60, deadline=None)
@given(st.text("abc", max_size=8), st.text("abc", max_size=8))
def test_alignment_is_cheapest_and_spells_both(a, b):
    ops = m.align(a, b)
    assert "".join(x for _, x, _ in ops) == a and "".join(y for _, _, y in ops) == b
    assert sum(o != "eq" for o, _, _ in ops) == m.edit_distance(a, b) == m.sequence_distance(a, b)


def test_pair_cer_conventions_and_collapse(spark):
    df = spark.createDataFrame([("", ""), ("", "x"), ("ab", "b"), (None, "x")], "r string, p string")
    assert [r.c for r in df.select(m.pair_cer("r", "p").alias("c")).collect()] == [0.0, 1.0, 0.5, 1.0]
    labels = spark.createDataFrame([([1, 1, 0, 1, 2, 2],)], "l array<int>")
    assert labels.select(m.collapse(F.col("l")).alias("c")).first().c == [1, 1, 2]


def test_geometry():
    square, half = np.array([[0, 0], [2, 0], [2, 2], [0, 2]]), np.array([[1, 0], [3, 0], [3, 2], [1, 2]])
    assert g.area(g.hull(np.vstack([square, [[1, 1], [1, 0]]]))) == 4 and g.overlap(square, half) == pytest.approx(1 / 3)
    assert g.inside((1, 1), square) and not g.inside((3, 1), square)
    assert g.y_at(np.array([[0, 0], [2, 2]]), 1) == 1 and g.y_at(np.array([[1, 0], [1, 4], [2, 2]]), 1) == 2
    assert len(g.simplify(np.array([[0, 0], [1, 0.01], [2, 0]]), 0.1)) == 2 and len(g.simplify(np.array([[0, 0], [1, 1], [2, 0]]), 0.1)) == 3


def test_hulls_and_overlaps_of_random_shapes():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 5, 9, 40):
        p = np.round(rng.random((n, 2)) * 9, 1)
        corners = g.hull(p)
        for a, b in zip(corners, np.roll(corners, -1, axis=0), strict=True) if len(corners) > 2 else ():
            assert all((b[0] - a[0]) * (q[1] - a[1]) - (b[1] - a[1]) * (q[0] - a[0]) >= -1e-6 for q in p)
    shapes = [rng.random((6, 2)) * 4 + rng.random(2) * 6 for _ in range(12)]
    assert np.allclose(g.overlaps(shapes, shapes[:5]), [[g.overlap(a, b) for b in shapes[:5]] for a in shapes]) and g.overlaps([], shapes).shape == (0, 12)
    square = np.array([[0, 0], [1, 0], [2, 0], [2, 2], [0, 2], [0, 1]])
    assert g.hull(square).tolist() == [[0, 0], [2, 0], [2, 2], [0, 2]]


def test_optimal_match_equals_brute_force():
    rng = np.random.default_rng(5)
    for n, k in itertools.product(range(1, 5), range(1, 5)):
        s = np.round(rng.random((n, k)), 2)
        found = matching.optimal_match(s, 0.4)
        best = (0, 0.0)
        for cols in itertools.permutations([*range(k), *[None] * n], n):
            pairs = [(i, j) for i, j in enumerate(cols) if j is not None and s[i, j] >= 0.4]
            best = max(best, (len(pairs), round(sum(s[i, j] for i, j in pairs), 6)))
        assert (len(found), round(float(sum(s[i, j] for i, j in found)), 6)) == best
    assert matching.greedy_match(np.array([[0.9, 0.8], [0.85, 0.1]]), 0.5) == [(0, 0)]
    assert matching.optimal_match(np.zeros((0, 2)), 0.5) == []


def test_box_pairs_equal_brute_force(spark):
    rng = random.Random(1)
    boxes = [(rng.choice("pq"), f"b{i}", x := rng.uniform(-300, 900), y := rng.uniform(0, 900), x + rng.uniform(1, 500), y + rng.uniform(1, 90)) for i in range(120)]
    df = spark.createDataFrame(boxes, "page string, id string, x0 double, y0 double, x1 double, y1 double")
    found = {(r.a, r.b) for r in matching.box_pairs(df, ["page"], "id", 100).collect()}
    brute = {(a[1], b[1]) for a in boxes for b in boxes if a[0] == b[0] and a[1] < b[1] and max(a[2], b[2]) < min(a[4], b[4]) and max(a[3], b[3]) < min(a[5], b[5])}
    assert found == brute


def test_reading_order_and_clusters():
    boxes = np.array([[100, 50, 180, 60], [0, 0, 80, 10], [0, 20, 80, 30], [100, 0, 180, 10]])
    assert matching.reading_order(boxes) == [1, 2, 3, 0] and matching.reading_order(np.zeros((0, 4))) == []
    assert matching.cluster_centres([1, 2, 10, 11], 2) == [1.5, 10.5] and matching.cluster_centres([], 2) == []


def test_split_allocation():
    assert splitting.allocate(10, (0.8, 0.1, 0.1)) == [8, 1, 1] and splitting.allocate(3, (0.98, 0.01, 0.01)) == [1, 1, 1]
    choice = splitting.exhaustive([80, 10, 10], (0.8, 0.1, 0.1))
    assert sorted(choice) == [0, 1, 2] and choice[0] == 0
    assert set(splitting.greedy([1] * 10, (0.8, 0.9))) == {0, 1, 2} and splitting.greedy([], (0.8, 0.9)) == []
    with pytest.raises(ValueError, match="groups"):
        splitting.exhaustive([1] * 13, (0.8, 0.1, 0.1))


def test_components_equal_union_find(spark):
    rng = random.Random(2)
    edges = [(f"r{i}", f"e{rng.randrange(40)}") for i in range(30) for _ in range(2)] + [(f"c{i}", f"n{j:03d}") for i in range(60) for j in (i, i + 1)] + [(None, "e0"), ("r0", None)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r, e in edges:
        if r and e:
            a, b = sorted((find("~" + r), find(e)), reverse=True)
            parent[a] = b
    groups = {e: find(e) for _, e in edges if e and any(x[1] == e and x[0] for x in edges)}
    found = {r.entity: r.component for r in components(spark.createDataFrame(edges, "record string, entity string")).collect()}
    assert {k: v for k, v in found.items()} == {k: min(e for e in groups if groups[e] == v) for k, v in groups.items()}
    assert components(spark.createDataFrame([], "record string, entity string")).count() == 0


def test_prefix_sum_equals_running_total(spark):
    rng = random.Random(4)
    data = [(rng.choice("ab"), rng.randrange(-(2**62), 2**62), rng.choice([None, 1, 5])) for _ in range(500)]
    found = {(r.g, r.h): r.s for r in prefix_sum(spark.createDataFrame(data, "g string, h bigint, v int"), ["g"], "h", "v", "s", 16).collect()}
    for grp in "ab":
        total = 0
        for _, h, v in sorted((x for x in data if x[0] == grp), key=lambda x: x[1]):
            assert found[grp, h] == total
            total += v or 0


def test_relational_blocks(spark, collected):
    df = spark.createDataFrame([(i, i % 3) for i in range(10)], "k int, v int")
    page = keyset_page(df, ["k"], (7,), 3).collect()
    assert sorted(r.k for r in page) == [4, 5, 6] and all(r.has_more for r in page)
    assert not any(r.has_more for r in keyset_page(df, ["k"], (2,), 5).collect())
    assert collected(latest_per_group(df, ["v"], ["k"])) == [(0, 9), (1, 7), (2, 8)]
    runs = spark.createDataFrame([(1, i, v) for i, v in enumerate(["a", "a", None, None, "a"])], "g int, i int, v string")
    assert collected(islands(runs, ["g"], ["i"], "v")) == [(1, 0, "a", 2), (1, 1, None, 2), (1, 2, "a", 1)]
    new = spark.createDataFrame([(1, None), (20, 5)], "k int, v int")
    assert collected(overlay(df, new, ["k"], ["v"])) == [(1, 1), (20, 5)]
    times = spark.sql("SELECT timestamp_seconds(x) AS at, 1 AS g FROM VALUES (0), (5), (11) AS t(x)")
    assert sorted(r.n for r in times.select(within_window(times, ["g"], "at", 10).alias("n")).collect()) == [1, 2, 2]
