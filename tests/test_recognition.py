"""Decoding, voting and bidirectional order on small cases with known answers."""

import random

import numpy as np
import pytest
from codexlake.functions import bidi
from codexlake.functions import recognition as r
from pyspark.sql import functions as F


def test_runs_and_decoding(spark):
    df = spark.createDataFrame([([1, 1, 0, 1, 2], [0.9, 0.5, 0.8, 0.6, 0.4]), ([], []), ([0, 0], [0.1, 0.2])], "l array<int>, s array<double>")
    runs = [[tuple(x) for x in row.r] for row in df.select(r.label_runs("l", "s").alias("r")).collect()]
    assert [(a, b, c, round(m, 3), w) for a, b, c, m, w in runs[0]] == [(1, 0, 1, 0.7, 1), (0, 2, 2, 0.8, 2), (1, 3, 3, 0.6, 3), (2, 4, 4, 0.4, 4)] and runs[1] == []
    out = [row.d for row in df.select(r.decoded("l", "s", "ab").alias("d")).collect()]
    assert (out[0].text, [round(x, 3) for x in out[0].confidences], round(out[0].mean, 4), out[0].least) == ("aab", [0.7, 0.6, 0.4], 0.5667, 0.4) and (out[1].text, out[1].mean) == ("", None) and out[2].text == ""
    top = spark.createDataFrame([([0.1, 0.5, 0.5, 0.2],)], "p array<double>").select(r.best_rivals("p", 3).alias("t")).first().t
    assert [(x.score, x.label) for x in top] == [(0.5, 1), (0.5, 2), (0.2, 3)]
    frames = np.array([[0.1, 0.8, 0.1], [0.9, 0.05, 0.05], [0.1, 0.3, 0.6]])
    assert r.alternatives(frames, "ab", 0.2) == [{"a": 0.8}, {"a": 0.3, "b": 0.6}] and r.alternatives(np.zeros((0, 3)), "ab") == []


def test_votes(spark):
    assert r.majority_text(["abcd", "abxd", "abcd"]) == "abcd" and r.majority_text(["abd", "abcd", "abcd"]) == "abcd" and r.majority_text(["abd", "abd", "abcd"]) == "abd"
    assert r.majority_text([]) == "" and r.majority_text(["", "", "x"]) == "" and r.majority_text(["one"]) == "one"
    text, mean = r.confident_text(["ab", "ax", "ab"], [[0.9, 0.2], [0.9, 0.9], [0.9, 0.3]])
    assert text == "ax" and mean == pytest.approx((0.9 + 0.3) / 2) and r.confident_text([], []) == ("", 0.0)
    df = spark.createDataFrame([(["abc", "abc", "xbc"],), ([],), (None,)], "t array<string>")
    assert [x.v for x in df.select(r.voted("t").alias("v")).collect()] == ["abc", None, None]
    rng = random.Random(3)
    for _ in range(40):
        texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(6))) for _ in range(3)]
        columns = r.aligned_columns(texts)
        assert all("".join(c[v] for c in columns) == t for v, t in enumerate(texts))


A, B, G = "א", "ב", "ג"  # Hebrew letters


@pytest.mark.parametrize(
    ("text", "drawn"),
    [
        ("abc", "abc"), ("", ""), (A + B + G, G + B + A), ("ab " + A + B, "ab " + B + A), (A + B + " 12", "12 " + B + A), (A + " ab " + B, B + " ab " + A), ("a " + A + ", " + B + " c", "a " + B + " ," + A + " c"),
        (A + "(b)" + G, G + ")b(" + A), ("a (" + A + ") b", "a (" + A + ") b"), ("ا12ب", "ب12ا"), ("ܕܒ.", ".ܒܕ"), ("x ⁧" + A + "b⁩ y", "x ⁧b" + A + "⁩ y"),
    ],
)
def test_lines_as_drawn(text, drawn):
    assert bidi.drawn(text) == drawn and sorted(bidi.visual_order(text)) == list(range(len(text)))


def test_levels_by_the_rules():
    assert bidi.levels_of("a" + A + "1") == ([0, 1, 2], 0) and bidi.levels_of(A + "a1") == ([1, 2, 2], 1) and bidi.levels_of("a" + A, 1) == ([2, 1], 1)
    assert bidi.levels_of("‮" + "ab" + "‬" + "c")[0][1:3] == [1, 1]  # an override
    assert bidi.levels_of(A + "-1")[0] == [1, 1, 2] and bidi.levels_of("1$" + A)[0][:2] == [2, 2] and bidi.levels_of(A + " \t" + B)[0] == [1, 1, 1, 1]
    assert max(bidi.levels_of("‫" * 200 + "a")[0]) <= bidi.MOST_DEPTH + 1


def test_permuted_confidences(spark):
    df = spark.createDataFrame([(A + B, [0.1, 0.2]), (None, None)], "t string, c array<double>").withColumn("d", bidi.drawn_column("t"))
    assert [x.c for x in df.select(bidi.permuted("c", F.col("d.order")).alias("c")).collect()] == [[0.2, 0.1], None]
