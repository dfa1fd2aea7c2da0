"""Preparation steps against plain Python."""

import itertools
import random
import unicodedata
from collections import Counter, defaultdict

import duckdb
import pytest
from codexlake.functions import text as t
from codexlake.operators import splitting
from codexlake.plans import preparation as p
from codexlake.plans import records
from pyspark.sql import functions as F


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first().y


def test_survivors_follow_chains(spark, collected):
    long = "abcdefghij klmnopqrst uvw"
    rows = [(1, "b", long), (2, "a", long), (3, "c", long.upper() + "!"), (4, "0", long + " ."), (5, "z", "short"), (6, "y", "SHORT"), (7, "x", "short")]
    df = spark.createDataFrame(rows, "row_id long, output_name string, text string")
    assert collected(p.survivors(df)) == [(1, 4, "exact"), (2, 4, "near"), (3, 4, "near"), (4, 4, "kept"), (5, 7, "exact"), (6, 6, "kept"), (7, 7, "kept")]
    assert p.survivors(df.limit(0)).count() == 0


def test_near_leakage_equals_brute_force(spark, small):
    def fuzzy(x):
        return "".join(c for c in unicodedata.normalize("NFKD", x).casefold() if unicodedata.category(c)[0] not in "MPZSC")

    rows = [(records.SPLIT_NAMES.get((s or "").strip().lower()), x, fuzzy(x)) for s, x in duckdb.sql(f"SELECT split, text FROM '{small}/import_rows.parquet' WHERE text IS NOT NULL AND output_name IS NOT NULL").fetchall()]
    texts, keys = {x for s, x, _ in rows if s == "train"} - {""}, {k for s, _, k in rows if s == "train"} - {""}
    found = {r.split: (r.n, r.text_leaks, r.near_leaks) for r in p.near_leakage(spark, small).collect()}
    for split in ("val", "test"):
        own = [r for r in rows if r[0] == split]
        assert found[split] == (len(own), sum(x in texts for _, x, _ in own), sum(k in keys for *_, k in own))


def test_greedy_holds_groups_back():
    assert splitting.greedy([1] * 20, (0.8, 0.9)) == [0] * 16 + [1] * 2 + [2] * 2
    assert splitting.greedy([90, 5, 5], (0.8, 0.9)) == [0, 1, 2] and splitting.greedy([1, 1, 98], (0.8, 0.9)) == [0, 1, 2] and splitting.greedy([], (0.8, 0.9)) == []
    rng = random.Random(4)
    for _ in range(50):
        sizes = [rng.randrange(1, 30) for _ in range(rng.randrange(3, 40))]
        out = splitting.greedy(sizes, (0.8, 0.9))
        assert out == sorted(out) and set(out) == {0, 1, 2}
    assert splitting.merge_undersized({"a": 2, "b": 9, "c": 9, "d": 3}, 3) == {"a": "b", "b": "b", "c": "c", "d": "d"} and splitting.merge_undersized({}, 3) == {}


def test_components_stay_whole(spark, small, monkeypatch):
    for most in (p.MOST_PLACED, 0):
        monkeypatch.setattr(p, "MOST_PLACED", most)
        rows = p.component_splits(spark, small).collect()
        texts = dict(duckdb.sql(f"SELECT row_id, text FROM '{small}/import_rows.parquet'").fetchall())
        splits, of = defaultdict(set), defaultdict(set)
        for r in rows:
            splits[r.component].add(r.split)
            of[texts[r.row_id]].add(r.split)
        assert len(rows) == len({r.row_id for r in rows}) and all(len(s) == 1 for s in [*splits.values(), *of.values()])
        assert set(Counter(r.split for r in rows)) <= set(p.SPLITS)


def test_partition_splits_fill_every_split(spark, small):
    by = defaultdict(Counter)
    for r in p.partition_splits(spark, small).collect():
        by[r.manuscript, r.part][r.split] += 1
    assert by and all(len(c) == 3 for c in by.values() if sum(c.values()) >= 3)


@pytest.mark.parametrize(
    ("function", "given_", "expected"),
    [
        (t.fuzzy_key, "Ἀ-b, ﬁ ß!‍", "αbfiss"), (t.nfc_changes, "éa", ["U+0065 U+0301->U+00E9"]), (t.nfc_changes, "가", ["U+1100 U+1161->U+AC00"]), (t.nfc_changes, "abc", []),
        (t.barred_expansions, "θ(εὸ)ς στ(αυ)ροῦ προκ(είμενον) (x)", "θ̅ς̅ στ̅ρ̅οῦ προκ̅ "), (t.barred_expansions, "α̅(β)γ", "α̅γ̅"), (t.barred_expansions, "α(β)γ(δ)ε", "α̅γ̅ε̅"),
        (t.sigma_spaces, "λόγοςκαὶ", "λόγος καὶ"), (t.line_end_hyphen, "ab-", "ab"), (t.line_end_hyphen, "ab -", "ab"), (t.line_end_hyphen, "a- -b:-", "a b:-"),
    ],
)
def test_text_functions(spark, function, given_, expected):
    assert one(spark, function("x"), given_) == expected and one(spark, function("x"), None) is None


def test_rules_apply_to_their_rows_only(spark):
    text, counts = t.ruled("x", "k", (("a", "one", "b"), ("c", None, "")))
    df = spark.createDataFrame([("a  c", "one.x"), ("a  c", "two"), ("a  b", "two"), ("a", None), (None, "one")], "x string, k string")
    assert [tuple(r) for r in df.select(text.alias("t"), counts.alias("n")).collect()] == [("b", [1, 1]), ("a", [0, 1]), ("a  b", [0, 0]), ("a", [0, 0]), (None, [None, None])]


def test_versions_refs_cursors_and_logs(spark, collected):
    given = ["1.2.3", "1.10.0", "1.9.9rc2", "1.9.9", "0.9", " ", None, "2.0.0a1", "x"]
    df = spark.createDataFrame([(v,) for v in given], "x string")
    assert [r.v for r in df.select(t.version_verdict("x", "1.9.9", "1.10.0").alias("v")).collect()] == ["below floor", "current", "below floor", "outdated", "malformed", "missing", "missing", "current", "malformed"]
    refs = spark.createDataFrame([("registry://blla?tag=v2",), ("registry://blla",), ("registry://b?tag=",), ("file:///x",), (None,)], "x string")
    assert [tuple(r.a) for r in refs.select(t.artifact_ref("x").alias("a")).collect()] == [("blla", "v2"), ("blla", "stable"), ("b", "stable"), (None, None), (None, None)]
    keys = spark.createDataFrame([(1, "Ω|x")], "a int, b string").select(t.encode_cursor("a", "b").alias("c"))
    assert tuple(keys.select(t.decode_cursor("c", "a int, b string").alias("d")).first().d) == (1, "Ω|x")
    assert keys.select(t.decode_cursor(F.lit("@@"), "a int").alias("d")).first().d is None
    log = one(spark, t.redact_log("x"), "GET https://u:p@h.example/a?key=1\nmail a.b@c.example id 0f027f8b-88ad-4785-ac52-ef647ea63e59 at /home/me/x.py")
    assert "u:p" not in log and "key=1" not in log and "@c.example" not in log and "0f027f8b" not in log and "/home" not in log and "\n" not in log


def test_codec_and_checks(spark):
    assert one(spark, t.encode_characters("x", "ab"), "abba") == [1, 2, 2, 1] and one(spark, t.encode_characters("x", "ab"), "") == []
    for column in (t.encode_characters("x", "ab"), records.split_name("x")):
        with pytest.raises(Exception, match="character not in|unknown split"):
            one(spark, column, "abc")
    df = spark.createDataFrame([("p.x", 1), ("q.y", 2)], "k string, n int")
    with pytest.raises(Exception, match="foreign row"):
        records.assert_pure(df, "k", "q.").collect()
    with pytest.raises(Exception, match="several parts"):
        records.combined({"a": df, "b": df}, "k").collect()
    assert records.combined({"a": df.limit(1), "b": df.where("n = 2")}, "k").count() == 2
    with pytest.raises(ValueError, match="unknown scope"):
        records.scoped(df, "none")
    merged = df.select(records.merged_maps(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3))).alias("m")).first().m
    assert merged == {"a": 1, "b": 3}


def test_normalisers_by_language(spark):
    df = spark.createDataFrame([("é.", "latin"), ("A;", "greek"), (".ⲁ", "coptic"), (None, "greek")], "x string, l string")
    assert [r.y for r in df.select(t.normalised("x", "l").alias("y")).collect()] == ["é.", "Α;", "·ⲁ", None]


def test_exhaustive_equals_all_assignments():
    sizes = [5, 1, 1, 3]
    best = min(itertools.product(range(3), repeat=4), key=lambda a: (round(sum(abs(sum(n for n, s in zip(sizes, a, strict=True) if s == k) - f * 10) for k, f in enumerate((0.8, 0.1, 0.1))), 9) + 99 * (len(set(a)) < 3), a))
    assert splitting.exhaustive(sizes, (0.8, 0.1, 0.1)) == list(best)
