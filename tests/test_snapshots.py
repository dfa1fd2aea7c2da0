import json
import random
from collections import defaultdict

import duckdb
from codexlake.operators.snapshots import _depth, merkle_diff, number_versions
from codexlake.plans.page_history import history_changes, line_digests, p1_found
from pyspark.sql import functions as F


def brute(data):
    out = []
    for (g, v), now in data.items():
        if v and (g, v - 1) in data:
            before = data[g, v - 1]
            for k in set(now) | set(before):
                a, b = sorted(before.get(k, [])), sorted(now.get(k, []))
                if a != b:
                    out.append((g, v, k, "added" if not a else "removed" if not b else "changed"))
    return sorted(out)


def test_merkle_equals_brute_force(spark, collected):
    rng = random.Random(3)
    data = {}
    for g in "abc":
        rows = {f"k{i}": [str(rng.random())] for i in range(300 if g == "a" else 5)}
        for v in range(4):
            rows = {k: ([str(rng.random())] if rng.random() < 0.05 else list(d)) for k, d in rows.items() if rng.random() > 0.03}
            rows |= {f"n{v}{i}": ["x", "x"] for i in range(rng.randrange(3))}
            data[g, v] = rows if not (g == "c" and v == 2) else {}
    rows = spark.createDataFrame([(g, v, k, d, "extra") for (g, v), r in data.items() for k, ds in r.items() for d in ds], "grp string, version int, row_key string, digest string, node string")
    versions = spark.createDataFrame(list(data), "grp string, version int")
    for levels in (None, 0, 1, 2, 3):
        found = merkle_diff(rows, versions, ["grp"], levels=levels).select("grp", "pair", "row_key", "change_kind")
        assert collected(found) == brute(data)


def test_merkle_edge_cases(spark, collected):
    schema = "grp string, version int, row_key string, digest string"
    versions = spark.createDataFrame([("g", 0), ("g", 1)], "grp string, version int")
    assert merkle_diff(spark.createDataFrame([], schema), versions, ["grp"]).count() == 0
    rows = spark.createDataFrame([("g", 0, None, "a"), ("g", 0, "k", None), ("g", 1, "k", "d"), ("g", 1, "e", "")], schema)
    assert collected(merkle_diff(rows, versions, ["grp"]).select("row_key", "change_kind")) == [("e", "added"), ("k", "changed")]


def test_depth_follows_the_rows(spark, collected):
    data = {("big", v): {f"k{i}": [str(i if i != 70 * v else -v)] for i in range(3000)} for v in range(3)} | {("small", v): {"a": [str(v)]} for v in range(3)}
    rows = spark.createDataFrame([(g, v, k, d) for (g, v), r in data.items() for k, ds in r.items() for d in ds], "grp string, version int, row_key string, digest string")
    versions = spark.createDataFrame([*data, ("none", 0), ("none", 1)], "grp string, version int")
    assert collected(merkle_diff(rows, versions, ["grp"]).select("grp", "pair", "row_key", "change_kind")) == brute(data)
    assert collected(spark.createDataFrame([(n,) for n in (0, 32, 33, 512, 513, 10**10)], "n long").select(_depth(F.col("n")))) == [(0,), (0,), (1,), (1,), (2,), (8,)]


def test_running_numbers_of_a_hot_group(spark):
    rows = [("hot", i * 7 % 5000, str(i)) for i in range(5000)] + [(None, i, "x") for i in range(20)] + [("a", 1, "x"), ("a", 1, "y")]
    df = spark.createDataFrame(rows, "part string, at int, id string")
    held = {}
    for r in number_versions(df, ["part"], ["at", "id"]).collect():
        held.setdefault(r.part, []).append((r.version, r.at, r.id))
    assert {p: len(x) for p, x in held.items()} == {"hot": 5000, None: 20, "a": 2}
    assert all([v for v, *_ in sorted(x)] == list(range(len(x))) and sorted(x) == sorted(x, key=lambda r: r[1:]) for x in held.values())


def test_number_versions_breaks_ties_by_order(spark, collected):
    df = spark.createDataFrame([("p", 1, "b"), ("p", 1, "a"), ("q", 5, "c")], "part string, at int, id string")
    assert collected(number_versions(df, ["part"], ["at", "id"]).select("id", "version")) == [("a", 0), ("b", 1), ("c", 0)]


def test_digests_ignore_spelling_but_not_values():
    def one(line):
        return line_digests(json.dumps({"lines": [line]}))[0]["digest"]

    base = {"id": "a", "points": [[1, 2]], "mask": None, "order": 1}
    assert one(base) == one({"order": 7, "points": [[1.0, 2.0]], "id": "a", "source_metadata": {"x": 1}})
    assert one(base) != one(base | {"points": [[1, 2.5]]})
    assert line_digests(None) is None and line_digests("[]") is None and line_digests("{") is None
    assert line_digests('{"lines": null}') == [] and line_digests('{"lines": [{"kind": "x"}, 3]}') == []


def test_history_null_states_and_repeats(spark, collected):
    def state(*ids):
        return json.dumps({"lines": [{"id": i, "kind": "k"} for i in ids]})

    rows = [("s1", "p", state("a"), 1, 1), ("s2", "p", None, 2, 2), ("s3", "p", state("a", "b"), 3, 9), ("s3", "p", state("a", "b"), 3, 12), ("s4", "p", "{}", 4, 4), (None, "p", state("z"), 5, 5)]
    df = spark.createDataFrame(rows, "id string, part_id string, state string, created_at int, received_at int").selectExpr("id", "part_id", "state", "timestamp_seconds(created_at) AS created_at", "timestamp_seconds(received_at) AS received_at", "1 AS lines")
    assert collected(history_changes(df)) == [("s3", "b", "added"), ("s4", "a", "removed"), ("s4", "b", "removed")]


def test_found_equals_brute_force(spark, small):
    def canonical(v):
        if isinstance(v, dict):
            return tuple(sorted((k, canonical(x)) for k, x in v.items() if x is not None))
        if isinstance(v, list):
            return tuple(map(canonical, v))
        return float(v) if isinstance(v, int) and not isinstance(v, bool) else v

    expected = set()
    pages = defaultdict(dict)
    for i, part, state, at in duckdb.sql(f"SELECT id, part_id, state, created_at FROM '{small}/annotation_history_snapshots.parquet' WHERE state IS NOT NULL").fetchall():
        lines = {x["id"]: canonical({k: v for k, v in x.items() if k not in ("id", "order", "source_metadata")}) for x in json.loads(state).get("lines") or []}
        pages[part][at, i] = lines
    for snapshots in pages.values():
        order = sorted(snapshots)
        for a, b in zip(order, order[1:], strict=False):
            for k in set(snapshots[a]) | set(snapshots[b]):
                x, y = snapshots[a].get(k), snapshots[b].get(k)
                if x != y:
                    expected.add(("history", b[1], k, "added" if x is None else "removed" if y is None else "changed"))
    runs = {}
    for i, part, lines, at in duckdb.sql(f"SELECT id, part_id, run_lines, created_at FROM '{small}/segmentation_runs.parquet'").fetchall():
        if part not in runs or (at, i) > runs[part][:2]:
            runs[part] = (at, i, {x["external_id"]: x["points"] for x in lines or [] if x["external_id"] is not None})
    live = defaultdict(dict)
    for i, part, points, run, ext in duckdb.sql(f"SELECT id, part_id, points, segmentation_run_id, run_external_id FROM '{small}/live_lines.parquet'").fetchall():
        live[part][i] = (points, run, ext)
    for part, (_, run, listed) in runs.items():
        came = defaultdict(list)
        for i, (points, origin, ext) in live[part].items():
            if origin == run and ext in listed:
                came[ext].append(points)
            else:
                expected.add(("run", run, i, "added"))
        for ext, points in listed.items():
            if ext not in came:
                expected.add(("run", run, ext, "removed"))
            elif len(came[ext]) > 1 or came[ext][0] != points:
                expected.add(("run", run, ext, "changed"))
    assert {tuple(r) for r in p1_found(spark, small).collect()} == expected
