"""Look-alike texts, cross-split duplicates and grouped splits."""

import glob
import os
import random
from collections import defaultdict

import duckdb
import pytest
from codexlake.functions.metrics import edit_distance
from codexlake.llm import cross_split, grouped_split
from codexlake.llm.characters import consistent_form, letter_skeleton, normalise
from codexlake.llm.lookalikes import form_of, same_look
from codexlake.llm.queries import ORACLES, QUERIES
from pyspark.sql import functions as F

LINES = "line_id string, text string, response_id bigint"
SAID = "response_id bigint, line_id string, text string, character_confidences array<struct<char:string,confidence:double>>, model_name string"


def spelled(text):
    return [(c, 0.5) for c in text] if text is not None else None


def test_forms():
    assert normalise("ＡB\u200b\u00a0ﬁẞ") == "ab fiss"
    same = [("abo", "аbо"), ("ⲟⲥ", "ос"), ("ό", "ό"), ("a b", "a\u2007b"), ("nο", "ո" + "o"), ("e\u0301", "é"), ("a\u00adb\ufeff", "ab"), ("։", ":")]
    assert all(consistent_form(a, False) == consistent_form(b, False) for a, b in same)
    other = [("a", "b"), ("ὶ", "ί"), ("a", "A"), ("σ", "ς"), ("ab", "a b"), ("ε", "η")]
    assert all(consistent_form(a, False) != consistent_form(b, False) for a, b in other)
    assert consistent_form("") == "" and letter_skeleton("Ἀ-β! 7") == letter_skeleton("αΒ7")


def test_same_look_edge_cases(spark, collected):
    lines = [("a", "οξυ", 9), ("a", "οξυ", 9), ("n", None, 9), ("b", " \u00a0", 9), ("m", "xy", 9), ("m", "oo", 9), (None, "oo", 9), ("long", "o" * 200_000, 9)]
    said = [
        (1, "a", "oξυ", spelled("οξυ"), "m"), (1, "a", "oξυ", spelled("οξυ"), "m"), (2, "a", "οξυ", spelled("оξυ"), None), (3, "a", "οξι", [], None), (4, "n", "x", spelled("x"), None),
        (5, "b", "x", None, None), (6, "m", "оо", None, None), (7, None, "oo", None, None), (8, "long", "о" + "o" * 199_999, None, None), (9, "a", None, None, None), (10, "a", "", [(None, 0.1)], None),
    ]
    found = same_look(spark.createDataFrame(said, SAID), spark.createDataFrame(lines, LINES))
    assert collected(found) == [(1, "a", "text"), (2, "a", "char"), (6, "m", "text"), (8, "long", "text")]
    assert same_look(spark.createDataFrame([], SAID), spark.createDataFrame([], LINES)).count() == 0
    forms = spark.createDataFrame([("Аb",), (None,), ("",)], "t string").select(form_of("t").alias("f")).collect()
    assert [r.f for r in forms] == ["ab", None, ""]


def _brute(rows):
    members = defaultdict(lambda: ([], []))
    for i, split, text in rows:
        s = {"train": 0, "training": 0, "val": 1, "valid": 1, "validation": 1, "test": 1}.get(split.strip().lower()) if split else None
        if s is not None and text is not None and i is not None:
            k = letter_skeleton(text)
            if sum(c.isalpha() for c in k) >= 20:
                members[k][s].append(i)
    out = set()
    keys = sorted(members)
    for a in keys:
        for b in keys:
            n = max(len(a), len(b))
            if members[a][0] and members[b][1] and abs(len(a) - len(b)) <= n // 10 and (a == b or edit_distance(a, b) <= n // 10):
                out |= {(t, e) for t in members[a][0] for e in members[b][1]}
    return out


def test_pairs_equal_brute_force(spark, small):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randrange(4, 11))) for _ in range(60)]
    rows = []
    for i in range(150):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(3, 9)))
        rows.append((i, rng.choice(["train", " Training", "val", "VALID", "test ", None]), text))
    for i in range(150, 320):
        _, _, text = rows[rng.randrange(150)]
        letters = list(text)
        for _ in range(rng.randrange(0, 1 + len(text) // 25)):
            at = rng.randrange(len(letters))
            letters[at : at + 1] = rng.choice([[], ["x"], [letters[at], "q"]])
        rows.append((i, rng.choice(["train", "val", "test"]), "".join(letters).upper() if rng.random() < 0.3 else "(" + "".join(letters) + ")"))
    rows += [(400, "train", None), (401, "val", ""), (402, "train", "ab" * 60_000), (403, "test", "AB " * 60_000), (None, "val", rows[0][2]), (404, "holdout", rows[0][2])]
    df = spark.createDataFrame(rows, "row_id bigint, split string, text string").selectExpr("*", "1 AS n", "'z' AS skeleton", "2 AS text_id")
    found = {(r.train_row, r.eval_row) for r in cross_split.cross_split_pairs(df).collect()}
    brute = _brute([r for r in rows if r[0] not in (402, 403)]) | {(402, 403)}
    assert found == brute
    real = [(i, s, t) for i, s, t in duckdb.sql(f"SELECT row_id, split, text FROM '{small}/import_rows.parquet'").fetchall()]
    assert {tuple(sorted(p)) for p in _brute(real)} == {tuple(r) for r in cross_split.p4_found(spark, small).collect()}
    assert cross_split.cross_split_pairs(df.limit(0)).count() == 0


def test_fingerprints_of_odd_texts():
    texts = ["", "a", "abcabcabcabc" * 5000, "abcdefghijklmnopqrstu", "abcdefghijklmnopqrstu"]
    sim = cross_split.simhashes(texts)
    assert (sim[3] == sim[4]).all() and (sim[:2] == 0).all() and cross_split.simhashes([]).shape == (0, 2)
    row, key, places = cross_split.paired_keys(texts)
    assert len(row) == len(key) == len(places) < 12 * sum(map(len, texts)) and 0 not in row and list(key[row == 3]) == list(key[row == 4])
    assert all(len(x) == 0 for x in cross_split.paired_keys([])) and all(len(x) == 0 for x in cross_split.even_keys([], cross_split._held))


def test_simhash_counts_bits(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefgh") for _ in range(n)) for n in [*range(70), 300, 1200]]
    sim = cross_split.simhashes(texts)
    monkeypatch.setattr(cross_split, "COUNTED_TOGETHER", 0)
    assert (cross_split.simhashes(texts) == sim).all()


def _hurt(rng, text):
    """As many random differences as a pair may have, each a changed, missing or further letter."""
    out, n = list(text), 0
    while n < len(text) // 10 - 1 or (n < len(text) // 10 and len(out) >= len(text)):
        at = rng.randrange(len(out))
        out[at : at + 1] = rng.choice([["ж"], [], [out[at], "ж"]])
        n += 1
    return "".join(out)


def test_even_blocks_lose_no_pair():
    """Every pair within one letter in ten shares a key, whatever the differences."""
    rng = random.Random(5)
    for n in list(range(20, cross_split.EVEN_BELOW)) * 15:
        train = "".join(rng.choice("abcdefgh") for _ in range(n))
        held = _hurt(rng, train) if rng.random() < 0.7 else "".join("ж" if i % (n // (n // 10)) == n // (n // 10) - 1 and i // (n // (n // 10)) < n // 10 else c for i, c in enumerate(train))
        if edit_distance(train, held) <= max(len(train), len(held)) // 10:
            assert set(cross_split.even_keys([train], cross_split._held)[1]) & set(cross_split.even_keys([held], cross_split._asked)[1]), (train, held)


def test_recall_at_the_bound_by_length(spark):
    """Pairs with exactly one letter in ten different, against brute force, for each class of lengths."""
    rng = random.Random(9)
    for low, high in ((20, 39), (40, 80), (81, 117), (130, 160), (200, 600)):
        rows, due = [], set()
        for i in range(150):
            text = "".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randrange(low, high + 1)))
            held = _hurt(rng, text)
            rows += [(2 * i, "train", text), (2 * i + 1, "test", held)]
            if edit_distance(text, held) <= max(len(text), len(held)) // 10 and len(held) >= 20:
                due.add((2 * i, 2 * i + 1))
        found = {(r.train_row, r.eval_row) for r in cross_split.cross_split_pairs(spark.createDataFrame(rows, "row_id bigint, split string, text string")).collect()}
        assert found <= due and len(found) >= (1 if high < cross_split.EVEN_BELOW else 0.98) * len(due) > 100, (low, len(found), len(due))


def test_overlap_counts_equal_counted_pairs(spark, small):
    rows = spark.read.parquet(f"{small}/import_rows.parquet")
    source = rows.select("row_id", (F.col("row_id") % 3).cast("string").alias("source")).where("row_id % 5 > 0")
    pairs = cross_split.cross_split_pairs(rows).join(source.withColumnRenamed("row_id", "eval_row"), "eval_row", "left")
    want = pairs.groupBy("eval_split", "source").agg(F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("eval_row").alias("n_rows"), F.countDistinct(F.when(F.col("same"), F.col("eval_row"))).alias("n_same_text"))
    assert {tuple(r) for r in cross_split.overlap_counts(rows, source).collect()} == {tuple(r) for r in want.collect()} != set()


RELEASE = "manuscript string, shelfmark string, text string"


def test_codices_and_torn_rows(spark, collected):
    lines = spark.createDataFrame([("x-gr-0007", "Place, Bibl., gr. 7", "t"), ("X_GR_0007 ", None, None), ("alias-a1", "PLACE BIBL. MS Gr. 007", ""), ("y-gr-0070", "Place, Bibl., gr. 70", "t"), (None, "s", "t"), ("", "s", "t")], RELEASE)
    slugs = {r.slug: r.codex for r in grouped_split.codices(lines).collect()}
    assert slugs["x-gr-0007"] == slugs["alias-a1"] != slugs["y-gr-0070"] and len(slugs) == 3
    rows = spark.createDataFrame([(1, "crops/x-gr-0007__1.png"), (2, "D:\\scans\\ALIAS-A1\\f1.tif"), (3, "./export 2/y_gr_0070_page_001.jpg"), (4, None), (5, "nothing"), (None, "x-gr-0007")], "row_id bigint, source_image string")
    found = dict(collected(grouped_split.codex_of_rows(rows, lines)))
    assert found[1] == found[2] != found[3] and set(found) == {1, 2, 3}
    assert grouped_split.codex_of_rows(rows, lines.limit(0)).count() == 0


def test_assignment_keeps_groups_and_shares(spark):
    rng = random.Random(1)
    sizes = [(f"g{i}", rng.choice(["a", "b", None]), rng.randrange(1, 9)) for i in range(3000)] + [("hot", "a", 5000), ("warm", "b", 900)]
    out = grouped_split.assign_groups(spark.createDataFrame(sizes, "grp string, label string, n bigint")).collect()
    of = {r.grp: r.assigned for r in out}
    assert len(of) == len(out) == len({s[0] for s in sizes}) and of["hot"] == "train"
    total = sum(n for *_, n in sizes)
    for split, share in grouped_split.SHARES.items():
        assert abs(sum(n for g, _, n in sizes if of[g] == split) / total - share) < 0.02
    assert grouped_split.assign_groups(spark.createDataFrame([], "grp string, label string, n bigint")).count() == 0


def test_many_labels_and_slug_lengths(spark, monkeypatch):
    monkeypatch.setattr(grouped_split, "MAX_LABELS", 3)
    sizes = [(f"g{i}", f"l{i % 40}", 1 + i % 5) for i in range(2000)]
    out = grouped_split.assign_groups(spark.createDataFrame(sizes, "grp string, label string, n bigint")).collect()
    of = {r.grp: r.assigned for r in out}
    assert len(of) == len(out) == 2000 and all(abs(sum(n for g, _, n in sizes if of[g] == s) / sum(n for *_, n in sizes) - w) < 0.02 for s, w in grouped_split.SHARES.items())
    lines = spark.createDataFrame([("-".join(["m", *map(str, range(k))]), None, "t") for k in range(1, 13)], RELEASE)
    rows = spark.createDataFrame([(k, "x/" + "_".join(["M", *map(str, range(k))]) + ".png") for k in range(1, 13)], "row_id bigint, source_image string")
    assert len({r.codex for r in grouped_split.codex_of_rows(rows, lines).collect()}) == 12


def test_torn_rows_equal_brute_force(spark, small):
    rows = grouped_split.codex_of_rows(spark.read.parquet(f"{small}/import_rows.parquet"), spark.read.parquet(f"{small}/release_lines.parquet")).collect()
    codex = {r.row_id: r.codex for r in rows}
    splits, names = defaultdict(set), {"train": "train", "training": "train", "val": "val", "valid": "val", "validation": "val", "test": "test"}
    read = {i: names.get(s.strip().lower()) for i, s in duckdb.sql(f"SELECT row_id, split FROM '{small}/import_rows.parquet' WHERE split IS NOT NULL").fetchall()}
    for i, s in read.items():
        if s and i in codex:
            splits[codex[i]].add(s)
    assert {r.row_id for r in grouped_split.p5_found(spark, small).collect()} == {i for i, s in read.items() if s and i in codex and len(splits[codex[i]]) > 1}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(name, spark, small):
    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    found, sql = QUERIES[name](spark, small), con.sql(ORACLES[name])
    at = [sql.columns.index(c) for c in found.columns]
    assert sorted(tuple(map(str, r)) for r in found.collect()) == sorted(tuple(str(r[i]) for i in at) for r in sql.fetchall()) != []
