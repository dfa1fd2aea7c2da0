"""Queries over whole tables, held against plain Python: nothing is left out by source, language, user or alphabet."""

from collections import Counter

import duckdb
from codexlake.plans import registry


def found(spark, folder, name):
    return Counter(tuple(r) for r in registry.QUERIES[name](spark, str(folder)).collect())


def read(folder, name, columns):
    return duckdb.sql(f"SELECT {columns} FROM '{folder}/{name}.parquet/*.parquet'").fetchall()


def test_corpus_queries_read_every_document(spark, small, tmp_path):
    own = [(-1, "a\r\n\n \tb 𐆊\n", None, None, 10), (-2, None, "EN", "acts", None), (-3, "", "hy", "lectionary", 0), (-4, "x", "de", "glossary", 1), (-5, "y", "DE", "acts", 1)]
    columns = ("doc_id", "text", "lang", "source", "n_chars")
    given = spark.read.parquet(f"{small}/documents.parquet").select(*columns)
    given.unionByName(spark.createDataFrame(own, "doc_id long, text string, lang string, source string, n_chars long")).write.parquet(f"{tmp_path}/documents.parquet")
    docs = read(tmp_path, "documents", "doc_id, text, lang, source")
    lines = Counter()
    for i, text, _, _ in docs:
        kept = [x for x in (y.strip(" \t\r") for y in (text or "").split("\n")) if x]
        lines.update((i, x, k) for k, x in enumerate(kept))
    assert found(spark, tmp_path, "imported_lines") == lines
    assert found(spark, tmp_path, "oversample") == Counter((i, k) for i, _, _, source in docs for k in range(1, 4 if source == "acts" else 2))
    chars = Counter((lang, c) for _, text, lang, _ in docs for c in text or "")
    assert found(spark, tmp_path, "charset") == Counter((lang, c, n) for (lang, c), n in chars.items())


def test_activity_counts_every_user(spark, tmp_path):
    rows = [("2024-01-02", "signup", 19), ("2024-01-02", "error", 20), ("2024-01-04", "signup", 5_000), ("2024-01-04", "signup", 5_000), ("2024-01-05", "error", None), ("2024-01-07", "click", 3)]
    spark.createDataFrame(rows, "day string, event_type string, user_id long").selectExpr("to_timestamp_ntz(day) AS ts", "event_type", "user_id").write.parquet(f"{tmp_path}/events.parquet")
    assert found(spark, tmp_path, "activity_zero_filled") == Counter([("2024-01-02", 1, 1), ("2024-01-03", 0, 0), ("2024-01-04", 2, 0), ("2024-01-05", 0, 1)])


def test_overlay_deletes_by_lines_not_by_key(spark, tmp_path):
    spark.createDataFrame([(3, "F", "low", 1.0), (6, "O", "low", 2.0), (7, "O", "high", 3.0)], "o_orderkey long, o_orderstatus string, o_orderpriority string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(3,), (6,), (6,)], "l_orderkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert found(spark, tmp_path, "bulk_replace_overlay") == Counter([(3, "low", 1.0), (6, "low new", 2.0)])


def test_messages_of_any_alphabet(spark, tmp_path):
    texts = ["Σελίδα 12 \u2013 κενή"] * 5 + ["Σελίδα 7 \u2013 κενή"] * 4 + ["𐆊" * 81 + "a"] * 4 + ["𐆊" * 80 + "b"] * 4 + ["two\nlines 1"] * 7 + ["plain 9"] * 6 + ["è"] * 5 + ["rare"] * 4 + [None] * 20
    spark.createDataFrame([(x,) for x in texts], "message string").write.parquet(f"{tmp_path}/feedback.parquet")
    out = [tuple(r) for r in registry.QUERIES["top_failure_messages"](spark, str(tmp_path)).collect()]
    assert out == [("Σελίδα N \u2013 κενή", 9), ("𐆊" * 80, 8), ("two\nlines N", 7), ("plain N", 6), ("è", 5)]
