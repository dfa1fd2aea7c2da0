import json
import xml.etree.ElementTree as ET

import duckdb
from codexlake.operators import inlining
from codexlake.operators.inlining import parse_json, parse_xml, schema_graph, shred, shred_array, tables_of, typed_table
from codexlake.plans.nested_pages import p6_found

XML = '<a xmlns="u"><TextRegion id="r1"><TextRegion id="r2"><TextLine id="l1"><Coords points="1,2"/></TextLine></TextRegion><TextLine id="l2"/></TextRegion></a>'


def test_tables_are_root_repeated_shared_and_recursive():
    graph = {("record", "page"): 1, ("page", "line"): 3, ("line", "box"): 1, ("page", "box"): 1, ("line", "meta"): 1, ("page", "region"): 1, ("region", "region"): 1}
    assert tables_of(graph) == {"record", "line", "box", "region"}


def test_xml_rows_keep_innermost_region(spark, collected):
    docs = spark.createDataFrame([("s", XML, 1), ("cut", XML[:60], 2), ("none", None, 3), ("empty", "", 4)], "stem string, xml string, row_id int")
    tables = tables_of(schema_graph(docs, "xml", "xml"))
    out = shred(docs, "stem", "xml", "xml", tables | {"TextLine"}, {"TextLine"}).selectExpr("record_id", "fields['@id']", "ancestors['TextRegion']", "position")
    assert collected(out) == [("s", "l1", "r2", 0), ("s", "l2", "r1", 0)]


def test_json_inlines_singletons_and_names_the_path(spark):
    text = json.dumps({"page": {"rotated": False}, "lines": [{"id": "x", "baseline": {"points": [[1, 2], [3, 4]]}, "points": [[5, 6]], "none": None}]})
    docs = spark.createDataFrame([("d", text), ("bad", "{"), ("list", "[1]")], "id string, state string")
    tables = tables_of(schema_graph(docs, "state", "json"))
    rows = {(r.table_name, r.via, r.position): r for r in shred(docs, "id", "state", "json", tables | {"lines", "points"}).collect()}
    assert rows["record", "", 0].fields["page.rotated"] == "false"
    assert "none" not in rows["lines", "", 0].fields
    assert rows["points", "baseline", 1].fields == {"0": "3", "1": "4"} and rows["points", "", 0].fields == {"0": "5", "1": "6"}
    assert rows["points", "", 0].parent_row_id == rows["lines", "", 0].row_id


def test_parsers_refuse_what_is_no_record():
    assert parse_json("3") is None and parse_json("") is None and parse_xml("<a>") is None and parse_xml("") is None


def test_empty_table_and_names_that_are_values(spark, monkeypatch):
    docs = spark.createDataFrame([], "id string, state string")
    assert schema_graph(docs, "state", "json").edges == {} and shred(docs, "id", "state", "json", {"record"}).count() == 0
    monkeypatch.setattr(inlining, "MAX_KINDS", 20)
    wide = spark.createDataFrame([(f"d{j}", json.dumps({f"k{i}": {"a": i} for i in range(15 * j, 15 * j + 15)})) for j in range(4)], "id string, state string")
    graph = schema_graph(wide, "state", "json")
    assert set(graph.edges) == {("record", "*")} and graph.edges["record", "*"] > 1 and {e for e, _ in graph.fields} <= {"record", "*"}
    rows = shred(wide, "id", "state", "json", tables_of(graph), {"*"}, graph=graph)
    assert {(r.record_id, r.fields["#name"], r.fields["a"]) for r in rows.collect()} == {(f"d{i // 15}", f"k{i}", str(i)) for i in range(60)}


def test_depth_and_tails(spark):
    deep = "{\"a\":" * 3000 + "1" + "}" * 3000
    docs = spark.createDataFrame([("deep", deep), ("flat", '{"a": {"a": 2}}'), ("broken", "{" * 100_000)], "id string, state string")
    graph = schema_graph(docs, "state", "json")
    assert graph.edges == {("record", "a"): 1, ("a", "a"): 1} and {r.record_id for r in shred(docs, "id", "state", "json", tables_of(graph)).collect()} >= {"flat"}
    xml = spark.createDataFrame([("x", "<p>one <b>two</b> three<!-- no --></p>")], "id string, xml string")
    graph = schema_graph(xml, "xml", "xml")
    fields = shred(xml, "id", "xml", "xml", tables_of(graph)).first().fields
    assert (fields["p.#text"], fields["p.b.#text"], fields["p.b.#tail"]) == ("one ", "two", " three")


def test_typed_table(spark, collected):
    docs = spark.createDataFrame([("d", json.dumps({"lines": [{"id": "x", "n": 1, "ok": True, "box": {"w": 2}}, {"id": "y", "n": 2.5, "ok": None, "box": {"w": "wide"}}]}))], "id string, state string")
    graph = schema_graph(docs, "state", "json")
    tables = tables_of(graph)
    lines = typed_table(shred(docs, "id", "state", "json", tables), graph, tables, "lines")
    assert dict(lines.dtypes) | {"n": "double", "ok": "boolean", "box.w": "string", "parent_row_id": "bigint"} == dict(lines.dtypes)
    assert collected(lines.select("id", "n", "ok", "`box.w`", "parent_table", "parent_row_id", "fields")) == [("x", 1.0, True, "2", "record", 0, None), ("y", 2.5, None, "wide", "record", 0, None)]


def test_array_points(spark, collected):
    df = spark.createDataFrame([("a", [[1, 2], [3]]), ("b", None), ("c", [])], "id string, polygon array<array<int>>")
    assert collected(shred_array(df, "id", "polygon")) == [("a", 0, 1, 2), ("a", 1, 3, None)]


def test_found_equals_brute_force(spark, small):
    expected = set()
    for i, state in duckdb.sql(f"SELECT id, state FROM '{small}/annotation_history_snapshots.parquet' WHERE state IS NOT NULL").fetchall():
        expected |= {("annotation_history_snapshots", i, x.get("block_id") or "", x["id"]) for x in json.loads(state).get("lines") or []}

    def walk(stem, element, region):
        for child in element:
            tag = child.tag.rpartition("}")[2]
            if tag == "TextLine":
                expected.add(("page_xml_bundles", stem, region, child.get("id")))
            walk(stem, child, child.get("id") if tag == "TextRegion" else region)

    for stem, xml in duckdb.sql(f"SELECT stem, xml FROM '{small}/page_xml_bundles.parquet' WHERE xml IS NOT NULL").fetchall():
        try:
            walk(stem, ET.fromstring(xml), "")
        except ET.ParseError:
            continue
    assert {tuple(r) for r in p6_found(spark, small).collect()} == expected
