import json

import pytest
from codexlake.functions.pagexml import page_problems
from codexlake.operators.inlining import parse_xml
from codexlake.sources import files
from codexlake.streaming import rates
from pyspark.sql import functions as F


def test_manifest_round_trip(spark, tmp_path, collected):
    df = spark.createDataFrame([("a.png", "x\ty"), ("b.png", None)], "image_name string, text string")
    files.write_manifest(df, str(tmp_path / "gt_train.txt"))
    assert collected(files.read_manifest(spark, str(tmp_path / "gt_train.txt"))) == [("a.png", "x\ty"), ("b.png", "")]
    for s in ("val", "test"):
        (tmp_path / f"gt_{s}.txt").write_text(f"{s}.png\tt\n\n")
    assert files.read_splits(spark, str(tmp_path)).count() == 4
    (tmp_path / "bad.txt").write_text("no tab\n")
    with pytest.raises(Exception, match="invalid manifest"):
        files.read_manifest(spark, str(tmp_path / "bad.txt")).collect()


def test_text_pairs_decode_both_encodings(spark, tmp_path, collected):
    (tmp_path / "a.gt.txt").write_text("ä", encoding="utf-8")
    (tmp_path / "b.gt.txt").write_bytes("ß".encode("utf-16"))
    (tmp_path / "c.gt.txt").write_text("alone")
    for x in "ab":
        (tmp_path / f"{x}.png").write_bytes(b"image")
    assert collected(files.read_text_pairs(spark, str(tmp_path)).select("stem", "text")) == [("a", "ä"), ("b", "ß")]


def test_predictions(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"page": "p", "lines": [{"polygon": [[1, 2]]}, {"baseline": [[3, 4]]}]}))
    assert [r.position for r in files.read_predictions(spark, str(tmp_path)).orderBy("position").collect()] == [0, 1]


def test_paged_source_follows_cursors(spark, tmp_path, collected):
    (tmp_path / "2.json").write_text(json.dumps({"items": [{"i": 3}], "next_cursor": None}))
    (tmp_path / "1.json").write_text(json.dumps({"items": [{"i": 1}, {"i": 2}], "next_cursor": (tmp_path / "2.json").as_uri()}))
    spark.dataSource.register(files.PagedSource)
    df = spark.read.format("paged").option("urls", (tmp_path / "1.json").as_uri()).load()
    assert collected(df.select("item")) == [('{"i": 1}',), ('{"i": 2}',), ('{"i": 3}',)]


def test_exports(spark, small, tmp_path):
    lines = spark.read.parquet(f"{small}/release_lines.parquet").dropDuplicates(["line_id"])
    files.write_lines(lines, str(tmp_path / "lines"))
    assert spark.read.parquet(str(tmp_path / "lines")).count() == lines.count()
    page = files.page_texts(lines).where("body LIKE '[p.%'").first()
    assert page.body.startswith(f"[p.{page.page_index}]\n")
    assert all(parse_xml(r.xml) is not None for r in files.page_xml(lines).limit(20).collect())
    assert spark.sql("SELECT '1.5,2 3,4.5' AS p").select(files.points_of("p").alias("x")).first().x == [[2, 2], [3, 4]]


def test_admission_is_a_sliding_log():
    let_in, log = rates.admit([0, 1, 2, 11], [], 10, 2)
    assert let_in == [True, True, False, True] and log == [11]


@pytest.mark.parametrize(("status", "attempts", "event", "after"), [("pending", 0, "claim", ("claimed", 0)), ("claimed", 0, "expire", ("pending", 1)), ("claimed", 4, "expire", ("failed", 5)), ("done", 0, "cancel", ("done", 0)), ("pending", 0, "finish", ("pending", 0)), ("claimed", 1, "finish", ("done", 1)), ("claimed", 0, "cancel", ("cancelled", 0))])
def test_job_states(status, attempts, event, after):
    assert rates.next_status(status, attempts, event) == after


def _stream(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").json(str(tmp_path / "in"))
    return spark.readStream.schema(schema).json(str(tmp_path / "in"))


def test_streams_run(spark, tmp_path, collected):
    rows = [(i, "u", f"2024-01-01T00:00:0{i}") for i in range(5)]
    events = _stream(spark, tmp_path, rows, "event_id bigint, user string, ts string").selectExpr("event_id", "user", "CAST(ts AS TIMESTAMP) AS ts")
    query = rates.rate_limited(events, "user", "ts", 5, 3).writeStream.format("memory").queryName("limited").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    query.awaitTermination(12)  # timers of idle keys keep such a query running
    query.stop()
    assert sorted((r.id, r.admitted) for r in spark.table("limited").collect()) == [(0, True), (1, True), (2, True), (3, False), (4, False)]
    query = rates.windowed_counts(events, "ts", ["user"]).writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    query.awaitTermination(120)
    assert [r.n for r in spark.table("counted").collect()] == [5]


def test_upsert_keeps_the_newest(spark, tmp_path, collected):
    path = str(tmp_path / "t")
    write = rates.upsert_into(path, "k", "v", buckets=4)
    with pytest.raises(FileNotFoundError):
        rates.read_upserted(spark, path)
    write(spark.createDataFrame([(f"k{i}", 1, "x") for i in range(20)], "k string, v int, p string"), 3)  # not the first batch of the stream
    later = spark.createDataFrame([("k1", 2, "z"), ("k2", 0, "old"), ("n", 5, "y")], "k string, v int, p string")
    write(later, 4)
    write(later, 4)  # a repeated batch
    want = {(f"k{i}", 1, "x") for i in range(20)} - {("k1", 1, "x")} | {("k1", 2, "z"), ("n", 5, "y")}
    assert {tuple(r) for r in rates.read_upserted(spark, path).collect()} == want and rates.read_upserted(spark, path).count() == 21


def test_limits_over_several_keys_and_sweeps(spark, collected):
    logs: dict = {}
    assert rates.admit_all([0, 1, 2, 3], logs, [["user:a", "ip:1"], ["user:a", "ip:1"], ["user:b", "ip:1"], ["user:b", "ip:2"]], 10, {"user": 2, "ip": 2}) == [True, True, False, True]
    assert logs["ip:1"] == [0, 1] and rates.refund([3, 1, 2]) == [1, 2] and rates.refund([]) == []
    jobs = spark.createDataFrame([("claimed", 0, 0), ("claimed", 0, 4), ("claimed", 90, 0), ("running", 0, 0), ("done", 0, 0)], "status string, s int, attempts int").selectExpr("status", "timestamp_seconds(s) AS at", "attempts")
    assert collected(rates.swept(jobs, F.timestamp_seconds(F.lit(100)), 60, 99).select("status", "attempts")) == [("claimed", 0), ("done", 0), ("failed", 5), ("pending", 1), ("pending", 1)]


def test_batch_sinks(spark, tmp_path):
    events = spark.createDataFrame([("s", i) for i in range(20)] + [("t", 1)], "subscriber string, at int")
    rates.notify(str(tmp_path / "n"), 16)(events, 0)
    assert spark.read.json(str(tmp_path / "n")).groupBy("subscriber").count().orderBy("subscriber").collect()[0]["count"] == 16
    rates.drain(str(tmp_path / "d"), lambda b: b["id"] % 2 == 0)(spark.createDataFrame([(1, 0), (2, 3)], "id int, attempts int"), 0)
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "d" / "batch=0")).select("id", "attempts", "delivered").collect()) == [(1, 1, False), (2, 4, True)]


def test_versions_reports_and_sinks(spark, tmp_path, collected):
    path = str(tmp_path / "v")
    with pytest.raises(FileNotFoundError):
        files.read_versioned(spark, path)
    for n in range(4):
        assert files.write_versioned(spark.createDataFrame([(n,)], "n int"), path) == n
    assert collected(files.read_versioned(spark, path)) == [(3,)] and collected(files.read_versioned(spark, path, version=2)) == [(2,)] and not (tmp_path / "v" / "v=0").exists()
    files.write_report({"rows": 3, "name": "ä"}, spark, str(tmp_path / "r"))
    assert json.loads(spark.read.text(str(tmp_path / "r")).first().value) == {"rows": 3, "name": "ä"}
    odd = spark.createDataFrame([('a "q", b', None), ("x", "y")], "a string, b string")
    files.write_json_lines(odd, str(tmp_path / "j"))
    assert collected(spark.read.json(str(tmp_path / "j")).select("a", "b")) == collected(odd)
    files.write_csv(odd, str(tmp_path / "c"))
    assert collected(spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c"))) == collected(odd)
    with pytest.raises(Exception, match="repeated name"):
        files.unique_names(spark.createDataFrame([("a",), ("a",)], "image_name string")).collect()


def _workbook(path, rows):
    import zipfile

    def cell(c, r, v):
        return "" if v is None else f'<c r="{"ABC"[c]}{r}" t="inlineStr"><is><t>{v}</t></is></c>'

    body = "".join(f'<row r="{r}">{"".join(cell(c, r, v) for c, v in enumerate(row))}</row>' for r, row in enumerate(rows, 1))
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="m"><sheetData>{body}</sheetData></worksheet>')


def test_workbook(spark, tmp_path, collected):
    at = str(tmp_path / "w.xlsx")
    _workbook(at, [("name", "label", "split"), ("a", "x", "train"), (None, None, None), ("b", "y", "val")])
    assert collected(files.read_workbook(spark, at, ["name", "label"], "name")) == [("a", "x", "train"), ("b", "y", "val")]
    for rows, error in (([("name",), ("a",)], "no column label"), ([("name", "label"), ("a", None)], "row 2: no label"), ([("name", "label"), ("a", "x"), ("a", "y")], "a again")):
        _workbook(at, rows)
        with pytest.raises(ValueError, match=error):
            files.read_workbook(spark, at, ["name", "label"], "name")


def test_discovery_staging_and_registry(spark, tmp_path, collected):
    root = tmp_path / "root"
    for name in ("train/images/a.png", "train/labels/a.txt", "val/b.jpg", "val/b.gt.txt", "val/alone.png"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("x")
    assert collected(files.discover_samples(spark, str(root)).select("split", "stem")) == [("train", "a"), ("val", "b")]
    (tmp_path / "virtual").mkdir()
    (tmp_path / "virtual" / "ROOT").write_text(str(root) + "\n")
    assert files.discover_samples(spark, str(tmp_path / "virtual")).count() == 2 and files.blob_sizes(spark, str(root)).agg({"size": "sum"}).first()[0] == 5
    labels, images = (spark.createDataFrame([(n,) for n in names], "image_name string") for names in (["a", "a", "b"], ["a", "c"]))
    assert collected(files.staged_problems(labels, images)) == [("labelled twice", "a"), ("no image", "b"), ("no label", "c")]
    (tmp_path / "models.yaml").write_text("# models\n- id: blla\n  task: segment\n  tag: stable\n  pad: 3\n- id: ppocr\n  task: transcribe\n")
    assert [(r.id, r.task, r.tag, dict(r.params)) for r in files.read_registry(spark, str(tmp_path / "models.yaml")).orderBy("id").collect()] == [("blla", "segment", "stable", {"pad": "3"}), ("ppocr", "transcribe", None, {})]


def test_inventory_walks_three_levels(spark, tmp_path, collected):
    def page(name, ids):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(json.dumps({"items": [{"id": i} for i in ids]}))

    page("projects", ["p", "q"])
    page("documents/p", ["d", "e"])
    page("documents/q", [])
    page("parts/d", ["1", "2"])
    page("parts/e", [])
    (tmp_path / "parts" / "None").write_text(json.dumps({"items": []}))
    assert {tuple(r) for r in files.inventory(spark, tmp_path.as_uri()).collect()} == {("p", "d", "1"), ("p", "d", "2"), ("p", "e", None), ("q", None, None)}


def test_pages_and_archives(spark, small):
    import io
    import zipfile

    lines = spark.read.parquet(f"{small}/release_lines.parquet").where("manuscript IS NOT NULL AND line_id IS NOT NULL")
    pages = files.release_pages(lines)
    assert pages.selectExpr("sum(size(objects))").first()[0] == lines.select("line_id").distinct().count()
    xml = files.page_xml(lines.dropDuplicates(["line_id"]), region="folio")
    assert all(p in ("no baseline", "baseline doesn't run from left to right", "baseline leaves its outline", "custom has a tag that readers act upon", "outline has fewer than 3 points") for r in xml.limit(30).collect() for p, _ in page_problems(r.xml))
    packed = files.page_archives(xml).collect()
    names = [n for r in packed for n in zipfile.ZipFile(io.BytesIO(r.archive)).namelist()]
    assert len([n for n in names if n.endswith(".xml")]) == xml.count() and names.count("manifest.json") == len(packed)
    heads = files.page_texts(lines, heading="folio").where("body LIKE '%# %'").first().body
    assert heads.split("\n")[1].startswith("# ")
