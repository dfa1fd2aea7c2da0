"""File sources and sinks: manifests, text pairs, predictions, paged services, exports."""

from __future__ import annotations

import io
import json
import os
import re
import urllib.request
import zipfile
import xml.etree.ElementTree as ET
from collections.abc import Iterator, Mapping, Sequence
from html import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LINES_SCHEMA = (
    "line_id string, manuscript string, shelfmark string, page_index int, line_index int, text string, image struct<bytes: binary, path: string>, polygon array<array<int>>, "
    "baseline array<array<int>>, bbox array<int>, page_width int, page_height int, image_shipped boolean, source_url string, folio string, text_source string"
)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``image_name``, ``text`` of a tab-separated manifest: split at the first tab, blank lines skipped.

    A line without a tab is an error that names the file, the line's number and the line.
    """
    raw = spark.read.format("binaryFile").load(path) if not os.path.isdir(path) else spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    lines = raw.select(F.col("path").alias("file"), F.posexplode(F.split(F.decode("content", "UTF-8"), "\r?\n")).alias("number", "value")).where("value <> ''")
    parts = F.split("value", "\t", 2)
    wrong = F.concat(F.lit("invalid manifest row at "), "file", F.lit(":"), (F.col("number") + 1).cast("string"), F.lit(": "), F.left("value", F.lit(80)))
    good = F.when(F.size(parts) == 2, parts).otherwise(F.raise_error(wrong))
    return lines.select(good.alias("p")).select(F.col("p")[0].alias("image_name"), F.col("p")[1].alias("text"))


def read_splits(spark: SparkSession, folder: str) -> DataFrame:
    """The three manifests of a folder with their ``split``."""
    parts = [read_manifest(spark, f"{folder}/gt_{s}.txt").withColumn("split", F.lit(s)) for s in ("train", "val", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def write_manifest(rows: DataFrame, path: str) -> None:
    """Rows as ``image_name<tab>text`` in name order; the job's commit makes the folder appear whole or not at all."""
    ordered = rows.select("image_name", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange("image_name").sortWithinPartitions("image_name")
    ordered.select(F.concat_ws("\t", "image_name", "text")).write.mode("overwrite").text(path)


def unique_names(rows: DataFrame, key: str = "image_name") -> DataFrame:
    """The rows unchanged; a name that occurs twice is an error when it is read."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    checked = F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("repeated name "), F.col(key).cast("string")))).otherwise(F.col(key))
    return rows.join(counts, key).withColumn(key, checked).select(*rows.columns)


def write_versioned(rows: DataFrame, path: str, form: str = "parquet", keep: int = 2) -> int:
    """Rows as the next version of a table: a new folder, then the pointer to it; readers never see a half-written one.

    The last ``keep`` versions stay, so the version before is the backup.  Returns the version's number.  One writer at a
    time, as for any swap of a pointer.
    """
    fs, at = _filesystem(rows.sparkSession, path)
    number = max(_versions(fs, at), default=-1) + 1
    rows.write.mode("errorifexists").format(form).save(f"{path}/v={number}")
    for old in sorted(_versions(fs, at))[:-keep]:
        fs.delete(_path(rows.sparkSession, f"{path}/v={old}"), True)
    return number


def read_versioned(spark: SparkSession, path: str, form: str = "parquet", version: int | None = None) -> DataFrame:
    """The newest complete version of a table, or a given one."""
    fs, at = _filesystem(spark, path)
    known = _versions(fs, at)
    if not known:
        raise FileNotFoundError(f"no version below {path}")
    return spark.read.format(form).load(f"{path}/v={max(known) if version is None else version}")


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _filesystem(spark: SparkSession, path: str):  # noqa: ANN202
    at = _path(spark, path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _versions(fs, at) -> list[int]:  # noqa: ANN001
    """Numbers of the versions whose job was committed."""
    if not fs.exists(at):
        return []
    out = []
    for f in fs.listStatus(at):
        name = f.getPath().getName()
        if name.startswith("v=") and name[2:].isdigit() and fs.exists(f.getPath().suffix("/_SUCCESS")):
            out.append(int(name[2:]))
    return out


def write_report(report: Mapping[str, object], spark: SparkSession, path: str) -> None:
    """A report of a few figures as one JSON object."""
    spark.createDataFrame([(json.dumps(report, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_json_lines(rows: DataFrame, path: str) -> None:
    """Rows as JSON, one a line, nulls included."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """Rows as CSV with a header; quotes are doubled, so that every reader takes them."""
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def _decode(data: bytes) -> str:
    """UTF-8 with or without mark, else UTF-16."""
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("utf-16")


def read_text_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """``stem``, ``image_path``, ``text`` of images that lie beside a ``.gt.txt`` of the same stem; bytes of images aren't read."""
    texts = spark.read.format("binaryFile").option("pathGlobFilter", "*.gt.txt").load(folder)
    decode = F.pandas_udf(lambda s: s.map(_decode), "string")
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.gt)?\.[^./]+$", 1)
    images = spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,jpg,jpeg,tif}").load(folder).select(stem.alias("stem"), F.col("path").alias("image_path"))
    return texts.select(stem.alias("stem"), decode("content").alias("text")).join(images, "stem")


def read_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each predicted line of a folder of page files."""
    schema = "page string, variant string, image_size array<int>, seconds double, lines array<struct<baseline: array<array<double>>, polygon: array<array<double>>>>"
    pages = spark.read.schema(schema).option("multiLine", True).json(folder)
    return pages.select("page", "variant", "seconds", F.posexplode_outer("lines").alias("position", "line")).select("page", "variant", "seconds", "position", "line.baseline", "line.polygon")


class PagedSource(DataSource):
    """``spark.read.format("paged")``: JSON services that answer ``items`` and ``next_cursor``.

    Options: ``urls`` (one a line; each is a partition, read to its last page), ``field`` (of the items, default
    ``items``).  Rows are the items as JSON text.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "url string, item string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _PagedReader(dict(self.options))


class _Url(InputPartition):
    pass


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.urls = [u for u in options.get("urls", "").split("\n") if u]
        self.field = options.get("field", "items")

    def partitions(self) -> list[InputPartition]:
        return [_Url(u) for u in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        url = nxt = partition.value
        while nxt:
            with urllib.request.urlopen(nxt) as answer:  # noqa: S310
                page = json.load(answer)
            for item in page.get(self.field, []):
                yield url, json.dumps(item, ensure_ascii=False, sort_keys=True)
            cursor = page.get("next_cursor")
            nxt = None if not cursor else cursor if "://" in cursor else f"{url}{'&' if '?' in url else '?'}cursor={cursor}"


def write_lines(lines: DataFrame, path: str) -> None:
    """Release lines as Parquet in their explicit schema, clustered by manuscript."""
    spark = lines.sparkSession
    wanted = spark.createDataFrame([], LINES_SCHEMA).schema
    typed = lines.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted])
    typed.repartitionByRange(F.col("manuscript"), F.col("line_id")).sortWithinPartitions("manuscript", "page_index", "line_index").write.mode("overwrite").parquet(path)


def read_workbook(spark: SparkSession, path: str, required: Sequence[str], key: str) -> DataFrame:
    """The first sheet of an XLSX workbook as strings: the header names the columns, rows without any value are skipped.

    A missing required column, a row that has some of them only, and a repeated key are errors that name them.  A workbook
    is a small table that one machine reads.
    """
    with zipfile.ZipFile(path) as book:
        names = set(book.namelist())
        texts = ["".join(t.text or "" for t in e.iter() if t.tag.endswith("}t")) for e in ET.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        sheet = ET.fromstring(book.read(sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))[0]))
    table: list[dict[str, str]] = []
    for row in (e for e in sheet.iter() if e.tag.endswith("}row")):
        cells: dict[str, str] = {}
        for cell in row:
            inline = "".join(t.text or "" for t in cell.iter() if t.tag.endswith("}t"))
            raw = next((v.text for v in cell if v.tag.endswith("}v")), None)
            value = inline if cell.get("t") == "inlineStr" else texts[int(raw)] if cell.get("t") == "s" and raw is not None else raw
            if value is not None and value.strip():
                cells[re.sub(r"\d", "", cell.get("r", ""))] = value.strip()
        table.append(cells)
    header = table[0] if table else {}
    if missing := [c for c in required if c not in header.values()]:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    rows, seen = [], set()
    for number, cells in enumerate(table[1:], 2):
        record = {name: cells.get(at) for at, name in header.items()}
        own = [record[c] is not None for c in required]
        if not any(own):
            continue
        if not all(own):
            raise ValueError(f"{path}, row {number}: no {', '.join(c for c, there in zip(required, own, strict=True) if not there)}")
        if record[key] in seen:
            raise ValueError(f"{path}, row {number}: {key} {record[key]} again")
        seen.add(record[key])
        rows.append(tuple(record[c] for c in header.values()))
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in header.values()) or "empty string")


def discover_samples(spark: SparkSession, root: str) -> DataFrame:
    """``split``, ``stem``, ``image_path``, ``text_path`` of samples in any of the known layouts below a root.

    Layouts: ``split/images/x.png`` with ``split/labels/x.txt``, ``split/x.png`` with ``split/x.gt.txt``, and a file
    ``ROOT`` that names another root.  Only names are read.
    """
    fs, _ = _filesystem(spark, root)
    pointer = _path(spark, f"{root}/ROOT")
    if fs.exists(pointer):
        root = spark.read.text(f"{root}/ROOT").first().value.strip()
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    part = F.regexp_extract("path", r"/([^/]+)(?:/(?:images|labels))?/[^/]+$", 1)
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.gt)?\.[^./]+$", 1)
    kind = F.when(F.col("path").rlike(r"(?i)\.(png|jpe?g|tiff?)$"), "image").when(F.col("path").rlike(r"(?i)(\.gt\.txt|/labels/[^/]+\.txt)$"), "text")
    files = found.select(part.alias("split"), stem.alias("stem"), kind.alias("kind"), "path").where("kind IS NOT NULL")
    both = files.groupBy("split", "stem").agg(F.max(F.when(F.col("kind") == "image", F.col("path"))).alias("image_path"), F.max(F.when(F.col("kind") == "text", F.col("path"))).alias("text_path"))
    return both.where("image_path IS NOT NULL AND text_path IS NOT NULL")


def staged_problems(labels: DataFrame, images: DataFrame) -> DataFrame:
    """``problem``, ``name`` of a staged set: labels without an image, images without a label, names labelled twice.

    ``labels``: ``image_name``; ``images``: ``image_name``.
    """
    named, there = labels.select("image_name"), images.select("image_name").distinct()

    def told(df: DataFrame, problem: str) -> DataFrame:
        return df.select(F.lit(problem).alias("problem"), F.col("image_name").alias("name"))

    twice = named.groupBy("image_name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return told(named.distinct().join(there, "image_name", "left_anti"), "no image").unionByName(told(there.join(named, "image_name", "left_anti"), "no label")).unionByName(told(twice, "labelled twice"))


def blob_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """``path``, ``size``, ``modified`` of all files below a folder; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def inventory(spark: SparkSession, base: str, projects: str = "projects") -> DataFrame:
    """Nested walk of a paged service: projects, their documents, the documents' parts, one level of requests after the other.

    Each level's urls become the partitions of the next read, so a level is fetched in parallel.
    """
    spark.dataSource.register(PagedSource)

    def level(urls: list[str]) -> DataFrame:
        return spark.read.format("paged").option("urls", "\n".join(urls)).load()

    first = level([f"{base}/{projects}"]).select(F.get_json_object("item", "$.id").alias("project_id"))
    out = first
    for name, path in (("document_id", "documents"), ("part_id", "parts")):
        above = out.columns[-1]
        ids = [r[0] for r in out.select(above).distinct().collect()]
        read = level([f"{base}/{path}/{i}" for i in ids])
        own = read.select(F.regexp_extract("url", "([^/]+)$", 1).alias(above), F.get_json_object("item", "$.id").alias(name))
        out = out.join(own, above, "left").select(*out.columns, name)
    return out


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Models of a registry file (a list of ``- key: value`` blocks) as ``id``, ``task``, ``tag``, ``params`` (a map)."""
    text = F.split(F.regexp_replace("value", r"(?m)^\s*#.*$", ""), r"(?m)^- ")
    blocks = spark.read.text(path, wholetext=True).select(F.explode(text).alias("b")).where(F.col("b").rlike(r"\S"))
    pairs = F.transform(F.filter(F.split("b", "\n"), lambda x: x.contains(":")), lambda x: F.struct(F.trim(F.split(x, ":", 2)[0]), F.trim(F.split(x, ":", 2)[1])))
    m = blocks.select(F.map_from_entries(pairs).alias("m"))
    main = ("id", "task", "tag")
    return m.select(*[F.col("m")[k].alias(k) for k in main], F.map_filter("m", lambda k, _: ~k.isin(*main)).alias("params"))


PAGES_SCHEMA = (
    "page_id string, manuscript string, shelfmark string, page_index int, width int, height int, image_shipped boolean, source_url string, folio string, text_source string, "
    "objects array<struct<id: string, bbox: array<int>, polygon: array<array<int>>, baseline: array<array<int>>, text: string, paired: boolean>>"
)


def release_pages(lines: DataFrame) -> DataFrame:
    """Release lines as pages with their lines nested, in line order; a page's own values are those of its lines."""
    own = [F.max(c).alias(n) for c, n in (("shelfmark", "shelfmark"), ("page_width", "width"), ("page_height", "height"), ("image_shipped", "image_shipped"), ("source_url", "source_url"), ("folio", "folio"), ("text_source", "text_source"))]
    entry = F.struct("line_index", F.col("line_id").alias("id"), "bbox", "polygon", "baseline", "text", F.col("text").isNotNull().alias("paired"))
    rows = lines.where("manuscript IS NOT NULL AND line_id IS NOT NULL").dropDuplicates(["line_id"]).groupBy("manuscript", "page_index").agg(*own, F.array_sort(F.collect_list(entry)).alias("o"))
    objects = F.transform("o", lambda x: F.struct(x["id"].alias("id"), x["bbox"].alias("bbox"), x["polygon"].alias("polygon"), x["baseline"].alias("baseline"), x["text"].alias("text"), x["paired"].alias("paired")))
    return rows.select(F.format_string("%s_%04d", "manuscript", "page_index").alias("page_id"), "manuscript", "shelfmark", "page_index", "width", "height", "image_shipped", "source_url", "folio", "text_source", objects.alias("objects"))


def page_texts(lines: DataFrame, heading: str | None = None) -> DataFrame:
    """Text export of pages: a page marker, then the lines; a placeholder stands for a blank line.

    ``heading``: a column whose value is put before its first line, as for the regions of a page.
    """
    text = F.when(F.length(F.trim("text")) > 0, F.col("text")).otherwise(F.lit("[…]"))
    head = F.col(heading) if heading else F.lit(None).cast("string")
    rows = lines.groupBy("manuscript", "page_index").agg(F.array_sort(F.collect_list(F.struct("line_index", "line_id", text.alias("t"), head.alias("h")))).alias("l"))

    def told(x: Column, i: Column) -> Column:
        new = x["h"].isNotNull() & ((i == 0) | ~x["h"].eqNullSafe(F.get("l", i - 1)["h"]))
        return F.when(new, F.concat(F.lit("# "), x["h"], F.lit("\n"), x["t"])).otherwise(x["t"])

    return rows.select("manuscript", "page_index", F.concat(F.format_string("[p.%d]\n", "page_index"), F.array_join(F.transform("l", told), "\n")).alias("body"))


def page_xml(lines: DataFrame, region: str | None = None) -> DataFrame:
    """PAGE XML of each page: its regions in reading order, their lines in order with outline, baseline and text.

    ``region``: a column that names the region of a line; without it a page is one region.  A region's outline is the box
    of its lines.
    """

    def coords(points: list | None) -> str:
        return " ".join(",".join(str(int(c)) for c in q) for q in (points if points is not None else []))

    def line(x: dict, index: int) -> str:
        base = f'<Baseline points="{coords(x["baseline"])}"/>' if x["baseline"] is not None and len(x["baseline"]) else ""
        return f'<TextLine id="{escape(x["line_id"])}" custom="readingOrder {{index:{index};}}"><Coords points="{coords(x["polygon"])}"/>{base}<TextEquiv><Unicode>{escape(x["text"] or "", quote=False)}</Unicode></TextEquiv></TextLine>'

    def render(manuscript: pd.Series, page: pd.Series, width: pd.Series, height: pd.Series, rows: pd.Series) -> pd.Series:
        out = []
        for m, p, w, h, ls in zip(manuscript, page, width, height, rows, strict=True):
            regions: dict[str, list] = {}
            for x in ls:
                regions.setdefault(x["region"] or "r1", []).append(x)
            order = "".join(f'<RegionRefIndexed index="{i}" regionRef="{escape(r)}"/>' for i, r in enumerate(regions))
            body = ""
            for r, own in regions.items():
                corners = [q for x in own for q in (x["polygon"] if x["polygon"] is not None else [])]
                xs, ys = [q[0] for q in corners] or [0], [q[1] for q in corners] or [0]
                box = [(min(xs), min(ys)), (max(xs), min(ys)), (max(xs), max(ys)), (min(xs), max(ys))]
                body += f'<TextRegion id="{escape(r)}"><Coords points="{coords(box)}"/>{"".join(line(x, i) for i, x in enumerate(own))}</TextRegion>'
            out.append(f'<PcGts xmlns="http://schema.primaresearch.org/PAGE/gts/pagecontent/2019-07-15"><Page imageFilename="{escape(m)}_{p:04d}" imageWidth="{w}" imageHeight="{h}"><ReadingOrder><OrderedGroup id="ro">{order}</OrderedGroup></ReadingOrder>{body}</Page></PcGts>')
        return pd.Series(out)

    named = F.col(region).cast("string") if region else F.lit(None).cast("string")
    entry = F.struct("line_index", "line_id", "text", "polygon", "baseline", named.alias("region"))
    rows = lines.where("manuscript IS NOT NULL").groupBy("manuscript", "page_index").agg(F.max("page_width").alias("w"), F.max("page_height").alias("h"), F.array_sort(F.collect_list(entry)).alias("l"))
    return rows.select("manuscript", "page_index", F.pandas_udf(render, "string")("manuscript", "page_index", "w", "h", "l").alias("xml"))


def page_archives(pages: DataFrame) -> DataFrame:
    """``manuscript``, ``part``, ``archive``: page files and a manifest as ZIP archives of at most ``ARCHIVE_PAGES`` pages each.

    A manuscript with many pages gives several archives, so none is built of more than a bounded number of pages.
    """

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        held = io.BytesIO()
        rows = rows.sort_values("page_index")
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as book:
            for r in rows.itertuples():
                book.writestr(zipfile.ZipInfo(f"{r.manuscript}_{r.page_index:04d}.xml"), r.xml)
            book.writestr(zipfile.ZipInfo("manifest.json"), json.dumps([int(i) for i in rows["page_index"]]))
        return pd.DataFrame({"manuscript": [rows["manuscript"].iloc[0]], "part": [int(rows["part"].iloc[0])], "archive": [held.getvalue()]})

    parted = pages.select("manuscript", "page_index", "xml").withColumn("part", F.floor(F.col("page_index") / ARCHIVE_PAGES).cast("int"))
    return parted.groupBy("manuscript", "part").applyInPandas(pack, "manuscript string, part int, archive binary")


ARCHIVE_PAGES = 500


def points_of(column: str) -> Column:
    """``x,y x,y`` as an array of points, rounded half to even; null for null."""
    return F.transform(F.split(F.trim(column), " +"), lambda p: F.transform(F.split(p, ","), lambda v: F.bround(v.cast("double")).cast("int")))
