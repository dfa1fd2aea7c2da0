"""Text-corpus preparation: deduplication, routing, splits and their leaks, normal forms, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codexlake.functions.text import GREEK_FROM, GREEK_TO, SCRIPT_CLASSES, armenian_gt, coptic_gt, greek_editorial, greek_gt, loose_key, main_script, route, script_counts, slug, syriac_gt
from codexlake.operators.components import components
from codexlake.plans.catalog import query
from codexlake.runtime import table

_SPLIT = "CASE lower(trim(split)) WHEN 'train' THEN 'train' WHEN 'training' THEN 'train' WHEN 'val' THEN 'val' WHEN 'valid' THEN 'val' WHEN 'validation' THEN 'val' WHEN 'test' THEN 'test' END"


def _split() -> Column:
    return F.expr(_SPLIT)


def _imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "import_rows")


_PREFER = "CASE WHEN starts_with(source_image, './export') THEN 1 ELSE 0 END"


@query(f"""
SELECT text, row_id FROM (SELECT text, row_id, row_number() OVER (PARTITION BY text ORDER BY {_PREFER}, output_name, row_id) AS r FROM import_rows WHERE text IS NOT NULL AND output_name IS NOT NULL AND source_image IS NOT NULL) WHERE r = 1
""")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each text: preferred source first, then the least name."""
    rows = _imports(spark, sf_dir).where("text IS NOT NULL AND output_name IS NOT NULL AND source_image IS NOT NULL")
    best = F.min(F.struct(F.col("source_image").startswith("./export").cast("int").alias("p"), "output_name", "row_id")).alias("b")
    return rows.groupBy("text").agg(best).select("text", "b.row_id")


@query(f"""
SELECT row_id AS dropped, kept FROM (SELECT row_id, first_value(row_id) OVER (PARTITION BY text ORDER BY {_PREFER}, output_name, row_id) AS kept FROM import_rows WHERE text IS NOT NULL AND output_name IS NOT NULL AND source_image IS NOT NULL) WHERE row_id <> kept
""")
def dedup_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dropped copies with the row kept in their place: a join with the winners, so a hot text needs no sort."""
    rows = _imports(spark, sf_dir).where("text IS NOT NULL AND output_name IS NOT NULL AND source_image IS NOT NULL")
    kept = exact_dedup(spark, sf_dir).select("text", F.col("row_id").alias("kept"))
    return rows.join(kept, "text").where("row_id <> kept").select(F.col("row_id").alias("dropped"), "kept")


@query()
def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each loose key of 20 characters or more; rows with shorter keys all stay."""
    rows = _imports(spark, sf_dir).where("text IS NOT NULL AND output_name IS NOT NULL").select("row_id", "output_name", loose_key("text").alias("k"))
    rows = rows.withColumn("grp", F.when(F.length("k") >= 20, F.col("k")).otherwise(F.concat(F.lit("#"), F.col("row_id").cast("string"))))
    return rows.groupBy("grp").agg(F.min(F.struct("output_name", "row_id")).alias("b"), F.count(F.lit(1)).alias("copies")).select("b.row_id", "copies")


@query(f"""
WITH r AS (SELECT row_id, text, {_SPLIT} AS s, regexp_extract(output_name, '^(.*)__[0-9]+-[0-9]+\\.jpg$', 1) AS page FROM import_rows WHERE text IS NOT NULL),
t AS (SELECT DISTINCT text FROM r WHERE s = 'train'), p AS (SELECT DISTINCT page FROM r WHERE s = 'train' AND page <> '')
SELECT r.s AS split, count(*) AS n, count(t.text) AS text_leaks, count(p.page) AS page_leaks FROM r LEFT JOIN t ON t.text = r.text LEFT JOIN p ON p.page = r.page WHERE r.s IN ('val', 'test') GROUP BY 1
""")
def leakage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of val and test whose text or page occurs in train."""
    rows = _imports(spark, sf_dir).where("text IS NOT NULL").select("text", _split().alias("split"), F.regexp_extract("output_name", r"^(.*)__[0-9]+-[0-9]+\.jpg$", 1).alias("page"))
    texts = rows.where("split = 'train'").select("text", F.lit(1).alias("t")).distinct()
    pages = rows.where("split = 'train' AND page <> ''").select("page", F.lit(1).alias("p")).distinct()
    held = rows.where("split IN ('val', 'test')").join(texts, "text", "left").join(pages, "page", "left")
    return held.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count("t").alias("text_leaks"), F.count("p").alias("page_leaks"))


_HASH = "sha256('1111|' || source)"


@query(f"""
SELECT source, CASE WHEN r <= 0.8 * c THEN 'train' WHEN r <= 0.9 * c THEN 'val' ELSE 'test' END AS split FROM (SELECT source, row_number() OVER (ORDER BY {_HASH}) AS r, count(*) OVER () AS c FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL))
""")
def split_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources to splits in seeded hash order; a table of sources is small."""
    sources = table(spark, sf_dir, "documents").where("source IS NOT NULL").select("source").distinct()
    order = Window.orderBy(F.sha2(F.concat(F.lit("1111|"), "source"), 256))
    ranked = sources.withColumn("r", F.row_number().over(order)).withColumn("c", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    return ranked.select("source", F.when(F.col("r") <= F.lit(0.8) * F.col("c"), "train").when(F.col("r") <= F.lit(0.9) * F.col("c"), "val").otherwise("test").alias("split"))


@query(f"""
SELECT regexp_extract(output_name, '^([a-z]+)', 1) AS place, count(*) FILTER (WHERE {_SPLIT} = 'train') AS train, count(*) FILTER (WHERE {_SPLIT} = 'val') AS val, count(*) FILTER (WHERE {_SPLIT} = 'test') AS test FROM import_rows WHERE output_name IS NOT NULL GROUP BY 1
""")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _imports(spark, sf_dir).where("output_name IS NOT NULL").select(F.regexp_extract("output_name", "^([a-z]+)", 1).alias("place"), _split().alias("s"))
    return rows.groupBy("place").agg(*[F.count_if(F.col("s") == s).alias(s) for s in ("train", "val", "test")])


@query(f"""
SELECT text, count(DISTINCT {_SPLIT}) AS n_splits, count(*) AS n FROM import_rows WHERE text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT {_SPLIT}) > 1
""")
def cross_split_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _imports(spark, sf_dir).where("text IS NOT NULL").select("text", _split().alias("s"))
    return rows.groupBy("text").agg(F.countDistinct("s").alias("n_splits"), F.count(F.lit(1)).alias("n")).where("n_splits > 1")


@query(f"""
SELECT 'name' AS rule, count(*) AS violations FROM (SELECT output_name FROM import_rows WHERE output_name IS NOT NULL GROUP BY 1 HAVING count(DISTINCT {_SPLIT}) > 1)
UNION ALL SELECT 'page', count(*) FROM (SELECT regexp_extract(output_name, '^(.*)__[0-9]+-[0-9]+\\.jpg$', 1) AS p FROM import_rows WHERE output_name IS NOT NULL GROUP BY 1 HAVING p <> '' AND count(DISTINCT {_SPLIT}) > 1)
""")
def split_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and pages that more than one split owns."""
    rows = _imports(spark, sf_dir).where("output_name IS NOT NULL").select("output_name", F.regexp_extract("output_name", r"^(.*)__[0-9]+-[0-9]+\.jpg$", 1).alias("page"), _split().alias("s"))

    def owned_twice(df: DataFrame, key: str, rule: str) -> DataFrame:
        return df.groupBy(key).agg(F.min("s").alias("a"), F.max("s").alias("b")).agg(F.count_if(F.col("a") != F.col("b")).alias("violations")).select(F.lit(rule).alias("rule"), "violations")

    return owned_twice(rows, "output_name", "name").unionByName(owned_twice(rows.where("page <> ''"), "page", "page"))


# Shapes of image references, first match wins.
_ROUTES = (("crop", r"^crops/(.+)__(\d+)__\d+\.png$", 1, 2), ("bundle", r"^bundle:([^#]+)#page=(\d+)&line=\d+$", 1, 2), ("corpus", r"^corpus/[a-z]+/([^/]+)/[^/]*_(\d+)\.jpg$", 1, 2), ("export", r"^\./export 2/(.+)_page_(\d+)_line_\d+\.jpg$", 1, 2), ("scan", r"^D:\\scans\\([^\\]+)\\f(\d+)\.tif$", 1, 2))
_ROUTE_SQL = "CASE " + " ".join(f"WHEN regexp_matches(source_image, '{p}') THEN {{'rule': '{n}', 'source': regexp_extract(source_image, '{p}', {s}), 'page': regexp_extract(source_image, '{p}', {g})}}" for n, p, s, g in _ROUTES) + " END"


@query(f"SELECT row_id, x.rule AS rule, x.source AS source, x.page AS page FROM (SELECT row_id, {_ROUTE_SQL} AS x FROM import_rows)")
def page_key_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _imports(spark, sf_dir).select("row_id", route("source_image", _ROUTES).alias("x")).select("row_id", "x.rule", "x.source", "x.page")


@query(f"""
SELECT x.rule AS rule, count(*) AS n, count(x.page) AS with_page, count(DISTINCT x.source) AS sources, round(count(x.page) / count(*), 4) AS coverage FROM (SELECT {_ROUTE_SQL} AS x FROM import_rows) GROUP BY 1
""")
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = page_key_routing(spark, sf_dir)
    return r.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.count("page").alias("with_page"), F.countDistinct("source").alias("sources"), F.round(F.count("page") / F.count(F.lit(1)), 4).alias("coverage"))


def _sql_class(name: str) -> str:
    return SCRIPT_CLASSES[name].encode().decode("unicode_escape")


_COUNTS_SQL = ", ".join(f"CAST(len(regexp_extract_all(text, '{_sql_class(s)}')) AS BIGINT) AS {s}" for s in SCRIPT_CLASSES)


@query(f"SELECT doc_id, {_COUNTS_SQL} FROM documents")
def script_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in script_counts("text").items()])


@query(f"""
SELECT main_script, count(*) AS n FROM (SELECT CASE WHEN m = 0 THEN NULL WHEN c = m THEN 'coptic' WHEN greek = m THEN 'greek' WHEN armenian = m THEN 'armenian' WHEN syriac = m THEN 'syriac' ELSE 'latin' END AS main_script
FROM (SELECT *, greatest(c, greek, armenian, syriac, latin) AS m FROM (SELECT *, CASE WHEN coptic > 0 THEN coptic + greek ELSE 0 END AS c FROM (SELECT {_COUNTS_SQL} FROM documents)))) GROUP BY 1
""")
def page_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by main script, which settles their direction."""
    return table(spark, sf_dir, "documents").groupBy(main_script("text").alias("main_script")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lang, ch, count(*) AS n FROM (SELECT lang, unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY 1, 2")
def charset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of every language, as spelled or null, with their counts; pre-aggregated before the shuffle."""
    d = table(spark, sf_dir, "documents")
    return d.select("lang", F.explode(F.split("text", "")).alias("ch")).where("ch <> ''").groupBy("lang", "ch").agg(F.count(F.lit(1)).alias("n"))


def _lines(spark: SparkSession, sf_dir: str, part: str) -> DataFrame:
    return table(spark, sf_dir, "release_lines").where(F.col("text").isNotNull() & F.lower("manuscript").contains(part)).select("line_id", "text")


@query("SELECT line_id, regexp_replace(translate(text, '{}', '{}'), ':{{2,}}', ':', 'g') AS gt FROM release_lines WHERE text IS NOT NULL AND contains(lower(manuscript), 'gr')".format(GREEK_FROM.replace("'", "''"), GREEK_TO))
def greek_ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, "gr").select("line_id", greek_gt("text").alias("gt"))


@query("SELECT line_id, regexp_replace(regexp_replace(replace(translate(nfc_normalize(text), '-', '\u058a'), '\u0565\u0582', '\u0587'), ' {2,}', ' ', 'g'), ' +$', '') AS gt FROM release_lines WHERE text IS NOT NULL AND contains(lower(manuscript), 'arm')")
def armenian_ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, "arm").select("line_id", armenian_gt("text").alias("gt"))


@query()
def coptic_ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, "copt").select("line_id", coptic_gt("text").alias("gt"))


@query()
def syriac_ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, "syr").select("line_id", syriac_gt("text").alias("gt"))


@query()
def editorial_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of each editorial rule over all Greek documents."""
    d = table(spark, sf_dir, "documents")
    _, counts = greek_editorial("text")
    sums = d.agg(*[F.sum(c).alias(n) for n, c in counts.items()])
    return sums.select(F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in counts]), F.array(*[F.coalesce(F.col(f"`{n}`"), F.lit(0)) for n in counts]))).alias("rule", "hits"))


@query("SELECT source, count(*) AS n_docs, round(avg(n_chars), 3) AS avg_chars, min(n_chars) AS min_chars, max(n_chars) AS max_chars, CAST(sum(n_chars) AS BIGINT) AS sum_chars FROM documents GROUP BY 1")
def dataset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.avg("n_chars"), 3).alias("avg_chars"), F.min("n_chars").alias("min_chars"), F.max("n_chars").alias("max_chars"), F.sum("n_chars").alias("sum_chars"))


@query("SELECT doc_id, (row_number() OVER (PARTITION BY source ORDER BY sha256('7|' || CAST(doc_id AS VARCHAR))) - 1) % 5 AS fold FROM documents")
def kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("source").orderBy(F.sha2(F.concat(F.lit("7|"), F.col("doc_id").cast("string")), 256))
    return table(spark, sf_dir, "documents").select("doc_id", ((F.row_number().over(w) - 1) % 5).cast("bigint").alias("fold"))


@query("""
WITH r AS (SELECT DISTINCT line_id, text FROM release_lines), p AS (SELECT DISTINCT line_id, text FROM transcribe_responses)
SELECT 'inner' AS mode, count(*) AS n FROM r JOIN p USING (line_id) UNION ALL SELECT 'missing prediction', count(*) FROM r WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.line_id = r.line_id) UNION ALL SELECT 'missing line', count(*) FROM p WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.line_id = p.line_id)
""")
def label_join_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, p = (table(spark, sf_dir, t).select("line_id", "text").distinct() for t in ("release_lines", "transcribe_responses"))
    n = F.count(F.lit(1)).alias("n")
    parts = [("inner", r.select("line_id").join(p.select("line_id"), "line_id")), ("missing prediction", r.join(p, "line_id", "left_anti")), ("missing line", p.join(r, "line_id", "left_anti"))]
    out = None
    for mode, df in parts:
        one = df.agg(n).select(F.lit(mode).alias("mode"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("""
SELECT doc_id, line, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS BIGINT) AS line_order FROM (SELECT doc_id, i, trim(l[i], chr(32) || chr(9) || chr(13)) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)) WHERE line <> ''
""")
def imported_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's text as its non-empty trimmed lines, in order."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, r"^[ \t\r]+|[ \t\r]+$", "")), lambda x: x != "")
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(lines).alias("p", "line")).select("doc_id", "line", F.col("p").cast("bigint").alias("line_order"))


@query("""
SELECT manuscript, page_index, sha256(string_agg(coalesce(text, ''), chr(10) ORDER BY line_index, line_id)) AS page_hash, count(*) AS n FROM (SELECT DISTINCT manuscript, page_index, line_index, line_id, text FROM release_lines WHERE manuscript IS NOT NULL) GROUP BY 1, 2
""")
def page_text_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's text in line order, by its hash."""
    rows = table(spark, sf_dir, "release_lines").where("manuscript IS NOT NULL").select("manuscript", "page_index", "line_index", "line_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    ordered = F.array_sort(F.collect_list(F.struct("line_index", "line_id", "text")))
    return rows.groupBy("manuscript", "page_index").agg(ordered.alias("l")).select("manuscript", "page_index", F.sha2(F.array_join(F.transform("l", lambda x: x["text"]), "\n"), 256).alias("page_hash"), F.size("l").cast("bigint").alias("n"))


@query("SELECT prefix, stem, row_number() OVER (PARTITION BY prefix ORDER BY num, stem) AS position FROM (SELECT stem, regexp_extract(stem, '^(.*)_page_[0-9]+$', 1) AS prefix, CAST(regexp_extract(stem, '_page_([0-9]+)$', 1) AS INTEGER) AS num, count(*) OVER (PARTITION BY regexp_extract(stem, '^(.*)_page_[0-9]+$', 1)) AS c FROM (SELECT DISTINCT stem FROM page_xml_bundles WHERE regexp_matches(stem, '_page_[0-9]+$')))")
def prefix_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page stems of a book in the order of their numbers."""
    s = table(spark, sf_dir, "page_xml_bundles").where(F.col("stem").rlike("_page_[0-9]+$")).select("stem").distinct()
    s = s.select("stem", F.regexp_extract("stem", "^(.*)_page_[0-9]+$", 1).alias("prefix"), F.regexp_extract("stem", "_page_([0-9]+)$", 1).cast("int").alias("num"))
    return s.select("prefix", "stem", F.row_number().over(Window.partitionBy("prefix").orderBy("num", "stem")).cast("bigint").alias("position"))


@query("SELECT doc_id, copy FROM (SELECT doc_id, unnest(generate_series(1, CASE WHEN source = 'acts' THEN 3 ELSE 1 END)) AS copy FROM documents)")
def oversample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole mix, null sources too, with the chosen source repeated."""
    times = F.when(F.col("source") == "acts", 3).otherwise(1)
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(1).cast("bigint"), times.cast("bigint"))).alias("copy"))


@query("""
WITH a AS (SELECT line_id, max(text) AS text FROM release_lines WHERE text IS NOT NULL GROUP BY 1), u AS (SELECT line_id, max(text) AS new_text FROM transcribe_responses WHERE confidence > 0.95 AND text IS NOT NULL GROUP BY 1)
SELECT coalesce(new_text = text, true) AS unchanged, count(*) AS n FROM a LEFT JOIN u USING (line_id) GROUP BY 1
""")
def manifest_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts replaced by name where a newer one is given: how many change."""
    a = table(spark, sf_dir, "release_lines").where("text IS NOT NULL").groupBy("line_id").agg(F.max("text").alias("text"))
    u = table(spark, sf_dir, "transcribe_responses").where("confidence > 0.95 AND text IS NOT NULL").groupBy("line_id").agg(F.max("text").alias("new_text"))
    return a.join(u, "line_id", "left").groupBy(F.coalesce(F.col("new_text") == F.col("text"), F.lit(True)).alias("unchanged")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT slug, count(*) AS n, count(DISTINCT shelfmark) AS spellings FROM (SELECT regexp_replace(regexp_replace(lower(shelfmark), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, shelfmark FROM release_lines WHERE shelfmark IS NOT NULL) GROUP BY 1")
def shelfmark_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "release_lines").where("shelfmark IS NOT NULL").select(slug("shelfmark").alias("slug"), "shelfmark")
    return rows.groupBy("slug").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("shelfmark").alias("spellings"))


_PAGE = r"^(.*)__[0-9]+-[0-9]+\.jpg$"


def text_page_edges(rows: DataFrame) -> DataFrame:
    """Edges ``record``, ``entity`` between texts and pages; a row without a page stands by its text alone."""
    page = F.concat(F.lit("p:"), F.nullif(F.regexp_extract("output_name", _PAGE, 1), F.lit("")))
    pairs = rows.where("text IS NOT NULL").select(page.alias("page"), F.concat(F.lit("t:"), F.sha2("text", 256)).alias("text")).distinct()
    return pairs.select(F.concat_ws("|", "page", "text").alias("record"), F.explode(F.array_compact(F.array("page", "text"))).alias("entity"))


@query()
def text_page_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import rows joined by equal texts or equal pages: component of each page and text.

    A row without a page goes with the rows of its text, and so with the page of a dropped twin.
    """
    return components(text_page_edges(_imports(spark, sf_dir)))


@query("SELECT count(*) FILTER (WHERE l.line_id IS NOT NULL) AS present, count(*) FILTER (WHERE l.line_id IS NULL) AS missing, r.model_name FROM transcribe_responses r LEFT JOIN (SELECT DISTINCT line_id FROM release_lines WHERE image_shipped) l USING (line_id) GROUP BY r.model_name")
def image_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses whose line image was shipped, by model."""
    shipped = table(spark, sf_dir, "release_lines").where("image_shipped").select("line_id", F.lit(True).alias("there")).distinct()
    return table(spark, sf_dir, "transcribe_responses").join(shipped, "line_id", "left").groupBy("model_name").agg(F.count_if(F.col("there")).alias("present"), F.count_if(F.col("there").isNull()).alias("missing"))


@query("""
SELECT grp, shelfmark AS winner FROM (SELECT grp, shelfmark, row_number() OVER (PARTITION BY grp ORDER BY n DESC, shelfmark) AS r FROM (SELECT lower(manuscript) AS grp, shelfmark, count(*) AS n FROM release_lines WHERE manuscript IS NOT NULL AND shelfmark IS NOT NULL GROUP BY 1, 2)) WHERE r = 1
""")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest shelfmark of each manuscript, ties to the least."""
    votes = table(spark, sf_dir, "release_lines").where("manuscript IS NOT NULL AND shelfmark IS NOT NULL").groupBy(F.lower("manuscript").alias("grp"), "shelfmark").agg(F.count(F.lit(1)).alias("n"))
    top = votes.groupBy("grp").agg(F.max("n").alias("n"))
    return votes.join(top, ["grp", "n"]).groupBy("grp").agg(F.min("shelfmark").alias("winner"))
