"""Record-level operators: scopes, keyed joins, nested rows, rankings, set checks, overlays and merges of layers.

The star schema plays the operational tables as in ``operations``; the domain tables stand for themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codexlake.operators.relational import keep_newest, ratio
from codexlake.plans.catalog import query
from codexlake.runtime import table

# Conditions of each scope of a batch; the narrower scopes add to ``all``.
SCOPES = {"all": "true", "open": "o_orderstatus <> 'F'", "urgent": "o_orderstatus <> 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')", "large": "o_totalprice >= 300000"}


def scoped(df: DataFrame, scope: str) -> DataFrame:
    """Rows of a named scope; an unknown scope is an error."""
    if scope not in SCOPES:
        raise ValueError(f"unknown scope {scope!r}, one of {', '.join(SCOPES)}")
    return df.where(SCOPES[scope])


@query(" UNION ALL ".join(f"SELECT '{n}' AS scope, count(*) AS n FROM orders WHERE {c}" for n, c in SCOPES.items()))
def scope_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every scope in one pass over the table."""
    counts = table(spark, sf_dir, "orders").agg(*[F.count_if(F.expr(c)).alias(n) for n, c in SCOPES.items()])
    return counts.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, SCOPES)), F.array(*[F.col(f"`{n}`") for n in SCOPES]))).alias("scope", "n"))


@query("SELECT event_id FROM events WHERE (event_type = 'error' AND value < 5) OR (event_type IN ('click', 'view') AND (value >= 45 OR CAST(json_extract(props, '$.k') AS BIGINT) = 7))")
def retention_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested AND / OR retention predicate."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    seen = F.col("event_type").isin("click", "view") & ((F.col("value") >= 45) | (k == 7))
    return table(spark, sf_dir, "events").where(((F.col("event_type") == "error") & (F.col("value") < 5)) | seen).select("event_id")


_SCOPE_KEY = ("shelfmark", "folio", "source_url")


@query("""
WITH r AS (SELECT DISTINCT line_id, manuscript, shelfmark, folio, source_url FROM release_lines), b AS (SELECT shelfmark, folio, source_url, count(*) AS n FROM r GROUP BY 1, 2, 3)
SELECT line_id, max(b.n) AS same_scope FROM r JOIN b ON r.shelfmark IS NOT DISTINCT FROM b.shelfmark AND r.folio IS NOT DISTINCT FROM b.folio AND r.source_url IS NOT DISTINCT FROM b.source_url GROUP BY 1
""")
def null_equal_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that share three optional scope columns, null equal to null: a null-safe hash join."""
    r = table(spark, sf_dir, "release_lines").select("line_id", "manuscript", *_SCOPE_KEY).distinct()
    b = r.groupBy(*_SCOPE_KEY).agg(F.count(F.lit(1)).alias("n"))
    same = F.lit(True)
    for c in _SCOPE_KEY:
        same = same & r[c].eqNullSafe(b[c])
    return r.join(b, same).groupBy("line_id").agg(F.max("n").alias("same_scope"))


@query("SELECT o_orderkey, CASE WHEN p.pos IS NULL THEN o_orderpriority ELSE p.pos || ':' || o_orderpriority END AS label FROM orders LEFT JOIN (VALUES ('1-URGENT', 10), ('2-HIGH', 20), ('5-LOW', 90)) p(k, pos) ON p.k = o_orderpriority")
def bulk_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulk remap of positions: a join to the table of positions instead of a chain of cases."""
    positions = spark.createDataFrame([("1-URGENT", 10), ("2-HIGH", 20), ("5-LOW", 90)], "o_orderpriority string, pos int")
    return table(spark, sf_dir, "orders").join(positions, "o_orderpriority", "left").select("o_orderkey", F.coalesce(F.concat_ws(":", F.col("pos").cast("string"), F.when(F.col("pos").isNotNull(), F.col("o_orderpriority"))), F.lit("")).alias("l"), "o_orderpriority", "pos").select("o_orderkey", F.when(F.col("pos").isNull(), F.col("o_orderpriority")).otherwise(F.col("l")).alias("label"))


@query("SELECT o_orderkey, (o_custkey % 2 = 0 OR EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_suppkey < 3) OR o_orderpriority = '1-URGENT') AS readable FROM orders o")
def access_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access as a boolean of every row: owner, member (a pre-aggregated join) or share link."""
    shared = table(spark, sf_dir, "lineitem").where("l_suppkey < 3").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(True).alias("member")).distinct()
    readable = (F.col("o_custkey") % 2 == 0) | F.coalesce("member", F.lit(False)) | (F.col("o_orderpriority") == "1-URGENT")
    return table(spark, sf_dir, "orders").join(shared, "o_orderkey", "left").select("o_orderkey", readable.alias("readable"))


@query("SELECT row_id FROM import_rows WHERE output_name NOT IN (SELECT min(output_name) FROM import_rows GROUP BY split)")
def drop_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a drop list of names doesn't hold; rows without a name are dropped too."""
    rows = table(spark, sf_dir, "import_rows").where("output_name IS NOT NULL")
    return rows.join(rows.groupBy("split").agg(F.min("output_name").alias("output_name")).select("output_name"), "output_name", "left_anti").select("row_id")


# Spellings of the splits.
SPLIT_NAMES = {"train": "train", "training": "train", "val": "val", "valid": "val", "validation": "val", "dev": "val", "test": "test"}


def split_name(column: str, strict: bool = True) -> Column:
    """Delivered split by its spelling; null stays null, an unknown one is an error (or null, if not ``strict``)."""
    known = F.create_map(*[F.lit(x) for pair in SPLIT_NAMES.items() for x in pair])[F.lower(F.trim(column))]
    if not strict:
        return known
    return F.when(F.col(column).isNull() | known.isNotNull(), known).otherwise(F.raise_error(F.concat(F.lit("unknown split "), column)).cast("string"))


@query("SELECT CASE WHEN lower(trim(split)) IN ('train', 'training') THEN 'train' WHEN lower(trim(split)) IN ('val', 'valid', 'validation', 'dev') THEN 'val' WHEN lower(trim(split)) = 'test' THEN 'test' END AS split, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS fraction FROM import_rows GROUP BY 1")
def split_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and fractions of the splits; an unknown spelling stops the query."""
    n = table(spark, sf_dir, "import_rows").groupBy(split_name("split").alias("split")).agg(F.count(F.lit(1)).alias("n"))
    whole = n.agg(F.sum("n").alias("whole"))
    return n.join(F.broadcast(whole)).select("split", "n", F.round(F.col("n") / F.col("whole"), 6).alias("fraction"))


def assert_pure(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """The rows unchanged; a row whose ``column`` begins with ``prefix`` is an error when it is read."""
    clean = F.when(F.col(column).startswith(prefix), F.raise_error(F.concat(F.lit("foreign row "), column))).otherwise(F.col(column))
    return df.withColumn(column, clean)


@query("SELECT user_id, max(k) AS k, max(CASE WHEN event_type = 'error' THEN value END) AS override, coalesce(max(CASE WHEN event_type = 'error' THEN value END), 0.5) AS threshold FROM (SELECT user_id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1")
def param_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Default parameters updated by overrides, the later map wins by key."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.get_json_object("props", "$.k").cast("bigint")).alias("k"), F.max(F.when(F.col("event_type") == "error", F.col("value"))).alias("override"))
    defaults = F.create_map(F.lit("threshold"), F.lit(0.5))
    overrides = F.map_filter(F.create_map(F.lit("threshold"), F.col("override")), lambda _, v: v.isNotNull())
    return e.select("user_id", "k", "override", merged_maps(defaults, overrides)["threshold"].alias("threshold"))


def merged_maps(first: Column, second: Column) -> Column:
    """Both maps as one; where they share a key the second wins, whatever the session's policy for repeated keys."""
    return F.map_concat(F.map_filter(first, lambda k, _: ~F.array_contains(F.map_keys(second), k)), second)


@query("SELECT id AS line_id, segmentation_run_id AS run_id, EXISTS (SELECT 1 FROM segmentation_runs r WHERE r.id = l.segmentation_run_id) AS found FROM (SELECT DISTINCT id, segmentation_run_id FROM live_lines WHERE segmentation_run_id IS NOT NULL) l")
def run_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup by a set of ids in one query; ids that are missing are told, not dropped."""
    runs = table(spark, sf_dir, "segmentation_runs").select(F.col("id").alias("run_id"), F.lit(True).alias("there")).distinct()
    asked = table(spark, sf_dir, "live_lines").where("segmentation_run_id IS NOT NULL").select(F.col("id").alias("line_id"), F.col("segmentation_run_id").alias("run_id")).distinct()
    return asked.join(runs, "run_id", "left").select("line_id", "run_id", F.coalesce("there", F.lit(False)).alias("found"))


@query("""
WITH d AS (SELECT manuscript, page_index, line_index, min(line_id) AS line_id FROM release_lines WHERE manuscript IS NOT NULL GROUP BY 1, 2, 3)
SELECT p.row_id, coalesce(d.line_id, '') AS line_id FROM (SELECT row_id, regexp_extract(output_name, '^(.*)__0*([0-9]+)__0*([0-9]+)-[0-9]+\\.jpg$', 1) AS m, TRY_CAST(regexp_extract(output_name, '^(.*)__0*([0-9]+)__0*([0-9]+)-[0-9]+\\.jpg$', 2) AS INTEGER) AS page, TRY_CAST(regexp_extract(output_name, '^(.*)__0*([0-9]+)__0*([0-9]+)-[0-9]+\\.jpg$', 3) AS INTEGER) AS line FROM import_rows) p
LEFT JOIN d ON d.manuscript = p.m AND d.page_index = p.page AND d.line_index = p.line
""")
def composite_key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary join on (manuscript, page, line), '' where there is none."""
    pattern = r"^(.*)__0*([0-9]+)__0*([0-9]+)-[0-9]+\.jpg$"
    part = [F.regexp_extract("output_name", pattern, i) for i in (1, 2, 3)]
    asked = table(spark, sf_dir, "import_rows").select("row_id", part[0].alias("manuscript"), part[1].try_cast("int").alias("page_index"), part[2].try_cast("int").alias("line_index"))
    known = table(spark, sf_dir, "release_lines").where("manuscript IS NOT NULL").groupBy("manuscript", "page_index", "line_index").agg(F.min("line_id").alias("line_id"))
    return asked.join(known, ["manuscript", "page_index", "line_index"], "left").select("row_id", F.coalesce("line_id", F.lit("")).alias("line_id"))


@query("SELECT l.id, p.first_response FROM (SELECT DISTINCT line_id AS id FROM release_lines) l LEFT JOIN (SELECT line_id, min(response_id) AS first_response FROM transcribe_responses GROUP BY 1) p ON p.line_id = l.id")
def first_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout with the earliest pairing of each segment; null where it has none."""
    pairs = table(spark, sf_dir, "transcribe_responses").groupBy(F.col("line_id").alias("id")).agg(F.min("response_id").alias("first_response"))
    return table(spark, sf_dir, "release_lines").select(F.col("line_id").alias("id")).distinct().join(pairs, "id", "left")


_DIFF_RUN = "SELECT part_id, max(struct_pack(created_at := created_at, id := id)).id AS run_id FROM segmentation_runs WHERE part_id IS NOT NULL GROUP BY 1"


@query(f"""
WITH n AS ({_DIFF_RUN}), r AS (SELECT DISTINCT n.part_id, n.run_id, l.external_id AS ext, l.points AS points FROM n JOIN (SELECT id, part_id, unnest(run_lines) AS l FROM segmentation_runs) s ON s.id = n.run_id AND s.part_id = n.part_id WHERE l.external_id IS NOT NULL),
v AS (SELECT id, max(part_id) AS part_id, max(segmentation_run_id) AS run_id, max(run_external_id) AS ext, max(points) AS points FROM live_lines WHERE id IS NOT NULL GROUP BY 1),
k AS (SELECT n.part_id, v.* EXCLUDE (part_id) FROM n JOIN v ON v.part_id = n.part_id AND v.run_id = n.run_id AND v.ext IS NOT NULL),
o AS (SELECT r.part_id, r.ext, count(k.id) AS n_live, count(k.id) FILTER (WHERE k.points = r.points) AS n_same FROM r LEFT JOIN k ON k.part_id = r.part_id AND k.ext = r.ext GROUP BY 1, 2)
SELECT CASE WHEN n_live = 0 THEN 'deleted' WHEN n_live > 1 THEN 'split' WHEN n_same = 1 THEN 'unchanged' ELSE 'corrected' END AS change, count(*) AS n FROM o GROUP BY 1
UNION ALL SELECT 'added', count(*) FROM (SELECT v.id FROM n JOIN v ON v.part_id = n.part_id LEFT JOIN r ON r.part_id = v.part_id AND r.run_id = v.run_id AND r.ext = v.ext WHERE r.ext IS NULL)
""")
def provenance_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's lines against the live lines that came from them, one to many: unchanged, corrected, split, deleted, added."""
    runs = table(spark, sf_dir, "segmentation_runs").where("part_id IS NOT NULL")
    newest = runs.groupBy("part_id").agg(F.max(F.struct("created_at", "id")).alias("r")).select("part_id", F.col("r.id").alias("run_id"))
    listed = runs.select(F.col("id").alias("run_id"), "part_id", F.explode("run_lines").alias("l")).join(newest, ["part_id", "run_id"], "left_semi").where("l.external_id IS NOT NULL").select("part_id", "run_id", F.col("l.external_id").alias("ext"), F.col("l.points").alias("points")).distinct()
    live = table(spark, sf_dir, "live_lines").where("id IS NOT NULL").groupBy("id").agg(F.max("part_id").alias("part_id"), F.max("segmentation_run_id").alias("run_id"), F.max("run_external_id").alias("ext"), F.max("points").alias("live_points"))
    live = live.join(newest.select("part_id"), "part_id", "left_semi")
    met = listed.join(live, ["part_id", "run_id", "ext"], "left").groupBy("part_id", "ext").agg(F.count("id").alias("n_live"), F.count_if(F.col("points") == F.col("live_points")).alias("n_same"))
    change = F.when(F.col("n_live") == 0, "deleted").when(F.col("n_live") > 1, "split").when(F.col("n_same") == 1, "unchanged").otherwise("corrected")
    added = live.join(listed, ["part_id", "run_id", "ext"], "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("added").alias("change"), "n")
    return met.groupBy(change.alias("change")).agg(F.count(F.lit(1)).alias("n")).unionByName(added)


@query("""
WITH l AS (SELECT line_id, max(text_source) AS ts FROM release_lines GROUP BY 1), r AS (SELECT line_id, count(*) AS n FROM transcribe_responses GROUP BY 1)
SELECT r.line_id, coalesce(l.ts, '(missing)') AS source, r.n, r.n > 1 AS repeated FROM r LEFT JOIN l USING (line_id)
""")
def label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name lookup over all manifests: misses and repeated names are marked."""
    known = table(spark, sf_dir, "release_lines").groupBy("line_id").agg(F.max("text_source").alias("source"))
    asked = table(spark, sf_dir, "transcribe_responses").where("line_id IS NOT NULL").groupBy("line_id").agg(F.count(F.lit(1)).alias("n"))
    return asked.join(known, "line_id", "left").select("line_id", F.coalesce("source", F.lit("(missing)")).alias("source"), "n", (F.col("n") > 1).alias("repeated"))


@query("""
WITH a AS (SELECT o_custkey AS k, o_orderkey AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey AS k, o_orderkey AS b, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders WHERE o_orderstatus = 'O')
SELECT coalesce(a.k, b.k) AS owner, coalesce(a.i, b.i) AS position, a.a AS done, b.b AS open FROM a FULL OUTER JOIN b ON a.k = b.k AND a.i = b.i
""")
def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists of each owner joined by position; the longer one's rest has no partner."""
    orders = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")

    def numbered(status: str, name: str) -> DataFrame:
        return orders.where(F.col("o_orderstatus") == status).select(F.col("o_custkey").alias("owner"), F.row_number().over(w).cast("bigint").alias("position"), F.col("o_orderkey").alias(name))

    return numbered("F", "done").join(numbered("O", "open"), ["owner", "position"], "full_outer")


@query("""
SELECT coalesce(a.line_id, b.line_id) AS line_id, CASE WHEN b.line_id IS NULL THEN 'only left' WHEN a.line_id IS NULL THEN 'only right' ELSE 'both' END AS side FROM (SELECT DISTINCT line_id FROM release_lines) a FULL OUTER JOIN (SELECT DISTINCT line_id FROM transcribe_responses) b ON a.line_id = b.line_id
""")
def id_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of two systems: in both, only left, only right; a null id has no partner."""
    a, b = (table(spark, sf_dir, t).select("line_id").distinct().withColumn(s, F.lit(True)) for t, s in (("release_lines", "l"), ("transcribe_responses", "r")))
    return a.join(b, "line_id", "full_outer").select("line_id", F.when(F.col("r").isNull(), "only left").when(F.col("l").isNull(), "only right").otherwise("both").alias("side"))


@query("SELECT f.id, f.user_id, c_name, c_mktsegment FROM (SELECT DISTINCT id, user_id, created_at FROM feedback) f JOIN customer ON c_custkey = f.user_id ORDER BY f.created_at DESC, f.id LIMIT 200")
def feedback_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 newest notes with their authors (the report is a top 200)."""
    notes = table(spark, sf_dir, "feedback").select("id", "user_id", "created_at").distinct()
    return notes.join(table(spark, sf_dir, "customer"), F.col("user_id") == F.col("c_custkey")).orderBy(F.desc("created_at"), "id").limit(200).select("id", "user_id", "c_name", "c_mktsegment")


@query("SELECT DISTINCT c_nationkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_returnflag = 'R'")
def parents_through_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct ancestors reached through two joins, pre-aggregated at every level."""
    pages = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    owners = table(spark, sf_dir, "orders").join(pages, "o_orderkey", "left_semi").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return table(spark, sf_dir, "customer").join(owners, "c_custkey", "left_semi").select("c_nationkey").distinct()


@query("""
WITH r AS (SELECT id, part_id, CAST(json_extract(params, '$.heatmap_threshold') AS DOUBLE) AS threshold, row_number() OVER (PARTITION BY id, part_id ORDER BY created_at) AS i FROM segmentation_runs)
SELECT l.id, r.threshold, r.id IS NULL AS unmatched FROM (SELECT DISTINCT id, part_id, segmentation_run_id AS run_id FROM live_lines WHERE segmentation_run_id IS NOT NULL) l LEFT JOIN r ON r.id = l.run_id AND r.part_id = l.part_id AND r.i = 1
""")
def backfill_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provenance backfill: live lines get a parameter out of the JSON of the run that (run, part) names."""
    runs = table(spark, sf_dir, "segmentation_runs")
    first = runs.groupBy(F.col("id").alias("run_id"), "part_id").agg(F.min_by("params", "created_at").alias("params"), F.lit(True).alias("there"))
    lines = table(spark, sf_dir, "live_lines").where("segmentation_run_id IS NOT NULL").select("id", "part_id", F.col("segmentation_run_id").alias("run_id")).distinct()
    return lines.join(first, ["run_id", "part_id"], "left").select("id", F.get_json_object("params", "$.heatmap_threshold").cast("double").alias("threshold"), F.col("there").isNull().alias("unmatched"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS route, count(*) FILTER (WHERE value >= 20) AS failures, count(*) AS requests FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 14 DAY GROUP BY 1, 2")
def failures_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures of the last 14 days by day and route; the window ends at the newest event, not at the clock."""
    events = table(spark, sf_dir, "events")
    last = events.agg(F.max("ts").alias("last"))
    recent = events.join(F.broadcast(last)).where(F.col("ts") > F.col("last") - F.expr("INTERVAL 14 DAYS"))
    return recent.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("route")).agg(F.count_if(F.col("value") >= 20).alias("failures"), F.count(F.lit(1)).alias("requests"))


@query("""
SELECT part_id, CAST(max(paired_line_count) AS BIGINT) AS paired, CAST(max(line_count) AS BIGINT) AS total, CASE WHEN max(line_count) > 0 THEN CAST(round_even(100.0 * max(paired_line_count) / max(line_count), 0) AS BIGINT) ELSE 0 END AS percent FROM annotation_history_snapshots WHERE part_id IS NOT NULL GROUP BY 1
""")
def pairing_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired lines of each page in percent, half to even, 0 for a page without lines."""
    s = table(spark, sf_dir, "annotation_history_snapshots").where("part_id IS NOT NULL").groupBy("part_id").agg(F.max("paired_line_count").cast("bigint").alias("paired"), F.max("line_count").cast("bigint").alias("total"))
    return s.select("part_id", "paired", "total", F.when(F.col("total") > 0, F.bround(100.0 * F.col("paired") / F.col("total")).cast("bigint")).otherwise(F.lit(0)).alias("percent"))


@query("SELECT coalesce(manuscript, '(none)') AS manuscript, count(DISTINCT page_index) AS pages, count(DISTINCT line_id) AS lines, count(DISTINCT line_id) FILTER (WHERE image_shipped) AS shipped FROM release_lines GROUP BY 1")
def build_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, lines and shipped images of each manuscript."""
    shipped = F.when(F.col("image_shipped"), F.col("line_id"))
    return table(spark, sf_dir, "release_lines").groupBy(F.coalesce("manuscript", F.lit("(none)")).alias("manuscript")).agg(F.countDistinct("page_index").alias("pages"), F.countDistinct("line_id").alias("lines"), F.countDistinct(shipped).alias("shipped"))


@query("""
SELECT l.part_id, CAST(l.n AS BIGINT) AS found, CAST(r.n AS BIGINT) AS expected FROM (SELECT part_id, count(DISTINCT id) AS n FROM live_lines WHERE part_id IS NOT NULL GROUP BY 1) l JOIN (SELECT part_id, max(line_count) AS n FROM segmentation_runs WHERE part_id IS NOT NULL GROUP BY 1) r USING (part_id) WHERE l.n <> r.n
""")
def line_counts_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose lines differ in number from what their runs announced."""
    found = table(spark, sf_dir, "live_lines").where("part_id IS NOT NULL").groupBy("part_id").agg(F.countDistinct("id").alias("found"))
    expected = table(spark, sf_dir, "segmentation_runs").where("part_id IS NOT NULL").groupBy("part_id").agg(F.max("line_count").cast("bigint").alias("expected"))
    return found.join(expected, "part_id").where("found <> expected")


_VERDICTS = ("identical", "numeric", "mismatch")


@query("""
SELECT model, CASE max(v) WHEN 0 THEN 'identical' WHEN 1 THEN 'numeric' ELSE 'mismatch' END AS worst, count(*) AS n FROM (SELECT coalesce(model_name, '(none)') AS model, CASE WHEN r.text = l.text THEN 0 WHEN length(r.text) = length(l.text) THEN 1 ELSE 2 END AS v FROM (SELECT DISTINCT response_id, line_id, model_name, text FROM transcribe_responses WHERE text IS NOT NULL) r JOIN (SELECT line_id, max(text) AS text FROM release_lines WHERE text IS NOT NULL GROUP BY 1) l USING (line_id)) GROUP BY 1
""")
def worst_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst verdict of each model, by rank in the lattice identical < numeric < mismatch."""
    said = table(spark, sf_dir, "transcribe_responses").where("text IS NOT NULL").select("response_id", "line_id", F.coalesce("model_name", F.lit("(none)")).alias("model"), "text").distinct()
    lines = table(spark, sf_dir, "release_lines").where("text IS NOT NULL").groupBy("line_id").agg(F.max("text").alias("ref"))
    rank = F.when(F.col("text") == F.col("ref"), 0).when(F.length("text") == F.length("ref"), 1).otherwise(2)
    return said.join(lines, "line_id").groupBy("model").agg(F.element_at(F.array(*map(F.lit, _VERDICTS)), F.max(rank) + 1).alias("worst"), F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, max(coalesce(n, 0)) + 1 AS next_position FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) GROUP BY 1")
def next_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position for a new page of each owner: the greatest one and one more."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.count(F.lit(1)) + 1).alias("next_position"))


@query("SELECT event_type AS route, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, route")
def busiest_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("route")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "route")


@query("SELECT event_id, value FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 200")
def newest_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ring buffer of the 200 newest failures (its size is the feature)."""
    return table(spark, sf_dir, "events").where("event_type = 'error'").orderBy(F.desc("ts"), F.desc("event_id")).limit(200).select("event_id", "value")


_BBOX = "SELECT line_id, max(manuscript) AS manuscript, max(page_index) AS page_index, max(bbox) AS bbox FROM release_lines WHERE line_id IS NOT NULL AND bbox IS NOT NULL AND manuscript IS NOT NULL GROUP BY 1"


def _bboxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "release_lines").where("line_id IS NOT NULL AND bbox IS NOT NULL AND manuscript IS NOT NULL").groupBy("line_id").agg(F.max("manuscript").alias("manuscript"), F.max("page_index").alias("page_index"), F.max("bbox").alias("bbox"))


@query(f"""
SELECT line_id, r AS rank FROM (SELECT line_id, row_number() OVER (PARTITION BY manuscript, page_index ORDER BY (bbox[3] - bbox[1]) DESC, bbox[2], bbox[1], line_id) AS r FROM ({_BBOX})) WHERE r <= 3
""")
def top_k_per_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three widest lines of each page, ties by place (the cap is the operator)."""
    b = F.col("bbox")
    return keep_newest(_bboxes(spark, sf_dir), ["manuscript", "page_index"], [F.desc(b[2] - b[0]), b[1], b[0], F.col("line_id")], 3).select("line_id", F.col("rank").cast("bigint").alias("rank"))


@query(f"""
WITH b AS ({_BBOX}), m AS (SELECT manuscript, page_index, count(*) AS n FROM b GROUP BY 1, 2)
SELECT line_id FROM (SELECT line_id, n, row_number() OVER (PARTITION BY manuscript, page_index ORDER BY bbox[4] - bbox[2], line_id) AS r FROM b JOIN m USING (manuscript, page_index)) WHERE r > greatest(0, n - 20)
""")
def worst_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages keep twenty lines: as many of the flattest are dropped as a page has too many (the count is the constraint)."""
    page = ["manuscript", "page_index"]
    b = _bboxes(spark, sf_dir)
    extra = b.groupBy(*page).agg(F.greatest(F.lit(0), F.count(F.lit(1)) - 20).alias("extra"))
    order = Window.partitionBy(*page).orderBy(F.col("bbox")[3] - F.col("bbox")[1], "line_id")
    return b.join(extra, page).withColumn("r", F.row_number().over(order)).where("r > extra").select("line_id")


@query("""
SELECT line_id, row_number() OVER (PARTITION BY manuscript, page_index ORDER BY n IS NULL, n, y, x, line_id) - 1 AS position FROM (SELECT line_id, max(manuscript) AS manuscript, max(page_index) AS page_index, max(bbox[2]) AS y, max(bbox[1]) AS x, max(p.n) AS n FROM release_lines LEFT JOIN (SELECT line_id, min(response_id) AS n FROM transcribe_responses GROUP BY 1) p USING (line_id) WHERE line_id IS NOT NULL AND manuscript IS NOT NULL GROUP BY 1)
""")
def paired_first_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired lines first, in the order of their texts, then the others by their place."""
    paired = table(spark, sf_dir, "transcribe_responses").groupBy("line_id").agg(F.min("response_id").alias("n"))
    lines = table(spark, sf_dir, "release_lines").where("line_id IS NOT NULL AND manuscript IS NOT NULL").groupBy("line_id").agg(F.max("manuscript").alias("manuscript"), F.max("page_index").alias("page_index"), F.max(F.col("bbox")[1]).alias("y"), F.max(F.col("bbox")[0]).alias("x"))
    w = Window.partitionBy("manuscript", "page_index").orderBy(F.col("n").isNull(), "n", F.asc_nulls_last("y"), F.asc_nulls_last("x"), "line_id")
    return lines.join(paired, "line_id", "left").select("line_id", (F.row_number().over(w) - 1).cast("bigint").alias("position"))


def folio_key(column: str) -> tuple[Column, Column, Column]:
    """Sort key of a folio label: number, recto before verso, then the label; labels without a number last."""
    number = F.regexp_extract(column, r"([0-9]+)\s*[rv]?", 1).try_cast("int")
    side = F.when(F.regexp_extract(column, r"[0-9]+\s*([rv])", 1) == "v", 1).otherwise(0)
    return F.coalesce(number, F.lit(2**31 - 1)), side, F.col(column)


def next_folio(column: str) -> Column:
    """The folio after one: ``12r`` to ``12v``, ``12v`` to ``13r``; null for other labels."""
    number, side = F.regexp_extract(column, "^([0-9]+)[rv]$", 1), F.regexp_extract(column, "^[0-9]+([rv])$", 1)
    return F.when(side == "r", F.concat(number, F.lit("v"))).when(side == "v", F.concat((number.cast("int") + 1).cast("string"), F.lit("r")))


@query("""
SELECT manuscript, folio, row_number() OVER (PARTITION BY manuscript ORDER BY coalesce(TRY_CAST(regexp_extract(folio, '([0-9]+)\\s*[rv]?', 1) AS INTEGER), 2147483647), CASE WHEN regexp_extract(folio, '[0-9]+\\s*([rv])', 1) = 'v' THEN 1 ELSE 0 END, folio) AS position,
CASE WHEN regexp_matches(folio, '^[0-9]+r$') THEN replace(folio, 'r', 'v') WHEN regexp_matches(folio, '^[0-9]+v$') THEN CAST(CAST(replace(folio, 'v', '') AS INTEGER) + 1 AS VARCHAR) || 'r' END AS following
FROM (SELECT DISTINCT manuscript, folio FROM release_lines WHERE manuscript IS NOT NULL AND folio IS NOT NULL)
""")
def folio_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folios of each manuscript in leaf order, recto before verso, with the folio that should follow."""
    f = table(spark, sf_dir, "release_lines").where("manuscript IS NOT NULL AND folio IS NOT NULL").select("manuscript", "folio").distinct()
    return f.select("manuscript", "folio", F.row_number().over(Window.partitionBy("manuscript").orderBy(*folio_key("folio"))).cast("bigint").alias("position"), next_folio("folio").alias("following"))


@query(f"""
WITH b AS ({_BBOX}), m AS (SELECT manuscript, page_index, median(bbox[4] - bbox[2]) AS h FROM b GROUP BY 1, 2)
SELECT line_id, row_number() OVER (PARTITION BY manuscript, page_index ORDER BY bbox[4] - bbox[2] > 2 * h, bbox[2], bbox[1], line_id) - 1 AS position FROM b JOIN m USING (manuscript, page_index)
""")
def suspects_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines from the top of the page, those of odd height after all others."""
    page, b = ["manuscript", "page_index"], _bboxes(spark, sf_dir)
    m = b.groupBy(*page).agg(F.median(F.col("bbox")[3] - F.col("bbox")[1]).alias("h"))
    odd = F.col("bbox")[3] - F.col("bbox")[1] > 2 * F.col("h")
    w = Window.partitionBy(*page).orderBy(odd, F.col("bbox")[1], F.col("bbox")[0], "line_id")
    return b.join(m, page).select("line_id", (F.row_number().over(w) - 1).cast("bigint").alias("position"))


@query("""
SELECT count(*) AS n_pages, count(*) FILTER (WHERE NOT same) AS not_permutations FROM (SELECT a.part_id, list_sort(a.ids) = list_sort(b.ids) AS same FROM (SELECT part_id, list(DISTINCT run_external_id) AS ids FROM live_lines WHERE part_id IS NOT NULL AND run_external_id IS NOT NULL GROUP BY 1) a JOIN (SELECT part_id, list(DISTINCT l.external_id) AS ids FROM (SELECT part_id, unnest(run_lines) AS l FROM segmentation_runs) WHERE l.external_id IS NOT NULL AND part_id IS NOT NULL GROUP BY 1) b USING (part_id))
""")
def permutation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an order names exactly the rows there are, page by page: set equality by counting either way."""
    live = table(spark, sf_dir, "live_lines").where("part_id IS NOT NULL AND run_external_id IS NOT NULL").select("part_id", F.col("run_external_id").alias("ext")).distinct()
    runs = table(spark, sf_dir, "segmentation_runs").where("part_id IS NOT NULL").select("part_id", F.explode("run_lines.external_id").alias("ext")).where("ext IS NOT NULL").distinct()
    a, b = (x.groupBy("part_id").agg(F.count(F.lit(1)).alias(n)) for x, n in ((live, "a"), (runs, "b")))
    both = live.join(runs, ["part_id", "ext"], "left_semi").groupBy("part_id").agg(F.count(F.lit(1)).alias("both"))
    pages = a.join(b, "part_id").join(both, "part_id", "left")
    return pages.agg(F.count(F.lit(1)).alias("n_pages"), F.count_if((F.col("a") != F.col("b")) | (F.coalesce("both", F.lit(0)) != F.col("a"))).alias("not_permutations"))


def combined(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """Union of named parts with their ``part``; a key that several parts hold is an error when it is read."""
    out = None
    for name, df in parts.items():
        one = df.withColumn("part", F.lit(name))
        out = one if out is None else out.unionByName(one)
    owners = out.groupBy(key).agg(F.countDistinct("part").alias("owners"))
    checked = F.when(F.col("owners") > 1, F.raise_error(F.concat(F.lit("in several parts: "), F.col(key).cast("string")))).otherwise(F.col(key))
    return out.join(owners.withColumn("__key", checked).select(key, "__key"), key).withColumn(key, F.col("__key")).drop("__key")


@query("SELECT user_id, greatest(max(ts) FILTER (WHERE event_type = 'signup'), max(ts) FILTER (WHERE event_type = 'click')) AS last_use, max(ts) + INTERVAL 15 MINUTE AS lease_until, max(ts) + INTERVAL 15 MINUTE < (SELECT max(ts) FROM events) - INTERVAL 1 DAY AS expired FROM events GROUP BY 1")
def lease_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last use (the later of two times, nulls passed over), lease deadline and whether it has run out by the newest event."""
    events = table(spark, sf_dir, "events")
    last = events.agg(F.max("ts").alias("last"))
    u = events.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "signup", F.col("ts"))).alias("a"), F.max(F.when(F.col("event_type") == "click", F.col("ts"))).alias("b"), F.max("ts").alias("t"))
    until = F.col("t") + F.expr("INTERVAL 15 MINUTES")
    return u.join(F.broadcast(last)).select("user_id", F.greatest("a", "b").alias("last_use"), until.alias("lease_until"), (until < F.col("last") - F.expr("INTERVAL 1 DAY")).alias("expired"))


@query("""
WITH g AS (SELECT line_id, max(text) AS text FROM release_lines WHERE line_id IS NOT NULL GROUP BY 1), u AS (SELECT line_id, max_by(text, response_id) AS new_text, max(response_id) AS rid FROM (SELECT DISTINCT response_id, line_id, coalesce(text, '') AS text FROM transcribe_responses WHERE confidence >= 0.9) GROUP BY 1)
SELECT line_id, CASE WHEN u.line_id IS NULL THEN g.text ELSE u.new_text END AS text, CASE WHEN u.line_id IS NULL THEN 'kept' WHEN g.line_id IS NULL THEN 'inserted' ELSE 'updated' END AS change FROM g FULL OUTER JOIN u USING (line_id) WHERE u.line_id IS NULL OR length(trim(u.new_text)) > 0
""")
def ground_truth_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth after an update: new texts replace old ones, a blank new text deletes the row, others are kept."""
    g = table(spark, sf_dir, "release_lines").where("line_id IS NOT NULL").groupBy("line_id").agg(F.max("text").alias("old"), F.lit(True).alias("had"))
    u = table(spark, sf_dir, "transcribe_responses").where("confidence >= 0.9 AND line_id IS NOT NULL").groupBy("line_id").agg(F.max_by(F.coalesce("text", F.lit("")), "response_id").alias("new"), F.lit(True).alias("sent"))
    both = g.join(u, "line_id", "full_outer").where(F.col("sent").isNull() | (F.length(F.trim("new")) > 0))
    return both.select("line_id", F.when(F.col("sent").isNull(), F.col("old")).otherwise(F.col("new")).alias("text"), F.when(F.col("sent").isNull(), "kept").when(F.col("had").isNull(), "inserted").otherwise("updated").alias("change"))


@query("""
WITH g AS (SELECT line_id, max(text) AS text FROM release_lines WHERE line_id IS NOT NULL GROUP BY 1), m AS (SELECT line_id, max_by(text, response_id) AS text, max(response_id) AS rid FROM (SELECT DISTINCT response_id, line_id, text FROM transcribe_responses WHERE text IS NOT NULL AND length(trim(text)) > 0) GROUP BY 1)
SELECT CASE WHEN g.text IS NOT NULL AND length(trim(g.text)) > 0 THEN 'human' ELSE 'model' END AS provenance, count(*) AS n, CAST(sum(m.rid) FILTER (WHERE g.text IS NULL OR length(trim(g.text)) = 0) AS BIGINT) AS rid_sum FROM g LEFT JOIN m USING (line_id) WHERE (g.text IS NOT NULL AND length(trim(g.text)) > 0) OR m.line_id IS NOT NULL GROUP BY 1
""")
def layer_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model layer copied below the human one: lines with a human text keep it, others take the newest model text with its provenance."""
    g = table(spark, sf_dir, "release_lines").where("line_id IS NOT NULL").groupBy("line_id").agg(F.max("text").alias("text"))
    m = table(spark, sf_dir, "transcribe_responses").where("text IS NOT NULL AND length(trim(text)) > 0").groupBy("line_id").agg(F.max("response_id").alias("rid"))
    human = F.col("text").isNotNull() & (F.length(F.trim("text")) > 0)
    rows = g.join(m, "line_id", "left").where(human | F.col("rid").isNotNull())
    return rows.groupBy(F.when(human, "human").otherwise("model").alias("provenance")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(~human, F.col("rid"))).alias("rid_sum"))


@query("""
WITH p AS (SELECT response_id, line_id, row_number() OVER (PARTITION BY line_id ORDER BY created_at DESC, response_id DESC) AS r FROM (SELECT response_id, line_id, min(created_at) AS created_at FROM transcribe_responses WHERE line_id IS NOT NULL GROUP BY 1, 2))
SELECT response_id, line_id, r > 1 AS released FROM p
""")
def repairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Re-pairing: the newest text of a line takes it over, the others are released."""
    p = table(spark, sf_dir, "transcribe_responses").where("line_id IS NOT NULL").groupBy("response_id", "line_id").agg(F.min("created_at").alias("at"))
    best = p.groupBy("line_id").agg(F.max(F.struct("at", "response_id")).alias("b"))
    return p.join(best, "line_id").select("response_id", "line_id", (F.struct("at", "response_id") != F.col("b")).alias("released"))


@query("""
WITH m AS (SELECT part_id, id FROM (SELECT DISTINCT part_id, id FROM live_lines WHERE part_id IS NOT NULL)), b AS (SELECT part_id, count(*) AS n FROM m GROUP BY 1)
SELECT part_id, n, n = 1 AS full_page FROM b
""")
def full_page_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a single line, whose block is the page itself."""
    lines = table(spark, sf_dir, "live_lines").where("part_id IS NOT NULL").select("part_id", "id").distinct()
    return lines.groupBy("part_id").agg(F.count(F.lit(1)).alias("n")).select("part_id", "n", (F.col("n") == 1).alias("full_page"))


@query("""
SELECT coalesce(p_brand, '(none)') AS brand, CAST(count(*) AS BIGINT) AS n, CAST(min(p_partkey) AS BIGINT) AS kept, CAST(count(*) - 1 AS BIGINT) AS repointed FROM part GROUP BY 1
""")
def catalogue_repoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate models by name: the first is kept, the others' references are pointed to it."""
    return table(spark, sf_dir, "part").groupBy(F.coalesce("p_brand", F.lit("(none)")).alias("brand")).agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("kept"), (F.count(F.lit(1)) - 1).alias("repointed"))


def insert_missing(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``target`` and those ``rows`` whose key it doesn't hold, each key once."""
    return target.unionByName(rows.join(target, key, "left_anti").dropDuplicates([key]).select(*target.columns))


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT s_nationkey + 20, 'new ' || min(s_nationkey) FROM supplier WHERE s_nationkey + 20 NOT IN (SELECT n_nationkey FROM nation) GROUP BY s_nationkey")
def insert_on_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows inserted unless their key is there: an anti-join and a union."""
    new = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") + 20).alias("n_nationkey"), F.concat(F.lit("new "), F.col("s_nationkey").cast("string")).alias("n_name"))
    return insert_missing(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), new, "n_nationkey")


@query("SELECT count(DISTINCT user_id) AS capacity, CASE WHEN count(DISTINCT user_id) = 0 THEN 'none' WHEN count(DISTINCT user_id) < 10 THEN 'scarce' ELSE 'enough' END AS state FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def capacity_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct hosts seen in the last hour of the data."""
    events = table(spark, sf_dir, "events")
    last = events.agg(F.max("ts").alias("last"))
    recent = events.join(F.broadcast(last)).where(F.col("ts") >= F.col("last") - F.expr("INTERVAL 1 HOUR"))
    n = recent.agg(F.countDistinct("user_id").alias("capacity"))
    return n.select("capacity", F.when(F.col("capacity") == 0, "none").when(F.col("capacity") < 10, "scarce").otherwise("enough").alias("state"))


@query("""
SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE event_type IN ('click', 'view')) WHERE r = 1
""")
def claim_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest pending job of each target; which worker gets it is decided outside, there are no row locks."""
    jobs = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view"))
    return jobs.groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("j")).select("user_id", F.col("j.event_id").alias("event_id"))


@query("SELECT event_id FROM events WHERE ts <= (SELECT max(ts) FROM events) - INTERVAL 3 HOUR AND event_type = 'purchase'")
def abandoned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that have been open for three hours or more at the newest event."""
    events = table(spark, sf_dir, "events")
    last = events.agg(F.max("ts").alias("last"))
    return events.where("event_type = 'purchase'").join(F.broadcast(last)).where(F.col("ts") <= F.col("last") - F.expr("INTERVAL 3 HOURS")).select("event_id")


@query("SELECT CAST(date_diff('second', min(ts), (SELECT max(ts) FROM events)) AS BIGINT) AS age_seconds, count(*) AS waiting, date_diff('second', min(ts), (SELECT max(ts) FROM events)) > 3600 AS stalled FROM events WHERE event_type = 'click'")
def queue_stall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age of the oldest waiting job at the newest event, and whether the queue stands still."""
    events = table(spark, sf_dir, "events")
    second = F.floor(F.unix_seconds(F.col("ts").cast("timestamp"))).cast("bigint")
    a = events.agg(F.max(second).alias("now"), F.min(F.when(F.col("event_type") == "click", second)).alias("oldest"), F.count_if(F.col("event_type") == "click").alias("waiting"))
    return a.select((F.col("now") - F.col("oldest")).alias("age_seconds"), "waiting", (F.col("now") - F.col("oldest") > 3600).alias("stalled"))


@query("""
SELECT CAST(v.user_id AS BIGINT) AS user_id, event_type, rate, rank FROM (SELECT user_id, event_type, n / sum(n) OVER (PARTITION BY user_id) AS rate, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rank FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)) v WHERE rank <= 2
""")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants by group: the two best of each with their share (a top 2 by nature)."""
    n = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("user_id")
    ranked = n.select("user_id", "event_type", (F.col("n") / F.sum("n").over(w)).alias("rate"), F.row_number().over(w.orderBy(F.desc("n"), "event_type")).cast("bigint").alias("rank"))
    return ranked.where("rank <= 2")


@query("""
WITH c AS (SELECT lower(lang) AS lang, unnest(string_split(text, '')) AS ch FROM documents), b AS (SELECT DISTINCT ch FROM c WHERE lang = 'en')
SELECT DISTINCT c.lang, c.ch FROM c LEFT JOIN b USING (ch) WHERE b.ch IS NULL AND c.ch <> '' AND c.lang IS NOT NULL
""")
def charset_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of each language that the character set of English doesn't hold."""
    c = table(spark, sf_dir, "documents").select(F.lower("lang").alias("lang"), F.explode(F.array_distinct(F.split("text", ""))).alias("ch")).where("ch <> ''").distinct()
    return c.where("lang IS NOT NULL").join(c.where("lang = 'en'").select("ch"), "ch", "left_anti").select("lang", "ch")


@query("""
SELECT 'line without text' AS warning, count(*) AS n FROM (SELECT line_id FROM release_lines WHERE line_id IS NOT NULL GROUP BY 1 HAVING max(CASE WHEN text IS NOT NULL AND length(trim(text)) > 0 THEN 1 ELSE 0 END) = 0)
UNION ALL SELECT 'text without line', count(DISTINCT line_id) FROM transcribe_responses WHERE line_id IS NOT NULL AND line_id NOT IN (SELECT line_id FROM release_lines WHERE line_id IS NOT NULL)
""")
def export_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an export would miss: lines without text, and texts that no line uses; anti-joins both ways."""
    text = F.max(F.coalesce(F.length(F.trim("text")), F.lit(0)))
    lines = table(spark, sf_dir, "release_lines").where("line_id IS NOT NULL").groupBy("line_id").agg(text.alias("most"))
    texts = table(spark, sf_dir, "transcribe_responses").where("line_id IS NOT NULL").select("line_id").distinct()
    n = F.count(F.lit(1)).alias("n")
    return lines.where("most = 0").agg(n).select(F.lit("line without text").alias("warning"), "n").unionByName(texts.join(lines, "line_id", "left_anti").agg(n).select(F.lit("text without line").alias("warning"), "n"))


@query("SELECT output_name, count(*) AS sources, min(text) = max(text) AS same_text FROM import_rows WHERE output_name IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def pack_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed rows that have more than one source pair, and whether their texts agree."""
    return table(spark, sf_dir, "import_rows").where("output_name IS NOT NULL").groupBy("output_name").agg(F.count(F.lit(1)).alias("sources"), (F.min("text") == F.max("text")).alias("same_text")).where("sources > 1")


@query("SELECT row_id, text, 'kept' AS origin FROM import_rows WHERE source_image IS NULL OR NOT starts_with(source_image, 'crops/') UNION ALL SELECT row_id + 1000000000, text, 'new' FROM import_rows WHERE starts_with(source_image, 'crops/')")
def prefix_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imported rows of a prefix replaced by a new delivery, everything else kept."""
    rows = table(spark, sf_dir, "import_rows")
    imported = F.coalesce(F.col("source_image").startswith("crops/"), F.lit(False))
    return replace_by_prefix(rows.select("row_id", "text", imported.alias("old")), F.col("old"), rows.where(imported).select((F.col("row_id") + 1_000_000_000).alias("row_id"), "text")).select("row_id", "text", "origin")


def replace_by_prefix(rows: DataFrame, drop: Column, new: DataFrame) -> DataFrame:
    """Rows that ``drop`` doesn't mark (``origin`` kept) and the new ones (``origin`` new)."""
    return rows.where(~drop).select(*new.columns).withColumn("origin", F.lit("kept")).unionByName(new.withColumn("origin", F.lit("new")))


@query("SELECT doc_id FROM (SELECT doc_id FROM documents ORDER BY sha256('5|' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 100) ORDER BY doc_id")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded sample of 100 without replacement, then sorted (sampling is the operator)."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    return d.orderBy(F.sha2(F.concat(F.lit("5|"), F.col("doc_id").cast("string")), 256), "doc_id").limit(100).orderBy("doc_id")


@query("""
SELECT doc_id, CASE WHEN r <= CAST(round(0.1 * c) AS BIGINT) THEN 'eval' ELSE 'train' END AS part FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY source) AS c FROM documents)
""")
def prefix_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first tenth of each source for evaluation, the rest for training; a real fraction, rounded."""
    by = Window.partitionBy("source")
    d = table(spark, sf_dir, "documents").select("doc_id", F.row_number().over(by.orderBy("doc_id")).alias("r"), F.count(F.lit(1)).over(by).alias("c"))
    return d.select("doc_id", F.when(F.col("r") <= F.round(0.1 * F.col("c")), "eval").otherwise("train").alias("part"))


@query("SELECT coalesce(model_name, '(none)') AS model, round(sum(confidence) FILTER (WHERE confidence BETWEEN 0 AND 1) / count(*) FILTER (WHERE confidence BETWEEN 0 AND 1), 4) AS mean_in_range, round(avg(least(1.0, greatest(0.0, confidence))), 4) AS clamped FROM transcribe_responses WHERE confidence IS NOT NULL GROUP BY 1")
def clamped_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean confidence with values clamped to the unit interval."""
    c = F.col("confidence")
    inside = F.when((c >= 0) & (c <= 1), c)
    return table(spark, sf_dir, "transcribe_responses").where("confidence IS NOT NULL").groupBy(F.coalesce("model_name", F.lit("(none)")).alias("model")).agg(F.round(F.avg(inside), 4).alias("mean_in_range"), F.round(F.avg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))), 4).alias("clamped"))


@query("""
WITH r AS (SELECT response_id, max(character_confidences) AS cc, max(text) AS text FROM transcribe_responses WHERE text IS NOT NULL GROUP BY 1)
SELECT response_id, CASE WHEN len(cc) = length(text) THEN list_aggregate(list_transform(cc, lambda x: CAST(round_even(x.confidence * 1000, 0) AS BIGINT)), 'sum') END AS thousandths FROM r
""")
def aligned_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of each character, rounded half to even to thousandths, where they fit the text; null where they don't."""
    r = table(spark, sf_dir, "transcribe_responses").where("text IS NOT NULL").groupBy("response_id").agg(F.max("character_confidences").alias("cc"), F.max("text").alias("text"))
    whole = F.aggregate(F.transform("cc", lambda x: F.bround(x["confidence"] * 1000).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return r.select("response_id", F.when(F.size("cc") == F.length("text"), whole).alias("thousandths"))


@query("SELECT doc_id, text_chars, ratio FROM (SELECT doc_id, length(text) AS text_chars, round(length(text) / (SELECT avg(length(text)) FROM documents), 4) AS ratio FROM documents WHERE length(text) BETWEEN 300 AND 420)")
def length_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of a length band, against the mean of all (the band is the operator)."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("bigint").alias("text_chars"))
    mean = d.agg(F.avg("text_chars").alias("mean"))
    return d.where("text_chars BETWEEN 300 AND 420").join(F.broadcast(mean)).select("doc_id", "text_chars", F.round(F.col("text_chars") / F.col("mean"), 4).alias("ratio"))


@query("SELECT source, lang, ch, count(*) AS n FROM (SELECT source, lang, unnest(string_split(text, '')) AS ch FROM documents) WHERE ch IN ('·', '⁘', '։', '܀', '⳾', '…', '«', '»') GROUP BY 1, 2, 3")
def char_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a fixed set of marks by source and language; only the marks of the set leave the scan."""
    marks = F.regexp_extract_all("text", F.lit("([·⁘։܀⳾…«»])"), F.lit(1))
    return table(spark, sf_dir, "documents").select("source", "lang", F.explode(marks).alias("ch")).groupBy("source", "lang", "ch").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, round(count(*) FILTER (WHERE value >= 20) / count(*), 4) AS rate, count(*) FILTER (WHERE value >= 20) AS part FROM events GROUP BY 1")
def guarded_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.count_if(F.col("value") >= 20)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(ratio(part, F.count(F.lit(1))).alias("rate"), part.alias("part"))
