"""Flat tables of regions or blocks, lines and points from history states, PAGE XML and line polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codexlake.operators.inlining import Graph, schema_graph, shred, shred_array, tables_of, typed_table
from codexlake.plans.catalog import query
from codexlake.runtime import table


def _shredded(docs: DataFrame, key: str, text: str, kind: str, keep: set[str]) -> tuple[DataFrame, Graph, set[str]]:
    graph = schema_graph(docs, text, kind)
    tables = tables_of(graph) | keep
    return shred(docs, key, text, kind, tables, keep, graph=graph), graph, tables


def history_elements(snapshots: DataFrame, keep: set[str]) -> tuple[DataFrame, Graph, set[str]]:
    return _shredded(snapshots.where(F.col("state").isNotNull()), "id", "state", "json", keep)


def page_elements(bundles: DataFrame, keep: set[str]) -> DataFrame:
    return _shredded(bundles.where(F.col("xml").isNotNull()), "stem", "xml", "xml", keep)[0]


@query()
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with the block or innermost region around it."""
    saved, _, _ = history_elements(table(spark, sf_dir, "annotation_history_snapshots"), {"lines"})
    saved = saved.select(F.lit("annotation_history_snapshots").alias("table_name"), "record_id", F.coalesce(F.col("fields")["block_id"], F.lit("")).alias("parent_id"), F.col("fields")["id"].alias("child_id"))
    pages = page_elements(table(spark, sf_dir, "page_xml_bundles"), {"TextLine"})
    pages = pages.select(F.lit("page_xml_bundles").alias("table_name"), "record_id", F.coalesce(F.col("ancestors")["TextRegion"], F.lit("")).alias("parent_id"), F.col("fields")["@id"].alias("child_id"))
    return saved.unionByName(pages).where(F.col("child_id").isNotNull()).distinct()


@query()
def p6_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions with the region around them, their position in it and their outline."""
    rows = page_elements(table(spark, sf_dir, "page_xml_bundles"), {"TextRegion"})
    f = F.col("fields")
    return rows.select("record_id", "row_id", "position", "parent_table", "parent_row_id", f["@id"].alias("region_id"), f["@type"].alias("region_type"), F.col("ancestors")["TextRegion"].alias("parent_id")).distinct()


_POINTS_SQL = " UNION ".join(
    f"SELECT DISTINCT record_id, '{k}' AS outline, CAST(i - 1 AS INTEGER) AS position, {k}[i][1] AS x, {k}[i][2] AS y FROM (SELECT line_id AS record_id, {k}, unnest(range(1, len({k}) + 1)) AS i FROM release_lines WHERE line_id IS NOT NULL)" for k in ("polygon", "baseline")
)


@query(_POINTS_SQL)
def p6_line_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of release lines' polygons and baselines, each linked to its line, with their position."""
    lines = table(spark, sf_dir, "release_lines").where(F.col("line_id").isNotNull()).select("line_id", "polygon", "baseline")
    parts = [shred_array(lines, "line_id", k).withColumn("outline", F.lit(k)) for k in ("polygon", "baseline")]
    return parts[0].unionByName(parts[1]).distinct()


_STATE_LINES = "SELECT id AS record_id, x, i FROM (SELECT id, unnest(CAST(json_extract(state, '$.lines') AS JSON[])) AS x, unnest(range(0, CAST(json_array_length(state, '$.lines') AS BIGINT))) AS i FROM annotation_history_snapshots WHERE state IS NOT NULL AND json_type(state, '$.lines') = 'ARRAY')"
_OWN_ID = "json_extract_string(x, '$.id')"


@query(f"""
SELECT DISTINCT record_id, CAST(i AS INTEGER) AS position, {_OWN_ID} AS line_id, coalesce(json_extract_string(x, '$.block_id'), '') AS block_id, CAST(json_extract_string(x, '$.order') AS BIGINT) AS line_order, json_extract_string(x, '$.kind') AS kind, json_extract_string(x, '$.approved_text') AS approved_text
FROM ({_STATE_LINES})
""")
def p6_history_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of history states with their block, in typed columns."""
    rows, graph, tables = history_elements(table(spark, sf_dir, "annotation_history_snapshots"), {"lines"})
    lines = typed_table(rows, graph, tables, "lines")

    def held(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in lines.columns else F.lit(None).cast(kind)

    return lines.select("record_id", "position", held("id", "string").alias("line_id"), F.coalesce(held("block_id", "string"), F.lit("")).alias("block_id"), held("order", "bigint").alias("line_order"), held("kind", "string").alias("kind"), held("approved_text", "string").alias("approved_text")).distinct()


@query(f"SELECT record_id, block_id, count(*) AS n_lines, count(DISTINCT line_id) AS n_ids FROM (SELECT DISTINCT record_id, i, json_extract_string(x, '$.block_id') AS block_id, {_OWN_ID} AS line_id FROM ({_STATE_LINES})) WHERE block_id IS NOT NULL GROUP BY 1, 2")
def p6_history_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of history states with the lines in them."""
    rows, _, _ = history_elements(table(spark, sf_dir, "annotation_history_snapshots"), {"lines"})
    lines = rows.where(F.col("fields")["block_id"].isNotNull()).select("record_id", "position", F.col("fields")["block_id"].alias("block_id"), F.col("fields")["id"].alias("line_id")).distinct()
    return lines.groupBy("record_id", "block_id").agg(F.count(F.lit(1)).alias("n_lines"), F.countDistinct("line_id").alias("n_ids"))


def _json_points(path: str) -> str:
    array = f"CAST(json_extract(x, '{path}') AS JSON[])"
    name = path.removeprefix("$.").removesuffix(".points") if path != "$.points" else "points"
    return f"SELECT record_id, {_OWN_ID} AS parent_id, '{name}' AS outline, CAST(k AS INTEGER) AS position, CAST(json_extract_string(p, '$[0]') AS DOUBLE) AS x, CAST(json_extract_string(p, '$[1]') AS DOUBLE) AS y FROM (SELECT record_id, x, unnest({array}) AS p, unnest(range(0, CAST(json_array_length(x, '{path}') AS BIGINT))) AS k FROM ({_STATE_LINES}) WHERE json_type(x, '{path}') = 'ARRAY')"


@query("SELECT DISTINCT * FROM (" + " UNION ALL ".join(_json_points(p) for p in ("$.points", "$.baseline", "$.baseline.points", "$.mask", "$.mask.points")) + ")")
def p6_history_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the outlines, baselines and masks of the lines in history states, linked to line and snapshot."""
    rows, _, _ = history_elements(table(spark, sf_dir, "annotation_history_snapshots"), {"points", "baseline", "mask"})
    f = F.col("fields")
    # A baseline is a list of points or an object that holds one.
    name = F.when((F.col("table_name") == "points") & (F.col("parent_table") != "lines"), F.col("parent_table")).when(F.col("via") != "", F.col("via")).otherwise(F.col("table_name"))
    points = rows.where(f["0"].isNotNull() & F.col("ancestors")["lines"].isNotNull())
    return points.select("record_id", F.col("ancestors")["lines"].alias("parent_id"), name.alias("outline"), "position", f["0"].cast("double").alias("x"), f["1"].cast("double").alias("y")).distinct()


@query()
def page_xml_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of PAGE XML with their region, position, first text and outline; null where they are missing."""
    elements = page_elements(table(spark, sf_dir, "page_xml_bundles"), {"TextLine", "Coords", "Unicode"})
    f = F.col("fields")
    inner = elements.where("table_name <> 'TextLine'").groupBy("record_id", F.col("ancestors")["TextLine"].alias("line_id"), F.col("ancestors")["TextRegion"].alias("region_id"))
    inner = inner.agg(F.min_by(f["@points"], F.when(F.col("parent_table") == "TextLine", F.col("row_id"))).alias("coords"), F.min_by(f["#text"], F.when(F.col("table_name") == "Unicode", F.col("row_id"))).alias("text"))
    lines = elements.where("table_name = 'TextLine'").select("record_id", f["@id"].alias("line_id"), F.col("ancestors")["TextRegion"].alias("region_id"), "position", f["@custom"].alias("custom"))
    source = F.when(F.col("custom").contains("source:manual"), "manual").when(F.col("custom").contains("source:kraken"), "kraken").otherwise("unknown")
    return lines.join(inner, ["record_id", "line_id", "region_id"], "left").select("record_id", "line_id", "region_id", "position", source.alias("provenance"), "coords", "text").distinct()


@query()
def page_xml_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each page and those without usable text or outline, beside the count that came with the page.

    Usable: text that is not blank, and an outline of three points or more.
    """
    lines = page_xml_lines(spark, sf_dir)
    usable = (F.length(F.trim(F.coalesce("text", F.lit("")))) > 0) & (F.size(F.split(F.trim(F.coalesce("coords", F.lit(""))), " +")) >= 3)
    found = lines.groupBy("record_id").agg(F.count(F.lit(1)).alias("found"), F.count_if(~usable).alias("unusable"))
    declared = table(spark, sf_dir, "page_xml_bundles").groupBy(F.col("stem").alias("record_id")).agg(F.max("line_counts.total").cast("bigint").alias("declared"))
    return found.join(declared, "record_id", "left").select("record_id", "found", "unusable", "declared")


@query()
def p6_xml_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the outlines of regions and lines and of the baselines in PAGE XML, linked to what they belong to."""
    rows = page_elements(table(spark, sf_dir, "page_xml_bundles"), {"Coords", "Baseline"})
    at = F.posexplode(F.split(F.trim(F.col("fields")["@points"]), " +")).alias("position", "p")
    parent = F.element_at("ancestors", F.col("parent_table")).alias("parent_id")
    points = rows.where("parent_table IN ('TextLine', 'TextRegion')").select("record_id", "parent_table", parent, F.col("table_name").alias("outline"), at)
    xy = F.split("p", ",")
    return points.select("record_id", "parent_table", "parent_id", "outline", "position", F.get(xy, F.lit(0)).try_cast("double").alias("x"), F.get(xy, F.lit(1)).try_cast("double").alias("y")).distinct()
