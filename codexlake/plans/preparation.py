"""Corpus preparation in several steps: duplicate chains, near-equal leaks, balanced splits, changes by normal forms.

Splits are made on the table of components, which has a row for each group of rows that must stay together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codexlake.functions.text import NORMALISERS, SYRIAC_FROM, SYRIAC_TO, fuzzy_key, loose_key, main_script, nfc_changes, normal, normalised, ruled, symbol_changes
from codexlake.operators.components import components
from codexlake.operators.splitting import allocate, exhaustive, greedy, merge_undersized
from codexlake.plans.catalog import query
from codexlake.plans.corpus import text_page_edges
from codexlake.plans.records import split_name
from codexlake.runtime import durable, table

SPLITS = ("train", "val", "test")
BOUNDS = (0.8, 0.9)
#: Keys shorter than this tell nothing.
MIN_KEY = 20
#: Components are placed one by one up to this number; more are laid out by a running total.
MOST_PLACED = 100_000


def _imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "import_rows").where("text IS NOT NULL AND output_name IS NOT NULL AND row_id IS NOT NULL").select("row_id", "output_name", "text", "split", "source_image")


def survivors(rows: DataFrame) -> DataFrame:
    """``row_id``, ``survivor``, ``step``: which row stands for each one after exact and then near deduplication.

    Of equal texts the least (name, id) stays; of the rows that stay, those with the same loose key of ``MIN_KEY``
    characters or more keep the least again, and rows dropped before follow their survivor.
    """
    best = F.min(F.struct("output_name", "row_id")).alias("b")
    exact = rows.groupBy("text").agg(best).select("text", "b.output_name", F.col("b.row_id").alias("first"))
    keyed = exact.withColumn("k", loose_key("text"))
    near = keyed.where(F.length("k") >= MIN_KEY).groupBy("k").agg(F.min(F.struct("output_name", "first")).alias("b")).select("k", F.col("b.first").alias("last"))
    chain = keyed.join(near, "k", "left").select("text", "first", F.coalesce("last", "first").alias("survivor"))
    step = F.when(F.col("row_id") == F.col("survivor"), "kept").when(F.col("row_id") == F.col("first"), "near").otherwise("exact")
    return rows.select("row_id", "text").join(chain, "text").select("row_id", "survivor", step.alias("step"))


@query()
def duplicate_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with the row that stands for it in the end."""
    return survivors(_imports(spark, sf_dir))


@query()
def near_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of val and test by what of them occurs in train: the text, a nearly equal text, the page."""
    page = F.regexp_extract("output_name", r"^(.*)__[0-9]+-[0-9]+\.jpg$", 1)
    rows = durable(_imports(spark, sf_dir).select(split_name("split").alias("split"), "text", fuzzy_key("text").alias("fuzzy"), page.alias("page")))
    train, flags = rows.where("split = 'train'"), rows.where("split IN ('val', 'test')")
    for key, name in (("text", "t"), ("fuzzy", "f"), ("page", "p")):
        flags = flags.join(train.where(F.col(key) != "").select(key, F.lit(1).alias(name)).distinct(), key, "left")
    return flags.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count("t").alias("text_leaks"), F.count("f").alias("near_leaks"), F.count("p").alias("page_leaks"))


@query("""
WITH r AS (SELECT CASE WHEN lower(trim(split)) IN ('train', 'training') THEN 'train' WHEN lower(trim(split)) IN ('val', 'valid', 'validation', 'dev') THEN 'val' WHEN lower(trim(split)) = 'test' THEN 'test' END AS s, text, regexp_extract(source_image, '^corpus/([a-z]+)/', 1) AS language FROM import_rows WHERE text IS NOT NULL AND output_name IS NOT NULL AND source_image IS NOT NULL)
SELECT language, text, count(DISTINCT s) AS owners FROM r GROUP BY 1, 2 HAVING count(DISTINCT s) > 1
""")
def language_text_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of one language that several splits own."""
    rows = _imports(spark, sf_dir).where("source_image IS NOT NULL").select(split_name("split").alias("s"), "text", F.regexp_extract("source_image", "^corpus/([a-z]+)/", 1).alias("language"))
    return rows.groupBy("language", "text").agg(F.countDistinct("s").alias("owners")).where("owners > 1")


def balanced_splits(members: DataFrame, seed: int = 1111) -> DataFrame:
    """``component``, ``grp``, ``split``: whole components split 80/10/10 by rows within their balance group.

    ``members``: ``component``, ``grp``, ``n`` (rows).  A component belongs to the group of most of its rows (ties: the
    least name); a group with fewer components than splits joins the largest.  Up to twelve components every assignment
    is tried; up to ``MOST_PLACED`` they are filled in seeded order with groups held back for the later splits; more are
    cut where the running total passes the bounds, which holds back nothing as no split can stay empty then.
    """
    votes = members.groupBy("component", "grp").agg(F.sum("n").alias("n"))
    order = F.sha2(F.concat(F.lit(f"{seed}|"), F.col("component")), 256)
    comps = durable(votes.groupBy("component").agg(F.min(F.struct((-F.col("n")).alias("n"), "grp")).alias("b"), F.sum("n").alias("size")).select("component", F.col("b.grp").alias("grp"), "size").withColumn("h", order))
    counts = {r.grp: r.n for r in comps.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect()}
    if sum(counts.values()) < len(SPLITS):
        raise ValueError(f"fewer than {len(SPLITS)} components to split")
    into = merge_undersized(counts, len(SPLITS))
    sizes: dict[str, int] = {}
    for g, n in counts.items():
        sizes[into[g]] = sizes.get(into[g], 0) + n
    merged = F.create_map(*[F.lit(x) for pair in into.items() for x in pair])[F.col("grp")]
    comps = comps.withColumn("grp", merged)
    few = [g for g, n in sizes.items() if n <= MOST_PLACED]
    rows = []
    for g in few:
        own = comps.where(F.col("grp") == g).orderBy("h", "component").select("component", "size").collect()
        n = [r.size for r in own]
        placed = exhaustive(n, [BOUNDS[0], BOUNDS[1] - BOUNDS[0], 1 - BOUNDS[1]]) if len(n) <= 12 else greedy(n, BOUNDS)
        rows += [(r.component, g, SPLITS[s]) for r, s in zip(own, placed, strict=True)]
    out = members.sparkSession.createDataFrame(rows, "component string, grp string, split string")
    if len(few) < len(sizes):
        from codexlake.operators.prefix import prefix_sum

        large = comps.where(~F.col("grp").isin(few)).withColumn("o", F.xxhash64(F.lit(seed), "component"))
        total = large.groupBy("grp").agg(F.sum("size").alias("total"))
        run = prefix_sum(large, ["grp"], "o", "size", "before", max(sizes.values())).join(total, "grp")
        split = F.when(F.col("before") < BOUNDS[0] * F.col("total"), "train").when(F.col("before") < BOUNDS[1] * F.col("total"), "val").otherwise("test")
        out = out.unionByName(run.select("component", "grp", split.alias("split")))
    return out


@query()
def component_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every import row with its component and split: no text and no page is in two splits."""
    rows = _imports(spark, sf_dir)
    text = F.concat(F.lit("t:"), F.sha2("text", 256))
    found = components(text_page_edges(rows)).where(F.col("entity").startswith("t:"))
    placed = durable(rows.withColumn("entity", text).join(found, "entity").select("row_id", "component", F.coalesce(main_script("text"), F.lit("none")).alias("grp")))
    splits = balanced_splits(placed.groupBy("component", "grp").agg(F.count(F.lit(1)).alias("n")))
    return placed.join(splits.select("component", F.col("grp").alias("balance"), "split"), "component").select("row_id", "component", "balance", "split")


@query("""
WITH s AS (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1), r AS (SELECT source, n, coalesce(sum(n) OVER (ORDER BY sha256('1111|' || source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS total FROM s)
SELECT source, CAST(before AS BIGINT) AS before, CASE WHEN before < 0.8 * total THEN 'train' WHEN before < 0.9 * total THEN 'val' ELSE 'test' END AS split FROM r
""")
def cumulative_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources fill the splits in seeded order up to the cumulative bounds; a table of sources is small."""
    s = table(spark, sf_dir, "documents").where("source IS NOT NULL").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(F.sha2(F.concat(F.lit("1111|"), "source"), 256)).rowsBetween(Window.unboundedPreceding, -1)
    run = s.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0))))
    return run.select("source", "before", F.when(F.col("before") < F.lit(0.8) * F.col("total"), "train").when(F.col("before") < F.lit(0.9) * F.col("total"), "val").otherwise("test").alias("split"))


@query("""
WITH p AS (SELECT manuscript, page_index, row_number() OVER (PARTITION BY manuscript ORDER BY sha256('7|' || manuscript || '|' || CAST(page_index AS VARCHAR))) AS r, count(*) OVER (PARTITION BY manuscript) AS c FROM (SELECT DISTINCT manuscript, page_index FROM release_lines WHERE manuscript IS NOT NULL AND page_index IS NOT NULL))
SELECT manuscript, page_index, CASE WHEN r <= least(greatest(1, round_even(0.7 * c, 0)), greatest(1, c - 1)) THEN 'pretraining' ELSE 'finetuning' END AS part FROM p
""")
def page_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each manuscript 70/30 to two parts in seeded order, neither of them empty where there are two pages."""
    pages = table(spark, sf_dir, "release_lines").where("manuscript IS NOT NULL AND page_index IS NOT NULL").select("manuscript", "page_index").distinct()
    by = Window.partitionBy("manuscript")
    p = pages.withColumn("r", F.row_number().over(by.orderBy(F.sha2(F.concat(F.lit("7|"), "manuscript", F.lit("|"), F.col("page_index").cast("string")), 256)))).withColumn("c", F.count(F.lit(1)).over(by))
    first = F.least(F.greatest(F.lit(1), F.bround(F.lit(0.7) * F.col("c"))), F.greatest(F.lit(1), F.col("c") - 1))
    return p.select("manuscript", "page_index", F.when(F.col("r") <= first, "pretraining").otherwise("finetuning").alias("part"))


@query()
def partition_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of each part split 80/10/10 with no empty split where there are three pages; counts by part."""
    parts = page_partitions(spark, sf_dir)
    by = Window.partitionBy("manuscript", "part")
    p = parts.withColumn("r", F.row_number().over(by.orderBy(F.sha2(F.concat(F.lit("8|"), "manuscript", F.lit("|"), F.col("page_index").cast("string")), 256)))).withColumn("c", F.count(F.lit(1)).over(by))
    sizes = [r.c for r in p.select("c").distinct().collect()]
    plan = spark.createDataFrame([(c, *allocate(c, (0.8, 0.1, 0.1))) for c in sizes], "c bigint, a int, b int, d int")
    split = F.when(F.col("r") <= F.col("a"), "train").when(F.col("r") <= F.col("a") + F.col("b"), "val").otherwise("test")
    return p.join(F.broadcast(plan), "c").select("manuscript", "page_index", "part", split.alias("split"))


@query()
def composition_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What NFC changes in the release texts: each mapping by text source, most frequent first."""
    lines = table(spark, sf_dir, "release_lines").where("text IS NOT NULL").select("line_id", "text_source", "text").distinct()
    found = lines.select("text_source", F.explode(nfc_changes("text")).alias("change"))
    return found.groupBy("text_source", "change").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "text_source", "change")


@query()
def normaliser_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each script that its normaliser changes, beyond NFC, and the symbols that the Syriac one maps."""
    d = table(spark, sf_dir, "documents").select("text", F.coalesce(main_script("text"), F.lit("none")).alias("script"))
    whole = d.withColumn("form", normalised("text", "script")).withColumn("nfc", normal("text"))
    kinds = whole.where(F.col("script").isin(*NORMALISERS)).groupBy("script").agg(F.count_if(F.col("form") != F.col("nfc")).alias("n")).select("script", F.lit("rows changed").alias("change"), "n")
    mapped = d.where("script = 'syriac'").select("script", F.explode(symbol_changes("text", SYRIAC_FROM, SYRIAC_TO)).alias("change")).groupBy("script", "change").agg(F.count(F.lit(1)).alias("n"))
    return kinds.unionByName(mapped)


# Rules that apply only to rows of one source, by the prefix of its names.
SOURCE_RULES = ((r"(?<=\p{L})- -(?=\p{L})", "querstead", " "), (r"(?<=\p{L})-$|\s+-$", "querstead", ""), (r"σ([̀-ͯ]*)(?=$|[^\p{L}\p{N}_̀-ͯ])", "ormdorf", "ς$1"), (r"(ς[̀-ͯ]*)(?=\p{L})", None, "$1 "))


@query()
def source_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and substitutions of each rule, in its own rows only."""
    rows = table(spark, sf_dir, "import_rows").where("text IS NOT NULL")
    text, counts = ruled("text", "output_name", SOURCE_RULES)
    hits = rows.select((text != F.col("text")).alias("changed"), F.posexplode(counts).alias("rule", "n")).where("n > 0")
    return hits.groupBy("rule").agg(F.sum("n").alias("substitutions"), F.count(F.lit(1)).alias("n_rows"))
