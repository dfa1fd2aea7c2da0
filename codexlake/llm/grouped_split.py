"""Splits that keep related records together: components of the record-entity graph, then stratified assignment."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codexlake.llm.cross_split import split_of
from codexlake.operators.components import components
from codexlake.operators.prefix import prefix_sum
from codexlake.runtime import durable, table

SHARES = {"train": 0.8, "val": 0.1, "test": 0.1}
#: A group with a larger share of all records is placed by itself; there can be at most 1/BIG_SHARE of them.
BIG_SHARE = 0.005
#: Strata of their own; rarer labels share one, so that the plan stays small whatever the labels are.
MAX_LABELS = 1_000


def slug_key(column: str) -> Column:
    """Slug without its spelling: small letters and digits, joined by hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.col(column)), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")


def shelfmark_key(column: str) -> Column:
    """Shelfmark without its spelling: words and number, without ``Cod.`` and ``MS`` and leading zeros."""
    words = F.regexp_replace(F.regexp_replace(F.lower(F.col(column)), r"(?<=\p{L})(?=\p{N})", " "), r"[^\p{L}\p{N}]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.concat(F.lit(" "), words, F.lit(" ")), r" (?:(?:cod|codex|ms|mss|manuscript) )+", " "), r" 0+(?=\p{N})", " "), " +", " "))


def codices(lines: DataFrame) -> DataFrame:
    """``slug`` (normalised) and ``codex`` of all manuscripts of the release lines."""
    seen = lines.select(slug_key("manuscript").alias("slug"), shelfmark_key("shelfmark").alias("shelf")).where((F.col("slug") != "") & F.col("slug").isNotNull()).distinct()
    record = F.concat_ws("|", "slug", F.coalesce("shelf", F.lit("")))
    entities = F.array(F.concat(F.lit("m:"), "slug"), F.when(F.col("shelf") != "", F.concat(F.lit("s:"), "shelf")))
    found = components(seen.select(record.alias("record"), F.explode(entities).alias("entity")))
    return found.where(F.col("entity").startswith("m:")).select(F.expr("substring(entity, 3)").alias("slug"), F.col("component").alias("codex"))


def codex_of_rows(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """``row_id`` and ``codex`` of the rows whose image reference contains the slug of a known manuscript.

    All runs of tokens of the reference, of the lengths that slugs really have, are looked up; the longest known
    slug counts, among equals the first.
    """
    known = durable(codices(lines))
    lengths = sorted(r.k for r in known.select(F.size(F.split("slug", "-")).alias("k")).distinct().collect())
    tokens = F.split(slug_key("source_image"), "-")
    parts = rows.where(F.col("row_id").isNotNull() & F.col("source_image").isNotNull()).select("row_id", tokens.alias("t"))

    if not lengths:
        return parts.select("row_id", F.lit(None).cast("string").alias("codex")).where(F.lit(False))
    runs = F.expr(f"flatten(transform(filter(array({', '.join(map(str, lengths))}), k -> k <= size(t)), k -> transform(sequence(1, size(t) - k + 1), i -> struct(k AS k, i AS i, array_join(slice(t, i, k), '-') AS slug))))")
    windows = parts.select("row_id", F.explode(runs).alias("w")).select("row_id", "w.k", "w.i", "w.slug")
    hits = windows.join(known, "slug")
    return hits.groupBy("row_id").agg(F.max(F.struct("k", (-F.col("i")).alias("first"), "codex")).alias("h")).select("row_id", F.col("h.codex").alias("codex"))


def assign_groups(sizes: DataFrame, shares: Mapping[str, float] = SHARES, seed: int = 0) -> DataFrame:
    """A split for every group such that split sizes and label mixes come near ``shares``: ``grp``, ``assigned``.

    ``sizes``: ``grp``, ``label``, ``n`` (records).  Groups above ``BIG_SHARE`` of all records are few by
    definition; each goes, largest first, where the label counts then deviate least.  All other groups are
    laid out by seeded hash within the stratum of their main label and cut where the running total passes
    what each split still lacks there, so a stratum deviates by less than one small group a cut.
    """
    labelled = durable(sizes.groupBy("grp", F.coalesce("label", F.lit("")).alias("label")).agg(F.sum("n").alias("n")))
    common = labelled.groupBy("label").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "label").limit(MAX_LABELS + 1).collect()
    sizes = labelled
    if len(common) > MAX_LABELS:
        named = F.col("label").isin([r.label for r in common[:MAX_LABELS]])
        sizes = durable(labelled.groupBy("grp", F.when(named, F.col("label")).otherwise(F.lit("(rest)")).alias("label")).agg(F.sum("n").alias("n")))
    totals = {r.label: r.n for r in sizes.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    everything = sum(totals.values())
    whole = sizes.groupBy("grp").agg(F.sum("n").alias("size"), F.max(F.struct("n", "label")).alias("m")).select("grp", "size", F.col("m.label").alias("label"))
    big = whole.where(F.col("size") > BIG_SHARE * everything).select("grp", "size")
    placed: dict[str, str] = {}
    held: dict[tuple[str, str], float] = defaultdict(float)
    parts: dict[str, dict[str, int]] = defaultdict(dict)
    for r in sizes.join(big, "grp").collect():
        parts[r.grp][r.label] = r.n
    for grp in sorted(parts, key=lambda g: (-sum(parts[g].values()), g)):
        def deviation(split: str, grp: str = grp) -> float:
            lacking = sum(shares[split] * totals[x] - held[split, x] for x in parts[grp])
            return sum(((held[split, x] + n - shares[split] * totals[x]) / max(1.0, shares[split] * totals[x])) for x, n in parts[grp].items()) - 1e-9 * lacking

        best = min(sorted(shares, key=lambda s: -shares[s]), key=deviation)
        placed[grp] = best
        for x, n in parts[grp].items():
            held[best, x] += n

    small = whole.join(big.select("grp"), "grp", "left_anti").withColumn("h", F.xxhash64(F.lit(seed), F.col("grp")))
    held_small = small.groupBy("label").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("groups")).collect()
    run = prefix_sum(small, ["label"], "h", "size", "before", max((r.groups for r in held_small), default=0))
    rest = {r.label: r.n for r in held_small}
    cut = F.lit(None).cast("string")
    middle = F.col("before") + F.col("size") / 2
    for label, n in sorted(rest.items()):
        lacks = {s: max(0.0, shares[s] * totals[label] - held[s, label]) for s in shares}
        scale = n / (sum(lacks.values()) or 1.0)
        upto, choice = 0.0, F.lit(max(shares, key=lambda s: shares[s]))
        edges = []
        for s in sorted(shares, key=lambda s: shares[s]):
            upto += lacks[s] * scale
            edges.append((upto, s))
        for upto, s in reversed(edges[:-1]):
            choice = F.when(middle < upto, s).otherwise(choice)
        cut = F.when(F.col("label") == label, choice).otherwise(cut)
    out = run.select("grp", cut.alias("assigned"))
    if placed:
        named = F.create_map(*[F.lit(x) for pair in placed.items() for x in pair])
        out = out.unionByName(big.select("grp", named[F.col("grp")].alias("assigned")))
    return out


def _script(column: str) -> Column:
    """Script of a text by its first letter of a known script, as a label."""
    c = F.col(column)
    out = F.lit("other")
    for name in ("Latin", "Greek", "Coptic", "Armenian", "Syriac"):
        out = F.when(c.rlike(rf"\p{{Is{name}}}"), name.lower()).otherwise(out)
    return F.coalesce(out, F.lit("none"))


_CODICES = r"""
WITH RECURSIVE seen AS (SELECT DISTINCT regexp_replace(regexp_replace(lower(manuscript), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
  trim(regexp_replace(regexp_replace(regexp_replace(' ' || regexp_replace(regexp_replace(lower(shelfmark), '(\p{L})(\p{N})', '\1 \2', 'g'), '[^\p{L}\p{N}]+', ' ', 'g') || ' ', ' (?:(?:cod|codex|ms|mss|manuscript) )+', ' ', 'g'), ' 0+([0-9])', ' \1', 'g'), ' +', ' ', 'g')) AS shelf FROM release_lines WHERE manuscript IS NOT NULL),
known AS (SELECT * FROM seen WHERE slug <> ''),
link AS (SELECT DISTINCT a.slug AS a, b.slug AS b FROM known a JOIN known b ON a.shelf = b.shelf AND a.shelf <> ''),
reach(a, b) AS (SELECT DISTINCT slug, slug FROM known UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
codex AS (SELECT a AS slug, min(b) AS codex, len(string_split(a, '-')) AS k FROM reach GROUP BY 1)
"""
CODICES_SQL = _CODICES + "SELECT codex, count(*) AS n_slugs FROM codex GROUP BY 1"
P5_SQL = _CODICES.rstrip() + r""",
r AS (SELECT row_id, CASE lower(trim(split)) WHEN 'train' THEN 'train' WHEN 'training' THEN 'train' WHEN 'val' THEN 'val' WHEN 'valid' THEN 'val' WHEN 'validation' THEN 'val' WHEN 'test' THEN 'test' END AS s, '-' || regexp_replace(regexp_replace(lower(source_image), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g') || '-' AS ref FROM import_rows WHERE row_id IS NOT NULL),
h AS (SELECT row_id, s, arg_max(codex, (k, -instr(ref, '-' || slug || '-'))) AS codex FROM r JOIN codex ON contains(ref, '-' || slug || '-') WHERE s IS NOT NULL GROUP BY 1, 2),
t AS (SELECT codex FROM h GROUP BY 1 HAVING count(DISTINCT s) > 1)
SELECT DISTINCT row_id FROM h JOIN t USING (codex)
"""


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of codices that the delivered splits tear apart."""
    rows = table(spark, sf_dir, "import_rows")
    placed = rows.select("row_id", split_of("split").alias("split")).where(F.col("split").isNotNull())
    known = durable(placed.join(codex_of_rows(rows, table(spark, sf_dir, "release_lines")), "row_id"))
    torn = known.groupBy("codex").agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b").select("codex")
    return known.join(torn, "codex", "left_semi").select("row_id").distinct()


def p5_codices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codices of the release lines with the number of slugs they stand under."""
    found = codices(table(spark, sf_dir, "release_lines"))
    named = found.groupBy("codex").agg(F.min("slug").alias("name"), F.count(F.lit(1)).alias("n_slugs"))
    return named.select(F.col("name").alias("codex"), "n_slugs")


def p5_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every import row with its codex and a split near 80/10/10 that keeps codices whole.

    A row whose image names no known manuscript is a group of its own.
    """
    rows = table(spark, sf_dir, "import_rows")
    known = codex_of_rows(rows, table(spark, sf_dir, "release_lines"))
    grouped = rows.select("row_id", _script("text").alias("label")).join(known, "row_id", "left").withColumn("grp", F.coalesce("codex", F.concat(F.lit("row:"), F.col("row_id").cast("string"))))
    grouped = durable(grouped)
    assigned = assign_groups(grouped.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("n")))
    return grouped.join(assigned, "grp").select("row_id", F.col("grp").alias("codex"), F.col("assigned").alias("assigned_split"))


def p5_split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and codices of each assigned split."""
    return p5_assignment(spark, sf_dir).groupBy("assigned_split").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("codex").alias("n_codices"))
