"""Evaluation of transcriptions against line texts: rates, bins, confusions, confidences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codexlake.functions.bidi import drawn_column
from codexlake.functions.metrics import edit_ops, error_rate, pair_cer, word_distance
from codexlake.functions.recognition import voted
from codexlake.functions.text import main_script, normal
from codexlake.operators.relational import islands
from codexlake.plans.catalog import query
from codexlake.runtime import table

_PAIRS = "SELECT response_id, coalesce(model_name, '(none)') AS model, r.text AS pred, l.text AS ref FROM (SELECT DISTINCT response_id, line_id, model_name, text FROM transcribe_responses WHERE text IS NOT NULL) r JOIN (SELECT line_id, max(text) AS text FROM release_lines WHERE text IS NOT NULL GROUP BY 1) l USING (line_id)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "transcribe_responses").where("text IS NOT NULL").select("response_id", "line_id", F.coalesce("model_name", F.lit("(none)")).alias("model"), F.col("text").alias("pred")).distinct()
    lines = table(spark, sf_dir, "release_lines").where("text IS NOT NULL").groupBy("line_id").agg(F.max("text").alias("ref"))
    return said.join(lines, "line_id").select("response_id", "model", "pred", "ref")


@query()
def text_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CER, WER and exact share by model, with mean and median line CER."""
    p = _pairs(spark, sf_dir).select("model", F.levenshtein("ref", "pred").alias("e"), F.length("ref").alias("n"), word_distance("ref", "pred").alias("we"), F.size(F.split(F.trim("ref"), r"(?U)\s+")).alias("wn"), pair_cer("ref", "pred").alias("cer"), (F.col("ref") == F.col("pred")).alias("same"))
    return p.groupBy("model").agg(F.count(F.lit(1)).alias("n_pairs"), error_rate(F.sum("e"), F.sum("n")).alias("cer"), error_rate(F.sum("we"), F.sum("wn")).alias("wer"), F.round(F.avg(F.col("same").cast("double")), 4).alias("exact"), F.round(F.avg("cer"), 4).alias("mean_cer"), F.round(F.median("cer"), 4).alias("median_cer"))


@query(f"""
WITH p AS (SELECT length(ref) AS n, ref = pred AS same FROM ({_PAIRS})), b AS (SELECT min(n) AS lo, max(n) AS hi FROM p)
SELECT CAST(least(9, floor((n - lo) * 10.0 / greatest(1, hi - lo))) AS BIGINT) AS bin, count(*) AS n_pairs, count(*) FILTER (WHERE same) AS exact FROM p, b GROUP BY 1
""")
def length_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten equal bins of reference length."""
    p = _pairs(spark, sf_dir).select(F.length("ref").alias("n"), (F.col("ref") == F.col("pred")).alias("same"))
    b = p.agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    spot = F.least(F.lit(9), F.floor((F.col("n") - F.col("lo")) * 10.0 / F.greatest(F.lit(1), F.col("hi") - F.col("lo"))))
    return p.join(F.broadcast(b)).groupBy(spot.cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if("same").alias("exact"))


@query(f"""
WITH p AS ({_PAIRS}), w AS (
  SELECT response_id, model, w, count(*) FILTER (WHERE side = 'r') AS r, count(*) FILTER (WHERE side = 'p') AS q FROM (
    SELECT response_id, model, unnest(string_split(ref, ' ')) AS w, 'r' AS side FROM p UNION ALL SELECT response_id, model, unnest(string_split(pred, ' ')), 'p' FROM p) GROUP BY 1, 2, 3)
SELECT model, CAST(sum(least(r, q)) AS BIGINT) AS common, round(sum(least(r, q)) / sum(q), 4) AS word_precision, round(sum(least(r, q)) / sum(r), 4) AS word_recall FROM w WHERE w <> '' GROUP BY 1
""")
def word_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiset overlap of words."""
    p = _pairs(spark, sf_dir)
    sides = F.explode(F.concat(F.transform(F.split("ref", " "), lambda w: F.struct(w.alias("w"), F.lit(1).alias("r"), F.lit(0).alias("q"))), F.transform(F.split("pred", " "), lambda w: F.struct(w.alias("w"), F.lit(0).alias("r"), F.lit(1).alias("q"))))).alias("s")
    w = p.select("response_id", "model", sides).where("s.w <> ''").groupBy("response_id", "model", "s.w").agg(F.sum("s.r").alias("r"), F.sum("s.q").alias("q"))
    both = F.sum(F.least("r", "q"))
    return w.groupBy("model").agg(both.alias("common"), F.round(both / F.sum("q"), 4).alias("word_precision"), F.round(both / F.sum("r"), 4).alias("word_recall"))


@query(f"""
WITH p AS ({_PAIRS}), w AS (
  SELECT response_id, w, count(*) FILTER (WHERE side = 'r') AS r, count(*) FILTER (WHERE side = 'p') AS q FROM (
    SELECT response_id, unnest(string_split(ref, ' ')) AS w, 'r' AS side FROM p UNION ALL SELECT response_id, unnest(string_split(pred, ' ')), 'p' FROM p) WHERE w <> '' GROUP BY 1, 2),
t AS (SELECT sum(least(r, q)) AS b, sum(r) AS r, sum(q) AS q FROM w)
SELECT round(b / q, 4) AS sroie_precision, round(b / r, 4) AS sroie_recall, round(2.0 * b / (q + r), 4) AS sroie_f1, CAST(r AS BIGINT) AS reference_words, CAST(q AS BIGINT) AS predicted_words FROM t
""")
def sroie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of the words of all pairs as multisets, each pair on its own."""
    p = _pairs(spark, sf_dir)
    sides = F.explode(F.concat(F.transform(F.split("ref", " "), lambda w: F.struct(w.alias("w"), F.lit(1).alias("r"), F.lit(0).alias("q"))), F.transform(F.split("pred", " "), lambda w: F.struct(w.alias("w"), F.lit(0).alias("r"), F.lit(1).alias("q"))))).alias("s")
    w = p.select("response_id", sides).where("s.w <> ''").groupBy("response_id", "s.w").agg(F.sum("s.r").alias("r"), F.sum("s.q").alias("q"))
    t = w.agg(F.sum(F.least("r", "q")).alias("b"), F.sum("r").alias("r"), F.sum("q").alias("q"))
    return t.select(F.round(F.col("b") / F.col("q"), 4).alias("sroie_precision"), F.round(F.col("b") / F.col("r"), 4).alias("sroie_recall"), F.round(2.0 * F.col("b") / (F.col("q") + F.col("r")), 4).alias("sroie_f1"), F.col("r").alias("reference_words"), F.col("q").alias("predicted_words"))


@query()
def length_bin_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CER in ten equal bins of reference length, with the bins' inclusive bounds; empty bins are left out."""
    p = _pairs(spark, sf_dir).select(F.length("ref").alias("n"), F.levenshtein("ref", "pred").alias("e"))
    b = p.agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    spot = F.least(F.lit(9), F.floor((F.col("n") - F.col("lo")) * 10.0 / F.greatest(F.lit(1), F.col("hi") - F.col("lo"))))
    return p.join(F.broadcast(b)).groupBy(spot.cast("bigint").alias("bin")).agg(F.min("n").alias("shortest"), F.max("n").alias("longest"), F.count(F.lit(1)).alias("n_pairs"), F.sum("n").alias("reference_characters"), F.sum("e").alias("edits"), error_rate(F.sum("e"), F.sum("n")).alias("cer"))


@query()
def script_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CER and exact share of each script of the references, where there are two or more."""
    p = _pairs(spark, sf_dir).select(F.coalesce(main_script("ref"), F.lit("none")).alias("script"), F.length("ref").alias("n"), F.levenshtein("ref", "pred").alias("e"), (F.col("ref") == F.col("pred")).alias("same"))
    rates = p.groupBy("script").agg(F.count(F.lit(1)).alias("n_pairs"), error_rate(F.sum("e"), F.sum("n")).alias("cer"), F.round(F.avg(F.col("same").cast("double")), 4).alias("exact"))
    several = rates.agg((F.count(F.lit(1)) > 1).alias("several"))
    return rates.join(F.broadcast(several)).where("several").drop("several")


@query()
def length_band_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CER of references of 42 to 57 characters, and their share of all edits (the band is the operator)."""
    p = _pairs(spark, sf_dir).select(F.length("ref").alias("n"), F.levenshtein("ref", "pred").alias("e"))
    band = F.col("n").between(42, 57)
    edits = F.sum(F.when(band, F.col("e")).otherwise(0))
    return p.agg(F.count_if(band).alias("n_pairs"), error_rate(edits, F.sum(F.when(band, F.col("n")).otherwise(0))).alias("cer"), F.round(edits / F.sum("e"), 4).alias("share_of_edits"))


@query()
def voted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text for each line that several responses read: the majority at every place, with its CER and the best single one."""
    p = _pairs(spark, sf_dir)
    said = p.join(table(spark, sf_dir, "transcribe_responses").select("response_id", "line_id").distinct(), "response_id")
    lines = said.groupBy("line_id").agg(F.max("ref").alias("ref"), F.array_sort(F.collect_list(F.struct("response_id", "pred"))).alias("r")).where("size(r) > 1")
    out = lines.select("line_id", "ref", voted(F.transform("r", lambda x: x["pred"])).alias("text"), F.array_min(F.transform("r", lambda x: F.levenshtein(x["pred"], "ref"))).alias("best_edits"))
    return out.select("line_id", "text", F.levenshtein("ref", "text").alias("edits"), "best_edits")


@query()
def drawn_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in the order in which their characters are drawn, where that differs from the order of the text."""
    lines = table(spark, sf_dir, "release_lines").where("text IS NOT NULL").select("line_id", "text").distinct()
    return lines.withColumn("d", drawn_column("text")).select("line_id", F.col("d.text").alias("drawn"), F.array_join(F.col("d.order").cast("array<string>"), ",").alias("places")).where("drawn <> text").select("line_id", "drawn", "places")


@query(f"""
SELECT model, round(avg(CAST(nfc_normalize(ref) = nfc_normalize(pred) AS DOUBLE)), 4) AS nfc FROM ({_PAIRS}) GROUP BY 1
""")
def nfc_match_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact share after NFC."""
    return _pairs(spark, sf_dir).groupBy("model").agg(F.round(F.avg((normal("ref") == normal("pred")).cast("double")), 4).alias("nfc"))


@query()
def bare_match_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact share under NFD, without marks, without punctuation, and without both."""

    def bare(column: str, drop: str) -> Column:
        return F.regexp_replace(normal(column, "NFD"), drop, "")

    rungs = {"nfd": "(?!)", "no_marks": r"\p{Mn}", "no_punctuation": r"\p{P}", "no_both": r"[\p{Mn}\p{P}]"}
    return _pairs(spark, sf_dir).groupBy("model").agg(*[F.round(F.avg((bare("ref", d) == bare("pred", d)).cast("double")), 4).alias(n) for n, d in rungs.items()])


@query(f"""
SELECT model, round(avg(CAST(ref = pred AS DOUBLE)), 4) AS raw, round(avg(CAST(lower(ref) = lower(pred) AS DOUBLE)), 4) AS caseless, round(avg(CAST(regexp_replace(ref, '[.,;:!?·]', '', 'g') = regexp_replace(pred, '[.,;:!?·]', '', 'g') AS DOUBLE)), 4) AS no_punctuation,
  round(avg(CAST(replace(ref, ' ', '') = replace(pred, ' ', '') AS DOUBLE)), 4) AS no_spaces FROM ({_PAIRS}) GROUP BY 1
""")
def match_rate_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    def rate(f, name):  # noqa: ANN001, ANN202
        return F.round(F.avg((f("ref") == f("pred")).cast("double")), 4).alias(name)

    return _pairs(spark, sf_dir).groupBy("model").agg(rate(F.col, "raw"), rate(F.lower, "caseless"), rate(lambda c: F.regexp_replace(c, "[.,;:!?·]", ""), "no_punctuation"), rate(lambda c: F.replace(F.col(c), F.lit(" "), F.lit("")), "no_spaces"))


@query()
def worst_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 worst lines by CER (a top 20 by nature)."""
    return _pairs(spark, sf_dir).select("response_id", "model", F.round(pair_cer("ref", "pred"), 4).alias("cer")).orderBy(F.desc("cer"), "response_id", "model").limit(20)


@query()
def confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit operations by kind and characters, with their share of all edits."""
    ops = _pairs(spark, sf_dir).where("ref <> pred").select(F.explode(edit_ops("ref", "pred")).alias("e")).groupBy("e.o", "e.a", "e.b").agg(F.count(F.lit(1)).alias("n"))
    whole = ops.agg(F.sum("n").alias("whole"))
    return ops.join(F.broadcast(whole)).select(F.col("o").alias("op"), F.col("a").alias("reference"), F.col("b").alias("prediction"), "n", F.round(F.col("n") / F.col("whole"), 6).alias("share"))


@query()
def error_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits by what they touch: spaces, punctuation, marks or letters."""
    c = confusions(spark, sf_dir)
    both = F.concat("reference", "prediction")
    kind = F.when(both.rlike(r"(?U)^\s+$"), "space").when(both.rlike(r"^[\p{P}\p{S}]+$"), "punctuation").when(both.rlike(r"^\p{M}+$"), "mark").otherwise(F.concat(F.lit("letter "), "op"))
    return c.groupBy(kind.alias("kind")).agg(F.sum("n").alias("n"), F.round(F.sum("share"), 4).alias("share"))


@query()
def edit_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by number of edits, empty numbers up to the greatest included."""
    e = _pairs(spark, sf_dir).select(F.levenshtein("ref", "pred").alias("edits")).groupBy("edits").agg(F.count(F.lit(1)).alias("n"))
    numbers = e.agg(F.max("edits").alias("most")).select(F.explode(F.sequence(F.lit(0), "most")).alias("edits"))
    return numbers.join(e, "edits", "left").select("edits", F.coalesce("n", F.lit(0)).alias("n"))


@query("""
SELECT c.char AS ch, count(*) AS n, round(avg(c.confidence), 4) AS mean_confidence FROM (SELECT unnest(character_confidences) AS c FROM transcribe_responses) WHERE c.char IS NOT NULL GROUP BY 1 HAVING count(*) >= 10
""")
def char_confidence_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "transcribe_responses").select(F.explode("character_confidences").alias("c")).where("c.char IS NOT NULL")
    return c.groupBy(F.col("c.char").alias("ch")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c.confidence"), 4).alias("mean_confidence")).where("n >= 10")


@query("""
SELECT CASE WHEN character_confidences IS NULL OR text IS NULL THEN 'absent' WHEN len(character_confidences) = length(text) THEN 'aligned' ELSE 'mismatch' END AS state, count(*) AS n FROM transcribe_responses GROUP BY 1
""")
def confidence_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("character_confidences").isNull() | F.col("text").isNull(), "absent").when(F.size("character_confidences") == F.length("text"), "aligned").otherwise("mismatch")
    return table(spark, sf_dir, "transcribe_responses").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH c AS (SELECT response_id, i, CASE WHEN k > 0.9 THEN 'high' WHEN k > 0.5 THEN 'medium' ELSE 'low' END AS tier FROM (
  SELECT response_id, i, cc[i].confidence AS k FROM (SELECT response_id, cc, unnest(range(1, len(cc) + 1)) AS i FROM (SELECT response_id, max(character_confidences) AS cc FROM transcribe_responses WHERE character_confidences IS NOT NULL GROUP BY 1)))),
m AS (SELECT *, CASE WHEN tier IS NOT DISTINCT FROM lag(tier) OVER (PARTITION BY response_id ORDER BY i) AND i > 1 THEN 0 ELSE 1 END AS c FROM c),
r AS (SELECT *, sum(c) OVER (PARTITION BY response_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM m),
g AS (SELECT response_id, run, max(tier) AS tier, count(*) AS n FROM r GROUP BY 1, 2)
SELECT tier, count(*) AS runs, max(n) AS longest FROM g GROUP BY 1
""")
def confidence_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of neighbouring characters of one confidence tier."""
    r = table(spark, sf_dir, "transcribe_responses").where("character_confidences IS NOT NULL").groupBy("response_id").agg(F.max("character_confidences").alias("cc"))
    k = F.col("c.confidence")
    c = r.select("response_id", F.posexplode("cc").alias("i", "c")).select("response_id", "i", F.when(k > 0.9, "high").when(k > 0.5, "medium").otherwise("low").alias("tier"))
    return islands(c, ["response_id"], ["i"], "tier").groupBy("tier").agg(F.count(F.lit(1)).alias("runs"), F.max("n").alias("longest"))


@query("""
SELECT coalesce(model_name, '(none)') AS model, round(sum(confidence * length(text)) / sum(length(text)), 4) AS weighted, round(avg(confidence), 4) AS plain FROM transcribe_responses WHERE text IS NOT NULL AND confidence IS NOT NULL GROUP BY 1
""")
def weighted_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "transcribe_responses").where("text IS NOT NULL AND confidence IS NOT NULL")
    return r.groupBy(F.coalesce("model_name", F.lit("(none)")).alias("model")).agg(F.round(F.sum(F.col("confidence") * F.length("text")) / F.sum(F.length("text")), 4).alias("weighted"), F.round(F.avg("confidence"), 4).alias("plain"))


@query("""
SELECT model, response_id, r AS rank FROM (SELECT coalesce(model_name, '(none)') AS model, response_id, row_number() OVER (PARTITION BY coalesce(model_name, '(none)') ORDER BY confidence, response_id) AS r FROM (SELECT DISTINCT model_name, response_id, confidence FROM transcribe_responses WHERE confidence IS NOT NULL)) WHERE r <= 8
""")
def least_confident_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight least confident responses of each model (a bottom 8 by nature)."""
    r = table(spark, sf_dir, "transcribe_responses").where("confidence IS NOT NULL").select(F.coalesce("model_name", F.lit("(none)")).alias("model"), "response_id", "confidence").distinct()
    w = Window.partitionBy("model").orderBy("confidence", "response_id")
    return r.withColumn("rank", F.row_number().over(w).cast("bigint")).where("rank <= 8").select("model", "response_id", "rank")
