"""Operational analytics: activity, workflow counts, result pages, newest rows, rates, queue sweeps.

The star schema plays the operational tables: orders are pages (customers their owners), lineitems the lines
of a page, parts the models, events the sessions, requests and jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codexlake.operators.relational import first_hit, full_outer_diff, keep_newest, keyset_page, latest_per_group, overlay, ratio, within_window, zero_filled
from codexlake.plans.catalog import query
from codexlake.runtime import table


@query("""
SELECT count(*) AS total, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)) AS unsegmented,
  count(*) FILTER (WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')) AS with_returns,
  count(*) FILTER (WHERE o.o_orderstatus = 'F') AS reviewed FROM orders o
""")
def workflow_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by workflow state in one row: one pre-aggregation of the lines instead of a subquery each."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max(F.col("l_returnflag") == "R").alias("returns"))
    pages = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return pages.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("l_orderkey").isNull()).alias("unsegmented"), F.count_if(F.col("returns")).alias("with_returns"), F.count_if(F.col("o_orderstatus") == "F").alias("reviewed"))


@query("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def pages_unsegmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O')")
def pages_transcribable(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'")
    return table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").join(ready, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("""
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS position FROM orders
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
""")
def batch_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligible pages that aren't in flight, in reading order within their owner."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.col("l_returnflag") == "R").alias("busy"))
    pages = table(spark, sf_dir, "orders").join(lines.where("NOT busy"), "o_orderkey", "left_semi")
    return pages.select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("bigint").alias("position"))


@query("""
WITH probe AS (SELECT o_totalprice, o_orderkey FROM orders WHERE (o_totalprice, o_orderkey) < (200000.0, 0) ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 51),
n AS (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey DESC) AS r, count(*) OVER () AS c FROM probe)
SELECT o_totalprice, o_orderkey, c > 50 AS has_more FROM n WHERE r <= 50
""")
def keyset_page_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of 50 orders below a cursor (the page size is the feature)."""
    return keyset_page(table(spark, sf_dir, "orders").select("o_totalprice", "o_orderkey"), ["o_totalprice", "o_orderkey"], (200000.0, 0), 50)


@query("""
WITH j AS (SELECT c_name, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'),
probe AS (SELECT * FROM j WHERE (c_name, o_orderkey) > ('Customer#000000100', 0) ORDER BY c_name, o_orderkey LIMIT 41),
n AS (SELECT *, row_number() OVER (ORDER BY c_name, o_orderkey) AS r, count(*) OVER () AS c FROM probe)
SELECT c_name, o_orderkey, c > 40 AS has_more FROM n WHERE r <= 40
""")
def keyset_page_asc_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey")).select("c_name", "o_orderkey")
    return keyset_page(joined, ["c_name", "o_orderkey"], ("Customer#000000100", 0), 40, descending=False)


@query("SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus <> 'P' GROUP BY 1, 2")
def counts_by_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_orderstatus") != "P")).groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT c_custkey, n_pages, n_lines, last_day FROM customer c
LEFT JOIN (SELECT o_custkey, count(*) AS n_pages, strftime(max(o_orderdate), '%Y-%m-%d') AS last_day FROM orders GROUP BY 1) p ON p.o_custkey = c_custkey
LEFT JOIN (SELECT o_custkey, count(*) AS n_lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) l ON l.o_custkey = c_custkey
ORDER BY n_lines DESC NULLS LAST, n_pages DESC NULLS LAST, c_custkey LIMIT 20
""")
def top_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 most active owners (the report is a top 20)."""
    orders = table(spark, sf_dir, "orders")
    pages = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_pages"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last_day"))
    lines = orders.join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_lines"))
    joined = table(spark, sf_dir, "customer").select("c_custkey").join(pages.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left").join(lines.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left")
    return joined.orderBy(F.desc_nulls_last("n_lines"), F.desc_nulls_last("n_pages"), "c_custkey").select("c_custkey", "n_pages", "n_lines", "last_day").limit(20)


@query("""
SELECT count(DISTINCT user_id) AS users, count(DISTINCT user_id) FILTER (WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY) AS active_7d,
  count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) AS events FROM events
""")
def user_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    last = events.agg(F.max("ts").alias("last"))
    recent = F.when(F.col("ts") > F.col("last") - F.expr("INTERVAL 7 DAYS"), F.col("user_id"))
    return events.join(F.broadcast(last)).agg(F.countDistinct("user_id").alias("users"), F.countDistinct(recent).alias("active_7d"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count(F.lit(1)).alias("events"))


@query("SELECT strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS week, count(*) AS n, count(DISTINCT o_custkey) AS owners FROM orders GROUP BY 1")
def new_per_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.date_format(F.date_trunc("week", "o_orderdate"), "yyyy-MM-dd").alias("week")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("owners"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, CASE WHEN value >= 20 THEN 'high' ELSE 'low' END AS level, count(*) AS n FROM events GROUP BY 1, 2, 3")
def jobs_per_day_kind_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("value") >= 20, "high").otherwise("low").alias("level")
    return table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type", level).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH s AS (SELECT id, min(part_id) AS part_id, min(created_at) AS created_at, min(paired_line_count) AS paired FROM annotation_history_snapshots GROUP BY id),
d AS (SELECT part_id, id, created_at, greatest(0, paired - lag(paired) OVER (PARTITION BY part_id ORDER BY created_at, id)) AS delta FROM s)
SELECT part_id, id, CAST(coalesce(delta, 0) AS INTEGER) AS approved FROM d WHERE created_at >= TIMESTAMP '2024-03-01'
""")
def approval_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newly paired lines a snapshot; the difference runs over the full history, the date filter stays outside."""
    s = table(spark, sf_dir, "annotation_history_snapshots").groupBy("id").agg(F.min("part_id").alias("part_id"), F.min("created_at").alias("created_at"), F.min("paired_line_count").alias("paired"))
    w = Window.partitionBy("part_id").orderBy("created_at", "id")
    d = s.withColumn("approved", F.greatest(F.lit(0), F.col("paired") - F.lag("paired").over(w)))
    return d.where("created_at >= TIMESTAMP_NTZ '2024-03-01'").select("part_id", "id", F.coalesce("approved", F.lit(0)).alias("approved"))


@query("""
WITH f AS (SELECT CAST(ts AS DATE) AS day, event_type FROM events WHERE event_type IN ('signup', 'error')),
c AS (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS day FROM f)
SELECT strftime(c.day, '%Y-%m-%d') AS day, count(*) FILTER (WHERE event_type = 'signup') AS signups, count(*) FILTER (WHERE event_type = 'error') AS errors
FROM c LEFT JOIN f ON f.day = CAST(c.day AS DATE) GROUP BY 1
""")
def activity_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups and errors of all users on each day from the first to the last."""
    f = table(spark, sf_dir, "events").where(F.col("event_type").isin("signup", "error")).select(F.to_date("ts").alias("day"), "event_type")
    return zero_filled(f, "day", {"signups": F.col("event_type") == "signup", "errors": F.col("event_type") == "error"}).withColumn("day", F.col("day").cast("string"))


@query("""
SELECT coalesce(p_brand, '(no model)') AS model, count(*) AS jobs, count(*) FILTER (WHERE l_returnflag <> 'R') AS done,
  CASE WHEN count(*) > 0 THEN round(count(*) FILTER (WHERE l_returnflag <> 'R') / count(*), 4) END AS success_rate,
  round(percentile_cont(0.5) WITHIN GROUP (ORDER BY date_diff('day', o_orderdate, l_shipdate)) FILTER (WHERE l_linestatus = 'F'), 1) AS median_days
FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey AND p_size > 5 GROUP BY 1
""")
def model_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "part").where("p_size > 5").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"), "left")
    days = F.datediff("l_shipdate", "o_orderdate").alias("days")
    jobs = jobs.select(F.coalesce("p_brand", F.lit("(no model)")).alias("model"), "l_returnflag", "l_linestatus", days)
    done = F.count_if(F.col("l_returnflag") != "R")
    return jobs.groupBy("model").agg(F.count(F.lit(1)).alias("jobs"), done.alias("done"), ratio(done, F.count(F.lit(1))).alias("success_rate"), F.expr("round(percentile_cont(0.5) WITHIN GROUP (ORDER BY days) FILTER (WHERE l_linestatus = 'F'), 1)").alias("median_days"))


@query("""
SELECT l_returnflag, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY l_quantity), 1) AS p50, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY l_quantity), 1) AS p95 FROM lineitem GROUP BY 1
""")
def duration_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.expr("round(percentile_cont(0.5) WITHIN GROUP (ORDER BY l_quantity), 1)").alias("p50"), F.expr("round(percentile_cont(0.95) WITHIN GROUP (ORDER BY l_quantity), 1)").alias("p95"))


@query("""
SELECT message_class, n FROM (SELECT left(regexp_replace(message, '[0-9]+', 'N', 'g'), 80) AS message_class, count(*) AS n FROM feedback WHERE message IS NOT NULL GROUP BY 1)
ORDER BY n DESC, message_class LIMIT 5
""")
def top_failure_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five commonest messages of any alphabet, numbers aside (a top 5 by nature); classes are cut by code point."""
    f = table(spark, sf_dir, "feedback").where("message IS NOT NULL")
    return f.groupBy(F.left(F.regexp_replace("message", "[0-9]+", "N"), F.lit(80)).alias("message_class")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "message_class").limit(5)


@query("""
SELECT n_name, count(DISTINCT c_custkey) AS owners, count(DISTINCT o_orderkey) AS pages, count(l_orderkey) AS lines FROM nation
LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1
""")
def owner_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct counts over a fan-out, pre-aggregated level by level so that no level multiplies the next."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    pages = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").distinct().join(lines, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.countDistinct("o_orderkey").alias("pages"), F.sum("n").alias("lines"))
    owners = table(spark, sf_dir, "customer").join(pages, "c_custkey", "left").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.countDistinct("c_custkey").alias("owners"), F.sum("pages").alias("pages"), F.sum("lines").alias("lines"))
    return table(spark, sf_dir, "nation").join(owners, "n_nationkey", "left").groupBy("n_name").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("owners", "pages", "lines")])


@query("""
SELECT c_mktsegment, count(*) AS lines, count(DISTINCT o_orderkey) AS pages FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey AND l_linestatus = 'F' WHERE length(trim(l_returnflag)) > 0 GROUP BY 1
""")
def ground_truth_by_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F' AND length(trim(l_returnflag)) > 0").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    joined = table(spark, sf_dir, "orders").join(lines, "o_orderkey").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_mktsegment").agg(F.sum("n").alias("lines"), F.countDistinct("o_orderkey").alias("pages"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey = 7 OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 7)")
def member_or_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owned pages and shared pages: the OR becomes a union of two cheap joins."""
    orders = table(spark, sf_dir, "orders")
    shared = table(spark, sf_dir, "lineitem").where("l_suppkey = 7").select(F.col("l_orderkey").alias("o_orderkey"))
    return orders.where("o_custkey = 7").select("o_orderkey").union(orders.join(shared, "o_orderkey", "left_semi").select("o_orderkey")).distinct()


@query("""
SELECT c_custkey, coalesce(own.p, seg.p, nat.p) AS binding, CAST(CASE WHEN own.p IS NOT NULL THEN 0 WHEN seg.p IS NOT NULL THEN 1 WHEN nat.p IS NOT NULL THEN 2 END AS INTEGER) AS priority FROM customer
LEFT JOIN (SELECT o_custkey AS k, max(o_orderpriority) AS p FROM orders WHERE o_totalprice > 250000 GROUP BY 1) own ON own.k = c_custkey
LEFT JOIN (SELECT c_mktsegment AS k, 'segment ' || min(c_name) AS p FROM customer WHERE c_acctbal > 9900 GROUP BY 1) seg ON seg.k = c_mktsegment
LEFT JOIN (SELECT n_nationkey AS k, 'nation ' || n_name AS p FROM nation) nat ON nat.k = c_nationkey
""")
def binding_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model binding for every owner: its own, else its segment's, else its nation's."""
    customer = table(spark, sf_dir, "customer")
    own = table(spark, sf_dir, "orders").where("o_totalprice > 250000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("binding"))
    segment = customer.where("c_acctbal > 9900").groupBy("c_mktsegment").agg(F.concat(F.lit("segment "), F.min("c_name")).alias("binding"))
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.concat(F.lit("nation "), "n_name").alias("binding"))
    return first_hit(customer, ["c_custkey"], [own, segment, nation], "binding")


@query("SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def latest_per_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_per_group(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_type")


@query("SELECT user_id, event_id, r AS rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 5")
def retain_newest_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_newest(table(spark, sf_dir, "events").select("user_id", "ts", "event_id"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).select("user_id", "event_id", F.col("rank").cast("bigint").alias("rank"))


@query("""
SELECT part_id, id FROM (SELECT part_id, id, row_number() OVER (PARTITION BY part_id ORDER BY created_at DESC, id DESC) AS r FROM (SELECT DISTINCT part_id, id, created_at FROM annotation_history_snapshots)) WHERE r > 2
""")
def prunable_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "annotation_history_snapshots").select("part_id", "id", "created_at").distinct()
    return s.withColumn("r", F.row_number().over(Window.partitionBy("part_id").orderBy(F.desc("created_at"), F.desc("id")))).where("r > 2").select("part_id", "id")


@query("SELECT manuscript, page_index, row_number() OVER (PARTITION BY manuscript ORDER BY page_index) AS page_number FROM (SELECT DISTINCT manuscript, page_index FROM release_lines WHERE manuscript IS NOT NULL)")
def page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "release_lines").where("manuscript IS NOT NULL").select("manuscript", "page_index").distinct()
    return pages.withColumn("page_number", F.row_number().over(Window.partitionBy("manuscript").orderBy("page_index")).cast("bigint"))


@query("""
SELECT l_orderkey, l_suppkey, n, row_number() OVER (PARTITION BY l_orderkey ORDER BY first_line, l_suppkey) - 1 AS new_order
FROM (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS first_line, count(*) AS n FROM lineitem GROUP BY 1, 2)
""")
def dense_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.min("l_linenumber").alias("first_line"), F.count(F.lit(1)).alias("n"))
    return blocks.select("l_orderkey", "l_suppkey", "n", (F.row_number().over(Window.partitionBy("l_orderkey").orderBy("first_line", "l_suppkey")) - 1).cast("bigint").alias("new_order"))


@query("SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) = 1")
def single_child_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("l_orderkey")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 90 AND event_type <> 'error'")
def json_contains_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.variant_get(F.parse_json("props"), "$.k", "bigint").alias("k")
    return table(spark, sf_dir, "events").where("event_type <> 'error'").select("event_id", k).where("k >= 90")


@query("SELECT e.k AS missing FROM (VALUES ('FRANCE'), ('ATLANTIS'), ('GERMANY'), ('LEMURIA')) e(k) LEFT JOIN nation ON upper(n_name) = e.k WHERE n_name IS NULL")
def expected_rows_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = spark.createDataFrame([("FRANCE",), ("ATLANTIS",), ("GERMANY",), ("LEMURIA",)], "missing string")
    return expected.join(table(spark, sf_dir, "nation"), F.upper("n_name") == F.col("missing"), "left_anti")


@query("""
WITH a AS (SELECT l_orderkey, l_linenumber, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-06-01' GROUP BY 1, 2),
b AS (SELECT l_orderkey, l_linenumber, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' GROUP BY 1, 2)
SELECT CASE WHEN b.l_orderkey IS NULL THEN 'deleted' WHEN a.l_orderkey IS NULL THEN 'added' WHEN a.q = b.q THEN 'unchanged' ELSE 'changed' END AS change, count(*) AS n
FROM a FULL OUTER JOIN b USING (l_orderkey, l_linenumber) GROUP BY 1
""")
def run_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    a, b = (lines.where(c).groupBy("l_orderkey", "l_linenumber").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("q")) for c in ("l_shipdate < TIMESTAMP_NTZ '1998-06-01'", "l_shipdate >= TIMESTAMP_NTZ '1996-01-01'"))
    return full_outer_diff(a, b, ["l_orderkey", "l_linenumber"], "q").groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS n,
  count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) > 3 AS over_limit FROM events
""")
def rate_limit_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = within_window(table(spark, sf_dir, "events"), ["user_id"], "ts", 6 * 3600)
    return table(spark, sf_dir, "events").select("event_id", n.alias("n"), (n > 3).alias("over_limit"))


@query("""
WITH j AS (SELECT event_id, event_type, date_diff('second', ts, (SELECT max(ts) FROM events)) AS age, CAST(json_extract(props, '$.k') AS BIGINT) % 6 AS attempts FROM events)
SELECT event_id, CASE WHEN event_type IN ('click', 'view') AND age > 86400 AND attempts + 1 >= 5 THEN 'failed' WHEN event_type IN ('click', 'view') AND age > 86400 THEN 'pending' ELSE event_type END AS new_status,
  CASE WHEN event_type IN ('click', 'view') AND age > 86400 THEN attempts + 1 ELSE attempts END AS attempts FROM j
""")
def lease_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stale leases go back to pending, or fail on their fifth attempt."""
    events = table(spark, sf_dir, "events")
    last = events.agg(F.max("ts").alias("last"))
    age = F.floor(F.unix_seconds(F.col("last").cast("timestamp"))) - F.floor(F.unix_seconds(F.col("ts").cast("timestamp")))
    j = events.join(F.broadcast(last)).select("event_id", "event_type", age.alias("age"), (F.get_json_object("props", "$.k").cast("bigint") % 6).alias("attempts"))
    stale = F.col("event_type").isin("click", "view") & (F.col("age") > 86400)
    return j.select("event_id", F.when(stale & (F.col("attempts") + 1 >= 5), "failed").when(stale, "pending").otherwise(F.col("event_type")).alias("new_status"), F.when(stale, F.col("attempts") + 1).otherwise(F.col("attempts")).alias("attempts"))


@query("""
SELECT event_type AS route, CASE WHEN value >= 40 THEN '5xx' WHEN value >= 20 THEN '4xx' ELSE '2xx' END AS status_class, count(*) AS n, round(avg(value), 3) AS avg_ms, max(value) AS max_ms FROM events GROUP BY 1, 2
""")
def request_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("value") >= 40, "5xx").when(F.col("value") >= 20, "4xx").otherwise("2xx").alias("status_class")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("route"), status).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 3).alias("avg_ms"), F.max("value").alias("max_ms"))


@query("""
SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority || ' new' END, o_orderpriority) AS label, o_totalprice AS price FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
""")
def bulk_replace_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulk replace from the pages that still have lines: absent fields keep their value, pages without lines are deleted."""
    orders = table(spark, sf_dir, "orders")
    sent = orders.join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    base = orders.select("o_orderkey", F.col("o_orderpriority").alias("label"), F.col("o_totalprice").alias("price"))
    updates = sent.select("o_orderkey", F.when(F.col("o_orderstatus") != "F", F.concat("o_orderpriority", F.lit(" new"))).alias("label"), F.lit(None).cast("double").alias("price"))
    return overlay(base, updates, ["o_orderkey"], ["label", "price"])


@query("""
SELECT o_orderkey, coalesce(n, 0) AS found, declared FROM (SELECT o_orderkey, CAST(o_totalprice AS BIGINT) % 8 AS declared FROM orders) o LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey WHERE coalesce(n, 0) <> declared
""")
def exact_counts_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export validation: declared against found counts."""
    found = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    declared = table(spark, sf_dir, "orders").select("o_orderkey", (F.bround("o_totalprice").cast("bigint") % 8).alias("declared"))
    return declared.join(found, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("found"), "declared").where("found <> declared")


@query("""
SELECT user_id, event_id, best, n - max(CASE WHEN is_new THEN n END) OVER (PARTITION BY user_id ORDER BY n) AS waited FROM (
  SELECT *, best < coalesce(lag(best) OVER (PARTITION BY user_id ORDER BY n), 1e18) AS is_new FROM (
    SELECT user_id, event_id, row_number() OVER w AS n, min(value) OVER w AS best FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)))
""")
def running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patience: the best value so far and how many steps it has stood."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(w).cast("bigint").alias("n"), F.min("value").over(w).alias("best"))
    v = Window.partitionBy("user_id").orderBy("n")
    fresh = F.col("best") < F.coalesce(F.lag("best").over(v), F.lit(1e18))
    return e.withColumn("fresh", F.when(fresh, F.col("n"))).select("user_id", "event_id", "best", (F.col("n") - F.max("fresh").over(v)).alias("waited"))
