"""Queries on the relational tables, events, labels and conversations, each with its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.operators import aggregates, joins, lookup, snapshots
from quillframe.sources.tables import register_views, table

#: prefix, rate, until: type rates, some of them dated; the undated one holds when no dated one does.
RATES = [("E", 1.0, None), ("ECO", 1.5, "2023-12-31"), ("ECO", 1.75, None), ("S", 2.0, None), ("SMALL", 2.5, "2024-06-30"), ("SMALL", 2.75, "2025-06-30"), ("ST", 3.0, None), ("STANDARD", 3.25, "2020-01-01"), ("PROMO", 4.0, "2030-01-01"), ("L", 5.0, None)]
TODAY = "2024-07-01"
_RATES_SQL = ", ".join(f"('{p}', {r}::DOUBLE, {'NULL' if u is None else repr(u)})" for p, r, u in RATES)


def r6(column, name: str):
    return F.round(column, 6).alias(name)


def papers_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    year = F.year("o_orderdate")
    where = [lookup.year_filter(year, span=(1996, 1998)), F.col("o_orderstatus") == "F", lookup.like_ci(F.col("o_orderpriority"), "high")]
    return lookup.lookup(o, where, [year.desc_nulls_last(), F.col("o_orderkey")], 100).select("o_orderkey", "o_totalprice", year.alias("order_year"))


def point_lookup_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.point_lookup(table(spark, sf_dir, "customer"), "c_name", " customer#000000042 ", "c_custkey").select("c_custkey", "c_name")


def missing_value_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.where(lookup.is_missing(F.col("quality").cast("string"))).select("doc_id", "lang")


def category_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return j.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").cast("long").alias("toxic"), r6(F.avg("quality"), "mean_quality"), F.countDistinct("source").alias("sources"))


def parent_child_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    child = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("child_role"), F.length("text").alias("child_len"))
    parent = c.select("conv_id", "turn", F.col("role").alias("parent_role"), F.length("text").alias("parent_len"))
    j = child.join(parent, ["conv_id", "turn"])
    return j.groupBy("parent_role", "child_role").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("child_len"), "mean_child"), r6(F.avg("parent_len"), "mean_parent"))


def semi_with_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(big, "c_custkey", "left_semi").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


def anti_zero_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


SUBQUERIES_SQL = """
    SELECT c.c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n_orders,
      (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F') AS n_done,
      (SELECT max(o.o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS top_price
    FROM customer c WHERE c.c_nationkey IN (1, 3, 5, 7)"""


def scalar_subqueries(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_views(spark, sf_dir)
    return spark.sql(SUBQUERIES_SQL)


def prefix_asof_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = spark.createDataFrame(RATES, "prefix string, rate double, until string")
    found = joins.longest_prefix_asof(table(spark, sf_dir, "part"), "p_type", rates, TODAY)
    parts = table(spark, sf_dir, "part").join(found, "p_type")
    return parts.groupBy("p_type", "prefix", "rate").agg(F.count(F.lit(1)).alias("n"), r6(F.sum(F.col("p_retailprice") * F.col("rate")), "priced"))


def spend_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), r6(F.sum(F.coalesce("value", F.lit(0.0))), "spend"), F.countDistinct("user_id").alias("users"))


def spend_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where((F.col("event_type") != "error") & (F.col("ts") >= F.lit("2024-01-08").cast("timestamp_ntz")))
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value"), "spend"))


def window_cost_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where((F.col("ts") >= F.lit("2024-01-23").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-30").cast("timestamp_ntz")))
    priced = spark.createDataFrame([("click", 0.5), ("view", 0.1), ("purchase", 2.0)], "event_type string, rate double")
    j = e.join(F.broadcast(priced), "event_type", "left")  # a fixed rate table of a few rows
    day = F.date_format("ts", "yyyy-MM-dd")
    return j.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"), r6(F.sum(F.coalesce(F.col("value") * F.col("rate"), F.lit(0.0))), "usd"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("rate").isNull(), F.col("event_type")))), ",").alias("unpriced"))


def json_field_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("double")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(k).alias("drafts"), r6(F.avg(k), "mean_k"), F.sum(F.when(k > 50, 1).otherwise(0)).alias("drifted"))


def section_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("double")
    section = F.coalesce(F.when(F.col("event_type") != "error", F.col("event_type")), F.lit("(whole page)"))
    return table(spark, sf_dir, "events").groupBy(section.alias("section")).agg(r6(F.avg(k), "mean_k"), r6(F.min(k), "worst"), F.countDistinct("user_id").alias("attempts"))


def grading_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("quality").isNotNull(), 1).otherwise(0)).alias("graded"), r6(F.avg("quality"), "mean_quality"), F.countDistinct("lang").alias("langs"))


def having_ungraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    ungraded = F.sum(F.when(F.col("quality").isNull(), 1).otherwise(0))
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), ungraded.alias("ungraded")).where(F.col("ungraded") * 2 > F.col("n"))


def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first_day"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))


def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.upper_median(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice")


def decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("customers"))


def page_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("l_quantity"), "mean_quantity"), r6(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), "revenue"),
        F.min_by("l_orderkey", F.struct("l_extendedprice", "l_orderkey", "l_linenumber")).alias("cheapest_order"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"))


def drift_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    disk = o.where("o_orderkey % 7 <> 0").select("o_orderkey", F.col("o_totalprice").alias("changed"))
    db = o.where("o_orderkey % 5 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 11 == 0, F.col("o_totalprice") - 1).otherwise(F.col("o_totalprice")).alias("indexed"))
    return snapshots.drift(disk, db, "o_orderkey", "changed", "indexed")


def backlog_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("line", F.concat_ws("|", F.lpad(F.col("turn").cast("string"), 4, "0"), "role", "text"))
    now = aggregates.fingerprint(c, "conv_id", F.col("line"))
    ledger = now.where("conv_id % 4 <> 0").withColumn("fingerprint", F.when(F.col("conv_id") % 6 == 1, F.lit("old")).otherwise(F.col("fingerprint")))
    return snapshots.backlog(now, ledger, "conv_id")


def upsert_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    new = c.where("c_custkey % 10 = 0").select((F.col("c_custkey") + F.when(F.col("c_custkey") % 20 == 0, 0).otherwise(100_000_000)).alias("c_custkey"), (F.col("c_acctbal") + 1).alias("c_acctbal"), "c_mktsegment")
    out = snapshots.upsert(c, new, ["c_custkey"])
    return out.select("c_custkey", r6(F.col("c_acctbal"), "c_acctbal"), "c_mktsegment")


def reconcile_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text"))
    old = rows.where("conv_id % 9 <> 3").withColumn("score", F.col("conv_id") * 10 + F.col("turn"))
    fresh = rows.where("turn < 4").withColumn("text", F.when(F.col("conv_id") % 5 == 2, F.concat("text", F.lit(" edited"))).otherwise(F.col("text")))
    return snapshots.reconcile(old, fresh, ["conv_id", "turn"], "text", ["score"]).select("conv_id", "turn", F.length("text").cast("long").alias("n_chars"), "score")


def edge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2").groupBy("l_suppkey", "l_partkey").agg(F.max("l_quantity").alias("confidence"))
    status = F.when(F.col("l_partkey") % 13 == 0, "rejected").otherwise("active")
    old = li.where("l_partkey % 3 <> 0").withColumn("status", status)
    new = li.where("l_partkey % 2 = 0").withColumn("status", F.lit("candidate")).withColumn("confidence", F.col("confidence") + 1)
    return snapshots.edge_upsert(old, new, ["l_suppkey", "l_partkey"]).groupBy("action", "status").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("confidence"), "confidence"))


def ranking_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id")
    a = e.agg(F.max(F.when(F.col("event_type") == "click", F.col("value"))).alias("score")).where("score is not null")
    b = e.agg(F.max(F.when(F.col("event_type") == "view", F.col("value"))).alias("score")).where("score is not null")
    return snapshots.ranking_diff(a, b, "user_id", "score")


def declines_last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return snapshots.last_write_wins(e, "user_id", [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


def replicate_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = aggregates.replicate_stats(table(spark, sf_dir, "events"), ["event_type", "user_id"], "value")
    return s.select("event_type", "user_id", "n", r6(F.col("mean"), "mean"), r6(F.col("sd"), "sd"), "lo", "hi")


def paired_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["click", "view"]).agg(F.avg("value"))
    arm = (F.col("user_id") % 5).alias("arm")
    n, mean, t, df = aggregates.paired_t(F.col("click") - F.col("view"))
    return e.groupBy(arm).agg(n, r6(mean, "mean_delta"), r6(t, "t"), df)


def regression_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    half = F.lit("2024-01-16").cast("timestamp_ntz")
    base = e.where(F.col("ts") < half).groupBy("user_id").agg(F.avg("value").alias("base"), F.count(F.lit(1)).alias("n_base"), F.max("value").alias("top"), F.min("value").alias("low"))
    now = e.where(F.col("ts") >= half).groupBy("user_id").agg(F.avg("value").alias("now"))
    j = now.join(base, "user_id", "left").withColumn("delta", F.round(F.col("now") - F.col("base"), 6))
    bucket = F.when(F.col("base").isNull(), "first").when(F.abs("delta") >= 1.0, F.when(F.col("delta") < 0, "regressed").otherwise("improved")).otherwise("steady")
    return j.select("user_id", "delta", bucket.alias("bucket"), "n_base", "top", "low")


def tournament(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("int"))
    key = F.struct(F.floor(F.col("value") / 10).alias("quality"), F.col("k"), (-F.col("event_id")).alias("first"))
    return e.groupBy("user_id").agg(F.max_by("event_id", key).alias("winner"), F.count(F.lit(1)).alias("drafts"))


def gate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    checks = [(F.col("quality") == 1, "low quality"), (F.col("toxic") == 0, "toxic"), (F.col("n_chars") >= 500, "short"), (F.col("lang") == "en", "language")]
    reasons = lookup.gate_reasons(checks)
    return d.select("doc_id", F.array_join(reasons, "; ").alias("reasons"), (F.size(reasons) == 0).alias("open"))


def budget_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillframe.operators.ranking import allocate

    return allocate(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), ["source"], "doc_id", "n_chars", 20_000, 4_000)


def anchor_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct().join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    g = li.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("times"), F.countDistinct("s_nationkey").alias("breadth"))
    return g.where("times >= 2").select("l_partkey", "times", "breadth", F.when(F.col("breadth") >= 2, "broad").otherwise("narrow").alias("kind"))


def top_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("cites"), F.max(F.year("o_orderdate")).alias("year")), "c_custkey", "left")
    return c.orderBy(F.coalesce("cites", F.lit(0)).desc(), F.col("year").desc_nulls_last(), "c_custkey").limit(50).select("c_custkey", F.coalesce("cites", F.lit(0)).cast("long").alias("cites"), "year")


def suffix_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillframe.operators.ranking import collision_suffix

    return collision_suffix(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "p_partkey").groupBy("p_name", "suffix").agg(F.min("p_partkey").alias("p_partkey"))


def collision_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    pairs = p.select("p_brand", "p_name", "p_type").distinct()
    a = pairs.select("p_name", F.col("p_type").alias("new_id"), "p_brand")
    b = pairs.select("p_name", F.col("p_type").alias("old_id"), "p_brand")
    kind = lookup.collision_kind(F.col("new_id"), F.col("old_id"), ["promo", "econ"])
    return a.join(b, ["p_name", "p_brand"]).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def knn_free_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillframe.operators.lint import document_rules, report

    return report(document_rules(table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")), "doc_id")


QUERIES = {f"q_{f.__name__}": f for f in (
    papers_lookup, point_lookup_ci, missing_value_filter, category_join, parent_child_quality, semi_with_activity, anti_zero_claims, scalar_subqueries,
    prefix_asof_rate, spend_by_role, spend_by_model, window_cost_rollup, json_field_quality, section_difficulty, grading_coverage, having_ungraded, first_seen,
    upper_median, decision_counts, page_summary, drift_diff, backlog_fingerprint, upsert_snapshot, reconcile_reset, edge_upsert, ranking_diff, declines_last_write,
    replicate_stats, paired_t, regression_delta, tournament, gate_reasons, budget_allocation, anchor_groups, top_neighbours, suffix_letters, collision_kinds)}
QUERIES["q_lint_report"] = knn_free_lint

ORACLES = {
    "q_papers_lookup": "SELECT o_orderkey, o_totalprice, year(o_orderdate)::INTEGER AS order_year FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998 AND o_orderstatus = 'F' AND o_orderpriority ILIKE '%high%' ORDER BY order_year DESC, o_orderkey LIMIT 100",
    "q_point_lookup_ci": "SELECT c_custkey, c_name FROM customer WHERE lower(trim(c_name)) = 'customer#000000042' ORDER BY c_custkey LIMIT 1",
    "q_missing_value_filter": "SELECT d.doc_id, d.lang FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL",
    "q_category_join": "SELECT lang, count(*) AS n, sum(toxic)::BIGINT AS toxic, round(avg(quality), 6) AS mean_quality, count(DISTINCT source) AS sources FROM documents JOIN labels USING (doc_id) GROUP BY lang",
    "q_parent_child_quality": "SELECT p.role AS parent_role, c.role AS child_role, count(*) AS n, round(avg(length(c.text)), 6) AS mean_child, round(avg(length(p.text)), 6) AS mean_parent FROM conversations c JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1 GROUP BY 1, 2",
    "q_semi_with_activity": "SELECT c_mktsegment, count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) GROUP BY 1",
    "q_anti_zero_claims": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "q_scalar_subqueries": SUBQUERIES_SQL,
    "q_prefix_asof_rate": f"""
        WITH r(prefix, rate, until) AS (VALUES {_RATES_SQL}),
        m AS (SELECT DISTINCT p_type, prefix, rate, until FROM part JOIN r ON starts_with(p_type, prefix) WHERE until IS NULL OR until >= '{TODAY}'),
        b AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY length(prefix) DESC, until ASC NULLS LAST) AS k FROM m)
        SELECT p.p_type, b.prefix, b.rate, count(*) AS n, round(sum(p_retailprice * rate), 6) AS priced FROM part p JOIN b ON b.p_type = p.p_type AND k = 1 GROUP BY 1, 2, 3""",
    "q_spend_by_role": "SELECT event_type, count(*) AS n, round(sum(coalesce(value, 0)), 6) AS spend, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
    "q_spend_by_model": "SELECT user_id, count(*) AS n, round(sum(value), 6) AS spend FROM events WHERE event_type <> 'error' AND ts >= TIMESTAMP '2024-01-08' GROUP BY 1",
    "q_window_cost_rollup": """
        WITH r(event_type, rate) AS (VALUES ('click', 0.5::DOUBLE), ('view', 0.1), ('purchase', 2.0))
        SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(sum(coalesce(value * rate, 0)), 6) AS usd,
          coalesce(array_to_string(list_sort(list(DISTINCT e.event_type) FILTER (r.rate IS NULL)), ','), '') AS unpriced
        FROM events e LEFT JOIN r ON r.event_type = e.event_type WHERE ts >= TIMESTAMP '2024-01-23' AND ts < TIMESTAMP '2024-01-30' GROUP BY 1""",
    "q_json_field_quality": "SELECT event_type, count(props->>'$.k') AS drafts, round(avg((props->>'$.k')::DOUBLE), 6) AS mean_k, sum(CASE WHEN (props->>'$.k')::DOUBLE > 50 THEN 1 ELSE 0 END)::BIGINT AS drifted FROM events GROUP BY 1",
    "q_section_difficulty": "SELECT coalesce(CASE WHEN event_type <> 'error' THEN event_type END, '(whole page)') AS section, round(avg((props->>'$.k')::DOUBLE), 6) AS mean_k, round(min((props->>'$.k')::DOUBLE), 6) AS worst, count(DISTINCT user_id) AS attempts FROM events GROUP BY 1",
    "q_grading_coverage": "SELECT count(*) AS n, sum(CASE WHEN quality IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS graded, round(avg(quality), 6) AS mean_quality, count(DISTINCT lang) AS langs FROM documents LEFT JOIN labels USING (doc_id)",
    "q_having_ungraded": "SELECT source, count(*) AS n, sum(CASE WHEN quality IS NULL THEN 1 ELSE 0 END)::BIGINT AS ungraded FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1 HAVING ungraded * 2 > n",
    "q_first_seen": "SELECT user_id, strftime(min(ts), '%Y-%m-%d') AS first_day, max_by(event_type, (ts, event_id)) AS last_type FROM events GROUP BY 1",
    "q_upper_median": "SELECT l_suppkey, list_sort(list(l_extendedprice))[count(*) // 2 + 1] AS upper_median FROM lineitem GROUP BY 1",
    "q_decision_counts": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1, 2",
    "q_page_summary": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS mean_quantity, round(sum(l_extendedprice * (1 - l_discount)), 6) AS revenue, min_by(l_orderkey, (l_extendedprice, l_orderkey, l_linenumber)) AS cheapest_order, count(*) FILTER (l_discount > 0.05) AS discounted FROM lineitem GROUP BY 1, 2",
    "q_drift_diff": """
        WITH a AS (SELECT o_orderkey, o_totalprice AS c FROM orders WHERE o_orderkey % 7 <> 0),
        b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN o_totalprice - 1 ELSE o_totalprice END AS i FROM orders WHERE o_orderkey % 5 <> 0)
        SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'missing' WHEN a.o_orderkey IS NULL THEN 'extra' ELSE 'stale' END AS kind
        FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR c > i""",
    "q_backlog_fingerprint": """
        WITH n AS (SELECT conv_id FROM conversations GROUP BY 1)
        SELECT conv_id, CASE WHEN conv_id % 4 = 0 THEN 'new' ELSE 'changed' END AS why FROM n WHERE conv_id % 4 = 0 OR conv_id % 6 = 1""",
    "q_upsert_snapshot": """
        WITH n AS (SELECT c_custkey + CASE WHEN c_custkey % 20 = 0 THEN 0 ELSE 100000000 END AS c_custkey, c_acctbal + 1 AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 10 = 0)
        SELECT c_custkey, round(c_acctbal, 6) AS c_acctbal, c_mktsegment FROM customer c WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.c_custkey = c.c_custkey)
        UNION ALL SELECT c_custkey, round(c_acctbal, 6), c_mktsegment FROM n""",
    "q_reconcile_reset": """
        SELECT conv_id, turn, length(text) + CASE WHEN conv_id % 5 = 2 THEN 7 ELSE 0 END AS n_chars,
          CASE WHEN conv_id % 9 <> 3 AND conv_id % 5 <> 2 THEN conv_id * 10 + turn END AS score FROM conversations WHERE turn < 4""",
    "q_edge_upsert": """
        WITH l AS (SELECT l_suppkey, l_partkey, max(l_quantity) AS q FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1, 2),
        x AS (SELECT q, l_partkey % 3 <> 0 AS o, l_partkey % 2 = 0 AS n, l_partkey % 13 = 0 AS rej FROM l),
        y AS (SELECT *, CASE WHEN NOT n THEN 'kept' WHEN NOT o THEN 'inserted' WHEN rej THEN 'skipped' ELSE 'updated' END AS action FROM x WHERE o OR n)
        SELECT action, CASE WHEN action IN ('inserted', 'updated') THEN 'candidate' WHEN rej THEN 'rejected' ELSE 'active' END AS status, count(*) AS n,
          round(sum(CASE WHEN action IN ('inserted', 'updated') THEN q + 1 ELSE q END), 6) AS confidence FROM y GROUP BY 1, 2""",
    "q_ranking_diff": """
        WITH s AS (SELECT user_id, max(value) FILTER (event_type = 'click') AS a, max(value) FILTER (event_type = 'view') AS b FROM events GROUP BY 1)
        SELECT user_id, CASE WHEN b IS NOT NULL AND (a IS NULL OR b > a) THEN 'improved' WHEN a IS NOT NULL AND (b IS NULL OR b < a) THEN 'regressed' ELSE 'unchanged' END AS change FROM s WHERE a IS NOT NULL OR b IS NOT NULL""",
    "q_declines_last_write": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
    "q_replicate_stats": "SELECT event_type, user_id, count(value) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS sd, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1, 2",
    "q_paired_t": """
        WITH u AS (SELECT user_id, avg(value) FILTER (event_type = 'click') - avg(value) FILTER (event_type = 'view') AS d FROM events GROUP BY 1)
        SELECT user_id % 5 AS arm, count(d) AS n, round(avg(d), 6) AS mean_delta, round(CASE WHEN count(d) < 2 THEN 0 ELSE avg(d) / sqrt(var_samp(d) / count(d)) END, 6) AS t, greatest(count(d) - 1, 0) AS df FROM u GROUP BY 1""",
    "q_regression_delta": """
        WITH b AS (SELECT user_id, avg(value) AS base, count(*) AS n_base, max(value) AS top, min(value) AS low FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1),
        n AS (SELECT user_id, avg(value) AS now FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1),
        j AS (SELECT n.user_id, round(now - base, 6) AS delta, base, n_base, top, low FROM n LEFT JOIN b USING (user_id))
        SELECT user_id, delta, CASE WHEN base IS NULL THEN 'first' WHEN abs(delta) >= 1 THEN CASE WHEN delta < 0 THEN 'regressed' ELSE 'improved' END ELSE 'steady' END AS bucket, n_base, top, low FROM j""",
    "q_tournament": "SELECT user_id, max_by(event_id, (floor(value / 10), (props->>'$.k')::INTEGER, -event_id)) AS winner, count(*) AS drafts FROM events GROUP BY 1",
    "q_gate_reasons": """
        SELECT d.doc_id, concat_ws('; ', CASE WHEN NOT coalesce(quality = 1, false) THEN 'low quality' END, CASE WHEN NOT coalesce(toxic = 0, false) THEN 'toxic' END,
          CASE WHEN n_chars < 500 THEN 'short' END, CASE WHEN lang <> 'en' THEN 'language' END) AS reasons, coalesce(quality = 1 AND toxic = 0 AND n_chars >= 500 AND lang = 'en', false) AS open
        FROM documents d LEFT JOIN labels l USING (doc_id)""",
    "q_budget_allocation": """
        WITH c AS (SELECT source, doc_id, least(n_chars, 4000) AS want, sum(least(n_chars, 4000)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS used FROM documents)
        SELECT source, doc_id, greatest(0, least(want, 20000 - coalesce(used, 0)))::BIGINT AS granted FROM c WHERE 20000 - coalesce(used, 0) > 0""",
    "q_anchor_groups": """
        WITH p AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), g AS (SELECT l_partkey, count(*) AS times, count(DISTINCT s_nationkey) AS breadth FROM p JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1)
        SELECT l_partkey, times, breadth, CASE WHEN breadth >= 2 THEN 'broad' ELSE 'narrow' END AS kind FROM g WHERE times >= 2""",
    "q_top_neighbours": """
        SELECT c_custkey, coalesce(cites, 0) AS cites, year FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS cites, max(year(o_orderdate))::INTEGER AS year FROM orders GROUP BY 1) ON o_custkey = c_custkey
        ORDER BY coalesce(cites, 0) DESC, year DESC NULLS LAST, c_custkey LIMIT 50""",
    "q_suffix_letters": """
        WITH r AS (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part)
        SELECT p_name, CASE WHEN k = 1 THEN '' WHEN k <= 26 THEN chr((96 + k)::INTEGER) ELSE k::VARCHAR END AS suffix, min(p_partkey) AS p_partkey FROM r GROUP BY 1, 2""",
    "q_collision_kinds": """
        WITH p AS (SELECT DISTINCT p_brand, p_name, p_type FROM part), j AS (SELECT a.p_type AS x, b.p_type AS y FROM p a JOIN p b ON a.p_name = b.p_name AND a.p_brand = b.p_brand),
        k AS (SELECT x, y, (lower(x) LIKE 'promo%' OR lower(x) LIKE 'econ%') AS px, (lower(y) LIKE 'promo%' OR lower(y) LIKE 'econ%') AS py FROM j)
        SELECT CASE WHEN x = y THEN 'duplicate' WHEN py AND NOT px THEN 'upgrade' WHEN NOT py AND px THEN 'downgrade' ELSE 'unclear' END AS kind, count(*) AS n FROM k GROUP BY 1""",
    "q_lint_report": """
        SELECT 'missing-label' AS rule, doc_id, '' AS detail FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL
        UNION ALL SELECT 'thin-text', doc_id, n_chars::VARCHAR FROM documents WHERE n_chars < 200
        UNION ALL SELECT 'toxic-but-good', doc_id, '' FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND quality = 1
        UNION ALL SELECT 'length-mismatch', doc_id, length(text)::VARCHAR FROM documents WHERE length(text) <> n_chars""",
}
