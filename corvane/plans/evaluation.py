"""Evaluation queries: users are runs, their events the steps of a trajectory."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.operators import metrics as M
from corvane.plans.registry import query
from corvane.sources.tables import table


@query("""
WITH s AS (SELECT user_id, event_type, value, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) >= 150 AS enough, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
x AS (SELECT *, min(CASE WHEN event_type = 'purchase' THEN pos END) OVER (PARTITION BY user_id) AS stop, min(CASE WHEN enough THEN pos END) OVER (PARTITION BY user_id) AS suff FROM s)
SELECT user_id, count(*) AS steps, min(stop) AS first_stop, min(suff) AS first_sufficient, arg_max(enough, pos) AS success, coalesce(bool_or(CASE WHEN pos = stop THEN NOT enough END), false) AS premature_stop, min(stop) IS NULL AS never_stop,
count(CASE WHEN pos > suff AND pos < stop THEN 1 END) AS late_steps, round(coalesce(sum(CASE WHEN pos > suff AND pos < stop THEN value END), 0), 6) AS late_tokens FROM x GROUP BY user_id
""")
def trajectory_summary(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    s = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type", "value").withColumn("enough", F.sum("value").over(w) >= 150)
    return M.trajectories(s, "user_id", ["ts", "event_id"], "event_type", "purchase", "enough", "value")


@query("""
WITH n AS (SELECT user_id, count(*) AS steps, round(sum(value), 6) AS cost FROM events GROUP BY user_id) SELECT count(*) AS runs, round(avg(steps), 6) AS mean_steps, round(median(steps), 6) AS median_steps, round(avg(cost), 4) AS mean_cost FROM n
""")
def cost_means(spark, d):
    n = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("steps"), F.round(F.sum("value"), 6).alias("cost"))
    return n.agg(F.count("*").alias("runs"), F.round(F.avg("steps"), 6).alias("mean_steps"), F.round(F.median("steps"), 6).alias("median_steps"), F.round(F.avg("cost"), 4).alias("mean_cost"))


@query("""
WITH p AS (SELECT l_returnflag AS curve, l_linestatus AS method, CAST(l_quantity AS DOUBLE) AS cost, round(avg(l_discount), 8) AS score FROM lineitem GROUP BY ALL),
x AS (SELECT *, (lead(cost) OVER w - cost) * (lead(score) OVER w + score) / 2 AS area FROM p WINDOW w AS (PARTITION BY curve, method ORDER BY cost, score))
SELECT curve, method, count(*) AS points, round(CASE WHEN max(cost) > min(cost) THEN sum(area) / (max(cost) - min(cost)) ELSE min_by(score, cost) END, 6) AS auc FROM x GROUP BY ALL
""")
def auc_sufficiency_cost(spark, d):
    p = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("curve"), F.col("l_linestatus").alias("method"), F.col("l_quantity").cast("double").alias("cost")).agg(F.round(F.avg("l_discount"), 8).alias("score"))
    return M.auc(p, ["curve", "method"], "cost", "score")


@query("""
WITH n AS (SELECT user_id, event_type, count(*) AS votes FROM events GROUP BY ALL), x AS (SELECT *, sum(votes) OVER (PARTITION BY user_id)::BIGINT AS voters, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, event_type) AS r FROM n)
SELECT user_id, CASE WHEN votes >= 2 THEN event_type END AS event_type, votes, voters FROM x WHERE r = 1
""")
def majority_vote(spark, d):
    return M.majority(table(spark, d, "events").select("user_id", "event_type"), ["user_id"], "event_type")


@query("SELECT o_orderstatus, metric, count(*) AS tasks, round(avg(value), 4) AS mean FROM (UNPIVOT (SELECT o_orderstatus, o_totalprice AS price, CAST(year(o_orderdate) AS DOUBLE) AS placed FROM orders) ON price, placed INTO NAME metric VALUE value) GROUP BY ALL")
def long_metric_means(spark, d):
    o = table(spark, d, "orders").select("o_orderstatus", F.col("o_totalprice").alias("price"), F.year("o_orderdate").cast("double").alias("placed"))
    return M.long_means(o, ["o_orderstatus"], ["price", "placed"]).withColumn("mean", F.round("mean", 4))


@query("SELECT l_returnflag, count(*) AS n, quantile_disc(l_extendedprice, 0.95) AS l_extendedprice FROM lineitem GROUP BY ALL")
def nearest_rank_p95(spark, d):
    """By an ordered-set aggregate, so no group is sorted in one task."""
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.expr("percentile_disc(0.95) within group (order by l_extendedprice)").alias("l_extendedprice"))


@query("""
WITH r AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, ts, event_id) AS rank FROM events),
s AS (SELECT user_id, max(CASE WHEN rank = 1 THEN event_type END) AS top_type, min(CASE WHEN event_type IN ('purchase', 'signup') THEN rank END) AS first_good FROM r GROUP BY user_id)
SELECT top_type, count(*) AS states, round(avg(CASE WHEN first_good = 1 THEN 1.0 ELSE 0 END), 6) AS hit_at_1, round(avg(coalesce(1.0 / first_good, 0)), 6) AS mrr FROM s GROUP BY top_type
""")
def policy_hit_mrr(spark, d):
    """Steps ranked by value; purchase and signup are acceptable. Hit at 1 and mean reciprocal rank by the top type."""
    w = Window.partitionBy("user_id").orderBy(F.col("value").desc(), "ts", "event_id")
    r = table(spark, d, "events").withColumn("rank", F.row_number().over(w))
    good = F.col("event_type").isin("purchase", "signup")
    s = r.groupBy("user_id").agg(F.max(F.when(F.col("rank") == 1, F.col("event_type"))).alias("top_type"), F.min(F.when(good, F.col("rank"))).alias("first_good"))
    return s.groupBy("top_type").agg(
        F.count("*").alias("states"), F.round(F.avg(F.when(F.col("first_good") == 1, 1.0).otherwise(0.0)), 6).alias("hit_at_1"), F.round(F.avg(F.coalesce(1.0 / F.col("first_good"), F.lit(0.0))), 6).alias("mrr"))


@query("""
WITH x AS (SELECT user_id, event_type, ts, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS delta FROM events)
SELECT before, event_type, count(*) AS pairs, round(avg(delta), 4) AS mean_delta, round(avg(CASE WHEN delta >= 0 THEN 1.0 ELSE 0 END), 6) AS non_decrease FROM x WHERE before IS NOT NULL GROUP BY ALL
""")
def paired_transitions(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = table(spark, d, "events").select("event_type", F.lag("event_type").over(w).alias("before"), (F.col("value") - F.lag("value").over(w)).alias("delta")).where("before is not null")
    return x.groupBy("before", "event_type").agg(F.count("*").alias("pairs"), F.round(F.avg("delta"), 4).alias("mean_delta"), F.round(F.avg((F.col("delta") >= 0).cast("double")), 6).alias("non_decrease"))


@query("SELECT event_type, count(*) AS cases, round(avg(CASE WHEN k = 1 THEN 1.0 ELSE 0 END), 6) AS agreement FROM (SELECT event_type, user_id % 100 AS u, count(DISTINCT value > 50) AS k FROM events GROUP BY ALL) GROUP BY event_type")
def judge_agreement(spark, d):
    """Share of cases whose repeated verdicts are one."""
    c = table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 100).alias("u")).agg(F.countDistinct(F.col("value") > 50).alias("k"))
    return c.groupBy("event_type").agg(F.count("*").alias("cases"), F.round(F.avg((F.col("k") == 1).cast("double")), 6).alias("agreement"))


@query("SELECT source, lang, count(*) AS n, count(CASE WHEN coalesce(trim(text), '') = '' THEN 1 END) AS empty, count(CASE WHEN n_chars <> length(text) THEN 1 END) AS wrong_length, GROUPING(source) + GROUPING(lang) AS level FROM documents GROUP BY ROLLUP (source, lang)")
def document_counters(spark, d):
    """Counters by source and language with subtotals."""
    n = lambda c: F.count(F.when(F.expr(c), 1))
    x = table(spark, d, "documents").select("source", "lang", "n_chars", F.length("text").alias("chars"), (F.coalesce(F.trim("text"), F.lit("")) == "").alias("blank"))
    return x.rollup("source", "lang").agg(
        F.count("*").alias("n"), n("blank").alias("empty"), n("n_chars <> chars").alias("wrong_length"), (F.grouping("source").cast("long") + F.grouping("lang").cast("long")).alias("level"))
