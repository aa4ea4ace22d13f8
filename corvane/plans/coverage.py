"""Coverage queries: an order is a task, its return flags and line states are obligations and groups, parts are evidence."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.operators import coverage as C
from corvane.operators import folds
from corvane.plans.registry import query
from corvane.sources.tables import table

_W = "w AS (SELECT DISTINCT l_orderkey AS task, l_returnflag AS obligation, l_linestatus AS grp, l_partkey AS evidence FROM lineitem), k AS (SELECT p_partkey AS evidence FROM part WHERE p_size <= 25)"
_G = f"{_W}, g AS (SELECT task, obligation, grp, count(*) AS size, count(k.evidence) AS held FROM w LEFT JOIN k USING (evidence) GROUP BY ALL)"
_O = f"{_G}, o AS (SELECT task, obligation, count(*) AS groups, bool_or(held = size) AS covered, round(max(held / size), 6) AS progress FROM g GROUP BY ALL)"


def _witness(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("task"), F.col("l_returnflag").alias("obligation"), F.col("l_linestatus").alias("grp"), F.col("l_partkey").alias("evidence")).distinct()


def _groups(spark, d):
    k = table(spark, d, "part").where("p_size <= 25").select(F.col("p_partkey").alias("evidence"))
    return C.group_coverage(_witness(spark, d), k, "task", "obligation", "grp", "evidence")


@query(f"WITH {_G} SELECT task, obligation, grp, size, held, held = size AS covered FROM g")
def witness_group_coverage(spark, d):
    return _groups(spark, d)


@query(f"WITH {_O} SELECT task, obligation, groups, covered, progress FROM o")
def sufficiency_division(spark, d):
    return C.obligation_coverage(_groups(spark, d), "task", "obligation")


@query(f"""
WITH {_O}, m AS (SELECT task, obligation, covered, progress, obligation <> 'N' AS mandatory FROM o)
SELECT task, round(sum(CASE WHEN mandatory AND covered THEN 1 ELSE 0 END) / nullif(sum(mandatory::INT), 0), 6) AS completion, round(avg(progress), 6) AS progress,
coalesce(sum(CASE WHEN mandatory AND covered THEN 1 ELSE 0 END) / nullif(sum(mandatory::INT), 0) >= 1 - 1e-6, false) AS sufficient FROM m GROUP BY task
""")
def completion_progress(spark, d):
    o = _witness(spark, d).select("task", "obligation").distinct().withColumn("mandatory", F.col("obligation") != "N")
    return C.completion(o, C.obligation_coverage(_groups(spark, d), "task", "obligation"), "task", "obligation", "mandatory")


@query(f"WITH {_O} SELECT task, array_to_string(list_sort(list(obligation)), ',') AS missing FROM o WHERE NOT covered AND obligation <> 'N' GROUP BY task")
def missing_mandatory(spark, d):
    o = C.obligation_coverage(_groups(spark, d), "task", "obligation").where("not covered and obligation <> 'N'")
    return o.groupBy("task").agg(F.array_join(F.array_sort(F.collect_list("obligation")), ",").alias("missing"))


@query("""
WITH w AS (SELECT DISTINCT l_suppkey % 50 AS obligation, l_orderkey AS grp, l_partkey % 7 AS evidence FROM lineitem),
n AS (SELECT obligation, grp, count(*) AS n FROM w GROUP BY ALL), s AS (SELECT a.obligation, a.grp AS g, b.grp AS h, count(*) AS s FROM w a JOIN w b ON a.obligation = b.obligation AND a.evidence = b.evidence AND a.grp <> b.grp GROUP BY ALL),
f AS (SELECT s.obligation, s.g, bool_or(s = y.n AND y.n < x.n) AS contains, bool_or(s = y.n AND y.n = x.n AND h < s.g) AS same FROM s JOIN n x ON x.obligation = s.obligation AND x.grp = s.g JOIN n y ON y.obligation = s.obligation AND y.grp = s.h GROUP BY ALL)
SELECT n.obligation, n.grp, NOT coalesce(contains, false) AS minimal, coalesce(same, false) AS duplicate FROM n LEFT JOIN f ON n.obligation = f.obligation AND n.grp = f.g
""")
def minimal_groups(spark, d):
    w = table(spark, d, "lineitem").selectExpr("l_suppkey % 50 as obligation", "l_orderkey as grp", "l_partkey % 7 as evidence").distinct()
    return C.minimal_groups(w, "obligation", "grp", "evidence")


@query("""
WITH o AS (SELECT l_orderkey AS task, l_partkey AS evidence, min(l_shipdate) AS seen FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY seen, evidence) AS step FROM o)
SELECT task, step, evidence, count(CASE WHEN p_size <= 25 THEN 1 END) OVER (PARTITION BY task ORDER BY step ROWS UNBOUNDED PRECEDING) AS held,
p_size > 25 OR coalesce(max(CASE WHEN p_size <= 25 THEN 1 ELSE 0 END) OVER (PARTITION BY task ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS redundant FROM r JOIN part ON p_partkey = evidence
""")
def interaction_redundancy(spark, d):
    """Evidence in the order of its arrival; it is redundant if it doesn't count or something that counts came before."""
    o = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("task"), F.col("l_partkey").alias("evidence")).agg(F.min("l_shipdate").alias("at"))
    w = Window.partitionBy("task").orderBy("at", "evidence")
    counts = (F.col("p_size") <= 25).cast("int")
    x = o.join(table(spark, d, "part").select(F.col("p_partkey").alias("evidence"), "p_size"), "evidence")
    before = F.coalesce(F.max(counts).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    return x.select("task", F.row_number().over(w).alias("step"), "evidence", F.sum(counts).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("held"), ((F.col("p_size") > 25) | before).alias("redundant"))


@query("""
WITH x AS (SELECT p_brand AS task, p_partkey AS id, p_retailprice AS price, p_size AS size FROM part)
SELECT task, id FROM x a WHERE NOT EXISTS (SELECT 1 FROM x b WHERE b.task = a.task AND b.price <= a.price AND b.size >= a.size AND (b.price < a.price OR b.size > a.size))
""")
def pareto_front(spark, d):
    """Parts of a brand that no other beats in price and size: a running maximum over the price order, no self-join."""
    x = table(spark, d, "part").select(F.col("p_brand").alias("task"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"))
    cheaper = Window.partitionBy("task").orderBy("price").rangeBetween(Window.unboundedPreceding, 0)
    below = F.max(F.struct("size", (-F.col("price")).alias("p"))).over(cheaper)
    return x.withColumn("best", below).where("best.size = size and -best.p = price").select("task", "id")


@query("""
WITH RECURSIVE l AS (SELECT l_orderkey, l_partkey || '-' || l_suppkey || '-' || l_linenumber AS id, l_quantity::BIGINT AS t, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey || '-' || l_suppkey || '-' || l_linenumber) AS k FROM lineitem),
w AS (SELECT DISTINCT l_orderkey, 0::BIGINT AS k, []::VARCHAR[] AS ids, 0::BIGINT AS used FROM l
UNION ALL SELECT w.l_orderkey, l.k, CASE WHEN len(ids) < 4 AND used + t <= 100 THEN list_append(ids, id) ELSE ids END, CASE WHEN len(ids) < 4 AND used + t <= 100 THEN used + t ELSE used END FROM w JOIN l ON l.l_orderkey = w.l_orderkey AND l.k = w.k + 1)
SELECT l_orderkey, array_to_string(ids, ',') AS kept FROM w QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY k DESC) = 1
""")
def budget_greedy(spark, d):
    """Lines of an order in ship order under a budget of 100 units of quantity and 4 lines."""
    item = F.struct("l_shipdate", F.concat_ws("-", "l_partkey", "l_suppkey", "l_linenumber").alias("id"), F.col("l_quantity").cast("long").alias("tokens"))
    o = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return o.select("l_orderkey", F.array_join(folds.greedy_budget(F.col("items"), 100, 4), ",").alias("kept"))


def _costed(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("task"), F.col("l_returnflag").alias("obligation"), F.col("l_linestatus").alias("grp"), F.col("l_partkey").alias("evidence")).agg(F.min("l_quantity").cast("long").alias("cost"))


_CERT = """
c AS (SELECT l_orderkey AS task, l_returnflag AS o, l_linestatus AS g, l_partkey::VARCHAR AS e, min(l_quantity)::BIGINT AS cost FROM lineitem GROUP BY ALL), pr AS (SELECT task, e, min(cost) AS cost FROM c GROUP BY ALL),
s AS (SELECT task, o, g, list_sort(list(DISTINCT e)) AS ids FROM c GROUP BY ALL), t AS (SELECT DISTINCT task FROM c),
x AS (SELECT t.task, list_sort(list_distinct(list_concat(list_concat(coalesce(a.ids, []), coalesce(n.ids, [])), coalesce(r.ids, [])))) AS ids, [a.g, n.g, r.g] AS gs
FROM t LEFT JOIN (SELECT * FROM s WHERE o = 'A') a USING (task) LEFT JOIN (SELECT * FROM s WHERE o = 'N' AND {0}) n USING (task) LEFT JOIN (SELECT * FROM s WHERE o = 'R') r USING (task)),
y AS (SELECT x.task, ids, gs, sum(cost) AS cost FROM x JOIN pr ON pr.task = x.task AND list_contains(ids, e) GROUP BY ALL),
best AS (SELECT task, ids, cost FROM y QUALIFY row_number() OVER (PARTITION BY task ORDER BY cost, len(ids), ids, gs) = 1)
"""


@query(f"WITH {_CERT.format('true')} SELECT task, array_to_string(ids, ',') AS certificate, cost::BIGINT AS cost FROM best")
def min_certificate(spark, d):
    return folds.certificates(_costed(spark, d), "task", "obligation", "grp", "evidence", "cost").withColumn("certificate", F.array_join("certificate", ","))


@query()
def acquisition_order(spark, d):
    """The way to each order's certificate; what was neither returned nor accepted is optional. No SQL: it is stepwise."""
    x = _costed(spark, d).withColumn("mandatory", F.col("obligation") != "N")
    return folds.acquisition_order(x, "task", "obligation", "grp", "evidence", "cost", "mandatory")


@query(f"""
WITH {_CERT.format('false')}, m AS (SELECT DISTINCT task FROM c WHERE o <> 'N') SELECT task, e AS evidence FROM (SELECT task, unnest(ids) AS e FROM best) SEMI JOIN m USING (task)
""")
def acquired_set(spark, d):
    """What acquisition_order acquires, as a set: the certificate of the mandatory obligations."""
    return acquisition_order(spark, d).select("task", "evidence")
