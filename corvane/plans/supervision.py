"""Queries on judgments, votes, gains, quotas and table differences."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.operators import judgments as J
from corvane.operators import selection as S
from corvane.plans.registry import query
from corvane.plans.views import TASKS_SQL, UNITS_SQL, units
from corvane.sources.tables import table

_J = """j AS (SELECT event_type, CASE WHEN value > 60 THEN 'sufficient' WHEN value > 30 THEN 'partial' ELSE 'insufficient' END AS verdict, CASE event_id % 4 WHEN 0 THEN 'correct' WHEN 1 THEN 'partial' WHEN 2 THEN 'incorrect' ELSE 'uncertain' END AS causal,
CASE event_id % 3 WHEN 0 THEN 'relevant' WHEN 1 THEN 'partial' ELSE 'irrelevant' END AS execution, (event_id % 10) / 10.0 AS confidence, event_id % 5 AS evidence_count, least(event_id % 3, event_id % 5) AS useful, least(event_id % 2, event_id % 5) AS redundant, event_id % 7 AS misleading FROM events)"""
_POINTS = {"verdict": J.VERDICT, "causal": J.CAUSAL, "execution": J.EXECUTION}
_CASE = {k: f"CASE {k} " + " ".join(f"WHEN '{n}' THEN {v}" for n, v in t.items()) + " END" for k, t in _POINTS.items()}


@query(f"""
WITH {_J} SELECT event_type, count(*) AS judgments, round(avg(CASE WHEN verdict = 'sufficient' THEN 1.0 ELSE 0 END), 6) AS sufficiency_rate, round(avg(({_CASE['verdict']})::DOUBLE), 6) AS partial_credit, round(avg(({_CASE['causal']})::DOUBLE), 6) AS causal_score,
round(avg(({_CASE['execution']})::DOUBLE), 6) AS execution_score, round(avg(CASE WHEN evidence_count > 0 THEN useful / evidence_count ELSE 0 END), 6) AS precision, round(avg(CASE WHEN evidence_count > 0 THEN redundant / evidence_count ELSE 0 END), 6) AS redundancy_rate,
round(avg(CASE WHEN misleading > 0 THEN 1.0 ELSE 0 END), 6) AS misleading_rate, round(avg(confidence::DOUBLE), 6) AS mean_confidence FROM j GROUP BY event_type
""")
def semantic_means(spark, d):
    pick = lambda n, *names: F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % n + 1).cast("int"))
    e = F.col("event_id")
    j = table(spark, d, "events").select(
        "event_type", F.when(F.col("value") > 60, "sufficient").when(F.col("value") > 30, "partial").otherwise("insufficient").alias("verdict"), pick(4, "correct", "partial", "incorrect", "uncertain").alias("causal"),
        pick(3, "relevant", "partial", "irrelevant").alias("execution"), ((e % 10) / 10.0).alias("confidence"), (e % 5).alias("evidence_count"), F.least(e % 3, e % 5).alias("useful"), F.least(e % 2, e % 5).alias("redundant"), (e % 7).alias("misleading"))
    return J.semantic_means(j, ["event_type"])


@query("""
WITH v AS (SELECT DISTINCT user_id % 30 AS slot, event_type AS status, (user_id // 30) % 3 AS voter, CASE WHEN event_id % 2 = 0 THEN event_id % 4 END AS grp FROM events),
w AS (SELECT slot, status, count(DISTINCT voter) AS n FROM v GROUP BY ALL), b AS (SELECT slot, status FROM w WHERE n >= 2 QUALIFY row_number() OVER (PARTITION BY slot ORDER BY n DESC, status DESC) = 1),
g AS (SELECT slot, grp FROM v SEMI JOIN b USING (slot, status) WHERE grp IS NOT NULL GROUP BY ALL HAVING count(DISTINCT voter) >= 2)
SELECT slot, status, coalesce(grp, -1) AS grp FROM b LEFT JOIN g USING (slot)
""")
def group_consensus(spark, d):
    return _consensus(table(spark, d, "events"))


def _consensus(events):
    v = events.selectExpr("user_id % 30 as slot", "event_type as status", "(user_id div 30) % 3 as voter", "case when event_id % 2 = 0 then event_id % 4 end as grp").distinct()
    return J.group_consensus(v, ["slot"], "status", "voter", "grp").withColumn("grp", F.coalesce("grp", F.lit(-1)))


@query("""
WITH p AS (SELECT event_type, value, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS later FROM events)
SELECT event_type, count(*) AS cases, round(avg(CASE WHEN later < value THEN 1.0 ELSE 0 END), 6) AS drop_rate, round(avg(CASE WHEN later <= value THEN 1.0 ELSE 0 END), 6) AS no_gain_rate FROM p WHERE later IS NOT NULL GROUP BY event_type
""")
def calibration_rates(spark, d):
    later = F.lead("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return J.calibration(table(spark, d, "events").select("event_type", "value", later.alias("later")).where("later is not null"), "event_type", "value", "later")


@query(f"""
WITH {TASKS_SQL}, r AS (SELECT task_id, 'BLANK' AS code, 4 AS points FROM tasks WHERE coalesce(trim(problem_statement), '') = '' UNION ALL SELECT task_id, 'NO_HINTS', 1 FROM tasks WHERE len(coalesce(hints, [])) = 0
UNION ALL SELECT task_id, 'NO_LANGUAGE', 1 FROM tasks WHERE language IS NULL UNION ALL SELECT task_id, 'SHORT', 2 FROM tasks WHERE length(problem_statement) < 200 UNION ALL SELECT task_id, 'UNDATED', 2 FROM tasks WHERE created_at IS NULL)
SELECT task_id, sum(points)::BIGINT AS points, array_to_string(list_sort(list(code)), ',') AS codes FROM r GROUP BY task_id
""")
def risk_flags(spark, d):
    from corvane.plans.views import tasks

    t = tasks(spark, d, "problem_statement", "hints", "language", "created_at")
    rules = [
        ("BLANK", 4, t.where("coalesce(trim(problem_statement), '') = ''")), ("NO_HINTS", 1, t.where("coalesce(size(hints), 0) <= 0")), ("NO_LANGUAGE", 1, t.where("language is null")),
        ("SHORT", 2, t.where("length(problem_statement) < 200")), ("UNDATED", 2, t.where("created_at is null"))]
    return J.weighted_flags(rules, "task_id").withColumn("codes", F.array_join("codes", ","))


@query("""
WITH b AS (SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders), n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 11 <> 0)
SELECT o_orderkey, 'missing' AS problem, NULL AS "column" FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM n)
UNION ALL SELECT b.o_orderkey, 'changed', 'o_orderstatus' FROM b JOIN n USING (o_orderkey) WHERE b.o_orderstatus IS DISTINCT FROM n.o_orderstatus
UNION ALL SELECT b.o_orderkey, 'changed', 'o_orderpriority' FROM b JOIN n USING (o_orderkey) WHERE b.o_orderpriority IS DISTINCT FROM n.o_orderpriority
""")
def row_differences(spark, d):
    b = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    n = b.where("o_orderkey % 11 <> 0").selectExpr("o_orderkey", "case when o_orderkey % 7 = 0 then 'X' else o_orderstatus end as o_orderstatus", "case when o_orderkey % 5 = 0 then null else o_orderpriority end as o_orderpriority")
    return J.row_differences(b, n, "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@query("""
WITH w AS (SELECT DISTINCT l_orderkey AS task, l_returnflag AS o, l_linestatus AS g, l_partkey AS e FROM lineitem), k AS (SELECT p_partkey AS e FROM part WHERE p_size <= 25), x AS (SELECT w.*, k.e AS h FROM w LEFT JOIN k ON w.e = k.e),
n AS (SELECT task, o, g, count(*) AS n, count(h) AS k FROM x GROUP BY ALL), b AS (SELECT task, o, max(k / n) AS best FROM n GROUP BY ALL), t AS (SELECT task, count(*) AS total FROM b GROUP BY task),
a AS (SELECT task, x.e, o, best, max((k + 1) / n) AS after FROM x JOIN n USING (task, o, g) JOIN b USING (task, o) WHERE h IS NULL GROUP BY ALL)
SELECT task, e AS evidence, round(sum(CASE WHEN after >= 1 - 1e-9 AND best < 1 - 1e-9 THEN 1 ELSE 0 END) / any_value(total), 6) AS gain, round(sum(greatest(after - best, 0)) / any_value(total), 6) AS progress FROM a JOIN t USING (task) GROUP BY ALL
""")
def addition_gains(spark, d):
    from corvane.plans.coverage import _witness

    k = table(spark, d, "part").where("p_size <= 25").select(F.col("p_partkey").alias("evidence"))
    return S.gains(_witness(spark, d), k, "task", "obligation", "grp", "evidence")


@query()
def interaction_rates(spark, d):
    from corvane.plans.coverage import _witness

    o = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("task"), F.col("l_partkey").alias("evidence")).agg(F.min("l_shipdate").alias("pos"))
    return S.interactions(o, _witness(spark, d), "task", "obligation", "grp", "evidence", "pos")


@query()
def quota_selection(spark, d):
    u = units(spark, d, "repo", "path", "unit_type", "start_line", "end_line", "scoreable").where("scoreable")
    return S.quota_select(u, "repo", "evidence_id", "path", "unit_type", "start_line", "end_line", [F.col("end_line") - F.col("start_line")], quotas={"code_block": 4, "doc_section": 2})


@query(f"""
WITH {UNITS_SQL}, u AS (SELECT file_version_id, evidence_id, start_line, end_line, unit_type FROM units WHERE unit_type IN ('function', 'class')),
p AS (SELECT a.evidence_id AS anchor, u.evidence_id, greatest(u.start_line - a.end_line, a.start_line - u.end_line, 0) AS distance FROM u a JOIN u USING (file_version_id) WHERE a.unit_type = 'class' AND a.evidence_id <> u.evidence_id)
SELECT anchor, evidence_id, distance, row_number() OVER (PARTITION BY anchor ORDER BY distance, evidence_id) AS rank FROM p QUALIFY rank <= 2
""")
def nearest_units(spark, d):
    u = units(spark, d, "file_version_id", "start_line", "end_line", "unit_type").where("unit_type in ('function', 'class')")
    return S.nearest_units(u.where("unit_type = 'class'"), u, "file_version_id", "evidence_id", "start_line", "end_line")


@query("SELECT c_custkey, c_name, coalesce(n > 20, false) AS excluded, CASE WHEN n > 20 THEN 'too_many_orders' END AS reason, coalesce(n, 0) AS orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def exclusion_marking(spark, d):
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    many = F.col("n") > 20
    return table(spark, d, "customer").select("c_custkey", "c_name").join(n, "c_custkey", "left").select(
        "c_custkey", "c_name", F.coalesce(many, F.lit(False)).alias("excluded"), F.when(many, "too_many_orders").alias("reason"), F.coalesce("n", F.lit(0)).alias("orders"))


@query("""
WITH q AS (SELECT DISTINCT task_id FROM normalize_swebench_task WHERE split <> 'train'), r AS (SELECT task_id, count(*) AS n FROM documents WHERE task_id IS NOT NULL AND source = 'judge_rationale' GROUP BY 1)
SELECT CASE WHEN q.task_id IS NULL THEN 'orphan' WHEN r.task_id IS NULL THEN 'missing' WHEN n > 1 THEN 'repeated' ELSE 'done' END AS state, count(*) AS n FROM q FULL JOIN r ON q.task_id = r.task_id GROUP BY 1
""")
def result_states(spark, d):
    """Questions against results: done, repeated, missing or orphaned."""
    q = table(spark, d, "normalize_swebench_task").where("split <> 'train'").select("task_id").distinct().withColumn("q", F.lit(1))
    r = table(spark, d, "documents").where("task_id is not null and source = 'judge_rationale'").groupBy("task_id").agg(F.count("*").alias("n"))
    state = F.when(F.col("q").isNull(), "orphan").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated").otherwise("done")
    return q.join(r, "task_id", "full").groupBy(state.alias("state")).agg(F.count("*").alias("n"))
