"""Queries that evaluate whole runs. Orders are tasks, their lines packages or steps, parts evidence, suppliers files."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.operators import assembly as A
from corvane.operators import metrics as M
from corvane.plans.registry import query
from corvane.plans.views import UNITS_SQL, units
from corvane.sources.tables import table

_PACK = """
l AS (SELECT l_orderkey AS task, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber) AS pos, l_partkey AS e, l_suppkey AS path FROM lineitem),
ge AS (SELECT DISTINCT task, e FROM l JOIN part ON p_partkey = e WHERE p_size <= 25), gf AS (SELECT DISTINCT task, path FROM l JOIN supplier ON s_suppkey = path WHERE s_acctbal > 0)
"""


def _package(spark, d):
    order = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_partkey", "l_suppkey", "l_linenumber")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("task"), F.row_number().over(order).alias("pos"), F.col("l_partkey").alias("evidence"), F.col("l_suppkey").alias("path"))


def _gold(spark, d, package):
    small = table(spark, d, "part").where("p_size <= 25").select(F.col("p_partkey").alias("evidence"))
    rich = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("path"))
    return package.join(small, "evidence", "left_semi").select("task", "evidence").distinct(), package.join(rich, "path", "left_semi").select("task", "path").distinct()


def _first(item):
    return f"(SELECT task, {item}, row_number() OVER (PARTITION BY task ORDER BY min(pos), {item}) AS r FROM l GROUP BY task, {item})"


_LOCAL = f"""
{_PACK}, ee AS (SELECT g.task, round(count(r) / count(*), 6) AS evidence_recall, round(coalesce(1.0 / min(r), 0), 6) AS evidence_mrr FROM ge g LEFT JOIN {_first('e')} x ON x.task = g.task AND x.e = g.e GROUP BY g.task),
ff AS (SELECT g.task, round(count(r) / count(*), 6) AS file_recall, round(coalesce(1.0 / min(r), 0), 6) AS file_mrr FROM gf g LEFT JOIN {_first('path')} x ON x.task = g.task AND x.path = g.path GROUP BY g.task),
lo AS (SELECT task, coalesce(evidence_recall, 0) AS evidence_recall, coalesce(evidence_mrr, 0) AS evidence_mrr, coalesce(file_recall, 0) AS file_recall, coalesce(file_mrr, 0) AS file_mrr FROM (SELECT DISTINCT task FROM l) LEFT JOIN ee USING (task) LEFT JOIN ff USING (task))
"""


@query(f"WITH {_LOCAL.replace('FROM l GROUP BY task, e)', 'FROM l WHERE pos <= 3 GROUP BY task, e)').replace('FROM l GROUP BY task, path)', 'FROM l WHERE pos <= 3 GROUP BY task, path)')} SELECT * FROM lo")
def localization(spark, d):
    """Recall and reciprocal rank of evidence and files of the first three units of each package."""
    p = _package(spark, d)
    return A.localization(p, *_gold(spark, d, p), ["task"], 3)


@query(f"""
WITH {UNITS_SQL}, p AS (SELECT repo, path, start_line, end_line FROM units WHERE unit_type IN ('function', 'method')), g AS (SELECT repo, path, start_line, end_line FROM units WHERE unit_type NOT IN ('function', 'method', 'file') AND start_line <= end_line)
SELECT repo, count(*) AS spans, round(avg(CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.repo = g.repo AND p.path = g.path AND p.start_line <= g.end_line AND g.start_line <= p.end_line) THEN 1.0 ELSE 0 END), 6) AS recall FROM g GROUP BY repo
""")
def span_recall(spark, d):
    """The share of a repository's other spans that a function or method of the same path meets."""
    u = units(spark, d, "repo", "path", "start_line", "end_line", "unit_type")
    return A.span_recall(u.where("unit_type in ('function', 'method')"), u.where("unit_type not in ('function', 'method', 'file') and start_line <= end_line"), ["repo"])


@query(f"""
WITH {_PACK}, x AS (SELECT task, e, row_number() OVER (PARTITION BY task ORDER BY e) AS r FROM (SELECT DISTINCT task, e FROM l)), b AS (SELECT DISTINCT task, e FROM {_first('e')} WHERE r <= 2),
n AS (SELECT DISTINCT x.task, x.e FROM x SEMI JOIN ge USING (task, e) ANTI JOIN b USING (task, e) WHERE r <= 2) SELECT ge.task, round(count(n.e) / count(*), 6) AS increment FROM ge LEFT JOIN n ON n.task = ge.task AND n.e = ge.e GROUP BY ge.task
""")
def structure_increment(spark, d):
    """What the first two parts by key find beyond the first two by arrival."""
    p = _package(spark, d)
    base = A.first_seen(p, ["task"], "evidence", "pos")
    other = p.select("task", "evidence").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("task").orderBy("evidence")))
    return A.structure_increment(base, other, _gold(spark, d, p)[0], "task", "evidence", 2)


_REPLAY = f"""
{_PACK}, w AS (SELECT DISTINCT l_orderkey AS task, l_returnflag AS o, l_linestatus AS g, l_partkey AS e FROM lineitem WHERE l_returnflag <> 'N'), fs AS (SELECT task, e, min(pos) AS pos FROM l GROUP BY ALL),
s AS (SELECT l.task, l.pos AS step, o, g, bool_and(fs.pos <= l.pos) AS met FROM l JOIN w USING (task) JOIN fs ON fs.task = w.task AND fs.e = w.e GROUP BY ALL),
t AS (SELECT task, step, bool_and(met) AS suff FROM (SELECT task, step, o, bool_or(met) AS met FROM s GROUP BY ALL) GROUP BY ALL), rp AS (SELECT l.task, l.pos AS step, coalesce(suff, false) AS sufficient_after FROM l LEFT JOIN t ON t.task = l.task AND t.step = l.pos)
"""


def _replay(spark, d):
    p = _package(spark, d)
    li = table(spark, d, "lineitem")
    w = li.select(F.col("l_orderkey").alias("task"), F.col("l_returnflag").alias("obligation"), (F.col("l_returnflag") != "N").alias("mandatory"), F.col("l_linestatus").alias("grp"), F.col("l_partkey").alias("evidence"))
    steps = p.withColumnRenamed("pos", "step")
    return A.sufficiency_replay(steps, w, steps, ["task"])


@query(f"WITH {_REPLAY} SELECT * FROM rp")
def sufficiency_replay(spark, d):
    return _replay(spark, d)


@query(f"""
WITH {_REPLAY}, f AS (SELECT task, count(*)::DOUBLE AS steps, min(CASE WHEN sufficient_after THEN step END) AS hit FROM rp GROUP BY task), m AS (SELECT o_orderpriority AS split, f.* FROM f JOIN orders ON o_orderkey = task)
SELECT split, count(*) AS trajectories, round(avg(CASE WHEN hit IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS success_rate, round(avg(CASE WHEN hit IS NULL THEN 1.0 ELSE 0 END), 6) AS premature_stop_rate, 0.0::DOUBLE AS never_stop_rate, round(avg(CASE WHEN steps >= 7 THEN 1.0 ELSE 0 END), 6) AS hard_stop_rate,
round(avg(steps), 6) AS mean_steps, round(median(steps), 6) AS median_steps, round(avg(coalesce(steps - hit, 0)), 6) AS late_steps FROM m GROUP BY split
""")
def trajectory_aggregate(spark, d):
    """Orders as trajectories that stop at their last line, by priority."""
    f = _replay(spark, d).groupBy("task").agg(F.count("*").alias("steps"), F.min(F.when(F.col("sufficient_after"), F.col("step"))).alias("at"))
    late = F.coalesce(F.col("steps") - F.col("at"), F.lit(0))
    x = f.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("task"), F.col("o_orderpriority").alias("split")), "task").select(
        "split", F.col("at").isNotNull().cast("int").alias("success"), F.col("at").isNull().cast("int").alias("premature_stop"), F.lit(0).alias("never_stop"), (F.col("steps") >= 7).cast("int").alias("hard_stop"), "steps",
        F.col("steps").alias("evidence"), F.col("steps").alias("tokens"), F.lit(1).alias("tool_calls"), late.alias("late_steps"), late.alias("late_evidence"), late.alias("late_tokens"))
    return A.trajectory_summary(x, ["split"]).select("split", "trajectories", "success_rate", "premature_stop_rate", "never_stop_rate", "hard_stop_rate", "mean_steps", "median_steps", "late_steps")


_TASKS = f"""
{_LOCAL}, w AS (SELECT DISTINCT l_orderkey AS task, l_returnflag AS o, l_linestatus AS g, l_partkey AS e FROM lineitem WHERE l_returnflag <> 'N'),
c AS (SELECT task, count(*) AS tokens FROM l GROUP BY task), mt AS (SELECT lo.*, tokens FROM lo JOIN c USING (task)), ord AS (SELECT o_orderkey AS task, o_orderstatus AS run, o_orderpriority AS split, (o_custkey % 20) AS unit FROM orders),
tm AS (SELECT run, split, unit AS task, avg(evidence_recall) AS evidence_recall, avg(file_mrr) AS file_mrr, avg(tokens) AS tokens FROM mt JOIN ord USING (task) GROUP BY ALL)
"""


def _task_metrics(spark, d):
    p = _package(spark, d)
    local = A.localization(p, *_gold(spark, d, p), ["task"])
    cost = p.groupBy("task").agg(F.count("*").alias("tokens"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("task"), F.col("o_orderstatus").alias("run"), F.col("o_orderpriority").alias("split"), (F.col("o_custkey") % 20).alias("unit"))
    return A.task_metrics(o, local, cost, by=["task"]).where("tokens is not null")


def _run_tasks(spark, d):
    return _task_metrics(spark, d).groupBy("run", "split", F.col("unit").alias("task")).agg(F.avg("evidence_recall").alias("evidence_recall"), F.avg("file_mrr").alias("file_mrr"), F.avg("tokens").alias("tokens"))


@query(f"WITH {_TASKS} SELECT task, run, split, unit, evidence_recall, evidence_mrr, file_recall, file_mrr, tokens FROM mt JOIN ord USING (task)")
def task_metrics(spark, d):
    """All families of metrics of each order, in one wide row."""
    return _task_metrics(spark, d)


@query(f"""
WITH {_TASKS}, n AS (SELECT split, count(DISTINCT run) AS n FROM tm GROUP BY 1), k AS (SELECT split, task FROM (SELECT split, task, count(DISTINCT run) AS runs FROM tm GROUP BY ALL) JOIN n USING (split) WHERE runs = n), r AS (SELECT * FROM tm SEMI JOIN k USING (split, task))
SELECT run, split, 'evidence_recall' AS metric, count(*) AS tasks, round(avg(evidence_recall), 6) AS mean FROM r GROUP BY ALL UNION ALL SELECT run, split, 'file_mrr', count(*), round(avg(file_mrr), 6) FROM r GROUP BY ALL
""")
def run_summary(spark, d):
    """Means of runs (order states) over the tasks (customers' residues) that all runs of a split (priority) share."""
    return A.run_summary(_run_tasks(spark, d), ["run", "split"], ["evidence_recall", "file_mrr"])


@query(f"""
WITH {_TASKS}, p AS (SELECT run, split, avg(tokens) AS x, avg(evidence_recall) AS y FROM tm GROUP BY run, split, task % 5), a AS (SELECT *, (lead(x) OVER w - x) * (lead(y) OVER w + y) / 2 AS area FROM p WINDOW w AS (PARTITION BY run, split ORDER BY x, y))
SELECT run, split, count(*) AS points, round(CASE WHEN max(x) - min(x) > 0 THEN sum(area) / (max(x) - min(x)) ELSE arg_min(y, (x, y)) END, 6) AS auc FROM a GROUP BY run, split
""")
def cost_curves(spark, d):
    """Area under recall over cost of each run and split, over five points."""
    return A.cost_curves(_run_tasks(spark, d).withColumn("point", F.col("task") % 5), ["run", "split"], "tokens", "evidence_recall", "point")


@query("SELECT event_type, ts::DATE AS day, count(*) AS n, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY ALL")
def nearest_rank(spark, d):
    """The ceil(0.95 n)-th smallest value of each type and day."""
    e = table(spark, d, "events").select("event_type", F.to_date("ts").alias("day"), "value")
    return M.nearest_rank(e, ["event_type", "day"], "value").withColumnRenamed("value", "p95")
