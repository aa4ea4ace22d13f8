"""Scans, filters, joins, set operations, deduplication, nesting and audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.operators.metrics import common_tasks, findings, latest
from corvane.plans.registry import query
from corvane.plans.views import TASKS_SQL, UNITS_SQL, tasks, units
from corvane.sources.tables import table


@query("SELECT evidence_id, repo, path, start_line, end_line FROM evidence WHERE scoreable AND unit_type = 'function'")
def scan_project_filter(spark, d):
    return table(spark, d, "evidence").where("scoreable and unit_type = 'function'").select("evidence_id", "repo", "path", "start_line", "end_line")


@query("SELECT split, count(*) AS n FROM normalize_swebench_task WHERE split = 'train' GROUP BY split")
def count_filtered(spark, d):
    return table(spark, d, "normalize_swebench_task").where("split = 'train'").groupBy("split").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)")
def point_lookup(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return o.join(F.broadcast(o.agg(F.min("o_orderkey").alias("o_orderkey"))), "o_orderkey", "left_semi")


@query("SELECT evidence_id, file_version_id, unit_type FROM evidence WHERE file_version_id IN (SELECT file_version_id FROM file_versions WHERE status = 'pending')")
def in_list_semi(spark, d):
    wanted = table(spark, d, "file_versions").where("status = 'pending'").select("file_version_id")
    return table(spark, d, "evidence").select("evidence_id", "file_version_id", "unit_type").join(wanted, "file_version_id", "left_semi")


@query("SELECT snapshot_id, m.path, m.file_version_id, f.status, f.line_count FROM (SELECT DISTINCT * FROM snapshot_membership) m JOIN file_versions f USING (file_version_id)")
def snapshot_files(spark, d):
    m = table(spark, d, "snapshot_membership").distinct()
    return m.join(table(spark, d, "file_versions").select("file_version_id", "status", "line_count"), "file_version_id").select("snapshot_id", "path", "file_version_id", "status", "line_count")


@query("SELECT file_version_id, array_to_string(list_sort(list_distinct(list(snapshot_id))), ',') AS snapshots, count(DISTINCT snapshot_id) AS n FROM snapshot_membership GROUP BY file_version_id")
def membership_collect(spark, d):
    m = table(spark, d, "snapshot_membership").groupBy("file_version_id").agg(F.array_sort(F.collect_set("snapshot_id")).alias("s"))
    return m.select("file_version_id", F.array_join("s", ",").alias("snapshots"), F.size("s").cast("long").alias("n"))


@query("SELECT count(*) AS n FROM (SELECT DISTINCT file_version_id FROM snapshot_membership) m WHERE NOT EXISTS (SELECT 1 FROM file_versions f WHERE f.file_version_id = m.file_version_id AND f.status = 'indexed')")
def anti_unindexed_members(spark, d):
    f = table(spark, d, "file_versions").where("status = 'indexed'").select("file_version_id")
    return table(spark, d, "snapshot_membership").select("file_version_id").distinct().join(f, "file_version_id", "left_anti").agg(F.count("*").alias("n"))


@query("SELECT snapshot_id, repo, status FROM snapshots s WHERE NOT EXISTS (SELECT 1 FROM snapshot_membership m WHERE m.snapshot_id = s.snapshot_id)")
def empty_snapshots(spark, d):
    m = table(spark, d, "snapshot_membership").select("snapshot_id")
    return table(spark, d, "snapshots").select("snapshot_id", "repo", "status").join(m, "snapshot_id", "left_anti")


@query("SELECT file_version_id, count(DISTINCT snapshot_id) AS n FROM snapshot_membership GROUP BY 1 HAVING count(DISTINCT snapshot_id) > 1")
def having_reused(spark, d):
    return table(spark, d, "snapshot_membership").groupBy("file_version_id").agg(F.countDistinct("snapshot_id").alias("n")).where("n > 1")


@query("SELECT count(*) AS rows, count(DISTINCT evidence_id) AS ids, count(*) - count(DISTINCT evidence_id) AS repeated FROM evidence")
def duplicate_detector(spark, d):
    return table(spark, d, "evidence").groupBy("evidence_id").agg(F.count("*").alias("n")).agg(F.sum("n").alias("rows"), F.count("*").alias("ids"), (F.sum("n") - F.count("*")).alias("repeated"))


@query(f"""
WITH {TASKS_SQL}
SELECT t.task_id, e.evidence_id FROM tasks t JOIN (SELECT DISTINCT * FROM snapshot_membership) m USING (snapshot_id) JOIN file_versions f ON f.file_version_id = m.file_version_id AND f.path = m.path
JOIN (SELECT DISTINCT evidence_id, file_version_id, scoreable, unit_type FROM evidence) e ON e.file_version_id = f.file_version_id WHERE e.scoreable AND e.unit_type = 'class' AND t.split <> 'train'
""")
def cross_snapshot_integrity(spark, d):
    """Units that a task's snapshot holds, over four keys."""
    t = tasks(spark, d, "snapshot_id", "split").where("split <> 'train'").select("task_id", "snapshot_id")
    f = table(spark, d, "file_versions").select("file_version_id", "path")
    e = table(spark, d, "evidence").where("scoreable and unit_type = 'class'").select("evidence_id", "file_version_id").distinct()
    return t.join(table(spark, d, "snapshot_membership").distinct(), "snapshot_id").join(f, ["file_version_id", "path"]).join(e, "file_version_id").select("task_id", "evidence_id")


@query("SELECT user_id, event_id, ts, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_record(spark, d):
    return latest(table(spark, d, "events").select("user_id", "event_id", "ts", "event_type"), ["user_id"], [F.col("ts"), F.col("event_id")])


@query("SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)")
def common_intersection(spark, d):
    return common_tasks(table(spark, d, "events"), "user_id", "event_type")


@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'click' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 50)")
def completed_anti(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "value")
    return e.where("event_type = 'click'").select("user_id").distinct().join(e.where("event_type = 'purchase' and value > 50").select("user_id"), "user_id", "left_anti")


@query("""
WITH a AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal > 0), b AS (SELECT DISTINCT o_custkey AS k FROM orders)
SELECT (SELECT count(*) FROM a) AS left_n, (SELECT count(*) FROM b) AS right_n, (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) AS both_n, (SELECT count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)) AS union_n
""")
def set_sizes(spark, d):
    """Sizes of two sets, their union and intersection, from one full outer join."""
    a = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")).distinct().withColumn("a", F.lit(1))
    b = table(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct().withColumn("b", F.lit(1))
    return a.join(b, "k", "full").agg(F.count("a").alias("left_n"), F.count("b").alias("right_n"), F.count(F.col("a") + F.col("b")).alias("both_n"), F.count("*").alias("union_n"))


@query("""
WITH base AS (SELECT c_custkey, c_name, c_acctbal FROM customer), new AS (SELECT o_custkey AS c_custkey, 'updated' AS c_name, round(max(o_totalprice), 2) AS c_acctbal FROM orders GROUP BY 1)
SELECT * FROM new UNION ALL SELECT * FROM base WHERE c_custkey NOT IN (SELECT c_custkey FROM new)
""")
def upsert(spark, d):
    base = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.lit("updated").alias("c_name"), F.round(F.max("o_totalprice"), 2).alias("c_acctbal"))
    return new.unionByName(base.join(new.select("c_custkey"), "c_custkey", "left_anti"))


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL")
def json_group_count(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query(f"""
WITH {UNITS_SQL}
SELECT coalesce(json_extract_string(metadata, '$.language'), 'unknown') AS language, coalesce(json_extract_string(metadata, '$.extraction.status'), 'unknown') AS status, count(*) AS n FROM units WHERE unit_type = 'file' GROUP BY ALL
""")
def metadata_counts(spark, d):
    u = units(spark, d, "unit_type", "metadata").where("unit_type = 'file'")
    field = lambda p: F.coalesce(F.get_json_object("metadata", p), F.lit("unknown"))
    return u.groupBy(field("$.language").alias("language"), field("$.extraction.status").alias("status")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, l_linenumber, l_partkey, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def nested_roundtrip(spark, d):
    """Lines collected into their order and taken apart again."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    o = table(spark, d, "orders").select("o_orderkey")
    nested = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return nested.select("o_orderkey", F.explode("lines").alias("x")).select("o_orderkey", "x.l_linenumber", "x.l_partkey", "x.l_quantity")


@query(f"""
WITH {UNITS_SQL}, {TASKS_SQL}
SELECT 'SHA_MISMATCH' AS code, 'error' AS severity, count(*) AS violations FROM units WHERE sha256(content) <> content_sha256
UNION ALL SELECT 'DANGLING_PARENT', 'error', count(*) FROM units u WHERE parent_evidence_id IS NOT NULL AND parent_evidence_id NOT IN (SELECT evidence_id FROM units)
UNION ALL SELECT 'STALE_TOKEN_COUNT', 'warning', count(*) FROM units WHERE token_count < 0 OR rendered_token_count < token_count
UNION ALL SELECT 'PENDING_FILE', 'warning', count(*) FROM file_versions WHERE status <> 'indexed'
UNION ALL SELECT 'TASK_WITHOUT_SNAPSHOT', 'error', count(*) FROM tasks WHERE snapshot_id NOT IN (SELECT snapshot_id FROM snapshots WHERE status = 'complete')
UNION ALL SELECT 'BAD_SPAN', 'error', count(*) FROM units WHERE start_line > end_line OR start_line < 1
UNION ALL SELECT 'EMPTY_STATEMENT', 'warning', count(*) FROM tasks WHERE coalesce(trim(problem_statement), '') = ''
""")
def audit_findings(spark, d):
    u = units(spark, d, "parent_evidence_id", "start_line", "end_line", "token_count", "rendered_token_count", F.sha2("content", 256).alias("sha"), "content_sha256")
    t = tasks(spark, d, "snapshot_id", "problem_statement")
    complete = table(spark, d, "snapshots").where("status = 'complete'").select("snapshot_id")
    parents = u.select(F.col("evidence_id").alias("parent_evidence_id"))
    return findings(
        ("SHA_MISMATCH", "error", u.where("sha <> content_sha256")), ("DANGLING_PARENT", "error", u.where("parent_evidence_id is not null").join(parents, "parent_evidence_id", "left_anti")),
        ("STALE_TOKEN_COUNT", "warning", u.where("token_count < 0 or rendered_token_count < token_count")), ("PENDING_FILE", "warning", table(spark, d, "file_versions").where("status <> 'indexed'")),
        ("TASK_WITHOUT_SNAPSHOT", "error", t.join(complete, "snapshot_id", "left_anti")), ("BAD_SPAN", "error", u.where("start_line > end_line or start_line < 1")),
        ("EMPTY_STATEMENT", "warning", t.where("coalesce(trim(problem_statement), '') = ''")))


@query("SELECT c_mktsegment, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('seed' || chr(1) || c_custkey), c_custkey) <= 10")
def stratified_hash_sample(spark, d):
    """The ten customers of least seeded hash per segment: a sample that doesn't depend on order."""
    key = F.sha2(F.concat_ws("\x01", F.lit("seed"), F.col("c_custkey").cast("string")), 256)
    r = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(key, "c_custkey"))
    return table(spark, d, "customer").withColumn("r", r).where("r <= 10").select("c_mktsegment", "c_custkey")


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark, d):
    l = table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'")  # noqa: E741
    return l.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_discount"), F.count("*").alias("n"))


@query("""
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name
""")
def local_supplier_volume(spark, d):
    t = lambda n: table(spark, d, n)
    near = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "s_nationkey", "n_name")
    sales = t("lineitem").select("l_orderkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v")).join(near, F.col("l_suppkey") == F.col("s_suppkey"))
    bought = t("orders").select("o_orderkey", "o_custkey").join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return sales.join(bought, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("s_nationkey") == F.col("c_nationkey"))).groupBy("n_name").agg(F.round(F.sum("v"), 2).alias("revenue"))
