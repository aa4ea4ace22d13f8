"""Queries on merged records, priorities, samples and normalised fields."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.functions import records as R
from corvane.functions import render
from corvane.functions import text as T
from corvane.operators import merge as G
from corvane.operators.ranking import ranked
from corvane.operators.selection import fitting_bodies
from corvane.plans.registry import query
from corvane.plans.views import TASKS_SQL, UNITS_SQL, tasks, units
from corvane.sources.tables import table

_STATS = """
r AS (SELECT l_orderkey AS task, l_partkey AS item, l_returnflag = 'A' AS in_witness, l_linestatus = 'F' AS in_certificate, l_quantity > 45 AS in_boundary, CASE WHEN l_linenumber > 1 THEN l_linenumber END AS rank, CASE WHEN l_discount > 0 THEN l_discount END AS score,
CASE WHEN l_tax < 0.04 THEN 'issue_explicit_path' WHEN l_tax < 0.06 THEN 'policy' ELSE '' END AS source, l_returnflag AS label, l_linestatus AS obligation, l_suppkey FROM lineitem),
st AS (SELECT task, item, coalesce(bool_or(in_witness), false) AS in_witness, coalesce(bool_or(in_certificate), false) AS in_certificate, coalesce(bool_or(in_boundary), false) AS in_boundary, min(rank) AS min_rank, max(score) AS max_score,
list_sort(list(DISTINCT source) FILTER (source <> '')) AS sources, array_to_string(list_sort(list(DISTINCT label)), '+') AS labels, array_to_string(list_sort(list(DISTINCT obligation)), '+') AS obligations, min(l_suppkey) AS s FROM r GROUP BY ALL)
"""


def _stats(spark, d):
    li = table(spark, d, "lineitem")
    source = F.when(F.col("l_tax") < 0.04, "issue_explicit_path").when(F.col("l_tax") < 0.06, "policy").otherwise("")
    r = li.select(
        F.col("l_orderkey").alias("task"), F.col("l_partkey").alias("item"), (F.col("l_returnflag") == "A").alias("in_witness"), (F.col("l_linestatus") == "F").alias("in_certificate"), (F.col("l_quantity") > 45).alias("in_boundary"),
        F.when(F.col("l_linenumber") > 1, F.col("l_linenumber")).alias("rank"), F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("score"), source.alias("source"), F.col("l_returnflag").alias("label"), F.col("l_linestatus").alias("obligation"))
    return G.candidate_stats(r, "task", "item")


@query(f"""
WITH {_STATS} SELECT task, item, in_witness, in_certificate, in_boundary, min_rank, max_score, coalesce(array_to_string(sources, '+'), '') AS sources, labels, obligations,
row_number() OVER (PARTITION BY task ORDER BY CASE WHEN in_witness OR in_certificate OR in_boundary THEN 0 ELSE 1 END, CASE WHEN min_rank IS NULL THEN 1 ELSE 0 END, coalesce(min_rank, 2147483647), max_score DESC NULLS LAST, item) AS rank FROM st
""")
def candidate_stats(spark, d):
    """Merged statistics of an order's parts, in the order of candidates."""
    x = ranked(_stats(spark, d), ["task"], G.stats_key("item"))
    return x.select("task", "item", *G.HELD, "min_rank", "max_score", *(F.array_join(c, "+").alias(c) for c in ("sources", "labels", "obligations")), "rank")


@query(f"""
WITH {_STATS}, p AS (SELECT st.*, 'src/' || p_name || CASE WHEN p_size % 3 = 0 THEN '.md' WHEN p_size % 3 = 1 THEN '.py' ELSE '.json' END AS path, p_size AS a, p_size + item % 7 AS b, p_size % 3 AS kind FROM st JOIN part ON p_partkey = item)
SELECT task, item, tier, row_number() OVER (PARTITION BY task ORDER BY tier, coalesce(min_rank, 2147483647), max_score DESC NULLS LAST, b - a, path, a, b, item) AS rank FROM (
SELECT *, CASE WHEN in_certificate OR in_boundary THEN 0 WHEN in_witness THEN 1 WHEN list_contains(sources, 'issue_explicit_path') THEN 5 WHEN kind = 1 THEN 6 WHEN kind = 0 THEN 8 ELSE 9 END AS tier FROM p)
""")
def candidate_priority(spark, d):
    """Tiers and places of an order's parts; a part's name and size make a path and lines."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("item"), "p_name", "p_size")
    end = F.when(F.col("p_size") % 3 == 0, ".md").when(F.col("p_size") % 3 == 1, ".py").otherwise(".json")
    x = _stats(spark, d).join(part, "item").withColumn("path", F.concat(F.lit("src/"), "p_name", end)).withColumn("start_line", F.col("p_size")).withColumn("end_line", F.col("p_size") + F.col("item") % 7)
    x = x.withColumn("tier", G.priority_tier(F.col("path"), F.col("sources")))
    return ranked(x, ["task"], G.priority_key("item")).select("task", "item", "tier", "rank")


@query("SELECT l_orderkey, l_partkey, max(l_discount) AS confidence, arg_max(l_returnflag, (l_discount, l_linenumber, l_suppkey)) AS source, array_to_string(list_sort(list(DISTINCT l_linestatus)), '+') AS annotations FROM lineitem GROUP BY ALL")
def label_merge(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.col("l_discount").alias("confidence"), F.col("l_returnflag").alias("source"), F.col("l_linestatus").alias("annotation"), F.struct("l_linenumber", "l_suppkey").alias("seq"))
    return G.merge_labels(x, ["l_orderkey", "l_partkey"]).withColumn("annotations", F.array_join("annotations", "+"))


@query("""
WITH g AS (SELECT l_orderkey, l_returnflag, l_linestatus, l_suppkey % 2 AS half, bool_or(l_linenumber = 1) AS m, bool_or(l_tax > 0) AS a, max(l_discount) AS c, array_to_string(list_sort(list(DISTINCT l_partkey::VARCHAR)), ',') AS ids FROM lineitem GROUP BY ALL)
SELECT l_orderkey, l_returnflag, bool_or(m) AS mandatory, bool_or(a) AS applicable, max(c) AS confidence, array_to_string(list_sort(list(DISTINCT ids)), '|') AS groups, array_to_string(list_sort(list(DISTINCT l_linestatus)), '+') AS annotations FROM g GROUP BY ALL
""")
def supervision_merge(spark, d):
    """Obligations merged from several deliveries: flags, the highest confidence, distinct groups of sorted ids."""
    x = table(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag", "l_linestatus", F.col("l_suppkey") % 2).agg(
        F.max(F.col("l_linenumber") == 1).alias("mandatory"), F.max(F.col("l_tax") > 0).alias("applicable"), F.max("l_discount").alias("confidence"), F.collect_list(F.col("l_partkey").cast("string")).alias("group"))
    x = G.merge_groups(x.withColumn("annotation", F.col("l_linestatus")), ["l_orderkey", "l_returnflag"])
    groups = F.array_join(F.array_sort(F.transform("groups", lambda g: F.array_join(g, ","))), "|")
    return x.withColumn("groups", groups).withColumn("annotations", F.array_join("annotations", "+"))


@query("""
WITH s AS (SELECT o_custkey, o_orderstatus, o_orderkey, count(DISTINCT l_partkey) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT o_custkey, state_type, state_id, size FROM (SELECT o_custkey, CASE o_orderstatus WHEN 'O' THEN 'initial' WHEN 'F' THEN 'complete' ELSE 'decision_boundary' END AS state_type, o_orderkey AS state_id, n AS size,
row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY CASE WHEN o_orderstatus = 'O' THEN n ELSE -n END, CASE WHEN o_orderstatus = 'O' THEN o_orderkey ELSE -o_orderkey END) AS r FROM s) WHERE r = 1
""")
def policy_state_choice(spark, d):
    """Of each customer's orders by status the one with the fewest parts, if open, or the most."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderkey")
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(F.col("l_partkey").cast("string")).alias("evidence_ids"))
    kind = F.when(F.col("o_orderstatus") == "O", "initial").when(F.col("o_orderstatus") == "F", "complete").otherwise("decision_boundary")
    return G.pick_states(o.join(n, "o_orderkey").select("o_custkey", kind.alias("state_type"), F.col("o_orderkey").alias("state_id"), "evidence_ids"), ["o_custkey"])


@query("""
SELECT o_orderpriority, o_orderkey, place FROM (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('calibration' || chr(0) || o_orderkey), o_orderkey) AS place FROM orders) WHERE place <= CASE o_orderpriority WHEN '1-URGENT' THEN 10 WHEN '2-HIGH' THEN 20 WHEN '5-LOW' THEN 20 ELSE 0 END
""")
def stratified_sample(spark, d):
    o = table(spark, d, "orders").select("o_orderpriority", "o_orderkey")
    return G.stratified(o, "o_orderpriority", "o_orderkey", {"1-URGENT": 10, "2-HIGH": 20, "5-LOW": 20}, "calibration")[0]


@query("""
WITH c AS (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 3) SELECT o_custkey, row_number() OVER (ORDER BY sha256('triplets' || chr(0) || o_custkey), o_custkey) AS place FROM c QUALIFY place <= 50
""")
def paired_sample(spark, d):
    """Fifty customers with orders of all three states."""
    return G.paired(table(spark, d, "orders"), "o_custkey", "o_orderstatus", ["F", "O", "P"], 50, "triplets")


@query("""
WITH a AS (SELECT l_orderkey AS task, l_partkey || '-' || l_suppkey || '-' || l_linenumber AS item, CASE WHEN l_linenumber = 7 THEN 'stop' WHEN l_tax < 0.03 THEN 'pair' ELSE 'single' END AS kind, CASE WHEN l_returnflag = 'A' THEN 'positive' WHEN l_returnflag = 'R' OR l_linestatus = 'O' THEN 'negative' ELSE 'unknown' END AS label,
CASE WHEN l_discount > 0.02 THEN (l_discount * 100)::INT END AS rank FROM lineitem), b AS (SELECT *, coalesce(rank, 2147483647) AS k, kind = 'pair' AND label = 'negative' AS p FROM a WHERE label <> 'unknown'), c AS (SELECT *, CASE WHEN p THEN row_number() OVER (PARTITION BY task, p ORDER BY k, item) END AS nth FROM b),
t AS (SELECT *, CASE WHEN label = 'positive' THEN 0 WHEN kind = 'stop' THEN 1 WHEN p AND nth <= 1 THEN 2 WHEN kind = 'single' AND rank IS NOT NULL THEN 3 ELSE 4 END AS tier FROM c)
SELECT task, item, tier, row_number() OVER (PARTITION BY task ORDER BY tier, CASE WHEN tier < 4 THEN k ELSE 0 END, CASE WHEN tier = 4 THEN sha256('epoch' || chr(0) || item) END NULLS FIRST, item) AS place FROM t QUALIFY place <= 3 OR tier = 0
""")
def listwise_candidates(spark, d):
    """At most three actions of an order to compare: positives, stop, one negative pair, ranked singles, others by hash."""
    li = table(spark, d, "lineitem")
    label = F.when(F.col("l_returnflag") == "A", "positive").when((F.col("l_returnflag") == "R") | (F.col("l_linestatus") == "O"), "negative").otherwise("unknown")
    kind = F.when(F.col("l_linenumber") == 7, "stop").when(F.col("l_tax") < 0.03, "pair").otherwise("single")
    a = li.select(F.col("l_orderkey").alias("task"), F.concat_ws("-", "l_partkey", "l_suppkey", "l_linenumber").alias("item"), kind.alias("kind"), label.alias("label"), F.when(F.col("l_discount") > 0.02, F.round(F.col("l_discount") * 100).cast("int")).alias("rank"))
    return G.listwise_sample(a, "task", "item", 3, 1, "epoch")


@query(f"""
WITH {UNITS_SQL}, p AS (SELECT evidence_id AS "left", parent_evidence_id AS "right" FROM units WHERE parent_evidence_id IS NOT NULL), x AS (SELECT p."left", p."right", a.repo = b.repo AND a.path = b.path AS same, greatest(0, least(a.end_line, b.end_line) - greatest(a.start_line, b.start_line) + 1) AS n,
greatest(1, least(a.end_line - a.start_line, b.end_line - b.start_line) + 1) AS m, coalesce(a.content_sha256 = b.content_sha256, false) AS eq FROM p JOIN units a ON a.evidence_id = p."left" JOIN units b ON b.evidence_id = p."right")
SELECT "left", "right", same AS same_path, round(CASE WHEN same THEN n / m ELSE 0 END, 6) AS overlap, CASE WHEN same THEN n / m ELSE 0 END >= 1 AS contained, eq AS equal_content FROM x
""")
def pair_features(spark, d):
    """Features of the pairs of every unit and its parent."""
    u = units(spark, d, "repo", "path", "start_line", "end_line", "content_sha256", "parent_evidence_id").withColumnRenamed("evidence_id", "evidence")
    return G.pair_features(u.where("parent_evidence_id is not null").select(F.col("evidence").alias("left"), F.col("parent_evidence_id").alias("right")), u)


@query(f"""
WITH {UNITS_SQL}, h AS (SELECT evidence_id AS hunk, repo, path, symbol, start_line, end_line FROM units WHERE unit_type = 'code_block'), u AS (SELECT * FROM units WHERE unit_type <> 'file'),
x AS (SELECT h.hunk, u.evidence_id AS evidence, greatest(0, least(u.end_line, h.end_line) - greatest(u.start_line, h.start_line) + 1) AS n, greatest(0, u.start_line - h.end_line, h.start_line - u.end_line) AS far, u.end_line - u.start_line AS span, u.start_line AS a FROM h JOIN u USING (repo, path))
SELECT hunk, evidence, row_number() OVER (PARTITION BY hunk ORDER BY n DESC, far, span, a, evidence) AS rank FROM x QUALIFY rank <= 4
""")
def hunk_units(spark, d):
    """The four units of the same path that are closest to each code block."""
    u = units(spark, d, "repo", "path", "symbol", "start_line", "end_line", "unit_type").withColumnRenamed("evidence_id", "evidence")
    return G.hunk_units(u.where("unit_type = 'code_block'").withColumnRenamed("evidence", "hunk").withColumn("symbol", F.lit(None).cast("string")), u.where("unit_type <> 'file'"))


@query(f"""
WITH {UNITS_SQL}, f AS (SELECT evidence_id, '/' || lower(path) || '/' AS p, regexp_extract(lower(path), '[^/]*$') AS name, content, strlen(content) AS n FROM units WHERE unit_type = 'file'),
x AS (SELECT evidence_id, regexp_matches(p, '/(tests?|testing|specs?)/.*/') OR starts_with(name, 'test_') OR regexp_matches(name, '(_test[.]py|[.](test|spec)[.](js|ts))$') AS is_test, regexp_matches(p, '/(dist|build|generated|gen|coverage)/') OR regexp_matches(name, '([.]min[.](js|css)|[.]generated[.](py|ts))$') AS is_generated,
regexp_matches(p, '/(vendors?|third_party|third-party|node_modules|site-packages|[.]venv|venv)/') AS is_vendor, contains(substr(content, 1, 8192), chr(0)) AS is_binary FROM f)
SELECT *, NOT (is_binary OR is_vendor OR is_generated) AS searchable FROM x
""")
def file_kinds(spark, d):
    """Kinds of every file by path and content (no text of the tables is as large as a data asset)."""
    u = units(spark, d, "path", "content", "unit_type").where("unit_type = 'file'")
    return u.select("evidence_id", *(c.alias(n) for n, c in R.file_kinds(F.col("path"), F.col("content"), F.octet_length("content")).items()))


@query("SELECT repo, 'repo' || substr(sha1(lower(repo)), 1, 20) AS token, regexp_replace(repo, '[^A-Za-z0-9._-]+', '-', 'g') AS label, repo AS normal FROM repositories")
def repository_names(spark, d):
    r = F.col("repo")
    return table(spark, d, "repositories").select("repo", R.repo_token(r).alias("token"), R.file_label(r).alias("label"), R.repo_name(F.concat(F.lit("https://github.com/"), r, F.lit(".git"))).alias("normal"))


@query(f"WITH {UNITS_SQL} SELECT repo, sum(CASE WHEN rendered_token_count > 0 THEN rendered_token_count WHEN token_count > 0 THEN token_count ELSE 0 END)::BIGINT AS tokens FROM units GROUP BY repo")
def token_costs(spark, d):
    """Tokens of a repository's units: the rendered count, else the raw one, else none."""
    u = units(spark, d, "repo", "rendered_token_count", "token_count")
    return u.groupBy("repo").agg(F.sum(R.token_cost(F.col("rendered_token_count"), F.col("token_count")).cast("long")).alias("tokens"))


@query(f"""
WITH {TASKS_SQL}, s AS (SELECT task_id, regexp_extract_all(coalesce(problem_statement, ''), '(?:^|[^A-Za-z0-9_])([A-Za-z_][A-Za-z0-9_]*(?:[.][A-Za-z_][A-Za-z0-9_]*)*)[[:space:]]*[(]', 1) AS calls FROM tasks) SELECT task_id, len(calls) > 0 AS has_call FROM s
""")
def statements_with_calls(spark, d):
    """Whether a statement writes a call."""
    t = tasks(spark, d, "problem_statement")
    return t.select("task_id", F.coalesce(F.col("problem_statement"), F.lit("")).rlike(r"(?<![A-Za-z0-9_])[A-Za-z_][A-Za-z0-9_]*\s*\(").alias("has_call"))


@query()
def issue_symbols(spark, d):
    """Symbols that statements name, with the units of the snapshot that are or declare them, three at most for each. No
    SQL: the patterns look behind."""
    t = tasks(spark, d, "snapshot_id", "problem_statement").select("task_id", "snapshot_id", F.explode(T.issue_symbols(F.col("problem_statement"))).alias("wanted"))
    m = table(spark, d, "snapshot_membership").select("snapshot_id", "file_version_id").distinct()
    u = units(spark, d, "file_version_id", "symbol", "qualified_name", "content", "start_line", "end_line", "scoreable").where("scoreable").withColumn("name", F.coalesce("qualified_name", "symbol", F.lit("")))
    x = t.join(m, "snapshot_id").join(u, "file_version_id").where(G.matches_symbol(F.col("name"), F.col("content"), F.col("wanted")))
    return ranked(x, ["task_id", "wanted"], G.symbol_key(F.col("name"), F.col("wanted"), "evidence_id"), 3).select("task_id", "wanted", "evidence_id", "rank")


@query("""
SELECT doc_id, length(trim(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g'))) AS n, CASE WHEN regexp_matches(coalesce(text, ''), '^\\s*[{\\[]') THEN TRY_CAST(text AS JSON) IS NOT NULL ELSE false END AS whole FROM documents
""")
def json_texts(spark, d):
    """Length without space around, and whether a text that begins like JSON is JSON."""
    t = F.col("text")
    first = F.coalesce(t, F.lit("")).rlike(r"^\s*[{\[]")
    return table(spark, d, "documents").select("doc_id", F.length(F.trim(R.strip(t))).alias("n"), F.when(first, F.try_parse_json(R.strip(t)).isNotNull()).otherwise(False).alias("whole"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, ts, event_id) AS rank FROM events")
def action_ranking(spark, d):
    """Actions of a state by score; equal scores keep their order."""
    w = Window.partitionBy("user_id").orderBy(F.col("value").desc(), "ts", "event_id")
    return table(spark, d, "events").select("user_id", "event_id", F.row_number().over(w).alias("rank"))


@query(f"""
WITH {UNITS_SQL}, u AS (SELECT *, '证据 ID：' || evidence_id || chr(10) || '位置：' || path || ':' || start_line || '-' || end_line || chr(10) || '类型：' || unit_type || chr(10) || content AS body FROM units WHERE unit_type <> 'file' AND scoreable)
SELECT file_version_id, string_agg(body, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY start_line, end_line, evidence_id) AS package FROM u GROUP BY file_version_id
""")
def judge_packages(spark, d):
    """Each file's units as a judge sees a package."""
    u = units(spark, d, "file_version_id", "path", "unit_type", "start_line", "end_line", "content", "scoreable").where("unit_type <> 'file' and scoreable")
    one = F.struct("start_line", "end_line", "evidence_id", "path", "unit_type", "content")
    return u.groupBy("file_version_id").agg(F.array_sort(F.collect_list(one)).alias("units")).select("file_version_id", render.package(F.col("units")).alias("package"))


@query()
def action_inputs(spark, d):
    """The scorer's input for each file's first unit, with its next units as state under a budget of 120 tokens for
    bodies. No SQL: the budget is a walk."""
    u = units(spark, d, "file_version_id", "path", "unit_type", "symbol", "qualified_name", "start_line", "end_line", "content", "scoreable").where("unit_type <> 'file' and scoreable")
    one = F.struct("start_line", "end_line", "evidence_id", "path", "unit_type", "symbol", "qualified_name", "content", (F.col("end_line") - F.col("start_line") + 1).alias("tokens"))
    x = u.groupBy("file_version_id").agg(F.array_sort(F.collect_list(one)).alias("all")).select("file_version_id", F.slice("all", 1, 1).alias("next"), F.slice("all", 2, 8).alias("held"))
    bodies = fitting_bodies(F.transform("held", lambda v: F.struct(v["evidence_id"].alias("id"), v["tokens"].alias("tokens"))), 120)
    return x.select("file_version_id", render.action(F.lit("what fails?"), F.col("held"), bodies, F.col("next")).alias("text"))
