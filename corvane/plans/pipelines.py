"""Queries on pipelines: rendering, chunking, extraction, adapters, acquisition, streams, sampling and losses."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import extract, graph, ranking, retrieval
from corvane.plans.registry import query
from corvane.plans.views import TASKS_SQL, UNITS_SQL, tasks, units
from corvane.sources.tables import table
from corvane.streaming import events as S


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windowed_counts(spark, d):
    return S.drain(S.windowed_counts(S.event_stream(spark, d)), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT user_id, count(*) AS steps, round(sum(value), 4) AS total, sum(value) >= 150 AS sufficient FROM events GROUP BY user_id")
def stream_running_totals(spark, d):
    return S.drain(S.running_totals(S.event_stream(spark, d)), "update")


@query(f"WITH {UNITS_SQL} SELECT evidence_id, '[PATH] ' || path || chr(10) || '[LINES] ' || start_line || '-' || end_line || chr(10) || coalesce('[SYMBOL] ' || symbol || chr(10), '') || '[CONTENT]' || chr(10) || content AS rendered FROM units WHERE unit_type = 'class'")
def render_units(spark, d):
    u = units(spark, d, "path", "start_line", "end_line", "symbol", "content", "unit_type").where("unit_type = 'class'")
    span = F.concat(F.lit("\n[LINES] "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit("\n"))
    return u.select("evidence_id", F.concat(F.lit("[PATH] "), "path", span, F.coalesce(F.concat(F.lit("[SYMBOL] "), "symbol", F.lit("\n")), F.lit("")), F.lit("[CONTENT]\n"), "content").alias("rendered"))


@query(r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r\f\v]+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, w, unnest(range(0, greatest(1, ceil((len(w) - 64) / 48)::INT + 1))) AS chunk FROM w WHERE len(w) > 0)
SELECT doc_id, CAST(chunk AS INT) AS chunk, CAST(len(w[chunk * 48 + 1:chunk * 48 + 64]) AS INT) AS tokens, array_to_string(w[chunk * 48 + 1:chunk * 48 + 64], ' ') AS text FROM c
""")
def token_chunks(spark, d):
    """Windows of 64 tokens, 48 apart, to the end of every text."""
    return extract.chunks(table(spark, d, "documents"), "doc_id", "text")


@query()
def extracted_units(spark, d):
    u = units(spark, d, "file_version_id", "path", "content", "unit_type").where("unit_type = 'file'")
    return extract.extract_units(u)


@query(f"""
WITH {UNITS_SQL}, p AS (SELECT evidence_id AS a, parent_evidence_id AS b FROM units WHERE parent_evidence_id IN (SELECT evidence_id FROM units)
UNION ALL SELECT a, b FROM (SELECT evidence_id AS a, lead(evidence_id) OVER (PARTITION BY file_version_id ORDER BY start_line, end_line, evidence_id) AS b FROM units) WHERE b IS NOT NULL),
e AS (SELECT a AS first, b AS second FROM p UNION SELECT b, a FROM p), c AS (SELECT file_version_id AS f, evidence_id AS id, row_number() OVER (PARTITION BY file_version_id ORDER BY evidence_id) AS k FROM units WHERE scoreable),
x AS (SELECT m.f, first, second, m.k AS ka, n.k AS kb FROM e JOIN c m ON m.id = first JOIN c n ON n.id = second AND n.f = m.f WHERE m.k < n.k)
SELECT f AS file_version_id, first, second, row_number() OVER (PARTITION BY f ORDER BY ka, kb, first, second) AS rank FROM x QUALIFY rank <= 8
""")
def structural_pairs(spark, d):
    u = units(spark, d, "file_version_id", "parent_evidence_id", "start_line", "end_line", "scoreable")
    c = u.where("scoreable").select("file_version_id", "evidence_id", F.row_number().over(Window.partitionBy("file_version_id").orderBy("evidence_id")).alias("k"))
    return retrieval.structural_pairs(graph.structural_edges(u), c, "file_version_id", "evidence_id", "k")


@query(f"""
WITH {UNITS_SQL}, o AS (SELECT repo AS task_id, row_number() OVER (PARTITION BY repo ORDER BY evidence_id) AS source_rank, CASE WHEN unit_type = 'method' THEN evidence_id END AS o_id, path AS o_path,
CASE WHEN unit_type = 'function' THEN symbol END AS o_symbol, CASE WHEN unit_type = 'code_block' THEN start_line END AS o_start, CASE WHEN unit_type = 'code_block' THEN end_line END AS o_end FROM units WHERE unit_type <> 'file'),
s AS (SELECT * FROM units WHERE coalesce(scoreable, true)), r AS (SELECT o.*, s.* FROM o JOIN s ON o_path = s.path AND task_id = s.repo WHERE o_id IS NULL),
h AS (SELECT task_id, source_rank, o_id AS evidence_id FROM o JOIN s ON o_id = s.evidence_id AND task_id = s.repo UNION ALL SELECT task_id, source_rank, evidence_id FROM r WHERE o_symbol IS NOT NULL AND (symbol = o_symbol OR qualified_name = o_symbol)
UNION ALL SELECT task_id, source_rank, evidence_id FROM r WHERE o_symbol IS NULL AND o_start IS NOT NULL AND start_line <= o_end AND o_start <= end_line UNION ALL SELECT task_id, source_rank, evidence_id FROM r WHERE o_symbol IS NULL AND o_start IS NULL)
SELECT task_id, evidence_id, min(source_rank) AS source_rank FROM h GROUP BY ALL
""")
def output_adapter(spark, d):
    """A repository's units as outputs: methods by id, functions by symbol, blocks by span, others by path."""
    u = units(spark, d, "repo", "path", "symbol", "qualified_name", "start_line", "end_line", "unit_type", "scoreable").withColumn("task_id", F.col("repo"))
    only = lambda kind, c: F.when(F.col("unit_type") == kind, F.col(c))
    o = u.where("unit_type <> 'file'").select(
        "task_id", F.row_number().over(Window.partitionBy("repo").orderBy("evidence_id")).alias("source_rank"), only("method", "evidence_id").alias("evidence_id"), "path",
        only("function", "symbol").alias("symbol"), only("code_block", "start_line").alias("start_line"), only("code_block", "end_line").alias("end_line"))
    return retrieval.adapt_outputs(o, u)


@query(f"""
WITH {UNITS_SQL}, i AS (SELECT DISTINCT repo, file_version_id AS importer, replace(unnest(regexp_extract_all(content, '(?m)^(?:from|import) ([a-z_0-9]+(?:\\.[a-z_0-9]+)*)', 1)), '.', '/') AS module FROM units WHERE unit_type = 'file' AND ends_with(path, '.py'))
SELECT DISTINCT importer, f.file_version_id AS imported FROM i JOIN file_versions f ON f.repo = i.repo AND (f.path = module || '.py' OR ends_with(f.path, '/' || module || '.py') OR f.path = module || '/__init__.py' OR ends_with(f.path, '/' || module || '/__init__.py'))
""")
def import_resolution(spark, d):
    """Modules to files of the repository whose path ends with them: an equi-join on path ends."""
    u = units(spark, d, "repo", "file_version_id", "path", "content", "unit_type").where("unit_type = 'file' and path like '%.py'")
    found = F.regexp_extract_all("content", F.lit(r"(?m)^(?:from|import) ([a-z_0-9]+(?:\.[a-z_0-9]+)*)"))
    i = u.select("repo", F.col("file_version_id").alias("importer"), F.explode(F.array_distinct(found)).alias("m")).select("repo", "importer", F.translate("m", ".", "/").alias("m"))
    i = i.select("repo", "importer", F.explode(F.array(F.concat("m", F.lit(".py")), F.concat("m", F.lit("/__init__.py")))).alias("end"))
    parts = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))
    f = table(spark, d, "file_versions").where("path like '%.py'").select("repo", F.col("file_version_id").alias("imported"), F.explode(ends).alias("end"))
    return i.join(f, ["repo", "end"]).select("importer", "imported").distinct()


_PATHS = "p AS (SELECT task_id, file_version_id, row_number() OVER (PARTITION BY task_id ORDER BY line_count DESC, file_version_id) AS rank FROM tasks JOIN file_versions USING (repo) WHERE true)"


@query(f"""
WITH {TASKS_SQL}, {_PATHS}, c AS (SELECT task_id, file_version_id, row_number() OVER (PARTITION BY task_id ORDER BY path, file_version_id) AS rank FROM tasks JOIN file_versions USING (repo) WHERE status = 'indexed'),
u AS (SELECT task_id, file_version_id, 0 AS c, 'path' AS s, rank FROM p WHERE rank <= 4 UNION ALL SELECT task_id, file_version_id, 1, 'content', rank FROM c WHERE rank <= 8),
b AS (SELECT task_id, file_version_id, min(c * 1000 + rank) AS k, array_to_string(list_sort(list_distinct(list(s))), '+') AS sources FROM u GROUP BY ALL)
SELECT task_id, file_version_id, row_number() OVER (PARTITION BY task_id ORDER BY k, file_version_id) AS rank, sources FROM b QUALIFY rank <= 10
""")
def file_shortlist(spark, d):
    t = tasks(spark, d, "repo").join(table(spark, d, "file_versions"), "repo")
    p = ranking.ranked(t, ["task_id"], [F.col("line_count").desc(), F.col("file_version_id")])
    c = ranking.ranked(t.where("status = 'indexed'"), ["task_id"], [F.col("path"), F.col("file_version_id")])
    return retrieval.shortlist(p, c, "task_id", "file_version_id", (4, 8), 10).withColumn("sources", F.array_join("sources", "+"))


@query()
def agent_rounds(spark, d):
    """All tasks acquire units of their snapshot's files in five rounds under two budgets, from two channels of the 64
    best each, as the reference ranks its channels."""
    t = tasks(spark, d, "snapshot_id").select("task_id", "snapshot_id")
    u = units(spark, d, "file_version_id", "scoreable", "start_line", "end_line").where("scoreable").withColumn("tokens", F.col("end_line") - F.col("start_line") + 1)
    x = t.join(table(spark, d, "snapshot_membership").select("snapshot_id", "file_version_id").distinct(), "snapshot_id").join(u, "file_version_id")
    by = lambda name, *o: ranking.ranked(x, ["task_id"], [*o, F.col("evidence_id")], 64).select("task_id", F.lit(name).alias("channel"), "evidence_id", "rank", "tokens")
    return retrieval.acquire(by("short", F.col("tokens")).unionByName(by("early", F.col("start_line"))), 5, 4, 60)


@query("""
SELECT user_id, round(ln(sum(exp(value / 100))) - ln(sum(CASE WHEN event_type IN ('purchase', 'signup') THEN exp(value / 100) END)), 6) AS loss FROM events GROUP BY user_id HAVING count(CASE WHEN event_type IN ('purchase', 'signup') THEN 1 END) > 0
""")
def listwise_loss(spark, d):
    """log-sum-exp over all actions less that over the positive ones, per state."""
    e = table(spark, d, "events").select("user_id", F.exp(F.col("value") / 100).alias("x"), F.col("event_type").isin("purchase", "signup").alias("good"))
    return e.groupBy("user_id").agg(F.sum("x").alias("all"), F.sum(F.when(F.col("good"), F.col("x"))).alias("pos")).where("pos is not null").select("user_id", F.round(F.log("all") - F.log("pos"), 6).alias("loss"))


@query("""
WITH n AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderdate, o_orderkey) AS ids, count(*) AS n FROM orders GROUP BY 1), i AS (SELECT o_custkey, ids, n, unnest(range(0, 5)) AS i FROM n)
SELECT DISTINCT o_custkey, ids[CAST(round_even(i * (n - 1) / 4.0, 0) AS BIGINT) + 1] AS o_orderkey FROM i
""")
def even_sampling(spark, d):
    """Five orders of a customer at even places in time, or all of fewer; half-even rounding."""
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))).alias("a"))
    i = n.select("o_custkey", "a", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i"))
    at = F.bround(F.col("i") * (F.size("a") - 1) / 4.0, 0).cast("int")
    return i.select("o_custkey", F.get("a", at)["o_orderkey"].alias("o_orderkey")).distinct()


@query("SELECT l_orderkey, sha256(array_to_string(list_sort(list(g)), '|')) AS signature FROM (SELECT l_orderkey, l_returnflag || ':' || array_to_string(list_sort(list(DISTINCT CAST(l_partkey AS VARCHAR))), ',') AS g FROM lineitem GROUP BY l_orderkey, l_returnflag) GROUP BY l_orderkey")
def witness_signature(spark, d):
    """Canonical OR-of-AND groups of an order, inner and outer sorted and without repeats, as a digest."""
    g = table(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))).alias("p"))
    text = F.concat("l_returnflag", F.lit(":"), F.array_join("p", ","))
    return g.groupBy("l_orderkey").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(text)), "|"), 256).alias("signature"))


@query(f"WITH {UNITS_SQL} SELECT evidence_id, CASE WHEN length(content) <= 400 THEN content ELSE substr(content, 1, 300) || chr(10) || '...' || chr(10) || right(content, 100) END AS body FROM units")
def head_tail_bodies(spark, d):
    u = units(spark, d, "content")
    return u.select("evidence_id", T.head_tail(F.col("content"), 400).alias("body"))
