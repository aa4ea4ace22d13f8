"""Retrieval queries. The query set is every document (or vector) whose id is divisible by 20, against all."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import channels as C
from corvane.operators import graph
from corvane.operators import ranking as R
from corvane.plans.corpus import MENTION_SQL, SPLIT
from corvane.plans.registry import query
from corvane.plans.views import TASKS_SQL, UNITS_SQL, tasks, units
from corvane.session import materialize
from corvane.sources.tables import table

_PICK = "list_transform(list_sort(list_transform(list_distinct({0}), lambda w: {{'k': -length(w), 'w': w}}))[1:12], lambda x: x.w)"
_BM25 = f"""
d AS (SELECT doc_id, {SPLIT.format("coalesce(text, '')")} AS terms FROM documents),
st AS (SELECT count(*) AS n, coalesce(nullif(avg(len(terms)), 0), 1.0) AS mean FROM d),
q AS (SELECT doc_id AS query_id, unnest({_PICK.format('terms')}) AS term FROM d WHERE doc_id % 20 = 0),
p AS (SELECT doc_id, len(terms) AS length, unnest(terms) AS term FROM d),
tf AS (SELECT doc_id, length, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
g AS (SELECT doc_id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean)) AS gain FROM tf JOIN df USING (term), st),
h AS (SELECT query_id, doc_id, round(sum(gain), 6) AS score FROM q JOIN g USING (term) GROUP BY ALL),
top AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM h WHERE score > 0)
"""


def _bm25(spark, d, limit):
    docs = table(spark, d, "documents").select("doc_id", "text")
    asked = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("question"))
    return R.bm25(docs, "doc_id", "text", asked, "query_id", "question", limit)


@query(f"WITH {_BM25} SELECT * FROM top WHERE rank <= 10")
def bm25_topk(spark, d):
    return _bm25(spark, d, 10)


_DENSE = """
b AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
s AS (SELECT q.vec_id AS query_id, b.vec_id, round(list_dot_product(q.e, b.e) / (q.n * b.n), 6) AS score FROM b q, b WHERE q.vec_id % 20 = 0),
top AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
"""


def _dense(spark, d, limit):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return R.dense_topk(e, "vec_id", "embedding", e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "query_id", "q", limit)


@query(f"WITH {_DENSE} SELECT * FROM top WHERE rank <= 10")
def dense_cosine_topk(spark, d):
    return _dense(spark, d, 10)


@query(f"""
WITH {_DENSE}, t AS (SELECT * FROM top WHERE rank <= 20), rel AS (SELECT q.vec_id AS query_id, b.vec_id FROM embeddings q JOIN embeddings b ON q.label = b.label WHERE q.vec_id % 20 = 0),
n AS (SELECT query_id, count(*) AS n FROM rel GROUP BY 1), h AS (SELECT t.query_id, t.rank FROM t JOIN rel USING (query_id, vec_id)),
i AS (SELECT query_id, {", ".join(f"(SELECT sum(1 / log2(k + 1)) FROM range(1, least(n, {k})::BIGINT + 1) x(k)) AS i{k}" for k in (1, 5, 10, 20))} FROM n)
SELECT n.query_id, round(coalesce(1.0 / min(rank), 0), 6) AS rr, {", ".join(f"round(count(CASE WHEN rank <= {k} THEN 1 END) / any_value(n), 6) AS recall_{k}" for k in (1, 5, 10, 20))},
{", ".join(f"round(coalesce(sum(CASE WHEN rank <= {k} THEN 1 / log2(rank + 1) END) / any_value(i{k}), 0), 6) AS ndcg_{k}" for k in (1, 5, 10, 20))}
FROM n JOIN i USING (query_id) LEFT JOIN h USING (query_id) GROUP BY n.query_id
""")
def dense_retrieval_metrics(spark, d):
    """Recall, reciprocal rank and NDCG of the dense search; a vector of the query's label is relevant."""
    from corvane.operators.metrics import retrieval_metrics

    e = table(spark, d, "embeddings").select("vec_id", "label")
    rel = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label").join(e, "label").select("query_id", "vec_id")
    return retrieval_metrics(_dense(spark, d, 20), rel, "query_id", "vec_id", cutoffs=(1, 5, 10, 20))


_TWO = f"""
{_BM25}, r AS (SELECT 'content' AS channel, query_id, doc_id, rank FROM top WHERE rank <= 64
UNION ALL SELECT 'repo', q.doc_id, x.doc_id, row_number() OVER (PARTITION BY q.doc_id ORDER BY abs(x.doc_id - q.doc_id), x.doc_id) FROM documents q JOIN documents x ON q.task_id = x.task_id WHERE q.doc_id % 20 = 0)
"""


def _channels(spark, d):
    from pyspark.sql import Window

    docs = table(spark, d, "documents").where("task_id is not null").select("doc_id", "task_id")
    same = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "task_id").join(docs, "task_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.abs(F.col("doc_id") - F.col("query_id")), "doc_id"))
    second = same.select(F.lit("repo").alias("channel"), "query_id", "doc_id", rank.alias("rank"))
    return _bm25(spark, d, 64).select(F.lit("content").alias("channel"), "query_id", "doc_id", "rank").unionByName(second)


@query(f"""
WITH {_TWO}, f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, array_to_string(list_sort(list_distinct(list(channel))), '+') AS sources FROM r GROUP BY ALL)
SELECT query_id, doc_id, score, sources, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f QUALIFY rank <= 20
""")
def rrf_two_channel(spark, d):
    return R.rrf(_channels(spark, d), "query_id", "channel", "doc_id", "rank", limit=20).withColumn("sources", F.array_join("sources", "+"))


@query(f"""
WITH {_TWO}, f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (64 + rank)), 9) AS score, min(rank) AS best_rank FROM r WHERE rank <= 64 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN best_rank <= 8 THEN 0 ELSE 1 END, score DESC, best_rank, doc_id) AS keep FROM f)
SELECT query_id, doc_id, score, best_rank, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best_rank, doc_id) AS rank FROM k WHERE keep <= 16
""")
def rrf_head_protected(spark, d):
    return R.rrf_protected(_channels(spark, d), "query_id", "channel", "doc_id", "rank", limit=16).drop("sources")


_Q = SPLIT.format("coalesce(problem_statement, '')")
_SEEN = f"{UNITS_SQL}, {TASKS_SQL}, m AS (SELECT DISTINCT task_id, file_version_id FROM tasks JOIN snapshot_membership USING (snapshot_id)), q AS (SELECT task_id, unnest(list_distinct({_Q})) AS term FROM tasks)"


def _asked(spark, d):
    """(task, question, snapshot_id) of all tasks, and their distinct terms."""
    t = tasks(spark, d, "snapshot_id", "problem_statement").select(F.col("task_id").alias("task"), "snapshot_id", F.col("problem_statement").alias("question"))
    return t, C.asked_terms(t)


def _seen_files(spark, d, t):
    m = table(spark, d, "snapshot_membership").select("snapshot_id", "file_version_id").distinct()
    return t.select("task", "snapshot_id").join(m, "snapshot_id").select("task", "file_version_id").distinct()


@query(f"""
WITH {_SEEN}, c AS (SELECT task_id, evidence_id, coalesce(qualified_name, symbol) AS s FROM m JOIN units USING (file_version_id) WHERE scoreable AND symbol IS NOT NULL),
e AS (SELECT task_id, lower(unnest(list_distinct(regexp_extract_all(coalesce(problem_statement, ''), '`([A-Za-z_][A-Za-z0-9_.]*)(?:\\(.*?\\))?`', 1)))) AS name FROM tasks),
o AS (SELECT task_id, evidence_id, count(*) AS n FROM (SELECT task_id, evidence_id, unnest(list_distinct({SPLIT.format("s")})) AS term FROM c) JOIN q USING (task_id, term) GROUP BY ALL),
b AS (SELECT task_id, evidence_id, 4 * max(CASE WHEN lower(s) = name THEN 1 ELSE 0 END) + 2 AS n FROM c JOIN e USING (task_id) WHERE ends_with(lower(s), name) GROUP BY ALL),
h AS (SELECT task_id AS task, evidence_id AS evidence, sum(n)::INT AS score FROM (SELECT * FROM o UNION ALL SELECT * FROM b) GROUP BY ALL)
SELECT task, evidence, score, row_number() OVER (PARTITION BY task ORDER BY score DESC, evidence) AS rank FROM h QUALIFY rank <= 64
""")
def symbol_rank(spark, d):
    """Units of a task's snapshot by the terms of their symbol, and by the names between backticks in the statement."""
    t, asked = _asked(spark, d)
    u = units(spark, d, "file_version_id", "scoreable", "symbol", "qualified_name").where("scoreable and symbol is not null").withColumnRenamed("evidence_id", "evidence")
    universe = _seen_files(spark, d, t).join(u.select("file_version_id", "evidence"), "file_version_id")
    names = t.select("task", F.explode(T.code_spans(F.col("question"))).alias("name"))
    return C.overlap(universe, u, F.coalesce("qualified_name", "symbol"), asked, names)


@query(f"""
WITH {_SEEN}, c AS (SELECT task_id, file_version_id, path FROM m JOIN file_versions USING (file_version_id)),
e AS (SELECT task_id, lower(unnest(list_distinct(regexp_extract_all(coalesce(problem_statement, ''), '{MENTION_SQL}', 1)))) AS name FROM tasks),
o AS (SELECT task_id, file_version_id, count(*) AS n FROM (SELECT task_id, file_version_id, unnest(list_distinct({SPLIT.format("path")})) AS term FROM c) JOIN q USING (task_id, term) GROUP BY ALL),
b AS (SELECT task_id, file_version_id, 4 * max(CASE WHEN lower(path) = name THEN 1 ELSE 0 END) + 2 AS n FROM c JOIN e USING (task_id) WHERE ends_with(lower(path), name) GROUP BY ALL),
h AS (SELECT task_id AS task, file_version_id AS evidence, sum(n)::INT AS score FROM (SELECT * FROM o UNION ALL SELECT * FROM b) GROUP BY ALL)
SELECT task, evidence, score, row_number() OVER (PARTITION BY task ORDER BY score DESC, evidence) AS rank FROM h QUALIFY rank <= 64
""")
def path_rank(spark, d):
    """Files of a task's snapshot by the terms of their path, and by the paths that the statement names."""
    t, asked = _asked(spark, d)
    f = table(spark, d, "file_versions").select(F.col("file_version_id").alias("evidence"), "path")
    names = t.select("task", F.explode(T.path_mentions(F.col("question"))).alias("name"))
    return C.overlap(_seen_files(spark, d, t).withColumnRenamed("file_version_id", "evidence"), f, F.translate("path", "\\", "/"), asked, names)


_UNIT_BM25 = f"""
{_SEEN}, c AS (SELECT task_id, evidence_id FROM m JOIN units USING (file_version_id) WHERE scoreable), w AS (SELECT evidence_id, {SPLIT.format("content")} AS terms FROM units WHERE scoreable),
st AS (SELECT task_id, count(*) AS n, coalesce(nullif(avg(len(terms)), 0), 1.0) AS mean FROM c JOIN w USING (evidence_id) GROUP BY 1),
p AS (SELECT evidence_id, len(terms) AS length, unnest(terms) AS term FROM w), pt AS (SELECT evidence_id, length, term, count(*) AS tf FROM p GROUP BY ALL),
tf AS (SELECT task_id, evidence_id, length, term, tf FROM c JOIN pt USING (evidence_id) JOIN q USING (task_id, term)), df AS (SELECT task_id, term, count(*) AS df FROM tf GROUP BY ALL),
h AS (SELECT task_id AS task, evidence_id AS evidence, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM tf JOIN df USING (task_id, term) JOIN st USING (task_id) GROUP BY ALL),
content AS (SELECT task, evidence, score, row_number() OVER (PARTITION BY task ORDER BY score DESC, evidence) AS rank FROM h WHERE score > 0)
"""


def _universe(spark, d):
    """(tasks, asked terms, scopes, universe, units) with the reference names: a scope is a snapshot, its units are the
    candidates of all its tasks."""
    t, asked = _asked(spark, d)
    u = units(spark, d, "file_version_id", "path", "symbol", "scoreable", "content").where("scoreable").select(F.col("evidence_id").alias("evidence"), "file_version_id", "path", "symbol", "content")
    scopes = t.select("task", F.col("snapshot_id").alias("scope")).where("scope is not null").distinct()
    m = table(spark, d, "snapshot_membership").select(F.col("snapshot_id").alias("scope"), "file_version_id").distinct()
    m = m.join(scopes.select("scope").distinct(), "scope", "left_semi").join(u.select("file_version_id", "evidence"), "file_version_id")
    return t, asked, scopes, materialize(m.select("scope", "evidence"), "universe"), u


@query(f"WITH {_UNIT_BM25} SELECT * FROM content WHERE rank <= 64")
def candidate_unit_bm25(spark, d):
    """BM25 within a task's candidates, the units of its snapshot: counts and lengths are the candidates' own."""
    _, asked, scopes, universe, u = _universe(spark, d)
    return C.candidate_bm25(universe, R.unit_vectors(u, asked, "evidence", "content"), asked, scopes=scopes)


_CHANNELS = f"""
{_UNIT_BM25.replace("c AS (SELECT task_id, evidence_id FROM m JOIN units USING (file_version_id) WHERE scoreable)",
"k AS (SELECT task_id, min(evidence_id) AS held FROM m JOIN units USING (file_version_id) WHERE scoreable GROUP BY 1), c AS (SELECT task_id, evidence_id FROM m JOIN units USING (file_version_id) JOIN k USING (task_id) WHERE scoreable AND evidence_id <> held)")},
o AS (SELECT c.task_id, c.evidence_id, path, coalesce(symbol, '') AS symbol FROM c JOIN units USING (evidence_id)),
path AS (SELECT task_id AS task, evidence_id AS evidence, count(*) AS score FROM (SELECT task_id, evidence_id, unnest(list_distinct({SPLIT.format("path")})) AS term FROM o) JOIN q USING (task_id, term) GROUP BY ALL),
sym AS (SELECT task_id AS task, evidence_id AS evidence, count(*) AS score FROM (SELECT task_id, evidence_id, unnest(list_distinct({SPLIT.format("symbol")})) AS term FROM o) JOIN q USING (task_id, term) GROUP BY ALL),
ep AS (SELECT evidence_id AS a, parent_evidence_id AS b FROM units WHERE parent_evidence_id IN (SELECT evidence_id FROM units) UNION ALL SELECT a, b FROM (SELECT evidence_id AS a, lead(evidence_id) OVER (PARTITION BY file_version_id ORDER BY start_line, end_line, evidence_id) AS b FROM units) WHERE b IS NOT NULL),
e AS (SELECT a AS source, b AS target FROM ep UNION SELECT b, a FROM ep), struct AS (SELECT c.task_id AS task, target AS evidence, count(*) AS score FROM k JOIN e ON source = held JOIN c ON c.task_id = k.task_id AND c.evidence_id = target GROUP BY ALL),
every AS (SELECT task, 'bm25_content' AS channel, evidence, score FROM content UNION ALL SELECT task, 'path_name', evidence, score FROM path UNION ALL SELECT task, 'symbol', evidence, score FROM sym UNION ALL SELECT task, 'structure', evidence, score FROM struct)
"""


@query(f"WITH {_CHANNELS} SELECT task, channel, evidence, row_number() OVER (PARTITION BY task, channel ORDER BY score DESC, evidence) AS rank FROM every QUALIFY rank <= 64")
def four_channel(spark, d):
    """The four channels of every task; its state holds the first unit of its snapshot."""
    _, asked, scopes, universe, u = _universe(spark, d)
    edges = graph.structural_edges(units(spark, d, "file_version_id", "parent_evidence_id", "start_line", "end_line"))
    held = universe.groupBy("scope").agg(F.min("evidence").alias("evidence")).join(scopes, "scope").select("task", "evidence")
    return C.four_channels(universe, u, asked, held, edges, scopes=scopes)


@query()
def rag_pipeline(spark, d):
    """The whole retrieval of every task: title and body are two dimensions, the first unit of the snapshot is held."""
    t, _ = _asked(spark, d)
    lines = F.split(F.coalesce("question", F.lit("")), "\n")
    asked = t.select("task", F.explode(F.array(F.struct(F.lit("title").alias("dimension"), F.get(lines, F.lit(0)).alias("q")), F.struct(F.lit("body").alias("dimension"), F.array_join(F.slice(lines, 2, F.size(lines)), "\n").alias("q")))).alias("x"))
    asked = asked.select("task", "x.dimension", F.explode(T.distinct_terms(F.col("x.q"))).alias("term"))
    u = units(spark, d, "file_version_id", "path", "symbol", "unit_type", "scoreable", "content")
    files = u.where("unit_type = 'file'").groupBy(F.col("file_version_id").alias("file")).agg(F.max("path").alias("path"), F.max("content").alias("content"))
    scored = u.where("scoreable").select(F.col("evidence_id").alias("evidence"), F.col("file_version_id").alias("file"), "path", "symbol", "content")
    seen = _seen_files(spark, d, t).withColumnRenamed("file_version_id", "file")
    held = seen.join(scored.select("file", "evidence"), "file").groupBy("task").agg(F.min("evidence").alias("evidence"))
    edges = graph.structural_edges(units(spark, d, "file_version_id", "parent_evidence_id", "start_line", "end_line"))
    named = lambda f: t.select("task", F.explode(f(F.col("question"))).alias("name"))
    return C.retrieve(seen, files, scored, asked, named(T.path_mentions), named(T.issue_symbols), held, edges).withColumn("sources", F.array_join("sources", "+"))


@query("""
WITH n AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings), s AS (SELECT q.vec_id AS query_id, b.label, round(list_dot_product(q.e, b.e) / (q.n * b.n), 6) AS score FROM n q, n b WHERE q.vec_id % 20 = 0)
SELECT query_id, label, max(score) AS score, row_number() OVER (PARTITION BY query_id ORDER BY max(score) DESC, label) AS rank FROM s GROUP BY query_id, label QUALIFY rank <= 5
""")
def dense_labels(spark, d):
    """Labels as files and vectors as their chunks: a label scores by its best vector. The search is run to the end, so
    that every label has its best."""
    e = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    every = R.dense_groups(e, "label", "embedding", q, "query_id", "q")
    return C.best_chunk(every, "query_id", "label", "score", 5)
