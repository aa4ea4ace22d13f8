"""Queries on the corpus of versioned files and its units."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import graph, intervals
from corvane.plans.registry import query
from corvane.plans.views import TASKS_SQL, UNITS_SQL, tasks, units
from corvane.sources.tables import table

# The words are written out here again, so that the SQL does not depend on the engine's own list.
_STOP = "the and for with from that this when then into does not are was were have has should error issue bug fix using use return python"
SPLIT = "list_filter(list_transform(regexp_extract_all(replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '_', ' '), '[A-Za-z][A-Za-z0-9]+'), lambda w: lower(w)), lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in _STOP.split()) + "))"
MENTION_SQL = "([A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)+\\.(?:pyi|py|tsx|ts|jsx|js|java|go|rst|rs|cpp|cc|c|hpp|h|rb|php|cs|scala|kts|kt|toml|yaml|yml|json|ini|cfg|md))"
_AT_SPANS = f"WITH {UNITS_SQL}, s AS (SELECT file_version_id, start_line AS a, end_line AS b, evidence_id, unit_type FROM units), f AS (SELECT file_version_id, min(start_line) AS first, max(end_line) AS last FROM units WHERE unit_type = 'file' GROUP BY 1)"


@query(f"""
{_AT_SPANS}, p AS (SELECT *, max(b) OVER (PARTITION BY file_version_id ORDER BY a, b, evidence_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM s WHERE unit_type NOT IN ('file', 'class')),
i AS (SELECT *, sum(CASE WHEN upto IS NULL OR a > upto + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY file_version_id ORDER BY a, b, evidence_id ROWS UNBOUNDED PRECEDING) AS k FROM p)
SELECT file_version_id, min(a) AS start_line, max(b) AS end_line, count(*) AS members FROM i GROUP BY file_version_id, k
""")
def islands_merge(spark, d):
    u = units(spark, d, "file_version_id", "start_line", "end_line", "unit_type").where("unit_type not in ('file', 'class')")
    return intervals.islands(u, ["file_version_id"], "start_line", "end_line")


@query(f"""
{_AT_SPANS}, x AS (SELECT DISTINCT s.file_version_id, unnest(range(a, b + 1)) AS line FROM s WHERE unit_type <> 'file'),
y AS (SELECT file_version_id, unnest(range(first, last + 1)) AS line FROM f), z AS (SELECT * FROM y ANTI JOIN x USING (file_version_id, line)),
g AS (SELECT *, line - row_number() OVER (PARTITION BY file_version_id ORDER BY line) AS k FROM z)
SELECT file_version_id, CAST(min(line) AS INT) AS start_line, CAST(max(line) AS INT) AS end_line FROM g GROUP BY file_version_id, k
""")
def gaps_complement(spark, d):
    """Line ranges of a file that no unit but the file itself covers."""
    u = units(spark, d, "file_version_id", "start_line", "end_line", "unit_type")
    whole = u.where("unit_type = 'file'").groupBy("file_version_id").agg(F.min("start_line").alias("first"), F.max("end_line").alias("last"))
    parts = u.where("unit_type <> 'file'").join(whole.select("file_version_id"), "file_version_id", "left_semi")
    return intervals.gaps(parts, whole, ["file_version_id"], "start_line", "end_line")


_REGIONS = ", r AS (SELECT evidence_id AS region_id, file_version_id, start_line + 1 AS rs, end_line AS re FROM units WHERE unit_type = 'function' AND end_line > start_line), u AS (SELECT evidence_id, file_version_id, start_line AS us, end_line AS ue FROM units WHERE unit_type IN ('class', 'code_block', 'file'))"


def _regions(spark, d):
    u = units(spark, d, "file_version_id", "start_line", "end_line", "unit_type")
    regions = u.where("unit_type = 'function' and end_line > start_line").select(F.col("evidence_id").alias("region_id"), "file_version_id", (F.col("start_line") + 1).alias("rs"), F.col("end_line").alias("re"))
    return regions, u.where("unit_type in ('class', 'code_block', 'file')").select("evidence_id", "file_version_id", F.col("start_line").alias("us"), F.col("end_line").alias("ue"))


@query(f"WITH {UNITS_SQL}{_REGIONS} SELECT region_id, evidence_id, CAST(least(re, ue) - greatest(rs, us) + 1 AS INT) AS shared FROM r JOIN u USING (file_version_id) WHERE rs <= ue AND us <= re")
def overlap_join(spark, d):
    r, u = _regions(spark, d)
    return intervals.overlap_join(r, u, ["file_version_id"], "rs", "re", "us", "ue").select("region_id", "evidence_id", F.col("shared").cast("int").alias("shared"))


@query(f"""
WITH {UNITS_SQL}{_REGIONS}, h AS (SELECT region_id, evidence_id, us <= rs AND ue >= re AS inside, ue - us AS span FROM r JOIN u USING (file_version_id) WHERE rs <= ue AND us <= re),
k AS (SELECT *, max(inside::INT) OVER (PARTITION BY region_id) AS contained, row_number() OVER (PARTITION BY region_id ORDER BY inside DESC, span, evidence_id) AS n FROM h)
SELECT DISTINCT region_id, evidence_id FROM k WHERE contained = 0 OR (inside AND n = 1)
""")
def smallest_containing(spark, d):
    r, u = _regions(spark, d)
    return intervals.map_regions(r, u, ["file_version_id"], "region_id", "evidence_id", "rs", "re", "us", "ue")


@query(f"""
WITH {UNITS_SQL}{_REGIONS}, h AS (SELECT region_id, evidence_id, CAST(least(re, ue) - greatest(rs, us) + 1 AS INT) AS shared, ue - us AS span FROM r JOIN u USING (file_version_id) WHERE rs <= ue AND us <= re)
SELECT region_id, evidence_id, shared FROM h QUALIFY row_number() OVER (PARTITION BY region_id ORDER BY shared DESC, span, evidence_id) = 1
""")
def best_anchor(spark, d):
    r, u = _regions(spark, d)
    return intervals.best_anchor(r, u, ["file_version_id"], "region_id", "evidence_id", "rs", "re", "us", "ue").select("region_id", "evidence_id", F.col("shared").cast("int").alias("shared"))


@query(f"""
WITH {UNITS_SQL}, p AS (SELECT evidence_id AS a, parent_evidence_id AS b FROM units WHERE parent_evidence_id IN (SELECT evidence_id FROM units)
UNION ALL SELECT a, b FROM (SELECT evidence_id AS a, lead(evidence_id) OVER (PARTITION BY file_version_id ORDER BY start_line, end_line, evidence_id) AS b FROM units) WHERE b IS NOT NULL)
SELECT a AS source, b AS target FROM p UNION SELECT b, a FROM p
""")
def structural_edges(spark, d):
    return graph.structural_edges(units(spark, d, "file_version_id", "parent_evidence_id", "start_line", "end_line"))


@query(f"""
WITH {UNITS_SQL}, u AS (SELECT evidence_id AS id, file_version_id AS f, parent_evidence_id AS up, start_line AS at FROM units),
i AS (SELECT DISTINCT repo, file_version_id AS importer, replace(unnest(regexp_extract_all(content, '(?m)^(?:from|import) ([a-z_0-9]+(?:\\.[a-z_0-9]+)*)', 1)), '.', '/') AS module FROM units WHERE unit_type = 'file' AND ends_with(path, '.py')),
l AS (SELECT DISTINCT importer, f.file_version_id AS imported FROM i JOIN file_versions f ON f.repo = i.repo AND (f.path = module || '.py' OR ends_with(f.path, '/' || module || '.py') OR f.path = module || '/__init__.py' OR ends_with(f.path, '/' || module || '/__init__.py'))),
w AS (SELECT s.id AS seed, u.id, 4.0 AS w, 'parent' AS r FROM u s JOIN u ON s.up = u.id UNION ALL SELECT s.id, u.id, 3.0, 'child' FROM u s JOIN u ON u.up = s.id UNION ALL SELECT s.id, u.id, 2.0, 'sibling' FROM u s JOIN u ON u.up = s.up AND u.id <> s.id
UNION ALL SELECT seed, id, 1.0 / (1 + far), 'same_file' FROM (SELECT s.id AS seed, u.id AS id, abs(u.at - s.at) AS far, row_number() OVER (PARTITION BY s.id ORDER BY abs(u.at - s.at), u.id) AS n FROM u s JOIN u ON u.f = s.f AND u.id <> s.id) WHERE n <= 8
UNION ALL SELECT s.id, x.id, 2.5, 'import' FROM u s JOIN l ON l.importer = s.f JOIN (SELECT f, id, row_number() OVER (PARTITION BY f ORDER BY u.at, u.id) AS n FROM u) x ON x.f = l.imported AND n <= 4 WHERE x.id <> s.id)
SELECT seed, id AS evidence_id, round(sum(w)::DOUBLE, 6) AS score, array_to_string(list_sort(list_distinct(list(r))), '+') AS relations FROM w GROUP BY ALL
""")
def one_hop_expansion(spark, d):
    """What every unit reaches in one hop, imports among it."""
    from corvane.plans.pipelines import import_resolution

    u = units(spark, d, "file_version_id", "parent_evidence_id", "start_line")
    return graph.expand(u, u, import_resolution(spark, d))


@query(f"WITH {UNITS_SQL}, t AS (SELECT unnest({SPLIT.format('content')}) AS term, evidence_id FROM units) SELECT term, count(*) AS uses, count(DISTINCT evidence_id) AS units FROM t GROUP BY term")
def term_statistics(spark, d):
    u = units(spark, d, "content")
    t = u.select("evidence_id", F.explode(T.retrieval_terms(F.col("content"))).alias("term")).groupBy("term", "evidence_id").agg(F.count("*").alias("n"))
    return t.groupBy("term").agg(F.sum("n").alias("uses"), F.count("*").alias("units"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z_][A-Za-z0-9_]{2,}'), lambda w: lower(w)))), ' ') AS terms FROM documents")
def light_terms(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.light_terms(F.col("text")), " ").alias("terms"))


@query("""
WITH p AS (SELECT '/' || lower(path) AS p, regexp_extract(lower(path), '[^/]*$') AS name, language FROM file_versions), x AS (SELECT *, regexp_replace(name, '(.)[.][^.]+$', '\\1') AS stem, regexp_extract(name, '.[.]([^.]+)$', 1) AS ext FROM p)
SELECT CASE WHEN regexp_matches(p, '/(fixtures?|test_data|testdata)/') THEN 'low_value' WHEN regexp_matches(p, '/(tests?|testing)/') OR starts_with(name, 'test_') OR ends_with(name, '_test.py') OR name = 'conftest.py' THEN 'test'
WHEN stem IN ('readme', 'contributing', 'changelog', 'changes', 'authors', 'license') OR regexp_matches(p, '/(whatsnew|changelog|changes)/') THEN 'low_value' WHEN regexp_matches(p, '/(docs?|documentation)/') OR ext IN ('md', 'markdown', 'rst', 'txt') THEN 'doc'
WHEN ext IN ('csv', 'tsv', 'json', 'yaml', 'yml', 'xml', 'npy', 'npz', 'pkl', 'pickle', 'parquet', 'h5', 'hdf5', 'mat', 'dat', 'bin', 'geojson', 'png', 'jpg', 'jpeg', 'gif', 'svg', 'webp') THEN 'resource' ELSE 'source' END AS category,
coalesce(language, 'unknown') AS language, count(*) AS files FROM x GROUP BY ALL
""")
def path_categories(spark, d):
    return table(spark, d, "file_versions").groupBy(T.path_category(F.col("path")).alias("category"), F.coalesce("language", F.lit("unknown")).alias("language")).agg(F.count("*").alias("files"))


@query("""
SELECT CASE regexp_extract(lower(path), '[^/][.]([^./]+)$', 1) WHEN 'py' THEN 'python' WHEN 'pyi' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'mjs' THEN 'javascript' WHEN 'cjs' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript'
WHEN 'java' THEN 'java' WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' WHEN 'c' THEN 'c' WHEN 'h' THEN 'c' WHEN 'cc' THEN 'cpp' WHEN 'cpp' THEN 'cpp' WHEN 'cxx' THEN 'cpp' WHEN 'hpp' THEN 'cpp' WHEN 'cs' THEN 'csharp' WHEN 'rb' THEN 'ruby' WHEN 'php' THEN 'php' WHEN 'swift' THEN 'swift'
WHEN 'kt' THEN 'kotlin' WHEN 'kts' THEN 'kotlin' WHEN 'scala' THEN 'scala' WHEN 'sh' THEN 'shell' WHEN 'bash' THEN 'shell' WHEN 'md' THEN 'markdown' WHEN 'rst' THEN 'rst' WHEN 'toml' THEN 'toml' WHEN 'yaml' THEN 'yaml' WHEN 'yml' THEN 'yaml' WHEN 'json' THEN 'json' WHEN 'xml' THEN 'xml'
WHEN 'html' THEN 'html' WHEN 'css' THEN 'css' WHEN 'sql' THEN 'sql' ELSE 'text' END AS language, count(*) AS files FROM file_versions GROUP BY ALL
""")
def languages(spark, d):
    return table(spark, d, "file_versions").groupBy(T.language_of(F.col("path")).alias("language")).agg(F.count("*").alias("files"))


@query(f"""
WITH {TASKS_SQL}, q AS (SELECT DISTINCT task_id, snapshot_id, unnest(regexp_extract_all(coalesce(problem_statement, ''), '{MENTION_SQL}', 1)) AS path FROM tasks)
SELECT DISTINCT task_id, q.path, m.file_version_id FROM q JOIN snapshot_membership m USING (snapshot_id) WHERE lower(m.path) = lower(q.path) OR ends_with(lower(m.path), '/' || lower(q.path))
""")
def mentioned_files(spark, d):
    """Files of a task's snapshot that its statement names by whole path or by a path's end, as equi-joins on ends."""
    q = tasks(spark, d, "snapshot_id", "problem_statement").select("task_id", "snapshot_id", F.explode(T.path_mentions(F.col("problem_statement"))).alias("path"))
    parts = F.split(F.lower("path"), "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))
    m = table(spark, d, "snapshot_membership").select("snapshot_id", "file_version_id", F.explode(ends).alias("end")).distinct()
    return q.withColumn("end", F.lower("path")).join(m, ["snapshot_id", "end"]).select("task_id", "path", "file_version_id").distinct()


@query(f"WITH {TASKS_SQL} SELECT task_id, split, concat_ws(chr(10), coalesce(problem_statement, ''), CASE WHEN len(list_filter(coalesce(hints, []), lambda h: trim(h) <> '')) > 0 THEN array_to_string(list_filter(hints, lambda h: trim(h) <> ''), chr(10)) END) AS question FROM tasks")
def online_questions(spark, d):
    return tasks(spark, d, "split", "problem_statement", "hints").select("task_id", "split", T.question(F.col("problem_statement"), F.col("hints")).alias("question"))


@query(f"""
WITH {UNITS_SQL}, f AS (SELECT file_version_id, string_split(content, chr(10)) AS ls FROM units WHERE unit_type = 'file')
SELECT u.evidence_id, array_to_string(list_slice(ls, start_line, end_line), chr(10)) = content AS same FROM units u JOIN f USING (file_version_id) WHERE start_line >= 1 AND end_line >= start_line AND end_line <= len(ls)
""")
def body_reconstruction(spark, d):
    """Whether a unit's content is what its line range cuts out of the file."""
    u = units(spark, d, "file_version_id", "unit_type", "start_line", "end_line", "content")
    f = u.where("unit_type = 'file'").select("file_version_id", F.col("content").alias("text"))
    cut = T.line_slice(F.col("text"), F.col("start_line"), F.col("end_line"))
    return u.join(f, "file_version_id").where(cut.isNotNull()).select("evidence_id", (cut == F.col("content")).alias("same"))


@query(f"WITH {UNITS_SQL} SELECT repo, unit_type, count(*) AS units, sum(end_line - start_line + 1)::BIGINT AS lines, round(avg(length(content)), 6) AS mean_chars, count(CASE WHEN scoreable THEN 1 END) AS scoreable FROM units GROUP BY ALL")
def corpus_statistics(spark, d):
    u = units(spark, d, "repo", "unit_type", "start_line", "end_line", "scoreable", F.length("content").alias("chars"))
    return u.groupBy("repo", "unit_type").agg(
        F.count("*").alias("units"), F.sum((F.col("end_line") - F.col("start_line") + 1).cast("long")).alias("lines"), F.round(F.avg("chars"), 6).alias("mean_chars"), F.count(F.when(F.col("scoreable"), 1)).alias("scoreable"))
