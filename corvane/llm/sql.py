"""SQL equivalents of the queries on training data, where SQL can express them."""

SQL = {
    "p1_found": r"""
SELECT DISTINCT evidence_id FROM evidence
WHERE unit_type <> 'file' AND len(regexp_extract_all('[PATH] ' || path || chr(10) || '[TYPE] ' || unit_type || chr(10) || '[LINES] ' || start_line || '-' || end_line || chr(10)
  || coalesce('[SYMBOL] ' || symbol || chr(10), '') || '[CONTENT]' || chr(10) || coalesce(content, ''), '[A-Za-z0-9_]+|[^ \t\n\r\f\v]')) > 1024
""",
    "p2_found": r"""
WITH w AS (SELECT DISTINCT task_id, split, regexp_extract_all(lower(problem_statement), '[a-z0-9]+') AS words FROM normalize_swebench_task WHERE problem_statement IS NOT NULL),
g AS (SELECT DISTINCT task_id, split, unnest(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) AS gram FROM w WHERE len(words) >= 3),
n AS (SELECT task_id, split, count(*) AS n FROM g GROUP BY ALL),
b AS (SELECT e.task_id AS e, t.task_id AS t, count(*) AS shared FROM g e JOIN g t ON e.gram = t.gram AND e.split <> 'train' AND t.split = 'train' GROUP BY ALL)
SELECT DISTINCT least(e, t) AS task_id_a, greatest(e, t) AS task_id_b
FROM b JOIN n x ON x.task_id = e AND x.split <> 'train' JOIN n y ON y.task_id = t AND y.split = 'train'
WHERE shared >= 0.6 * (x.n + y.n - shared) AND e <> t
""",
    "p3_found": r"""
WITH u AS (SELECT DISTINCT evidence_id, file_version_id, unit_type, regexp_extract_all(content, '[A-Za-z0-9_]+|[^ \t\n\r\f\v]') AS tokens FROM evidence),
k AS (SELECT *, sha256(unit_type || chr(31) || array_to_string(tokens, chr(31))) AS class FROM u WHERE len(tokens) >= 40),
c AS (SELECT class, any_value(unit_type) AS unit_type, any_value(tokens) AS tokens FROM k GROUP BY class),
g AS (SELECT DISTINCT class, unit_type, unnest(list_transform(range(1, len(tokens) - 1), lambda i: hash(tokens[i] || chr(31) || tokens[i + 1] || chr(31) || tokens[i + 2]))) AS gram FROM c),
n AS (SELECT class, count(*) AS n FROM g GROUP BY ALL),
f AS (SELECT gram, count(*) AS df FROM g GROUP BY ALL),
r AS (SELECT g.class, g.unit_type, g.gram, row_number() OVER (PARTITION BY g.class ORDER BY df, gram) AS rank, n FROM g JOIN f USING (gram) JOIN n USING (class)),
p AS (SELECT * FROM r WHERE rank <= n - ceil(0.7 * n) + 1),
m AS (SELECT DISTINCT a.class AS a, b.class AS b FROM p a JOIN p b ON a.gram = b.gram AND a.unit_type = b.unit_type AND a.class < b.class AND least(a.n, b.n) >= 0.7 * greatest(a.n, b.n)),
s AS (SELECT a, b, count(*) AS shared FROM m JOIN g x ON x.class = a JOIN g y ON y.class = b AND y.gram = x.gram GROUP BY ALL),
l AS (SELECT a, b FROM s JOIN n x ON x.class = a JOIN n y ON y.class = b WHERE shared >= 0.7 * (x.n + y.n - shared) UNION SELECT class, class FROM c)
SELECT DISTINCT least(x.evidence_id, y.evidence_id) AS evidence_id_a, greatest(x.evidence_id, y.evidence_id) AS evidence_id_b
FROM l JOIN k x ON x.class = a JOIN k y ON y.class = b WHERE x.file_version_id <> y.file_version_id AND x.evidence_id <> y.evidence_id
""",
}
