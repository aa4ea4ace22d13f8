"""Operators against hand-made fixtures."""

from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import coverage, folds, graph, intervals, metrics, ranking


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_terms(spark):
    df = spark.createDataFrame([("RefreshCache the stale_cache2 a B1 don't x",), (None,), ("",)], "t string")
    got = [r.x for r in df.select(T.retrieval_terms(F.col("t")).alias("x")).collect()]
    assert got == [["refresh", "cache", "stale", "cache2", "b1", "don"], [], []]
    assert spark.createDataFrame([("bb aaa cccc bb",)], "t string").select(T.query_terms(F.col("t"), 2).alias("x")).head().x == ["cccc", "aaa"]


def test_lines_like_splitlines(spark):
    for t in ["a\nb\r\nc\rd", "a\x0bb\x1cc d", "", "a\n", "\n\na", None]:
        got = spark.createDataFrame([(t,)], "t string").select(T.lines(F.col("t")).alias("x")).head().x
        assert got == (t or "").splitlines()


def test_paths_and_questions(spark):
    df = spark.createDataFrame([("src/a.py", "source"), ("tests/x/a.py", "test"), ("docs/a.md", "doc"), ("a/b.json", "resource"), ("vendor/a.js", "source"), ("README.md", "low_value"), ("x/fixtures/test_a.py", "low_value"), ("conftest.py", "test"), ("docs/whatsnew/v1.rst", "low_value"), (None, "source")], "p string, want string")
    assert all(r.c == r.want for r in df.select("want", T.path_category(F.col("p")).alias("c")).collect())
    q = spark.createDataFrame([("p", ["a", " ", None]), (None, None)], "p string, h array<string>").select(T.question(F.col("p"), F.col("h")).alias("q"))
    assert [r.q for r in q.collect()] == ["p\na", ""]
    h = spark.createDataFrame([("x" * 10 + "y" * 10,)], "t string").select(T.head_tail(F.col("t"), 8).alias("x")).head().x
    assert h == "xxxxxx\n...\nyy"


def test_rrf(spark):
    r = spark.createDataFrame([("q", "c1", "a", 1), ("q", "c1", "b", 2), ("q", "c2", "b", 1), ("q", "c2", "c", 2), ("q", "c2", "b", 5), ("q", "c4", "a", 1)], "query string, channel string, item string, pos int")
    got = ranking.rrf_protected(r, "query", "channel", "item", "pos").orderBy("rank").collect()
    assert [x.item for x in got] == ["a", "b", "c"] and abs(got[0].score - 2 / 65) < 1e-9 and got[0].sources == ["c1", "c4"]
    assert [x.item for x in ranking.rrf(r, "query", "channel", "item", "pos").orderBy("rank").collect()] == ["a", "b", "c"]
    shared = [("q", "bm25", "head", 1)] + [("q", "bm25", f"s{i:03}", i + 2) for i in range(63)] + [("q", "path", f"s{i:03}", i + 1) for i in range(64)]
    kept = ranking.rrf_protected(spark.createDataFrame(shared, r.schema), "query", "channel", "item", "pos", reserve=2, limit=16)
    assert "head" in {x.item for x in kept.collect()}


def test_bm25_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "refresh stale cache", 0), (2, "network socket", 0), (3, None, 0), (4, "cache cache", 0)], "id int, text string, score int")
    q = spark.createDataFrame([(9, "stale cache"), (8, None)], "q int, text string")
    got = rows(ranking.bm25(docs, "id", "text", q, "q", "text"), "q", "id", "rank")
    assert got == [(9, 1, 1), (9, 4, 2)]
    assert ranking.bm25(docs.limit(0), "id", "text", q, "q", "text").count() == 0


def test_dense(spark):
    base = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, None), (5, [0.0, 0.0])], "id int, v array<float>")
    q = spark.createDataFrame([(7, [2.0, 0.1])], "q int, w array<float>")
    assert rows(ranking.dense_topk(base, "id", "v", q, "q", "w", 2, block=1), "q", "id", "rank") == [(7, 1, 1), (7, 3, 2)]


def test_intervals(spark):
    s = spark.createDataFrame([("a", 10, 20), ("a", 12, 15), ("a", 18, 25), ("b", 1, 3), ("b", 4, 6), ("b", 8, 9)], "path string, s int, e int")
    assert rows(intervals.islands(s, ["path"], "s", "e"), "path", "s", "e") == [("a", 10, 25), ("b", 1, 6), ("b", 8, 9)]
    whole = spark.createDataFrame([("a", 1, 30), ("b", 1, 9), ("c", 1, 2)], "path string, first int, last int")
    assert rows(intervals.gaps(s, whole, ["path"], "s", "e"), "path", "s", "e") == [("a", 1, 9), ("a", 26, 30), ("b", 7, 7), ("c", 1, 2)]


def test_region_mapping(spark):
    r = spark.createDataFrame([("f", "r", 10, 25), ("f", "t", 90, 120), ("f", "none", 500, 501)], "f string, region string, rs int, re int")
    u = spark.createDataFrame([("f", "wide", 1, 100), ("f", "exact", 10, 25), ("f", "part", 20, 30), ("f", "late", 110, 130)], "f string, unit string, us int, ue int")
    args = (["f"], "region", "unit", "rs", "re", "us", "ue")
    for size in (7, 64):
        both = intervals.overlap_join(r, u, ["f"], "rs", "re", "us", "ue", bin_size=size)
        assert rows(both, "region", "unit", "shared") == [("r", "exact", 16), ("r", "part", 6), ("r", "wide", 16), ("t", "late", 11), ("t", "wide", 11)]
    assert rows(intervals.map_regions(r, u, *args), "region", "unit") == [("r", "exact"), ("t", "late"), ("t", "wide")]
    assert rows(intervals.best_anchor(r, u, *args), "region", "unit") == [("r", "exact"), ("t", "late")]


def test_coverage(spark):
    w = spark.createDataFrame([(1, "r1", "g1", "a"), (1, "r1", "g1", "b"), (1, "r1", "g2", "c"), (1, "r2", "g3", "d")], "t int, o string, g string, e string")
    o = spark.createDataFrame([(1, "r1", True), (1, "r2", False), (2, "r9", False)], "t int, o string, m boolean")
    for held, want in ((["a"], (0.0, 0.25, False)), (["a", "b", "d"], (1.0, 1.0, True)), (["c"], (1.0, 0.5, True))):
        k = spark.createDataFrame([(e,) for e in held], "e string")
        x = coverage.completion(o, coverage.obligation_coverage(coverage.group_coverage(w, k, "t", "o", "g", "e"), "t", "o"), "t", "o", "m")
        got = {r.t: (r.completion, r.progress, r.sufficient) for r in x.collect()}
        assert got[1] == want and got[2] == (None, 0.0, False)


def test_minimal_groups(spark):
    w = spark.createDataFrame([("o", "a", 1), ("o", "b", 1), ("o", "b", 2), ("o", "c", 2), ("o", "d", 2)], "o string, g string, e int")
    got = rows(coverage.minimal_groups(w, "o", "g", "e"), "g", "minimal", "duplicate")
    assert got == [("a", True, False), ("b", False, False), ("c", True, False), ("d", True, True)]


def test_minimal_groups_brute_force(spark):
    import random

    r = random.Random(2)
    w = [(r.choice("op"), r.randrange(40), r.randrange(9)) for _ in range(300)] + [("o", 50, None), ("o", 50, 1), ("o", 51, 1), ("o", 52, None), ("o", None, 1), (None, 1, 1), (None, 2, 1)]
    sets = {}
    for o, g, e in w:
        sets.setdefault((o, g), set()).add(e)
    inside = lambda o, h, g: None not in (o, h, g) and h != g and None not in sets[o, h] and sets[o, h] <= sets[o, g]
    want = {}
    for o, g in sets:
        below = [h for p, h in sets if p == o and inside(o, h, g)]
        want[o, g] = (not any(len(sets[o, h]) < len(sets[o, g]) for h in below), any(sets[o, h] == sets[o, g] and h < g for h in below))
    x = coverage.minimal_groups(spark.createDataFrame(w, "o string, g int, e int"), "o", "g", "e")
    got = x.collect()
    assert {(r.o, r.g): (r.minimal, r.duplicate) for r in got} == want and len(got) == len(want)


def test_whole_queries(spark, tmp_path):
    """No line, supplier or event is left out."""
    from corvane.plans import catalog

    spark.createDataFrame([(1, 1, 11, 1), (1, 5, 11, 2), (2, 5, 61, 2)], "l_orderkey int, l_linenumber int, l_suppkey int, l_partkey int").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert rows(catalog.QUERIES["minimal_groups"](spark, str(tmp_path)), "obligation", "grp", "minimal", "duplicate") == [(11, 1, False, False), (11, 2, True, False)]
    spark.createDataFrame([(1, 0, "a", 5.0), (2, 30, "a", 6.0), (4, 1, "a", 99.0)], "event_id int, user_id int, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    assert rows(catalog.QUERIES["group_consensus"](spark, str(tmp_path)), "slot", "status", "grp") == [(0, "a", -1)]


def test_folds(spark):
    w = spark.createDataFrame([(1, "r1", "g1", "a", 6), (1, "r1", "g1", "b", 5), (1, "r1", "g2", "c", 4)], "t int, o string, g string, e string, c int")
    assert folds.certificates(w, "t", "o", "g", "e", "c").head().certificate == ["c"]
    assert [r.evidence for r in folds.acquisition_order(w, "t", "o", "g", "e", "c").orderBy("step").collect()] == ["c"]
    items = spark.createDataFrame([([("x", 5), ("y", 9), ("z", 4)],), (None,)], "i array<struct<id:string,tokens:int>>")
    assert [r.k for r in items.select(folds.greedy_budget(F.col("i"), 10, 64).alias("k")).collect()] == [["x", "z"], None]


def test_retrieval_metrics(spark):
    r = spark.createDataFrame([("q", "x", 1), ("q", "a", 2), ("q", "b", 3)], "q string, i string, rank int")
    rel = spark.createDataFrame([("q", "a"), ("q", "c"), ("none", "z")], "q string, i string")
    got = {x.q: x for x in metrics.retrieval_metrics(r, rel, "q", "i", cutoffs=(2,)).collect()}
    assert got["q"].rr == 0.5 and got["q"].recall_2 == 0.5 and got["none"].rr == 0.0 and got["none"].ndcg_2 == 0.0
    only = metrics.retrieval_metrics(r.where("rank < 3"), rel.where("i = 'a'"), "q", "i", cutoffs=(2,)).head()
    assert abs(only.ndcg_2 - 0.63093) < 1e-5


def test_auc_and_votes(spark):
    p = spark.createDataFrame([("a", 0.0, 0.0), ("a", 10.0, 1.0), ("b", 5.0, 0.2), ("b", 5.0, 0.8)], "k string, c double, s double")
    assert rows(metrics.auc(p, ["k"], "c", "s"), "k", "auc") == [("a", 0.5), ("b", 0.2)]
    v = spark.createDataFrame([(1, "keep"), (1, "keep"), (1, "drop"), (2, "x"), (2, "y")], "t int, d string")
    assert {r.t: r.d for r in metrics.majority(v, ["t"], "d").collect()} == {1: "keep", 2: None}


def test_trajectories(spark):
    s = spark.createDataFrame([("a", 1, "add", False, 5.0), ("a", 2, "add", True, 6.0), ("a", 3, "add", True, 7.0), ("a", 4, "stop", True, 0.0), ("b", 1, "add", False, 1.0)], "r string, n int, k string, ok boolean, t double")
    got = {x.r: x for x in metrics.trajectories(s, "r", ["n"], "k", "stop", "ok", "t").collect()}
    assert (got["a"].late_steps, got["a"].late_tokens, got["a"].success, got["a"].premature_stop) == (1, 7.0, True, False)
    assert got["b"].never_stop and not got["b"].success


def test_latest_and_common(spark):
    t = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", None)], "k int, v string, n int")
    assert rows(metrics.latest(t, ["k"], [F.col("n")]), "k", "v") == [(1, "b"), (2, "c")]
    c = spark.createDataFrame([("t1", "x"), ("t1", "y"), ("t2", "x")], "t string, r string")
    assert rows(metrics.common_tasks(c, "t", "r"), "t") == [("t1",)]


def test_graph(spark):
    u = spark.createDataFrame([("f", "a", None, 1, 1), ("f", "b", "a", 2, 2), ("f", "c", None, 3, 3)], "file_version_id string, evidence_id string, parent_evidence_id string, start_line int, end_line int")
    assert rows(graph.structural_edges(u), "source", "target") == [("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")]
    got = {r.evidence_id: r.score for r in graph.expand(u.where("evidence_id = 'b'"), u).collect()}
    assert got == {"a": 4.5, "c": 0.5}
    assert graph.structural_edges(u.limit(0)).count() == 0


def test_bm25_makes_no_pairs(spark, monkeypatch):
    """Scores by brute force, with ties, a repeated document, chunks and blocks; queries never meet documents as rows."""
    import math
    import random
    from collections import Counter

    r = random.Random(5)
    words = [f"word{chr(97 + i)}" for i in range(12)]
    data = [(i, " ".join(r.choices(words, k=r.randint(1, 9)))) for i in range(300)] + [(7, "worda wordb"), (7, "worda wordc"), (400, None)]
    docs = spark.createDataFrame(data, "id long, text string")
    q = docs.where("id % 20 = 1").withColumnsRenamed({"id": "q", "text": "question"})
    tf = Counter()
    split = [(i, (t or "").split()) for i, t in data]
    n, mean = len(split), sum(len(t) for _, t in split) / len(split)
    for i, t in split:
        tf.update((i, len(t), w) for w in t)
    df = Counter(w for _, _, w in tf)
    want = []
    for k, t in ((i, t) for i, t in split if i % 20 == 1):
        score = Counter()
        for (i, length, w), c in tf.items():
            if w in set(t):
                score[i] += math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * length / mean))
        best = sorted((-round(s, 6), i) for i, s in score.items())[:20]
        want += [(k, i, -s, p + 1) for p, (s, i) in enumerate(best)]
    for kind in ("long", "string"):
        d = docs.withColumn("id", F.col("id").cast(kind) if kind == "long" else F.lpad(F.col("id").cast(kind), 3, "0"))
        out = ranking.bm25(d, "id", "text", q, "q", "question", 20, block=5, chunk=100)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "Join" not in plan
        got = sorted((x.q, int(x.id), x.score, x.rank) for x in out.collect())
        assert [(x[0], x[1], round(x[2], 5), x[3]) for x in got] == [(x[0], x[1], round(x[2], 5), x[3]) for x in sorted(want)]
