"""Release utilities, records and merges on small cases."""

import os

import pytest
from pyspark.sql import functions as F

from corvane.functions import records as R
from corvane.functions import text as T
from corvane.operators import assembly as A
from corvane.operators import channels as C
from corvane.operators import folds, merge, selection
from corvane.operators import ranking as K
from corvane.sources import release, sinks


def one(spark, values, f):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r.x for r in df.orderBy("i").select(f(F.col("t")).alias("x")).collect()]


def test_parts(tmp_path):
    data = os.urandom(250_000)
    (tmp_path / "x.bin").write_bytes(data)
    m = release.split_parts(str(tmp_path / "x.bin"), str(tmp_path / "p"), 100_000)
    assert [p["bytes"] for p in m["parts"]] == [100_000, 100_000, 50_000] and m["sha256"] == release.sha256_file(str(tmp_path / "x.bin"))
    release.merge_parts(m, str(tmp_path / "p"), str(tmp_path / "y.bin"))
    assert (tmp_path / "y.bin").read_bytes() == data
    (tmp_path / "p" / m["parts"][1]["name"]).write_bytes(b"z")
    with pytest.raises(ValueError):
        release.merge_parts(m, str(tmp_path / "p"), str(tmp_path / "z.bin"))
    assert not (tmp_path / "z.bin").exists()
    (tmp_path / "empty").write_bytes(b"")
    assert release.split_parts(str(tmp_path / "empty"), str(tmp_path / "q"))["bytes"] == 0
    a = release.sha256_folder(str(tmp_path / "p"))
    (tmp_path / "p" / "more").write_bytes(b"")
    assert a != release.sha256_folder(str(tmp_path / "p"))


def test_staged_audit(spark, tmp_path):
    r = sinks.write_stream(spark.range(5), str(tmp_path / "t"))
    assert release.staged_audit(spark, [r], {"t": "struct<id:bigint>"}) == []
    codes = [x["code"] for x in release.staged_audit(spark, [{**r, "rows": 4, "bytes": 1}, {**r, "path": str(tmp_path / "none")}], {"t": "struct<id:int>"})]
    assert codes == ["SCHEMA", "ROWS", "BYTES", "MISSING"]
    assert release.digests(spark, str(tmp_path / "t")).where("length(sha256) = 64").count() >= 1


def test_views(spark):
    df = spark.createDataFrame([("a", "train", None), ("b", "test", "p")], "task_id string, split string, gold_patch string")
    assert [tuple(r) for r in release.offline_view(df, "train").select("task_id", "gold_patch").collect()] == [("a", "")]
    with pytest.raises(ValueError):
        release.required(df, ["task_id", "nothing"])
    with pytest.raises(Exception, match="repeated key"):
        release.unique_or_fail(df.union(df), "task_id").collect()
    new = spark.createDataFrame([("b", "x", "1"), ("c", "x", "2"), ("c", "y", "1")], df.schema)
    assert sorted((r.task_id, r.split) for r in release.insert_new(df, new, ["task_id"], [F.col("gold_patch")]).collect()) == [("a", "train"), ("b", "test"), ("c", "y")]
    acts = spark.createDataFrame([("s", "stop"), ("s", "single"), ("t", "stop"), ("t", "stop"), ("x", "single")], "state_id string, action_type string")
    states = spark.createDataFrame([("s",), ("t",), ("u",)], "state_id string")
    assert sorted(map(tuple, release.orphans(acts, states).collect())) == [("ORPHAN_ACTION", "x"), ("STOP_COUNT", "t"), ("STOP_COUNT", "u")]


def test_records(spark):
    assert one(spark, ["https://github.com/a/b.git", "git@github.com:a/b", "a", "a\\b/", None], R.repo_name) == ["a/b", "a/b", None, "a/b", None]
    assert one(spark, ['["a", " b ", ""]', "plain", "null", '"q"', "[broken", "5", None, ""], R.hint_list) == [["a", "b"], ["plain"], [], ["q"], ["[broken"], ["5"], [], []]
    assert one(spark, ['```json\n{"a":1}\n```', " x "], R.unfenced) == ['{"a":1}', "x"]
    assert one(spark, ['x {"a": 1} y', "no", None], lambda c: R.salvaged_json(c).cast("string")) == ['{"a":1}', None, None]
    assert [str(x) if x else x for x in one(spark, ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05+02:00", "2024-01-02 03:04:05", "x", None], R.utc_time)] == ["2024-01-02 03:04:05", "2024-01-02 01:04:05", "2024-01-02 03:04:05", None, None]
    assert one(spark, ["A b/c:d"], R.file_label) == ["A-b-c-d"] and one(spark, [" a  b\n"], R.review_label) == ["A B"]
    assert one(spark, ["a.cxx", "b.kts", "c.rst", "d.ini", ".py", "x/y.PY", None], T.language_of) == ["cpp", "kotlin", "rst", "text", "text", "python", "text"]
    assert one(spark, ["see src/a.py and b.py, x/y.zzz a/b.pyi"], T.path_mentions) == [["src/a.py", "a/b.pyi"]]
    assert one(spark, ['call `foo.bar` and baz_qux(1) in\n  File "a.py", line 3, in deep_fn\nclass Data SELECT(x) file.sql(1) self.Foo.bar()', None], T.issue_symbols) == [["foo.bar", "baz_qux", "deep_fn", "Data"], []]
    df = spark.createDataFrame([("k", '[{"path":"./a.py","start_line":1,"end_line":3}]'), ("m", '{"x":[{"path":"b","start_line":2,"end_line":1},{"path":"b","start_line":2,"end_line":5}]}'), ("n", "z")], "k string, p string")
    assert sorted(map(tuple, R.region_list(df, "k", "p").collect())) == [("k", "a.py", 1, 3), ("m", "b", 2, 5)]
    raw = "instance_id string, repo string, base_commit string, problem_statement string, hints_text string, language string, created_at string, upstream_split string"
    good, bad = R.tasks_of(spark.createDataFrame([("i1", "a/b", "ABC", "p", '["h"]', None, "2020", "dev"), ("", "a/b", "c", "p", None, None, None, "test"), ("i3", "a", "c", "p", None, None, None, "x")], raw))
    g = good.head()
    assert (g.repo, g.base_commit, g.hints, g.split, g.language, len(g.task_id)) == ("a/b", "abc", ["h"], "validation", "unknown", 29)
    assert sorted((r.issue_id, r.lacks) for r in bad.collect()) == [("", "instance_id"), ("i3", "repo")]
    assert spark.range(1).select(R.stable_json({"z": F.lit(1), "a": F.array(F.lit("x"))}).alias("j")).head().j == '{"a":["x"],"z":1}'


def test_renderings(spark):
    from corvane.functions import render

    row = "struct<evidence_id:string,path:string,unit_type:string,symbol:string,qualified_name:string,start_line:int,end_line:int,content:string>"
    a, b = ("e1", "a.py", "method", "f", "A.f", 1, 2, "x"), ("e2", "b.py", "code_block", None, None, 3, 3, "y")
    df = spark.createDataFrame([([a, b], ["e2"], [a]), ([], [], [])], f"held array<{row}>, ids array<string>, next array<{row}>")
    got = df.select(render.action(F.lit("q"), F.col("held"), F.col("ids"), F.col("next")).alias("a"), render.state(F.col("held"), F.col("ids")).alias("s"), render.package(F.col("held")).alias("p")).collect()
    full, empty = max(got, key=lambda r: len(r.a)), min(got, key=lambda r: len(r.a))
    assert full.a == ("[QUESTION]\nq\n\n[CURRENT EVIDENCE METADATA]\n[EVIDENCE_META] id=e1 path=a.py type=method symbol=f lines=1-2\n[EVIDENCE_META] id=e2 path=b.py type=code_block symbol=None lines=3-3"
                      "\n\n[CURRENT EVIDENCE BODY]\n[STATE BODY] evidence_id=e2\ny\n\n[CANDIDATE ACTION]\n[PATH] a.py\n[TYPE] method\n[LINES] 1-2\n[SYMBOL] f\n[CONTENT]\nx")  # fmt: skip
    assert empty.a == "[QUESTION]\nq\n\n[CURRENT EVIDENCE METADATA]\n[EMPTY]\n\n[CURRENT EVIDENCE BODY]\n[NONE]\n\n[CANDIDATE ACTION]\n[STOP]"
    assert full.s == "Evidence ID：e1\n位置：a.py:1-2\n类型：method\n符号：A.f\n[正文因 Planner 上下文预算省略]\n\n---\n\nEvidence ID：e2\n位置：b.py:3-3\n类型：code_block\n符号：\ny" and empty.s == "[EMPTY]"
    assert full.p == "证据 ID：e1\n位置：a.py:1-2\n类型：method\nx\n\n---\n\n证据 ID：e2\n位置：b.py:3-3\n类型：code_block\ny" and empty.p == ""


def test_channels(spark):
    u = spark.createDataFrame([("e_cache", "cache/refresh.py", "refresh_cache", "refresh the stale cache cache"), ("e_test", "tests/test_cache.py", "test_refresh", "refresh stale cache"), ("e_net", "net.py", "send", "send a packet")], "evidence string, path string, symbol string, content string")
    tasks = spark.createDataFrame([("t", "refresh stale cache")], "task string, question string")
    universe = u.selectExpr("'t' as task", "evidence")
    held = spark.createDataFrame([("t", "e_test")], "task string, evidence string")
    edges = spark.createDataFrame([("e_test", "e_cache")], "source string, target string")
    asked = C.asked_terms(tasks)
    got = sorted((r.channel, r.rank, r.evidence) for r in C.four_channels(universe, u, asked, held, edges).collect())
    assert got == [(c, 1, "e_cache") for c in ("bm25_content", "path_name", "structure", "symbol")]
    again = sorted((r.channel, r.rank, r.evidence) for r in C.channels_for_state(C.query_channels(universe, u, asked), universe, held, edges).collect())
    assert again == got
    names = spark.createDataFrame([("t", "Refresh.py"), ("t", "NET.py")], "task string, name string")
    over = {r.evidence: r.score for r in C.overlap(universe, u, F.col("path"), asked, names).collect()}
    assert over == {"e_cache": 4, "e_test": 1, "e_net": 6}


def test_blocked_search_is_the_same(spark):
    import random

    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1) for _ in range(6)], i % 5) for i in range(300)] + [(300, [0.0] * 6, 1), (301, None, 1)]
    base = spark.createDataFrame(rows, "id long, v array<double>, g int")
    q = base.where("id % 3 = 0").select(F.col("id").alias("q"), F.col("v").alias("w"))
    a = sorted(map(tuple, K.dense_topk(base, "id", "v", q, "q", "w", 4).collect()))
    assert sorted(map(tuple, K.dense_topk(base, "id", "v", q, "q", "w", 4, block=20, chunk=70).collect())) == a and len(a) == 101 * 4
    g = sorted(map(tuple, K.dense_groups(base, "g", "v", q, "q", "w").collect()))
    assert sorted(map(tuple, K.dense_groups(base, "g", "v", q, "q", "w", block=20, chunk=70).collect())) == g and len(g) == 101 * 5


def test_quota_pages(spark):
    import random

    r = random.Random(4)
    rows = [(i % 3, i, f"f{r.randrange(9)}", r.choice("abc"), s, s + r.randrange(1, 30)) for i in range(400) for s in [r.randrange(200)]]
    df = spark.createDataFrame(rows, "t int, i int, f string, c string, a int, b int")

    def walk(own):
        out, files, used = [], {}, {}
        for _, i, f, c, a, b in sorted(own, key=lambda x: (x[5] - x[4], x[1])):
            if len(out) == 20:
                break
            if len(files.get(f, [])) >= 4 or used.get(c, 0) >= {"a": 5}.get(c, 20) or any(min(b, y) - max(a, x) + 1 >= 0.65 * min(b - a + 1, y - x + 1) for x, y in files.get(f, [])):
                continue
            files.setdefault(f, []).append((a, b))
            used[c] = used.get(c, 0) + 1
            out.append(i)
        return out

    want = sorted((t, i, k + 1) for t in range(3) for k, i in enumerate(walk([x for x in rows if x[0] == t])))
    for page in (7, 1000):
        got = selection.quota_select(df, "t", "i", "f", "c", "a", "b", [F.col("b") - F.col("a")], limit=20, quotas={"a": 5}, page=page)
        assert sorted(map(tuple, got.collect())) == want
    assert selection.quota_select(df.limit(0), "t", "i", "f", "c", "a", "b", [F.col("a")]).count() == 0


def test_certificate_and_order(spark):
    w = spark.createDataFrame([("t", "o1", True, "g1", "a", 5), ("t", "o1", True, "g1", "b", 5), ("t", "o2", True, "g2", "c", 3), ("t", "o3", False, "g3", "d", 1)], "task string, o string, m boolean, g string, e string, c int")
    args = ("task", "o", "g", "e", "c", "m")
    assert folds.certificates(w, *args).head().certificate == ["a", "b", "c"]
    got = [(r.evidence, r.completion) for r in folds.acquisition_order(w, *args).orderBy("step").collect()]
    assert got == [("c", 0.5), ("b", 0.5), ("a", 1.0)]
    state = spark.createDataFrame([("t", i, e) for i, e in enumerate(["a", "b", "c", "noise"])], "task string, pos int, e string")
    noise = w.unionByName(spark.createDataFrame([("t", "o3", False, "g4", "noise", 100)], w.schema))
    assert folds.minimal_states(state, noise, *args).head().kept == ["a", "b", "c"]
    assert folds.minimal_states(state.where("e <> 'c'"), noise, *args).head().kept == []
    optional = w.withColumn("m", F.lit(False))
    assert folds.certificates(optional, *args).head().certificate == [] and folds.acquisition_order(optional, *args).count() == 0


def test_assembly(spark):
    p = spark.createDataFrame([("t", 1, "x", "f"), ("t", 2, "a", "g"), ("t", 3, "a", "f"), ("u", 1, "q", "h")], "task string, pos int, evidence string, path string")
    e = spark.createDataFrame([("t", "a"), ("t", "c")], "task string, evidence string")
    f = spark.createDataFrame([("t", "g")], "task string, path string")
    assert sorted(map(tuple, A.localization(p, e, f, ["task"]).collect())) == [("t", 0.5, 0.5, 1.0, 0.5), ("u", 0.0, 0.0, 0.0, 0.0)]
    pred = spark.createDataFrame([("t", "a.py", 1, 5)], "task string, path string, start_line int, end_line int")
    gold = spark.createDataFrame([("t", "a.py", 5, 9), ("t", "b.py", 1, 2)], pred.schema)
    assert tuple(A.span_recall(pred, gold, ["task"]).head()) == ("t", 2, 0.5)


def test_merges(spark):
    rows = [("t", "e", True, None, False, 3, 0.5, "b", "", "o1"), ("t", "e", None, None, False, 2, None, "a", "positive", None), ("t", "z", None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "task string, item string, in_witness boolean, in_certificate boolean, in_boundary boolean, rank int, score double, source string, label string, obligation string")
    got = {r.item: r for r in merge.candidate_stats(df, "task", "item").collect()}
    assert (got["e"].in_witness, got["e"].min_rank, got["e"].max_score, got["e"].sources, got["e"].labels, got["e"].obligations) == (True, 2, 0.5, ["a", "b"], ["positive"], ["o1"])
    assert got["z"].min_rank is None and not got["z"].in_boundary and got["z"].sources == []
    g = spark.createDataFrame([("o", True, None, 0.4, ["b", "a", "a", None], "x"), ("o", None, True, 0.9, ["a", "b"], "y"), ("o", None, None, None, [], None)], "o string, mandatory boolean, applicable boolean, confidence double, `group` array<string>, annotation string")
    x = merge.merge_groups(g, ["o"]).head()
    assert (x.mandatory, x.applicable, x.confidence, x.groups, x.annotations) == (True, True, 0.9, [["a", "b"]], ["x", "y"])
    s, short = merge.stratified(spark.createDataFrame([("a", i) for i in range(5)] + [("b", 9)], "k string, i int"), "k", "i", {"a": 3, "b": 2, "c": 1}, "s")
    assert s.groupBy("k").count().orderBy("k").collect() == [("a", 3), ("b", 1)] and sorted(map(tuple, short.collect())) == [("b", 2, 1), ("c", 1, 0)]
    sym = spark.createDataFrame([("A.f", "x", "f"), ("", "def g(a):", "m.g"), ("", "g(1)", "g"), (None, "  Total = 3", "Total"), ("h", None, "k")], "s string, c string, w string")
    assert [r.m for r in sym.select(merge.matches_symbol(F.col("s"), F.col("c"), F.col("w")).alias("m")).collect()] == [True, True, False, True, False]


def test_scoped_candidates(spark):
    """Tasks that share a scope get what each gets by itself, without what it holds, and no row pairs task and unit."""
    from corvane.operators import ranking as R

    u = spark.createDataFrame([(f"e{i}", "a.py", None, " ".join(["alpha"] * (i % 3) + ["beta"] * (i % 2) + ["gamma"])) for i in range(9)], "evidence string, path string, symbol string, content string")
    asked = spark.createDataFrame([("t", "alpha"), ("t", "beta"), ("s", "alpha"), ("s", "none"), ("r", "none")], "task string, term string")
    scopes = spark.createDataFrame([("t", "x"), ("s", "x"), ("r", "x")], "task string, scope string")
    inside = u.select(F.lit("x").alias("scope"), "evidence")
    held = spark.createDataFrame([("t", "e1"), ("s", "e2")], "task string, evidence string")
    vectors = R.unit_vectors(u, asked)
    shared = C.candidate_bm25(inside, vectors, asked, depth=5, scopes=scopes, held=held)
    own = scopes.join(inside, "scope").select("task", "evidence").join(held, ["task", "evidence"], "left_anti")
    got = sorted(map(tuple, shared.collect()))
    assert got == sorted(map(tuple, C.candidate_bm25(own, vectors, asked, depth=5).collect())) and {g[0] for g in got} == {"s", "t"}
    alone = [r for r in got if r[0] == "s"]
    import math

    # s sees 8 units, 5 of which hold alpha: e1, e4, e7 once, e5 and e8 twice; e2 is held
    mean = sum(1 + i % 3 + i % 2 for i in range(9) if i != 2) / 8
    gain = lambda tf, length: round(math.log(1 + (8 - 5 + 0.5) / 5.5) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)), 6)
    want = sorted((-gain(i % 3, 1 + i % 3 + i % 2), f"e{i}") for i in (1, 4, 5, 7, 8))
    assert [(r[1], round(r[2], 5)) for r in sorted(alone, key=lambda r: r[3])] == [(e, round(-s, 5)) for s, e in want]
