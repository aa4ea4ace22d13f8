"""States, actions and labels on the reference cases and on edge cases."""

from pyspark.sql import functions as F

from corvane.operators import policy as P

W = "task string, obligation string, mandatory boolean, grp string, evidence string"


def witness(spark, groups):
    return spark.createDataFrame([("t", o, m, f"{o}{k}", e) for o, m, gs in groups for k, g in enumerate(gs) for e in (g or [None])], W)


def metrics(spark, groups, held):
    states = spark.createDataFrame([("t", "s")], "task string, state string")
    k = spark.createDataFrame([("t", "s", e) for e in held], "task string, state string, evidence string")
    return P.state_metrics(states, k, witness(spark, groups)).head()


def test_state_metrics(spark):
    ab = [("r1", True, ["ab", "c"]), ("r2", False, ["d"])]
    x = metrics(spark, ab, "a")
    assert (x.completion, x.progress, x.completed) == (0.0, 0.25, [])
    x = metrics(spark, ab, "abd")
    assert (x.completion, x.progress, x.completed, x.sufficient) == (1.0, 1.0, ["r1", "r2"], True)
    two = [("o1", True, ["ab", "x"]), ("o2", True, ["c"])]
    assert [(m.completion, m.progress) for m in (metrics(spark, two, k) for k in ("", "a", "ab"))] == [(0, 0), (0, 0.25), (0.5, 0.5)]
    assert all(metrics(spark, two, k).sufficient for k in ("abc", "xc"))
    x = metrics(spark, [("r", False, ["ab"])], "a")
    assert x.completion is None and x.progress == 0.5 and not x.sufficient
    assert metrics(spark, [("r", True, [""])], "a").completion == 0


def test_applicable(spark):
    rows = [("t", "o", True, "g", "a", True), ("t", "p", False, None, None, True), ("u", "o", True, None, None, True), ("u", "p", True, "g", "a", True), ("v", "o", True, "g", "a", None)]
    df = spark.createDataFrame(rows, W + ", applicable boolean")
    assert {(r.task, r.obligation) for r in P.applicable(df).collect()} == {("t", "o"), ("t", "p")}


def test_labels(spark):
    w = witness(spark, [("r1", True, ["ab"])])
    states = spark.createDataFrame([("t", "s"), ("t", "full")], "task string, state string")
    k = spark.createDataFrame([("t", "full", "a"), ("t", "full", "b")], "task string, state string, evidence string")
    acts = spark.createDataFrame([("t", "s", n, e) for n in ("a", "b", "z", "ab", "y") for e in n] + [("t", "full", "z", "z")], "task string, state string, action string, evidence string")
    costs = spark.createDataFrame([("t", "a", 5), ("t", "b", 7), ("t", "z", 1)], "task string, evidence string, cost int")
    bad = spark.createDataFrame([("t", "z")], "task string, evidence string")
    got = {(r.state, r.action): r for r in P.label_actions(acts, states, k, w, costs, bad).collect()}
    pair = got["s", "ab"]
    assert pair.completion_gain == 1.0 and pair.progress_interaction == 0.0 and pair.complement and not pair.substitute and pair.token_cost == 12 and pair.label == "positive" and pair.covered == ["r1"]
    assert got["s", "z"].label == "negative" and got["s", "z"].loss_mask and got["s", "STOP"].label == "negative" and got["s", "STOP"].loss_mask
    assert got["s", "a"].label == "positive" and got["s", "b"].pareto_dominated and got["s", "y"].label == "unknown" and not got["s", "y"].loss_mask
    assert got["full", "STOP"].label == "positive" and got["full", "z"].label == "negative"
    none = P.label_actions(acts, states, k, w.withColumn("mandatory", F.lit(False)), costs, bad).where("action = 'STOP' and state = 's'").head()
    assert none.label == "unknown" and none.acceptable is None and not none.loss_mask
    assert P.label_actions(acts.limit(0), states.limit(0), k, w, costs, bad).count() == 0


def test_seeds(spark):
    tasks = spark.createDataFrame([("t",)], "task string")
    bad = spark.createDataFrame([("t", "x", 1)], "task string, evidence string, rank int")
    cost = spark.createDataFrame([("t", e, c) for e, c in (("a", 6), ("b", 5), ("c", 4), ("x", 3))], "task string, evidence string, cost int")
    one = spark.createDataFrame([("t", "c")], "task string, evidence string")
    w = witness(spark, [("r1", True, ["ab", "c"])])
    got = P.state_seeds(tasks, one, w, cost, bad).orderBy("step").collect()
    assert [(r.state_type, r.label_source, r.evidence_ids) for r in got] == [("initial", "deterministic_initial", []), ("decision_boundary", "controlled_corruption", ["x"]), ("complete", "reference_certificate", ["c"])]
    assert [r.completion for r in got] == [0.0, 0.0, 1.0]
    two = spark.createDataFrame([("t", e) for e in "abc"], "task string, evidence string")
    got = P.state_seeds(tasks, two, witness(spark, [("r1", True, ["ab"]), ("r2", True, ["c"])]), cost, bad.limit(0)).orderBy("step").collect()
    assert got[1].evidence_ids == ["b", "c"] and got[1].completion == 0.5 and got[1].progress == 0.75
    assert [r.state_type for r in P.state_seeds(tasks, one, w, cost, bad.limit(0)).orderBy("step").collect()] == ["initial", "complete"]


def test_prefix_lengths(spark):
    def want(n, most):
        possible = list(range(1, n))
        if most <= 0 or len(possible) <= most:
            return possible
        got = sorted({min(n - 1, max(1, 1 + round(i * (n - 2) / max(1, most - 1)))) for i in range(most)})
        for x in possible:
            if len(got) >= most:
                break
            if x not in got:
                got.append(x)
        return sorted(got)[:most]

    for most in (0, 2, 3, 4, 7):
        for r in spark.range(0, 40).select(F.col("id").cast("int").alias("n")).withColumn("p", P.prefix_lengths(F.col("n"), most)).collect():
            assert r.p == want(r.n, most), (r.n, most)


def test_boundaries(spark):
    order = spark.createDataFrame([("t", i + 1, e) for i, e in enumerate("abc")], "task string, step int, evidence string")
    got = P.boundary_states(order, witness(spark, [("o1", True, ["ab", "x"]), ("o2", True, ["c"])])).orderBy("length").collect()
    assert [(r.length, r.evidence_ids, r.completion, r.progress, r.stage) for r in got] == [(1, ["a"], 0.0, 0.25, "early"), (2, ["a", "b"], 0.5, 0.5, "mid")]
    assert len({r.state_id for r in got}) == 2 and len(got[0].state_id) == 30


def test_action_set(spark):
    c = spark.createDataFrame([("t", e, i, n) for i, (e, n) in enumerate([("a", 4), ("b", 5), ("c", 9), ("d", None)])], "task string, evidence string, rank int, tokens int")
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "b"), ("a", "q")], "source string, target string")
    left = spark.createDataFrame([("t", 10, 2), ("u", 5, 1)], "task string, tokens_left int, units_left int")
    got = {(r.task, r.kind, r.first, r.second, r.token_cost) for r in P.action_set(c, edges, left).collect()}
    assert got == {("t", "single", "a", None, 4), ("t", "single", "b", None, 5), ("t", "single", "c", None, 9), ("t", "single", "d", None, 0), ("t", "pair", "a", "b", 9), ("t", "stop", None, None, 0), ("u", "stop", None, None, 0)}


def test_labels_in_shares(spark, tmp_path, monkeypatch):
    """Labels of orders in shares are those of all at once, and only the labels stay on disk."""
    from corvane import session
    from corvane.plans import states

    rows = [(o, p, f, s, float(p)) for o in range(40) for p, f, s in ((o % 7, "A", "F"), (o % 5 + 7, "R", "F"), (o % 3 + 12, "N", "O"))]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_returnflag string, l_linestatus string, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(p, p * 5) for p in range(15)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    made, gone = [], []
    plain, remove = session._remove, session.shared_dir
    monkeypatch.setattr(session, "shared_dir", lambda s: made.append(1) or remove(s))
    monkeypatch.setattr(session, "_remove", lambda s, p: gone.append(p) or plain(s, p))
    whole = sorted(map(str, states.action_labels(spark, str(tmp_path)).collect()))
    assert len(made) == 4 and len(gone) == 3 and not any("labels" in p for p in gone)
    monkeypatch.setattr(states, "SHARE", 30)
    made.clear()
    assert sorted(map(str, states.action_labels(spark, str(tmp_path)).collect())) == whole and len(made) == 16


def _sql_rows(folder):
    import duckdb

    from corvane.plans import catalog

    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    return con.execute(catalog.SQL["action_labels"]).fetchall()


def _clean(rows):
    return sorted(str(tuple(float(v) + 0.0 if isinstance(v, float) else v for v in r)) for r in rows)


def test_labels_of_odd_lines(spark, tmp_path, monkeypatch):
    """Nulls, repeated lines, fractional quantities, long orders and batches that end within an order, against SQL."""
    import random

    from corvane.operators import neighbours
    from corvane.plans import states

    draw = random.Random(7)
    odd = lambda v: None if draw.random() < 0.08 else v
    rows = [(odd(draw.choice([1, *range(60)])), odd(draw.randrange(14)), odd(draw.choice("ANR")), odd(draw.choice("FO")), odd(draw.choice([1.0, 2.0, 2.5, 3.5, 7.9]))) for _ in range(600)]
    kinds = "l_orderkey long, l_partkey long, l_returnflag string, l_linestatus string, l_quantity double"
    parts = spark.createDataFrame([(p, odd(p * 5)) for p in range(1, 14)] + [(None, 1)], "p_partkey long, p_size int")
    for name, lines in (("odd", rows), ("none", []), ("held", [(1, 2, "A", "F", 1.0), (2, None, "R", "F", 1.0), (None, 9, "R", "F", 1.0)])):
        d = f"{tmp_path}/{name}"
        spark.createDataFrame(lines, kinds).write.parquet(f"{d}/lineitem.parquet")
        parts.write.parquet(f"{d}/part.parquet")
        want = _clean(_sql_rows(d))
        assert _clean(states.action_labels(spark, d).collect()) == want, name
        with monkeypatch.context() as m:
            m.setattr(neighbours, "ROWS", 5)
            m.setattr(neighbours, "PAIRS", 3)
            assert _clean(states.action_labels(spark, d).collect()) == want, name


def test_neighbours_as_label_actions(spark):
    """Both operators say the same of singles and pairs of neighbours, also where evidence is a string."""
    import random

    from corvane.operators.neighbours import label_neighbours

    draw = random.Random(3)
    w = spark.createDataFrame(list({(f"t{draw.randrange(9)}", draw.choice("pqN"), draw.choice("gh"), draw.choice("abcdefgh")) for _ in range(120)}), "task string, obligation string, grp string, evidence string")
    w = w.withColumn("mandatory", F.col("obligation") != "N").withColumn("held", F.col("evidence") <= "c").withColumn("cost", F.ascii("evidence") % 3)
    got = label_neighbours(w).collect()
    key = lambda r: (r.task, "+".join(x for x in (r.first, r.second) if x) or "STOP")
    acts = spark.createDataFrame([(t, "k", a, e) for t, a in map(key, got) if a != "STOP" for e in a.split("+")], "task string, state string, action string, evidence string")
    states = w.select("task", F.lit("k").alias("state")).distinct()
    held = w.where("held").select("task", F.lit("k").alias("state"), "evidence").distinct()
    want = P.label_actions(acts, states, held, w, w.select("task", "evidence", "cost"), w.select("task", "evidence").limit(0)).collect()
    few = lambda v: round(v, 4) + 0.0 if isinstance(v, float) else v
    cols = ("token_cost", "completion_gain", "progress_gain", "completion_interaction", "progress_interaction", "complement", "substitute", "semantic_useful", "pareto_dominated", "label")
    assert {key(r): [few(r[c]) for c in cols] for r in got} == {(r.task, r.action): [few(r[c]) for c in cols] for r in want}


def test_labels_take_few_jobs(spark, tmp_path):
    """A share of orders is grouped by order once, whatever is said of its actions."""
    from corvane.plans import states

    spark.createDataFrame([(1, 2, "A", "F", 1.0), (1, 9, "R", "F", 1.0)], "l_orderkey long, l_partkey long, l_returnflag string, l_linestatus string, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(2, 10), (9, 30)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.sparkContext.setJobGroup("labels", "labels")
    try:
        states.action_labels(spark, str(tmp_path)).collect()
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("labels")) <= 20
    finally:
        for k in ("spark.jobGroup.id", "spark.job.description"):
            spark.sparkContext.setLocalProperty(k, None)
