"""Sources, sinks, phases, diffs, extraction, adapters, acquisition and streams."""

import json

import pytest
from pyspark.sql import functions as F

from corvane.functions import diff
from corvane.operators import extract, retrieval
from corvane.plans.pipeline import Pipeline
from corvane.sources import files, sinks
from corvane.streaming import events


def test_readers(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"a": 1, "b": "x"}\n\n{"a": 2}\n')
    assert sorted((r.a, r.b) for r in files.read_jsonl(spark, str(p), "a int, b string").collect()) == [(1, "x"), (2, None)]
    assert files.read_jsonl(spark, str(tmp_path / "none"), "a int").count() == 0
    p.write_text("not json\n")
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(p), "a int").collect()
    for text in ('\ufeff[{"a": 1}, {"a": 2}]', '\ufeff{"a": 1}\n\n{"a": 2}\n'):
        p.write_text(text)
        assert sorted(r.a for r in files.read_json_or_jsonl(spark, str(p), "a int").collect()) == [1, 2]
    p.write_text('\ufeffx,y\n1,"a, b"\n')
    assert [tuple(r) for r in files.read_csv(spark, str(p)).select("x", "y").collect()] == [("1", "a, b")]
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "e" / "q.md").write_text("[CANDIDATE 1] id=e1 path=a.py\ntext\n[CANDIDATE 2] id=e2 path=b.py")
    t = files.read_texts(spark, str(tmp_path / "d"))
    assert sorted((r.number, r.id, r.path) for r in files.bindings(t).collect()) == [(1, "e1", "a.py"), (2, "e2", "b.py")]
    with pytest.raises(Exception):
        files.bindings(t.withColumn("text", F.concat("text", F.lit("\n[CANDIDATE 1] id=e3 path=c.py")))).collect()
    assert files.view(t, ["name", "missing"]).head().missing is None


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, "é") for i in range(7)], "a int, b string")
    r = sinks.write_stream(df, str(tmp_path / "p"))
    j = sinks.write_stream(df, str(tmp_path / "j"), "json")
    assert r["rows"] == j["rows"] == 7 and r["bytes"] > 0
    m = sinks.write_manifest(spark, str(tmp_path / "m.json"), [r, j], version=1)
    assert json.loads((tmp_path / "m.json").read_text()) == m and m["rows"] == 14
    sinks.publish(spark, str(tmp_path / "p"), str(tmp_path / "out"))
    sinks.publish(spark, str(tmp_path / "j"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 7 and not (tmp_path / "out.previous").exists()
    both = sinks.merge_splits({"train": df, "test": df.select("a").withColumn("c", F.lit(1))})
    assert both.columns == ["a", "b", "split", "c"] and both.count() == 14
    u = spark.createDataFrame([("e", "x"), ("f", None)], "evidence_id string, content string").withColumn("content_sha256", F.sha2("content", 256))
    assert sinks.verified(u).count() == 2
    with pytest.raises(Exception, match="digest of"):
        sinks.verified(u.withColumn("content_sha256", F.lit("0"))).collect()


def test_phases(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.createDataFrame([(1,), (2,)], "k int")

    p = Pipeline(spark, str(tmp_path))
    assert p.run("a", ["x"], {"n": 1}, make).count() == 2
    assert p.run("a", ["x"], {"n": 1}, make).count() == 2 and len(made) == 1
    p.run("b", ["a"], {}, make)
    p.run("a", ["x"], {"n": 2}, make)
    p.run("b", ["a"], {}, make)
    assert len(made) == 4
    assert [r.k for r in p.pending(spark.createDataFrame([(2,), (3,)], "k int"), "a", "k").collect()] == [3]
    assert p.pending(spark.createDataFrame([(2,)], "k int"), "never", "k").count() == 1


def test_diff(spark):
    patch = "--- a/src/old.py\n+++ b/src/old.py\n@@ -10,3 +10,4 @@ def f\n x\n--- not a header\n@@ -20,0 +22,2 @@\n+y\n--- /dev/null\n+++ b/new.py\n@@ -0,0 +1 @@\n+z\n"
    df = spark.createDataFrame([(1, patch, None), (2, None, ""), (3, "--- /dev/null\n+++ b/n\n@@ -0,0 +1 @@\n+z", None)], "k int, patch string, test string")
    assert [tuple(r) for r in diff.regions(df, "k").orderBy("start_line").collect()] == [(1, "src/old.py", 10, 12), (1, "src/old.py", 20, 20)]
    assert [r.c for r in df.orderBy("k").select(diff.certificate_class(F.col("patch"), F.col("test")).alias("c")).collect()] == ["ok", "missing_patch_and_test_patch", "no_old_side_text_hunk"]


def test_extract(spark):
    code = "import a\n\n@dec\nclass A:\n    def f(self):\n        return 1\n\n\ndef g():\n    pass\nx = 1\n"
    df = spark.createDataFrame([("p", "a.py", code), ("q", "b.py", "def (:\n"), ("r", "c.md", "a b c\n" * 4), ("s", "d.py", None)], "file_version_id string, path string, content string")
    got = extract.extract_units(df, limit=7).collect()
    own = {r.unit_no: r for r in got if r.file_version_id == "p"}
    units = {(r.unit_type, r.qualified_name, r.start_line, r.end_line, own[r.parent_no].qualified_name if r.parent_no else None) for r in own.values()}
    blocks = {("code_block", None, 1, 3, None), ("code_block", None, 11, 11, None), ("code_block", None, 4, 5, "A"), ("code_block", None, 6, 6, "A"), ("code_block", None, 5, 5, "A.f"), ("code_block", None, 6, 6, "A.f"), ("code_block", None, 9, 9, "g"), ("code_block", None, 10, 10, "g")}
    assert {u for u in units if u[0] != "code_block"} == {("file", None, 1, 11, None), ("class", "A", 4, 6, None), ("method", "A.f", 5, 6, "A"), ("function", "g", 9, 10, None)}
    assert {u[2:4] for u in units if u[0] == "code_block" and u[4] is None} == {(1, 3), (11, 11)} and {u for u in units if u[0] == "code_block"} & blocks
    assert all(r.scoreable == (r.unit_type != "file" and r.tokens <= 7) for r in got)
    assert [(r.module, r.line) for r in extract.extract_imports(df).collect()] == [("a", 1)]
    assert {r.status for r in got if r.file_version_id == "q"} == {"fallback"}
    assert sorted((r.start_line, r.end_line) for r in got if r.file_version_id == "r" and r.unit_type != "file") == [(1, 2), (3, 4)]
    c = extract.chunks(spark.createDataFrame([(1, " ".join(map(str, range(100)))), (2, "a"), (3, None)], "k int, t string"), "k", "t", 64, 48)
    assert sorted((r.k, r.chunk, r.tokens) for r in c.collect()) == [(1, 0, 64), (1, 1, 52), (2, 0, 1)]


def test_adapter(spark):
    u = [("e1", "a.py", "f", "A.f", 1, 9, True), ("e2", "a.py", "g", None, 10, 20, None), ("e3", "b.py", None, None, 1, 5, True), ("e4", "b.py", None, None, 1, 5, False)]
    u = spark.createDataFrame([(1, *x) for x in u] + [(2, "e5", "a.py", "f", "A.f", 1, 99, True)], "task_id int, evidence_id string, path string, symbol string, qualified_name string, start_line int, end_line int, scoreable boolean")
    o = spark.createDataFrame([(1, 1, None, "a.py", None, 15, 16), (1, 2, "e1", "b.py", None, None, None), (1, 3, None, "a.py", "A.f", 10, 20), (1, 4, None, "b.py", None, None, None), (1, 5, "e2", None, None, None, None)],
                              "task_id int, source_rank int, evidence_id string, path string, symbol string, start_line int, end_line int")
    assert sorted((r.evidence_id, r.source_rank) for r in retrieval.adapt_outputs(o, u).collect()) == [("e1", 2), ("e2", 1), ("e3", 4)]


def test_acquire(spark):
    c = spark.createDataFrame([("t", "x", "a", 1, 50), ("t", "x", "b", 2, 30), ("t", "y", "b", 1, 30), ("t", "y", "c", 2, 40), ("s", "x", "z", 1, None)], "task_id string, channel string, evidence_id string, rank int, tokens int")
    got = sorted((r.task_id, r.step, r.evidence_id, r.used) for r in retrieval.acquire(c, 4, 3, 90).collect())
    assert got == [("s", 1, "z", 0), ("t", 1, "b", 30), ("t", 2, "a", 80)]
    assert retrieval.acquire(c.limit(0), 2, 3, 90).count() == 0


def test_streams(spark, tmp_path):
    rows = [(i % 20, 1_700_000_000 + 3600 * (i % 20), i % 3, "click", float(i % 20)) for i in range(30)]
    df = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double").select("event_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value")
    df.coalesce(1).write.parquet(str(tmp_path / "x"))
    next((tmp_path / "x").glob("*.parquet")).rename(tmp_path / "events.parquet")
    s = events.event_stream(spark, str(tmp_path))
    assert events.drain(events.deduplicated(s), "append").count() == 20
    assert events.drain(events.windowed_counts(s), "complete").agg(F.sum("n")).head()[0] == 30
    assert events.drain(events.running_totals(s, 80.0), "update").agg(F.sum("steps")).head()[0] == 30


def test_chunks_to_the_end(spark, tmp_path):
    from corvane.plans import catalog

    words = [str(i) for i in range(1000)]
    spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:64])), (3, " ".join(words[:65])), (4, " ")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for r in catalog.QUERIES["token_chunks"](spark, str(tmp_path)).orderBy("doc_id", "chunk").collect():
        assert r.tokens == len(r.text.split())
        got.setdefault(r.doc_id, []).append(r.text.split())
    assert [w for k, c in enumerate(got[1]) for w in c[16 if k else 0 :]] == words and {k: len(v) for k, v in got.items()} == {1: 21, 2: 1, 3: 2}
