"""Judgments, consensus, flags, gains, interactions and quotas on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from corvane.operators import judgments, selection


def test_semantic(spark):
    j = spark.createDataFrame([("m", "sufficient", "correct", "relevant", 0.5, 4, 2, 1, 0), ("m", "partial", "uncertain", "partial", None, 0, 0, 0, 2)],
                              "k string, verdict string, causal string, execution string, confidence double, evidence_count int, useful int, redundant int, misleading int")
    r = judgments.semantic_means(j, ["k"]).head()
    assert (r.sufficiency_rate, r.partial_credit, r.causal_score, r.execution_score, r.precision, r.redundancy_rate, r.misleading_rate, r.mean_confidence) == (0.5, 0.75, 0.5, 0.75, 0.25, 0.125, 0.5, 0.5)
    with pytest.raises(Exception, match="unknown value"):
        judgments.semantic_means(j.withColumn("verdict", F.lit("?")), ["k"]).collect()
    d = spark.createDataFrame([("m", "api", True, True, "sufficient"), ("m", "api", True, False, "none"), ("m", "api", False, True, "none"), ("m", "env", True, False, "partial")], "k string, dimension string, applicable boolean, critical boolean, coverage string")
    assert sorted((r.dimension, r.n, r.coverage, r.critical_coverage) for r in judgments.dimension_coverage(d, ["k"]).collect()) == [("api", 2, 0.5, 1.0), ("env", 1, 0.5, None)]
    assert judgments.agreement(spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b")], "c int, v string"), "c", "v").head().agreement == 0.5


def test_consensus_and_flags(spark):
    v = spark.createDataFrame([(1, "ok", "a", "g"), (1, "ok", "b", "g"), (1, "ok", "b", "h"), (1, "no", "c", "g"), (2, "ok", "a", None), (2, "no", "b", None), (3, "no", "a", None), (3, "no", "c", None)], "s int, status string, voter string, g string")
    assert sorted(tuple(r) for r in judgments.group_consensus(v, ["s"], "status", "voter", "g").collect()) == [(1, "ok", "g"), (3, "no", None)]
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "k int"), spark.createDataFrame([(2,)], "k int")
    assert sorted((r.k, r.points, r.codes) for r in judgments.weighted_flags([("A", 1, a), ("B", 3, b)], "k").collect()) == [(1, 1, ["A"]), (2, 4, ["A", "B"])]


def test_differences(spark):
    b = spark.createDataFrame([(1, "x", None), (2, "y", 1), (3, "z", 1)], "k int, a string, n int")
    d = spark.createDataFrame([(1, "x", None), (2, "q", None), (4, "z", 1)], "k int, a string, n int")
    assert sorted((r.k, r.problem, r.column or "") for r in judgments.row_differences(b, d, "k", ["a", "n"]).collect()) == [(2, "changed", "a"), (2, "changed", "n"), (3, "missing", ""), (4, "added", "")]


def test_gains(spark):
    w = spark.createDataFrame([(1, "r1", "g", "a"), (1, "r1", "g", "b"), (1, "r1", "h", "c"), (1, "r2", "i", "d")], "t int, o string, g string, e string")
    k = spark.createDataFrame([("a",)], "e string")
    got = {r.e: (r.gain, r.progress) for r in selection.gains(w, k, "t", "o", "g", "e").collect()}
    assert got == {"b": (0.5, 0.25), "c": (0.5, 0.25), "d": (0.5, 0.5)}
    assert selection.gains(w, k.limit(0), "t", "o", "g", "e").count() == 4


def test_interactions(spark):
    w = spark.createDataFrame([(1, "r1", "g", "a"), (1, "r1", "g", "b"), (1, "r1", "h", "c")], "t int, o string, g string, e string")
    o = spark.createDataFrame([(1, "c", 1), (1, "a", 2), (1, "z", 3), (1, "b", 4), (2, "a", 1)], "t int, e string, p int")
    got = {r.t: (r.redundant_rate, r.substitute_rate, r.complementary_rate) for r in selection.interactions(o, w, "t", "o", "g", "e", "p").collect()}
    assert got == {1: (0.75, 0.666667, 1.0), 2: (1.0, 0.0, 0.0)}


def test_quotas_and_bodies(spark):
    c = spark.createDataFrame([("t", "a", "f", "test", 1, 10, 1), ("t", "b", "f", "src", 2, 10, 2), ("t", "c", "f", "src", 11, 20, 3), ("t", "d", "g", "test", 1, 5, 4), ("t", "e", "g", "src", 1, 5, 5)], "t string, i string, f string, c string, s int, e int, p int")
    got = selection.quota_select(c, "t", "i", "f", "c", "s", "e", [F.col("p")], quotas={"test": 1}).orderBy("place").collect()
    assert [r.i for r in got] == ["a", "c", "e"]
    items = spark.createDataFrame([([("a", 5), ("b", 9), ("c", 4)],)], "x array<struct<id:string,tokens:int>>")
    assert items.select(selection.fitting_bodies(F.col("x"), 10).alias("k")).head().k == ["a", "c"]
    u = spark.createDataFrame([("f", "x", 1, 5), ("f", "y", 6, 9), ("f", "z", 20, 22), ("f", "w", 2, 3)], "f string, i string, s int, e int")
    assert [(r.i, r.distance) for r in selection.nearest_units(u.where("i = 'x'"), u, "f", "i", "s", "e").orderBy("rank").collect()] == [("w", 0), ("y", 1)]
