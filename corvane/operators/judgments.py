"""Judgments: semantic scores, agreement, calibration, consensus over several answers, weighted flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a verdict counts.
VERDICT = {"sufficient": 1.0, "partial": 0.5, "insufficient": 0.0}
COVERAGE = {"sufficient": 1.0, "partial": 0.5, "none": 0.0}
CAUSAL = {"correct": 1.0, "partial": 0.5, "incorrect": 0.0, "uncertain": 0.0}
EXECUTION = {"relevant": 1.0, "partial": 0.5, "irrelevant": 0.0, "uncertain": 0.0}


def score(column: Column, table: dict[str, float]) -> Column:
    """The value of a name; an unknown name is an error, null stays null."""
    known = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.when(column.isNull(), None).otherwise(F.coalesce(F.try_element_at(known, column), F.raise_error(F.concat(F.lit("unknown value: "), column)).cast("double")))


def semantic_means(judgments: DataFrame, by: list[str]) -> DataFrame:
    """Per group: judgments, sufficiency rate, partial credit, causal and execution scores, precision, redundancy and
    misleading rates, mean confidence. Columns: verdict, causal, execution, confidence, evidence_count, useful,
    redundant, misleading (counts)."""
    n = F.col("evidence_count")
    share = lambda c: F.when(n > 0, F.col(c) / n).otherwise(0.0)
    r = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return judgments.groupBy(*by).agg(
        F.count("*").alias("judgments"), r((F.col("verdict") == "sufficient").cast("double"), "sufficiency_rate"), r(score(F.col("verdict"), VERDICT), "partial_credit"), r(score(F.col("causal"), CAUSAL), "causal_score"),
        r(score(F.col("execution"), EXECUTION), "execution_score"), r(share("useful"), "precision"), r(share("redundant"), "redundancy_rate"), r((F.col("misleading") > 0).cast("double"), "misleading_rate"), r(F.col("confidence"), "mean_confidence"))


def dimension_coverage(dimensions: DataFrame, by: list[str]) -> DataFrame:
    """(by, dimension, n, coverage, critical_coverage) over the applicable rows of (dimension, applicable, critical,
    coverage)."""
    d = dimensions.where("applicable").withColumn("_s", score(F.col("coverage"), COVERAGE))
    return d.groupBy(*by, "dimension").agg(F.count("*").alias("n"), F.round(F.avg("_s"), 6).alias("coverage"), F.round(F.avg(F.when(F.col("critical"), F.col("_s"))), 6).alias("critical_coverage"))


def agreement(judgments: DataFrame, case: str, verdict: str) -> DataFrame:
    """(cases, agreement): the share of cases with one verdict."""
    c = judgments.groupBy(case).agg(F.countDistinct(verdict).alias("_n"))
    return c.agg(F.count("*").alias("cases"), F.round(F.avg((F.col("_n") == 1).cast("double")), 6).alias("agreement"))


def calibration(pairs: DataFrame, kind: str, before: str, after: str) -> DataFrame:
    """(kind, cases, drop_rate, no_gain_rate): how often a score falls, and how often it doesn't rise."""
    return pairs.groupBy(kind).agg(
        F.count("*").alias("cases"), F.round(F.avg((F.col(after) < F.col(before)).cast("double")), 6).alias("drop_rate"), F.round(F.avg((F.col(after) <= F.col(before)).cast("double")), 6).alias("no_gain_rate"))


def group_consensus(votes: DataFrame, slot: list[str], status: str, voter: str, group: str, least: int = 2) -> DataFrame:
    """(slot, status, group): a slot's status with `least` voters, and of the groups that its supporters name, those
    with `least` votes. `votes` has a row per voter and group, group being null where a voter names none."""
    who = votes.select(*slot, status, voter).distinct().groupBy(*slot, status).agg(F.count("*").alias("_n"))
    best = who.groupBy(*slot).agg(F.max(F.struct("_n", F.col(status).alias("_s"))).alias("_b")).where(F.col("_b._n") >= least).select(*slot, F.col("_b._s").alias(status))
    named = votes.where(F.col(group).isNotNull()).join(best, [*slot, status], "left_semi").groupBy(*slot, group).agg(F.countDistinct(voter).alias("_v")).where(F.col("_v") >= least)
    return best.join(named.select(*slot, group), slot, "left")


def weighted_flags(rules: list[tuple[str, int, DataFrame]], key: str) -> DataFrame:
    """(key, points, codes): rules are (code, points, offending rows with the key); a key counts once per code."""
    every = reduce(DataFrame.unionByName, [df.select(key).distinct().select(key, F.lit(code).alias("code"), F.lit(points).alias("points")) for code, points, df in rules])
    return every.groupBy(key).agg(F.sum("points").alias("points"), F.array_sort(F.collect_set("code")).alias("codes"))


def row_differences(base: DataFrame, derived: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, problem, column): keys that one side lacks, and immutable columns that differ; nulls are equal."""
    b = base.select(key, F.struct(*columns).alias("_b"))
    d = derived.select(key, F.struct(*columns).alias("_d"))
    both = b.join(d, key, "full")
    changed = F.filter(F.array(*(F.when(~F.col(f"_b.{c}").eqNullSafe(F.col(f"_d.{c}")), F.lit(c)) for c in columns)), lambda c: c.isNotNull())
    found = both.select(key, F.when(F.col("_d").isNull(), F.array(F.struct(F.lit("missing").alias("problem"), F.lit(None).cast("string").alias("column"))))
                        .when(F.col("_b").isNull(), F.array(F.struct(F.lit("added").alias("problem"), F.lit(None).cast("string").alias("column"))))
                        .otherwise(F.transform(changed, lambda c: F.struct(F.lit("changed").alias("problem"), c.alias("column")))).alias("x"))
    return found.select(key, F.explode("x").alias("x")).select(key, "x.*")
