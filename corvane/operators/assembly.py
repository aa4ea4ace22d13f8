"""Evaluation of whole runs: localization, replay of trajectories, per-task assembly, summaries and curves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.intervals import overlap_join
from corvane.operators.metrics import auc, long_means


def first_seen(rows: DataFrame, by: list[str], item: str, pos: str) -> DataFrame:
    """(by, item, rank): distinct items in the order of their first occurrence."""
    x = rows.groupBy(*by, item).agg(F.min(pos).alias("_pos"))
    return x.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("_pos", item))).drop("_pos")


def _recall(ranked: DataFrame, gold: DataFrame, by: list[str], item: str, name: str) -> DataFrame:
    total = gold.select(*by, item).distinct().groupBy(*by).agg(F.count("*").alias("_all"))
    hit = ranked.join(gold.select(*by, item).distinct(), [*by, item], "left_semi").groupBy(*by).agg(F.count("*").alias("_n"), F.min("rank").alias("_first"))
    return total.join(hit, by, "left").select(*by, F.round(F.coalesce(F.col("_n") / F.col("_all"), F.lit(0.0)), 6).alias(f"{name}_recall"), F.round(F.coalesce(1.0 / F.col("_first"), F.lit(0.0)), 6).alias(f"{name}_mrr"))


def localization(package: DataFrame, gold_evidence: DataFrame, gold_files: DataFrame, by: list[str], k: int | None = None) -> DataFrame:
    """(by, evidence_recall, evidence_mrr, file_recall, file_mrr) of packages (by, pos, evidence, path) of which the
    first `k` units count. Files are ranked by their first unit. Without gold a metric is 0; groups without a package and
    without gold have no row."""
    own = package if k is None else package.where(F.col("pos") <= k)
    e = _recall(first_seen(own, by, "evidence", "pos"), gold_evidence, by, "evidence", "evidence")
    f = _recall(first_seen(own, by, "path", "pos"), gold_files, by, "path", "file")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    every = package.select(*by).distinct().join(e, by, "full").join(f, by, "full")
    return every.select(*by, *(zero(c) for c in ("evidence_recall", "evidence_mrr", "file_recall", "file_mrr")))


def span_recall(predicted: DataFrame, gold: DataFrame, by: list[str]) -> DataFrame:
    """(by, spans, recall): the share of the gold spans (by, path, start_line, end_line) that some predicted span of the
    same path meets. Repeated gold spans count each."""
    g = gold.select(*by, "path", "start_line", "end_line").groupBy(*by, "path", "start_line", "end_line").agg(F.count("*").alias("_n"))
    p = predicted.select(*by, "path", F.col("start_line").alias("_s"), F.col("end_line").alias("_e")).distinct()
    met = overlap_join(g, p, [*by, "path"], "start_line", "end_line", "_s", "_e").select(*by, "path", "start_line", "end_line").distinct().withColumn("_met", F.lit(1))
    x = g.join(met, [*by, "path", "start_line", "end_line"], "left")
    return x.groupBy(*by).agg(F.sum("_n").alias("spans"), F.round(F.sum(F.coalesce(F.col("_n") * F.col("_met"), F.lit(0))) / F.sum("_n"), 6).alias("recall"))


def structure_increment(base: DataFrame, expanded: DataFrame, relevant: DataFrame, by: str, item: str, k: int) -> DataFrame:
    """(by, increment): the share of the relevant items that the first `k` of the expanded ranking hold and the first `k`
    of the base ranking don't."""
    rel = relevant.select(by, item).distinct()
    new = expanded.where(F.col("rank") <= k).select(by, item).join(rel, [by, item], "left_semi").distinct().join(base.where(F.col("rank") <= k).select(by, item), [by, item], "left_anti")
    n = new.groupBy(by).agg(F.count("*").alias("_new"))
    return rel.groupBy(by).agg(F.count("*").alias("_all")).join(n, by, "left").select(by, F.round(F.coalesce(F.col("_new"), F.lit(0)) / F.col("_all"), 6).alias("increment"))


def sufficiency_replay(added: DataFrame, witness: DataFrame, steps: DataFrame, by: list[str]) -> DataFrame:
    """(by, step, sufficient_after): whether what all steps up to one have added meets all mandatory obligations.

    added: by, step, evidence. witness: task, obligation, mandatory, grp, evidence. `by` begins with task. A group is met
    at the step at which its last piece comes, an obligation at the first of its groups, a task at the last of its
    mandatory obligations: three aggregates, and no state is kept per step. A task without a mandatory obligation is
    never sufficient; a group without evidence is met from the start."""
    first = added.groupBy(*by, "evidence").agg(F.min("step").alias("at"))
    must = witness.where("mandatory").select("task", "obligation", "grp", "evidence").distinct()
    runs = steps.select(*by).distinct()
    need = runs.join(must, "task").join(first, [*by, "evidence"], "left")
    group = need.groupBy(*by, "obligation", "grp").agg(F.max(F.when(F.col("evidence").isNull(), F.lit(0)).otherwise(F.col("at"))).alias("at"), F.count_if(F.col("evidence").isNotNull() & F.col("at").isNull()).alias("open"))
    obligation = group.groupBy(*by, "obligation").agg(F.min(F.when(F.col("open") == 0, F.col("at"))).alias("at"))
    task = obligation.groupBy(*by).agg(F.max("at").alias("at"), F.count_if(F.col("at").isNull()).alias("open"))
    done = task.where("open = 0").select(*by, "at")
    return steps.select(*by, "step").distinct().join(done, by, "left").select(*by, "step", F.coalesce(F.col("step") >= F.col("at"), F.lit(False)).alias("sufficient_after"))


def trajectory_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, trajectories and the means over them): of one row per trajectory with success, premature_stop, never_stop,
    hard_stop, steps, evidence, tokens, tool_calls, late_steps, late_evidence, late_tokens."""
    share = lambda c, name: F.round(F.avg(F.col(c).cast("double")), 6).alias(name)
    return rows.groupBy(*by).agg(
        F.count("*").alias("trajectories"), share("success", "success_rate"), share("premature_stop", "premature_stop_rate"), share("never_stop", "never_stop_rate"), share("hard_stop", "hard_stop_rate"),
        share("steps", "mean_steps"), F.round(F.median("steps"), 6).alias("median_steps"), share("evidence", "mean_evidence"), share("tokens", "mean_tokens"), share("tool_calls", "mean_tool_calls"),
        share("late_steps", "late_steps"), share("late_evidence", "late_evidence"), share("late_tokens", "late_tokens"))


def task_metrics(base: DataFrame, *families: DataFrame, by: list[str]) -> DataFrame:
    """One wide row per key of `base`, with the columns of every family that has the key; what a family lacks is null."""
    return reduce(lambda a, f: a.join(f, by, "left"), families, base)


def run_summary(tasks: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """(by, metric, tasks, mean) over the tasks that all runs of a split have in common; `by` has run and split.
    Metrics that a task lacks don't count for it."""
    total = tasks.groupBy("split").agg(F.countDistinct("run").alias("_runs"))
    common = tasks.groupBy("split", "task").agg(F.countDistinct("run").alias("_n")).join(F.broadcast(total), "split").where("_n = _runs").select("split", "task")
    return long_means(tasks.join(common, ["split", "task"], "left_semi"), by, metrics)


def cost_curves(tasks: DataFrame, by: list[str], cost: str, score: str, point: str) -> DataFrame:
    """(by, points, auc): the mean score over the mean cost of every point (a budget or cut-off) of a curve."""
    return auc(tasks.groupBy(*by, point).agg(F.avg(cost).alias("_x"), F.avg(score).alias("_y")), by, "_x", "_y")
