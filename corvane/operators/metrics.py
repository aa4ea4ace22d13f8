"""Evaluation metrics on long tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTOFFS = (1, 5, 10, 20, 64)


def _sum_if(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0))


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, query: str, item: str, rank: str = "rank", gain: str | None = None, cutoffs=CUTOFFS) -> DataFrame:
    """(query, rr, recall_k..., ndcg_k...) of every query that has a relevant item. Gains are 2^g - 1, discounted by
    log2(rank + 1); the ideal order sorts the relevant items' gains."""
    g = F.col(gain).cast("double") if gain else F.lit(1.0)
    rel = relevant.select(query, item, (F.pow(F.lit(2.0), g) - 1).alias("_gain"))
    ideal_rank = F.row_number().over(Window.partitionBy(query).orderBy(F.col("_gain").desc(), item))
    ideal = rel.withColumn("_i", ideal_rank).groupBy(query).agg(F.count("*").alias("_n"), *(F.sum(F.when(F.col("_i") <= k, F.col("_gain") / F.log2(F.col("_i") + 1))).alias(f"_ideal_{k}") for k in cutoffs))
    hit = ranked.select(query, item, F.col(rank).alias("_r")).join(rel, [query, item])
    got = hit.groupBy(query).agg(
        F.min("_r").alias("_first"), *(_sum_if(F.col("_r") <= k).alias(f"_hits_{k}") for k in cutoffs), *(F.sum(F.when(F.col("_r") <= k, F.col("_gain") / F.log2(F.col("_r") + 1))).alias(f"_dcg_{k}") for k in cutoffs))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return ideal.join(got, query, "left").select(
        query, F.round(F.coalesce(1.0 / F.col("_first"), F.lit(0.0)), 6).alias("rr"),
        *(F.round(zero(f"_hits_{k}") / F.col("_n"), 6).alias(f"recall_{k}") for k in cutoffs), *(F.round(F.coalesce(F.col(f"_dcg_{k}") / F.col(f"_ideal_{k}"), F.lit(0.0)), 6).alias(f"ndcg_{k}") for k in cutoffs))


def trajectories(steps: DataFrame, run: str, order: list[str], kind: str, stop: str, sufficient: str, tokens: str, forced: str | None = None) -> DataFrame:
    """(run, steps, first_stop, first_sufficient, success, premature_stop, never_stop, late_steps, late_tokens), one row
    per run. A forced stop is no stop. Late steps lie strictly between the first sufficient step and the first stop."""
    w = Window.partitionBy(run).orderBy(*order)
    learned = (F.col(kind) == stop) & (~F.col(forced) if forced else F.lit(True))
    x = steps.withColumn("_pos", F.row_number().over(w))
    x = x.withColumn("_stop", F.min(F.when(learned, F.col("_pos"))).over(Window.partitionBy(run))).withColumn("_suff", F.min(F.when(F.col(sufficient), F.col("_pos"))).over(Window.partitionBy(run)))
    late = (F.col("_pos") > F.col("_suff")) & (F.col("_pos") < F.col("_stop"))
    return x.groupBy(run).agg(
        F.count("*").alias("steps"), F.min("_stop").alias("first_stop"), F.min("_suff").alias("first_sufficient"), F.max_by(F.col(sufficient), "_pos").alias("success"),
        F.coalesce(F.max(F.when(F.col("_pos") == F.col("_stop"), ~F.col(sufficient))), F.lit(False)).alias("premature_stop"), F.min("_stop").isNull().alias("never_stop"),
        F.coalesce(_sum_if(late), F.lit(0)).alias("late_steps"), F.round(F.coalesce(F.sum(F.when(late, F.col(tokens))), F.lit(0.0)), 6).alias("late_tokens"))


def auc(points: DataFrame, by: list[str], cost: str, score: str) -> DataFrame:
    """(by, points, auc): trapezoid area over the cost range; a range of zero gives the first score."""
    w = Window.partitionBy(*by).orderBy(cost, score)
    area = (F.lead(cost).over(w) - F.col(cost)) * (F.lead(score).over(w) + F.col(score)) / 2
    x = points.withColumn("_area", area)
    width = F.max(cost) - F.min(cost)
    return x.groupBy(*by).agg(F.count("*").alias("points"), F.round(F.when(width > 0, F.sum("_area") / width).otherwise(F.min_by(score, F.struct(cost, score))), 6).alias("auc"))


def majority(votes: DataFrame, by: list[str], choice: str, least: int = 2) -> DataFrame:
    """(by, choice, votes, voters): the most frequent choice, ties by name, null under `least` votes."""
    n = votes.groupBy(*by, choice).agg(F.count("*").alias("votes"))
    w = Window.partitionBy(*by)
    top = n.withColumn("voters", F.sum("votes").over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.col("votes").desc(), choice))).where("_r = 1")
    return top.select(*by, F.when(F.col("votes") >= least, F.col(choice)).alias(choice), "votes", "voters")


def long_means(rows: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """(by, metric, tasks, mean) over the rows that carry the metric."""
    long = rows.unpivot(by, metrics, "metric", "value")
    return long.where("value is not null").groupBy(*by, "metric").agg(F.count("*").alias("tasks"), F.round(F.avg("value"), 6).alias("mean"))


def nearest_rank(df: DataFrame, by: list[str], value: str, share: float = 0.95) -> DataFrame:
    """(by, n, value): the ceil(share * n)-th smallest value."""
    w = Window.partitionBy(*by)
    x = df.where(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(w.orderBy(value))).withColumn("n", F.count("*").over(w))
    return x.where(F.col("_r") == F.ceil(F.lit(share) * F.col("n"))).select(*by, "n", value)


def common_tasks(rows: DataFrame, task: str, run: str) -> DataFrame:
    """(task): tasks that every run holds."""
    runs = rows.agg(F.countDistinct(run).alias("_runs"))
    return rows.groupBy(task).agg(F.countDistinct(run).alias("_n")).crossJoin(F.broadcast(runs)).where("_n = _runs").select(task)


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by a total order, by an aggregate that combines before the shuffle."""
    cols = rows.columns
    return rows.groupBy(*key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_row")).select("_row.*")


def findings(*checks: tuple[str, str, DataFrame]) -> DataFrame:
    """(code, severity, violations): one row per check, a check being (code, severity, offending rows)."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("violations")).select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), "violations") for code, severity, df in checks])
