"""OR-of-AND coverage: an obligation is met by any of its witness groups, a group by all of its evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def group_coverage(witness: DataFrame, selected: DataFrame, task: str, obligation: str, group: str, evidence: str) -> DataFrame:
    """(task, obligation, group, size, held, covered): relational division on the long table. `selected` holds
    (task, evidence), or (evidence) for a selection that all tasks share."""
    keys = [task, evidence] if task in selected.columns else [evidence]
    hit = selected.select(*keys).distinct().withColumn("_hit", F.lit(1))
    long = witness.select(task, obligation, group, evidence).distinct().join(hit, keys, "left")
    return long.groupBy(task, obligation, group).agg(F.count("*").alias("size"), F.count("_hit").alias("held")).withColumn("covered", F.col("held") == F.col("size"))


def obligation_coverage(groups: DataFrame, task: str, obligation: str) -> DataFrame:
    """(task, obligation, groups, covered, progress): progress is the largest share of a group that is held."""
    return groups.groupBy(task, obligation).agg(
        F.count("*").alias("groups"), F.max("covered").alias("covered"), F.round(F.max(F.col("held") / F.col("size")), 6).alias("progress"))


def completion(obligations: DataFrame, covered: DataFrame, task: str, obligation: str, mandatory: str) -> DataFrame:
    """(task, completion, progress, sufficient): completion is the met share of the mandatory obligations, null where
    there is none; progress the mean over all."""
    x = obligations.select(task, obligation, mandatory).join(covered, [task, obligation], "left")
    met = F.coalesce(F.col("covered"), F.lit(False)).cast("int")
    must = F.col(mandatory).cast("int")
    return x.groupBy(task).agg(
        F.round(F.sum(must * met) / F.nullif(F.sum(must), F.lit(0)), 6).alias("completion"), F.round(F.avg(F.coalesce("progress", F.lit(0.0))), 6).alias("progress")
    ).withColumn("sufficient", F.coalesce(F.col("completion") >= 1 - 1e-6, F.lit(False)))


def minimal_groups(witness: DataFrame, obligation: str, group: str, evidence: str) -> DataFrame:
    """(obligation, group, minimal, duplicate): a group that strictly contains another of its obligation isn't minimal;
    of equal groups all but the first are duplicates."""
    w = witness.select(obligation, group, evidence).distinct()
    sets = w.groupBy(obligation, group).agg(F.sort_array(F.collect_set(evidence)).alias("s"), F.count("*").alias("n"))
    # A null is evidence that no other group has: such a group can contain others, but none contains or equals it.
    kinds = sets.where(F.col(obligation).isNotNull() & F.col(group).isNotNull()).groupBy(obligation, "s", "n").agg(F.min(group).alias("first"))
    held = kinds.select(obligation, "s", "n", F.explode("s").alias("e"))
    often = held.groupBy(obligation, "e").agg(F.count("*").alias("c"))
    # Equal groups are one set, and a set meets only those that hold its rarest evidence.
    rarest = held.where("size(s) = n").join(often, [obligation, "e"]).groupBy(obligation, "s", "n").agg(F.min_by("e", F.struct("c", "e")).alias("e"))
    within = held.join(rarest.select(obligation, "e", F.col("s").alias("t"), F.col("n").alias("m")), [obligation, "e"]).where("m < n and size(array_except(t, s)) = 0")
    within = within.select(obligation, "s", "n").distinct().withColumn("contains", F.lit(True))
    first = kinds.where("size(s) = n").select(obligation, "s", "n", "first")
    return sets.join(within, [obligation, "s", "n"], "left").join(first, [obligation, "s", "n"], "left").select(
        obligation, group, (~(F.coalesce("contains", F.lit(False)) & F.col(group).isNotNull())).alias("minimal"), F.coalesce(F.col(group) > F.col("first"), F.lit(False)).alias("duplicate"))
