"""Closed integer intervals within a group: islands, gaps, overlaps, containment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, by: list[str], start: str, end: str, touch: int = 1) -> DataFrame:
    """(by, start, end, members): overlapping, contained and adjacent intervals merged (a gap under `touch` + 1)."""
    w = Window.partitionBy(*by).orderBy(start, end)
    upto = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(upto.isNull() | (F.col(start) > upto + touch), 1).otherwise(0))
    numbered = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("members")).drop("_island")


def gaps(covered: DataFrame, whole: DataFrame, by: list[str], start: str, end: str, first: str = "first", last: str = "last") -> DataFrame:
    """(by, start, end): what of first..last of each group no interval covers."""
    merged = islands(covered, by, start, end).select(*by, start, end)
    bounds = whole.select(*by, first, last)
    edge = bounds.select(*by, F.col(first).alias(start), (F.col(first) - 1).alias(end)).unionByName(bounds.select(*by, (F.col(last) + 1).alias(start), (F.col(last) + 1).alias(end)))
    w = Window.partitionBy(*by).orderBy(start, end)
    both = merged.unionByName(edge).withColumn("_before", F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return both.where(F.col(start) > F.col("_before") + 1).select(*by, (F.col("_before") + 1).alias(start), (F.col(start) - 1).alias(end))


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], ls: str, le: str, rs: str, re: str, bin_size: int = 64) -> DataFrame:
    """Pairs of intervals of the same group that share a point, and how many points they share.

    Both sides are spread over bins of `bin_size`, so a group with very many intervals is joined bin by bin; a pair is
    kept in the first bin that both reach, hence once."""
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / bin_size), F.floor(F.col(e) / bin_size))).alias("_bin")
    a = left.where(F.col(ls) <= F.col(le)).select("*", bins(ls, le))
    b = right.where(F.col(rs) <= F.col(re)).select("*", bins(rs, re))
    return (
        a.join(b, [*on, "_bin"]).where((F.col(ls) <= F.col(re)) & (F.col(rs) <= F.col(le)))
        .where(F.col("_bin") == F.floor(F.greatest(ls, rs) / bin_size))
        .withColumn("shared", F.least(le, re) - F.greatest(ls, rs) + 1).drop("_bin")
    )


def map_regions(regions: DataFrame, units: DataFrame, on: list[str], region: str, unit: str, rs: str, re: str, us: str, ue: str) -> DataFrame:
    """(region, unit): the smallest unit that contains a region, or where none does, every unit that overlaps it."""
    hit = overlap_join(regions, units, on, rs, re, us, ue)
    inside = (F.col(us) <= F.col(rs)) & (F.col(ue) >= F.col(re))
    w = Window.partitionBy(region)
    hit = hit.withColumn("_inside", inside).withColumn("_any", F.max(inside).over(w))
    rank = F.row_number().over(w.orderBy(F.col("_inside").desc(), F.col(ue) - F.col(us), unit))
    return hit.withColumn("_rank", rank).where(~F.col("_any") | (F.col("_inside") & (F.col("_rank") == 1))).select(region, unit).distinct()


def best_anchor(regions: DataFrame, units: DataFrame, on: list[str], region: str, unit: str, rs: str, re: str, us: str, ue: str) -> DataFrame:
    """(region, unit, shared): the unit that shares most lines with a region, then the shortest, then by id."""
    hit = overlap_join(regions, units, on, rs, re, us, ue)
    rank = F.row_number().over(Window.partitionBy(region).orderBy(F.col("shared").desc(), F.col(ue) - F.col(us), unit))
    return hit.withColumn("_rank", rank).where("_rank = 1").select(region, unit, "shared")
