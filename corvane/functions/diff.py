"""Unified diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def regions(patches: DataFrame, key: str, patch: str = "patch") -> DataFrame:
    """(key, path, start_line, end_line): old-side regions of unified diffs. A pure insertion is anchored to its line; a
    new file has no old side. A header is a `--- ` line followed by a `+++ ` line."""
    lines = patches.select(key, F.posexplode(F.split(F.coalesce(patch, F.lit("")), "\n")).alias("pos", "line"))
    w = Window.partitionBy(key).orderBy("pos")
    head = F.col("line").startswith("--- ") & F.lead("line").over(w).startswith("+++ ")
    path = F.regexp_replace(F.regexp_replace(F.substring("line", 5, 1 << 20), r"\t.*$", ""), r"^[ab]/", "")
    x = lines.withColumn("head", F.when(head, path)).withColumn("path", F.last("head", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    hunk = r"^@@ -(\d+)(?:,(\d+))? \+\d+(?:,\d+)? @@"
    start, size = F.regexp_extract("line", hunk, 1), F.regexp_extract("line", hunk, 2)
    n = F.when(size == "", 1).otherwise(size.try_cast("int"))
    x = x.where(F.col("line").rlike(hunk) & F.col("path").isNotNull() & (F.col("path") != "/dev/null"))
    first = F.greatest(start.try_cast("int"), F.lit(1))
    return x.select(key, "path", first.alias("start_line"), (first + F.greatest(n, F.lit(1)) - 1).alias("end_line"))


def certificate_class(patch, test_patch):
    """missing_patch_and_test_patch, no_old_side_text_hunk or ok, of two columns."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    old = lambda c: F.coalesce(c, F.lit("")).rlike(r"(?m)^--- (?!/dev/null)[^\n]*\n\+\+\+ [^\n]*\n@@ -")
    return F.when(blank(patch) & blank(test_patch), "missing_patch_and_test_patch").when(~old(patch) & ~old(test_patch), "no_old_side_text_hunk").otherwise("ok")
