"""Structure of units: parents, children, siblings and neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Weights of the relations.
WEIGHTS = {"parent": 4.0, "child": 3.0, "import": 2.5, "sibling": 2.0, "same_file": 1.0}


def structural_edges(units: DataFrame, file: str = "file_version_id", key: str = "evidence_id", parent: str = "parent_evidence_id", start: str = "start_line", end: str = "end_line") -> DataFrame:
    """(source, target), both directions: parent and child, and neighbours in the order of spans within a file."""
    up = units.where(F.col(parent).isNotNull()).select(F.col(key).alias("a"), F.col(parent).alias("b")).join(units.select(F.col(key).alias("b")), "b", "left_semi")
    after = F.lead(key).over(Window.partitionBy(file).orderBy(start, end, key))
    along = units.select(F.col(key).alias("a"), after.alias("b")).where("b is not null")
    pairs = up.select("a", "b").unionByName(along)
    return pairs.select(F.col("a").alias("source"), F.col("b").alias("target")).unionByName(pairs.select(F.col("b").alias("source"), F.col("a").alias("target"))).distinct()


def expand(seeds: DataFrame, units: DataFrame, imports: DataFrame | None = None, key: str = "evidence_id", file: str = "file_version_id", parent: str = "parent_evidence_id", start: str = "start_line", near: int = 8, per_import: int = 4) -> DataFrame:
    """(seed, evidence_id, score, relations): what one hop from a seed reaches, the relations' weights added up. Of the
    file's other units the `near` nearest by start line count 1 / (1 + distance). `imports` (importer, imported) are
    files; of an imported one the first `per_import` units by place count."""
    u = units.select(F.col(key).alias("id"), F.col(file).alias("file"), F.col(parent).alias("up"), F.col(start).alias("at"))
    s = seeds.select(F.col(key).alias("id")).distinct().join(u, "id").select(F.col("id").alias("seed"), "file", F.col("up").alias("seed_up"), F.col("at").alias("seed_at"))
    weighted = lambda df, name, w: df.select("seed", "id", w.alias("w"), F.lit(name).alias("relation"))
    fixed = lambda df, name: weighted(df, name, F.lit(WEIGHTS[name]))
    parents = fixed(s.where("seed_up is not null").join(u.select("id"), F.col("seed_up") == F.col("id")), "parent")
    children = fixed(s.join(u, F.col("up") == F.col("seed")), "child")
    siblings = fixed(s.join(u, F.col("up") == F.col("seed_up")).where("id <> seed"), "sibling")
    mates = s.join(u, "file").where("id <> seed").withColumn("far", F.abs(F.col("at") - F.col("seed_at")))
    rank = F.row_number().over(Window.partitionBy("seed").orderBy("far", "id"))
    mates = weighted(mates.withColumn("r", rank).where(F.col("r") <= near), "same_file", WEIGHTS["same_file"] / (1 + F.col("far")))
    every = parents.unionByName(children).unionByName(siblings).unionByName(mates)
    if imports is not None:
        first = u.withColumn("r", F.row_number().over(Window.partitionBy("file").orderBy("at", "id"))).where(F.col("r") <= per_import).select(F.col("file").alias("imported"), "id")
        links = imports.select(F.col("importer").alias("file"), "imported").distinct()
        every = every.unionByName(fixed(s.join(links, "file").join(first, "imported").where("id <> seed"), "import"))
    return every.groupBy("seed", F.col("id").alias(key)).agg(F.round(F.sum("w"), 6).alias("score"), F.array_join(F.array_sort(F.collect_set("relation")), "+").alias("relations"))
