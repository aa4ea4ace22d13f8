"""Merging of records about the same thing, keys of priority, and samples that repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import path_category, symbol_leaf

WORST_RANK = (1 << 31) - 1
HELD = ("in_witness", "in_certificate", "in_boundary")


def candidate_stats(rows: DataFrame, by: str, item: str) -> DataFrame:
    """(by, item, in_witness, in_certificate, in_boundary, min_rank, max_score, sources, labels, obligations) of rows with
    rank, score, source, label, obligation and the three flags, any of them null: best rank and score, whether any row
    has a flag, and the sorted distinct values."""
    names = lambda c: F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c))))
    return rows.groupBy(by, item).agg(
        *(F.coalesce(F.max(c), F.lit(False)).alias(c) for c in HELD), F.min("rank").alias("min_rank"), F.max("score").alias("max_score"),
        names("source").alias("sources"), names("label").alias("labels"), names("obligation").alias("obligations"))


def stats_key(item: str) -> list[Column]:
    """The order of candidate statistics: what was held before, what a search found, rank, score, id."""
    held = F.col(HELD[0]) | F.col(HELD[1]) | F.col(HELD[2])
    return [F.when(held, 0).otherwise(1), F.when(F.col("min_rank").isNotNull(), 0).otherwise(1), F.coalesce("min_rank", F.lit(WORST_RANK)), F.col("max_score").desc_nulls_last(), F.col(item)]


def priority_tier(path: Column, sources: Column) -> Column:
    """0 to 10: certificate or boundary, witness, patch hunk, named symbol, patch path, named path, then source, test,
    doc, resource and other files."""
    has = lambda s: F.array_contains(sources, s)
    kind = path_category(path)
    return (
        F.when(F.col("in_certificate") | F.col("in_boundary"), 0).when(F.col("in_witness"), 1).when(has("gold_patch_hunk"), 2).when(has("issue_explicit_symbol"), 3).when(has("gold_patch_path"), 4)
        .when(has("issue_explicit_path"), 5).when(kind == "source", 6).when(kind == "test", 7).when(kind == "doc", 8).when(kind == "resource", 9).otherwise(10)
    )


def priority_key(item: str) -> list[Column]:
    """The order of candidates: tier, rank, score, span of lines, path, place, id."""
    span = F.greatest(F.lit(1), F.col("end_line") - F.col("start_line") + 1)
    return [priority_tier(F.col("path"), F.col("sources")), F.coalesce("min_rank", F.lit(WORST_RANK)), F.col("max_score").desc_nulls_last(), span, F.col("path"), F.col("start_line"), F.col("end_line"), F.col(item)]


def merge_labels(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, confidence, source, annotations) of rows with confidence, source, annotation and seq: the highest confidence,
    the source of the last row that has it, all annotations."""
    return rows.groupBy(*by).agg(F.max("confidence").alias("confidence"), F.max_by("source", F.struct("confidence", "seq")).alias("source"), F.array_sort(F.collect_set("annotation")).alias("annotations"))


def merge_groups(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, mandatory, applicable, confidence, groups, annotations) of obligations with mandatory, applicable, confidence,
    group (array of ids) and annotation: flags by or, the highest confidence, distinct groups with sorted distinct ids.
    Empty groups and null ids are no groups and no ids."""
    group = F.array_sort(F.array_distinct(F.array_compact(F.coalesce("group", F.array().cast("array<string>")))))
    return rows.withColumn("_g", group).groupBy(*by).agg(
        F.coalesce(F.max("mandatory"), F.lit(False)).alias("mandatory"), F.coalesce(F.max("applicable"), F.lit(False)).alias("applicable"), F.max("confidence").alias("confidence"),
        F.array_sort(F.collect_set(F.when(F.size("_g") > 0, F.col("_g")))).alias("groups"), F.array_sort(F.collect_set("annotation")).alias("annotations"))


def matches_symbol(symbol: Column, content: Column, wanted: Column) -> Column:
    """Whether a unit is, or declares, the symbol that a text names: its name or last part is the wanted one, or one name
    ends with the other; or a line defines the last part as a function, a class or a value."""
    same = (symbol == wanted) | (symbol_leaf(symbol) == symbol_leaf(wanted)) | F.endswith(symbol, F.concat(F.lit("."), wanted)) | F.endswith(wanted, F.concat(F.lit("."), symbol))
    leaf = F.regexp_replace(symbol_leaf(wanted), r"[^A-Za-z0-9_]", "")
    pattern = F.concat(F.lit(r"(?m)^\s*(?:(?:async\s+)?def\s+"), leaf, F.lit(r"\s*\(|class\s+"), leaf, F.lit(r"\b|"), leaf, F.lit(r"\s*=)"))
    return F.coalesce((symbol != "") & same, F.lit(False)) | ((leaf != "") & F.coalesce(F.regexp_like(content, pattern), F.lit(False)))


def symbol_key(symbol: Column, wanted: Column, item: str) -> list[Column]:
    """The order of a symbol's units: the whole name, the last part, span of lines, place, id."""
    span = F.greatest(F.lit(1), F.col("end_line") - F.col("start_line") + 1)
    full = (F.coalesce(symbol, F.lit("")) != "") & (symbol == wanted)
    leaf = (F.coalesce(symbol, F.lit("")) != "") & (symbol_leaf(symbol) == symbol_leaf(wanted))
    return [F.when(full, 0).otherwise(1), F.when(leaf, 0).otherwise(1), span, F.col("start_line"), F.col(item)]


def hunk_units(hunks: DataFrame, units: DataFrame, most: int = 4) -> DataFrame:
    """(hunk, evidence, rank): a hunk's file's units, those of its symbol first, then by the lines that they share with
    the hunk, the lines between, and their span. hunks: hunk, path, symbol, start_line, end_line. units: evidence, path,
    symbol, start_line, end_line, and both have repo."""
    h = hunks.select("hunk", "repo", "path", F.col("symbol").alias("_want"), F.col("start_line").alias("_s"), F.col("end_line").alias("_e"))
    x = h.join(units.select("evidence", "repo", "path", "symbol", "start_line", "end_line"), ["repo", "path"])
    shared = F.greatest(F.lit(0), F.least("end_line", "_e") - F.greatest("start_line", "_s") + 1)
    far = F.greatest(F.lit(0), F.col("start_line") - F.col("_e"), F.col("_s") - F.col("end_line"))
    named = F.coalesce(symbol_leaf(F.col("symbol")) == symbol_leaf(F.col("_want")), F.lit(False)) & (F.coalesce("_want", F.lit("")) != "")
    order = [F.when(named, 0).otherwise(1), shared.desc(), far, F.col("end_line") - F.col("start_line"), F.col("start_line"), F.col("evidence")]
    x = x.withColumn("rank", F.row_number().over(Window.partitionBy("hunk").orderBy(*order)))
    return x.where(F.col("rank") <= most).select("hunk", "evidence", "rank")


def pick_states(states: DataFrame, by: list[str]) -> DataFrame:
    """(by, state_type, state_id, size): of each type of state the initial one with the least evidence and the others
    with the most, ties by id: the first for initial, else the last."""
    n = F.size(F.coalesce("evidence_ids", F.array().cast("array<string>")))
    least, most = F.min(F.struct(n.alias("n"), "state_id")), F.max(F.struct(n.alias("n"), "state_id"))
    x = states.groupBy(*by, "state_type").agg(least.alias("a"), most.alias("b"))
    chosen = F.when(F.col("state_type") == "initial", F.col("a")).otherwise(F.col("b"))
    return x.select(*by, "state_type", chosen["state_id"].alias("state_id"), chosen["n"].alias("size"))


def hash_order(seed: str, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(seed + "\0"), key.cast("string")), 256)


def stratified(rows: DataFrame, stratum: str, key: str, limits: dict[str, int], seed: str) -> tuple[DataFrame, DataFrame]:
    """(sample, shortages): of each stratum as many rows as its limit in the order of a seeded hash, and the strata that
    have fewer, with what they have. Strata without a limit are left out."""
    own = F.element_at(F.create_map(*(F.lit(x) for kv in limits.items() for x in kv)), F.col(stratum))
    x = rows.withColumn("_limit", own).where("_limit is not null")
    order = Window.partitionBy(stratum).orderBy(hash_order(seed, F.col(key)), key)
    sample = x.withColumn("place", F.row_number().over(order)).where("place <= _limit").drop("_limit")
    have = x.groupBy(stratum).agg(F.count("*").alias("have"))
    wanted = rows.sparkSession.createDataFrame(list(limits.items()), [stratum, "wanted"])
    return sample, wanted.join(have, stratum, "left").select(stratum, "wanted", F.coalesce("have", F.lit(0)).alias("have")).where("have < wanted")


def paired(rows: DataFrame, by: str, kind: str, kinds: list[str], limit: int, seed: str) -> DataFrame:
    """(by, place): the groups that have all kinds, the first `limit` in the order of a seeded hash."""
    whole = rows.where(F.col(kind).isin(kinds)).groupBy(by).agg(F.countDistinct(kind).alias("_n")).where(F.col("_n") == len(kinds)).select(by)
    return whole.orderBy(hash_order(seed, F.col(by)), by).limit(limit).withColumn("place", F.row_number().over(Window.orderBy(hash_order(seed, F.col(by)), by)))


def listwise_sample(actions: DataFrame, by: str, item: str, most: int, pair_quota: int, seed: str) -> DataFrame:
    """(by, item, tier, place): at most `most` of a state's actions to compare: positives, STOP, the best ranked negative
    pairs up to a quota, the best ranked negative singles, then the rest in the order of a seeded hash.

    actions: by, item, kind (single, pair, stop), label, rank. Positives all stay, even beyond `most`."""
    negative = F.col("label") == "negative"
    rank = F.coalesce("rank", F.lit(WORST_RANK))
    pairs = F.row_number().over(Window.partitionBy(by, F.col("_pair")).orderBy(rank, item))
    x = actions.where(F.col("label").isin("positive", "negative")).withColumn("_pair", (F.col("kind") == "pair") & negative).withColumn("_nth", F.when(F.col("_pair"), pairs))
    tier = F.when(F.col("label") == "positive", 0).when(F.col("kind") == "stop", 1).when(F.col("_pair") & (F.col("_nth") <= pair_quota), 2).when((F.col("kind") == "single") & F.col("rank").isNotNull(), 3).otherwise(4)
    x = x.withColumn("tier", tier)
    order = [F.col("tier"), F.when(F.col("tier") < 4, rank).otherwise(0), F.when(F.col("tier") == 4, hash_order(seed, F.col(item))), F.col(item)]
    x = x.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return x.where((F.col("place") <= most) | (F.col("tier") == 0)).select(by, item, "tier", "place")


def pair_features(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """(left, right, same_path, overlap, contained, equal_content) of pairs of units (evidence, repo, path, start_line,
    end_line, content_sha256)."""
    side = lambda s: units.select(F.col("evidence").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("repo", "path", "start_line", "end_line", "content_sha256")))
    x = pairs.select("left", "right").join(side("left"), "left").join(side("right"), "right")
    same = (F.col("repo_left") == F.col("repo_right")) & (F.col("path_left") == F.col("path_right"))
    shared = F.greatest(F.lit(0), F.least("end_line_left", "end_line_right") - F.greatest("start_line_left", "start_line_right") + 1)
    shorter = F.greatest(F.lit(1), F.least(F.col("end_line_left") - F.col("start_line_left"), F.col("end_line_right") - F.col("start_line_right")) + 1)
    ratio = F.when(same, shared / shorter).otherwise(0.0)
    return x.select("left", "right", same.alias("same_path"), F.round(ratio, 6).alias("overlap"), (ratio >= 1).alias("contained"), F.coalesce(F.col("content_sha256_left") == F.col("content_sha256_right"), F.lit(False)).alias("equal_content"))
