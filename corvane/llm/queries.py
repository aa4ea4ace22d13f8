"""The queries on training data, by name. Each takes (spark, folder) and runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe, handwritten, mixing, neardup, overlap, secrets, split, truncation, validity
from corvane.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return split.split_oversized(table(spark, folder, "evidence")).select("evidence_id").distinct()


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split.split_oversized(table(spark, folder, "evidence"))


def _overlap(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return overlap.cross_split_overlap(table(spark, folder, "normalize_swebench_task"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs, _ = _overlap(spark, folder)
    return pairs.select(F.least("eval_id", "train_id").alias("task_id_a"), F.greatest("eval_id", "train_id").alias("task_id_b")).distinct()


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    """Per split and source of the evaluation record: records, records with an overlap, their rate, pairs, and the mean
    share of an overlapping record's words that the matched intervals of all its training records cover."""
    tasks = table(spark, folder, "normalize_swebench_task").where(F.col("split").isin("validation", "benchmark"))
    own = tasks.select("split", "source", F.col("task_id").alias("eval_id")).distinct()
    pairs, coverage = _overlap(spark, folder)
    hits = pairs.groupBy("eval_id").agg(F.count("*").alias("pairs")).join(coverage, "eval_id")
    return (
        own.join(hits, "eval_id", "left").groupBy("split", "source")
        .agg(F.count("*").alias("records"), F.count("pairs").alias("overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.round(F.avg("coverage"), 6).alias("coverage"))
        .withColumn("rate", F.round(F.col("overlapping") / F.col("records"), 6))
    )


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.duplicate_pairs(*neardup.near_duplicates(table(spark, folder, "evidence")))


def p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.groups(*neardup.near_duplicates(table(spark, folder, "evidence")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return handwritten.classify(table(spark, folder, "evidence")).where("kind is not null").select("file_version_id")


def p4_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Per language and kind (hand-written counts as one): file versions."""
    kinds = handwritten.classify(table(spark, folder, "evidence"))
    return kinds.groupBy("language", F.coalesce("kind", F.lit("handwritten")).alias("kind")).agg(F.count("*").alias("files"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    found, _ = secrets.find_secrets(table(spark, folder, "evidence"))
    return found.select("file_version_id", "line_no").distinct()


def p5_redacted(spark: SparkSession, folder: str) -> DataFrame:
    evidence = table(spark, folder, "evidence")
    return secrets.redacted(evidence, secrets.find_secrets(evidence)[0])


def p5_steps(spark: SparkSession, folder: str) -> DataFrame:
    """How many values, and how many lines of theirs, each step of the search leaves."""
    return secrets.steps(table(spark, folder, "evidence"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return validity.judge(table(spark, folder, "evidence")).where("error_line is not null").select("file_version_id")


def p6_rates(spark: SparkSession, folder: str) -> DataFrame:
    return validity.rates(validity.judge(table(spark, folder, "evidence")))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p8_uses(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncated(table(spark, folder, "documents"))[0].where("truncated").select("doc_id")


def p9_rates(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.rates(truncation.truncated(table(spark, folder, "documents"))[0])


QUERIES = {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit() and callable(v)}
