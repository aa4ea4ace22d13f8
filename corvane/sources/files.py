"""Readers of record files and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON object per line; blank lines are skipped, a malformed line is an error, an absent file is empty."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    parsed = spark.createDataFrame([], schema).schema
    return spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", parsed, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_json_or_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """An array of objects or JSON lines, with or without a byte order mark."""
    text = spark.read.option("wholetext", True).text(path).select(F.regexp_replace("value", "^\ufeff", "").alias("t"))
    parsed = spark.createDataFrame([], schema).schema
    array = text.where(F.ltrim("t").startswith("[")).select(F.explode(F.from_json("t", f"array<{parsed.simpleString()}>", {"mode": "FAILFAST"})).alias("r"))
    lines = text.where(~F.ltrim("t").startswith("[")).select(F.explode(F.split("t", "\r?\n")).alias("l")).where(F.trim("l") != "")
    return array.select("r.*").unionByName(lines.select(F.from_json("l", parsed, {"mode": "FAILFAST"}).alias("r")).select("r.*"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header and strings; a byte order mark before the header is dropped."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*(c.lstrip("\ufeff") for c in df.columns))


def read_texts(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """(file, name, text) of every file under a folder whose name matches."""
    t = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder)
    return t.select(F.input_file_name().alias("file"), F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), F.col("value").alias("text"))


def bindings(texts: DataFrame, text: str = "text", key: str = "file") -> DataFrame:
    """(key, number, id, path) of the `[CANDIDATE n] id=... path=...` lines; a number given twice in a text is an error."""
    found = texts.select(key, F.explode(F.expr(rf"regexp_extract_all({text}, '\\[CANDIDATE \\d+\\] id=\\S+ path=\\S+', 0)")).alias("b"))
    take = lambda p: F.regexp_extract("b", p, 1)
    out = found.select(key, take(r"CANDIDATE (\d+)").cast("int").alias("number"), take(r"id=(\S+)").alias("id"), take(r"path=(\S+)").alias("path"))
    n = out.groupBy(key, "number").agg(F.count("*").alias("n"), F.first("id").alias("id"), F.first("path").alias("path"))
    return n.select(key, F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("candidate given twice: "), F.col("number").cast("string"))).cast("int")).otherwise(F.col("number")).alias("number"), "id", "path")


def view(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of a whitelist, null where the table lacks one; nothing else is read."""
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns))
