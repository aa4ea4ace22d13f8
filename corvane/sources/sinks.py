"""Writers: record streams with reports, split merges, verified exports, staged publication."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_stream(df: DataFrame, path: str, kind: str = "parquet") -> dict:
    """Writes parquet (zstd) or JSON lines; returns {path, kind, rows, bytes}. The rows are counted while writing."""
    seen = Observation()
    w = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists")
    w.option("compression", "zstd").parquet(path) if kind == "parquet" else w.option("ignoreNullFields", False).json(path)
    p, fs = _fs(df.sparkSession, path)
    return {"path": path, "kind": kind, "rows": seen.get["rows"], "bytes": fs.getContentSummary(p).getLength()}


def write_manifest(spark: SparkSession, path: str, reports: list[dict], **extra) -> dict:
    """One JSON object with the reports, their sum, and what else is given."""
    m = {"files": reports, "rows": sum(r["rows"] for r in reports), **extra}
    p, fs = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(m, sort_keys=True, ensure_ascii=False).encode()))
    out.close()
    return m


def publish(spark: SparkSession, staged: str, target: str) -> None:
    """Renames a staged folder to its target; what was there is set aside first and put back if the rename fails."""
    (s, fs), (t, _), (old, _) = _fs(spark, staged), _fs(spark, target), _fs(spark, target + ".previous")
    had = fs.exists(t)
    if had:
        fs.delete(old, True)
        fs.rename(t, old)
    if not fs.rename(s, t):
        if had:
            fs.rename(old, t)
        raise OSError(f"could not publish {staged}")
    if had:
        fs.delete(old, True)


def merge_splits(parts: dict[str, DataFrame]) -> DataFrame:
    """The union of split tables with their split's name; columns are aligned by name, missing ones are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn("split", F.lit(s)) for s, df in parts.items()))


def verified(units: DataFrame, content: str = "content", digest: str = "content_sha256") -> DataFrame:
    """Units whose content matches its digest; the first that doesn't fails the job."""
    fine = F.sha2(content, 256) == F.col(digest)
    return units.withColumn(content, F.when(fine | F.col(digest).isNull(), F.col(content)).otherwise(F.raise_error(F.concat(F.lit("digest of "), F.col("evidence_id"))).cast("string")))
