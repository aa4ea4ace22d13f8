"""Views that several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.metrics import latest
from corvane.sources.tables import table

UNITS_SQL = "units AS (SELECT * FROM evidence QUALIFY row_number() OVER (PARTITION BY evidence_id ORDER BY ingested_at DESC, extracted_at DESC) = 1)"
TASKS_SQL = "tasks AS (SELECT * FROM normalize_swebench_task QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY ingested_at DESC, created_at DESC NULLS LAST) = 1)"


def units(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The last delivery of each evidence unit; only the columns asked for are read and shuffled."""
    t = table(spark, folder, "evidence").select("evidence_id", *columns, "ingested_at", "extracted_at")
    return latest(t, ["evidence_id"], [F.col("ingested_at"), F.col("extracted_at")]).drop("ingested_at", "extracted_at")


def tasks(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The last delivery of each task."""
    t = table(spark, folder, "normalize_swebench_task").select("task_id", *columns, F.col("ingested_at").alias("_in"), F.col("created_at").alias("_at"))
    return latest(t, ["task_id"], [F.col("_in"), F.col("_at")]).drop("_in", "_at")
