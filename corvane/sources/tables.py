"""Readers of the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table `name` under `folder`; filters and projections on it are pushed into the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
