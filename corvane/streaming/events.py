"""Structured Streaming: windowed counts with late data, the latest record of a key, sessions of runs."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from corvane.session import shared_dir, ship


def event_stream(spark: SparkSession, folder: str, name: str = "events", files_per_trigger: int = 64) -> DataFrame:
    """The event table as a stream of files. Its `ts` is taken as UTC."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events and values per window and type; events later than `late` are dropped once a window is closed."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "2 days") -> DataFrame:
    """The first delivery of each key; state is kept as long as copies may come."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def running_totals(events: DataFrame, enough: float = 150.0) -> DataFrame:
    """(user_id, steps, total, sufficient) after each micro-batch of a run, by state that a group keeps."""
    ship(events.sparkSession)

    def update(key, frames, state):
        steps, total = state.get if state.exists else (0, 0.0)
        for f in frames:
            steps, total = steps + len(f), total + float(f["value"].sum())
        state.update((steps, total))
        yield pd.DataFrame({"user_id": [key[0]], "steps": [steps], "total": [round(total, 4)], "sufficient": [total >= enough]})

    return events.select("user_id", "value").groupBy("user_id").applyInPandasWithState(
        update, "user_id long, steps long, total double, sufficient boolean", "steps long, total double", "update", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what is there and returns the last result, a table in the shared folder."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/corvane-stream-{uuid.uuid4().hex}"
    write = lambda df, _: df.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/out")
    stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{base}/state").foreachBatch(write).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
