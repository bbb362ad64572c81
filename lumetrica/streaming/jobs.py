"""Structured Streaming forms: telemetry windows, resumable append, latest status, patience, rolling means."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.sinks import append_batch


def read_events(spark: SparkSession, path: str, pattern: str = "*.parquet", files_per_trigger: int = 1) -> DataFrame:
    """A stream over the events files of a folder; event time as timestamp (watermarks refuse timestamp_ntz)."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(path).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def telemetry_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count, mean and peak per window and kind; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("peak")).select("window.start", "event_type", "n", "mean", "peak")


def resume_append(stream: DataFrame, path: str, key: str, checkpoint: str):
    """Append each key once, also after a crash between write and commit and after a restart that repeats a batch; sinks.read_committed reads the result.

    A batch is named by its stream (the id that its checkpoint holds) and its number.
    """

    def batch(df: DataFrame, number: int) -> None:
        own = df.sparkSession.read.text(f"{checkpoint}/metadata").select(F.get_json_object("value", "$.id")).first()[0]
        append_batch(df, path, key, f"{own}-{number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_status(stream: DataFrame) -> DataFrame:
    """The last event kind per user; use update or complete mode."""
    return stream.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))


def patience(stream: DataFrame, threshold: float = 0.1, most: int = 3) -> DataFrame:
    """Per user, after each batch: best value so far, rows since it was kept, and whether the run should have stopped."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, bad, stopped = state.get if state.exists else (float("inf"), 0, False)
        value = pd.concat(list(batches)).sort_values(["ts", "event_id"])["value"].to_numpy(float)
        before = np.minimum.accumulate(np.concatenate([[best], value]))  # the best before each row, and after all
        worse = value > before[:-1] * (1 + threshold)
        at = np.arange(1, len(value) + 1)
        since = at - np.maximum.accumulate(np.where(worse, 0, at))  # rows since the last that was kept
        since = np.where(since == at, since + bad, since)  # none was kept yet: the rows of the batches before count on
        stopped = bool(stopped or (since >= most).any())
        best, bad = float(before[-1]), int(since[-1]) if len(since) else bad
        state.update((best, bad, stopped))
        yield pd.DataFrame({"user_id": [key[0]], "best": [best], "bad": [bad], "stopped": [stopped]})

    return stream.select("user_id", "ts", "event_id", "value").groupBy("user_id").applyInPandasWithState(
        step, "user_id long, best double, bad int, stopped boolean", "best double, bad int, stopped boolean", "update", GroupStateTimeout.NoTimeout)


def rolling_means(stream: DataFrame, width: int = 8, group: str = "event_type") -> DataFrame:
    """Per group, after each batch: how many batches it has been in, and the mean over the last `width` of these batches' means."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, held = state.get if state.exists else (0, [])
        total, n = 0.0, 0
        for part in batches:
            total, n = total + float(part["value"].sum()), n + int(part["value"].count())
        held = [*held, total / n][-width:] if n else list(held)
        seen += n > 0
        state.update((seen, held))
        yield pd.DataFrame({group: [key[0]], "batches": [seen], "rolling": [sum(held) / len(held) if held else None]})

    return stream.select(group, "value").groupBy(group).applyInPandasWithState(
        step, f"{group} string, batches long, rolling double", "seen long, held array<double>", "update", GroupStateTimeout.NoTimeout)
