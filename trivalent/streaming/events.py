"""Structured Streaming over events: windows, duplicates, change states by key, and sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_folder(spark: SparkSession, folder: str, schema: str = SCHEMA, files: int = 10) -> DataFrame:
    """New parquet files of a folder, some at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def windowed_counts(events: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type; rows later than the watermark are left out."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def once(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """The first event of each key within the watermark: an idempotent insert."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def session_counts(events: DataFrame, gap: str = "45 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def change_states(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each key's last body and links are kept; every event is told as baseline, changed or unchanged. State of quiet keys expires."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get if state.exists else None
        for f in frames:
            told = []
            for r in f.sort_values(["ts", "event_id"]).itertuples():
                now = (r.event_type, r.props)
                told.append((key[0], r.event_id, "BASELINE" if last is None else "UNCHANGED" if last == now else "CHANGED"))
                last = now
            yield pd.DataFrame(told, columns=["user_id", "event_id", "state"])
        if last is not None:
            state.update(last)
        state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + 86_400_000)

    return events.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, state string", "event_type string, props string", "append", GroupStateTimeout.EventTimeTimeout)
