"""Streaming forms of three operators. They are an extension: the batch operators have the same results.

State is bounded by watermarks; sinks get each result once through checkpoints.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def view_counts(views: DataFrame, time: str = "updated_at", late: str = "1 day") -> DataFrame:
    """Views of each episode by day, one for each user and day; events later than ``late`` are left out."""
    watched = views.withWatermark(time, late).withColumn("_day", F.date_format(time, "yyyy-MM-dd"))
    once = watched.dropDuplicatesWithinWatermark(["user_id", "episode_id", "_day"])
    return once.groupBy(F.window(time, "1 day").alias("day"), "episode_id").agg(F.count(F.lit(1)).alias("n_views")).select(F.col("day.start").alias("day"), "episode_id", "n_views")


_ENTRY = "user_id string, episode_id string, time_s double, duration double, updated_at timestamp"


def progress(events: DataFrame) -> DataFrame:
    """Newest progress of each user and episode; an event older than what is known changes nothing."""

    def newest(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known = state.get if state.exists else None
        best = known
        for pdf in batches:
            for r in pdf[["time_s", "duration", "updated_at"]].itertuples(index=False):
                if best is None or r.updated_at > best[2]:
                    best = (r.time_s, r.duration, r.updated_at)
        if best is not None and best is not known:
            state.update(best)
            yield pd.DataFrame({"user_id": [key[0]], "episode_id": [key[1]], "time_s": [best[0]], "duration": [best[1]], "updated_at": [best[2]]})

    return events.groupBy("user_id", "episode_id").applyInPandasWithState(newest, _ENTRY, "time_s double, duration double, updated_at timestamp", "update", "NoTimeout")


def speech_sessions(frames: DataFrame, time: str = "ts", pause: str = "350 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Sessions of frames of a media item that follow each other within a pause."""
    timed = frames.withWatermark(time, late)
    return timed.groupBy(F.session_window(time, pause), "media_id").agg(F.count(F.lit(1)).alias("n_frames")).select("media_id", F.col("session_window.start").alias("start_at"), F.col("session_window.end").alias("end_at"), "n_frames")


def once(df: DataFrame, name: str, mode: str, checkpoint: str) -> DataStreamWriter:
    """A writer that takes in what there is and ends, into a table in memory."""
    return df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
