"""The same questions asked of a stream: events by window and session, late ones beyond the watermark left out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed(events: DataFrame, size: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts and sums by tumbling window and type."""
    w = F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Runs of a user's events with no gap longer than this."""
    s = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(s.alias("s"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n", "total")


def running_counts(events: DataFrame) -> DataFrame:
    """Earlier events of each user as batches arrive: state is a count, a sum and the last time for each user.

    Within a batch the rule of the history holds: events of one instant don't see each other.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, last = state.get if state.exists else (0, 0.0, None)
        rows = pd.concat(frames).sort_values(["ts", "event_id"])
        out = []
        for _, same in rows.groupby("ts", sort=True):
            out += [(int(key[0]), int(e), n, total) for e in same["event_id"]]
            n, total, last = n + len(same), total + float(same["value"].fillna(0).sum()), same["ts"].iloc[0]
        state.update((n, total, last.to_pydatetime() if last is not None else None))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "prior_events", "prior_value"])

    return events.groupBy("user_id").applyInPandasWithState(
        step, "user_id long, event_id long, prior_events long, prior_value double", "n long, total double, last timestamp", "append", GroupStateTimeout.NoTimeout
    )
