"""Streaming versions of the event detectors, for any streaming DataFrame of
events (event_id, ts, user_id, event_type, value).

Each works as well on a batch DataFrame, and gives there what the stream has
given when it has seen the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def timed(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Event time as a timestamp with a watermark; later rows are dropped."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def windowed_counts(events: DataFrame, width: str = "1 day") -> DataFrame:
    """Counts per kind and window of event time."""
    w = timed(events).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "4 hours") -> DataFrame:
    """Events per user and session."""
    s = timed(events).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def deliveries_once(events: DataFrame, ttl: str = "1 day") -> DataFrame:
    """The first of equal deliveries; a key is forgotten after ``ttl``."""
    return timed(events, ttl).dropDuplicatesWithinWatermark(["event_id"])


def cooldown(events: DataFrame, kind: str = "error", quiet: int = 10) -> DataFrame:
    """user_id, fires, seen: an alarm per user fires at an event of ``kind`` if
    ``quiet`` events have passed since it last fired. The state of a user is
    two numbers; order is that of arrival, and within a batch that of time."""

    def fold(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since, fires = state.get if state.exists else (quiet, 0)
        seen = 0
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for k in rows["event_type"]:
            seen += 1
            if k == kind and since >= quiet:
                fires, since = fires + 1, 0
            else:
                since += 1
        state.update((since, fires))
        yield pd.DataFrame({"user_id": [key[0]], "fires": [fires], "seen": [seen]})

    by = events.groupBy("user_id")
    return by.applyInPandasWithState(fold, "user_id long, fires long, seen long", "since long, fires long", "update", GroupStateTimeout.NoTimeout)
