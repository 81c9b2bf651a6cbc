"""Micro-batch versions: windowed counts with a watermark, and states kept per user."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Which event leads from which phase to which; others leave the phase as it is.
TRANSITIONS = {("FORMULATE", "view"): "SEARCH", ("SEARCH", "click"): "BROWSE", ("BROWSE", "signup"): "SEARCH", ("SEARCH", "purchase"): "DONE", ("BROWSE", "purchase"): "DONE"}
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of event files that appear in a folder."""
    return spark.readStream.schema(EVENTS.replace("ts timestamp", "ts timestamp_ntz")).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and error share by window and type; rows later than the watermark are left out."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def running_states(events: DataFrame) -> DataFrame:
    """(user_id, state, n): the state machine carried from batch to batch; each batch's rows of a user in order of time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now, n = state.get if state.exists else ("FORMULATE", 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for action in rows["event_type"]:
            now, n = TRANSITIONS.get((now, action), now), n + 1
        state.update((now, n))
        yield pd.DataFrame({"user_id": [key[0]], "state": [now], "n": [n]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, state string, n long", "state string, n long", "update", "NoTimeout")
