"""Telemetry as a stream: append log, latest-n state, windowed figures."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarrylens.operators.telemetry import METRICS_BUFFER


def append_log(log: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """JSON-lines append sink; a restart from the checkpoint writes no row twice."""
    return (
        log.writeStream.format("json").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    )


def windowed_figures(log: DataFrame, ts: str, width: str, lateness: str) -> DataFrame:
    """Count, declines and mean latency per tumbling window and category.

    Rows later than the watermark are dropped, closed windows leave the state.
    """
    timed = log.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", lateness)
    figures = timed.groupBy(F.window("__ts", width), "category").agg(
        F.count("*").alias("queries"),
        F.count_if("is_decline").alias("declined"),
        F.avg("total_latency_ms").alias("avg_latency"),
    )
    return figures.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "category", "queries", "declined", "avg_latency")


def latest_n(log: DataFrame, key: str, ts: str, value: str, n: int = METRICS_BUFFER) -> DataFrame:
    """Mean of the latest ``n`` values of each key, updated with every batch.

    The state is the n (time, value) pairs and nothing else.  Rows of a key
    reach the function in Arrow batches, each cut to n at once.
    """
    rows = log.select(
        F.col(key).cast("string").alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(value).cast("double").alias("value")
    )

    def update(group: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [tuple(pair) for pair in json.loads(state.get[0])] if state.exists else []
        for batch in batches:
            held = sorted(held + list(zip(batch["at"].tolist(), batch["value"].tolist())))[-n:]
        state.update((json.dumps(held),))
        values = [v for _, v in held]
        yield pd.DataFrame({"key": [group[0]], "n": [len(values)], "mean": [sum(values) / len(values)]})

    return rows.groupBy("key").applyInPandasWithState(
        update, "key string, n long, mean double", "held string", "update", GroupStateTimeout.NoTimeout
    )
