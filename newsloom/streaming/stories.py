"""Structured Streaming versions of the windowed and stateful operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from newsloom.shared import path_exists


def with_event_time(events: DataFrame, time: str = "ts", late: str = "2 days") -> DataFrame:
    """`events` with a timestamp that watermarks accept; rows later than `late` are dropped by the operators below."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def window_counts(events: DataFrame, time: str, size: str, slide: str | None, key: str) -> DataFrame:
    """Events and their sum by key in tumbling or sliding windows."""
    by = F.window(time, size, slide) if slide else F.window(time, size)
    out = events.groupBy(by.alias("w"), key).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, key: str) -> DataFrame:
    """Sessions of each key: events no more than `gap` apart."""
    out = events.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(events: DataFrame, keys: list[str]) -> DataFrame:
    """Each key once while its watermark holds it."""
    return events.dropDuplicatesWithinWatermark(keys)


def running_average(events: DataFrame, key: str, value: str, alpha: float = 0.3) -> DataFrame:
    """(key, n, average): an exponential moving average of each key in arrival order, updated with every micro-batch."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, average = state.get if state.exists else (0, 0.0)
        for rows in batches:
            for v in rows.sort_values("seq")["v"]:
                average = float(v) if n == 0 else average * (1 - alpha) + float(v) * alpha
                n += 1
        state.update((n, average))
        yield pd.DataFrame({key: [k[0]], "n": [n], "average": [average]})

    rows = events.select(key, F.col(value).cast("double").alias("v"), F.col("event_id").alias("seq"))
    return rows.groupBy(key).applyInPandasWithState(update, f"{key} string, n long, average double", "n long, average double", "update", GroupStateTimeout.NoTimeout)


def upsert_sink(path: str, keys: list[str]):
    """A foreachBatch function that keeps the first row of each key under `path`: later repeats are ignored."""

    def write(batch: DataFrame, _: int) -> None:
        spark, fresh = batch.sparkSession, batch.dropDuplicates(keys)
        if path_exists(spark, path):
            fresh = fresh.join(spark.read.schema(batch.schema).parquet(path).select(keys), keys, "left_anti")
        fresh.write.mode("append").parquet(path)

    return write
