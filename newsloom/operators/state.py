"""State kept across runs: moving averages, health counters and track records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def moving_average(batches: DataFrame, keys: list[str], order: str, value: str, alpha: float = 0.3) -> DataFrame:
    """The exponential moving average of each key after its last batch, batches taken in order.

    `batches` holds one row for each key and batch; the fold runs over a key's batches, which are few.
    """
    series = batches.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, F.col(value).cast("double").alias("v")))).alias("s"))
    fold = F.aggregate(F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))), F.col("s")[0]["v"], lambda acc, x: acc * (1 - alpha) + x["v"] * alpha)
    return series.select(*keys, F.size("s").cast("long").alias("batches"), F.bround(fold, 2).alias("average"))


def blend_prior(rows: DataFrame, state: DataFrame, keys: list[str], value: str, weight: float = 0.7) -> DataFrame:
    """`value` blended with the latest state of the keys (0.7 to 0.3 by default); rows without a state keep theirs."""
    joined = rows.join(state.select(*keys, F.col("average").alias("prior")), keys, "left")
    return joined.withColumn("blended", F.round(F.when(F.col("prior").isNull(), F.col(value)).otherwise(weight * F.col(value) + (1 - weight) * F.col("prior")), 4))


def failure_streaks(events: DataFrame, key: str, order: str, failed: str) -> DataFrame:
    """Failures of each key since its last success, and whether it is quarantined (5 or more)."""
    last = F.max(F.when(~F.col(failed), F.col(order)))
    marks = events.groupBy(key).agg(last.alias("last_ok"))
    since = events.join(marks, key).where(F.col(failed) & (F.col("last_ok").isNull() | (F.col(order) > F.col("last_ok"))))
    streaks = since.groupBy(key).agg(F.count("*").alias("failures"))
    return marks.join(streaks, key, "left").select(key, F.coalesce("failures", F.lit(0)).cast("long").alias("failures"), (F.coalesce("failures", F.lit(0)) >= 5).alias("quarantined"))


def track_record(outcomes: DataFrame, key: str, outcome: str) -> DataFrame:
    """Counts of outcomes of each key and the share that was corroborated, for keys with any."""
    by = outcomes.groupBy(key).agg(F.count("*").alias("claims"), F.count_if(F.col(outcome) == "corroborated").alias("corroborated"), F.count_if(F.col(outcome) == "disputed").alias("disputed"))
    return by.withColumn("rate", F.round(F.col("corroborated") / F.col("claims"), 3))
