"""Top-k, latest-wins, caps, round robin and gaps: window semantics over stories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def best_per_key(rows: DataFrame, keys: list[str], order: list[Column], k: int = 1, place: str = "place") -> DataFrame:
    """The first `k` rows of each key; `place` counts them from 1. Spark limits each partition before the shuffle."""
    return rows.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(place) <= k)


def capped_members(members: DataFrame, cap: int) -> DataFrame:
    """Up to `cap` members of each cluster: the first of every outlet before further ones, then by tier.

    `members` (cluster_id, article_id, source_id, tier_rank).
    """
    own = Window.partitionBy("cluster_id", "source_id").orderBy("tier_rank", "article_id")
    return best_per_key(members.withColumn("turn", F.row_number().over(own)), ["cluster_id"], [F.col("turn") > 1, F.col("tier_rank"), F.col("turn"), F.col("article_id")], cap)


def round_robin(members: DataFrame, bucket: str, order: list[Column], cap: int) -> DataFrame:
    """Up to `cap` members of each cluster, one of each bucket in turn."""
    turn = F.row_number().over(Window.partitionBy("cluster_id", bucket).orderBy(*order))
    return best_per_key(members.withColumn("turn", turn), ["cluster_id"], [F.col("turn"), F.col(bucket)], cap)


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0, most: int = 50) -> DataFrame:
    """Rows `offset` on, between 1 and `most` of them."""
    return rows.orderBy(*order).offset(max(offset, 0)).limit(min(max(limit, 1), most))


def feed_query(clusters: DataFrame, sections: str, section: str, limit: int) -> DataFrame:
    """The best-ranked clusters whose array `sections` contains `section`."""
    return clusters.where(F.array_contains(sections, section)).orderBy(F.desc("rank"), "cluster_id").limit(limit)


def edition_positions(clusters: DataFrame, candidates: int = 100, least_sources: int = 3, most: int = 50) -> DataFrame:
    """Positions 1 to `most` among the best `candidates` clusters with enough sources."""
    top = clusters.orderBy(F.desc("rank"), "cluster_id").limit(candidates).where(F.col("source_count") >= least_sources)
    placed = top.withColumn("position", F.row_number().over(Window.orderBy(F.desc("rank"), "cluster_id")))  # at most `candidates` rows
    return placed.where(F.col("position") <= most)


def rolling_count(events: DataFrame, key: str, time: str, seconds: int) -> DataFrame:
    """Events of each key in the `seconds` up to and including each event (`in_window`), for rate limits."""
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    last = Window.partitionBy(key).orderBy(micros).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("in_window", F.count("*").over(last))


def gaps(events: DataFrame, key: str, time: str, order: str) -> DataFrame:
    """Seconds since the previous event of each key (null for its first)."""
    before = F.lag(time).over(Window.partitionBy(key).orderBy(time, order))
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    return events.withColumn("gap_s", (micros(F.col(time)) - micros(before)) / 1_000_000)


def percentile_flags(rows: DataFrame, value: str, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Flags rows at or under the element at floor(n * low), and at or over that at floor(n * high), of the sorted values.

    The two limits come from counts of distinct values, not from one sorted list of all rows.
    """
    counted = rows.groupBy(value).agg(F.count("*").alias("n"))
    total = rows.agg(F.count(value).alias("total"))
    part = counted.where(F.col(value).isNotNull()).repartitionByRange(value).withColumn("part", F.spark_partition_id())
    sizes = part.groupBy("part").agg(F.sum("n").alias("size"))  # one row for each range partition
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    upto = part.join(F.broadcast(before), "part").withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy(value)))
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(F.col("total") * q), F.col(value)))
    limits = upto.join(F.broadcast(total)).agg(at(low).alias("low_limit"), at(high).alias("high_limit"))
    out = rows.join(F.broadcast(limits))
    return out.withColumn("is_low", F.col(value) <= F.col("low_limit")).withColumn("is_high", F.col(value) >= F.col("high_limit"))


def cap_same_event(clusters: DataFrame, event: str, keep: int = 2, decay: float = 0.80) -> DataFrame:
    """rank, decayed for all but `keep` clusters of an event: the most-sourced one and the best ranked others."""
    first = Window.partitionBy(event).orderBy(F.desc("source_count"), F.desc("rank"), "cluster_id")
    marked = clusters.withColumn("canonical", (F.row_number().over(first) == 1) & F.col(event).isNotNull())
    then = Window.partitionBy(event).orderBy(F.desc("canonical"), F.desc("rank"), "cluster_id")
    place = F.row_number().over(then)
    return marked.withColumn("event_place", place).withColumn("rank", F.when(F.col(event).isNotNull() & (F.col("event_place") > keep), F.bround(F.col("rank") * decay, 2)).otherwise(F.col("rank")))
