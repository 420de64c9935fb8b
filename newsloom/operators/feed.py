"""The feed's order, the archive's search, weekly threads and the curated tallies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.functions.text import words
from newsloom.operators.selection import best_per_key


def lead_gate(clusters: DataFrame, least_sources: int = 3, slots: int = 10) -> DataFrame:
    """Ranks with clusters of few sources held under the tenth well-sourced one."""
    well = clusters.where(F.col("source_count") >= least_sources).orderBy(F.desc("rank"), "cluster_id").limit(slots)
    limit = well.agg(F.when(F.count("*") == slots, F.greatest(F.lit(0.0), F.min("rank") - 0.1)).alias("limit"))
    held = (F.col("source_count") < least_sources) & F.col("limit").isNotNull() & (F.col("rank") > F.col("limit"))
    return clusters.join(F.broadcast(limit)).withColumn("rank", F.when(held, F.bround("limit", 2)).otherwise(F.col("rank"))).drop("limit")


def diverse_top(clusters: DataFrame, slots: int = 10, soft: tuple[str, ...] = (), most: int = 2, most_soft: int = 1, candidates: int = 300) -> DataFrame:
    """(cluster_id, position): the first `slots` in rank order with at most `most` of a category, then the others.

    Within a category only the first `most` can be promoted, so a row number per category replaces the greedy walk.
    """
    top = clusters.orderBy(F.desc("rank"), "cluster_id").limit(candidates)
    own = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("rank"), "cluster_id"))
    cap = F.when(F.col("category").isin(*soft), most_soft).otherwise(most) if soft else F.lit(most)
    within = top.withColumn("fits", own <= cap)
    placed = within.withColumn("turn", F.row_number().over(Window.partitionBy("fits").orderBy(F.desc("rank"), "cluster_id")))
    promoted = F.col("fits") & (F.col("turn") <= slots)
    return placed.select("cluster_id", F.row_number().over(Window.orderBy(F.desc(promoted), F.desc("rank"), "cluster_id")).alias("position"))


def decreasing(ordered: DataFrame, step: float = 0.1) -> DataFrame:
    """Ranks made strictly decreasing along `position` (a few hundred rows, folded in one array)."""
    rows = F.sort_array(F.collect_list(F.struct("position", "rank", "cluster_id")))
    zero = F.array().cast("array<struct<cluster_id: bigint, position: int, rank: double>>")

    def put(acc, x):
        last = F.element_at(acc, -1)["rank"]
        rank = F.when((F.size(acc) > 0) & (x["rank"] >= F.when(F.size(acc) > 0, last)), F.bround(last - step, 2)).otherwise(x["rank"])
        return F.concat(acc, F.array(F.struct(x["cluster_id"].cast("bigint").alias("cluster_id"), x["position"].cast("int").alias("position"), rank.cast("double").alias("rank"))))

    return ordered.agg(rows.alias("r")).select(F.inline(F.aggregate("r", zero, lambda acc, x: F.when(F.size(acc) == 0, F.array(F.struct(x["cluster_id"].cast("bigint").alias("cluster_id"), x["position"].cast("int").alias("position"), x["rank"].cast("double").alias("rank")))).otherwise(put(acc, x)))))


def search(printed: DataFrame, query: str, as_of: str, collapse: bool = True, limit: int = 20, offset: int = 0) -> DataFrame:
    """Printed stories that hold all words of `query`: term share x breadth x age, one for each thread if collapsed.

    `printed` (story_id, thread, day, title, source_count). thread_printings counts the thread before any filter.
    """
    terms = sorted(set(query.lower().split()))
    tokens = words(F.col("title"))
    found = sum((F.size(tokens) - F.size(F.array_remove(tokens, t)) for t in terms), F.lit(0))
    printings = printed.groupBy("thread").agg(F.count("*").alias("thread_printings"))
    hit = printed.where(F.array_size(F.array_intersect(tokens, F.array(*map(F.lit, terms)))) == len(terms))
    age = F.date_diff(F.lit(as_of).cast("date"), "day")
    rank = found / F.greatest(F.size(tokens), F.lit(1)) * (1 + F.least("source_count", F.lit(60)) / 120.0) * (0.5 + 0.5 * F.exp(-age / 90.0))
    scored = hit.withColumn("rank", F.round(rank, 8)).join(printings, "thread")
    if collapse:
        scored = best_per_key(scored, ["thread"], [F.desc("rank"), F.desc("day"), F.col("story_id")]).drop("place")
    return scored.orderBy(F.desc("rank"), F.desc("day"), "story_id").offset(max(offset, 0)).limit(min(max(limit, 1), 50))


def weekly_threads(clusters: DataFrame) -> DataFrame:
    """(week, thread, weekly_score): five signals, each over its week's maximum. `clusters` (week, thread, day, source_count, rank, divergence, edition)."""
    by = clusters.groupBy("week", "thread").agg(F.countDistinct("day").alias("days"), F.sum("source_count").alias("sources"), F.max("rank").alias("peak"), F.countDistinct("edition").alias("editions"), F.sum("divergence").alias("divergence"))
    # The weights; the share of brief mentions is the caller's to add.
    weights = {"days": 0.25, "sources": 0.20, "peak": 0.15, "editions": 0.10, "divergence": 0.10}
    most = by.groupBy("week").agg(*(F.max(c).alias(f"most_{c}") for c in weights))
    score = sum((F.when(F.col(f"most_{c}") > 0, F.col(c) / F.col(f"most_{c}")).otherwise(F.col(c)) * w for c, w in weights.items()), F.lit(0.0))
    return by.join(most, "week").select("week", "thread", F.round(score, 6).alias("weekly_score"))


def success_band(factors: DataFrame, key: str) -> DataFrame:
    """Counts of factor directions of each key and the band of their difference."""
    by = factors.groupBy(key).agg(F.count_if(F.col("direction") == "favors-movement").alias("favors"), F.count_if(F.col("direction") == "favors-regime").alias("against"), F.count("*").alias("total"))
    net = F.col("favors") - F.col("against")
    return by.withColumn("band", F.when(net >= 2, "Favorable").when(net <= -2, "Low").otherwise("Contested"))


def sections_replaced(rows: DataFrame, column: str, old: str, new: str) -> DataFrame:
    """`rows` with `old` replaced by `new` in an array column."""
    return rows.withColumn(column, F.transform(column, lambda s: F.when(s == old, new).otherwise(s)))


def shortened(text, opinion, most: int = 300):
    """Bodies cut to 297 characters and an ellipsis, unless they are opinion."""
    return F.when(~opinion & (F.length(text) > most), F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)
