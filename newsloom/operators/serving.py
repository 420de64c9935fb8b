"""Aggregates and selections behind the served pages: voices, cohesion, priorities, outlets, dashboards, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import word_count, words
from newsloom.operators.selection import best_per_key


def voice_counts(members: DataFrame) -> DataFrame:
    """(cluster_id, articles, voices, amplification): copies of a wire story count as its origin's voice.

    `members` (cluster_id, source_id, origin_id null if no copy).
    """
    by = members.groupBy("cluster_id").agg(F.count("*").alias("articles"), F.countDistinct(F.coalesce("origin_id", "source_id")).alias("voices"))
    return by.withColumn("amplification", F.round(F.col("articles") / F.col("voices"), 4))


def topic_coherence(members: DataFrame, most: int = 4) -> DataFrame:
    """(cluster_id, coherence): share of a cluster's titles with one of its `most` most frequent longer title words."""
    tokens = members.select("cluster_id", "article_id", F.explode(F.array_distinct(F.filter(words(F.col("title")), lambda w: F.length(w) >= 5))).alias("word"))
    top = best_per_key(tokens.groupBy("cluster_id", "word").agg(F.count("*").alias("n")), ["cluster_id"], [F.desc("n"), F.col("word")], most).select("cluster_id", "word")
    with_word = tokens.join(top, ["cluster_id", "word"]).groupBy("cluster_id").agg(F.countDistinct("article_id").alias("hit"))
    size = members.groupBy("cluster_id").agg(F.count("*").alias("size"))
    return size.join(with_word, "cluster_id", "left").select("cluster_id", F.round(F.coalesce("hit", F.lit(0)) / F.col("size"), 6).alias("coherence"))


def priorities(clusters: DataFrame, most: int = 25) -> DataFrame:
    """The clusters most in need of a second opinion: 40 (1 - confidence) + 35 n / 10 + 25 range / 60."""
    score = 40 * (1 - F.col("confidence")) + 35 * F.least(F.lit(1.0), F.col("n") / 10) + 25 * F.least(F.lit(1.0), F.col("range") / 60)
    return clusters.withColumn("priority", F.round(score, 6)).orderBy(F.desc("priority"), "cluster_id").limit(most)


def rank_labels(signals: DataFrame, weights: dict[str, float], most: int = 3, least: float = 50.0) -> DataFrame:
    """(cluster_id, labels): up to `most` signals of at least `least`, by weight x value, equal ones by the smaller value, then by name."""
    each = F.array_compact(F.array(*(F.when(F.col(n) >= least, F.struct((-F.col(n) * w).alias("order"), F.col(n).alias("value"), F.lit(n).alias("name"))) for n, w in weights.items())))
    return signals.select("cluster_id", F.array_join(F.transform(F.slice(F.array_sort(each), 1, most), lambda s: s["name"]), ",").alias("labels"))


def distribution_by(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Count, mean, sample deviation, limits and exact quartiles of a value by key."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    by = rows.groupBy(key).agg(F.count(value).alias("n"), F.round(F.avg(value), 4).alias("mean"), F.round(F.stddev_samp(value), 4).alias("deviation"), F.min(value).alias("low"), F.max(value).alias("high"), q.alias("q"))
    return by.select(key, "n", "mean", "deviation", "low", "high", *(F.round(F.col("q")[k], 4).alias(f"q{k + 1}") for k in range(3)))


def capture_rates(rows: DataFrame, key: str, ok: Column) -> DataFrame:
    """Attempts, successes and their share by key, worst first."""
    by = rows.groupBy(key).agg(F.count("*").alias("attempts"), F.count_if(ok).alias("captured"))
    return by.withColumn("rate", F.round(F.col("captured") / F.col("attempts"), 6)).orderBy("rate", key)


def recounted(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """`parents` with the number of their children, 0 without any."""
    return parents.join(children.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def disagreement(members: DataFrame) -> DataFrame:
    """(cluster_id, disagreement): polarization + half the range + 20 if both wings (<= 42 and >= 58) speak."""
    by = members.groupBy("cluster_id").agg(F.count_if(F.col("lean") <= 45).alias("l"), F.count_if(F.col("lean") > 55).alias("r"), F.count("*").alias("n"), F.min("lean").alias("low"), F.max("lean").alias("high"))
    polar = 200 * F.least("l", "r") / F.col("n")
    return by.select("cluster_id", F.round(polar + 0.5 * (F.col("high") - F.col("low")) + F.when((F.col("low") <= 42) & (F.col("high") >= 58), 20).otherwise(0), 4).alias("disagreement"))


def display_outlets(members: DataFrame, most: int = 3) -> DataFrame:
    """(cluster_id, source_id, slot): one outlet of each lean, both extremes first, then by tier.

    `members` (cluster_id, source_id, lean, tier_rank).
    """
    one = best_per_key(members, ["cluster_id", "lean"], [F.col("tier_rank"), F.col("source_id")]).drop("place")
    ends = one.groupBy("cluster_id").agg(F.min("lean").alias("low"), F.max("lean").alias("high"))
    return best_per_key(one.join(ends, "cluster_id"), ["cluster_id"], [~F.col("lean").isin(F.col("low"), F.col("high")), F.col("tier_rank"), F.col("lean")], most, "slot").select("cluster_id", "source_id", "slot")


def best_text(articles: DataFrame, key: str) -> DataFrame:
    """The longest body of each key, ties to the smallest article_id."""
    return articles.groupBy(key).agg(F.max_by("article_id", F.struct(word_count(F.col("body")), -F.col("article_id"))).alias("article_id"), F.max(word_count(F.col("body"))).alias("n_words"))


def later_corroboration(claims: DataFrame, low_hours: int = 6, high_hours: int = 24) -> DataFrame:
    """(claim_id, corroborations): later claims of other outlets on the same topic, 6 to 24 hours after.

    `claims` (claim_id, source_id, topic, at). The join is on topic and day, each claim meeting its own and the next day.
    """
    at = F.col("at").cast("timestamp")
    day = F.floor(F.unix_seconds(at) / 86400)
    early = claims.select("claim_id", "topic", F.col("source_id").alias("s"), at.alias("t")).withColumn("day", F.explode(F.sequence(F.floor(F.unix_seconds("t") / 86400), F.floor(F.unix_seconds("t") / 86400) + (high_hours + 23) // 24)))
    late = claims.select("topic", F.col("source_id").alias("other"), at.alias("u"), day.alias("day"))
    gap = F.unix_micros("u") - F.unix_micros("t")
    hit = early.join(late, ["topic", "day"]).where((F.col("s") != F.col("other")) & gap.between(low_hours * 3_600_000_000, high_hours * 3_600_000_000))
    return hit.groupBy("claim_id").agg(F.count("*").alias("corroborations"))


def with_lookback(batch: DataFrame, earlier: DataFrame, time: str, as_of: str, hours: int = 36) -> DataFrame:
    """`batch` with the earlier rows of the last `hours` whose article_id it lacks."""
    recent = earlier.where(F.col(time) >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {hours} HOURS"))
    return batch.unionByName(recent.join(batch.select("article_id"), "article_id", "left_anti").select(batch.columns))


def split_reason(clusters: DataFrame) -> DataFrame:
    """(cluster_id, reason): why a cluster is split or capped, first rule that holds; kept if none."""
    c = F.col
    return clusters.select("cluster_id", F.when(c("source_count") >= 75, "mega_capped").when((c("articles") >= 30) & (c("coherence") < 0.25), "incoherent").when((c("articles") < 5) & (c("coherence") < 0.34), "small_bag").otherwise("kept").alias("reason"))


def health(runs: DataFrame) -> DataFrame:
    """A 0 to 100 health score of each kind of run from its success share, mean gap in hours and freshness (bands)."""
    c = F.col
    gap = F.when(c("gap_hours") <= 1, 100).when(c("gap_hours") <= 2, 70).when(c("gap_hours") <= 6, 40).otherwise(10)
    return runs.select("kind", F.round(0.6 * 100 * c("ok_share") + 0.4 * gap, 2).alias("health"))
