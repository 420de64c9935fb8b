"""Ranking signals of story clusters and their weighted combination."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.operators.enrichment import lower_quartile_of

#: Outlets up to which `cluster_signals` sends them to all tasks; more are joined by a shuffle.
BROADCAST_SOURCES = 1_000_000

# The weights of the combined rank (signals that need entities are given by the caller).
WEIGHTS = {"coverage": 0.20, "maturity": 0.16, "tier_diversity": 0.13, "consequentiality": 0.10, "authority": 0.08, "factual": 0.08, "divergence": 0.07, "perspective": 0.09, "geographic": 0.06, "velocity": 0.03}


def _saturating(x, scale: float):
    return 100 * (1 - F.exp(-x / scale))


def _capped(x, most: float):
    return F.least(F.lit(100.0), x / most * 100)


def source_signals(members: DataFrame, sources: DataFrame, home: str) -> DataFrame:
    """coverage, tier_diversity and source_count of each cluster, from its distinct outlets.

    `home` is the country whose outlets may pile up on a domestic story. Without entity data no foreign mention is known.
    """
    voices = members.select("cluster_id", "source_id").distinct().join(sources, "source_id")
    return _of_sources(voices.groupBy("cluster_id").agg(*_voice_sums(home))).select("cluster_id", "source_count", "coverage", "tier_diversity")


def _voice_sums(home: str) -> list:
    tier = F.col("tier")
    return [
        F.count("*").alias("source_count"),
        F.sum(F.when(tier == "independent", 1.5).when(tier == "international", 1.2).otherwise(1.0)).alias("weight"),
        F.count_if(tier == "us_major").alias("major"), F.count_if(tier == "international").alias("intl"), F.count_if(tier == "independent").alias("indep"),
        F.count_if(F.col("country") == home).alias("at_home"),
    ]


def _of_sources(by: DataFrame) -> DataFrame:
    c = F.col
    kinds = (c("major") > 0).cast("int") + (c("intl") > 0).cast("int") + (c("indep") > 0).cast("int")
    one_tier = (c("source_count") >= 4) & (F.greatest("major", "intl", "indep") / c("source_count") > 0.70) & (kinds < 3)
    pile = (c("source_count") >= 6) & (c("at_home") / c("source_count") > 0.70)
    weight = c("weight") * F.when(one_tier, 0.85).otherwise(1.0) * F.when(pile & (c("at_home") == c("source_count")), 0.60).when(pile, 0.80).otherwise(1.0)
    major, intl, indep = (c(x) > 0 for x in ("major", "intl", "indep"))
    diversity = (
        F.when(major & intl & indep, 100.0).when(major & intl, 80.0).when(major & indep, 70.0).when(major, 50.0)
        .when(intl & indep, 50.0).when(intl, 30.0).when(indep, 15.0).otherwise(0.0)
    )
    return by.withColumns({"coverage": _saturating(weight, 10.0), "tier_diversity": diversity})


def score_signals(members: DataFrame) -> DataFrame:
    """perspective, divergence and factual of each cluster, from its articles' scores (population deviations)."""
    return _of_scores(members.groupBy("cluster_id").agg(*_score_sums())).select("cluster_id", "perspective", "divergence", "factual")


def _score_sums() -> list:
    return [
        F.count("lean").alias("n"), F.stddev_pop("lean").alias("dev"), (F.max("lean") - F.min("lean")).alias("range"),
        F.stddev_pop("framing").alias("framing_dev"), F.stddev_pop("sensationalism").alias("sens_dev"), F.avg("rigor").alias("rigor"),
    ]


def _of_scores(by: DataFrame) -> DataFrame:
    c = F.col
    raw = 0.6 * _capped(c("dev"), 20.0) + 0.4 * _capped(c("range"), 60.0)
    floor = F.when((c("n") >= 5) & (c("dev") < 8), F.least(F.lit(45.0), c("n") * 5.0)).when((c("n") >= 3) & (c("dev") < 5), F.least(F.lit(30.0), c("n") * 5.0)).otherwise(0.0)
    perspective = F.when(c("n") == 0, 10.0).when(c("n") == 1, 15.0).otherwise(F.greatest(raw, floor))
    divergence = F.when(c("n") < 2, 0.0).otherwise(0.625 * _capped(c("framing_dev"), 25.0) + 0.375 * _capped(c("sens_dev"), 20.0))
    return by.withColumns({"perspective": perspective, "divergence": divergence, "factual": F.coalesce("rigor", F.lit(40.0))})


def _hours(later, earlier):
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 3.6e9


def time_signals(members: DataFrame, as_of: str) -> DataFrame:
    """recency, maturity, velocity, and the longevity factor of each cluster at the moment `as_of`."""
    now = F.lit(as_of).cast("timestamp")
    when = F.col("published_at").cast("timestamp")
    by = members.groupBy("cluster_id").agg(
        F.max(when).alias("last"), F.min(when).alias("first"), F.countDistinct("source_id").alias("voices"),
        F.countDistinct(F.when(_hours(now, when) <= 24, F.col("source_id"))).alias("fresh"),
    )
    return _of_times(by, now).select("cluster_id", "recency", "maturity", "velocity", "longevity")


def _of_times(by: DataFrame, now) -> DataFrame:
    c = F.col
    by = by.withColumn("age", F.greatest(F.lit(0.0), _hours(now, c("last")))).withColumn("birth", F.greatest(F.lit(0.0), _hours(now, c("first")))).withColumn("span", _hours(c("last"), c("first")))
    half = F.when((c("voices") >= 4) & (c("span") < 6) & (c("age") < 12), 18.0).when((c("voices") >= 3) & (c("age") < 6), 15.0).otherwise(12.0)
    recency = 100 * F.exp(-F.log(F.lit(2.0)) / half * c("age"))
    maturity = recency * (0.4 + 0.6 * F.log2(1 + F.least(c("voices"), F.lit(40))) / F.log2(F.lit(41.0)))
    a = c("age")
    decay = (
        F.when(a < 6, 1.0).when(a < 12, 1 - 0.05 * (a - 6) / 6).when(a < 24, 0.95 - 0.10 * (a - 12) / 12)
        .when(a < 36, 0.85 - 0.15 * (a - 24) / 12).when(a < 48, 0.70 - 0.15 * (a - 36) / 12).otherwise(0.5)
    )
    decay = F.when(c("voices") >= 30, F.greatest(decay, F.lit(0.75))).when(c("voices") >= 15, F.greatest(decay, F.lit(0.65))).otherwise(decay)
    birth = F.when(c("birth") >= 48, 0.90).when(c("birth") >= 36, 0.93).when(c("birth") >= 24, 0.96).otherwise(1.0)
    birth = F.when(c("voices") >= 30, F.greatest(birth, F.lit(0.95))).otherwise(birth)
    return by.withColumns({"recency": recency, "maturity": maturity, "velocity": _saturating(c("fresh"), 4.0), "longevity": decay * birth})


def cluster_signals(members: DataFrame, sources: DataFrame, home: str, as_of: str) -> DataFrame:
    """The columns of `source_signals`, `score_signals` and `time_signals` with avg_sensationalism and cluster_confidence (the lower
    quartile of confidence), for clusters with a known outlet and a confidence.

    Members are dealt by cluster once, where one aggregation gives all of them. An outlet counts at its latest member.
    """
    now, when = F.lit(as_of).cast("timestamp"), F.col("published_at").cast("timestamp")
    outlets = sources.groupBy("source_id").agg(*_voice_sums(home))  # an outlet that is listed twice counts twice
    if sources.count() <= BROADCAST_SOURCES:
        outlets = F.broadcast(outlets)
    rows = members.select("cluster_id", "source_id", "lean", "framing", "sensationalism", "rigor", "confidence", when.alias("when"))
    rows = rows.join(outlets, "source_id", "left").repartition("cluster_id")
    latest = F.row_number().over(Window.partitionBy("cluster_id", "source_id").orderBy(F.desc("when")))
    rows = rows.withColumn("voice", (latest == 1) & F.col("source_id").isNotNull())
    counted = ("source_count", "weight", "major", "intl", "indep", "at_home")
    by = rows.groupBy("cluster_id").agg(
        *_score_sums(), *(F.sum(F.when(F.col("voice"), F.col(x))).alias(x) for x in counted), F.max("when").alias("last"), F.min("when").alias("first"),
        F.count_if("voice").alias("voices"), F.count_if(F.col("voice") & (_hours(now, F.col("when")) <= 24)).alias("fresh"),
        F.avg("sensationalism").alias("avg_sensationalism"), lower_quartile_of("confidence").alias("cluster_confidence"), F.count("confidence").alias("trusted"),
    ).where("cluster_id is not null and source_count > 0 and trusted > 0")
    names = ("source_count", "coverage", "tier_diversity", "recency", "maturity", "velocity", "longevity", "perspective", "divergence", "factual", "avg_sensationalism", "cluster_confidence")
    return _of_times(_of_scores(_of_sources(by)), now).select("cluster_id", *names)


def rank_clusters(signals: DataFrame) -> DataFrame:
    """headline_rank and is_headline from the joined signals of each cluster.

    `signals` has the WEIGHTS' columns with source_count, cluster_confidence (0 to 1), longevity, avg_sensationalism and
    soft (a soft-news category). Gates multiply in their order; the result keeps at least 40 % of the rank before them.
    """
    c = F.col
    total = sum((c(n) * w for n, w in WEIGHTS.items()), F.lit(0.0))
    trust = 0.65 + 0.35 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), c("cluster_confidence")))
    trust = F.when((c("source_count") >= 15) & (c("factual") > 40), F.greatest(trust, F.lit(0.85))).otherwise(trust)
    before = total * trust * c("longevity")
    gates = [
        F.when(c("consequentiality") < 5, 0.82).otherwise(1.0),
        F.when(c("source_count") == 2, 0.85).when(c("source_count") <= 4, 0.92).otherwise(1.0),
        F.when(c("soft"), 0.78).otherwise(1.0),
        F.when((c("factual") <= 55) & (c("avg_sensationalism") > 65), 0.80).when((c("factual") <= 55) & (c("avg_sensationalism") > 55), 0.90).otherwise(1.0),
        F.when(c("factual") < 30, 0.88).otherwise(1.0),
        F.when((c("source_count") == 1) & (c("factual") >= 70), 0.75).when(c("source_count") == 1, 0.65).otherwise(1.0),
    ]
    after = before
    for g in gates:
        after = after * g
    rank = F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.greatest(after, before * 0.40))), 2)
    ranked = signals.withColumn("headline_rank", rank)
    return ranked.select("cluster_id", "headline_rank", ((c("source_count") >= 8) & (c("headline_rank") >= 40)).alias("is_headline"))


def rescale(rank, low: float = 5.0, share: float = 0.95):
    """A rank from 0 to 100 on the shown scale."""
    return F.bround(low + share * F.least(F.greatest(rank, F.lit(0.0)), F.lit(100.0)), 2)
