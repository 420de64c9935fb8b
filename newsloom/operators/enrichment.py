"""Per-cluster aggregates of article scores: means, spreads, histogram, confidence, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The score limits of the seven lean buckets.
BUCKETS = {"far_left": (None, 20), "left": (20, 35), "center_left": (35, 45), "center": (45, 55), "center_right": (55, 65), "right": (65, 80), "far_right": (80, None)}


def _between(column: str, low: int | None, high: int | None) -> str:
    return " AND ".join([f"{column} > {low}"] * (low is not None) + [f"{column} <= {high}"] * (high is not None))


def _weighted(where: str) -> str:
    only = f" FILTER (WHERE {where})" if where else ""
    return f"CASE WHEN SUM(rigor){only} > 0 THEN ROUND(SUM(lean * rigor){only} / SUM(rigor){only}) ELSE ROUND(AVG(lean){only}) END"


def bias_summary(members: DataFrame) -> DataFrame:
    """One row for each cluster_id of `members` (cluster_id, lean, sensationalism, opinion, rigor, framing, confidence, lean_unscored).

    Lean aggregates read the measured articles only, or all if none is measured. Spreads are sample
    deviations (0 for one article). One shuffle on cluster_id, of the scores themselves: a cluster has a few articles, which lie apart, so
    partial aggregates before it would be as many and several times as wide.
    """
    measured = "NOT lean_unscored"
    spread = f"COALESCE(STDDEV(lean) FILTER (WHERE {measured}), STDDEV(lean), 0)"
    confident = "CASE WHEN SUM(rigor) > 0 THEN SUM(COALESCE(confidence, 0.5D) * rigor) / SUM(rigor) ELSE AVG(COALESCE(confidence, 0.5D)) END"
    aggregates = {
        "avg_lean": f"COALESCE({_weighted(measured)}, {_weighted('')})",
        "avg_sensationalism": "CAST(ROUND(AVG(sensationalism)) AS INT)",
        "avg_opinion": "CAST(ROUND(AVG(opinion)) AS INT)",
        "avg_rigor": "CAST(ROUND(AVG(rigor)) AS INT)",
        "avg_framing": "CAST(ROUND(AVG(framing)) AS INT)",
        "lean_spread": f"ROUND({spread}, 1)",
        "framing_spread": "ROUND(COALESCE(STDDEV(framing), 0), 1)",
        "sensationalism_spread": "ROUND(COALESCE(STDDEV(sensationalism), 0), 1)",
        "opinion_spread": "ROUND(COALESCE(STDDEV(opinion), 0), 1)",
        "lean_range": f"COALESCE(MAX(lean) FILTER (WHERE {measured}) - MIN(lean) FILTER (WHERE {measured}), MAX(lean) - MIN(lean))",
        "aggregate_confidence": f"ROUND(GREATEST(0D, LEAST(1D, (0.7D * ({confident}) + 0.3D * LEAST(1D, COUNT(*) / 12D)) * (1D - LEAST(0.2D, GREATEST(0D, {spread}) / 100D)))), 8)",
        "analyzed_count": "COUNT(*)",
        "lean_measured_count": f"COUNT(*) FILTER (WHERE {measured})",
        "lean_left_count": f"COUNT(*) FILTER (WHERE {measured} AND lean <= 45)",
        "lean_center_count": f"COUNT(*) FILTER (WHERE {measured} AND lean > 45 AND lean <= 55)",
        "lean_right_count": f"COUNT(*) FILTER (WHERE {measured} AND lean > 55)",
    } | {f"{name}_count": f"COUNT(*) FILTER (WHERE {measured} AND {_between('lean', *limits)})" for name, limits in BUCKETS.items()}
    scores = ("lean", "sensationalism", "opinion", "rigor", "framing", "confidence", "lean_unscored")
    return members.select("cluster_id", *scores).repartition("cluster_id").groupBy("cluster_id").agg(*(F.expr(e).alias(n) for n, e in aggregates.items()))


def enrich_clusters(members: DataFrame, sources: DataFrame) -> DataFrame:
    """Coverage score, divergence, polarization, label and tier counts of every cluster at once."""
    summary = bias_summary(members)
    tier = F.col("tier")
    tiers = members.join(sources, "source_id").groupBy("cluster_id").agg(
        F.countDistinct("source_id").alias("source_count"), F.countDistinct(tier).alias("tier_count"),
        F.count_if(tier == "us_major").alias("us_major"), F.count_if(tier == "international").alias("international"), F.count_if(tier == "independent").alias("independent"),
    )
    least = F.least
    one = F.lit(1.0)
    coverage = least(F.lit(100.0), least(one, F.col("source_count") / 10) * 35 + F.col("tier_count") / 3 * 20 + F.col("aggregate_confidence") * 20 + F.col("avg_rigor") / 100 * 25)
    divergence = least(F.lit(100.0), least(F.col("lean_range") / 60, one) * 40 + least(F.col("lean_spread") / 20, one) * 30 + least(F.col("framing_spread") / 25, one) * 30)
    label = F.when(F.col("avg_opinion") <= 25, "Reporting").when(F.col("avg_opinion") <= 50, "Analysis").when(F.col("avg_opinion") <= 75, "Opinion").otherwise("Editorial")
    polar = F.when(F.col("lean_measured_count") > 0, F.round(200 * least("lean_left_count", "lean_right_count") / F.col("lean_measured_count")).cast("int")).otherwise(0)
    return summary.join(tiers, "cluster_id").select(
        "cluster_id", "source_count", "tier_count", "us_major", "international", "independent",
        F.round(coverage, 1).alias("coverage_score"), F.round(divergence, 3).alias("divergence_score"), label.alias("opinion_label"), polar.alias("polarization"),
    )


def consensus_points(summary: DataFrame) -> DataFrame:
    """Consensus and divergence statements of bias_summary rows, by thresholds over spreads and means."""
    c = F.col
    agree = F.array_compact(F.array(
        F.when(c("lean_spread") < 10, "lean_agrees"), F.when(c("framing_spread") < 10, "framing_agrees"),
        F.when(c("avg_rigor") >= 70, "well_sourced"), F.when(c("avg_sensationalism") < 30, "measured_tone"),
    ))
    differ = F.array_compact(F.array(
        F.when(c("lean_spread") >= 20, "lean_splits"), F.when(c("framing_spread") >= 25, "framing_splits"),
        F.when(c("sensationalism_spread") >= 20, "tone_splits"), F.when(c("opinion_spread") >= 25, "opinion_mixes"),
    ))
    return summary.select("cluster_id", F.array_join(agree, ",").alias("consensus"), F.array_join(differ, ",").alias("divergence"))


def lower_quartile_of(value: str) -> Column:
    """The element at place floor(n / 4) of the sorted values of a group, as an aggregate; null without any."""
    return F.get(F.sort_array(F.collect_list(value)), F.floor(F.count(value) / 4).cast("int"))


def lower_quartile(values: DataFrame, key: str, value: str) -> DataFrame:
    """The element at place floor(n / 4) of each key's sorted values (a discrete lower quartile)."""
    return values.where(F.col(value).isNotNull()).groupBy(key).agg(lower_quartile_of(value).alias("quartile"))


def global_idf(terms: DataFrame, total: int, key: str, term: str) -> DataFrame:
    """Document frequency and smoothed idf of each term of distinct (key, term) rows among `total` keys."""
    df = terms.select(key, term).distinct().groupBy(term).agg(F.count("*").alias("df"))
    smoothing, size = max(1, (total + 3) // 4), max(total, 30)
    return df.withColumn("idf", F.round(F.greatest(F.lit(0.05), F.log(F.lit(float(size)) / (F.col("df") + smoothing))), 6))


def kernel_density(values: DataFrame, column: str, low: float, high: float, points: int = 100) -> DataFrame:
    """(x, density): a Gaussian sum over `values` at evenly spaced points, with the robust bandwidth
    max(4, 0.9 * min(sigma, iqr / 1.34) * n ** -0.2). Values are counted first, so that the sum runs over
    distinct values rather than rows."""
    counted = values.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    stats = values.agg(F.stddev_pop(column).alias("sigma"), (F.percentile(column, F.lit(0.75)) - F.percentile(column, F.lit(0.25))).alias("iqr"), F.count(column).alias("total"))
    stats = stats.withColumn("h", F.greatest(F.lit(4.0), 0.9 * F.least("sigma", F.col("iqr") / 1.34) * F.pow("total", F.lit(-0.2))))
    grid = counted.join(F.broadcast(stats)).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", low + F.col("k") * ((high - low) / (points - 1)))
    bump = F.col("n") * F.exp(-0.5 * F.pow((F.col("x") - F.col("v")) / F.col("h"), 2)) / (F.col("h") * F.col("total") * 2.5066282746310002)
    return grid.groupBy("k").agg(F.round(F.first("x"), 6).alias("x"), F.round(F.sum(bump), 8).alias("density")).orderBy("k")
