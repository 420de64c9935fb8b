"""Registered queries: each applies operators to the whole of the driver's tables, with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.operators import audit, enrichment, joins, ranking, selection, state, stories
from newsloom.plans import story_tables as S
from newsloom.plans.story_tables import AS_OF, table, with_tables
from newsloom.streaming import stories as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *tables: str):
    """Register the function under its name, with SQL over the story tables named."""

    def add(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"query {f.__name__} is registered already")
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_tables(sql, *tables) if tables else sql
        return f

    return add


_M = "FILTER (WHERE NOT lean_unscored)"
_SPREAD = f"coalesce(stddev_samp(lean) {_M}, stddev_samp(lean), 0)"
SUMMARY_SQL = f"""
SELECT cluster_id,
  coalesce(CASE WHEN sum(rigor) {_M} > 0 THEN round(sum(lean * rigor) {_M} / sum(rigor) {_M}) ELSE round(avg(lean) {_M}) END,
           CASE WHEN sum(rigor) > 0 THEN round(sum(lean * rigor) / sum(rigor)) ELSE round(avg(lean)) END) AS avg_lean,
  CAST(round(avg(sensationalism)) AS INTEGER) AS avg_sensationalism, CAST(round(avg(opinion)) AS INTEGER) AS avg_opinion,
  CAST(round(avg(rigor)) AS INTEGER) AS avg_rigor, CAST(round(avg(framing)) AS INTEGER) AS avg_framing,
  round({_SPREAD}, 1) AS lean_spread, round(coalesce(stddev_samp(framing), 0), 1) AS framing_spread,
  round(coalesce(stddev_samp(sensationalism), 0), 1) AS sensationalism_spread, round(coalesce(stddev_samp(opinion), 0), 1) AS opinion_spread,
  coalesce(max(lean) {_M} - min(lean) {_M}, max(lean) - min(lean)) AS lean_range,
  round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (0.7::DOUBLE * (CASE WHEN sum(rigor) > 0 THEN sum(coalesce(confidence, 0.5::DOUBLE) * rigor) / sum(rigor) ELSE avg(coalesce(confidence, 0.5::DOUBLE)) END)
    + 0.3::DOUBLE * least(1.0::DOUBLE, count(*) / 12.0::DOUBLE)) * (1.0::DOUBLE - least(0.2::DOUBLE, greatest(0.0::DOUBLE, {_SPREAD}) / 100.0::DOUBLE)))), 8) AS aggregate_confidence,
  count(*) AS analyzed_count, count(*) {_M} AS lean_measured_count,
  count(*) FILTER (WHERE NOT lean_unscored AND lean <= 45) AS lean_left_count,
  count(*) FILTER (WHERE NOT lean_unscored AND lean > 45 AND lean <= 55) AS lean_center_count,
  count(*) FILTER (WHERE NOT lean_unscored AND lean > 55) AS lean_right_count,
  count(*) FILTER (WHERE NOT lean_unscored AND lean <= 20) AS far_left_count,
  count(*) FILTER (WHERE NOT lean_unscored AND lean > 20 AND lean <= 35) AS left_count,
  count(*) FILTER (WHERE NOT lean_unscored AND lean > 35 AND lean <= 45) AS center_left_count,
  count(*) FILTER (WHERE NOT lean_unscored AND lean > 45 AND lean <= 55) AS center_count,
  count(*) FILTER (WHERE NOT lean_unscored AND lean > 55 AND lean <= 65) AS center_right_count,
  count(*) FILTER (WHERE NOT lean_unscored AND lean > 65 AND lean <= 80) AS right_count,
  count(*) FILTER (WHERE NOT lean_unscored AND lean > 80) AS far_right_count
FROM members GROUP BY cluster_id"""


@query(SUMMARY_SQL, "members")
def cluster_bias_summary(spark, d):
    """Means, spreads, histogram and confidence of every cluster (the flagship)."""
    return enrichment.bias_summary(S.members(spark, d))


_ENRICH = f"""
, summary AS ({SUMMARY_SQL}), tiers AS (
  SELECT cluster_id, count(DISTINCT source_id) AS source_count, count(DISTINCT tier) AS tier_count, count(*) FILTER (WHERE tier = 'us_major') AS us_major,
         count(*) FILTER (WHERE tier = 'international') AS international, count(*) FILTER (WHERE tier = 'independent') AS independent
  FROM members JOIN sources USING (source_id) GROUP BY cluster_id)"""


@query("SELECT 1", "members")
def cluster_enrichment(spark, d):
    """Coverage, divergence, polarization, label and tier counts of every cluster."""
    return enrichment.enrich_clusters(S.members(spark, d), S.sources(spark, d))


ORACLE_SQL["cluster_enrichment"] = with_tables("", "members", "sources") + _ENRICH + """
SELECT cluster_id, source_count, tier_count, us_major, international, independent,
  round(least(100.0::DOUBLE, least(1.0::DOUBLE, source_count / 10.0::DOUBLE) * 35 + tier_count / 3.0::DOUBLE * 20 + aggregate_confidence * 20 + avg_rigor / 100.0::DOUBLE * 25), 1) AS coverage_score,
  round(least(100.0::DOUBLE, least(lean_range / 60.0::DOUBLE, 1.0::DOUBLE) * 40 + least(lean_spread / 20.0::DOUBLE, 1.0::DOUBLE) * 30 + least(framing_spread / 25.0::DOUBLE, 1.0::DOUBLE) * 30), 3) AS divergence_score,
  CASE WHEN avg_opinion <= 25 THEN 'Reporting' WHEN avg_opinion <= 50 THEN 'Analysis' WHEN avg_opinion <= 75 THEN 'Opinion' ELSE 'Editorial' END AS opinion_label,
  CASE WHEN lean_measured_count > 0 THEN CAST(round(200 * least(lean_left_count, lean_right_count) / lean_measured_count::DOUBLE) AS INTEGER) ELSE 0 END AS polarization
FROM summary JOIN tiers USING (cluster_id)"""


@query("SELECT 1", "members")
def consensus_divergence_points(spark, d):
    """Statements of agreement and difference of every cluster."""
    return enrichment.consensus_points(enrichment.bias_summary(S.members(spark, d)))


ORACLE_SQL["consensus_divergence_points"] = with_tables("", "members") + f", summary AS ({SUMMARY_SQL})" + """
SELECT cluster_id,
  concat_ws(',', CASE WHEN lean_spread < 10 THEN 'lean_agrees' END, CASE WHEN framing_spread < 10 THEN 'framing_agrees' END,
    CASE WHEN avg_rigor >= 70 THEN 'well_sourced' END, CASE WHEN avg_sensationalism < 30 THEN 'measured_tone' END) AS consensus,
  concat_ws(',', CASE WHEN lean_spread >= 20 THEN 'lean_splits' END, CASE WHEN framing_spread >= 25 THEN 'framing_splits' END,
    CASE WHEN sensationalism_spread >= 20 THEN 'tone_splits' END, CASE WHEN opinion_spread >= 25 THEN 'opinion_mixes' END) AS divergence
FROM summary"""


@query("SELECT cluster_id, list_sort(list(confidence))[CAST(floor(count(*) / 4) AS INTEGER) + 1] AS quartile FROM members GROUP BY cluster_id", "members")
def p25_confidence(spark, d):
    """The discrete lower quartile of the members' confidence."""
    return enrichment.lower_quartile(S.members(spark, d), "cluster_id", "confidence")


@query("""SELECT cluster_id, rank, rank <= low_limit AS is_low, rank >= high_limit AS is_high FROM clusters, (
  SELECT v[CAST(floor(len(v) * 0.1) AS INTEGER) + 1] AS low_limit, v[CAST(floor(len(v) * 0.9) AS INTEGER) + 1] AS high_limit FROM (SELECT list_sort(list(rank)) AS v FROM clusters))""", "clusters")
def percentile_flags(spark, d):
    """Clusters at the lower and upper tenth of the rank."""
    return selection.percentile_flags(S.clusters(spark, d), "rank").select("cluster_id", "rank", "is_low", "is_high")


@query("SELECT cluster_id, opinion > 50 AS is_opinion, n FROM (SELECT cluster_id, avg(opinion) AS opinion, count(*) AS n FROM members GROUP BY cluster_id)", "members")
def content_type(spark, d):
    """Whether a cluster's articles are opinion on average."""
    return S.members(spark, d).groupBy("cluster_id").agg((F.avg("opinion") > 50).alias("is_opinion"), F.count("*").alias("n"))


@query("""SELECT cluster_id, topic AS category FROM (SELECT cluster_id, topic_id % 7 AS topic, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, min(line), topic_id % 7) AS r
  FROM members GROUP BY cluster_id, topic_id % 7) WHERE r = 1""", "members")
def category_vote(spark, d):
    """The most frequent topic of each cluster, ties to the first."""
    votes = S.members(spark, d).groupBy("cluster_id", (F.col("topic_id") % 7).alias("category")).agg(F.count("*").alias("n"), F.min("line").alias("first"))
    return selection.best_per_key(votes, ["cluster_id"], [F.desc("n"), F.col("first"), F.col("category")]).select("cluster_id", "category")


@query("SELECT c.cluster_id, c.category, c.created_at FROM clusters c WHERE NOT EXISTS (SELECT 1 FROM members m WHERE m.cluster_id = c.cluster_id)", "clusters", "members")
def orphan_clusters(spark, d):
    """Clusters without a member."""
    return joins.orphans(S.clusters(spark, d), S.members(spark, d), "cluster_id").select("cluster_id", "category", "created_at")


@query("""SELECT 'member_cluster' AS reference, count(*) AS missing FROM members m WHERE NOT EXISTS (SELECT 1 FROM clusters c WHERE c.cluster_id = m.cluster_id)
  UNION ALL SELECT 'member_source', count(*) FROM members m WHERE NOT EXISTS (SELECT 1 FROM sources s WHERE s.source_id = m.source_id)
  UNION ALL SELECT 'cluster_owner', count(*) FROM clusters c WHERE NOT EXISTS (SELECT 1 FROM customer u WHERE u.c_custkey = c.owner_id)""", "clusters", "members", "sources")
def invalid_references(spark, d):
    """References that lead nowhere, by kind."""
    m, c = S.members(spark, d), S.clusters(spark, d)
    owners = table(spark, d, "customer").select(F.col("c_custkey").alias("owner_id"))
    bad = lambda rows, other, key, name: rows.join(other.select(key), key, "left_anti").agg(F.lit(name).alias("reference"), F.count("*").alias("missing"))
    return bad(m, c, "cluster_id", "member_cluster").unionByName(bad(m, S.sources(spark, d), "source_id", "member_source")).unionByName(bad(c, owners, "owner_id", "cluster_owner"))


@query("""SELECT page_id, host FROM (SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS host, row_number() OVER (PARTITION BY split_part(split_part(url, '://', 2), '/', 1) ORDER BY page_id) AS r FROM pages) WHERE r = 1""")
def first_url_wins(spark, d):
    """The first page of every host in ingest order."""
    pages = table(spark, d, "pages").select("page_id", F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)).alias("host"))
    return joins.first_wins(pages, ["host"], [F.col("page_id")])


@query("""SELECT user_id, count(*) AS fresh FROM events e WHERE ts >= TIMESTAMP '2024-01-20' AND NOT EXISTS
  (SELECT 1 FROM events b WHERE b.ts < TIMESTAMP '2024-01-20' AND b.ts >= TIMESTAMP '2024-01-18' AND b.user_id = e.user_id AND b.event_type = e.event_type) GROUP BY user_id""")
def known_url_filter(spark, d):
    """New arrivals by user, without those whose key was already seen in the 48 hours before."""
    e = table(spark, d, "events")
    cut = F.lit("2024-01-20").cast("timestamp_ntz")
    known = e.where((F.col("ts") < cut) & (F.col("ts") >= cut - F.expr("INTERVAL 48 HOURS"))).select("user_id", "event_type")
    return e.where(F.col("ts") >= cut).join(known, ["user_id", "event_type"], "left_anti").groupBy("user_id").agg(F.count("*").alias("fresh"))


@query("""SELECT c.cluster_id, count(m.article_id) AS n_members, coalesce(sum(m.article_id * m.lean), 0)::BIGINT AS digest FROM clusters c LEFT JOIN members m USING (cluster_id) GROUP BY c.cluster_id""", "clusters", "members")
def deep_dive_nested(spark, d):
    """Clusters with their members nested, flattened to counts and a digest."""
    nested = joins.nested_members(S.clusters(spark, d), S.members(spark, d), S.sources(spark, d))
    digest = F.aggregate("members", F.lit(0).cast("long"), lambda acc, m: acc + m["article_id"] * m["lean"])
    return nested.select("cluster_id", F.size("members").cast("long").alias("n_members"), digest.alias("digest"))


@query("""SELECT a.cluster_id, count(*) AS pairs, sum(abs(a.lean - b.lean))::BIGINT AS lean_gap FROM members a JOIN members b
  ON a.cluster_id = b.cluster_id AND a.article_id < b.article_id AND a.source_id <> b.source_id GROUP BY a.cluster_id""", "members")
def sibling_pairs(spark, d):
    """Pairs of articles of a cluster by different outlets, with how far their leans are apart."""
    m = S.members(spark, d)
    return joins.sibling_pairs(m).groupBy("cluster_id").agg(F.count("*").alias("pairs"), F.sum(F.abs(F.col("lean") - F.col("sibling_lean"))).cast("long").alias("lean_gap"))


@query("""SELECT owner_id, cluster_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY rank DESC, created_at DESC, cluster_id) AS r FROM clusters) WHERE r = 1""", "clusters")
def latest_per_thread(spark, d):
    """The best cluster of each thread (DISTINCT ON)."""
    return selection.best_per_key(S.clusters(spark, d), ["owner_id"], [F.desc("rank"), F.desc("created_at"), F.col("cluster_id")]).select("owner_id", "cluster_id", "rank")


@query("""SELECT cluster_id, article_id, place FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY turn > 1, tier_rank, turn, article_id) AS place FROM (
  SELECT cluster_id, article_id, source_id, source_id % 3 AS tier_rank, row_number() OVER (PARTITION BY cluster_id, source_id ORDER BY source_id % 3, article_id) AS turn FROM members)) WHERE place <= 3""", "members")
def capped_members(spark, d):
    """Three members of each cluster: one of every outlet first, then by tier."""
    m = S.members(spark, d).select("cluster_id", "article_id", "source_id", (F.col("source_id") % 3).alias("tier_rank"))
    return selection.capped_members(m, 3).select("cluster_id", "article_id", F.col("place").cast("long").alias("place"))


@query("""SELECT cluster_id, article_id, place FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY turn, bucket) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster_id, bucket ORDER BY source_id % 3, published_at DESC, article_id) AS turn FROM (
  SELECT *, CASE WHEN lean <= 45 THEN 0 WHEN lean <= 55 THEN 1 ELSE 2 END AS bucket FROM members))) WHERE place <= 4""", "members")
def round_robin_selection(spark, d):
    """Four members of each cluster, from left, centre and right in turn."""
    m = S.members(spark, d).withColumn("bucket", F.when(F.col("lean") <= 45, 0).when(F.col("lean") <= 55, 1).otherwise(2))
    out = selection.round_robin(m, "bucket", [F.col("source_id") % 3, F.desc("published_at"), F.col("article_id")], 4)
    return out.select("cluster_id", "article_id", F.col("place").cast("long").alias("place"))


@query("""SELECT cluster_id, rank FROM clusters WHERE list_contains([left(category, 1), status], 'F') ORDER BY rank DESC, cluster_id LIMIT 50""", "clusters")
def feed_query(spark, d):
    """The 50 best clusters of a section."""
    c = S.clusters(spark, d).withColumn("sections", F.array(F.substring("category", 1, 1), "status"))
    return selection.feed_query(c, "sections", "F", 50).select("cluster_id", "rank")


_VOICES = "SELECT cluster_id, count(DISTINCT source_id) AS source_count FROM members GROUP BY cluster_id"


@query(f"""SELECT cluster_id, row_number() OVER (ORDER BY rank DESC, cluster_id) AS position FROM (SELECT * FROM (SELECT c.*, v.source_count FROM clusters c JOIN ({_VOICES}) v USING (cluster_id)
  ORDER BY rank DESC, cluster_id LIMIT 100) WHERE source_count >= 3) QUALIFY position <= 50""", "clusters", "members")
def edition_positions(spark, d):
    """Positions in the printed edition."""
    voices = S.members(spark, d).groupBy("cluster_id").agg(F.countDistinct("source_id").alias("source_count"))
    return selection.edition_positions(S.clusters(spark, d).join(voices, "cluster_id")).select("cluster_id", F.col("position").cast("long").alias("position"))


@query(f"""SELECT cluster_id, CASE WHEN event_place > 2 THEN round_even(rank * 0.8, 2) ELSE rank END AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY canonical DESC, rank DESC, cluster_id) AS event_place FROM (
  SELECT c.cluster_id, c.owner_id, c.rank, row_number() OVER (PARTITION BY owner_id ORDER BY source_count DESC, rank DESC, cluster_id) = 1 AS canonical FROM clusters c JOIN ({_VOICES}) v USING (cluster_id)))""", "clusters", "members")
def same_event_cap(spark, d):
    """Ranks after decay of all but two clusters of an event."""
    voices = S.members(spark, d).groupBy("cluster_id").agg(F.countDistinct("source_id").alias("source_count"))
    return selection.cap_same_event(S.clusters(spark, d).join(voices, "cluster_id"), "owner_id").select("cluster_id", "rank")


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS in_window FROM events""")
def rolling_rate_limit(spark, d):
    """Events of each user in the hour up to each event."""
    return selection.rolling_count(table(spark, d, "events"), "user_id", "ts", 3600).select("event_id", "in_window")


@query("""SELECT event_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id))) / 1000000 AS gap_s FROM events""")
def run_interval_gaps(spark, d):
    """Seconds between consecutive events of a type."""
    return selection.gaps(table(spark, d, "events"), "event_type", "ts", "event_id").select("event_id", "gap_s")


_HOURS = "(epoch_us(TIMESTAMP '{as_of}') - epoch_us({col})) / 3.6e9"
_TIMES_SQL = f"""
SELECT cluster_id, round(recency, 6) AS recency, round(recency * (0.4::DOUBLE + 0.6::DOUBLE * log2(1 + least(voices, 40)) / log2(41)), 6) AS maturity,
  round(100 * (1 - exp(-fresh / 4)), 6) AS velocity, round(decay * birth_decay, 6) AS longevity FROM (
  SELECT *, 100 * exp(-ln(2) / CASE WHEN voices >= 4 AND span < 6 AND age < 12 THEN 18 WHEN voices >= 3 AND age < 6 THEN 15 ELSE 12 END * age) AS recency,
    CASE WHEN voices >= 30 THEN greatest(raw, 0.75::DOUBLE) WHEN voices >= 15 THEN greatest(raw, 0.65::DOUBLE) ELSE raw END AS decay,
    CASE WHEN voices >= 30 THEN greatest(b, 0.95::DOUBLE) ELSE b END AS birth_decay FROM (
  SELECT *, CASE WHEN age < 6 THEN 1::DOUBLE WHEN age < 12 THEN 1 - 0.05::DOUBLE * (age - 6) / 6 WHEN age < 24 THEN 0.95::DOUBLE - 0.10::DOUBLE * (age - 12) / 12
    WHEN age < 36 THEN 0.85::DOUBLE - 0.15::DOUBLE * (age - 24) / 12 WHEN age < 48 THEN 0.70::DOUBLE - 0.15::DOUBLE * (age - 36) / 12 ELSE 0.5::DOUBLE END AS raw,
    CASE WHEN birth >= 48 THEN 0.90::DOUBLE WHEN birth >= 36 THEN 0.93::DOUBLE WHEN birth >= 24 THEN 0.96::DOUBLE ELSE 1::DOUBLE END AS b FROM (
  SELECT cluster_id, count(DISTINCT source_id) AS voices, greatest(0::DOUBLE, {_HOURS.format(as_of=AS_OF, col='max(published_at)')}) AS age, greatest(0::DOUBLE, {_HOURS.format(as_of=AS_OF, col='min(published_at)')}) AS birth,
    (epoch_us(max(published_at)) - epoch_us(min(published_at))) / 3.6e9 AS span,
    count(DISTINCT CASE WHEN {_HOURS.format(as_of=AS_OF, col='published_at')} <= 24 THEN source_id END) AS fresh FROM members GROUP BY cluster_id)))"""


@query(_TIMES_SQL, "members")
def time_signals(spark, d):
    """Recency, maturity, velocity and longevity of every cluster."""
    out = ranking.time_signals(S.members(spark, d), AS_OF)
    return out.select("cluster_id", *(F.round(c, 6).alias(c) for c in ("recency", "maturity", "velocity", "longevity")))


_SOURCES_SQL = """
SELECT cluster_id, source_count, round(100 * (1 - exp(-(weight
    * CASE WHEN source_count >= 4 AND greatest(major, intl, indep) / source_count > 0.70 AND (major > 0)::INT + (intl > 0)::INT + (indep > 0)::INT < 3 THEN 0.85 ELSE 1 END
    * CASE WHEN source_count >= 6 AND at_home = source_count THEN 0.60 WHEN source_count >= 6 AND at_home / source_count > 0.70 THEN 0.80 ELSE 1 END)::DOUBLE / 10)), 6) AS coverage,
  CASE WHEN major > 0 AND intl > 0 AND indep > 0 THEN 100 WHEN major > 0 AND intl > 0 THEN 80 WHEN major > 0 AND indep > 0 THEN 70 WHEN major > 0 THEN 50
    WHEN intl > 0 AND indep > 0 THEN 50 WHEN intl > 0 THEN 30 WHEN indep > 0 THEN 15 ELSE 0 END::DOUBLE AS tier_diversity
FROM (SELECT cluster_id, count(*) AS source_count, sum(CASE tier WHEN 'independent' THEN 1.5 WHEN 'international' THEN 1.2 ELSE 1.0 END) AS weight,
  count(*) FILTER (WHERE tier = 'us_major') AS major, count(*) FILTER (WHERE tier = 'international') AS intl, count(*) FILTER (WHERE tier = 'independent') AS indep,
  count(*) FILTER (WHERE country = 'NATION_0') AS at_home
  FROM (SELECT DISTINCT cluster_id, source_id FROM members) JOIN sources USING (source_id) GROUP BY cluster_id)"""


@query(_SOURCES_SQL, "members", "sources")
def source_signals(spark, d):
    """Coverage and tier diversity of every cluster."""
    out = ranking.source_signals(S.members(spark, d), S.sources(spark, d), "NATION_0")
    return out.select("cluster_id", "source_count", F.round("coverage", 6).alias("coverage"), "tier_diversity")


_SCORES_SQL = """
SELECT cluster_id, round(CASE WHEN n = 0 THEN 10 WHEN n = 1 THEN 15 ELSE greatest(0.6::DOUBLE * least(100::DOUBLE, dev / 20 * 100) + 0.4::DOUBLE * least(100::DOUBLE, range / 60 * 100),
    CASE WHEN n >= 5 AND dev < 8 THEN least(45::DOUBLE, n * 5::DOUBLE) WHEN n >= 3 AND dev < 5 THEN least(30::DOUBLE, n * 5::DOUBLE) ELSE 0 END) END, 6) AS perspective,
  round(CASE WHEN n < 2 THEN 0 ELSE 0.625::DOUBLE * least(100::DOUBLE, framing_dev / 25 * 100) + 0.375::DOUBLE * least(100::DOUBLE, sens_dev / 20 * 100) END, 6) AS divergence, round(rigor, 6) AS factual
FROM (SELECT cluster_id, count(lean) AS n, stddev_pop(lean) AS dev, (max(lean) - min(lean))::DOUBLE AS range, stddev_pop(framing) AS framing_dev, stddev_pop(sensationalism) AS sens_dev, avg(rigor) AS rigor
  FROM members GROUP BY cluster_id)"""


@query(_SCORES_SQL, "members")
def score_signals(spark, d):
    """Perspective, divergence and factual signals of every cluster."""
    out = ranking.score_signals(S.members(spark, d))
    return out.select("cluster_id", *(F.round(c, 6).alias(c) for c in ("perspective", "divergence", "factual")))


def rank_signals(spark, d):
    """The signals of every cluster that need no words: those of sources, times and scores, with the mean sensationalism and confidence."""
    out = ranking.cluster_signals(S.members(spark, d), S.sources(spark, d), "NATION_0", AS_OF)
    names = ("coverage", "recency", "maturity", "velocity", "longevity", "perspective", "divergence", "factual")
    return out.withColumns({c: F.round(c, 6) for c in names} | {"soft": F.col("cluster_id") % 5 == 0})


@query("SELECT 1", "members")
def headline_rank(spark, d):
    """The combined rank of every cluster (signals that need entity recognition are 0)."""
    zero = F.lit(0.0)
    return ranking.rank_clusters(rank_signals(spark, d).withColumns({"consequentiality": zero, "authority": zero, "geographic": zero}))


ORACLE_SQL["headline_rank"] = with_tables("", "members", "sources") + f""", a AS ({_SOURCES_SQL}), b AS ({_TIMES_SQL}), c AS ({_SCORES_SQL}),
e AS (SELECT cluster_id, avg(sensationalism) AS sens, list_sort(list(confidence))[CAST(floor(count(*) / 4) AS INTEGER) + 1] AS conf FROM members GROUP BY cluster_id),
r AS (SELECT *, (coverage * 0.20::DOUBLE + maturity * 0.16::DOUBLE + tier_diversity * 0.13::DOUBLE + factual * 0.08::DOUBLE + divergence * 0.07::DOUBLE + perspective * 0.09::DOUBLE + velocity * 0.03::DOUBLE)
  * CASE WHEN source_count >= 15 AND factual > 40 THEN greatest(0.65::DOUBLE + 0.35::DOUBLE * conf, 0.85::DOUBLE) ELSE 0.65::DOUBLE + 0.35::DOUBLE * conf END * longevity AS before FROM a JOIN b USING (cluster_id) JOIN c USING (cluster_id) JOIN e USING (cluster_id)),
g AS (SELECT cluster_id, source_count, round_even(greatest(0::DOUBLE, least(100::DOUBLE, greatest(before * 0.82::DOUBLE
  * CASE WHEN source_count = 2 THEN 0.85::DOUBLE WHEN source_count <= 4 THEN 0.92::DOUBLE ELSE 1 END * CASE WHEN cluster_id % 5 = 0 THEN 0.78::DOUBLE ELSE 1 END
  * CASE WHEN factual <= 55 AND sens > 65 THEN 0.80::DOUBLE WHEN factual <= 55 AND sens > 55 THEN 0.90::DOUBLE ELSE 1 END * CASE WHEN factual < 30 THEN 0.88::DOUBLE ELSE 1 END
  * CASE WHEN source_count = 1 AND factual >= 70 THEN 0.75::DOUBLE WHEN source_count = 1 THEN 0.65::DOUBLE ELSE 1 END, before * 0.40::DOUBLE))), 2) AS headline_rank FROM r)
SELECT cluster_id, headline_rank, source_count >= 8 AND headline_rank >= 40 AS is_headline FROM g"""


@query("SELECT cluster_id, round_even(5 + 0.95::DOUBLE * least(greatest(floor(rank), 0), 100), 2) AS rank FROM clusters", "clusters")
def rank_rescale(spark, d):
    """Whole ranks on the shown scale."""
    return S.clusters(spark, d).select("cluster_id", ranking.rescale(F.floor("rank")).alias("rank"))


@query("""SELECT cluster_id, new_id, common FROM (SELECT o.cluster_id, n.new_id, count(*) AS common, any_value(size) AS size FROM (SELECT *, count(*) OVER (PARTITION BY cluster_id) AS size FROM (SELECT DISTINCT source_id AS cluster_id, topic_id AS article_id FROM members WHERE line <= 2))  o
  JOIN (SELECT DISTINCT cluster_id AS new_id, topic_id AS article_id FROM members) n USING (article_id) GROUP BY ALL) WHERE common / size > 0.02""", "members")
def stale_clusters(spark, d):
    """Old groups of topics that a new cluster covers to more than a fiftieth."""
    m = S.members(spark, d)
    old = m.where("line <= 2").select(F.col("source_id").alias("cluster_id"), F.col("topic_id").alias("article_id")).distinct()
    new = m.select("cluster_id", F.col("topic_id").alias("article_id")).distinct()
    return joins.stale_clusters(old, new, 0.02).select("cluster_id", "new_id", "common")


@query("""SELECT story_id, prior_id FROM (SELECT a.cluster_id AS story_id, b.cluster_id AS prior_id, row_number() OVER (PARTITION BY a.cluster_id ORDER BY b.rank DESC, b.created_at DESC, b.cluster_id) AS r
  FROM clusters a JOIN clusters b ON a.owner_id = b.owner_id AND b.created_at < a.created_at AND date_diff('day', b.created_at, a.created_at) <= 90) WHERE r = 1""", "clusters")
def thread_continuations(spark, d):
    """The best earlier story of the same thread within 90 days."""
    stories_ = S.clusters(spark, d).select(F.col("cluster_id").alias("story_id"), F.col("owner_id").alias("thread"), F.to_date("created_at").alias("day"), F.col("rank").alias("weight"))
    return joins.thread_continuations(stories_, 90).select("story_id", "prior_id")


@query("SELECT year, n, kept FROM (SELECT year(created_at) AS year, count(*) AS n, count(*) FILTER (WHERE created_at >= TIMESTAMP '2001-11-05' - INTERVAL 1500 DAYS) AS kept FROM clusters GROUP BY 1)", "clusters")
def retention(spark, d):
    """Clusters that stay under a retention of 1500 days, by year."""
    c = S.clusters(spark, d)
    kept = joins.retained(c, "created_at", AS_OF, 1500).groupBy(F.year("created_at").alias("year")).agg(F.count("*").alias("kept"))
    return c.groupBy(F.year("created_at").cast("long").alias("year")).agg(F.count("*").alias("n")).join(kept, "year", "left").select("year", "n", F.coalesce("kept", F.lit(0)).cast("long").alias("kept"))


@query("""SELECT category, status, greatest(n, coalesce(o, n)) AS n FROM (SELECT category, status, count(*) AS n FROM clusters WHERE created_at >= TIMESTAMP '1998-01-01' GROUP BY ALL)
  LEFT JOIN (SELECT category, max(n) AS o FROM (SELECT category, status, count(*) AS n FROM clusters WHERE created_at < TIMESTAMP '1998-01-01' GROUP BY ALL) GROUP BY category) USING (category)""", "clusters")
def tier_carry_forward(spark, d):
    """Counts of the new period raised to the old period's greatest of the same key."""
    c = S.clusters(spark, d)
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    by = lambda rows: rows.groupBy("category", "status").agg(F.count("*").alias("n"))
    return joins.carry_forward(by(c.where(F.col("created_at") < cut)), by(c.where(F.col("created_at") >= cut)), "category", "n").select("category", "status", "n")


@query("""SELECT user_id, count(*) AS batches, 0.0 AS average FROM events GROUP BY 1 LIMIT 0""")
def ema_topic_state(spark, d):
    """The moving average of each event type over its days."""
    e = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("v"))
    return state.moving_average(e, ["event_type"], "day", "v")


ORACLE_SQL["ema_topic_state"] = """
WITH RECURSIVE b AS (SELECT event_type, round(avg(value), 6) AS v, row_number() OVER (PARTITION BY event_type ORDER BY CAST(ts AS DATE)) AS k FROM events GROUP BY event_type, CAST(ts AS DATE)),
f AS (SELECT event_type, k, v AS a FROM b WHERE k = 1 UNION ALL SELECT b.event_type, b.k, f.a * 0.7::DOUBLE + b.v * 0.3::DOUBLE FROM f JOIN b ON b.event_type = f.event_type AND b.k = f.k + 1)
SELECT event_type, k AS batches, round_even(a, 2) AS average FROM f QUALIFY k = max(k) OVER (PARTITION BY event_type)"""


@query("""SELECT user_id, count(*) FILTER (WHERE event_type = 'error' AND (last_ok IS NULL OR event_id > last_ok)) AS failures, count(*) FILTER (WHERE event_type = 'error' AND (last_ok IS NULL OR event_id > last_ok)) >= 5 AS quarantined
  FROM (SELECT *, max(CASE WHEN event_type <> 'error' THEN event_id END) OVER (PARTITION BY user_id) AS last_ok FROM events) GROUP BY user_id""")
def source_health(spark, d):
    """Failures of each feed since its last success."""
    e = table(spark, d, "events").withColumn("failed", F.col("event_type") == "error")
    return state.failure_streaks(e, "user_id", "event_id", "failed")


@query("""SELECT user_id, count(*) AS claims, count(*) FILTER (WHERE event_type = 'purchase') AS corroborated, count(*) FILTER (WHERE event_type = 'error') AS disputed, round(count(*) FILTER (WHERE event_type = 'purchase') / count(*), 3) AS rate FROM events GROUP BY user_id""")
def track_record(spark, d):
    """Outcomes of each source's claims."""
    outcome = F.when(F.col("event_type") == "purchase", "corroborated").when(F.col("event_type") == "error", "disputed").otherwise("open")
    return state.track_record(table(spark, d, "events").withColumn("outcome", outcome), "user_id", "outcome")


_WORDS = "unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '')))"


@query(f"""SELECT term, df, round(greatest(0.05::DOUBLE, ln(greatest(total, 30)::DOUBLE / (df + greatest(1, (total + 3) // 4)))), 6) AS idf
  FROM (SELECT term, count(*) AS df FROM (SELECT doc_id, {_WORDS} AS term FROM documents) GROUP BY term), (SELECT count(*) AS total FROM documents)""")
def smoothed_idf(spark, d):
    """Document frequency and smoothed idf of every word."""
    docs = table(spark, d, "documents")
    terms = docs.select("doc_id", F.explode(F.array_distinct(T.words(F.col("text")))).alias("term"))
    return enrichment.global_idf(terms, docs.count(), "doc_id", "term")


_LEAD = "substring(trim(regexp_replace(lower(body), '[^a-z0-9]+', ' ', 'g')), 1, 800)"


@query(f"""SELECT article_id, wire_group, origin_id, article_id <> origin_id AS is_copy FROM (SELECT article_id, wire_group, min(article_id) OVER (PARTITION BY wire_group) AS origin_id, count(*) OVER (PARTITION BY wire_group) AS n
  FROM (SELECT article_id, sha1({_LEAD}) AS wire_group FROM articles WHERE length({_LEAD}) >= 80)) WHERE n > 1""", "articles")
def wire_fingerprint_groups(spark, d):
    """Articles whose normalised leads are equal."""
    return stories.wire_groups(S.articles(spark, d))


_STEMS = """stems AS (SELECT DISTINCT article_id, CASE WHEN length(w) < 6 THEN w ELSE regexp_replace(w, '(ation|tion|ing|ness|ies|ed|es|ly|s)$', '') END AS stem
  FROM (SELECT article_id, unnest(list_filter(string_split_regex(lower(title), '[^a-z0-9]+'), lambda w: length(w) >= 4)) AS w FROM articles))"""
_TITLE_PAIRS = f""", {_STEMS}, rare AS (SELECT stem FROM stems GROUP BY stem HAVING count(*) <= 5),
keys AS (SELECT * FROM stems WHERE stem IN (SELECT stem FROM rare)),
cand AS (SELECT DISTINCT a.article_id, b.article_id AS other_id FROM keys a JOIN keys b ON a.stem = b.stem AND a.article_id < b.article_id),
bags AS (SELECT article_id, count(*) AS n FROM stems GROUP BY article_id),
pairs AS (SELECT c.article_id, c.other_id, count(y.stem) AS common FROM cand c JOIN stems x ON x.article_id = c.article_id LEFT JOIN stems y ON y.article_id = c.other_id AND y.stem = x.stem GROUP BY ALL)
SELECT p.article_id, p.other_id, round(common / (a.n + b.n - common), 6) AS jaccard FROM pairs p JOIN bags a ON a.article_id = p.article_id JOIN bags b ON b.article_id = p.other_id WHERE round(common / (a.n + b.n - common), 6) >= 0.22"""


@query("SELECT 1", "articles")
def title_stem_pairs(spark, d):
    """Pairs of articles with alike titles."""
    return stories.similar_titles(S.articles(spark, d))


ORACLE_SQL["title_stem_pairs"] = with_tables("", "articles") + _TITLE_PAIRS


@query()
def story_components(spark, d):
    """Stories: what pairs of alike titles connect."""
    a = S.articles(spark, d)
    return stories.components_of(stories.similar_titles(a), a)


ORACLE_SQL["story_components"] = with_tables("", "articles").replace("WITH ", "WITH RECURSIVE ", 1) + _TITLE_PAIRS.replace("SELECT p.article_id", """, alike AS MATERIALIZED (SELECT p.article_id""") + """),
edges AS MATERIALIZED (SELECT article_id AS src, other_id AS dst FROM alike UNION ALL SELECT other_id, article_id FROM alike),
reach(node, origin) AS (SELECT article_id, article_id FROM articles UNION SELECT dst, origin FROM reach JOIN edges ON src = node)
SELECT node AS article_id, min(origin) AS story_id FROM reach GROUP BY node"""


@query("""WITH r AS (SELECT user_id * 100 + day(ts) AS cluster_id, event_id AS claim_id, event_type, TRY_CAST(regexp_extract(props, '([0-9]{1,9})', 1) AS DOUBLE) AS number FROM events)
SELECT a.cluster_id, a.claim_id, b.claim_id AS other_id, a.number, b.number AS other_number FROM r a JOIN r b ON a.cluster_id = b.cluster_id AND a.claim_id < b.claim_id AND a.event_type <> b.event_type
WHERE a.number > 0 AND b.number > 0 AND (greatest(a.number, b.number) - least(a.number, b.number)) / greatest(a.number, b.number) > 0.2 AND greatest(a.number, b.number) / least(a.number, b.number) <= 100""")
def numeric_conflicts(spark, d):
    """Claims of a user's day whose numbers disagree."""
    c = table(spark, d, "events").select((F.col("user_id") * 100 + F.dayofmonth("ts")).alias("cluster_id"), F.col("event_id").alias("claim_id"), F.col("event_type").alias("source_id"), F.col("props").alias("text"))
    return stories.numeric_conflicts(c)


def _sql_count(phrase: str) -> str:
    return f"(length(lower(text)) - length(replace(lower(text), '{phrase}', ''))) // {len(phrase)}"


_COUNT = r"len(list_filter(string_split_regex(text, '[ \t\n\r]+'), lambda w: w <> ''))"


def _sql_density(phrases: list[str]) -> str:
    return f"round(CASE WHEN {_COUNT} > 0 THEN ({' + '.join(map(_sql_count, phrases))}) * 1000 / {_COUNT} ELSE 0 END, 6)"


@query(f"""SELECT doc_id, {_sql_density(T.HEDGES)} AS hedging, {_sql_density(T.ATTRIBUTIONS)} AS attribution, {_sql_density(T.MODALS)} AS modality,
  round(CASE WHEN {_COUNT} > 0 THEN len(list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda w: regexp_full_match(w, '[A-Z][A-Z]+[!?.,]*'))) / {_COUNT} ELSE 0 END, 6) AS caps FROM documents""")
def text_densities(spark, d):
    """Hedging, attribution, modality and capitals of every document."""
    rows = table(spark, d, "documents").select("doc_id", "text", F.lower("text").alias("low"), T.word_count(F.col("text")).alias("n"))
    n = F.col("n")
    parts = (F.round(T.density(F.col("low"), n, p), 6).alias(name) for name, p in (("hedging", T.HEDGES), ("attribution", T.ATTRIBUTIONS), ("modality", T.MODALS)))
    return rows.select("doc_id", *parts, F.round(F.when(n > 0, T.caps_count(F.col("text")) / n).otherwise(0.0), 6).alias("caps"))


_HITS = " + ".join(f"contains(lower(text), '{p}')::INT" for p in T.PAYWALL)


@query(f"""SELECT article_id, {_COUNT} <= 500 AND ({_HITS} >= 2 OR ({_HITS} >= 1 AND {_COUNT} < 100)) AS paywalled,
  length(trim(title)) < 6 OR regexp_full_match(trim(title), '[a-z0-9-]+\\.(com|org|net)') OR (length(trim(title)) < 15 AND {_COUNT} < 80) AS garbage FROM (SELECT *, body AS text FROM articles)""", "articles")
def article_gates(spark, d):
    """Paywall and garbage gates of every article."""
    return S.articles(spark, d).select("article_id", T.looks_paywalled(F.col("body")).alias("paywalled"), T.is_garbage(F.col("title"), F.col("body")).alias("garbage"))


_BARE = r"regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
for _name, _char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _BARE = f"replace({_BARE}, '{_name}', '{_char}')"


@query(rf"""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, trim(regexp_replace({_BARE}, '[ \t\r\n]+', ' ', 'g')) AS text FROM pages""")
def page_text(spark, d):
    """Title and visible text of every page."""
    return table(spark, d, "pages").select("page_id", T.page_title(F.col("html")).alias("title"), T.html_text(F.col("html")).alias("text"))


@query(""", s AS (SELECT stddev_pop(lean) AS sigma, quantile_cont(lean, 0.75) - quantile_cont(lean, 0.25) AS iqr, count(lean) AS total FROM members),
h AS (SELECT total, greatest(4::DOUBLE, 0.9::DOUBLE * least(sigma, iqr / 1.34::DOUBLE) * pow(total, -0.2::DOUBLE)) AS h FROM s)
SELECT k, round(0::DOUBLE + k * (100::DOUBLE / 99), 6) AS x, round(sum(n * exp(-0.5::DOUBLE * pow((k * (100::DOUBLE / 99) - lean) / h, 2)) / (h * total * 2.5066282746310002::DOUBLE)), 8) AS density
FROM (SELECT lean, count(*) AS n FROM members GROUP BY lean), h, (SELECT unnest(range(100)) AS k) GROUP BY k""", "members")
def kde_curve(spark, d):
    """The density of leans at 100 points."""
    return enrichment.kernel_density(S.members(spark, d), "lean", 0.0, 100.0).withColumn("k", F.col("k").cast("long"))


@query("""SELECT axis AS column_name, count(*) AS total, count(*) FILTER (WHERE v IS NULL) AS nulls, round(count(*) FILTER (WHERE v IS NULL) / count(*), 6) AS null_share FROM (
  SELECT 'text' AS axis, text AS v FROM documents UNION ALL SELECT 'lang', lang FROM documents UNION ALL SELECT 'source', source FROM documents) GROUP BY axis""")
def audit_coverage(spark, d):
    """Nulls of the documents' columns."""
    return audit.coverage(table(spark, d, "documents"), ["text", "lang", "source"])


@query("""SELECT axis, count(v) AS n, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS deviation, min(v)::BIGINT AS least, max(v)::BIGINT AS most, round(count(*) FILTER (WHERE v IN (0, 100)) / count(v), 6) AS at_bounds
  FROM (UNPIVOT (SELECT lean, sensationalism, rigor, framing FROM members) ON lean, sensationalism, rigor, framing INTO NAME axis VALUE v) GROUP BY axis""", "members")
def audit_axes(spark, d):
    """Distribution of the score axes."""
    return audit.axis_statistics(S.members(spark, d), ["lean", "sensationalism", "rigor", "framing"])


@query("SELECT CAST(CASE WHEN rank >= 100 THEN 11 ELSE floor(rank / 10) + 1 END AS INTEGER) AS bin, count(*) AS n FROM clusters GROUP BY 1", "clusters")
def rank_histogram(spark, d):
    """Clusters in ten equal bins of the rank."""
    return audit.histogram(S.clusters(spark, d), "rank", 0, 100, 10)


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM members" for a, b in (("lean", "rigor"), ("lean", "framing"), ("rigor", "framing"))), "members")
def axis_correlations(spark, d):
    """Correlation of score axes."""
    return audit.correlations(S.members(spark, d), ["lean", "rigor", "framing"])


_RULES_SQL = """found AS (SELECT cluster_id, 'LOW_RIGOR' AS code, 'rigor' AS dimension, 4 AS penalty FROM members WHERE rigor < 4
  UNION ALL SELECT cluster_id, 'LOUD', 'tone', 16 FROM members WHERE sensationalism >= 80 AND framing > 97 UNION ALL SELECT cluster_id, 'EXTREME', 'balance', 45 FROM members WHERE lean = 100 AND opinion = 100 AND framing = 0)"""


def _found(spark, d):
    c = F.col
    rules = [("LOW_RIGOR", "rigor", 4, c("rigor") < 4), ("LOUD", "tone", 16, (c("sensationalism") >= 80) & (c("framing") > 97)), ("EXTREME", "balance", 45, (c("lean") == 100) & (c("opinion") == 100) & (c("framing") == 0))]
    return audit.findings(S.members(spark, d), "cluster_id", rules)


@query("SELECT 1", "members")
def feed_findings(spark, d):
    """Rule findings by code and dimension."""
    return _found(spark, d).groupBy("code", "dimension").agg(F.count("*").alias("n"), F.sum("penalty").alias("lost"))


ORACLE_SQL["feed_findings"] = with_tables("", "members") + f", {_RULES_SQL} SELECT code, dimension, count(*) AS n, sum(penalty)::BIGINT AS lost FROM found GROUP BY ALL"


@query("SELECT 1", "members")
def feed_score(spark, d):
    """Scores of the feed's dimensions and overall."""
    return audit.score_findings(_found(spark, d), ["rigor", "tone", "balance"])


ORACLE_SQL["feed_score"] = with_tables("", "members") + f""", {_RULES_SQL}, s AS (SELECT dimension, greatest(0, 100 - coalesce(lost, 0))::DOUBLE AS score FROM (SELECT unnest(['rigor', 'tone', 'balance']) AS dimension)
LEFT JOIN (SELECT dimension, sum(penalty) AS lost FROM found GROUP BY dimension) USING (dimension))
SELECT * FROM s UNION ALL SELECT 'overall', round(CASE WHEN (SELECT max(penalty) FROM found) >= 45 THEN least((SELECT avg(score) FROM s), 40) ELSE (SELECT avg(score) FROM s) END, 4)"""


@query("""SELECT cluster_id, 'rank_range' AS check_name FROM clusters WHERE NOT (rank BETWEEN 1 AND 99) UNION ALL SELECT cluster_id, 'status_known' FROM clusters WHERE NOT (status IN ('O', 'F'))""", "clusters")
def check_violations(spark, d):
    """Rows that break a CHECK condition."""
    return audit.violations(S.clusters(spark, d), "cluster_id", {"rank_range": F.col("rank").between(1, 99), "status_known": F.col("status").isin("O", "F")})


@query("""SELECT node, count(*) AS degree, count(*) FILTER (WHERE forward) AS ahead FROM (SELECT c_nationkey AS node, o_orderkey AS other, true AS forward FROM customer JOIN orders ON c_custkey = o_custkey
  UNION ALL SELECT o_orderkey, c_nationkey, false FROM customer JOIN orders ON c_custkey = o_custkey) GROUP BY node""")
def bidirectional_edges(spark, d):
    """Edges read from both ends, as degrees."""
    edges = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_nationkey").cast("long").alias("src"), F.col("o_orderkey").alias("dst"), F.lit("placed").alias("kind"))
    return joins.both_directions(edges).groupBy("node").agg(F.count("*").alias("degree"), F.count_if("forward").alias("ahead"))


_TERMS = [("harvest", 0, "small", "strong"), ("harvest", 0, "red", "context"), ("strike", 1, "widget", "strong"), ("strike", 1, "small", "context"), ("march", 2, "gear", "strong"), ("march", 2, "red", "exclude")]


@query(f"""WITH terms(movement, position, word, kind) AS (VALUES {', '.join(str(t) for t in _TERMS)}), items AS (SELECT p_partkey AS item_id, unnest(list_distinct(string_split(p_name, ' '))) AS word FROM part)
SELECT item_id, movement, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, position) AS r FROM (
  SELECT item_id, movement, position, max((kind = 'strong')::INT * 2 + (kind = 'context')::INT) AS score, max((kind = 'exclude')::INT) AS out FROM items JOIN terms USING (word) GROUP BY ALL) WHERE score > 0 AND out = 0) WHERE r = 1""")
def argmax_assignment(spark, d):
    """Each item's best movement by its words."""
    items = table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.explode(F.array_distinct(F.split("p_name", " "))).alias("word"))
    return joins.assign_best(items, spark.createDataFrame(_TERMS, "movement string, position int, word string, kind string"))


@query("""SELECT owner_id, count(*) AS stories, bool_or(category = '1-URGENT' AND rank > 50) AS urgent_reached FROM clusters GROUP BY owner_id""", "clusters")
def any_in_array(spark, d):
    """Threads with any urgent story above the middle, over an array of structs."""
    by = S.clusters(spark, d).groupBy("owner_id").agg(F.collect_list(F.struct("category", "rank")).alias("phases"))
    return by.select("owner_id", F.size("phases").cast("long").alias("stories"), F.exists("phases", lambda p: (p["category"] == "1-URGENT") & (p["rank"] > 50)).alias("urgent_reached"))


@query("""SELECT time_bucket(INTERVAL 1 DAY, ts) AS "start", time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS "end", event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL""")
def tumbling_windows(spark, d):
    """Events by type and day."""
    return stream.window_counts(table(spark, d, "events"), "ts", "1 day", None, "event_type")


@query("""SELECT s AS "start", s + INTERVAL 24 HOURS AS "end", event_type, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT *, unnest([time_bucket(INTERVAL 12 HOURS, ts), time_bucket(INTERVAL 12 HOURS, ts) - INTERVAL 12 HOURS]) AS s FROM events) GROUP BY ALL""")
def sliding_windows(spark, d):
    """Events by type in windows of 24 hours every 12."""
    return stream.window_counts(table(spark, d, "events"), "ts", "24 hours", "12 hours", "event_type")


@query("""SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL 6 HOURS AS "end", count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
  SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""")
def session_windows(spark, d):
    """Sessions of each user with gaps of up to six hours."""
    return stream.sessions(table(spark, d, "events"), "ts", "6 hours", "user_id")


_LEXICON = [("the", "left", 1.0), ("de", "left", 2.0), ("thing", "left", 1.5), ("and", "right", 1.0), ("der", "right", 2.0), ("tion", "right", 1.5), ("ering", "right", 3.0)]


@query(f"""WITH lexicon(word, side, weight) AS (VALUES {', '.join(f"('{w}', '{s}', {x}::DOUBLE)" for w, s, x in _LEXICON)}),
found AS (SELECT doc_id, word, side, weight, count(*) AS n FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS word FROM documents) JOIN lexicon USING (word) GROUP BY ALL),
f AS (SELECT doc_id, sum(CASE WHEN side = 'right' THEN n * weight ELSE 0 END) AS r, sum(n * weight) AS t, count(*) AS k FROM found GROUP BY doc_id)
SELECT doc_id AS article_id, round(coalesce(50 + (r / t - 0.5::DOUBLE) * (1 / (1 + exp(-0.7::DOUBLE * (k - 4)))) * 100, 50), 4) AS lean_text, coalesce(k, 0) AS "distinct" FROM documents LEFT JOIN f USING (doc_id)""")
def lexicon_lean(spark, d):
    """Lean of every document's words."""
    from newsloom.operators.scores import lexicon_lean as lean

    return lean(S.articles(spark, d), spark.createDataFrame(_LEXICON, "word string, side string, weight double"))


_VERBS, _BODIES1, _BODIES2 = ["the", "ering", "tion"], ["and", "der"], ["of", "de"]


def _hits_sql(terms, where="title"):
    return " + ".join(f"(len(list_filter(string_split_regex(lower({where}), '[^a-z0-9]+'), lambda w: w = '{t}')) > 0)::INT" for t in terms)


def _count_sql(terms):
    return " + ".join(f"len(list_filter(string_split_regex(lower(title), '[^a-z0-9]+'), lambda w: w = '{t}'))" for t in terms)


@query(f"""SELECT source AS cluster_id, round((CASE WHEN sum((contains(lower(title), 'thion'))::INT) > 0 THEN 0.7::DOUBLE ELSE 1 END) * (CASE WHEN sum(contains(lower(title), 'ouing')::INT) > 0 THEN greatest(raw, 70) ELSE raw END), 4) AS consequentiality, 0 AS authority FROM (SELECT 1) LIMIT 0""")
def event_signals(spark, d):
    """Consequentiality and authority of the stories of each outlet."""
    from newsloom.operators.scores import event_signals as signals

    rows = S.articles(spark, d).select(F.col("source").alias("cluster_id"), "article_id", "title")
    return signals(rows, _VERBS, ["ouing"], ["thion"], _BODIES1, _BODIES2)


ORACLE_SQL["event_signals"] = with_tables("", "articles") + f""", t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY article_id) AS r FROM articles) WHERE r <= 10),
g AS (SELECT source AS cluster_id, {' + '.join(f"max((len(list_filter(string_split_regex(lower(title), '[^a-z0-9]+'), lambda w: w = '{v}')) > 0)::INT)" for v in _VERBS)} AS verbs, sum({_count_sql(_VERBS)}) AS n,
  max(contains(lower(title), 'ouing')::INT) AS weighty, max(contains(lower(title), 'thion')::INT) AS hedged, sum({_hits_sql(_BODIES1)}) AS t1, sum({_hits_sql(_BODIES2)}) AS t2 FROM t GROUP BY source),
s AS (SELECT *, 0.6::DOUBLE * least(100::DOUBLE, verbs * 20::DOUBLE) + 0.4::DOUBLE * least(100::DOUBLE, n * 5::DOUBLE) AS raw, CASE WHEN t1 > 0 THEN least(100::DOUBLE, 80 + (t1 - 1) * 10::DOUBLE) ELSE 0 END AS one, CASE WHEN t2 > 0 THEN least(70::DOUBLE, 40 + (t2 - 1) * 10::DOUBLE) ELSE 0 END AS two FROM g),
w AS (SELECT *, CASE WHEN weighty > 0 THEN greatest(raw, 70::DOUBLE) ELSE raw END AS kept FROM s)
SELECT cluster_id, round(CASE WHEN hedged > 0 THEN kept * 0.7::DOUBLE ELSE kept END, 4) AS consequentiality, round(CASE WHEN one > 0 AND two > 0 THEN least(100::DOUBLE, one + two * 0.2::DOUBLE) ELSE greatest(one, two) END, 4) AS authority FROM w"""


@query(r"""SELECT doc_id AS article_id, count(*) AS n, sum(length(s))::BIGINT AS chars FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])[ \n\t]+', '\1' || chr(10), 'g'), chr(10))) AS s FROM documents)
WHERE len(list_filter(string_split_regex(s, '[ \t\n\r]+'), lambda w: w <> '')) BETWEEN 8 AND 60 AND (regexp_matches(s, '[0-9]') OR contains(lower(s), 'said') OR contains(lower(s), 'according to')) GROUP BY doc_id""")
def claim_sentences(spark, d):
    """Sentences of every document that make a checkable claim."""
    from newsloom.operators.scores import claims

    return claims(S.articles(spark, d)).groupBy("article_id").agg(F.count("*").alias("n"), F.sum(F.length("sentence")).alias("chars"))


@query("""SELECT cluster_id, CASE WHEN source_count < 3 AND rank > lim THEN round_even(lim, 2) ELSE rank END AS rank FROM v, (SELECT greatest(0, min(rank) - 0.1::DOUBLE) AS lim FROM (SELECT rank FROM v WHERE source_count >= 3 ORDER BY rank DESC, cluster_id LIMIT 10))""")
def lead_gate(spark, d):
    """Ranks with thin stories held under the tenth well-sourced one."""
    from newsloom.operators.feed import lead_gate as gate

    voices = S.members(spark, d).groupBy("cluster_id").agg(F.countDistinct("source_id").alias("source_count"))
    return gate(S.clusters(spark, d).join(voices, "cluster_id")).select("cluster_id", "rank")


ORACLE_SQL["lead_gate"] = with_tables("", "clusters", "members") + f", v AS (SELECT cluster_id, rank, source_count FROM clusters JOIN ({_VOICES}) USING (cluster_id)) " + ORACLE_SQL["lead_gate"]


@query("""WITH t AS (SELECT o_orderkey AS cluster_id, o_orderpriority AS category, floor(o_totalprice * 7)::BIGINT % 10001 / 100 AS rank FROM orders ORDER BY rank DESC, cluster_id LIMIT 300),
f AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY rank DESC, cluster_id) <= 2 AS fits FROM t), g AS (SELECT *, row_number() OVER (PARTITION BY fits ORDER BY rank DESC, cluster_id) AS turn FROM f)
SELECT cluster_id, row_number() OVER (ORDER BY (fits AND turn <= 10) DESC, rank DESC, cluster_id) AS position FROM g""")
def diverse_top(spark, d):
    """The feed's order with at most two stories of a category on top."""
    from newsloom.operators.feed import diverse_top as top

    return top(S.clusters(spark, d)).select("cluster_id", F.col("position").cast("long").alias("position"))


@query()
def feed_ranks(spark, d):
    """The feed's order as strictly decreasing ranks."""
    from newsloom.operators.feed import decreasing, diverse_top as top

    c = S.clusters(spark, d)
    return decreasing(top(c).join(c.select("cluster_id", "rank"), "cluster_id"))


ORACLE_SQL["feed_ranks"] = with_tables("", "clusters").replace("WITH ", "WITH RECURSIVE ", 1) + """,
best AS (SELECT * FROM clusters ORDER BY rank DESC, cluster_id LIMIT 300),
fitting AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY rank DESC, cluster_id) <= 2 AS fits FROM best),
turns AS (SELECT *, row_number() OVER (PARTITION BY fits ORDER BY rank DESC, cluster_id) AS turn FROM fitting),
placed AS MATERIALIZED (SELECT cluster_id, rank::DOUBLE AS rank, row_number() OVER (ORDER BY fits AND turn <= 10 DESC, rank DESC, cluster_id) AS position FROM turns),
walk(cluster_id, position, rank) AS (SELECT cluster_id, position, rank FROM placed WHERE position = 1
  UNION ALL SELECT p.cluster_id, p.position, CASE WHEN p.rank >= w.rank THEN round_even(w.rank - 0.1e0, 2) ELSE p.rank END FROM walk w JOIN placed p ON p.position = w.position + 1)
SELECT cluster_id, position::INT AS position, rank FROM walk"""


@query("""WITH p AS (SELECT p_partkey AS story_id, p_brand AS thread, CAST(DATE '2001-11-05' - CAST(p_partkey % 200 AS INTEGER) AS DATE) AS day, p_name AS title, p_size AS source_count FROM part),
n AS (SELECT thread, count(*) AS thread_printings FROM p GROUP BY thread), w AS (SELECT *, string_split(title, ' ') AS t FROM p WHERE list_contains(string_split(title, ' '), 'small')),
s AS (SELECT story_id, thread, thread_printings, day, round(len(list_filter(t, lambda x: x = 'small')) / len(t) * (1 + least(source_count, 60) / 120::DOUBLE) * (0.5::DOUBLE + 0.5::DOUBLE * exp(-date_diff('day', day, DATE '2001-11-05') / 90::DOUBLE)), 8) AS rank FROM w JOIN n USING (thread))
SELECT story_id, thread, thread_printings, rank FROM (SELECT *, row_number() OVER (PARTITION BY thread ORDER BY rank DESC, day DESC, story_id) AS r FROM s) WHERE r = 1 ORDER BY rank DESC, day DESC, story_id LIMIT 20""")
def archive_search(spark, d):
    """The best printings for a word, one for each thread."""
    from newsloom.operators.feed import search

    part = table(spark, d, "part")
    printed = part.select(F.col("p_partkey").alias("story_id"), F.col("p_brand").alias("thread"), F.date_sub(F.lit("2001-11-05").cast("date"), (F.col("p_partkey") % 200).cast("int")).alias("day"), F.col("p_name").alias("title"), F.col("p_size").alias("source_count"))
    return search(printed, "small", "2001-11-05").select("story_id", "thread", "thread_printings", "rank")


@query("""WITH b AS (SELECT CAST(date_trunc('week', created_at) AS DATE) AS week, owner_id AS thread, count(DISTINCT CAST(created_at AS DATE)) AS days, sum(cluster_id % 9) AS sources, max(rank) AS peak, count(DISTINCT status) AS editions, sum(cluster_id % 4) AS divergence FROM clusters GROUP BY ALL),
m AS (SELECT week, max(days) AS md, max(sources) AS ms, max(peak) AS mp, max(editions) AS me, max(divergence) AS mv FROM b GROUP BY week)
SELECT week, thread, round(days / md * 0.25::DOUBLE + CASE WHEN ms > 0 THEN sources / ms ELSE sources END * 0.20::DOUBLE + CASE WHEN mp > 0 THEN peak / mp ELSE peak END * 0.15::DOUBLE + editions / me * 0.10::DOUBLE + CASE WHEN mv > 0 THEN divergence / mv ELSE divergence END * 0.10::DOUBLE, 6) AS weekly_score FROM b JOIN m USING (week)""")
def weekly_threads(spark, d):
    """Scores of the threads of each week."""
    from newsloom.operators.feed import weekly_threads as weekly

    c = S.clusters(spark, d).select(F.to_date(F.date_trunc("week", "created_at")).alias("week"), F.col("owner_id").alias("thread"), F.to_date("created_at").alias("day"), (F.col("cluster_id") % 9).alias("source_count"), "rank", (F.col("cluster_id") % 4).alias("divergence"), F.col("status").alias("edition"))
    return weekly(c)


ORACLE_SQL["weekly_threads"] = with_tables(", " + ORACLE_SQL["weekly_threads"].removeprefix("WITH "), "clusters")


@query("""SELECT user_id, favors, against, total, CASE WHEN favors - against >= 2 THEN 'Favorable' WHEN favors - against <= -2 THEN 'Low' ELSE 'Contested' END AS band FROM (
  SELECT user_id, count(*) FILTER (WHERE event_type IN ('signup', 'purchase')) AS favors, count(*) FILTER (WHERE event_type = 'error') AS against, count(*) AS total FROM events GROUP BY user_id)""")
def success_bands(spark, d):
    """Bands of each movement's factors."""
    from newsloom.operators.feed import success_band

    direction = F.when(F.col("event_type").isin("signup", "purchase"), "favors-movement").when(F.col("event_type") == "error", "favors-regime").otherwise("indeterminate")
    return success_band(table(spark, d, "events").withColumn("direction", direction), "user_id")


from newsloom.operators import serving  # noqa: E402


@query("""SELECT cluster_id, count(*) AS articles, count(DISTINCT CASE WHEN line > 4 THEN topic_id % 10 ELSE source_id END) AS voices, round(count(*) / count(DISTINCT CASE WHEN line > 4 THEN topic_id % 10 ELSE source_id END), 4) AS amplification FROM members GROUP BY cluster_id""", "members")
def voice_counts(spark, d):
    """Voices of every cluster, copies counted as their origin."""
    return serving.voice_counts(S.members(spark, d).withColumn("origin_id", F.when(F.col("line") > 4, F.col("topic_id") % 10)))


@query("""WITH m AS (SELECT source AS cluster_id, article_id, title FROM articles), t AS (SELECT DISTINCT cluster_id, article_id, word FROM (SELECT cluster_id, article_id, unnest(list_filter(string_split_regex(lower(title), '[^a-z0-9]+'), lambda w: length(w) >= 5)) AS word FROM m)),
w AS (SELECT cluster_id, word FROM (SELECT cluster_id, word, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, word) AS r FROM t GROUP BY cluster_id, word) WHERE r <= 4),
h AS (SELECT cluster_id, count(DISTINCT article_id) AS hit FROM t JOIN w USING (cluster_id, word) GROUP BY cluster_id)
SELECT cluster_id, round(coalesce(hit, 0) / size, 6) AS coherence FROM (SELECT cluster_id, count(*) AS size FROM m GROUP BY cluster_id) LEFT JOIN h USING (cluster_id)""", "articles")
def topic_coherence(spark, d):
    """How many of each outlet's titles share its leading words."""
    return serving.topic_coherence(S.articles(spark, d).withColumn("cluster_id", F.col("source")))


ORACLE_SQL["topic_coherence"] = ORACLE_SQL["topic_coherence"].replace(" WITH m AS", ", m AS", 1)


@query("""SELECT cluster_id, round(40 * (1 - confidence) + 35 * least(1::DOUBLE, n / 10) + 25 * least(1::DOUBLE, range / 60), 6) AS priority FROM (SELECT cluster_id, sum(topic_id % 10)::DOUBLE / (10 * count(*)) AS confidence, count(*) AS n, max(lean) - min(lean) AS range FROM members GROUP BY cluster_id)
  ORDER BY priority DESC, cluster_id LIMIT 25""", "members")
def second_opinions(spark, d):
    """The 25 clusters most in need of a second opinion."""
    by = S.members(spark, d).groupBy("cluster_id").agg((F.sum(F.col("topic_id") % 10) / (10 * F.count("*"))).alias("confidence"), F.count("*").alias("n"), (F.max("lean") - F.min("lean")).alias("range"))
    return serving.priorities(by).select("cluster_id", "priority")


@query("""SELECT tier, count(lean) AS n, round(avg(lean), 4) AS mean, round(stddev_samp(lean), 4) AS deviation, min(lean) AS low, max(lean) AS high, round(quantile_cont(lean, 0.25), 4) AS q1, round(quantile_cont(lean, 0.5), 4) AS q2, round(quantile_cont(lean, 0.75), 4) AS q3
  FROM members JOIN sources USING (source_id) GROUP BY tier""", "members", "sources")
def lean_by_tier(spark, d):
    """Distribution of lean by tier."""
    return serving.distribution_by(S.members(spark, d).join(F.broadcast(S.sources(spark, d)), "source_id"), "tier", "lean")


@query("SELECT source, count(*) AS attempts, count(*) FILTER (WHERE n_chars >= 1000) AS captured, round(count(*) FILTER (WHERE n_chars >= 1000) / count(*), 6) AS rate FROM documents GROUP BY source")
def capture_rates(spark, d):
    """Documents of each source that came in full."""
    return serving.capture_rates(table(spark, d, "documents"), "source", F.col("n_chars") >= 1000)


@query("SELECT cluster_id, category, coalesce(votes, 0) AS votes FROM clusters LEFT JOIN (SELECT cluster_id, count(*) AS votes FROM members GROUP BY cluster_id) USING (cluster_id)", "clusters", "members")
def vote_recount(spark, d):
    """Members counted anew for every cluster."""
    return serving.recounted(S.clusters(spark, d).select("cluster_id", "category"), S.members(spark, d), "cluster_id", "votes")


@query("""SELECT cluster_id, round(200 * least(l, r) / n + 0.5::DOUBLE * (high - low) + CASE WHEN low <= 42 AND high >= 58 THEN 20 ELSE 0 END, 4) AS disagreement FROM (
  SELECT cluster_id, count(*) FILTER (WHERE lean <= 45) AS l, count(*) FILTER (WHERE lean > 55) AS r, count(*) AS n, min(lean) AS low, max(lean) AS high FROM members GROUP BY cluster_id)""", "members")
def cluster_disagreement(spark, d):
    """Disagreement of every cluster."""
    return serving.disagreement(S.members(spark, d))


@query("""WITH o AS (SELECT * FROM (SELECT cluster_id, source_id, lean, row_number() OVER (PARTITION BY cluster_id, lean ORDER BY source_id % 3, source_id) AS r FROM members) WHERE r = 1)
SELECT cluster_id, source_id, slot FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY NOT (lean = low OR lean = high), source_id % 3, lean) AS slot FROM (SELECT *, min(lean) OVER (PARTITION BY cluster_id) AS low, max(lean) OVER (PARTITION BY cluster_id) AS high FROM o)) WHERE slot <= 3""", "members")
def display_outlets(spark, d):
    """Three outlets of each cluster that span its leans."""
    return serving.display_outlets(S.members(spark, d).select("cluster_id", "source_id", "lean", (F.col("source_id") % 3).alias("tier_rank"))).select("cluster_id", "source_id", F.col("slot").cast("long").alias("slot"))


ORACLE_SQL["display_outlets"] = ORACLE_SQL["display_outlets"].replace(" WITH o AS", ", o AS", 1)


@query(f"""SELECT source, article_id, n_words FROM (SELECT source, article_id, {_COUNT} AS n_words, row_number() OVER (PARTITION BY source ORDER BY {_COUNT} DESC, article_id) AS r FROM (SELECT *, body AS text FROM articles)) WHERE r = 1""", "articles")
def best_article_text(spark, d):
    """The longest article of each source."""
    return serving.best_text(S.articles(spark, d), "source").select("source", "article_id", F.col("n_words").cast("long").alias("n_words"))


@query("""SELECT a.event_id AS claim_id, count(*) AS corroborations FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type <> b.event_type AND b.ts >= a.ts + INTERVAL 6 HOURS AND b.ts <= a.ts + INTERVAL 24 HOURS GROUP BY a.event_id""")
def later_corroboration(spark, d):
    """Later claims by others on the same topic."""
    return serving.later_corroboration(table(spark, d, "events").select(F.col("event_id").alias("claim_id"), F.col("event_type").alias("source_id"), F.col("user_id").alias("topic"), F.col("ts").alias("at")))


@query("""SELECT 'now' AS kind, count(*) AS n FROM members WHERE published_at >= TIMESTAMP '2001-09-01' UNION ALL SELECT 'all', count(*) FROM members WHERE published_at >= TIMESTAMP '2001-09-01' OR (published_at >= TIMESTAMP '2001-11-05' - INTERVAL 2400 HOURS
  AND article_id NOT IN (SELECT article_id FROM members WHERE published_at >= TIMESTAMP '2001-09-01'))""", "members")
def lookback_append(spark, d):
    """Sizes of a batch without and with its lookback."""
    m = S.members(spark, d)
    cut = F.lit("2001-09-01").cast("timestamp_ntz")
    batch, earlier = m.where(F.col("published_at") >= cut), m.where(F.col("published_at") < cut)
    whole = serving.with_lookback(batch, earlier, "published_at", AS_OF, 2400)
    return batch.agg(F.lit("now").alias("kind"), F.count("*").alias("n")).unionByName(whole.agg(F.lit("all").alias("kind"), F.count("*").alias("n")))


@query("""SELECT doc_id AS article_id, CASE WHEN contains(lower(substring(text, 1, 200)), 'the') AND (contains(lower(text), 'killed')) THEN 55 ELSE 0 END::DOUBLE AS severity, length(CASE WHEN n_chars % 2 = 1 AND length(text) > 300 THEN concat(substring(text, 1, 297), '...') ELSE text END) AS kept_chars FROM documents""")
def disaster_and_truncation(spark, d):
    """Disaster severity of every document, and its length once stored."""
    from newsloom.operators.feed import shortened
    from newsloom.operators.scores import disaster_severity

    docs = table(spark, d, "documents")
    lead = F.concat(F.substring("text", 1, 200), F.when(F.contains(F.lower("text"), F.lit("killed")), " killed").otherwise(""))
    return docs.select(F.col("doc_id").alias("article_id"), disaster_severity(lead, ["the"], ["killed"]).cast("double").alias("severity"), F.length(shortened(F.col("text"), F.col("n_chars") % 2 == 0)).alias("kept_chars"))
