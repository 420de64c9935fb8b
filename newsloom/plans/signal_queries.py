"""Registered queries of the full rank, and of small scores and labels over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.operators import feed, ranking, scores, serving, state
from newsloom.plans import story_tables as S
from newsloom.plans.queries import _SCORES_SQL, ORACLE_SQL, _count_sql, _hits_sql, query, rank_signals, score_signals

_VERBS, _WEIGHTY, _HEDGED, _FIRST, _SECOND = ["bolt", "ring", "rod"], "hot anvil", "old plate", ["gizmo"], ["widget", "gear"]
_PLACES, _KEYS = {"red": 2, "blue": 3}, ["cold", "new"]


@query("SELECT 1")
def importance_rank(spark, d):
    """The rank of every cluster from all eleven signals; titles of its articles are the names of their parts."""
    facts = scores.title_facts(F.col("p_name"), _VERBS, [_WEIGHTY], [_HEDGED], _FIRST, _SECOND, list(_PLACES), _KEYS)
    part = S.table(spark, d, "part").select(F.col("p_partkey").alias("topic_id"), facts.alias("facts"))
    told = S.members(spark, d).join(part, "topic_id", "left").select("cluster_id", "article_id", "facts")
    words = scores.title_signals(told, _PLACES, _KEYS)
    return ranking.rank_clusters(rank_signals(spark, d).join(words, "cluster_id"))


_HAS = lambda w: f"max(list_contains(string_split(lower(title), ' '), '{w}')::INT)"
_WORDED = f"""titled AS (SELECT cluster_id, article_id, coalesce(p_name, '') AS title FROM members LEFT JOIN part ON p_partkey = topic_id),
ten AS (SELECT * FROM titled QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY article_id) <= 10),
g0 AS (SELECT cluster_id, {" + ".join(_HAS(v) for v in _VERBS)} AS verbs, sum({_count_sql(_VERBS)}) AS n, bool_or(contains(title, '{_WEIGHTY}')) AS weighty, bool_or(contains(title, '{_HEDGED}')) AS hedged,
  sum({_hits_sql(_FIRST)}) AS t1, sum({_hits_sql(_SECOND)}) AS t2 FROM ten GROUP BY cluster_id),
g1 AS (SELECT *, greatest(0.6::DOUBLE * least(100::DOUBLE, verbs * 20::DOUBLE) + 0.4::DOUBLE * least(100::DOUBLE, n * 5::DOUBLE), CASE WHEN weighty THEN 70::DOUBLE ELSE 0 END) AS raw,
  CASE WHEN t1 > 0 THEN least(100::DOUBLE, 80 + (t1 - 1) * 10::DOUBLE) ELSE 0 END AS one, CASE WHEN t2 > 0 THEN least(70::DOUBLE, 40 + (t2 - 1) * 10::DOUBLE) ELSE 0 END AS two FROM g0),
ev AS (SELECT cluster_id, round(CASE WHEN hedged THEN raw * 0.7::DOUBLE ELSE raw END, 4) AS consequentiality, round(CASE WHEN one > 0 AND two > 0 THEN least(100::DOUBLE, one + two * 0.2::DOUBLE) ELSE greatest(one, two) END, 4) AS authority FROM g1),
geo AS (SELECT cluster_id, least({" + ".join(f"{_HAS(w)} * {v}" for w, v in _PLACES.items())}, 6) * 10::DOUBLE + least({" + ".join(f"max(contains(lower(title), '{w}')::INT)" for w in _KEYS)}, 8) * 5::DOUBLE AS geographic FROM titled GROUP BY cluster_id),
r AS ("""
ORACLE_SQL["importance_rank"] = (
    ORACLE_SQL["headline_rank"].replace("r AS (", _WORDED, 1)
    .replace("velocity * 0.03::DOUBLE)", "velocity * 0.03::DOUBLE + consequentiality * 0.10::DOUBLE + authority * 0.08::DOUBLE + geographic * 0.06::DOUBLE)")
    .replace("JOIN e USING (cluster_id))", "JOIN e USING (cluster_id) JOIN ev USING (cluster_id) JOIN geo USING (cluster_id))")
    .replace("before * 0.82::DOUBLE", "before * CASE WHEN consequentiality < 5 THEN 0.82::DOUBLE ELSE 1 END")
)


@query(f""", c AS ({_SCORES_SQL}), l AS (SELECT cluster_id, list_sort(list_filter([{{'o': -perspective * 0.09::DOUBLE, 'v': perspective, 'n': 'perspective'}}, {{'o': -divergence * 0.07::DOUBLE, 'v': divergence, 'n': 'divergence'}}, {{'o': -factual * 0.08::DOUBLE, 'v': factual, 'n': 'factual'}}], lambda s: s.v >= 40)) AS s FROM c)
SELECT cluster_id, array_to_string(list_transform(s[1:2], lambda x: x.n), ',') AS labels FROM l""", "members")
def rank_labels(spark, d):
    """The two weightiest strong signals of every cluster."""
    return serving.rank_labels(score_signals(spark, d), {"perspective": 0.09, "divergence": 0.07, "factual": 0.08}, 2, 40.0)


@query(""", v AS (SELECT source_id, avg(rigor) AS rigor FROM members GROUP BY ALL), p AS (SELECT source_id, avg(rigor) AS prior FROM members WHERE line = 1 AND source_id % 4 <> 0 GROUP BY ALL)
SELECT source_id, round(CASE WHEN prior IS NULL THEN rigor ELSE 0.7::DOUBLE * rigor + 0.3::DOUBLE * prior END, 4) AS blended FROM v LEFT JOIN p USING (source_id)""", "members")
def prior_blend(spark, d):
    """Mean rigor of every outlet blended with its earlier mean, where it has one."""
    m = S.members(spark, d)
    earlier = m.where("line = 1 AND source_id % 4 <> 0").groupBy("source_id").agg(F.avg("rigor").alias("average"))
    return state.blend_prior(m.groupBy("source_id").agg(F.avg("rigor").alias("rigor")), earlier, ["source_id"], "rigor").select("source_id", "blended")


@query("SELECT conv_id, sha256(array_to_string(list_sort(list(coalesce(text, ''))), chr(10))) AS content_hash FROM conversations GROUP BY conv_id")
def content_hashes(spark, d):
    """One hash for the turns of every conversation, whatever their order."""
    return S.table(spark, d, "conversations").groupBy("conv_id").agg(T.content_hash(F.collect_list(F.coalesce("text", F.lit("")))).alias("content_hash"))


_N_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r]+'))"


@query(f"""SELECT doc_id, CASE WHEN n < 150 THEN greatest(0.15::DOUBLE, n / 500::DOUBLE) ELSE CAST(round(CAST(CAST(0.4::DOUBLE * least(1::DOUBLE, n / 800::DOUBLE) + 0.3::DOUBLE * least(1::DOUBLE, length(text) / 1600::DOUBLE) + 0.3::DOUBLE * ((abs(doc_id % 101 - 50) + abs(doc_id * 7 % 101 - 50)) / 100::DOUBLE) AS VARCHAR) AS DECIMAL(25, 20)), 4) AS DOUBLE) END AS confidence,
  CAST(round_even(greatest(0::DOUBLE, least(100::DOUBLE, doc_id % 5 * 25 + greatest(-10, least(10, doc_id * 13 % 101 - 50)) * least(1::DOUBLE, n / 150::DOUBLE))), 0) AS DOUBLE) AS lean
FROM (SELECT *, {_N_WORDS} AS n FROM documents)""")
def article_trust(spark, d):
    """How far the scores of every document can be trusted, and its outlet's placement moved by its text."""
    rows = S.table(spark, d, "documents").withColumn("n", T.word_count(F.col("text")))
    k = F.col("doc_id")
    return rows.select("doc_id", scores.article_confidence(F.col("n"), F.length("text"), k % 101, k * 7 % 101).alias("confidence"), scores.anchored_lean(k % 5 * 25, k * 13 % 101, F.col("n")).cast("double").alias("lean"))


@query("""SELECT o_custkey AS owner_id, array_to_string(list_transform(list_sort(list(DISTINCT o_orderstatus)), lambda s: CASE WHEN s = 'P' THEN 'pending' ELSE s END), ',') AS sections FROM orders GROUP BY ALL""")
def renamed_sections(spark, d):
    """The sections of every owner with one of them renamed."""
    owners = S.clusters(spark, d).groupBy("owner_id").agg(F.array_sort(F.collect_set("status")).alias("sections"))
    return feed.sections_replaced(owners, "sections", "P", "pending").select("owner_id", F.array_join("sections", ",").alias("sections"))


@query(""" SELECT cluster_id, line, article_id, CASE WHEN lean <= 20 THEN 'far left' WHEN lean <= 35 THEN 'left' WHEN lean <= 45 THEN 'center left' WHEN lean <= 55 THEN 'center' WHEN lean <= 65 THEN 'center right' WHEN lean <= 80 THEN 'right' ELSE 'far right' END AS label FROM members""", "members")
def lean_labels(spark, d):
    """The label of the lean of every article."""
    return S.members(spark, d).select("cluster_id", "line", "article_id", T.lean_label(F.col("lean")).alias("label"))
