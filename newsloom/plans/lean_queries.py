"""Registered queries of lean and framing: terms are learnt from the outlets' placements, then the lean and the framing of every whole text are scored."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.operators import framing, lean
from newsloom.plans.queries import query
from newsloom.plans.story_tables import table

#: An outlet's placement is 25 times its number modulo 5; numbers that 7 divides are a state's, those of remainder 3 are unrated.
_NUMBER = "CAST(regexp_extract(source, '([0-9]+)', 1) AS BIGINT)"


def _articles(spark, d):
    n = F.regexp_extract("source", "([0-9]+)", 1).try_cast("long")
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("article_id"), "text", (n % 5 * 25).cast("double").alias("baseline"), (n % 7 != 3).alias("rated"), (n % 7 == 0).alias("state"), F.when(n % 2 == 0, n * 3).cast("double").alias("topic_lean"))


_VERBS = ", ".join(f"'{v}'" for v in lean.ATTRIBUTING)
_PATTERN = "(?s)" + lean.QUOTATION.replace("'", "''")
_STARTS = "list_transform(range(1, len({0})), lambda i: list_sum(list_transform({0}[1:i], lambda p: length(p))) + (i - 1) * length({1}))"


#: Lower-case texts, the terms that placed outlets give, and for each article and term its hits and those in reported speech.
_HITS_SQL = rf"""WITH a AS MATERIALIZED (SELECT doc_id AS article_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
  len(regexp_extract_all(text, '[^ \t\n\r]+')) AS n_words, {_NUMBER} AS k FROM documents),
placed AS (SELECT CASE WHEN k % 5 * 25 < 45 THEN 'left' WHEN k % 5 * 25 > 55 THEN 'right' END AS side, list_distinct(regexp_extract_all(low, '[a-z]{{3,}}')) AS words FROM a WHERE k % 5 <> 2),
sizes AS (SELECT count(*) FILTER (WHERE side = 'left') AS n_left, count(*) FILTER (WHERE side = 'right') AS n_right FROM placed),
counts AS (SELECT term, count(*) FILTER (WHERE side = 'left') AS l, count(*) FILTER (WHERE side = 'right') AS r FROM (SELECT side, unnest(words) AS term FROM placed) GROUP BY term HAVING count(*) >= 20),
rated AS (SELECT term, round(ln((r + 1) / (n_right + 2) * (n_left + 2) / (l + 1)), 9) AS ratio FROM counts, sizes),
terms AS MATERIALIZED (SELECT term, ratio < 0 AS is_left, CASE WHEN abs(ratio) >= 1 THEN 3.0::DOUBLE WHEN abs(ratio) >= 0.5 THEN 2.0 ELSE 1.0 END AS weight FROM rated WHERE ratio <> 0
  QUALIFY row_number() OVER (PARTITION BY ratio < 0 ORDER BY abs(ratio) DESC, term) <= 60),
pieces AS (SELECT article_id, low, term, string_split(low, term) AS p FROM a JOIN terms ON contains(low, term)),
places AS (SELECT article_id, term, low, unnest({_STARTS.format("p", "term")}) AS s FROM pieces),
hits AS MATERIALIZED (SELECT article_id, term, CAST(s AS BIGINT) AS s, CAST(s + length(term) AS BIGINT) AS e FROM places
  WHERE (s = 0 OR NOT regexp_matches(substring(low, CAST(s AS BIGINT), 1), '[\p{{L}}\p{{N}}_]')) AND NOT regexp_matches(substring(low, CAST(s AS BIGINT) + length(term) + 1, 1), '[\p{{L}}\p{{N}}_]')),
quoted AS (SELECT article_id, regexp_extract_all(low, '{_PATTERN}') AS q, regexp_split_to_array(low, '{_PATTERN}') AS g FROM a),
spans AS MATERIALIZED (SELECT article_id, CAST(s AS BIGINT) AS s, CAST(s AS BIGINT) + n AS e FROM (SELECT article_id,
  unnest(list_transform(q, lambda x, i: list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(q[1:i - 1], lambda y: length(y))), 0))) AS s, unnest(list_transform(q, lambda x: length(x))) AS n FROM quoted)),
verbs AS (SELECT article_id, v, string_split(low, v) AS p FROM a JOIN (SELECT unnest([{_VERBS}]) AS v) ON contains(low, v)),
marks AS MATERIALIZED (SELECT article_id, CAST(unnest({_STARTS.format("p", "v")}) AS BIGINT) AS s FROM verbs),
told AS (SELECT *, EXISTS (SELECT 1 FROM spans WHERE spans.article_id = hits.article_id AND spans.s <= hits.s AND hits.e <= spans.e)
  OR EXISTS (SELECT 1 FROM marks WHERE marks.article_id = hits.article_id AND abs(marks.s - hits.s) <= 120) AS reported FROM hits),
by_term AS (SELECT article_id, is_left, weight, count(*) AS n, count(*) FILTER (WHERE reported) AS half FROM told JOIN terms USING (term) GROUP BY article_id, term, is_left, weight)"""


@query(rf"""{_HITS_SQL},
by_article AS (SELECT article_id, coalesce(sum(weight * (n - 0.5::DOUBLE * half)) FILTER (WHERE is_left), 0) AS l, coalesce(sum(weight * (n - 0.5::DOUBLE * half)) FILTER (WHERE NOT is_left), 0) AS r,
  count(*) AS n_terms, count(*) FILTER (WHERE n = half) AS n_half FROM by_term GROUP BY article_id),
s AS (SELECT a.article_id, k, coalesce(n_words, 0) AS n_words, coalesce(l, 0) AS l, coalesce(r, 0) AS r, coalesce(n_terms, 0) AS n_terms, coalesce(n_half, 0) AS n_half FROM a LEFT JOIN by_article USING (article_id)),
t AS (SELECT *, round(CASE WHEN l + r > 0 THEN 50 + (r / (l + r) - 0.5::DOUBLE) / (1 + exp(-0.7::DOUBLE * (n_terms - 0.5::DOUBLE * n_half - 4))) * 100 ELSE 50 END, 6) AS score,
  CASE WHEN k % 7 = 0 THEN 8 WHEN k % 7 = 3 THEN 24 ELSE 10 END AS most, CASE WHEN k % 2 = 0 THEN k % 5 * 25 * 0.7::DOUBLE + k * 3 * 0.3::DOUBLE ELSE k % 5 * 25 END AS anchor FROM s)
SELECT article_id, score AS keyword_score, l AS left_weight, r AS right_weight, n_terms, n_half AS n_reported_only, score AS text_score,
  CAST(round_even(greatest(0, least(100, anchor + CASE WHEN n_words = 0 THEN 0 ELSE greatest(-most, least(most, score - 50)) * least(1, n_words / 150) END)), 0) AS INTEGER) AS lean,
  k % 7 = 3 AND n_terms <= 2 AND n_words > 0 AS unscored FROM t""")
def article_lean(spark, d):
    """Lean of every article by the terms of placed outlets, half weight in reported speech, anchored at its outlet."""
    a = _articles(spark, d)
    return lean.article_lean(a, lean.outlet_terms(a))


_SIDES = [" de ", " la ", " the "], [" le ", " of ", " and "]
_ENTITIES = "[A-Z][a-z]{2,}"


@query(rf"""{_HITS_SQL},
weights AS (SELECT article_id, sum(weight * (n - 0.5::DOUBLE * half)) AS weight FROM by_term GROUP BY 1),
named AS MATERIALIZED (SELECT doc_id // 8 AS cluster_id, doc_id AS article_id, list_distinct(regexp_extract_all(coalesce(text, ''), '{_ENTITIES}')) AS own FROM documents),
others AS (SELECT x.article_id, len(x.own) AS n_own, len(list_distinct(flatten(list(y.own)))) AS n_others, len(list_intersect(x.own, list_distinct(flatten(list(y.own))))) AS n_common
  FROM named x JOIN named y ON x.cluster_id = y.cluster_id AND x.article_id <> y.article_id GROUP BY x.article_id, x.own),
s AS (SELECT article_id, k, coalesce(n_words, 0) AS n_words, round(least(100, coalesce(weight, 0) / greatest(coalesce(n_words, 0) / 100, 1) * 15), 6) AS emphasis,
  len(regexp_extract_all(low, '{"|".join(_SIDES[0])}')) AS p, len(regexp_extract_all(low, '{"|".join(_SIDES[1])}')) AS q,
  CASE WHEN n_own > 0 AND n_others > 0 THEN (1 - n_common / n_others) * 30 ELSE 0 END AS missed FROM a LEFT JOIN weights USING (article_id) LEFT JOIN others USING (article_id)),
t AS (SELECT *, CASE WHEN p + q = 0 THEN 10 WHEN p = 0 OR q = 0 THEN least(100, (p + q) * 15) ELSE (1 - least(p, q) / greatest(p, q)) * 60 END::DOUBLE AS sourcing FROM s),
u AS (SELECT *, round(least(100, sourcing + missed), 6) AS omission, least(1, n_words / 500) AS share, CASE k % 3 WHEN 0 THEN 18 WHEN 1 THEN 20 ELSE 25 END AS lowest FROM t),
v AS (SELECT *, least(100, emphasis * CASE WHEN emphasis > 60 THEN 0.45::DOUBLE ELSE 0.35::DOUBLE END + omission * 0.15::DOUBLE) AS raw FROM u)
SELECT article_id, emphasis, sourcing, omission, CASE WHEN n_words = 0 THEN 15 ELSE CAST(round_even(round(greatest(raw, share * raw + (1 - share) * lowest), 6), 0) AS INTEGER) END AS framing FROM v""")
def framing_scores(spark, d):
    """Framing of every article within its story, eight neighbours each; capitalised words are its entities, the learnt terms its charged ones."""
    a = _articles(spark, d)
    tier = F.element_at(F.array(*map(F.lit, framing.FLOORS)), (F.regexp_extract("source", "([0-9]+)", 1).try_cast("long") % 3 + 1).cast("int"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("article_id"), "text", tier.alias("tier"))
    entities = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_ENTITIES), F.lit(0))
    members = docs.select(F.expr("article_id div 8").alias("cluster_id"), "article_id", entities.alias("entities"))
    return framing.framing_scores(docs, lean.outlet_terms(a), members, *_SIDES)
