"""Registered queries of claims: the sentences of five words and more of eight neighbouring documents are a story's claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions.text import words
from newsloom.operators import claims
from newsloom.plans.queries import query
from newsloom.plans.story_tables import table
from newsloom.shared import materialise

_CUT = "[.!?][ \\n]+"


def _groups(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", F.posexplode(F.split("text", _CUT)).alias("place", "text"))
    said = rows.where(F.size(F.filter(words(F.col("text")), lambda w: F.length(w) >= 2)) >= 5).select(
        F.expr("doc_id div 8").alias("cluster_id"), (F.col("doc_id") * 100000 + F.col("place")).alias("claim_id"), F.col("source").alias("source_id"), F.regexp_extract("text", "[A-Z][a-z]{3,}", 0).alias("entity"), "text")
    grouped = claims.claim_groups(said).withColumn("text", F.when(~F.col("alone"), F.col("text")))  # a claim of its own conflicts with none
    return claims.verified_groups(materialise(grouped.drop("entity"), "claim-groups"))


#: All pairs of a story's claims, links closed by recursion, conflicts by all pairs of a group.
_GROUPS_SQL = rf"""WITH RECURSIVE docs AS (SELECT doc_id, source, string_split_regex(text, '[.!?][ \n]+') AS s FROM documents WHERE text IS NOT NULL),
said AS (SELECT doc_id, source, unnest(s) AS text, generate_subscripts(s, 1) - 1 AS place FROM docs),
c AS MATERIALIZED (SELECT * FROM (SELECT doc_id // 8 AS cluster_id, doc_id * 100000 + place AS claim_id, source AS source_id, lower(regexp_extract(text, '[A-Z][a-z]{{3,}}')) AS topic, text,
  list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: length(w) >= 2) AS tokens FROM said) WHERE len(tokens) >= 5),
bags AS (SELECT cluster_id, claim_id, term, count(*) AS tf FROM (SELECT cluster_id, claim_id, unnest(tokens) AS term FROM c) GROUP BY ALL),
n AS (SELECT cluster_id, count(*) AS n FROM c GROUP BY 1), idf AS (SELECT cluster_id, term, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM bags JOIN n USING (cluster_id) GROUP BY cluster_id, term, n),
raw AS (SELECT cluster_id, claim_id, term, tf * idf AS w FROM bags JOIN idf USING (cluster_id, term)),
v AS MATERIALIZED (SELECT cluster_id, claim_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY claim_id)) AS w FROM raw),
pairs AS (SELECT x.claim_id AS a, y.claim_id AS b, round(sum(x.w * y.w), 9) AS cosine FROM v x JOIN v y ON x.cluster_id = y.cluster_id AND x.term = y.term AND x.claim_id <> y.claim_id GROUP BY ALL HAVING cosine >= 0.3),
edges AS MATERIALIZED (SELECT a, b FROM pairs JOIN c p ON a = p.claim_id JOIN c q ON b = q.claim_id WHERE p.source_id <> q.source_id AND (cosine >= 0.65 OR (p.topic = q.topic AND p.topic <> ''))),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
label AS (SELECT claim_id, least(claim_id, coalesce(min(b), claim_id)) AS group_id FROM c LEFT JOIN reach ON a = claim_id GROUP BY claim_id),
x AS MATERIALIZED (SELECT c.*, group_id, string_split_regex(lower(text), '[ \t\n\r]+') AS w,
  list_filter(list_transform(regexp_extract_all(text, '[\d,]+\.?\d*'), lambda t: TRY_CAST(replace(t, ',', '') AS DOUBLE)), lambda t: t IS NOT NULL) AS numbers FROM c JOIN label USING (claim_id)),
two AS (SELECT p.group_id, p.numbers AS a, q.numbers AS b, p.w AS wa, q.w AS wb, list_sort(list_intersect(p.w, {claims.NEGATIONS})) <> list_sort(list_intersect(q.w, {claims.NEGATIONS})) AS negated
  FROM x p JOIN x q ON p.group_id = q.group_id AND p.source_id <> q.source_id),
k AS (SELECT group_id, bool_or(negated OR {" OR ".join(f"(list_contains(wa, '{a}') AND list_contains(wb, '{b}'))" for a, b in claims.OPPOSITES)}) AS negation,
  bool_or(len(list_filter(a, lambda m: len(list_filter(b, lambda o: greatest(m, o) > 0 AND (least(m, o) = 0 OR greatest(m, o) / least(m, o) <= 100) AND (greatest(m, o) - least(m, o)) / greatest(m, o) > 0.2)) > 0)) > 0) AS numeric FROM two GROUP BY 1),
g AS (SELECT cluster_id, group_id, count(*) AS n_claims, count(DISTINCT source_id) AS source_count, arg_min(claim_id, (-length(text), claim_id)) AS canonical_id FROM x GROUP BY ALL),
groups AS (SELECT g.*, CASE WHEN source_count < 2 THEN NULL WHEN negation THEN 'negation' WHEN numeric THEN 'numeric' END AS conflict FROM g LEFT JOIN k USING (group_id)),
verified AS (SELECT cluster_id, group_id, n_claims, source_count, CASE WHEN source_count < 2 THEN 'single_source' WHEN conflict IS NOT NULL THEN 'disputed' ELSE 'corroborated' END AS status, conflict, canonical_id FROM groups)"""


@query(f"{_GROUPS_SQL} SELECT * FROM verified")
def verified_claims(spark, d):
    """Groups of alike claims of every story, and whether outlets bear each other out."""
    return _groups(spark, d)


@query(f"""{_GROUPS_SQL} SELECT cluster_id, count(*) AS total, count(*) FILTER (WHERE status = 'corroborated') AS corroborated, count(*) FILTER (WHERE status = 'single_source') AS single_source,
  count(*) FILTER (WHERE status = 'disputed') AS disputed, round(count(*) FILTER (WHERE status = 'corroborated') / count(*), 3) AS ratio FROM verified GROUP BY 1""")
def claim_consensus(spark, d):
    """Claims of every story by status."""
    return claims.consensus(_groups(spark, d))
