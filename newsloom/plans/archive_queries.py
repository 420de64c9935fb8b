"""Registered search of printed stories, with a twin that looks for covers from their other end."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.operators import archive
from newsloom.plans import story_tables as S
from newsloom.plans.queries import query
from newsloom.plans.stem_queries import _stem_sql

_SEARCHES = {1: "there theing -une", 2: '"of the" "and the" by', 3: '"the of" with or "le la" dans or "est -les"', 4: "onening or reing -le -the", 5: '"in it is"', 6: '"the of and" -"of the"'}


def _terms_sql() -> str:
    rows = []
    for query_id, text in _SEARCHES.items():
        for a, units in enumerate(archive.web_query(text)):
            n = sum(w for w, _ in units)
            for i, (wanted, found) in enumerate(sorted(units, key=lambda u: not u[0])):
                rows += [f"({query_id}, {a}, {i}, {n}, {wanted}, {len(found)}, {k}, '{w}')" for k, w in enumerate(found)]
    return ", ".join(rows)


_UNITS = max(sum(w for w, _ in a) for q in _SEARCHES.values() for a in archive.web_query(q))
_WORDS = "list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda w: w <> '')"


@query(f"""WITH docs AS (SELECT doc_id, {_WORDS.format("split_part(text, chr(10), 1)")} AS head, {_WORDS.format("text")} AS body FROM documents),
spots AS (SELECT doc_id, len(head) AS n_head, unnest(list_concat(head, body)) AS word, generate_subscripts(list_concat(head, body), 1) AS place FROM docs),
asked(query_id, alternative, unit, units, wanted, size, off, word) AS (VALUES {_terms_sql()}),
distinct_words AS (SELECT word FROM spots UNION SELECT word FROM asked), {_stem_sql("distinct_words")},
terms AS (SELECT asked.*, stem FROM asked JOIN p9 USING (word)),
hits AS (SELECT query_id, doc_id, alternative, wanted, unit, units, size, off, place, CASE WHEN place <= n_head THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END AS w FROM spots JOIN p9 USING (word) JOIN terms USING (stem)),
found AS (SELECT query_id, doc_id, alternative, wanted, unit, units, size, place - off AS start, max(place) AS last FROM hits GROUP BY ALL HAVING count(*) = any_value(size)),
fit AS (SELECT query_id, doc_id, alternative FROM found GROUP BY ALL HAVING count(DISTINCT unit) FILTER (WHERE wanted) = any_value(units) AND NOT bool_or(NOT wanted)),
ahead AS (SELECT query_id, doc_id, start, units, {", ".join(f"min(last) FILTER (WHERE unit = {u}) OVER w AS e{u}" for u in range(_UNITS))} FROM found JOIN fit USING (query_id, doc_id, alternative)
  WINDOW w AS (PARTITION BY query_id, doc_id, alternative ORDER BY start RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
spans AS (SELECT DISTINCT query_id, doc_id, start, greatest({", ".join(f"e{u}" for u in range(_UNITS))}) AS last FROM ahead WHERE {" AND ".join(f"(units <= {u} OR e{u} IS NOT NULL)" for u in range(_UNITS))}),
covers AS (SELECT query_id, doc_id, start, last FROM spans QUALIFY coalesce(last < min(last) OVER (PARTITION BY query_id, doc_id ORDER BY start DESC, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)),
places AS (SELECT DISTINCT query_id, doc_id, place, w FROM hits WHERE wanted),
dense AS (SELECT query_id, doc_id, start, last, count(*) AS n, sum(1 / w) AS inverse FROM covers JOIN places USING (query_id, doc_id) WHERE place BETWEEN start AND last GROUP BY ALL),
scored AS (SELECT query_id, doc_id AS story_id, doc_id % 150 AS thread, count(*) AS covers, round(sum(n / inverse / (1 + (last - start + 1 - n))) * (1 + least(any_value(n_chars) % 80, 60) / 120::DOUBLE) * (0.5::DOUBLE + 0.5::DOUBLE * exp(-(doc_id % 200) / 90::DOUBLE)), 8) AS rank
  FROM dense JOIN documents USING (doc_id) GROUP BY query_id, doc_id),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query_id, thread ORDER BY rank DESC, story_id % 200, story_id) = 1)
SELECT query_id, place, story_id, thread, thread_printings, covers, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, story_id % 200, story_id) AS place FROM best)
JOIN (SELECT doc_id % 150 AS thread, count(*) AS thread_printings FROM documents GROUP BY ALL) USING (thread) WHERE place <= 50""")
def archive_covers(spark, d):
    """The 50 best printings, one of each thread, for searches of words, phrases, alternatives and exclusions over all whole texts."""
    docs = S.table(spark, d, "documents")
    as_of = "2001-11-05"
    printed = docs.select(F.col("doc_id").alias("story_id"), (F.col("doc_id") % 150).alias("thread"), F.date_sub(F.lit(as_of).cast("date"), (F.col("doc_id") % 200).cast("int")).alias("day"), F.col("lang").alias("category"), (F.col("n_chars") % 80).alias("source_count"))
    texts = docs.select(F.col("doc_id").alias("story_id"), F.split("text", "\n", 2)[0].alias("title"), F.col("text").alias("summary"))
    index = archive.positional_index(texts, "story_id", [("title", "A"), ("summary", "B")], only=archive.query_terms(spark, _SEARCHES))
    return archive.search_printed(printed, index, _SEARCHES, as_of, limit=50)
