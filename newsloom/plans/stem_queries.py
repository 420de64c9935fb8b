"""Registered queries of Porter stems, with twins that take the same published steps in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import stems
from newsloom.functions import text as T
from newsloom.plans import story_tables as S
from newsloom.plans.queries import query


def _table_sql(prev: str, table: dict[str, str]) -> str:
    pattern = f"'^(.+?)({'|'.join(table)})$'"
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    return f"""SELECT word, CASE WHEN regexp_matches(w, {pattern}) AND regexp_matches(regexp_extract(w, {pattern}, 1), '{stems.MEASURED}')
  THEN regexp_extract(w, {pattern}, 1) || CASE regexp_extract(w, {pattern}, 2) {cases} END ELSE w END AS w FROM {prev}"""


def _stem_sql(words: str) -> str:
    """Tables p0 to p9 over the column `word` of `words`; p9 holds (word, stem)."""
    fits = lambda n, p: f"regexp_matches(left(w, length(w) - {n}), '{p}')"
    four = f"'^(.+?)({'|'.join(stems.STEP_4)})$'"
    return f"""p0 AS (SELECT word, regexp_replace(word, '^y', 'Y') AS w FROM {words}),
p1 AS (SELECT word, CASE WHEN regexp_matches(w, '.(ss|i)es$') THEN left(w, -2) WHEN regexp_matches(w, '.[^s]s$') THEN left(w, -1) ELSE w END AS w FROM p0),
p2 AS (SELECT word, CASE WHEN regexp_matches(w, 'eed$') THEN 0 WHEN regexp_matches(w, '.ed$') AND {fits(2, stems.VOWEL)} THEN 2 WHEN regexp_matches(w, '.ing$') AND {fits(3, stems.VOWEL)} THEN 3 ELSE 0 END AS n,
  CASE WHEN regexp_matches(w, '.eed$') AND {fits(3, stems.MEASURED)} THEN left(w, -1) ELSE w END AS w FROM p1),
p3 AS (SELECT word, CASE WHEN n = 0 THEN w WHEN regexp_matches(x, '(at|bl|iz)$') THEN x || 'e' WHEN regexp_matches(x, '([bcdfghjkmnpqrtvwx0-9Y])$') AND length(x) > 1 AND x[-1] = x[-2] THEN left(x, -1)
  WHEN regexp_matches(x, '{stems.SHORT}') THEN x || 'e' ELSE x END AS w FROM (SELECT *, left(w, length(w) - n) AS x FROM p2)),
p4 AS (SELECT word, CASE WHEN regexp_matches(w, '.y$') AND {fits(1, stems.VOWEL)} THEN left(w, -1) || 'i' ELSE w END AS w FROM p3),
p5 AS ({_table_sql("p4", stems.STEP_2)}), p6 AS ({_table_sql("p5", stems.STEP_3)}),
p7 AS (SELECT word, CASE WHEN regexp_matches(w, {four}) THEN CASE WHEN regexp_matches(regexp_extract(w, {four}, 1), '{stems.MEASURE_TWO}') THEN regexp_extract(w, {four}, 1) ELSE w END
  WHEN regexp_matches(w, '[st]ion$') AND {fits(3, stems.MEASURE_TWO)} THEN left(w, -3) ELSE w END AS w FROM p6),
p8 AS (SELECT word, CASE WHEN regexp_matches(w, '.e$') AND ({fits(1, stems.MEASURE_TWO)} OR ({fits(1, stems.MEASURE_ONE)} AND NOT {fits(1, stems.SHORT)})) THEN left(w, -1) ELSE w END AS w FROM p7),
p9 AS (SELECT word, CASE WHEN length(word) <= 2 THEN word ELSE regexp_replace(CASE WHEN regexp_matches(w, 'll$') AND regexp_matches(w, '{stems.MEASURE_TWO}') THEN left(w, -1) ELSE w END, '^Y', 'y') END AS stem FROM p8)"""


@query(f"""WITH words AS (SELECT word, count(*) AS n_documents FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) GROUP BY word), {_stem_sql("words")}
SELECT word, stem, n_documents FROM words JOIN p9 USING (word)""")
def porter_stems(spark, d):
    """Every distinct word of a to z of all whole texts, its documents and its stem."""
    docs = S.table(spark, d, "documents")
    seen = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("word"))
    return stems.porter(seen.groupBy("word").agg(F.count("*").alias("n_documents")), "word")


@query(f""", seen AS (SELECT DISTINCT article_id, unnest(list_filter(string_split_regex(lower(title), '[^a-z0-9]+'), lambda w: w <> '')) AS word FROM articles), distinct_words AS (SELECT DISTINCT word FROM seen), {_stem_sql("distinct_words")}
SELECT DISTINCT article_id, stem FROM seen JOIN p9 USING (word)""", "articles")
def porter_title_stems(spark, d):
    """Distinct stems of every title."""
    return stems.stemmed(S.articles(spark, d).select("article_id", T.words(F.col("title")).alias("words")), "words", ["article_id"])
