"""Full-text search of printed stories: an index with positions, queries of words and phrases, ranks by the density of covers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.functions.stems import porter
from newsloom.functions.text import words
from newsloom.operators.selection import best_per_key
from newsloom.shared import materialise

# What a word counts by its label, and the most stories that a search gives.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
MOST = 50


def positional_index(stories: DataFrame, key: str, fields: list[tuple[str, str]], stopwords: list[str] = (), only: DataFrame | None = None) -> DataFrame:
    """(term, `key`, place, weight): every word of the `fields` (column, label A to D) as its Porter stem.

    Places run on from field to field from 0, and stop words keep theirs. Null and empty fields have no words. Write the result
    as a table where it is searched often. Every distinct word is stemmed once; the stems are written, as a filter on a stem would
    be pushed through all steps of the stemmer. With `only` (term) the index holds these terms: for searches known beforehand. The words
    of the terms then go to all tasks and places are found where texts are read; no frequent word is sorted.
    """
    def labelled(column: str, label: str) -> Column:
        return F.transform(words(F.coalesce(F.col(column), F.lit(""))), lambda w: F.struct(w.alias("word"), F.lit(WEIGHTS[label]).alias("weight")))

    spots = stories.select(key, F.posexplode(F.concat(*(labelled(*f) for f in fields))).alias("place", "w")).select(key, "place", "w.word", "w.weight").where(~F.col("word").isin(list(stopwords)))
    stems = materialise(porter(spots.select("word").distinct(), "word", "term"), "archive-stems")
    if only is not None:
        stems = F.broadcast(materialise(stems.join(only.select("term").distinct(), "term", "left_semi"), "archive-searched"))
    return spots.join(stems, "word").select("term", key, "place", "weight")


def web_query(text: str) -> list[list[tuple[bool, list[str]]]]:
    """Alternatives, each a list of (wanted, words): quotes hold a phrase together, a minus excludes, `or` parts alternatives.

    Alternatives that only exclude are left out.
    """
    out: list[list[tuple[bool, list[str]]]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', text.lower()):
        found = re.findall("[a-z0-9]+", phrase or word)
        if word == "or" and not minus:
            out.append([])
        elif found:
            out[-1].append((not minus, found))
    return [a for a in out if any(wanted for wanted, _ in a)]


def query_terms(spark: SparkSession, queries: dict[int, str], stopwords: list[str] = ()) -> DataFrame:
    """A row for each word of the queries: (query_id, alternative, unit, units, wanted, size, offset, term).

    A unit is a word or phrase; wanted ones are numbered from 0 to `units` of their alternative, the others from there on. Stop words
    leave a gap in their phrase; units of stop words alone are left out.
    """
    rows = []
    for query_id, text in queries.items():
        for a, units in enumerate(web_query(text)):
            kept = [(wanted, [(k, w) for k, w in enumerate(found) if w not in stopwords]) for wanted, found in units]
            kept = sorted((u for u in kept if u[1]), key=lambda u: not u[0])
            n = sum(wanted for wanted, _ in kept)
            rows += [(query_id, a, i, n, wanted, len(found), k - found[0][0], w) for i, (wanted, found) in enumerate(kept) if n for k, w in found]
    terms = spark.createDataFrame(rows, "query_id long, alternative int, unit int, units int, wanted boolean, size int, offset int, word string")
    return materialise(terms.join(porter(terms.select("word").distinct(), "word", "term"), "word").drop("word"), "archive-query")


def cover_density(index: DataFrame, terms: DataFrame, key: str, most_units: int) -> DataFrame:
    """(query_id, `key`, covers, density) of the stories that match: an alternative has all wanted units there and no other one.

    A cover is a shortest span that holds all wanted units of an alternative, and no shorter cover. Its density is the number of
    wanted words in it over the sum of their inverse weights, divided by one more than the words between them. `most_units` is at
    least the most wanted units of an alternative. Work grows with the places of the queries' words; a window holds one story.
    """
    story = ["query_id", key]
    hits = index.join(terms, "term")
    walk = Window.partitionBy(*story, "wanted").orderBy("place")
    upto = walk.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own = 1 / F.col("weight")
    fresh = F.coalesce(F.lag("place").over(walk) != F.col("place"), F.lit(True))
    marked = hits.withColumn("fresh", fresh)
    summed = marked.withColumns({"n": F.count_if("fresh").over(upto), "inverse": F.sum(F.when(F.col("fresh"), own).otherwise(0.0)).over(upto)})
    found = summed.groupBy(*story, "alternative", "wanted", "unit", "units", "size", (F.col("place") - F.col("offset")).alias("start")).agg(
        F.count("*").alias("found"), F.max("place").alias("end"), (F.min("n") - 1).alias("n_before"), F.min(F.col("inverse") - own).alias("inverse_before"), F.max("n").alias("n_end"), F.max("inverse").alias("inverse_end"),
    ).where("found = size")
    of = Window.partitionBy(*story, "alternative")
    before = of.orderBy("end").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    begin = F.struct("start", "n_before", "inverse_before")
    last = F.array(*(F.max(F.when(F.col("wanted") & (F.col("unit") == u), begin)).over(before) for u in range(most_units)))
    ends = found.withColumns({"last": last, "barred": F.max(~F.col("wanted")).over(of)}).where("wanted AND NOT barred").withColumn("last", F.slice("last", F.lit(1), F.col("units")))
    spans = ends.where(~F.exists("last", lambda s: s.isNull())).select(*story, "end", "n_end", "inverse_end", F.array_min("last").alias("b"))
    nearest = F.max("b.start").over(Window.partitionBy(*story).orderBy("end", F.desc("b.start")).rowsBetween(Window.unboundedPreceding, -1))
    covers = spans.withColumn("nearest", nearest).where("nearest IS NULL OR b.start > nearest")
    n = F.col("n_end") - F.col("b.n_before")
    noise = F.col("end") - F.col("b.start") + 1 - n
    return covers.groupBy(*story).agg(F.count("*").alias("covers"), F.sum(n / (F.col("inverse_end") - F.col("b.inverse_before")) / (1 + noise)).alias("density"))


def boosted(density: Column, source_count: Column, day: Column, as_of: str) -> Column:
    """The density raised by breadth (60 outlets at most) and lowered by age."""
    age = F.date_diff(F.lit(as_of).cast("date"), day)
    return density * (1 + F.least(source_count, F.lit(60)) / 120.0) * (0.5 + 0.5 * F.exp(-age / 90.0))


def search_printed(
    printed: DataFrame, index: DataFrame, queries: dict[int, str], as_of: str, collapse: bool = True, since: str | None = None, until: str | None = None, category: str | None = None, limit: int = 10, offset: int = 0, stopwords: list[str] = (),
) -> DataFrame:
    """The best printings for each query: (query_id, place from 1, story_id, thread, thread_printings, covers, rank).

    `printed` (story_id unique, thread, day, category, source_count), `index` of it by `positional_index` with the same stop words.
    Collapsed, a thread gives its best printing only; stories of no thread stand alone. thread_printings counts a thread before any
    filter. Ranks are rounded to 8 digits; ties go to the later day, then the smaller story_id. `limit` is held between 1 and 50.
    """
    spark = printed.sparkSession
    most_units = max((sum(w for w, _ in a) for q in queries.values() for a in web_query(q)), default=1)
    ranks = cover_density(index, query_terms(spark, queries, stopwords), "story_id", most_units)
    kept = printed
    if since is not None:
        kept = kept.where(F.col("day") >= F.lit(since).cast("date"))
    if until is not None:
        kept = kept.where(F.col("day") <= F.lit(until).cast("date"))
    if category is not None:
        kept = kept.where(F.col("category") == category)
    scored = ranks.join(kept.select("story_id", "thread", "day", "source_count"), "story_id").withColumn("rank", F.round(boosted(F.col("density"), F.col("source_count"), F.col("day"), as_of), 8))
    best = [F.desc("rank"), F.desc("day"), F.col("story_id")]
    if collapse:
        alone = F.when(F.col("thread").isNull(), F.col("story_id"))
        scored = best_per_key(scored.withColumn("alone", alone), ["query_id", "thread", "alone"], best).drop("place", "alone")
    first, most = max(offset, 0), min(max(limit, 1), MOST)
    shown = best_per_key(scored, ["query_id"], best, first + most).where(F.col("place") > first)
    printings = printed.where("thread IS NOT NULL").groupBy("thread").agg(F.count("*").alias("thread_printings"))
    return shown.join(printings, "thread", "left").select("query_id", "place", "story_id", "thread", "thread_printings", "covers", "rank")
