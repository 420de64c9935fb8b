"""Checks of feed cards that give findings, hygiene of summaries, and scores of titles and texts from word lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators.selection import best_per_key

# Our own word lists for the scores.


def any_of(phrases: list[str], whole: bool = True) -> str:
    """A pattern of any of the phrases, as whole words unless told otherwise; longer ones first."""
    inner = "|".join(sorted(phrases, key=lambda p: (-len(p), p)))
    return rf"\b({inner})\b" if whole else f"({inner})"


#: Marks of text that was scraped, not written.
_RAW = [r"(?i)continue reading", r"(?i)read more", r"(?i)sign up for", r"\[[+&]", r"\.\.\.$", r"(?i)^(photo|image|credit):", r"<[a-z/]"]


def is_raw_excerpt(summary: Column) -> Column:
    """Whether a summary looks scraped: one of the marks, two long words with a seam of small and capital letters, or a word of
    40 or more characters. False for null and blank ones."""
    s = F.trim(F.coalesce(summary, F.lit("")))
    marked = reduce(lambda a, b: a | b, (s.rlike(p) for p in _RAW))
    seams = F.regexp_count(s, F.lit(r"(?<![^ \t\n\r])(?=[^ \t\n\r]{12})[^ \t\n\r]*[a-z][A-Z]"))
    return (s != "") & (marked | (seams >= 2) | s.rlike(r"[^ \t\n\r]{40}"))


def clean_feed_summary(summary: Column) -> Column:
    """The summary as it is, or nothing for raw excerpts and blank ones."""
    return F.when((F.trim(F.coalesce(summary, F.lit(""))) == "") | is_raw_excerpt(summary), "").otherwise(summary)


def _finding(rows: DataFrame, code: str, grade: str, dimension: str) -> DataFrame:
    return rows.select("cluster_id", F.lit(code).alias("code"), F.lit(grade).alias("grade"), F.lit(dimension).alias("dimension"))


def coverage_findings(cards: DataFrame) -> DataFrame:
    """Cards of reporting without a summary, or with a raw excerpt for one."""
    news = cards.where(F.coalesce(F.lower("content_type") != "opinion", F.lit(True)))
    blank = F.trim(F.coalesce("summary", F.lit(""))) == ""
    return _finding(news.where(blank), "RF-4", "CATASTROPHIC", "coverage").unionByName(_finding(news.where(~blank & is_raw_excerpt(F.col("summary"))), "RF-4", "WRONG", "coverage"))


def hygiene_findings(cards: DataFrame, asserted: list[str]) -> DataFrame:
    """Cards with long dashes in title or summary, or words that assert significance."""
    both = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")))
    return _finding(cards.where(both.rlike("[–—]") | F.lower(both).rlike(any_of(asserted))), "RF-11", "ACCEPTABLE", "hygiene")


def agreement_findings(cards: DataFrame, title_terms: str, summary_terms: str) -> DataFrame:
    """Cards of which the summary holds none of at least two specific terms of the title."""
    news = cards.where(F.coalesce(F.lower("content_type") != "opinion", F.lit(True)) & (F.trim(F.coalesce("summary", F.lit(""))) != "") & ~is_raw_excerpt(F.col("summary")))
    return _finding(news.where((F.size(F.array_distinct(title_terms)) >= 2) & ~F.arrays_overlap(title_terms, summary_terms)), "RF-3", "WRONG", "agreement")


def contamination_findings(cards: DataFrame, members: DataFrame, title_terms: str, summary_terms: str) -> DataFrame:
    """Cards whose summary shares no term with the title, nor with any term that two member titles have.

    `members` (cluster_id, terms); cards with fewer than two members are left alone.
    """
    each = members.select("cluster_id", F.explode(F.array_distinct("terms")).alias("term")).groupBy("cluster_id", "term").agg(F.count("*").alias("n")).where("n > 1")
    many = members.groupBy("cluster_id").agg(F.count("*").alias("n")).where("n > 1").select("cluster_id")
    told = cards.join(many, "cluster_id", "left_semi").where((F.size(summary_terms) > 0) & ~F.arrays_overlap(title_terms, summary_terms))
    shared = told.select("cluster_id", F.explode(summary_terms).alias("term")).join(each, ["cluster_id", "term"], "left_semi").select("cluster_id")
    core = each.select("cluster_id").union(told.where(F.size(title_terms) > 0).select("cluster_id")).distinct()
    return _finding(told.join(shared, "cluster_id", "left_anti").join(core, "cluster_id", "left_semi"), "RF-1", "WRONG", "contamination")


def cohesion_findings(cohesion: DataFrame, least: int = 3, convergence: float = 0.5, jaccard: float = 0.1) -> DataFrame:
    """Clusters of `least` or more members under both floors; cohesion is that of merging.title_cohesion."""
    return _finding(cohesion.where((F.col("members") >= least) & (F.col("convergence") < convergence) & (F.col("mean_jaccard") < jaccard)), "RF-5", "ACCEPTABLE", "cohesion")


def junk_findings(cards: DataFrame, weights: dict[str, int], drop_from: int = 3) -> DataFrame:
    """Cards whose title holds phrases of evergreen pages weighing `drop_from` or more."""
    low = F.lower(F.coalesce("title", F.lit("")))
    score = sum((F.when(F.contains(low, F.lit(p)), w).otherwise(0) for p, w in weights.items()), F.lit(0))
    return _finding(cards.where(score >= drop_from), "RF-7", "WRONG", "junk")


def categories_of(articles: DataFrame, lexicon: DataFrame, share: float = 0.6, title_weight: float = 2.0) -> DataFrame:
    """(article_id, category, score, place): the best category of each article and those of at least `share` of its score.

    `articles` (article_id, title_words, body_words: arrays), `lexicon` (word, category, weight). A word counts for its weight
    a hundred words of the text, and `title_weight` times its weight in the title.
    """
    n = F.greatest(F.size("body_words") / 100, F.lit(1.0))
    body = articles.select("article_id", n.alias("per"), F.explode("body_words").alias("word")).groupBy("article_id", "per", "word").agg(F.count("*").alias("n")).select("article_id", "word", (F.col("n") / F.col("per")).alias("v"))
    title = articles.select("article_id", F.explode("title_words").alias("word"), F.lit(title_weight).alias("v"))
    scored = body.unionByName(title).join(F.broadcast(lexicon), "word").groupBy("article_id", "category").agg(F.round(F.sum(F.col("v") * F.col("weight")), 6).alias("score"))
    best = scored.groupBy("article_id").agg(F.max("score").alias("best"))
    kept = scored.join(best, "article_id").where(F.col("score") >= share * F.col("best")).drop("best")
    return best_per_key(kept, ["article_id"], [F.desc("score"), F.col("category")], 3)


def geographic_impact(texts: DataFrame, places: DataFrame, keywords: list[str]) -> DataFrame:
    """(cluster_id, impact): the weights of places named, x 10 and 60 at most, and keywords x 5, 40 at most.

    `texts` (cluster_id, text), `places` (place, weight), single words in lower case; each place counts once a cluster.
    """
    words = texts.select("cluster_id", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("place")).join(F.broadcast(places.select("place").distinct()), "place", "left_semi").distinct()
    named = words.join(F.broadcast(places), "place").groupBy("cluster_id").agg(F.sum("weight").alias("weight"))
    low = F.lower("text")
    key = texts.groupBy("cluster_id").agg(*(F.max(F.contains(low, F.lit(k)).cast("int")).alias(f"k{i}") for i, k in enumerate(keywords)))
    hits = sum((F.col(f"k{i}") for i in range(len(keywords))), F.lit(0))
    impact = F.least(F.coalesce("weight", F.lit(0)) * 10.0, F.lit(60.0)) + F.least(hits * 5.0, F.lit(40.0))
    return key.join(named, "cluster_id", "left").select("cluster_id", F.coalesce(impact, F.lit(0.0)).alias("impact"))
