"""Framing of articles: charged wording, one-sided sourcing, and what an article leaves out that the rest of its story tells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import total, word_count
from newsloom.operators.lean import Terms, term_hits

#: Citing phrases of either side, this library's own; callers give theirs.
FOR = ["supporters say", "backers of", "proponents", "in favour of", "in favor of", "hailed"]
AGAINST = ["critics say", "opponents of", "detractors", "condemned", "denounced", "objected to"]

# Weights of the parts (calm wording, and with emphasis over 60), and the floor of each tier for short texts.
CALM = {"connotation": 0.25, "emphasis": 0.35, "omission": 0.15, "headline": 0.25}
CHARGED = {"connotation": 0.15, "emphasis": 0.45, "omission": 0.15, "headline": 0.25}
FLOORS = {"us_major": 18.0, "international": 20.0, "independent": 25.0}
OTHER_FLOOR = 20.0


def emphasis(hits: Column, terms: Terms, n_words: Column) -> Column:
    """0 to 100: 15 points for each unit of weight of charged terms a hundred words; reported speech counts half (see `lean.term_hits`)."""
    weights = F.array(*(F.lit(float(w)) for _, _, w in terms.rows))
    zipped = F.arrays_zip(hits["number"], hits["n"], hits["reported"])
    weight = F.aggregate(zipped, F.lit(0.0), lambda acc, x: acc + F.get(weights, x["number"]) * (x["n"] - 0.5 * x["reported"]))
    return F.least(F.lit(100.0), weight / F.greatest(n_words / 100, F.lit(1.0)) * 15)


def one_sided(low: Column, pro: list[str], anti: list[str]) -> Column:
    """10 without a citing phrase; 15 a phrase if only one side is cited, 100 at most; else 60 times the lack of balance."""
    p, a = total(low, pro), total(low, anti)
    return F.when(p + a == 0, 10.0).when((p == 0) | (a == 0), F.least(F.lit(100.0), (p + a) * 15.0)).otherwise((1 - F.least(p, a) / F.greatest(p, a)) * 60)


def omissions(members: DataFrame, entities: str) -> DataFrame:
    """(cluster_id, article_id, n_own, n_others, n_common): of the entities that a story's other articles name, how many an article names.

    `members` (cluster_id, article_id, array `entities`), an article once a cluster. What the others name is what the story names less
    what the article alone does, so counts of (cluster, entity) suffice and no article meets another. Counts are taken before the
    shuffle; only entities of two articles and more are joined back. Null and empty arrays count no entity.
    """
    keys = ["cluster_id", "article_id"]
    own = members.select(*keys, F.explode(F.array_distinct(F.filter(entities, lambda e: e.isNotNull()))).alias("entity"))
    counts = own.groupBy("cluster_id", "entity").agg(F.count("*").alias("n"))
    shared = own.join(counts.where("n > 1").select("cluster_id", "entity"), ["cluster_id", "entity"]).groupBy(*keys).agg(F.count("*").alias("n_common"))
    sizes = counts.groupBy("cluster_id").agg(F.count("*").alias("n_named"))
    base = members.select(*keys, F.coalesce(F.size(F.array_distinct(F.filter(entities, lambda e: e.isNotNull()))), F.lit(0)).cast("long").alias("n_own"))
    rows = base.join(shared, keys, "left").join(sizes, "cluster_id", "left").withColumn("n_common", F.coalesce("n_common", F.lit(0)))
    return rows.select(*keys, "n_own", (F.coalesce("n_named", F.lit(0)) - (F.col("n_own") - F.col("n_common"))).alias("n_others"), "n_common")


def framing_scores(articles: DataFrame, charged: Terms, members: DataFrame | None = None, pro: list[str] = FOR, anti: list[str] = AGAINST) -> DataFrame:
    """(article_id, emphasis, sourcing, omission, framing).

    `articles` (article_id, text, tier; columns connotation and headline are taken where present, else 0: they need a sentiment model).
    `members` (cluster_id, article_id, entities): an article of a story of two articles and more has up to 30 points of omission for the
    entities of the others that it does not name, if both name any; its story is the one of the least cluster_id. Texts under 500 words are lifted towards their tier's
    floor, never lowered. Empty texts score 15.
    """
    n = word_count(F.col("text"))
    part = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in articles.columns else F.lit(0.0)
    rows = articles.select("article_id", F.lower(F.coalesce("text", F.lit(""))).alias("low"), "tier", n.alias("n_words"), term_hits(F.col("text"), charged).alias("hits"), part("connotation").alias("connotation"), part("headline").alias("headline"))
    rows = rows.select("article_id", "tier", "n_words", "connotation", "headline", F.round(emphasis(F.col("hits"), charged, F.col("n_words")), 6).alias("emphasis"), one_sided(F.col("low"), pro, anti).alias("sourcing"))
    if members is None:
        rows = rows.withColumn("missed", F.lit(0.0))
    else:
        known = omissions(members, "entities").groupBy("article_id").agg(F.min_by(F.struct("n_own", "n_others", "n_common"), "cluster_id").alias("o"))
        missed = F.when((F.col("o.n_own") > 0) & (F.col("o.n_others") > 0), (1 - F.col("o.n_common") / F.col("o.n_others")) * 30)
        rows = rows.join(known, "article_id", "left").withColumn("missed", F.coalesce(missed, F.lit(0.0)))
    rows = rows.withColumn("omission", F.round(F.least(F.lit(100.0), F.col("sourcing") + F.col("missed")), 6))
    blend = lambda w: sum((F.col(c) * x for c, x in w.items()), F.lit(0.0))
    raw = F.least(F.lit(100.0), F.when(F.col("emphasis") > 60, blend(CHARGED)).otherwise(blend(CALM)))
    floor = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in FLOORS.items() for x in pair)), F.lower(F.coalesce("tier", F.lit("")))), F.lit(OTHER_FLOOR))
    share = F.least(F.lit(1.0), F.col("n_words") / 500)
    rows = rows.withColumn("raw", raw).withColumn("lifted", F.greatest("raw", share * F.col("raw") + (1 - share) * floor))
    return rows.select("article_id", "emphasis", "sourcing", "omission", F.when(F.col("n_words") == 0, 15).otherwise(F.bround(F.round("lifted", 6)).cast("int")).alias("framing"))
