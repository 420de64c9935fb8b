"""Article axes from lexicons and densities, and event signals from texts.

Lexicons are small tables given by the caller and broadcast; scores follow from joins on words, so that no
Python code sees a text. Axes that would need entity recognition or a sentiment model are lexicon approximations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.functions.text import hits, occurrences, total, word_count, words


def lexicon_lean(articles: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(article_id, lean_text, distinct): 50 moved towards the heavier side by a logistic of the distinct hits.

    `lexicon` (word, side, weight): side is left or right. Only single words; 50 without a hit.
    """
    found = articles.select("article_id", F.explode(words(F.col("body"))).alias("word")).groupBy("article_id", "word").agg(F.count("*").alias("n")).join(F.broadcast(lexicon), "word")
    by = found.groupBy("article_id").agg(
        F.sum(F.when(F.col("side") == "right", F.col("n") * F.col("weight")).otherwise(0.0)).alias("right"), F.sum(F.col("n") * F.col("weight")).alias("total"), F.count("*").alias("distinct"))
    pull = 1 / (1 + F.exp(-0.7 * (F.col("distinct") - 4.0)))
    by = by.withColumn("lean_text", 50 + (F.col("right") / F.col("total") - 0.5) * pull * 100)
    return articles.select("article_id").join(by, "article_id", "left").select("article_id", F.round(F.coalesce("lean_text", F.lit(50.0)), 4).alias("lean_text"), F.coalesce("distinct", F.lit(0)).cast("long").alias("distinct"))


def framing_shift(text: Column, phrases: dict[str, float]) -> Column:
    """Sum of the phrases' directions by occurrence, times 1.5, between -15 and 15."""
    shift = sum((occurrences(text, p) * w for p, w in phrases.items()), F.lit(0.0))
    return F.greatest(F.lit(-15.0), F.least(F.lit(15.0), shift * 1.5))


def anchored_lean(baseline: Column, text_lean: Column, n_words: Column, most: float = 10.0) -> Column:
    """The outlet's baseline moved by the text's lean, by at most `most`, in full from 150 words on."""
    move = F.greatest(F.lit(-most), F.least(F.lit(most), text_lean - 50))
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), baseline + move * F.least(F.lit(1.0), n_words / 150))))


def opinion_blend(parts: dict[str, Column], metadata: Column) -> Column:
    """Weighted opinion score; a publisher's own marking sets a floor of 70, 45 or 35."""
    # The weights of the sub-scores.
    weights = {"pronoun": 0.12, "subjectivity": 0.18, "modal": 0.12, "hedging": 0.06, "attribution": 0.15, "metadata": 0.12, "value_judgment": 0.06, "absolutist": 0.19}
    total = sum((parts.get(n, metadata if n == "metadata" else F.lit(0.0)) * w for n, w in weights.items()), F.lit(0.0))
    floor = F.when(metadata >= 90, 70.0).when(metadata >= 50, 45.0).when(metadata >= 30, 35.0).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.greatest(total, floor)))


def rigor_blend(parts: dict[str, Column], references: Column, vague: Column) -> Column:
    """Weighted rigor score with a bonus for references (8 at most) and 3 points off for each vague phrase (15 at most)."""
    # The weights of the sub-scores.
    weights = {"named_source": 0.22, "organisation": 0.24, "data": 0.27, "quotes": 0.17, "specificity": 0.10}
    total = sum((parts.get(n, F.lit(0.0)) * w for n, w in weights.items()), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), total + F.least(references * 0.05, F.lit(8.0)) - F.least(F.lit(15.0), vague * 3.0)))


def article_confidence(n_words: Column, n_chars: Column, *axes: Column) -> Column:
    """How far a score can be trusted: length in words and characters, and how far axes are from their defaults."""
    distance = sum((F.abs(a - 50) for a in axes), F.lit(0.0)) / (50 * max(1, len(axes)))
    value = 0.4 * F.least(F.lit(1.0), n_words / 800) + 0.3 * F.least(F.lit(1.0), n_chars / 1600) + 0.3 * distance
    return F.when(n_words < 150, F.greatest(F.lit(0.15), n_words / 500)).otherwise(F.round(value, 4))


def disaster_severity(text: Column, nouns: list[str], casualty: list[str], pattern: str = r"(\d[\d,]{0,6}) (?:people )?(?:killed|dead|died)") -> Column:
    """0 to 100: a hazard with a casualty word, or a toll of 10 or more; 40, 15 for the noun, 15 log10 of the toll."""
    low = F.lower(text)
    noun, hurt = hits(low, nouns) > 0, hits(low, casualty) > 0
    tolls = F.transform(F.regexp_extract_all(low, F.lit(pattern), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("")).cast("double"))
    toll = F.coalesce(F.array_max(tolls), F.lit(0.0))
    severity = 40 + F.when(noun, 15.0).otherwise(0.0) + F.when(toll > 0, F.least(F.lit(45.0), 15 * F.log10(toll + 1))).otherwise(0.0)
    return F.when((noun & hurt) | (toll >= 10), F.least(F.lit(100.0), severity)).otherwise(0.0)


def event_signals(members: DataFrame, verbs: list[str], weighty: list[str], hedged: list[str], tier1: list[str], tier2: list[str], first: int = 10) -> DataFrame:
    """consequentiality and authority of each cluster from the titles of its first ten articles.

    `members` (cluster_id, article_id, title). Verb breadth x 20 and hits x 5 (60 : 40), at least 70 with a weighty phrase,
    x 0.7 if a title deliberates; authority is 80 + 10 for each further body of tier 1, 40 + 10 for tier 2.
    """
    from newsloom.operators.selection import best_per_key

    facts = members.select("cluster_id", "article_id", *_event_facts(F.col("title"), verbs, weighty, hedged, tier1, tier2))
    by = best_per_key(facts, ["cluster_id"], [F.col("article_id")], first).groupBy("cluster_id").agg(*_event_sums(F.lit(True)))
    return by.select("cluster_id", *_event_scores())


def title_facts(title: Column, verbs: list[str], weighty: list[str], hedged: list[str], tier1: list[str], tier2: list[str], places: list[str], keywords: list[str]) -> Column:
    """What `title_signals` needs of a title, as a struct: where many articles have one title, get it before they are joined."""
    low = F.lower(F.coalesce(title, F.lit("")))
    named = F.filter(F.array(*map(F.lit, places)), lambda p: F.array_contains(F.split(low, "[^a-z]+"), p))
    held = F.array(*(F.contains(low, F.lit(k)).cast("int") for k in keywords))
    return F.struct(*_event_facts(title, verbs, weighty, hedged, tier1, tier2), named.alias("places"), held.alias("keys"))


def title_signals(members: DataFrame, places: dict[str, int], keywords: list[str], first: int = 10) -> DataFrame:
    """`event_signals` of the first ten titles and, as geographic, `checks.geographic_impact` of all titles, with the short lists of `title_facts`.

    `members` (cluster_id, article_id, facts; null facts for no title). Facts of titles, not titles, are dealt by cluster, once for both.
    """
    placed = members.select("cluster_id", "article_id", "facts.*").withColumn("place", F.row_number().over(Window.partitionBy("cluster_id").orderBy("article_id")))
    keys = [F.coalesce(F.max(F.get("keys", F.lit(i))), F.lit(0)).alias(f"k{i}") for i in range(len(keywords))]
    by = placed.groupBy("cluster_id").agg(*_event_sums(F.col("place") <= first), F.array_distinct(F.flatten(F.collect_list(F.when(F.size("places") > 0, F.col("places"))))).alias("places"), *keys)
    weight = sum((F.when(F.array_contains("places", p), w).otherwise(0) for p, w in places.items()), F.lit(0))
    impact = F.least(weight * 10.0, F.lit(60.0)) + F.least(sum((F.col(f"k{i}") for i in range(len(keywords))), F.lit(0)) * 5.0, F.lit(40.0))
    return by.select("cluster_id", *_event_scores(), impact.alias("geographic"))


def _event_facts(title: Column, verbs: list[str], weighty: list[str], hedged: list[str], tier1: list[str], tier2: list[str]) -> list[Column]:
    """What `_event_sums` needs of a title: the distinct verbs, and numbers."""
    title = F.lower(F.coalesce(title, F.lit("")))
    tokens = words(title)
    seen = lambda terms: F.filter(F.array(*map(F.lit, terms)), lambda t: F.array_contains(tokens, t))
    count = lambda terms: sum((F.size(tokens) - F.size(F.array_remove(tokens, t)) for t in terms), F.lit(0))
    return [seen(verbs).alias("verbs"), count(verbs).alias("n"), hits(title, weighty).alias("weighty"), hits(title, hedged).alias("hedged"), F.size(seen(tier1)).alias("t1"), F.size(seen(tier2)).alias("t2")]


def _event_sums(inside: Column) -> list[Column]:
    given = lambda name: F.when(inside, F.col(name))
    verbs = F.array_distinct(F.flatten(F.collect_list(F.when(inside & (F.size("verbs") > 0), F.col("verbs")))))
    return [verbs.alias("verbs"), *(F.coalesce(F.sum(given(c)), F.lit(0)).alias(c) for c in ("n", "t1", "t2")), *(F.max(given(c)).alias(c) for c in ("weighty", "hedged"))]


def _event_scores() -> list[Column]:
    raw = 0.6 * F.least(F.lit(100.0), F.size("verbs") * 20.0) + 0.4 * F.least(F.lit(100.0), F.col("n") * 5.0)
    raw = F.when(F.col("weighty") > 0, F.greatest(raw, F.lit(70.0))).otherwise(raw)
    one = F.when(F.col("t1") > 0, F.least(F.lit(100.0), 80 + (F.col("t1") - 1) * 10.0)).otherwise(0.0)
    two = F.when(F.col("t2") > 0, F.least(F.lit(70.0), 40 + (F.col("t2") - 1) * 10.0)).otherwise(0.0)
    both = F.when((one > 0) & (two > 0), F.least(F.lit(100.0), one + two * 0.2)).otherwise(F.greatest(one, two))
    return [F.round(F.when(F.col("hedged") > 0, raw * 0.7).otherwise(raw), 4).alias("consequentiality"), F.round(both, 4).alias("authority")]


def newsworthiness(title: Column, body: Column, weights: dict[str, int], markers: list[str]) -> Column:
    """Sum of the junk phrases' weights in the title; dropped from 3 on, or from 6 with a news marker in the text."""
    return sum((F.when(F.contains(F.lower(title), F.lit(p)), w).otherwise(0) for p, w in weights.items()), F.lit(0)) - F.when(hits(body, markers) > 0, 3).otherwise(0)


def claims(articles: DataFrame, least: int = 8, most: int = 60) -> DataFrame:
    """(article_id, place, sentence) of sentences of 8 to 60 words that hold a number or an attribution."""
    sentences = F.split(F.regexp_replace("body", r"([.!?])[ \n\t]+", "$1\n"), "\n")
    rows = articles.select("article_id", F.posexplode(sentences).alias("place", "sentence"))
    n = word_count(F.col("sentence"))
    return rows.where(n.between(least, most) & (F.col("sentence").rlike("[0-9]") | (total(F.lower("sentence"), ["said", "according to"]) > 0)))
