"""Editorial selections, feed passes, retention and small rollups over stories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.operators.selection import best_per_key


def split_by_opinion(articles: DataFrame, score: str = "opinion", above: float = 50) -> tuple[DataFrame, DataFrame]:
    """Reporting and opinion; articles without a score are reporting."""
    is_opinion = F.coalesce(F.col(score) > above, F.lit(False))
    return articles.where(~is_opinion), articles.where(is_opinion)


def opinion_gate(clusters: DataFrame, title_pattern: str, factor: float = 0.70) -> DataFrame:
    """rank times `factor`, to two digits, for clusters of opinion by content_type or title."""
    is_opinion = F.coalesce(F.lower("content_type") == "opinion", F.lit(False)) | F.coalesce(F.col("title").rlike(title_pattern), F.lit(False))
    return clusters.withColumn("is_opinion", is_opinion).withColumn("rank", F.when(is_opinion, F.round(F.col("rank") * factor, 2)).otherwise(F.round("rank", 2)))


def pick_origin(members: DataFrame, group: str, wire_tiers: list[str], canonical: list[str]) -> DataFrame:
    """The origin of each group: wire tiers, then canonical slugs, then the earliest (no time last), then the least id."""
    order = [~F.coalesce(F.lower("tier").isin(wire_tiers), F.lit(False)), ~F.coalesce(F.lower("slug").isin(canonical), F.lit(False)), F.asc_nulls_last("published_at"), F.col("article_id")]
    return best_per_key(members, [group], order).drop("place")


def articles_in_first_cluster(links: DataFrame, articles: DataFrame) -> DataFrame:
    """Each linked article in the first cluster that it has (the least id), with its columns where the article is known."""
    return links.groupBy("article_id").agg(F.min("cluster_id").alias("cluster_id")).join(articles, "article_id", "left")


def rerank_gather(clusters: DataFrame, links: DataFrame | None, articles: DataFrame, as_of: str, hours: int = 48) -> DataFrame:
    """Articles of the last `hours` with the clusters that they belong to, by `links` or, without these, by their own cluster_id."""
    now = F.lit(as_of).cast("timestamp_ntz")
    fresh = articles.where((F.col("published_at") >= now - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("published_at") <= now))
    linked = fresh if links is None else fresh.join(links, "article_id")
    return linked.join(clusters, "cluster_id")


def category_junction(items: DataFrame, key: str, labels: str, categories: DataFrame) -> DataFrame:
    """Distinct (key, category_id) of the labels (an array) that `categories` (name, category_id) knows."""
    return items.select(key, F.explode(labels).alias("name")).distinct().join(categories, "name").select(key, "category_id").distinct()


def common_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys of each side, and of both."""
    left, right = a.select(key).distinct().withColumn("a", F.lit(1)), b.select(key).distinct().withColumn("b", F.lit(1))
    return left.join(right, key, "full").agg(F.count("a").alias("of_a"), F.count("b").alias("of_b"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("of_both"))


def archive_split(rows: DataFrame, time: str, as_of: str, days: int = 2) -> tuple[DataFrame, DataFrame]:
    """(archived, kept): rows older than `days` at `as_of`, and the others, those without a time among them."""
    old = F.coalesce(F.col(time) < F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS"), F.lit(False))
    return rows.where(old), rows.where(~old)


def same_day_purge(prior: DataFrame, displayable: DataFrame, time: str, as_of: str, hours: int = 12, least: int = 30) -> DataFrame:
    """`prior` without the clusters of the last `hours`, but only if this run has at least `least` displayable clusters."""
    enough = F.broadcast(displayable.agg((F.count("*") >= least).alias("enough")))  # one row
    now = F.lit(as_of).cast("timestamp_ntz")
    recent = F.coalesce((F.col(time) >= now - F.expr(f"INTERVAL {hours} HOURS")) & (F.col(time) <= now), F.lit(False))
    return prior.join(enough).where(~(F.col("enough") & recent)).drop("enough")


def latest_with_fallback(runs: DataFrame, good: Column, order: list[Column]) -> DataFrame:
    """The latest good run, or the latest of all if none is good."""
    return runs.orderBy(F.when(good, 0).otherwise(1), *order).limit(1)


def lean_diversity(members: DataFrame) -> DataFrame:
    """0 to 100 by the spread of leans of clusters with three sources and three leans."""
    # Bands of the spread.
    by = members.groupBy("cluster_id").agg((F.max("lean") - F.min("lean")).alias("spread"), F.count("lean").alias("leans"), F.countDistinct("source_id").alias("sources"))
    s = F.col("spread")
    score = F.when(s > 50, 100.0).when(s > 30, 60.0 + (s - 30) * 2.0).when(s > 15, 30.0 + (s - 15) * 2.0).otherwise(0.0)
    return by.select("cluster_id", F.when((F.col("leans") >= 3) & (F.col("sources") >= 3), score).otherwise(0.0).alias("lean_diversity"))


def top_sources(members: DataFrame, tiers: list[str], most: int = 10) -> DataFrame:
    """Up to `most` outlets of each cluster, by tier in the order given, then slug."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, tiers)), F.col("tier")), F.lit(0))
    own = members.select("cluster_id", "source_id", "slug", "tier").distinct()
    return best_per_key(own, ["cluster_id"], [F.when(rank == 0, len(tiers) + 1).otherwise(rank), F.col("slug")], most)


def timeline(events: DataFrame, thread: str, time: str, order: list[Column], per_day: int = 2) -> DataFrame:
    """At most `per_day` events a day of each thread."""
    return best_per_key(events.withColumn("day", F.to_date(time)), [thread, "day"], order, per_day)


def dynamic_event_cap(clusters: DataFrame, tokens: str, scan: int = 50, least: int = 3, keep: int = 2, decay: float = 0.72) -> DataFrame:
    """rank of the best `scan` clusters, lowered where a token (of the array `tokens`) stands in `least` or more of them.

    Of a token's clusters the `keep` most-sourced ones stay; others fall to `decay` times the lower of those, if that is
    less. A cluster takes the least of what its tokens ask for, all from the ranks before the pass: unlike a walk over
    the tokens one by one, that does not depend on their order.
    """
    top = clusters.orderBy(F.desc("rank"), "cluster_id").limit(scan)
    each = top.select("cluster_id", "source_count", "rank", F.explode(F.array_distinct(tokens)).alias("token"))
    place = F.row_number().over(Window.partitionBy("token").orderBy(F.desc("source_count"), F.desc("rank"), "cluster_id"))
    each = each.withColumn("place", place).withColumn("n", F.count("*").over(Window.partitionBy("token"))).where(F.col("n") >= least)
    floor = F.min(F.when(F.col("place") <= keep, F.col("rank"))).over(Window.partitionBy("token"))
    asked = each.withColumn("floor", floor).where(F.col("place") > keep).groupBy("cluster_id").agg(F.min(F.round(F.col("floor") * decay, 2)).alias("asked"))
    return clusters.join(F.broadcast(asked), "cluster_id", "left").withColumn("rank", F.least("rank", F.coalesce("asked", "rank"))).drop("asked")


def mid_feed_cap(clusters: DataFrame, lead: int = 10, end: int = 50, cap: int = 12) -> DataFrame:
    """Positions 1 to `end` of the feed: the best `lead` as they are, then the best whose category has fewer than `cap` before.

    `clusters` (cluster_id, category, rank). A category's first `cap` rows are what a walk down the ranks would take.
    """
    order = [F.desc("rank"), F.col("cluster_id")]
    # bounded: only the first of each category can be in the feed, besides the best `lead`
    first = best_per_key(clusters, ["category"], order, max(cap, lead)).withColumnRenamed("place", "of_category")
    rank = F.row_number().over(Window.orderBy(*order))
    placed = first.withColumn("overall", rank).where((F.col("overall") <= lead) | (F.col("of_category") <= cap))
    placed = placed.withColumn("position", F.row_number().over(Window.orderBy("overall")))
    return placed.where(F.col("position") <= end).drop("of_category", "overall")


def lead_breadth(feed: DataFrame, share: float = 0.45, scan: int = 5, among: int = 10) -> DataFrame:
    """The feed (position, source_count, ...) with the first of its `scan` best on top that has `share` of the most sources
    among the first `among`; feeds of fewer than `among` stay as they are."""
    head = Window.orderBy("position")  # a feed has at most 50 rows
    need = F.max(F.when(F.col("position") <= among, F.col("source_count"))).over(Window.partitionBy()) * share
    wide = (F.col("position") <= scan) & (F.col("source_count") >= F.col("need")) & (F.count("*").over(Window.partitionBy()) >= among)
    marked = feed.withColumn("need", need).withColumn("wide", F.when(wide, F.col("position")))
    lead = F.coalesce(F.min("wide").over(Window.partitionBy()), F.lit(1))
    return marked.withColumn("key", F.when(F.col("position") == lead, 0).otherwise(F.col("position"))).withColumn("position", F.row_number().over(head.orderBy("key"))).drop("need", "wide", "key")


def threads_of(threads: DataFrame, thread: str, members: str) -> DataFrame:
    """Lists of members by thread turned into sorted threads by member."""
    return threads.select(thread, F.explode(members).alias("member")).groupBy("member").agg(F.array_sort(F.collect_set(thread)).alias("threads"))


def relaxing_pick(clusters: DataFrame, good: Column, order: list[Column], floors: tuple[int, ...] = (4, 2)) -> DataFrame:
    """The best good cluster with the first of the `floors` of sources that any reaches."""
    step = F.lit(None).cast("int")
    for k, least in reversed(list(enumerate(floors))):
        step = F.when(F.col("source_count") >= least, k).otherwise(step)
    return clusters.where(good).withColumn("step", step).where("step is not null").orderBy("step", *order).limit(1).drop("step")


def live_clusters(clusters: DataFrame, categories: list[str], as_of: str, matches: Column, days: int = 21, best: int = 150, first: int = 6) -> DataFrame:
    """Of the `best` ranked clusters of the categories in the last `days`, the `first` that match."""
    recent = clusters.where(F.col("category").isin(categories) & (F.col("created_at") >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS")))
    return recent.orderBy(F.desc("rank"), "cluster_id").limit(best).where(matches).orderBy(F.desc("rank"), "cluster_id").limit(first)


def dashboard(members: DataFrame, as_of: str) -> DataFrame:
    """One row: articles of the last 24 hours, mean and population deviation of the lean, seven equal bins of it."""
    now, x = F.lit(as_of).cast("timestamp_ntz"), F.col("lean")
    day = (F.col("published_at") >= now - F.expr("INTERVAL 24 HOURS")) & (F.col("published_at") <= now)
    bins = [F.count_if(F.least(F.floor(x * 7 / 100), F.lit(6)) == k).alias(f"bin_{k}") for k in range(7)]
    return members.agg(F.count_if(day).alias("last_day"), F.count("*").alias("articles"), F.round(F.avg(x), 4).alias("mean_lean"), F.round(F.stddev_pop(x), 4).alias("deviation"), *bins)


def continuing_stories(stories: DataFrame, known: DataFrame) -> DataFrame:
    """Stories that go on a known one: of the same id, or sharing a keyword. Both: (story_id, keywords)."""
    by_id = stories.join(known.select("story_id").distinct(), "story_id", "left_semi").select("story_id")
    words = known.select(F.explode("keywords").alias("word")).distinct()
    by_word = stories.select("story_id", F.explode("keywords").alias("word")).join(words, "word", "left_semi").select("story_id")
    return stories.join(by_id.union(by_word).distinct(), "story_id", "left_semi")


def ratio_by_status(claims: DataFrame, group: str, status: str, agreed: list[str]) -> DataFrame:
    """Claims of each group, those of agreed status, and their share to three digits."""
    by = claims.groupBy(group).agg(F.count("*").alias("claims"), F.count_if(F.col(status).isin(agreed)).alias("agreed"))
    return by.withColumn("ratio", F.round(F.col("agreed") / F.col("claims"), 3))


def domestic_signal(title: Column, body: Column, terms: list[str]) -> Column:
    """Whether title or text holds one of the terms as whole words, in any case."""
    whole = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))))
    return whole.rlike(r"(^|[^a-z0-9])(" + "|".join(terms) + r")([^a-z0-9]|$)")
