"""Registered queries of the desk: selections, merges, checks and rollups, each over whole tables with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.operators import checks, desk, merging, stories
from newsloom.plans import story_tables as S
from newsloom.plans.queries import query
from newsloom.plans.story_tables import AS_OF, table

_WORDS = "list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda w: w <> '')"


def _terms(text):
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _cards(spark, d):
    """Documents as feed cards: the first line of a document is the title, its text the summary, its length the rank."""
    a = S.articles(spark, d)
    kind = F.when(F.col("article_id") % 9 == 0, "opinion").otherwise("reporting")
    return a.select(F.col("article_id").alias("cluster_id"), "title", F.col("body").alias("summary"), kind.alias("content_type"), (F.length("body") % 1000 / 10).alias("rank"), (F.col("article_id") % 17 + 1).alias("source_count"), _terms(F.col("title")).alias("stems"))


_CARDS = f"""cards AS (SELECT article_id AS cluster_id, title, body AS summary, CASE WHEN article_id % 9 = 0 THEN 'opinion' ELSE 'reporting' END AS content_type,
  length(body) % 1000 / 10 AS rank, article_id % 17 + 1 AS source_count, {_WORDS.format('title')} AS stems FROM articles)"""


@query("SELECT opinion > 50 AS is_opinion, count(*) AS n, sum(rigor)::BIGINT AS rigor FROM members GROUP BY 1", "members")
def opinion_split(spark, d):
    """Articles of reporting and of opinion."""
    news, views = desk.split_by_opinion(S.members(spark, d))
    both = news.withColumn("is_opinion", F.lit(False)).unionByName(views.withColumn("is_opinion", F.lit(True)))
    return both.groupBy("is_opinion").agg(F.count("*").alias("n"), F.sum("rigor").alias("rigor"))


@query(f""", {_CARDS} SELECT cluster_id, round(CASE WHEN content_type = 'opinion' OR regexp_matches(title, '(?i)^(opinion|comment)[ ]*[|:]') THEN rank * 0.7 ELSE rank END, 2) AS rank FROM cards""", "articles")
def opinion_gate(spark, d):
    """Cards with the rank of opinion lowered."""
    return desk.opinion_gate(_cards(spark, d), r"(?i)^(opinion|comment)[ ]*[|:]").select("cluster_id", "rank")


@query("""SELECT cluster_id, article_id, slug FROM (SELECT cluster_id, article_id, slug, row_number() OVER (PARTITION BY cluster_id
  ORDER BY (tier <> 'independent'), (slug <> 'Supplier#000000003'), published_at, article_id) AS r FROM members JOIN sources USING (source_id)) WHERE r = 1""", "members", "sources")
def wire_origins(spark, d):
    """The origin article of each cluster, with independents for wires."""
    m = S.members(spark, d).join(F.broadcast(S.sources(spark, d)), "source_id")
    return desk.pick_origin(m, "cluster_id", ["independent"], ["supplier#000000003"]).select("cluster_id", "article_id", "slug")


@query("""SELECT l.cluster_id, count(*) AS n, count(a.article_id) AS known, coalesce(sum(length(a.body)), 0)::BIGINT AS chars
  FROM (SELECT l_partkey AS article_id, min(l_orderkey) AS cluster_id FROM lineitem GROUP BY 1) l LEFT JOIN articles a USING (article_id) GROUP BY 1""", "articles")
def members_by_cluster(spark, d):
    """Documents in the first order that has their number, by order."""
    links = table(spark, d, "lineitem").select(F.col("l_partkey").alias("article_id"), F.col("l_orderkey").alias("cluster_id"))
    a = S.articles(spark, d).select("article_id", F.lit(True).alias("here"), F.length("body").alias("chars"))
    return desk.articles_in_first_cluster(links, a).groupBy("cluster_id").agg(F.count("*").alias("n"), F.count("here").alias("known"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"))


@query(f"""SELECT category, count(*) AS articles, count(DISTINCT cluster_id) AS clusters, sum(lean)::BIGINT AS lean FROM members JOIN clusters USING (cluster_id)
  WHERE published_at BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 4800 HOURS AND TIMESTAMP '{AS_OF}' GROUP BY category""", "members", "clusters")
def rerank_gather(spark, d):
    """Articles of the last 200 days with their clusters, by category."""
    # members name their cluster; their article_id repeats beyond 99,999 parts, so links by it would multiply them
    rows = desk.rerank_gather(S.clusters(spark, d), None, S.members(spark, d), AS_OF, 4800)
    return rows.groupBy("category").agg(F.count("*").alias("articles"), F.countDistinct("cluster_id").alias("clusters"), F.sum("lean").alias("lean"))


@query("""SELECT k AS p_partkey, category_id FROM (SELECT DISTINCT p_partkey AS k, unnest(string_split(p_type, ' ')) AS name FROM part)
  JOIN (SELECT name, row_number() OVER (ORDER BY name) AS category_id FROM (SELECT DISTINCT unnest(string_split(p_type, ' ')) AS name FROM part) WHERE name > 'C') USING (name)""")
def category_junction(spark, d):
    """Parts and the categories that their types name."""
    from pyspark.sql.window import Window

    part = table(spark, d, "part")
    names = part.select(F.explode(F.split("p_type", " ")).alias("name")).distinct().where("name > 'C'")
    categories = names.withColumn("category_id", F.row_number().over(Window.orderBy("name")))  # a small vocabulary
    return desk.category_junction(part.withColumn("labels", F.split("p_type", " ")), "p_partkey", "labels", categories)


@query("""SELECT (SELECT count(DISTINCT o_custkey) FROM orders) AS of_a, (SELECT count(DISTINCT user_id) FROM events) AS of_b,
  (SELECT count(*) FROM (SELECT o_custkey FROM orders INTERSECT SELECT user_id FROM events)) AS of_both""")
def common_keys(spark, d):
    """Customers with orders, users with events, and those that are both."""
    return desk.common_keys(table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "events").select(F.col("user_id").alias("k")), "k")


@query(f"SELECT category, count(*) FILTER (WHERE created_at < TIMESTAMP '{AS_OF}' - INTERVAL 1000 DAYS) AS archived, count(*) FILTER (WHERE NOT coalesce(created_at < TIMESTAMP '{AS_OF}' - INTERVAL 1000 DAYS, false)) AS kept FROM clusters GROUP BY category", "clusters")
def archive_then_delete(spark, d):
    """Clusters older than 1000 days go to the archive, the others stay."""
    old, kept = desk.archive_split(S.clusters(spark, d), "created_at", AS_OF, 1000)
    both = old.withColumn("gone", F.lit(1)).unionByName(kept.withColumn("gone", F.lit(0)))
    return both.groupBy("category").agg(F.sum("gone").alias("archived"), F.sum(1 - F.col("gone")).alias("kept"))


@query(f"""SELECT category, count(*) AS n FROM clusters WHERE NOT ((SELECT count(*) FROM clusters WHERE rank > 50) >= 30
  AND created_at BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 12000 HOURS AND TIMESTAMP '{AS_OF}') GROUP BY category""", "clusters")
def same_day_purge(spark, d):
    """Clusters left after a run that has enough to show."""
    c = S.clusters(spark, d)
    return desk.same_day_purge(c, c.where("rank > 50"), "created_at", AS_OF, 12000).groupBy("category").agg(F.count("*").alias("n"))


@query("SELECT cluster_id, created_at FROM clusters ORDER BY CASE WHEN status = 'F' THEN 0 ELSE 1 END, created_at DESC, cluster_id LIMIT 1", "clusters")
def latest_run(spark, d):
    """The latest finished cluster."""
    return desk.latest_with_fallback(S.clusters(spark, d), F.col("status") == "F", [F.desc("created_at"), F.col("cluster_id")]).select("cluster_id", "created_at")


@query("SELECT status, count(*) AS n FROM clusters GROUP BY status", "clusters")
def clusters_by_status(spark, d):
    """Clusters by status."""
    return S.clusters(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT lang, count(*) AS articles, sum(octet_length(encode(text)))::BIGINT AS bytes, min(doc_id) AS first_id FROM documents GROUP BY lang")
def archive_stats(spark, d):
    """Texts and their bytes by language."""
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("articles"), F.sum(F.octet_length("text")).alias("bytes"), F.min("doc_id").alias("first_id"))


@query("SELECT user_id, count(*) AS claims, count(*) FILTER (WHERE event_type IN ('view', 'click')) AS agreed, round(count(*) FILTER (WHERE event_type IN ('view', 'click')) / count(*), 3) AS ratio FROM events GROUP BY user_id")
def consensus_ratio(spark, d):
    """The share of views and clicks of each user."""
    return desk.ratio_by_status(table(spark, d, "events"), "user_id", "event_type", ["view", "click"])


@query("SELECT date_trunc('week', published_at)::TIMESTAMP AS week, round(avg(lean), 4) AS mean_lean, round(stddev_pop(lean), 4) AS deviation, count(*) AS n FROM members GROUP BY 1", "members")
def weekly_bias(spark, d):
    """Mean and population deviation of leans by week."""
    return S.members(spark, d).groupBy(F.date_trunc("week", "published_at").cast("timestamp_ntz").alias("week")).agg(F.round(F.avg("lean"), 4).alias("mean_lean"), F.round(F.stddev_pop("lean"), 4).alias("deviation"), F.count("*").alias("n"))


@query("SELECT cluster_id, min(published_at) AS first_published, array_to_string(list_sort(list(DISTINCT source_id)), ',') AS source_ids FROM members GROUP BY cluster_id", "members")
def first_published(spark, d):
    """The first publication and the outlets of each cluster."""
    return S.members(spark, d).groupBy("cluster_id").agg(F.min("published_at").alias("first_published"), F.array_join(F.array_sort(F.collect_set("source_id")).cast("array<string>"), ",").alias("source_ids"))


@query("""SELECT cluster_id, CASE WHEN count(lean) < 3 OR count(DISTINCT source_id) < 3 THEN 0 WHEN max(lean) - min(lean) > 50 THEN 100 WHEN max(lean) - min(lean) > 30 THEN 60 + (max(lean) - min(lean) - 30) * 2
  WHEN max(lean) - min(lean) > 15 THEN 30 + (max(lean) - min(lean) - 15) * 2 ELSE 0 END::DOUBLE AS lean_diversity FROM members GROUP BY cluster_id""", "members")
def lean_diversity(spark, d):
    """How far the leans of each cluster's outlets reach."""
    return desk.lean_diversity(S.members(spark, d))


@query("""SELECT cluster_id, source_id, place FROM (SELECT cluster_id, source_id, row_number() OVER (PARTITION BY cluster_id ORDER BY CASE tier WHEN 'us_major' THEN 1 WHEN 'international' THEN 2 ELSE 3 END, slug) AS place
  FROM (SELECT DISTINCT cluster_id, source_id, tier, slug FROM members JOIN sources USING (source_id))) WHERE place <= 3""", "members", "sources")
def top_sources(spark, d):
    """The three first outlets of each cluster."""
    m = S.members(spark, d).join(F.broadcast(S.sources(spark, d)), "source_id")
    return desk.top_sources(m, ["us_major", "international"], 3).select("cluster_id", "source_id", "place")


@query("""SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS digest FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type, ts::DATE ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 2 GROUP BY 1""")
def timeline_two_a_day(spark, d):
    """At most two events a day of each user and kind."""
    e = table(spark, d, "events").withColumn("thread", F.struct("user_id", "event_type"))
    return desk.timeline(e, "thread", "ts", [F.desc("value"), F.col("event_id")]).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("digest"))


_SCAN = "top AS (SELECT * FROM cards ORDER BY rank DESC, cluster_id LIMIT 50)"


@query(f""", {_CARDS}, {_SCAN}, each_term AS (SELECT cluster_id, source_count, rank, token, row_number() OVER w AS place, count(*) OVER (PARTITION BY token) AS n
  FROM (SELECT cluster_id, source_count, rank, unnest(list_distinct(stems)) AS token FROM top) WINDOW w AS (PARTITION BY token ORDER BY source_count DESC, rank DESC, cluster_id)),
floors AS (SELECT token, min(rank) AS floor FROM each_term WHERE n >= 3 AND place <= 2 GROUP BY token),
asked AS (SELECT cluster_id, min(round(floor * 0.72::DOUBLE, 2)) AS asked FROM each_term JOIN floors USING (token) WHERE n >= 3 AND place > 2 GROUP BY cluster_id)
SELECT cluster_id, least(rank, coalesce(asked, rank)) AS rank FROM cards LEFT JOIN asked USING (cluster_id)""", "articles")
def dynamic_event_cap(spark, d):
    """Ranks lowered where a title word stands in three or more of the best fifty cards."""
    return desk.dynamic_event_cap(_cards(spark, d), "stems").select("cluster_id", "rank")


@query("""SELECT cluster_id, category, position FROM (SELECT *, row_number() OVER (ORDER BY overall) AS position FROM (SELECT *, row_number() OVER (ORDER BY rank DESC, cluster_id) AS overall,
  row_number() OVER (PARTITION BY category ORDER BY rank DESC, cluster_id) AS of_category FROM clusters) WHERE overall <= 10 OR of_category <= 12) WHERE position <= 50""", "clusters")
def mid_feed_cap(spark, d):
    """The first fifty of the feed, with at most twelve of a category after the lead."""
    return desk.mid_feed_cap(S.clusters(spark, d)).select("cluster_id", "category", "position")


@query(""", feed AS (SELECT cluster_id, source_count, row_number() OVER (ORDER BY rank DESC, cluster_id) AS position FROM (SELECT cluster_id, count(DISTINCT source_id) AS source_count FROM members GROUP BY 1) JOIN clusters USING (cluster_id)),
f AS (SELECT * FROM feed WHERE position <= 50), need AS (SELECT max(source_count) * 0.45 AS need FROM f WHERE position <= 10), lead AS (SELECT min(position) AS lead FROM f, need WHERE position <= 5 AND source_count >= need)
SELECT cluster_id, source_count, row_number() OVER (ORDER BY CASE WHEN position = coalesce(lead, 1) THEN 0 ELSE position END) AS position FROM f, lead""", "members", "clusters")
def lead_breadth(spark, d):
    """The feed's fifty, led by a story of enough sources."""
    from pyspark.sql.window import Window

    by = S.members(spark, d).groupBy("cluster_id").agg(F.countDistinct("source_id").alias("source_count"))
    best = S.clusters(spark, d).join(by, "cluster_id").orderBy(F.desc("rank"), "cluster_id").limit(50)
    feed = best.withColumn("position", F.row_number().over(Window.orderBy(F.desc("rank"), "cluster_id")))
    return desk.lead_breadth(feed.select("cluster_id", "source_count", "position"))


@query("SELECT source_id AS member, array_to_string(list_sort(list(DISTINCT cluster_id)), ',') AS threads FROM members GROUP BY source_id", "members")
def thread_membership(spark, d):
    """The clusters of each outlet, from the outlets of each cluster."""
    lists = S.members(spark, d).groupBy("cluster_id").agg(F.collect_set("source_id").alias("outlets"))
    return desk.threads_of(lists, "cluster_id", "outlets").select("member", F.array_join(F.col("threads").cast("array<string>"), ",").alias("threads"))


_COUNTED = """counted AS (SELECT c.*, source_count FROM clusters c JOIN (SELECT cluster_id, count(DISTINCT source_id) AS source_count FROM members GROUP BY 1) USING (cluster_id))"""


def _counted(spark, d):
    return S.clusters(spark, d).join(S.members(spark, d).groupBy("cluster_id").agg(F.countDistinct("source_id").alias("source_count")), "cluster_id")


@query(f""", {_COUNTED} SELECT cluster_id, source_count, rank FROM counted WHERE category = '1-URGENT' AND source_count >= 2 ORDER BY CASE WHEN source_count >= 4 THEN 0 ELSE 1 END, rank DESC, cluster_id LIMIT 1""", "members", "clusters")
def opinion_cluster(spark, d):
    """The best urgent cluster with four outlets, or with two."""
    return desk.relaxing_pick(_counted(spark, d), F.col("category") == "1-URGENT", [F.desc("rank"), F.col("cluster_id")]).select("cluster_id", "source_count", "rank")


@query(f"""SELECT cluster_id, category, rank FROM (SELECT * FROM clusters WHERE category IN ('1-URGENT', '2-HIGH') AND created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 2100 DAYS ORDER BY rank DESC, cluster_id LIMIT 150)
  WHERE owner_id % 3 = 0 ORDER BY rank DESC, cluster_id LIMIT 6""", "clusters")
def live_clusters(spark, d):
    """The six best recent clusters that match."""
    return desk.live_clusters(S.clusters(spark, d), ["1-URGENT", "2-HIGH"], AS_OF, F.col("owner_id") % 3 == 0, 2100).select("cluster_id", "category", "rank")


@query(f"""SELECT count(*) FILTER (WHERE published_at BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 24 HOURS AND TIMESTAMP '{AS_OF}') AS last_day, count(*) AS articles, round(avg(lean), 4) AS mean_lean, round(stddev_pop(lean), 4) AS deviation,
  {", ".join(f"count(*) FILTER (WHERE least(floor(lean * 7 / 100), 6) = {k}) AS bin_{k}" for k in range(7))} FROM members""", "members")
def dashboard(spark, d):
    """Counts, mean, deviation and bins of the lean."""
    return desk.dashboard(S.members(spark, d), AS_OF)


@query("""SELECT DISTINCT s.user_id AS story_id FROM events s WHERE s.ts >= TIMESTAMP '2024-01-20' AND (EXISTS (SELECT 1 FROM events k WHERE k.ts < TIMESTAMP '2024-01-20' AND k.user_id = s.user_id)
  OR EXISTS (SELECT 1 FROM events k WHERE k.ts < TIMESTAMP '2024-01-20' AND k.event_type = s.event_type AND k.value > 90 AND s.value > 90))""")
def continuing_stories(spark, d):
    """Users whose late events go on earlier ones, by user or by kind of a high value."""
    key = F.when(F.col("value") > 90, F.array("event_type")).otherwise(F.array().cast("array<string>"))
    e = table(spark, d, "events").select(F.col("user_id").alias("story_id"), "ts", key.alias("keywords"))
    cut = F.lit("2024-01-20").cast("timestamp_ntz")
    return desk.continuing_stories(e.where(F.col("ts") >= cut), e.where(F.col("ts") < cut)).select("story_id").distinct()


_DOMESTIC = ["congress", "senate", "texas", "white house", "supreme court"]


@query(rf"""SELECT article_id, regexp_matches(lower(concat_ws(' ', coalesce(title, ''), coalesce(body, ''))), '(^|[^a-z0-9])({'|'.join(_DOMESTIC)})([^a-z0-9]|$)') AS domestic FROM articles""", "articles")
def domestic_signal(spark, d):
    """Whether an article names a domestic institution or state."""
    return S.articles(spark, d).select("article_id", desk.domestic_signal(F.col("title"), F.col("body"), _DOMESTIC).alias("domestic"))


_TERMS = "t AS (SELECT article_id AS story_id, list_distinct({}) AS terms, TIMESTAMP '2024-01-01' + INTERVAL (article_id % 97) HOUR AS at FROM articles)"


@query(f""", {_TERMS.format(_WORDS.format('title'))}, e AS (SELECT story_id, unnest(terms) AS term FROM t), r AS (SELECT term FROM e GROUP BY term HAVING count(*) BETWEEN 2 AND 3),
p AS (SELECT DISTINCT x.story_id AS a, y.story_id AS b FROM e x JOIN e y ON x.term = y.term AND x.story_id < y.story_id JOIN r ON r.term = x.term),
c AS (SELECT a, b, len(list_intersect(x.terms, y.terms)) AS shared, len(x.terms) AS na, len(y.terms) AS nb, x.at AS xa, y.at AS ya FROM p JOIN t x ON x.story_id = a JOIN t y ON y.story_id = b)
SELECT a, b, shared FROM c WHERE shared >= 3 AND shared / (na + nb - shared) >= 0.08 AND abs(epoch_us(xa) - epoch_us(ya)) <= 48 * 3600000000""", "articles")
def merge_edges(spark, d):
    """Articles to be merged: three title words in common, one of them rare, within 48 hours."""
    at = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("article_id") % 97).cast("int"))
    t = S.articles(spark, d).select(F.col("article_id").alias("story_id"), _terms(F.col("title")).alias("terms"), at.alias("at"))
    return merging.merge_edges(t, "terms", "at")


@query(f""", {_CARDS}, top AS (SELECT cluster_id, source_count, rank, list_distinct(stems) AS s, list_filter(list_distinct(stems), lambda t: length(t) >= 6) AS p FROM (SELECT * FROM cards ORDER BY rank DESC, cluster_id LIMIT 50)),
pairs AS (SELECT a.cluster_id AS kept, b.cluster_id AS dropped, len(list_intersect(a.s, b.s)) AS shared, len(list_intersect(a.p, b.p)) AS specific, least(len(a.s), len(b.s)) AS smaller FROM top a JOIN top b
  ON a.cluster_id <> b.cluster_id AND len(a.s) >= 3 AND len(b.s) >= 3 AND (a.source_count > b.source_count OR (a.source_count = b.source_count AND (a.rank > b.rank OR (a.rank = b.rank AND a.cluster_id < b.cluster_id)))))
SELECT kept, dropped, shared FROM pairs WHERE shared >= 4 OR (shared >= 3 AND (specific >= 2 OR shared / smaller >= 0.65))""", "articles")
def near_duplicate_titles(spark, d):
    """Pairs among the best fifty cards that tell the same story."""
    c = _cards(spark, d).withColumn("specific", merging.specific_terms(F.col("stems"), [], 6))
    return merging.near_duplicate_edges(c, "stems", "specific")


@query(f""", {_CARDS}, top AS (SELECT cluster_id, list_distinct(stems) AS s FROM (SELECT * FROM cards ORDER BY rank DESC, cluster_id LIMIT 40))
SELECT a, b, round(similarity, 6) AS similarity FROM (SELECT x.cluster_id AS a, y.cluster_id AS b, len(list_intersect(x.s, y.s)) / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s))) AS similarity FROM top x JOIN top y ON x.cluster_id < y.cluster_id)
WHERE similarity >= 0.3""", "articles")
def story_families(spark, d):
    """Pairs of like titles among the best forty cards."""
    return merging.family_edges(_cards(spark, d), "stems", 40)


_TURNS = f"turns AS (SELECT conv_id AS cluster_id, turn AS article_id, list_distinct({_WORDS.format('text')}) AS s FROM conversations WHERE text IS NOT NULL)"


@query(f""", {_TURNS}, front AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY article_id) AS r FROM turns WHERE len(s) > 0) WHERE r <= 30),
n AS (SELECT cluster_id, count(*) AS members FROM front GROUP BY 1 HAVING count(*) > 1),
j AS (SELECT x.cluster_id, sum(len(list_intersect(x.s, y.s)) / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s)))) AS total FROM front x JOIN front y ON x.cluster_id = y.cluster_id AND x.article_id < y.article_id GROUP BY 1),
h AS (SELECT cluster_id, max(have) AS have FROM (SELECT cluster_id, term, count(*) AS have FROM (SELECT cluster_id, unnest(s) AS term FROM front) GROUP BY 1, 2) GROUP BY 1)
SELECT cluster_id, members, round(coalesce(total, 0) / (members * (members - 1) / 2), 6) AS mean_jaccard, round(have / members, 6) AS convergence FROM n JOIN h USING (cluster_id) LEFT JOIN j USING (cluster_id)""".replace(", turns", "WITH turns", 1))
def cluster_cohesion(spark, d):
    """How alike the turns of each conversation are."""
    return merging.title_cohesion(_turns(spark, d), "s")


def _turns(spark, d):
    c = table(spark, d, "conversations").where("text is not null")
    return c.select(F.col("conv_id").alias("cluster_id"), F.col("turn").alias("article_id"), F.array_distinct(_terms(F.col("text"))).alias("s"))


@query(f"""WITH {_TURNS}, e AS (SELECT cluster_id, article_id, unnest(s) AS term FROM turns), w AS (SELECT cluster_id, term, count(*) AS have FROM e GROUP BY 1, 2), k AS (SELECT term FROM w GROUP BY 1 HAVING count(*) <= 5),
core AS (SELECT DISTINCT cluster_id, article_id FROM e JOIN w USING (cluster_id, term) JOIN k USING (term) WHERE have > 1), m AS (SELECT t.cluster_id, t.article_id, c.cluster_id IS NOT NULL AS core FROM turns t LEFT JOIN core c ON c.cluster_id = t.cluster_id AND c.article_id = t.article_id)
SELECT * FROM m WHERE cluster_id IN (SELECT cluster_id FROM m GROUP BY 1 HAVING count(*) >= 3 AND count(*) FILTER (WHERE core) < 0.5 * count(*))""")
def incoherent_turns(spark, d):
    """Conversations of which few turns share an anchor, and the turns that do."""
    return merging.incoherent_members(_turns(spark, d), "s")


_RAW_SQL = " OR ".join(f"regexp_matches(trim(summary), '{p}')" for p in checks._RAW)
_RAW_SQL = f"""(trim(summary) <> '' AND ({_RAW_SQL} OR len(list_filter(string_split_regex(trim(summary), '[ \\t\\n\\r]+'), lambda w: length(w) >= 12 AND regexp_matches(w, '[a-z][A-Z]'))) >= 2 OR regexp_matches(trim(summary), '[^ \\t\\n\\r]{{40}}')))"""
_LOUD = ["landmark", "historic", "unprecedented", "crucial"]


@query(f""", {_CARDS}, c AS (SELECT cluster_id, title, coalesce(summary, '') AS summary, content_type, list_filter(list_distinct(stems), lambda t: length(t) >= 5) AS p FROM cards)
SELECT code, grade, dimension, cluster_id FROM (
SELECT 'RF-4' AS code, 'CATASTROPHIC' AS grade, 'coverage' AS dimension, cluster_id FROM c WHERE content_type <> 'opinion' AND trim(summary) = ''
UNION ALL SELECT 'RF-4', 'WRONG', 'coverage', cluster_id FROM c WHERE content_type <> 'opinion' AND {_RAW_SQL}
UNION ALL SELECT 'RF-11', 'ACCEPTABLE', 'hygiene', cluster_id FROM c WHERE regexp_matches(concat(coalesce(title, ''), ' ', summary), '[–—]') OR regexp_matches(lower(concat(coalesce(title, ''), ' ', summary)), '\\b(unprecedented|historic|landmark|crucial)\\b')
UNION ALL SELECT 'RF-3', 'WRONG', 'agreement', cluster_id FROM c WHERE content_type <> 'opinion' AND trim(summary) <> '' AND NOT {_RAW_SQL} AND len(p) >= 2 AND len(list_intersect(p, list_distinct({_WORDS.format("array_to_string(string_split(summary, chr(10))[2:], ' ')")}))) = 0
UNION ALL SELECT 'RF-7', 'WRONG', 'junk', cluster_id FROM c WHERE contains(lower(title), 'best ')::INT * 2 + contains(lower(title), 'how to')::INT * 2 + contains(lower(title), 'license')::INT * 3 >= 3)""", "articles")
def card_findings(spark, d):
    """Findings of five rules over all cards."""
    c = _cards(spark, d)
    rest = F.array_join(F.slice(F.split("summary", "\n"), 2, 1_000_000), " ")
    agreed = c.withColumn("p", F.filter("stems", lambda t: F.length(t) >= 5)).withColumn("r", _terms(rest))
    found = checks.coverage_findings(c).unionByName(checks.hygiene_findings(c, _LOUD)).unionByName(checks.agreement_findings(agreed, "p", "r"))
    return found.unionByName(checks.junk_findings(c, {"best ": 2, "how to": 2, "license": 3}))


@query(f""", {_TURNS}, front AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY article_id) AS r FROM turns WHERE len(s) > 0) WHERE r <= 30),
n AS (SELECT cluster_id, count(*) AS members FROM front GROUP BY 1 HAVING count(*) >= 3),
j AS (SELECT x.cluster_id, sum(len(list_intersect(x.s, y.s)) / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s)))) AS total FROM front x JOIN front y ON x.cluster_id = y.cluster_id AND x.article_id < y.article_id GROUP BY 1),
h AS (SELECT cluster_id, max(have) AS have FROM (SELECT cluster_id, term, count(*) AS have FROM (SELECT cluster_id, unnest(s) AS term FROM front) GROUP BY 1, 2) GROUP BY 1)
SELECT cluster_id, 'RF-5' AS code, 'ACCEPTABLE' AS grade, 'cohesion' AS dimension FROM n JOIN h USING (cluster_id) LEFT JOIN j USING (cluster_id)
WHERE round(have / members, 6) < 0.9 AND round(coalesce(total, 0) / (members * (members - 1) / 2), 6) < 0.2""".replace(", turns", "WITH turns", 1))
def cohesion_findings(spark, d):
    """Conversations that look like mixed bags."""
    return checks.cohesion_findings(merging.title_cohesion(_turns(spark, d), "s"), 3, 0.9, 0.2)


@query(f"""WITH {_TURNS}, first AS (SELECT cluster_id, s FROM turns WHERE article_id = 0), last AS (SELECT cluster_id, s FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY article_id DESC) AS r FROM turns) WHERE r = 1),
many AS (SELECT cluster_id FROM turns GROUP BY 1 HAVING count(*) > 1), core AS (SELECT cluster_id, list(term) AS core FROM (SELECT cluster_id, term FROM (SELECT cluster_id, unnest(s) AS term FROM turns WHERE article_id > 0) GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1)
SELECT f.cluster_id, 'RF-1' AS code, 'WRONG' AS grade, 'contamination' AS dimension FROM first f JOIN last l USING (cluster_id) LEFT JOIN core c USING (cluster_id)
WHERE f.cluster_id IN (SELECT cluster_id FROM turns WHERE article_id > 0 GROUP BY 1 HAVING count(*) > 1) AND len(l.s) > 0 AND len(list_intersect(f.s, l.s)) = 0 AND coalesce(len(list_intersect(l.s, c.core)), 0) = 0 AND (len(f.s) > 0 OR c.core IS NOT NULL)""")
def contamination_findings(spark, d):
    """Conversations whose last turn shares nothing with the first, nor with what later turns have in common."""
    from newsloom.operators.selection import best_per_key

    t = _turns(spark, d)
    first = t.where("article_id = 0").select("cluster_id", F.col("s").alias("p"))
    last = best_per_key(t, ["cluster_id"], [F.desc("article_id")]).select("cluster_id", F.col("s").alias("r"))
    return checks.contamination_findings(first.join(last, "cluster_id"), t.where("article_id > 0").select("cluster_id", F.col("s").alias("terms")), "p", "r")


_LEXICON = [("the", "general", 0.5), ("data", "science", 2.0), ("water", "nature", 2.0), ("river", "nature", 2.0), ("license", "law", 3.0), ("password", "security", 3.0), ("le", "french", 1.0), ("la", "french", 1.0), ("der", "german", 1.0), ("und", "german", 1.0), ("el", "spanish", 1.0), ("los", "spanish", 1.0)]


@query(f""", w AS (SELECT article_id, {_WORDS.format('title')} AS t, {_WORDS.format('body')} AS b FROM articles WHERE body IS NOT NULL), lex(word, category, weight) AS (VALUES {", ".join(f"('{a}', '{b}', {c}::DOUBLE)" for a, b, c in _LEXICON)}),
v AS (SELECT article_id, word, count(*) / per AS v FROM (SELECT article_id, greatest(len(b) / 100, 1) AS per, unnest(b) AS word FROM w) GROUP BY article_id, word, per UNION ALL SELECT article_id, unnest(t), 2 FROM w),
s AS (SELECT article_id, category, round(sum(v * weight), 6) AS score FROM v JOIN lex USING (word) GROUP BY 1, 2), k AS (SELECT *, max(score) OVER (PARTITION BY article_id) AS best FROM s)
SELECT article_id, category, score, place FROM (SELECT article_id, category, score, row_number() OVER (PARTITION BY article_id ORDER BY score DESC, category) AS place FROM k WHERE score >= 0.6 * best) WHERE place <= 3""", "articles")
def article_categories(spark, d):
    """Categories of each article by a lexicon."""
    a = S.articles(spark, d).where("body is not null").select("article_id", _terms(F.col("title")).alias("title_words"), _terms(F.col("body")).alias("body_words"))
    return checks.categories_of(a, spark.createDataFrame(_LEXICON, "word string, category string, weight double"))


_KEYS = ["border", "treaty", "global"]


@query(f""", t AS (SELECT source_id % 7 AS k, lower(n_name) AS place FROM (SELECT n_nationkey AS source_id, n_name FROM nation)), w AS (SELECT DISTINCT article_id, unnest(string_split_regex(lower(body), '[^a-z]+')) AS place FROM articles),
g AS (SELECT article_id, sum(k) AS weight FROM w JOIN t USING (place) GROUP BY 1)
SELECT a.article_id AS cluster_id, coalesce(least(coalesce(weight, 0) * 10, 60) + least(({" + ".join(f"contains(lower(body), '{k}')::INT" for k in _KEYS)}) * 5, 40), 0)::DOUBLE AS impact FROM articles a LEFT JOIN g USING (article_id)""", "articles")
def geographic_impact(spark, d):
    """Weight of the nations that an article names."""
    places = table(spark, d, "nation").select(F.lower("n_name").alias("place"), (F.col("n_nationkey") % 7).alias("weight"))
    return checks.geographic_impact(S.articles(spark, d).select(F.col("article_id").alias("cluster_id"), F.col("body").alias("text")), places, _KEYS)


_WIRE_LEAD = "substring(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), 1, 800)"


@query(f"""WITH a AS (SELECT doc_id AS article_id, source AS slug, CASE WHEN source IN ('src3', 'src7') THEN 'wire' ELSE 'national' END AS tier, -(doc_id % 50) AS published_at, {_WIRE_LEAD} AS lead FROM documents),
k AS (SELECT *, sha1(lead) AS wire_group, row_number() OVER (PARTITION BY lead ORDER BY tier = 'wire' DESC, slug IN ('src5') DESC, published_at, article_id) AS r, count(*) OVER (PARTITION BY lead) AS n,
  first_value(slug) OVER (PARTITION BY lead ORDER BY tier = 'wire' DESC, slug IN ('src5') DESC, published_at, article_id) AS origin FROM a WHERE length(lead) >= 80 AND regexp_matches(lead, '[a-z0-9]{{2}}'))
SELECT a.article_id, CASE WHEN n > 1 THEN wire_group END AS wire_group, CASE WHEN n > 1 THEN origin END AS origin_source, coalesce(n > 1 AND r > 1, false) AS is_copy FROM a LEFT JOIN k USING (article_id)""")
def wire_tags(spark, d):
    """Every document with its syndication group, the outlet that it comes from, and whether it is a copy."""
    tier = F.when(F.col("source").isin("src3", "src7"), "wire").otherwise("national")
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("article_id"), F.col("text").alias("body"), F.col("source").alias("slug"), tier.alias("tier"), (-(F.col("doc_id") % 50)).alias("published_at"))
    return stories.wire_tags(rows, ["wire", "wire-service"], ["src5"])
