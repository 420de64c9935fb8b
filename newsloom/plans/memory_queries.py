"""Registered queries of story memory over `events`: an edition is an event type, a story one of ten values of `k`, a url a user."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.plans.queries import ORACLE_SQL, query
from newsloom.plans.story_tables import table
from newsloom.streaming import memory

_EVENTS = """WITH RECURSIVE e AS (SELECT event_type AS edition, CAST(props->>'k' AS BIGINT) % 10 AS story, value, user_id AS url, date_trunc('day', ts)::TIMESTAMP AS run,
  date_trunc('day', ts)::TIMESTAMP + INTERVAL 6 HOUR * (hour(ts) // 6) AS poll FROM events),
s AS (SELECT edition, run + INTERVAL 1 DAY AS run, story, round(sum(value), 2) AS score FROM e WHERE run IS NOT NULL AND story IS NOT NULL GROUP BY ALL HAVING score IS NOT NULL),
top AS (SELECT *, row_number() OVER (PARTITION BY edition, run ORDER BY score DESC, story) AS place FROM s QUALIFY place <= 2),
tracked AS MATERIALIZED (SELECT edition, run, place, story, (SELECT min(run) FROM s WHERE s.edition = top.edition AND s.run > top.run) AS replaced_at,
  (SELECT min(run) FROM s WHERE s.edition = top.edition AND s.run > top.run + INTERVAL 48 HOUR) AS evicted_at FROM top)"""


def _events(spark, d):
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    story = F.get_json_object("props", "$.k").cast("long") % 10
    return table(spark, d, "events").select(
        F.col("event_type").alias("edition"), story.alias("story"), "value", F.col("user_id").alias("url"), day.alias("run"), (day + F.expr("make_dt_interval(0, hour(ts) div 6 * 6)")).alias("poll"))


def _tracked(events):
    scores = events.groupBy("edition", "story", (F.col("run") + F.expr("INTERVAL 1 DAY")).alias("run")).agg(F.round(F.sum("value"), 2).alias("score"))
    return memory.tracked_stories(scores, ["edition"], "run", "story", "score")


@query(f"{_EVENTS} SELECT * FROM tracked")
def tracked_stories(spark, d):
    """The two leading stories of every day and edition, when they are replaced and when their record goes."""
    return _tracked(_events(spark, d))


@query()
def live_story_updates(spark, d):
    """What polls, four a day, add to the stories that their edition tracks at that time."""
    e = _events(spark, d)
    offered = e.drop("run").join(_tracked(e), ["edition", "story"]).where((F.col("poll") >= F.col("run")) & (F.col("replaced_at").isNull() | (F.col("poll") < F.col("replaced_at"))))
    return memory.live_updates(offered, ["edition", "story"], "poll", "url")


#: Openings by recursion over a story's polls, then additions by recursion over the polls of an opening.
ORACLE_SQL["live_story_updates"] = f"""{_EVENTS},
offers AS MATERIALIZED (SELECT DISTINCT edition, story, poll, url FROM e JOIN tracked USING (edition, story) WHERE poll >= tracked.run AND (replaced_at IS NULL OR poll < replaced_at) AND url IS NOT NULL),
g(edition, story, opened) AS (SELECT edition, story, min(poll) FROM offers GROUP BY ALL
  UNION ALL SELECT g.edition, g.story, min(poll) FROM g JOIN offers o ON o.edition = g.edition AND o.story = g.story AND o.poll > g.opened + INTERVAL 48 HOUR GROUP BY g.edition, g.story, g.opened),
placed AS (SELECT edition, story, poll, url, (SELECT max(opened) FROM g WHERE g.edition = offers.edition AND g.story = offers.story AND opened <= poll) AS opened FROM offers),
polls AS MATERIALIZED (SELECT edition, story, opened, poll, list(url ORDER BY url) AS urls, row_number() OVER (PARTITION BY edition, story, opened ORDER BY poll) AS k FROM placed GROUP BY edition, story, opened, poll),
walk(edition, story, opened, poll, k, seen, fresh) AS (
  SELECT edition, story, opened, poll, k, urls[1:8], urls[1:8] FROM polls WHERE k = 1
  UNION ALL SELECT p.edition, p.story, p.opened, p.poll, p.k, list_concat(seen, list_filter(urls, lambda u: NOT list_contains(seen, u))[1:8]), list_filter(urls, lambda u: NOT list_contains(seen, u))[1:8]
  FROM walk w JOIN polls p ON p.edition = w.edition AND p.story = w.story AND p.opened = w.opened AND p.k = w.k + 1)
SELECT edition, story, opened, poll, unnest(fresh) AS url FROM walk"""
