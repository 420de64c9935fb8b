"""Story memory: the two leading stories of every edition, replaced with every run, and the capped updates that polls add to a story
until it is evicted.

Each operator has a batch form (DataFrame to DataFrame) and a streaming form that keeps the same decisions in keyed state. A run or poll
is a value of a column, not a micro-batch, so both give the same rows however the input is cut into batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from newsloom.operators.selection import best_per_key

HOLD_HOURS = 48
TRACKED = 2
UPDATES_A_POLL = 8


def tracked_stories(ranked: DataFrame, keys: list[str], run: str, story: str, score: str, most: int = TRACKED, hold: int = HOLD_HOURS) -> DataFrame:
    """(*keys, run, place, story, replaced_at, evicted_at): what every run tracks, and until when.

    A run replaces all that earlier runs track, so `replaced_at` is the next run of the keys (null: still active). `evicted_at` is the
    first run more than `hold` hours later, which deletes the record (null: still kept). Ties of the score go to the smaller story;
    rows whose run, story or score is null take no part.
    """
    rows = ranked.where(F.col(run).isNotNull() & F.col(story).isNotNull() & F.col(score).isNotNull())
    top = best_per_key(rows, [*keys, run], [F.col(score).desc(), F.col(story)], most)
    seen = top.groupBy(*keys).agg(F.array_sort(F.collect_set(run)).alias("runs"))
    later = lambda hours: F.array_min(F.filter("runs", lambda r: r > F.col(run) + F.expr(f"INTERVAL {hours} HOURS")))
    return top.join(seen, keys).select(*keys, run, "place", story, later(0).alias("replaced_at"), later(hold).alias("evicted_at"))


def live_updates(articles: DataFrame, keys: list[str], poll: str, url: str, most: int = UPDATES_A_POLL, hold: int = HOLD_HOURS) -> DataFrame:
    """(*keys, opened, poll, url): the articles that a story's polls add to it, once each.

    A story opens with its first poll; the first poll more than `hold` hours later evicts it with all it has seen and opens it anew.
    A poll adds at most `most` urls that the open story has not added yet, smaller urls first; the others stay unseen and can come with
    a later poll. Rows with a null poll or url take no part; repeats within a poll count once. A group of the last fold holds what one
    story's polls offer within `hold` hours; openings of a story are few, as each is over `hold` hours after the one before.
    """
    rows = articles.where(F.col(poll).isNotNull() & F.col(url).isNotNull()).select(*keys, poll, url).distinct()
    nothing = F.filter(F.array(F.lit(None).cast(articles.schema[poll].dataType)), lambda x: x.isNotNull())
    longer = lambda p, o: p > o + F.expr(f"INTERVAL {hold} HOURS")
    opens = F.aggregate(F.array_sort("polls"), nothing, lambda o, p: F.when(F.size(o) == 0, F.array(p)).when(longer(p, F.element_at(o, -1)), F.concat(o, F.array(p))).otherwise(o))
    openings = rows.select(*keys, poll).groupBy(*keys).agg(F.collect_set(poll).alias("polls")).select(*keys, opens.alias("opens"))
    placed = rows.join(openings, keys).withColumn("opened", F.array_max(F.filter("opens", lambda o: o <= F.col(poll))))
    polls = placed.groupBy(*keys, "opened", poll).agg(F.array_sort(F.collect_list(url)).alias("urls"))
    story = polls.groupBy(*keys, "opened").agg(F.array_sort(F.collect_list(F.struct(F.col(poll).alias("at"), "urls"))).alias("polls"))
    start = F.struct(F.slice(F.col("polls")[0]["urls"], 1, 0).alias("seen"), F.slice(F.transform("polls", lambda p: F.struct(p["at"], F.slice(p["urls"], 1, 0).alias("urls"))), 1, 0).alias("out"))

    def add(acc, p):
        fresh = F.slice(F.array_except(p["urls"], acc["seen"]), 1, most)
        return F.struct(F.concat(acc["seen"], fresh).alias("seen"), F.concat(acc["out"], F.array(F.struct(p["at"], fresh.alias("urls")))).alias("out"))

    added = story.select(*keys, "opened", F.explode(F.aggregate("polls", start, add)["out"]).alias("p"))
    return added.select(*keys, "opened", F.col("p.at").alias(poll), F.explode("p.urls").alias(url))


class _Updates(StatefulProcessor):
    """State of one story: when it opened, and the urls it has added. An event-time timer evicts both."""

    def __init__(self, key: str, most: int, hold: int) -> None:
        self.key, self.most, self.hold = key, most, pd.Timedelta(hours=hold)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.opened = handle.getValueState("opened", "at timestamp")
        self.seen = handle.getMapState("seen", "url string", "poll timestamp")

    def _evict(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.opened.clear()
        self.seen.clear()

    def _open(self, at: pd.Timestamp) -> None:
        self._evict()
        self.opened.update((at.to_pydatetime(),))
        self.handle.registerTimer(int((at + self.hold).timestamp() * 1000) + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        offered = pd.concat(rows).dropna(subset=["poll", "url"])
        for at, urls in offered.groupby("poll", sort=True)["url"]:
            if not self.opened.exists() or at - pd.Timestamp(self.opened.get()[0]) > self.hold:
                self._open(at)
            fresh = [u for u in sorted(set(urls)) if not self.seen.containsKey((u,))][: self.most]
            for u in fresh:
                self.seen.updateValue((u,), (at.to_pydatetime(),))
            if fresh:
                yield pd.DataFrame({self.key: key[0], "opened": pd.Timestamp(self.opened.get()[0]), "poll": at, "url": fresh, "kind": "update"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.opened.exists():
            opened = pd.Timestamp(self.opened.get()[0])
            self._evict()
            yield pd.DataFrame({self.key: [key[0]], "opened": [opened], "poll": [opened + self.hold], "url": [None], "kind": ["evicted"]})

    def close(self) -> None:
        pass


def live_updates_stream(articles: DataFrame, key: str, poll: str, url: str, late: str = "2 hours", most: int = UPDATES_A_POLL, hold: int = HOLD_HOURS) -> DataFrame:
    """`live_updates` over a stream, with a row of kind `evicted` (url null) when the watermark ends a story's time.

    State lives in RocksDB (set `spark.sql.streaming.stateStore.providerClass`) and is bounded by `most` urls a poll and `hold` hours.
    Polls of a story may come in one micro-batch in any order; a poll that comes in a later micro-batch than a later poll of its story is
    taken as it comes; one beyond `late` is dropped.
    """
    rows = articles.select(F.col(key), F.col(poll).cast("timestamp").alias("poll"), F.col(url).cast("string").alias("url")).withWatermark("poll", late)
    kind = articles.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, opened timestamp, poll timestamp, url string, kind string"
    return rows.groupBy(key).transformWithStateInPandas(_Updates(key, most, hold), schema, "Append", "EventTime")
