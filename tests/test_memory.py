"""Story memory: replacement by runs, capped updates, eviction, restart and late rows of its stream."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from newsloom.streaming import memory

START = datetime(2024, 1, 1)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def hour(h):
    return START + timedelta(hours=h)


def slow(rows, most, hold):
    """Every story's polls one after the other."""
    out = set()
    for story in {r[0] for r in rows}:
        opened, seen = None, set()
        for at in sorted({r[1] for r in rows if r[0] == story and r[1] is not None and r[2] is not None}):
            if opened is None or at - opened > timedelta(hours=hold):
                opened, seen = at, set()
            fresh = sorted({r[2] for r in rows if r[0] == story and r[1] == at and r[2] is not None} - seen)[:most]
            seen |= set(fresh)
            out |= {(story, opened, at, u) for u in fresh}
    return out


def offers(seed, n=400):
    rng = random.Random(seed)
    rows = [(rng.choice("abc"), hour(rng.choice(range(0, 200, 3))), f"u{rng.randrange(40):02d}") for _ in range(n)]
    return [*rows, *rows[:20], ("a", None, "u1"), ("b", hour(3), None)]


def test_updates_match_one_poll_after_the_other(spark):
    for seed, most, hold in ((1, 2, 48), (2, 3, 10), (3, 8, 0)):
        rows = offers(seed)
        got = memory.live_updates(spark.createDataFrame(rows, "story string, poll timestamp, url string"), ["story"], "poll", "url", most, hold)
        assert sorted(map(tuple, got.collect())) == sorted(slow(rows, most, hold))


def test_updates_of_nothing(spark):
    assert memory.live_updates(spark.createDataFrame([], "story string, poll timestamp, url string"), ["story"], "poll", "url").count() == 0


def test_runs_replace_and_evict(spark):
    rows = [("e", hour(h), s, v) for h, s, v in ((0, "a", 3.0), (0, "b", 3.0), (0, "c", 1.0), (24, "b", 5.0), (48, "a", 1.0), (49, "c", 2.0), (49, None, 9.0), (49, "d", None))]
    got = memory.tracked_stories(spark.createDataFrame(rows, "edition string, run timestamp, story string, score double"), ["edition"], "run", "story", "score").collect()
    assert sorted((r.run, r.place, r.story, r.replaced_at, r.evicted_at) for r in got if r.run == hour(0)) == [(hour(0), 1, "a", hour(24), hour(49)), (hour(0), 2, "b", hour(24), hour(49))]
    assert [(r.story, r.replaced_at, r.evicted_at) for r in got if r.run == hour(49)] == [("c", None, None)]
    assert [(r.place, r.replaced_at, r.evicted_at) for r in got if r.run == hour(24)] == [(1, hour(48), None)]


def test_stream_restarts_evicts_and_drops_late_rows(spark, tmp_path):
    """A query that is stopped after each file and started again gives the rows of one pass; state and its timers survive."""
    rows = [r for r in offers(5) if r[1] is not None and r[2] is not None]
    source, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)

    def run():
        stream = spark.readStream.schema("story string, poll timestamp, url string").parquet(source)
        memory.live_updates_stream(stream, "story", "poll", "url", most=3).writeStream.format("parquet").option("checkpointLocation", log).trigger(availableNow=True).start(out).awaitTermination()

    try:
        for low, high in ((0, 60), (60, 120), (120, 201)):
            spark.createDataFrame([r for r in rows if hour(low) <= r[1] < hour(high)], "story string, poll timestamp, url string").coalesce(1).write.mode("append").parquet(source)
            run()
        spark.createDataFrame([("a", hour(1), "late"), ("z", hour(400), "u")], "story string, poll timestamp, url string").coalesce(1).write.mode("append").parquet(source)
        run()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    got = spark.read.parquet(out)
    taken = got.where("kind = 'update'").select("story", "opened", "poll", "url").collect()
    assert sorted(map(tuple, taken)) == sorted(slow([*rows, ("z", hour(400), "u")], 3, 48))
    gone = {(r.story, r.opened) for r in got.where("kind = 'evicted'").collect()}
    last = {s: max(o for t, o, _, _ in slow(rows, 3, 48) if t == s) for s in "abc"}
    assert set(last.items()) <= gone and got.where(F.col("url") == "late").count() == 0
