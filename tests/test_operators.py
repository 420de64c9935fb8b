"""Semantics that SQL twins cannot show, on small fixtures."""

import pytest
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.operators import analysis, clustering, joins, selection, serving, state, stories
from newsloom.operators.graph import connected_components
from newsloom.plans import desk_queries
from newsloom.shared import replace_table
from newsloom.sources.readers import feed_entries, nested_events, outlets, parse_time, write_latest
from newsloom.streaming import stories as stream


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (200, 200), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: 200}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_stories_of_many_articles_with_one_title(spark):
    titles = ["harbour strike enters second week"] * 30 + ["harbour strike enters third week", "museum opens wing", "museum opens wing", None, ""]
    rows = spark.createDataFrame(list(enumerate(titles)), "article_id long, title string")
    weights = stories.tf_idf(rows, "title")
    copies = stories.equal_vectors(weights)
    distinct = weights.join(copies.select(F.col("vector_id").alias("article_id")).distinct(), "article_id", "left_semi")
    got = {r.article_id: r.story_id for r in stories.average_linkage(clustering.prefix_pairs(distinct, 0.15), rows, copies).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 31: 31, 32: 31, 33: 33, 34: 34}


def test_upsert_and_insert_if_absent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert {tuple(r) for r in joins.upsert(old, new, ["id"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert {tuple(r) for r in joins.insert_if_absent(old, new, ["id"]).collect()} == {(1, "a"), (2, "b"), (3, "d")}


def test_first_wins_keeps_ingest_order(spark):
    rows = spark.createDataFrame([("u", 2), ("u", 1), ("w", 3)], "url string, at int")
    assert {tuple(r) for r in joins.first_wins(rows, ["url"], [F.col("at")]).collect()} == {("u", 1), ("w", 3)}


def test_moving_average_is_ordered(spark):
    rows = spark.createDataFrame([("k", 2, 20.0), ("k", 1, 10.0), ("k", 3, None)], "k string, day int, v double")
    assert state.moving_average(rows, ["k"], "day", "v").first().average == 13.0


def test_page_is_clamped(spark):
    rows = spark.range(100)
    assert selection.page(rows, [F.col("id")], 500).count() == 50
    assert selection.page(rows, [F.col("id")], 0, 3).first().id == 3


def test_text_functions(spark):
    one = spark.createDataFrame([("<title> A </title><script>x</script><p>b &amp;lt; c</p>", "GO NOW ok", None)], "h string, t string, n string")
    r = one.select(T.html_text(F.col("h")).alias("x"), T.page_title(F.col("h")).alias("y"), T.caps_share(F.col("t")).alias("c"), T.word_count(F.col("n")).alias("n")).first()
    assert (r.x, r.y, round(r.c, 3), r.n) == ("A b &lt; c", "A", 0.667, 0)


def test_stems(spark):
    got = {r.token: r.stem for r in stories.stems_in_python(spark.createDataFrame([("caresses",), ("ponies",), ("running",), ("rated",), ("sing",)], "token string")).collect()}
    assert got == {"caresses": "caress", "ponies": "poni", "running": "run", "rated": "rate", "sing": "sing"}


def test_sources(spark, tmp_path):
    (tmp_path / "o.json").write_text('[{"slug":"a","country":"US"},{"slug":"b","country":"FR"}]')
    assert [r.slug for r in outlets(spark, str(tmp_path / "o.json"), {"us": ["US"]}, "world").collect()] == ["b"]
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>A long enough title</title><link>u</link></item><item><title>short</title><link>v</link></item></channel></rss>")
    assert [r.link for r in feed_entries(spark, str(tmp_path / "f.xml")).collect()] == ["u"]
    (tmp_path / "e.json").write_text('{"slug":"x","perspectives":[{"viewpoint":"p"}],"connections":[{"target_slug":"y","connection_type":"k"},{"target_slug":"z","connection_type":"k"}]}\n{"slug":"y"}\n')
    tables = nested_events(spark, str(tmp_path / "e.json"))
    assert tables["perspectives"].count() == 1 and [r.dst for r in tables["connections"].collect()] == ["y"]
    t = spark.createDataFrame([("2026-04-08T06:00Z",), ("nope",)], "t string").select(parse_time(F.col("t")).alias("t")).collect()
    assert t[0].t.hour == 6 and t[1].t is None


def test_feed_entries_keep_the_order_of_the_feed(spark, tmp_path):
    item = "<item><title>A long enough title {0}</title><link>https://x/{0}</link><pubDate>{1}</pubDate></item>"
    dates = ["Mon, 06 Apr 2026 10:00:00 GMT", "Wed, 08 Apr 2026 10:00:00 +0200", "Thu, 01 Jan 2026 10:00:00 GMT", "unknown"]
    junk = "<item><title>A title of a section</title><link>https://x/subscribe/now</link></item>"
    (tmp_path / "f.xml").write_text("<rss><channel>" + junk + "".join(item.format(k, d) for k, d in enumerate(dates)) + "</channel></rss>")
    links = lambda **more: sorted(r.link[-1] for r in feed_entries(spark, str(tmp_path / "f.xml"), **more).collect())
    assert links() == ["0", "1", "2", "3"] and links(per_feed=2) == ["0", "1"]
    assert links(now="2026-04-08 09:00:00") == ["0", "1", "3"] and links(now="2026-04-09 09:00:00") == ["1", "3"]
    t = [r.t for r in spark.createDataFrame([(d,) for d in dates], "t string").select(parse_time(F.col("t")).alias("t")).collect()]
    assert [x and (x.day, x.hour) for x in t] == [(6, 10), (8, 8), (1, 10), None]


def test_failed_write_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    with pytest.raises(Exception):
        replace_table(spark.read.parquet(path).select(F.raise_error(F.lit("no")).alias("id")), path)
    assert spark.read.parquet(path).count() == 3
    replace_table(spark.read.parquet(path).where("id > 0"), path)
    assert spark.read.parquet(path).count() == 2 and [p.name for p in tmp_path.iterdir() if ".old-" in p.name] == []


def test_latest_wins_sink(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string").write.parquet(path)
    write_latest(spark, path, spark.createDataFrame([(2, "c")], "id int, v string"), ["id"])
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "c")}


def _stream(spark, tmp_path, frames):
    folder = tmp_path / "in"
    for k, f in enumerate(frames):
        f.coalesce(1).write.parquet(str(folder / f"b={k}"))
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "*"))


def test_streaming_average_and_sink(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "event_id long, k string, value double")
    source = _stream(spark, tmp_path, [frame([(1, "a", 10.0), (2, "a", 20.0)])])
    q = stream.running_average(source, "k", "value").writeStream.outputMode("update").format("memory").queryName("ema").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("ema").collect()[-1].average == 13.0
    q = source.writeStream.foreachBatch(stream.upsert_sink(str(tmp_path / "out"), ["k"])).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_streaming_windows_drop_late_rows(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "event_id long, event_type string, user_id long, value double, ts string").withColumn("ts", F.to_timestamp("ts"))
    frames = [frame([(1, "a", 1, 1.0, "2001-01-10 00:00:00")]), frame([(2, "a", 1, 1.0, "2001-01-09 00:00:00")]), frame([(3, "a", 1, 1.0, "2001-01-01 00:00:00")])]
    source = stream.with_event_time(_stream(spark, tmp_path, frames))
    q = stream.window_counts(source, "ts", "1 day", None, "event_type").writeStream.outputMode("update").format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("late").agg(F.sum("n")).first()[0] == 2


def test_streaming_windows_match_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source = stream.with_event_time(_stream(spark, tmp_path, [events]))
    q = stream.window_counts(source, "ts", "1 day", None, "event_type").writeStream.outputMode("complete").format("memory").queryName("days").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    batch = stream.window_counts(events, "ts", "1 day", None, "event_type")
    pick = lambda df: sorted((r.event_type, r.n, r.total) for r in df.collect())
    assert pick(spark.table("days")) == pick(batch)


def test_axes_of_single_articles(spark):
    wire = (
        "Secretary Jane Doe said in an interview that 40 percent of the planned cuts were dropped. \"We have listened to every town in the valley,\" she told reporters. "
        "According to census figures, the district lost 3 thousand jobs. Mayor Omar Reyes confirmed the vote. The agency said records show the fund held $12 million."
    )
    column = "I must say it is absurd. We should never let this pass. Of course they always knew, and surely we deserve better. It is shameful and foolish, and in my view it must stop."
    tabloid = "Mayhem! You absolutely must see it! Terrifying! The thugs run! Evil liars! Utterly savage! Run! Now or never!"
    rows = [
        (1, "Council drops part of the budget cuts", wire, "us_major"), (2, "Opinion: The council has lost its way", column, "us_major"), (3, "7 TERRIFYING things you will see!! Utterly savage...", tabloid, None),
        (4, None, None, "independent"), (5, "", " \n", "us_major"), (6, "Budget", wire + " It is believed that some people left. Many people know.", "us_major"),
    ]
    rows = spark.createDataFrame(rows, "article_id long, title string, body string, tier string")
    loud = {r.article_id: r for r in analysis.sensationalism(rows).collect()}
    views = {r.article_id: r for r in analysis.opinion(rows).collect()}
    rigor = {r.article_id: r for r in analysis.factual_rigor(rows).collect()}
    # bands as for news of a wire, a column and a tabloid
    assert loud[1].sensationalism <= 20 and loud[3].sensationalism >= 65
    assert views[1].opinion <= 25 and views[2].opinion >= 65
    assert rigor[1].rigor >= 50 and rigor[2].rigor <= 45 and rigor[3].rigor <= 45
    assert (rigor[1].named_source, rigor[1].quotes, rigor[1].specificity, views[1].pronoun > 0) == (40.0, 20.0, 100.0, True)
    assert rigor[6].specificity == 40.0 and rigor[6].rigor < rigor[1].rigor  # two titled persons, three weasel words
    # the title of the tabloid: number, reader, unfinished; two shouts; two strong words, one of degree; one word in capitals of eight
    assert loud[3].headline == 3 * 6 + 2 * 5 + 5 + 20 / 8 + 2 * 3 + 2
    assert loud[4].sensationalism == loud[5].sensationalism == 5 and rigor[4].rigor == rigor[5].rigor == 10 and views[4].attribution == 50


def test_axes_take_lists_of_the_caller(spark):
    rows = spark.createDataFrame([(1, "Neutral words", "zork zork and more", "us_major")], "article_id long, title string, body string, tier string")
    mine = analysis.LISTS | {"urgent": ["zork"]}
    assert analysis.sensationalism(rows, mine).first().body - analysis.sensationalism(rows).first().body == 16.0



def test_labels_of_equal_weight_go_by_the_smaller_value(spark):
    rows = spark.createDataFrame([(1, 80.0, 70.0), (2, 90.0, 70.0), (3, 39.0, 70.0)], "cluster_id int, divergence double, factual double")
    got = {r.cluster_id: r.labels for r in serving.rank_labels(rows, {"divergence": 0.07, "factual": 0.08}, 2, 40.0).collect()}
    assert 80.0 * 0.07 == 70.0 * 0.08 and got == {1: "factual,divergence", 2: "divergence,factual", 3: "factual"}


def test_gathered_members_count_once_where_article_ids_meet(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    spark.read.parquet(f"{sf}/orders.parquet").write.parquet(f"{tmp_path}/orders.parquet")
    # part 100,000 + p of an order has the article_id of part p of the next order
    row = spark.read.parquet(f"{sf}/lineitem.parquet").join(spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    row = row.withColumn("l_shipdate", F.lit("2001-11-01").cast(row.schema["l_shipdate"].dataType)).withColumn("l_linenumber", F.lit(1).cast(row.schema["l_linenumber"].dataType))
    keys = [r.o_orderkey for r in spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey").orderBy("o_orderkey").collect()]
    low = next(k for k in keys if k + 1 in set(keys))
    key, part = row.schema["l_orderkey"].dataType, row.schema["l_partkey"].dataType
    one = row.limit(1)
    two = one.withColumns({"l_orderkey": F.lit(low).cast(key), "l_partkey": F.lit(100_007).cast(part)}).unionByName(one.withColumns({"l_orderkey": F.lit(low + 1).cast(key), "l_partkey": F.lit(7).cast(part)}))
    two.write.parquet(f"{tmp_path}/lineitem.parquet")
    assert sum(r.articles for r in desk_queries.rerank_gather(spark, str(tmp_path)).collect()) == 2


def test_threads_meet_without_a_broadcast(spark, capsys):
    day = "to_date('2024-01-01')"
    rows = spark.range(400).selectExpr("id AS story_id", "id % 7 AS thread", f"date_add({day}, cast(id * 13 % 60 as int)) AS day", "cast(id % 5 as double) AS weight")
    found = joins.thread_continuations(rows, 9)
    got = {r.story_id: r.prior_id for r in found.collect()}
    found.explain()
    assert "Broadcast" not in capsys.readouterr().out
    all_rows = rows.collect()
    for a in all_rows:
        near = [(-b.weight, -b.day.toordinal(), b.story_id) for b in all_rows if b.thread == a.thread and 0 < (a.day - b.day).days <= 9]
        assert got.get(a.story_id) == (min(near)[2] if near else None)
