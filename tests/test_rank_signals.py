"""The signals of the rank from one aggregation are those of the single operators, on odd rows too."""

import random
from functools import reduce

import pytest
from pyspark.sql import functions as F

from newsloom.operators import checks, enrichment, ranking, scores

AS_OF = "2024-03-01 00:00:00"


def made(spark):
    rng = random.Random(2)
    some = lambda v: None if rng.random() < 0.1 else v
    rows = [(some(rng.randint(1, 40)), some(rng.randint(1, 12)), some(rng.randint(0, 100)), rng.randint(0, 100), some(rng.randint(0, 100)), some(rng.randint(0, 100)), some(rng.randint(0, 9) / 10), some(f"2024-02-{rng.randint(25, 29)} {rng.randint(0, 23):02d}:00:00"), k) for k in range(260)]
    rows += [(90, 77, 1, 1, 1, 1, 0.5, "2024-02-28 00:00:00", 900), (91, 1, 1, 1, 1, 1, None, "2024-02-28 00:00:00", 901)]  # an unknown outlet, no confidence
    members = spark.createDataFrame(rows, "cluster_id long, source_id long, lean int, framing int, sensationalism int, rigor int, confidence double, at string, article_id long").withColumn("published_at", F.col("at").cast("timestamp"))
    tiers = ["us_major", "international", "independent", None]
    sources = spark.createDataFrame([(k, tiers[(k or 0) % 4], f"c{(k or 0) % 2}") for k in [*range(1, 12), 5, None]], "source_id long, tier string, country string")  # one is listed twice
    return members, sources


@pytest.mark.parametrize("most", [ranking.BROADCAST_SOURCES, 0])
def test_one_aggregation_gives_all_signals(spark, monkeypatch, most):
    monkeypatch.setattr(ranking, "BROADCAST_SOURCES", most)
    members, sources = made(spark)
    sens = members.groupBy("cluster_id").agg(F.avg("sensationalism").alias("avg_sensationalism"))
    trust = enrichment.lower_quartile(members, "cluster_id", "confidence").withColumnRenamed("quartile", "cluster_confidence")
    parts = [ranking.source_signals(members, sources, "c1"), ranking.time_signals(members, AS_OF), ranking.score_signals(members), sens, trust]
    want = reduce(lambda a, b: a.join(b, "cluster_id"), parts)
    got = ranking.cluster_signals(members, sources, "c1", AS_OF)
    text = got._jdf.queryExecution().executedPlan().toString()
    plain = lambda df: {r.cluster_id: tuple(round(float(r[c]), 9) if r[c] is not None else None for c in sorted(df.columns)) for r in df.collect()}
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want) and len(plain(want)) > 30
    assert sum("hashpartitioning(cluster_id" in line for line in text.splitlines()) == 1  # members are dealt by cluster once


def test_titles_are_read_once_for_both_signals(spark):
    rng = random.Random(7)
    bits = ["bolt", "Ring", "hot anvil", "old plate", "gizmo", "widget", "gear", "red", "blue2", "cold", "news", "é"]
    rows = [(rng.randint(1, 9), k, None if rng.random() < 0.1 else " ".join(rng.choice(bits) for _ in range(rng.randint(0, 4)))) for k in range(150)] + [(50, 1000, None)]
    titled = spark.createDataFrame(rows, "cluster_id long, article_id long, title string")
    places, keys, lists = {"red": 2, "blue": 3}, ["cold", "new"], (["bolt", "ring", "rod"], ["hot anvil"], ["old plate"], ["gizmo"], ["widget", "gear"])
    geo = checks.geographic_impact(titled.select("cluster_id", F.coalesce("title", F.lit("")).alias("text")), spark.createDataFrame(list(places.items()), "place string, weight int"), keys)
    want = {tuple(r) for r in scores.event_signals(titled, *lists).join(geo, "cluster_id").collect()}
    facts = scores.title_facts(F.col("title"), *lists, list(places), keys)
    for given in (facts, F.when(F.col("title").isNotNull(), facts)):
        got = scores.title_signals(titled.select("cluster_id", "article_id", given.alias("facts")), places, keys)
        assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        assert {tuple(r) for r in got.collect()} == want and len(want) == 10
