"""Framing: omission against all other articles of a story, scores of single articles by hand."""

import random

import pytest
from pyspark.sql import functions as F

from newsloom.operators import framing
from newsloom.operators.lean import Terms

CHARGED = Terms((("slaughter", "right", 3.0), ("regime", "left", 2.0)))


def test_omissions_as_with_all_others(spark):
    rng = random.Random(3)
    rows = [(k % 5, k, [rng.choice("abcdefgh") for _ in range(rng.randrange(6))]) for k in range(40)] + [(9, 100, None), (9, 101, ["a", None]), (10, 102, ["z"])]
    got = {r.article_id: (r.n_own, r.n_others, r.n_common) for r in framing.omissions(spark.createDataFrame(rows, "cluster_id int, article_id int, entities array<string>"), "entities").collect()}
    for c, a, mine in rows:
        own = {e for e in mine or [] if e}
        others = {e for d, b, es in rows if d == c and b != a for e in es or [] if e}
        assert got[a] == (len(own), len(others), len(own & others))


def test_no_article_meets_another(spark):
    rows = spark.createDataFrame([(1, 1, ["a"])], "cluster_id int, article_id int, entities array<string>")
    plan = framing.omissions(rows, "entities")._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "cluster_id" in plan and plan.count("Join") == 3


def test_single_articles_by_hand(spark):
    far = " word" * 98
    rows = [
        (1, "Regime" + far + " x", "us_major", 0.0), (2, None, "us_major", 0.0), (3, "critics say", "independent", 40.0), (4, "slaughter slaughter slaughter slaughter slaughter", None, 0.0),
        (5, "word " * 600 + "proponents proponents critics say", "us_major", 0.0), (6, 'the "regime"' + far, "us_major", 0.0),
    ]
    articles = spark.createDataFrame(rows, "article_id int, text string, tier string, headline double")
    got = {r.article_id: r for r in framing.framing_scores(articles, CHARGED).collect()}
    assert (got[1].emphasis, got[1].sourcing, got[1].framing) == (30.0, 10.0, round(0.2 * 12 + 0.8 * 18)) and got[6].emphasis == 15.0
    assert got[2].framing == 15
    assert got[3].sourcing == 15.0 and got[3].framing == round(0.004 * 12.25 + 0.996 * 25)
    assert got[4].emphasis == 100.0 and got[4].framing == round(100 * 0.45 + 1.5)
    assert got[5].sourcing == pytest.approx(30.0) and got[5].framing == round(0.15 * 30) == 4
    members = articles.select(F.lit(1).alias("cluster_id"), "article_id", F.when(F.col("article_id") == 5, F.array(F.lit("a"))).otherwise(F.array(F.lit("b"), F.lit("a"))).alias("entities"))
    assert {r.article_id: r.omission for r in framing.framing_scores(articles, CHARGED, members).collect()}[5] == 45.0
