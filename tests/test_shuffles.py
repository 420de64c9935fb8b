"""What the joins and sums of clusters shuffle."""

from newsloom.operators import enrichment, joins


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stale_pairs_are_counted_where_they_are_made(spark):
    old = spark.createDataFrame([(1, k) for k in range(4)] + [(2, 9)], "cluster_id long, article_id long")
    new = spark.createDataFrame([(7, 0), (7, 1), (8, 2), (9, 9), (9, 0)], "cluster_id long, article_id long")
    got = joins.stale_clusters(old, new, 0.3)
    assert {tuple(r) for r in got.select("cluster_id", "new_id", "common", "size").collect()} == {(1, 7, 2, 4), (2, 9, 1, 1)}
    assert not any("hashpartitioning(cluster_id" in line and "new_id" in line.split("hashpartitioning", 1)[1].split(")")[0] for line in plan(got).splitlines())


def test_bias_summary_shuffles_scores_not_sums(spark):
    rows = spark.createDataFrame([(1, 10, 20, 30, 40, 50, 0.5, False), (1, 20, 20, 30, 40, 50, None, True)], "cluster_id long, lean int, sensationalism int, opinion int, rigor int, framing int, confidence double, lean_unscored boolean")
    found = enrichment.bias_summary(rows)
    text = plan(found)
    assert [r.avg_lean for r in found.collect()] == [10.0] and text.index("HashAggregate") < text.index("Exchange") and "Aggregate" not in text[text.index("Exchange") :]
