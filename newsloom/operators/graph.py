"""Connected components as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.shared import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: tie every neighbour of a node (its larger ones, or its smaller ones and itself) to the node's least neighbour."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    if not large:
        both = both.where("dst < src")
    least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("least"))
    near = both.join(least, "src")
    if large:
        tied = near.where("dst > src").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
    else:
        tied = near.where("dst <> least").select(F.col("dst").alias("src"), F.col("least").alias("dst")).unionByName(least.select("src", F.col("least").alias("dst")))
    return tied.where("src <> dst").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Columns (node, component) for every node of `edges` (src, dst: any one ordered type).

    A component is named by its least node. Alternating large-star and small-star steps: a step keeps
    the number of edges, and the number of rounds grows with the logarithm of the longest path.
    Self-loops and null ends are ignored, except that a node with only self-loops is its own component.
    """
    nodes = edges.where("src is not null and dst is not null").select("src", "dst")
    loops = nodes.where("src = dst").select(F.col("src").alias("node")).distinct()
    now = materialise(nodes.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        now = materialise(_star(_star(now, True), False), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    stars = now.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    roots = now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    found = stars.unionByName(roots)
    alone = loops.join(found.select("node"), "node", "left_anti").withColumn("component", F.col("node"))
    return found.unionByName(alone)
