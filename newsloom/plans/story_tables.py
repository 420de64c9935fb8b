"""The story model over the driver's tables: clusters are orders, their members line items, outlets suppliers.

Each function gives a DataFrame; the SQL text of the same name gives the same rows in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The moment that stands for now in all registered queries.
AS_OF = "2001-11-05 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, slug, tier, country, region, baseline (0 to 100)."""
    supplier, nation, region = (table(spark, sf_dir, n) for n in ("supplier", "nation", "region"))
    tier = F.element_at(F.array(F.lit("us_major"), F.lit("international"), F.lit("independent")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    joined = supplier.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("slug"), tier.alias("tier"), F.col("n_name").alias("country"), F.col("r_name").alias("region"), (F.col("s_suppkey") % 5 * 25).cast("int").alias("baseline"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each article of a cluster with its scores."""
    item = table(spark, sf_dir, "lineitem")
    return item.select(
        F.col("l_orderkey").alias("cluster_id"),
        (F.col("l_orderkey") * 1_000_000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("article_id"),
        F.col("l_suppkey").alias("source_id"),
        F.round(F.col("l_discount") * 1000).cast("int").alias("lean"),
        F.round(F.col("l_tax") * 1000).cast("int").alias("sensationalism"),
        (F.col("l_quantity").cast("int") * 2).alias("rigor"),
        (F.col("l_partkey") % 101).cast("int").alias("framing"),
        (F.floor("l_extendedprice") % 101).cast("int").alias("opinion"),
        (F.col("l_partkey") % 10 / 10).alias("confidence"),
        (F.col("l_returnflag") == "A").alias("lean_unscored"),
        F.col("l_shipdate").alias("published_at"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("topic_id"),
    )


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cluster_id, category, created_at, rank (0 to 100), owner_id."""
    order = table(spark, sf_dir, "orders")
    return order.select(F.col("o_orderkey").alias("cluster_id"), F.col("o_orderpriority").alias("category"), F.col("o_orderdate").alias("created_at"), (F.floor(F.col("o_totalprice") * 7) % 10001 / 100).alias("rank"), F.col("o_custkey").alias("owner_id"), F.col("o_orderstatus").alias("status"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """article_id, title (first line, 80 characters at most), body, source, lang."""
    docs = table(spark, sf_dir, "documents")
    title = F.substring(F.split(F.col("text"), "\n", 2)[0], 1, 80)
    return docs.select(F.col("doc_id").alias("article_id"), title.alias("title"), F.col("text").alias("body"), "source", "lang")


SQL = {
    "sources": """
        SELECT s_suppkey AS source_id, s_name AS slug, (['us_major', 'international', 'independent'])[s_suppkey % 3 + 1] AS tier,
               n_name AS country, r_name AS region, CAST(s_suppkey % 5 * 25 AS INTEGER) AS baseline
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "members": """
        SELECT l_orderkey AS cluster_id, l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS article_id, l_suppkey AS source_id,
               CAST(round(l_discount * 1000) AS INTEGER) AS lean, CAST(round(l_tax * 1000) AS INTEGER) AS sensationalism,
               CAST(l_quantity AS INTEGER) * 2 AS rigor, CAST(l_partkey % 101 AS INTEGER) AS framing,
               CAST(floor(l_extendedprice)::BIGINT % 101 AS INTEGER) AS opinion, l_partkey % 10 / 10 AS confidence,
               l_returnflag = 'A' AS lean_unscored, l_shipdate AS published_at, l_linenumber AS line, l_partkey AS topic_id
        FROM lineitem""",
    "clusters": """
        SELECT o_orderkey AS cluster_id, o_orderpriority AS category, o_orderdate AS created_at,
               floor(o_totalprice * 7)::BIGINT % 10001 / 100 AS rank, o_custkey AS owner_id, o_orderstatus AS status
        FROM orders""",
    "articles": r"""
        SELECT doc_id AS article_id, substring(split_part(text, chr(10), 1), 1, 80) AS title, text AS body, source, lang FROM documents""",
}


def with_tables(sql: str, *names: str) -> str:
    """`sql` after a WITH clause for the named tables."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + " " + sql
