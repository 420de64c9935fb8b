"""Readers of feeds, outlet lists, nested documents and tables, and the latest-wins sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators.joins import upsert
from newsloom.operators.selection import best_per_key
from newsloom.shared import replace_table

OUTLETS = "slug string, name string, url string, tier string, country string, political_lean_baseline string, rss_url string"
#: Accepted forms of a time; fixtures leave the seconds out.
TIMES = ["yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd'T'HH:mmX", "yyyy-MM-dd HH:mm:ss", "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z"]
#: Links that lead to no article.
JUNK_LINK = r"(?i)/(login|signin|subscribe|newsletter|podcasts?|video|live|photos?|games|horoscopes?)(/|$|[?#])"


def parse_time(text):
    """The first form that fits, else null. Of a feed's form the weekday is not read, and names of universal time count as +0000."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(text), "^[A-Za-z]{3,9}, *", ""), " (GMT|UTC|UT|Z)$", " +0000")
    return F.coalesce(*(F.try_to_timestamp(plain, F.lit(f)) for f in TIMES))


def outlets(spark: SparkSession, path: str, editions: dict[str, list[str]] | None = None, edition: str = "world") -> DataFrame:
    """Outlets of a JSON file; an edition takes its countries, and world those of no edition."""
    rows = spark.read.schema(OUTLETS).option("multiLine", True).json(path)
    if not editions:
        return rows
    if edition != "world":
        return rows.where(F.upper("country").isin(editions[edition]))
    mapped = [c for countries in editions.values() for c in countries]
    return rows.where(~F.upper("country").isin(mapped) | F.col("country").isNull())


def feed_entries(spark: SparkSession, path: str, per_feed: int = 30, now: str | None = None, max_days: int = 2) -> DataFrame:
    """The first entries of each RSS file under `path`, as they stand in it: (feed, title, link, description, published).

    Titles of under ten characters and links to sections without articles are left out, and with `now` also entries of more than
    `max_days` before it; entries without a readable time stay.
    """
    schema = "title string, link string, description string, pubDate string"
    rows = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)
    rows = rows.select("*", F.col("_metadata.file_path").alias("feed"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("place"))
    rows = rows.where((F.length("title") >= 10) & ~F.coalesce(F.col("link").rlike(JUNK_LINK), F.lit(False)))
    if now is not None:
        rows = rows.where(F.coalesce(parse_time(F.col("pubDate")) >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(max_days)} DAYS"), F.lit(True)))
    kept = best_per_key(rows.withColumnRenamed("place", "stands"), ["feed"], [F.col("stands")], per_feed)
    return kept.select("feed", "title", "link", F.substring("description", 1, 1000).alias("description"), F.col("pubDate").alias("published"))


def nested_events(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Parent and child tables of JSON event documents: events, perspectives, connections (unknown targets left out)."""
    schema = "slug string, title string, date_sort int, region string, category string, perspectives array<struct<viewpoint string, narrative string>>, connections array<struct<target_slug string, connection_type string>>"
    docs = spark.read.schema(schema).json(path)
    events = docs.drop("perspectives", "connections")
    views = docs.select("slug", F.posexplode("perspectives").alias("place", "p")).select("slug", "place", "p.*")
    edges = docs.select("slug", F.explode("connections").alias("c")).select(F.col("slug").alias("src"), F.col("c.target_slug").alias("dst"), F.col("c.connection_type").alias("kind"))
    return {"events": events, "perspectives": views, "connections": edges.join(events.select(F.col("slug").alias("dst")), "dst", "left_semi")}


def write_latest(spark: SparkSession, path: str, changes: DataFrame, keys: list[str]) -> None:
    """Merge `changes` into the table under `path`; the merged table takes its place only when it is written in full."""
    replace_table(upsert(spark.read.parquet(path), changes, keys), path)
