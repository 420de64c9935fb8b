"""Nested event documents as variants: parent and child tables, edges in both directions, and whole events put together again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.operators.selection import best_per_key
from newsloom.shared import materialise

_PARENT = {"title": "string", "era": "string", "region": "string", "category": "string", "date_sort": "int", "date_start": "string", "display_order": "int"}
_VIEW = {"viewpoint": "string", "viewpoint_type": "string", "region_origin": "string", "narrative": "string"}
_MEDIUM = {"media_type": "string", "title": "string", "description": "string", "thumbnail_url": "string", "attribution": "string", "creator": "string", "width": "int", "height": "int"}


def _get(v: str | Column, path: str, kind: str) -> Column:
    return F.try_variant_get(F.col(v) if isinstance(v, str) else v, f"$.{path}", kind)


def latest_documents(lines: DataFrame, text: str, order: list[Column]) -> DataFrame:
    """(slug, doc): the first document of each slug by `order`, ties to the greater text, as a variant.

    Texts that are null, no JSON, or without a slug are left out. A later document takes the place of an earlier one with all its
    children. Keys that no table names stay in `doc`, and numbers stay whole or fractions as they were written. Only texts are shuffled.
    """
    docs = lines.withColumn("slug", _get(F.try_parse_json(text), "slug", "string")).where("slug IS NOT NULL")
    return best_per_key(docs, ["slug"], [*order, F.desc(text)]).select("slug", F.parse_json(text).alias("doc"))


def children(docs: DataFrame, name: str) -> DataFrame:
    """(slug, place, item): the elements of the array `name` of every document, from 0; no rows where it is missing or no array."""
    return docs.select("slug", F.posexplode(_get("doc", name, "array<variant>")).alias("place", "item"))


def _fields(v: str | Column, kinds: dict[str, str]) -> list[Column]:
    return [_get(v, c, k).alias(c) for c, k in kinds.items()]


def _view(item: str | Column, place: Column) -> list[Column]:
    """The columns of a perspective that stands at `place`."""
    return [*_fields(item, _VIEW), F.coalesce(_get(item, "display_order", "int"), place).alias("display_order"), _get(item, "key_arguments", "array<string>").alias("key_arguments")]


def _medium(item: str | Column, place: Column) -> list[Column]:
    """The columns of a medium that stands at `place`."""
    url = F.coalesce(_get(item, "supabase_url", "string"), _get(item, "source_url", "string")).alias("source_url")
    licence = F.coalesce(_get(item, "license", "string"), F.lit("public-domain")).alias("license")
    return [*_fields(item, _MEDIUM), url, licence, F.coalesce(_get(item, "display_order", "int"), place).alias("display_order")]


def event_tables(docs: DataFrame) -> dict[str, DataFrame]:
    """Tables of documents (slug unique, doc): events, perspectives, media, metrics, connections.

    Values of another kind than their column's are null. Events are published unless they say otherwise; children stand in the order
    that they give, else as they are written. Each pair of events is connected once a kind, by the first such entry; targets that no
    document describes are left out. A metric keeps its value as a variant and also as a number.
    """
    published = F.coalesce(_get("doc", "is_published", "boolean"), F.lit(True)).alias("is_published")
    edges = children(docs, "connections").select(F.col("slug").alias("src"), "place", _get("item", "target_slug", "string").alias("dst"), _get("item", "connection_type", "string").alias("kind"), _get("item", "description", "string").alias("description"))
    known = edges.join(docs.select(F.col("slug").alias("dst")), "dst", "left_semi")
    return {
        "events": docs.select("slug", *_fields("doc", _PARENT), published, "doc"),
        "perspectives": children(docs, "perspectives").select("slug", "place", *_view("item", F.col("place"))),
        "media": children(docs, "media").select("slug", "place", *_medium("item", F.col("place"))),
        "metrics": children(docs, "metrics").select("slug", "place", _get("item", "name", "string").alias("name"), _get("item", "value", "variant").alias("value"), _get("item", "value", "double").alias("number")),
        "connections": best_per_key(known.withColumnRenamed("place", "entry"), ["src", "dst", "kind"], [F.col("entry")]).select("src", "dst", "kind", "description"),
    }


def both_ways(connections: DataFrame) -> DataFrame:
    """(slug, other, kind, description, reverse): every connection at both of its ends."""
    ends = lambda a, b, back: connections.select(F.col(a).alias("slug"), F.col(b).alias("other"), "kind", "description", F.lit(back).alias("reverse"))
    return ends("src", "dst", False).unionByName(ends("dst", "src", True))


def assembled(tables: dict[str, DataFrame]) -> DataFrame:
    """Published events with their arrays `perspectives` and `media` in display order and `connections`, own ones before reverse ones.

    Connections carry the title of the other event, published or not. Events without children have empty arrays.
    """

    def gathered(rows: DataFrame, name: str, order: list[str]) -> DataFrame:
        inner = [c for c in rows.columns if c not in ("slug", *order)]
        return rows.groupBy("slug").agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, *inner))), lambda s: s.dropFields("place") if "place" in order else s).alias(name))

    titles = tables["events"].select(F.col("slug").alias("other"), F.col("title").alias("other_title"))
    linked = both_ways(tables["connections"]).join(titles, "other")
    out = tables["events"].where("is_published")
    for name, rows, order in (("perspectives", tables["perspectives"], ["display_order", "place"]), ("media", tables["media"], ["display_order", "place"]), ("connections", linked, ["reverse", "other", "kind"])):
        found = gathered(rows, name, order)
        out = out.join(found, "slug", "left").withColumn(name, F.coalesce(name, F.array().cast(found.schema[name].dataType)))
    return out


def with_children(docs: DataFrame) -> DataFrame:
    """Every document's event with its arrays `perspectives` and `media` in display order, as `assembled` has them: made in its row, so nothing is shuffled."""

    def ordered(name: str, columns: Callable[[Column, Column], list[Column]]) -> Column:
        placed = F.transform(_get("doc", name, "array<variant>"), lambda v, k: F.struct(F.coalesce(_get(v, "display_order", "int"), k).alias("display_order"), k.alias("place"), F.struct(*columns(v, k)).alias("row")))
        return F.coalesce(F.transform(F.sort_array(placed), lambda s: s["row"]), F.array()).alias(name)

    events = event_tables(docs)["events"]
    return events.select("*", ordered("perspectives", _view), ordered("media", _medium))


def connections_of(docs: DataFrame) -> DataFrame:
    """(slug, connections) of the events that have some, as `assembled` has them: own ones before reverse ones, each with the other event's title.

    Repeated entries are dropped in their document, and an edge meets its target and the target's title in one join.
    """
    entries = F.transform(_get("doc", "connections", "array<variant>"), lambda v: F.struct(_get(v, "target_slug", "string").alias("dst"), _get(v, "connection_type", "string").alias("kind"), _get(v, "description", "string").alias("description")))
    titled = docs.select("slug", _get("doc", "title", "string").alias("title"), entries.alias("entries"))
    keys = F.transform("entries", lambda e: F.struct(e["dst"], e["kind"]))
    first = F.filter("entries", lambda e, k: e["dst"].isNotNull() & (F.array_position("keys", F.struct(e["dst"], e["kind"])) == k + 1))
    edges = titled.withColumn("keys", keys).select(F.col("slug").alias("src"), F.col("title").alias("src_title"), F.explode(first).alias("e")).select("src", "src_title", "e.*")
    both = edges.join(titled.select(F.col("slug").alias("dst"), F.col("title").alias("dst_title")), "dst")
    end = lambda a, b, back: F.struct(F.col(a).alias("slug"), F.lit(back).alias("reverse"), F.col(b).alias("other"), "kind", "description", F.col(f"{b}_title").alias("other_title"))
    ends = both.select(F.explode(F.array(end("src", "dst", False), end("dst", "src", True))).alias("c"))
    return ends.groupBy(F.col("c.slug").alias("slug")).agg(F.transform(F.sort_array(F.collect_list("c")), lambda c: c.dropFields("slug")).alias("connections"))


def in_order(events: DataFrame, by: str | None = None, keys: tuple[str, ...] = ("date_sort",)) -> DataFrame:
    """`events` with `place` from 1 by `keys`, nulls last, then slug, within each value of `by` (era, region) if that is given.

    The events are dealt by ranges of that order, written, and counted within their range after what the earlier ranges hold: no
    task holds all events of a value.
    """
    order = [F.asc_nulls_last(k) for k in keys] + [F.col("slug")]
    first = [] if by is None else [by]
    dealt = materialise(events.repartitionByRange(*(F.asc_nulls_last(c) for c in first), *order).withColumn("part", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("part", *first).agg(F.count("*").alias("n"))  # a row for each range and value
    earlier = counts.withColumn("earlier", F.sum("n").over(Window.partitionBy(*first).orderBy("part")) - F.col("n")).select(F.col("part").alias("in_part"), *(F.col(c).alias(f"in_{c}") for c in first), "earlier")
    ranked = dealt.withColumn("within", F.row_number().over(Window.partitionBy("part", *first).orderBy(*order)))
    same = F.col("part") == F.col("in_part")
    for c in first:
        same = same & F.col(c).eqNullSafe(F.col(f"in_{c}"))
    return ranked.join(F.broadcast(earlier), same).withColumn("place", (F.col("earlier") + F.col("within")).cast("int")).select(*events.columns, "place")
