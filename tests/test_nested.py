import json

from pyspark.sql import functions as F

from newsloom.sources import nested

A = {"slug": "a", "title": "A", "date_sort": -44, "odd": {"x": [1, 2.5]}, "metrics": [{"name": "m", "value": 3}, {"name": "m", "value": 3.25}, {"name": "m", "value": "many"}],
     "perspectives": [{"viewpoint": "late", "display_order": 5}, {"viewpoint": "first", "display_order": 0, "key_arguments": ["k"]}, {"viewpoint": "third"}],
     "media": [{"title": "t", "source_url": "s", "supabase_url": "u"}, {"title": "w", "source_url": "s", "width": "wide", "license": "cc"}],
     "connections": [{"target_slug": "b", "connection_type": "k", "description": "one"}, {"target_slug": "b", "connection_type": "k", "description": "two"}, {"target_slug": "gone", "connection_type": "k"}]}
B = {"slug": "b", "title": "B", "date_sort": 7, "is_published": False, "perspectives": None, "connections": [{"target_slug": "a", "connection_type": "back"}]}
C = {"slug": "c", "title": 9, "date_sort": "soon", "media": "none"}


def tables(spark, *lines):
    return nested.event_tables(nested.latest_documents(spark.createDataFrame(list(lines), "version int, line string"), "line", [F.desc("version")]))


def test_documents_are_taken_apart_and_put_together(spark):
    old = {**A, "title": "old", "media": A["media"] * 3}
    t = tables(spark, (2, json.dumps(A)), (1, json.dumps(old)), (1, json.dumps(B)), (1, json.dumps(C)), (1, None), (1, "{"), (1, "[]"), (1, "{}"))
    assert {(r.slug, r.title, r.date_sort, r.is_published) for r in t["events"].collect()} == {("a", "A", -44, True), ("b", "B", 7, False), ("c", "9", None, True)}
    kinds = t["metrics"].select("place", F.schema_of_variant("value").alias("kind"), "number").orderBy("place").collect()
    assert [tuple(r) for r in kinds] == [(0, "BIGINT", 3.0), (1, "DECIMAL(3,2)", 3.25), (2, "STRING", None)]
    assert t["events"].where("slug = 'a'").select(F.try_variant_get("doc", "$.odd.x[1]", "double")).first()[0] == 2.5
    assert {tuple(r) for r in t["connections"].collect()} == {("a", "b", "k", "one"), ("b", "a", "back", None)}
    found = {r.slug: r for r in nested.assembled(t).collect()}
    assert set(found) == {"a", "c"}
    assert [p.viewpoint for p in found["a"].perspectives] == ["first", "third", "late"] and found["a"].perspectives[0].key_arguments == ["k"]
    assert [(m.title, m.source_url, m.license, m.width) for m in found["a"].media] == [("t", "u", "public-domain", None), ("w", "s", "cc", None)]
    assert [(c.reverse, c.other, c.kind, c.other_title) for c in found["a"].connections] == [(False, "b", "k", "B"), (True, "b", "back", "B")]
    assert found["c"].perspectives == found["c"].media == found["c"].connections == []


def test_order_by_year_and_by_two_keys(spark):
    rows = spark.createDataFrame([("a", -5, 1, "x"), ("b", 3, 0, "x"), ("c", -5, 0, "y"), ("d", None, 0, None)], "slug string, date_sort int, display_order int, region string")
    places = lambda df: {r.slug: r.place for r in df.collect()}
    assert places(nested.in_order(rows)) == {"a": 1, "c": 2, "b": 3, "d": 4}
    assert places(nested.in_order(rows, keys=("display_order", "date_sort"))) == {"c": 1, "b": 2, "d": 3, "a": 4}
    assert places(nested.in_order(rows, "region")) == {"a": 1, "b": 2, "c": 1, "d": 1}


def test_empty(spark):
    t = tables(spark)
    assert nested.assembled(t).count() == nested.in_order(t["events"].drop("doc")).count() == 0


def test_places_by_value_come_from_many_tasks(spark, monkeypatch):
    kept = []
    materialise = nested.materialise
    monkeypatch.setattr(nested, "materialise", lambda df, label: kept.append(materialise(df, label)) or kept[-1])
    rows = spark.range(5000).select(F.concat(F.lit("e"), F.col("id")).alias("slug"), F.when(F.col("id") % 10 == 0, "b").when(F.col("id") % 10 < 9, "a").alias("region"), (F.col("id") % 7).cast("int").alias("date_sort"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.slug: r.place for r in nested.in_order(rows, "region").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert kept[0].select("part").distinct().count() > 1
    for region in ("a", "b", None):
        mine = sorted((k % 7, f"e{k}") for k in range(5000) if ("b" if k % 10 == 0 else "a" if k % 10 < 9 else None) == region)
        assert [got[s] for _, s in mine] == list(range(1, len(mine) + 1))


def test_events_made_in_their_row_are_those_of_the_tables(spark):
    odd = {"slug": "d", "title": "D", "connections": [{"target_slug": "a"}, {"target_slug": "a"}, {"target_slug": "d", "connection_type": "self"}, {"connection_type": "k"}, 5, {"target_slug": "a", "connection_type": "k"}],
           "perspectives": [{"viewpoint": "x", "display_order": 2}, 7, {"viewpoint": "y", "display_order": 1}, {"viewpoint": "z", "display_order": 1}]}
    docs = nested.latest_documents(spark.createDataFrame([(1, json.dumps(x)) for x in (A, B, C, odd)], "version int, line string"), "line", [F.desc("version")]).cache()
    children = nested.with_children(docs).where("is_published")
    got = {r.slug: r for r in children.join(nested.connections_of(docs), "slug", "left").collect()}
    want = {r.slug: r for r in nested.assembled(nested.event_tables(docs)).collect()}
    pick = lambda rows, keys: [tuple(r[k] for k in keys) for r in rows or []]
    for slug, r in want.items():
        for name in ("perspectives", "media", "connections"):
            keys = r[name][0].asDict() if r[name] else ()
            assert pick(got[slug][name], keys) == pick(r[name], keys), (slug, name)
    assert set(got) == set(want) == {"a", "c", "d"} and len(want["d"].connections) == 4
    plan = nested.with_children(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
