"""Claims of a story held against each other: groups of alike claims, their status, and a summary of each story."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType
from pyspark.sql.window import Window

from newsloom.functions.text import words
from newsloom.operators.clustering import DIGITS, pairs_by_prefix
from newsloom.operators.graph import connected_components
from newsloom.operators.linkage import close_pairs, products, roots, tied
from newsloom.shared import materialise

# Similarity of alike claims, that of claims on one entity, the difference of numbers that conflict and the scale they share.
ALIKE, ALIKE_ON_ENTITY, APART, SCALE = 0.65, 0.30, 0.20, 100.0
# Numbers conflict from a ratio over 1 / (1 - APART) on, up to SCALE: as logarithms, with room for their rounding.
_NEAR, _FAR = -math.log(1 - APART) + 1e-12, math.log(SCALE) + 1e-12
#: Characters of a story up to which one task groups its claims.
LARGE = 4_000_000
# Words that negate, and verbs that contradict each other.
NEGATIONS = ["not", "no", "never", "neither", "nor", "without"]
OPPOSITES = [
    ("confirmed", "denied"), ("approved", "rejected"), ("agreed", "disagreed"), ("accepted", "refused"), ("supported", "opposed"), ("advanced", "retreated"),
    ("increased", "decreased"), ("rose", "fell"), ("gained", "lost"), ("allowed", "banned"), ("released", "detained"), ("survived", "died"),
]


def claim_groups(claims: DataFrame, stopwords: list[str] = (), large: int = LARGE) -> DataFrame:
    """`claims` with `group_id`, the least claim_id of the claims that links reach, and `alone`: true only in a group of one claim.

    `claims` (cluster_id, claim_id, source_id, entity, text), claim_id unique. Claims of one story and different outlets link if the
    cosine of their TF-IDF (of the story's claims) is at least `ALIKE`, or `ALIKE_ON_ENTITY` with one entity, blanks and case aside.
    Claims with a null story, outlet or text, or without a word, stay alone.

    Claims are shuffled once, by their story, which a task groups. Only stories of over `large` characters, of which few can be, take joins
    over all tasks. `large` does not affect the groups.
    """
    known = F.col("cluster_id").isNotNull() & F.col("source_id").isNotNull() & F.col("text").isNotNull()
    entity = F.lower(F.trim(F.coalesce("entity", F.lit(""))))
    tokens = F.filter(words(F.col("text")), lambda w: (F.length(w) >= 2) & ~w.isin(list(stopwords)))
    told = claims.where(known)
    big = materialise(told.groupBy("cluster_id").agg(F.sum(F.length("text")).alias("n")).where(F.col("n") > large).select("cluster_id"), "large-stories")
    dealt = told.join(F.broadcast(big), "cluster_id", "left_anti").repartition("cluster_id").withColumns({"topic": entity, "tokens": tokens})
    schema = StructType([*claims.schema.fields, StructField("group_id", claims.schema["claim_id"].dataType), StructField("alone", BooleanType())])
    out = dealt.groupBy("cluster_id").applyInArrow(_of_story, schema)
    alone = claims.where(~known).withColumns({"group_id": F.col("claim_id"), "alone": F.lit(True)})
    out = out.unionByName(alone)
    if big.limit(1).count():
        wide = told.join(F.broadcast(big), "cluster_id", "left_semi")
        out = out.unionByName(_groups_by_joins(wide, entity, tokens).withColumn("alone", F.lit(False)))
    return out


def _of_story(table: pa.Table) -> pa.Table:
    """A story's claims (.., topic, tokens) with their group_id, and whether they are alone in it. Equal claims are one node."""
    lists = table.column("tokens").combine_chunks()
    flat = lists.flatten().dictionary_encode()
    codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)).tolist()
    ids = table.column("claim_id").to_numpy()
    outlet = np.unique(table.column("source_id").to_numpy(), return_inverse=True)[1]
    topics, topic = np.unique(table.column("topic").to_numpy().astype(str), return_inverse=True)
    names: dict[tuple[int, bytes], int] = {}
    node, sample, start = np.empty(len(ids), np.int64), [], 0
    for k, (t, end) in enumerate(zip(topic.tolist(), ends, strict=True)):
        node[k] = names.setdefault((t, codes[start:end].tobytes()), len(names))
        if node[k] == len(sample):
            sample.append((start, end, k))
        start = end
    n = len(sample)
    first, last, least = np.full(n, len(ids)), np.full(n, -1), np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(first, node, outlet)
    np.maximum.at(last, node, outlet)
    np.minimum.at(least, node, ids)
    spans = [codes[i:j] for i, j, _ in sample]
    entry = np.repeat(np.arange(n), [len(x) for x in spans])
    cells, tf = np.unique(entry * max(1, len(flat.dictionary)) + (np.concatenate(spans) if spans else codes), return_counts=True)
    entry, term = np.divmod(cells, max(1, len(flat.dictionary)))
    df = np.bincount(term, np.bincount(node, minlength=n)[entry], minlength=len(flat.dictionary))
    weight = tf * (np.log((1 + len(ids)) / (1 + df[term])) + 1)
    weight /= np.sqrt(np.bincount(entry, weight * weight, minlength=n))[entry]
    vectors = np.concatenate([[0], np.cumsum(np.bincount(entry, minlength=n))]), term, weight
    about = topic[[k for _, _, k in sample]]
    blank = np.flatnonzero(topics == "")
    top = np.arange(n)
    for row, values in products(vectors, vectors):
        a, b = close_pairs(values, ALIKE_ON_ENTITY)
        cosine, a = np.round(values[a, b], DIGITS), a + row
        linked = (a < b) & (np.minimum(first[a], first[b]) != np.maximum(last[a], last[b])) & ((cosine >= ALIKE) | (about[a] == about[b]) & ~np.isin(about[a], blank))
        linked &= top[a] != top[b]
        if linked.any():
            parent = top.tolist()
            for x, y in zip(a[linked].tolist(), b[linked].tolist(), strict=True):
                tied(parent, x, y)
            top = roots(parent)
    # a node that links, or has a word and two outlets, is a group; the claims of another are each their own
    words_in = np.bincount(entry, minlength=n) > 0
    grouped = (np.bincount(top, minlength=n)[top] > 1) | (first != last) & words_in
    named = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(named, top, least)
    group = np.where(grouped[node], named[top[node]], ids)
    alone = np.unique(group, return_inverse=True, return_counts=True)
    kept = table.drop_columns(["topic", "tokens"])
    return kept.append_column("group_id", pa.array(group).cast(kept.schema.field("claim_id").type)).append_column("alone", pa.array(alone[2][alone[1]] == 1))


def _groups_by_joins(known: DataFrame, entity: Column, tokens: Column) -> DataFrame:
    """`known` with the same group_id by joins over all tasks: equal claims are one node, which knows its least and greatest outlet, so
    copies make no pairs; nodes meet by an exact prefix filter within their story."""
    rows = known.select("cluster_id", "claim_id", "source_id", entity.alias("topic"), tokens.alias("tokens"))
    same = ["cluster_id", "topic", "tokens"]
    nodes = materialise(rows.groupBy(*same).agg(F.min("claim_id").alias("node"), F.count("*").alias("copies"), F.min("source_id").alias("first"), F.max("source_id").alias("last")), "claim-nodes")
    sizes = nodes.groupBy("cluster_id").agg(F.sum("copies").alias("n"))
    tf = F.transform(F.array_distinct("tokens"), lambda t: F.struct(t.alias("term"), F.size(F.filter("tokens", lambda u: u == t)).alias("tf")))
    bags = nodes.select("cluster_id", "node", "copies", F.explode(tf).alias("bag")).join(sizes, "cluster_id")
    # the terms of all claims are shuffled twice: by term for its frequencies, by node for the length and the order
    term, node = Window.partitionBy("cluster_id", "bag.term"), Window.partitionBy("node")
    idf = F.ln((1 + F.col("n")) / (1 + F.sum("copies").over(term))) + 1
    raw = bags.select("node", "cluster_id", F.col("bag.term").alias("term"), (F.col("bag.tf") * idf).alias("w"), F.count("*").over(term).alias("df"))
    square, order = F.col("w") * F.col("w"), node.orderBy(F.desc("df"), F.desc("term"))
    whole = raw.select(F.col("node").alias("article_id"), F.struct("cluster_id", "term").alias("term"), "df", (F.col("w") / F.sqrt(F.sum(square).over(node))).alias("weight"), (F.sum(square).over(order) / F.sum(square).over(node)).alias("rest"))
    ends = nodes.select(F.col("node").alias("article_id"), "topic", "first", "last")
    pairs = pairs_by_prefix(materialise(whole, "claim-terms"), ALIKE_ON_ENTITY).join(ends, "article_id").join(ends.select(*(F.col(c).alias("other_id" if c == "article_id" else f"other_{c}") for c in ends.columns)), "other_id")
    linked = pairs.where((F.least("first", "other_first") != F.greatest("last", "other_last")) & ((F.col("cosine") >= ALIKE) | ((F.col("topic") == F.col("other_topic")) & (F.col("topic") != ""))))
    found = connected_components(linked.select(F.col("article_id").alias("src"), F.col("other_id").alias("dst")))
    named = nodes.where(F.size("tokens") > 0).join(found, "node", "left").select(*same, F.coalesce("component", F.when(F.col("first") != F.col("last"), F.col("node"))).alias("group_id"))
    grouped = rows.join(named, same).select("claim_id", "group_id")
    return known.join(grouped, "claim_id", "left").select(*known.columns, F.coalesce("group_id", "claim_id").alias("group_id"))


def verified_groups(grouped: DataFrame) -> DataFrame:
    """(cluster_id, group_id, n_claims, source_count, status, conflict, canonical_id): status single_source, corroborated or disputed.

    `grouped` is what `claim_groups` gives. A group of two outlets and more is disputed if two claims of different outlets conflict:
    one negates otherwise than the other, they use opposite verbs, or have numbers over 20 % apart on one scale (0 conflicts with all
    others). All three are decided by aggregates of a group's outlets, words and numbers, so its claims form no pairs. `conflict` is
    negation before numeric, else null; canonical_id is the longest claim, ties to the least id.
    """
    key = ["cluster_id", "group_id"]
    if "alone" in grouped.columns:  # a group of one claim is not shuffled
        one = grouped.where("alone").select(*key, F.lit(1).cast("long").alias("n_claims"), F.col("source_id").isNotNull().cast("long").alias("source_count"), F.lit("single_source").alias("status"), F.lit(None).cast("string").alias("conflict"), F.col("claim_id").alias("canonical_id"))
        return verified_groups(grouped.where("not alone").drop("alone")).unionByName(one)
    tokens = F.split(F.lower("text"), r"[ \t\n\r]+")
    by = grouped.groupBy(*key).agg(
        F.count("*").alias("n_claims"), F.count_distinct("source_id").alias("source_count"), F.min_by("claim_id", F.struct(-F.coalesce(F.length("text"), F.lit(0)), F.col("claim_id"))).alias("canonical_id"),
        F.count_distinct(F.array_sort(F.array_intersect(tokens, F.array(*map(F.lit, NEGATIONS))))).alias("negations"),
    )
    side = F.create_map(*(F.lit(x) for k, (a, b) in enumerate(OPPOSITES) for x in (a, 2 * k, b, 2 * k + 1)))
    verbs = grouped.select(*key, "source_id", F.explode(F.filter(F.transform(tokens, lambda w: F.element_at(side, w)), lambda x: x.isNotNull())).alias("verb"))
    opposed = verbs.groupBy(*key, F.floor(F.col("verb") / 2).alias("pair")).agg(F.count_distinct("verb").alias("sides"), (F.min("source_id") != F.max("source_id")).alias("apart")).where("sides = 2 AND apart").select(*key, F.lit(True).alias("opposed")).distinct()
    found = F.filter(F.transform(F.regexp_extract_all("text", F.lit(r"[\d,]+\.?\d*"), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double")), lambda x: x.isNotNull())
    numbers = grouped.select(*key, "source_id", F.explode(F.array_distinct(found)).alias("x")).where("source_id IS NOT NULL").groupBy(*key, "x").agg(F.min("source_id").alias("first"), F.max("source_id").alias("last"))
    frame = f"OVER (PARTITION BY cluster_id, group_id ORDER BY CASE WHEN x > 0 THEN ln(x) END RANGE BETWEEN {_NEAR!r} FOLLOWING AND {_FAR!r} FOLLOWING)"
    ahead = numbers.where("x > 0").withColumns({"low": F.expr(f"min(first) {frame}"), "high": F.expr(f"max(last) {frame}")}).where("low IS NOT NULL AND least(first, low) <> greatest(last, high)")
    zero = numbers.groupBy(*key).agg(F.count_if(F.col("x") == 0).alias("zeros"), F.count("*").alias("all"), F.min("first").alias("low"), F.max("last").alias("high")).where("zeros > 0 AND all > zeros AND low <> high")
    numeric = ahead.select(*key).unionByName(zero.select(*key)).distinct().withColumn("numeric", F.lit(True))
    rows = by.join(opposed, key, "left").join(numeric, key, "left")
    several = F.col("source_count") >= 2
    conflict = F.when(several & ((F.col("negations") > 1) | F.col("opposed")), "negation").when(several & F.col("numeric"), "numeric")
    status = F.when(~several, "single_source").when(conflict.isNotNull(), "disputed").otherwise("corroborated")
    return rows.select(*key, "n_claims", "source_count", status.alias("status"), conflict.alias("conflict"), "canonical_id")


def consensus(groups: DataFrame) -> DataFrame:
    """(cluster_id, total, corroborated, single_source, disputed, ratio) of each story; groups without a story are left out."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    by = groups.where(F.col("cluster_id").isNotNull()).groupBy("cluster_id").agg(F.count("*").alias("total"), n("corroborated"), n("single_source"), n("disputed"))
    return by.withColumn("ratio", F.round(F.col("corroborated") / F.col("total"), 3))
