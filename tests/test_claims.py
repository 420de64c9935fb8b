"""Claims held against each other, against all pairs one by one."""

import math
import random
import re
from collections import Counter

from newsloom.operators import claims as C
from newsloom.operators import clustering

SCHEMA = "cluster_id int, claim_id int, source_id string, entity string, text string"


def tokens(text):
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if len(w) >= 2]


def numbers(text):
    return [float(x.replace(",", "")) for x in re.findall(r"[\d,]+\.?\d*", text) if x.replace(",", "").strip(".")]


def conflict(a, b):
    wa, wb = set(a.lower().split()), set(b.lower().split())
    if wa & set(C.NEGATIONS) != wb & set(C.NEGATIONS) or any((x in wa and y in wb) or (y in wa and x in wb) for x, y in C.OPPOSITES):
        return "negation"
    for x in numbers(a):
        for y in numbers(b):
            high, low = max(x, y), min(x, y)
            if high > 0 and (low == 0 or high / low <= 100) and (high - low) / high > 0.2:
                return "numeric"
    return None


def slow(rows):
    """(group of each claim, (status, conflict) of each group) by all pairs of a story."""
    label = {r[1]: r[1] for r in rows}
    for c in {r[0] for r in rows if r[0] is not None}:
        mine = [r for r in rows if r[0] == c and r[2] is not None and r[4] is not None]
        df = Counter(t for r in mine for t in set(tokens(r[4])))
        vectors = {}
        for r in mine:
            w = {t: k * (math.log((1 + len(mine)) / (1 + df[t])) + 1) for t, k in Counter(tokens(r[4])).items()}
            norm = math.sqrt(sum(x * x for x in w.values()))
            vectors[r[1]] = {t: x / norm for t, x in w.items()}
        for r in mine:
            for s in mine:
                cosine = round(sum(x * vectors[s[1]].get(t, 0) for t, x in vectors[r[1]].items()), 9)
                one = (r[3] or "").strip().lower() == (s[3] or "").strip().lower() != ""
                if r[2] != s[2] and (cosine >= 0.65 or (cosine >= 0.30 and one)):
                    a, b = sorted((label[r[1]], label[s[1]]))
                    label = {k: a if v == b else v for k, v in label.items()}
    status = {}
    for g in set(label.values()):
        group = [r for r in rows if label[r[1]] == g]
        kinds = {conflict(r[4], s[4]) for r in group for s in group if r[2] != s[2] and r[2] and s[2]} - {None}
        kind = min(kinds) if kinds else None
        status[g] = ("single_source", None) if len({r[2] for r in group if r[2]}) < 2 else ("disputed", kind) if kind else ("corroborated", None)
    return label, status


def test_groups_and_status_as_with_all_pairs(spark):
    rng = random.Random(11)
    pool = ["mayor", "budget", "approved", "rejected", "rose", "not", "bridge", "100", "1,250", "125", "0", "12.5", "percent", "council", "river"]
    rows = [(k % 6, k, rng.choice("ABC"), rng.choice(["Mayor", " mayor", "", None]), " ".join(rng.choice(pool) for _ in range(rng.randrange(2, 7)))) for k in range(240)]
    rows += [(0, 300 + k, "AB"[k % 2 if k < 6 else 0], "", "bridge closed over the river") for k in range(12)] + [(1, 400 + k, "A", None, "same outlet twice") for k in range(2)]
    rows += [(None, 500, "A", "", "bridge"), (2, 501, None, "", "bridge"), (2, 502, "A", "", None), (2, 503, "B", "", ""), (2, 504, "C", "", "!")]
    label, status = slow(rows)
    grouped = C.claim_groups(spark.createDataFrame(rows, SCHEMA)).cache()
    assert {r.claim_id: r.group_id for r in grouped.collect()} == label
    got = C.verified_groups(grouped).collect()
    assert {r.group_id: (r.status, r.conflict) for r in got} == status
    assert {s for s, _ in status.values()} == {"single_source", "corroborated", "disputed"} and {k for _, k in status.values()} == {None, "negation", "numeric"}
    total = C.consensus(C.verified_groups(grouped)).collect()
    assert sum(r.total for r in total) == sum(1 for g in got if g.cluster_id is not None)


def test_no_claims(spark):
    assert C.verified_groups(C.claim_groups(spark.createDataFrame([], SCHEMA))).count() == 0


def test_pairs_of_stored_vectors(spark):
    vectors = {1: {"a": 0.6, "b": 0.8}, 2: {"a": 0.6, "b": 0.8}, 3: {"a": 1.0}, 4: {"b": 0.6, "c": 0.8}}
    df = {"a": 3, "b": 3, "c": 1}
    rows = []
    for k, v in vectors.items():
        rest = 0.0
        for t in sorted(v, key=lambda t: (df[t], t), reverse=True):
            rest += v[t] ** 2
            rows.append((k, t, v[t], df[t], rest))
    found = clustering.pairs_by_prefix(spark.createDataFrame(rows, "article_id int, term string, weight double, df int, rest double"), 0.3)
    want = {(a, b): round(sum(vectors[a][t] * vectors[b].get(t, 0) for t in vectors[a]), 9) for a in vectors for b in vectors if a < b}
    assert {(r.article_id, r.other_id): r.cosine for r in found.collect()} == {k: v for k, v in want.items() if v >= 0.3}


def test_stories_by_joins_and_in_tasks_give_the_same_groups(spark):
    rng = random.Random(13)
    pool = ["mayor", "budget", "approved", "rose", "bridge", "100", "council", "river", "!", "a"]
    rows = [(k % 4, k, rng.choice("ABC"), rng.choice(["Mayor", "mayor ", "", None]), " ".join(rng.choice(pool) for _ in range(rng.randrange(0, 6)))) for k in range(160)]
    rows += [(4, 900 + k, "AB"[k % 2], "", "the bridge") for k in range(300)] + [(None, 300, "A", "", "bridge"), (2, 301, None, "", "bridge"), (2, 302, "A", "", None), (5, 303, "A", "", "")]
    claims = spark.createDataFrame(rows, SCHEMA)
    groups = lambda large: {r.claim_id: r.group_id for r in C.claim_groups(claims, large=large).collect()}
    assert groups(C.LARGE) == groups(4000) == groups(0) and len(groups(0)) == len(rows)
    counts = Counter(groups(C.LARGE).values())
    assert {r.claim_id: r.alone for r in C.claim_groups(claims).collect()} == {k: counts[g] == 1 for k, g in groups(C.LARGE).items()}


def test_claims_are_shuffled_once(spark):
    claims = spark.createDataFrame([(1, k, "AB"[k % 2], "", "bridge closed over the river") for k in range(6)], SCHEMA).repartition(2)
    plan = C.claim_groups(claims)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(") == 1 and "Join" not in plan.replace("BroadcastHashJoin", "")
