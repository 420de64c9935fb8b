"""Lean: every hit discounted or not as a slow rule says, scores of single articles by hand, edge rows."""

import math
import random
import re

import pytest

from newsloom.operators import lean as L

TERMS = L.Terms((("tax relief", "right", 3.0), ("relief", "right", 1.0), ("welfare", "left", 2.0), ("said", "left", 1.0), ("red-tape", "right", 2.0)))
NAMES = tuple(t for t, _, _ in TERMS.rows)
SCHEMA = "article_id int, text string, baseline double, rated boolean, state boolean, topic_lean double"


def slow(low):
    spans = [m.span() for m in re.finditer(L.QUOTATION, low, re.DOTALL)]
    marks = [i for v in L.ATTRIBUTING for i in range(len(low)) if low.startswith(v, i)]
    out = set()
    for k, t in enumerate(NAMES):
        for m in re.finditer(re.escape(t) if " " in t else rf"\b{re.escape(t)}\b", low):
            out.add((k, m.start(), any(a <= m.start() and m.end() <= b for a, b in spans) or any(abs(m.start() - x) <= L.REACH for x in marks)))
    return out


def test_every_hit_as_the_slow_rule():
    rng = random.Random(7)
    pieces = ["tax relief", "relief", "welfare", " said ", "red-tape", '"', "'", "“", "”", "’", " ", " ", "é", "x" * 60, "\n", "according to", "_", "9", "\U0001f600"]
    met = set()
    for _ in range(1500):
        low = "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 25)))
        number, start, told = L.hits_of(low, NAMES)
        got = set(zip(number.tolist(), start.tolist(), told.tolist(), strict=True))
        assert got == slow(low), low
        met |= {t for _, _, t in got}
    assert met == {True, False}


def test_single_articles_by_hand(spark):
    far = " filler" * 30  # over 120 characters
    rows = [
        (1, "Welfare." + far, 50.0, True, False, None),
        (2, 'He said "welfare" again.' + far, 50.0, True, False, None),
        (3, None, 20.0, True, False, None),
        (4, "", None, None, None, None),
        (5, "tax relief and red-tape," + far * 6, 80.0, True, True, 40.0),
        (6, "tax relief" + far * 6, None, False, False, None),
    ]
    got = {r.article_id: r for r in L.article_lean(spark.createDataFrame(rows, SCHEMA), TERMS).collect()}
    logistic = lambda x: 1 / (1 + math.exp(-0.7 * (x - 4)))
    assert got[1].left_weight == 2.0 and got[1].keyword_score == pytest.approx(50 - 50 * logistic(1), abs=1e-6)
    assert got[2].left_weight == 1.5 and (got[2].n_terms, got[2].n_reported_only) == (2, 2) and got[2].keyword_score == pytest.approx(50 - 50 * logistic(1), abs=1e-6)
    assert (got[3].lean, got[3].keyword_score, got[4].lean, got[4].unscored) == (20, 50.0, 50, False)
    assert got[5].right_weight == 6.0 and got[5].lean == round(80 * 0.7 + 40 * 0.3 + min(8, 50 * logistic(3)))
    assert got[6].unscored and got[6].lean == round(50 + min(24, 50 * logistic(2)))


def test_terms_are_checked():
    for bad in ((), (("a", "up", 1.0),), (("a", "left", 1.0), ("a", "right", 1.0)), (("", "left", 1.0),)):
        with pytest.raises(ValueError):
            L.Terms(bad)


def test_terms_of_outlets(spark):
    rows = [("welfare for all the people", 10.0)] * 6 + [("relief for all", 90.0)] * 6 + [("nothing", 50.0)] * 9 + [(None, 10.0)]
    terms = L.outlet_terms(spark.createDataFrame(rows, "text string, baseline double"), most=3, least=5)
    assert {(t, s) for t, s, _ in terms.rows} >= {("welfare", "left"), ("relief", "right")} and all(t != "nothing" for t, _, _ in terms.rows)
