"""Political lean of articles: terms of either side by position, half weight in quotations and near attributions, anchored at the outlet.

The terms are the caller's, or learnt from outlets of known placement (`outlet_terms`). Texts are read once: a multi-pattern matcher gives
all positions of terms and attributions, quotations are spans, and each hit is looked up in both. No entity or sentiment model takes part.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import word_count

# Verbs that attribute, the pattern of a quotation, and how near a verb makes a hit reported speech.
ATTRIBUTING = (
    "said", "says", "stated", "told", "according to", "announced", "declared", "wrote", "tweeted", "posted", "argued", "claimed",
    "contended", "testified", "explained", "noted", "added", "responded", "replied", "insisted", "warned",
)
QUOTATION = "[\"“](.*?)[\"”]|['‘](.*?)['’]"
REACH = 120
# How far a text may move its outlet's baseline (state outlets, unrated ones, others), and words for the full move.
MOVES = (8.0, 24.0, 10.0)
FULL_WORDS = 150

_QUOTED = re.compile(QUOTATION, re.DOTALL)


@dataclass(frozen=True)
class Terms:
    """(term, side, weight) with side left or right; terms are lower case, and each is given once."""

    rows: tuple[tuple[str, str, float], ...]

    def __post_init__(self) -> None:
        if not self.rows or len({t for t, _, _ in self.rows}) < len(self.rows) or any(not t or s not in ("left", "right") for t, s, _ in self.rows):
            raise ValueError("terms must be given, differ, not be empty, and belong to left or right")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is, so that positions stay those of the text; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@lru_cache(maxsize=8)
def _machine(terms: tuple[str, ...]) -> ahocorasick.Automaton:
    """Matcher of terms (number) and attributions (-1); a word that is both carries both."""
    what: dict[str, list[int]] = {}
    for k, t in enumerate(terms):
        what.setdefault(t, []).append(k)
    for v in ATTRIBUTING:
        what.setdefault(v, []).append(-1)
    machine = ahocorasick.Automaton()
    for word, numbers in what.items():
        machine.add_word(word, (len(word), " " not in word, tuple(numbers)))
    machine.make_automaton()
    return machine


def _wordy(low: str, at: int) -> bool:
    return 0 <= at < len(low) and (low[at].isalnum() or low[at] == "_")


def reported(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray, marks: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Whether each hit lies in one of the spans (n, 2), which do not overlap, or starts within `reach` of a mark; both sorted."""
    inside = np.zeros(len(starts), bool)
    if len(spans):
        k = np.searchsorted(spans[:, 0], starts, "right") - 1
        inside = (k >= 0) & (ends <= spans[np.maximum(k, 0), 1])
    near = np.searchsorted(marks, starts - reach, "left") < np.searchsorted(marks, starts + reach, "right")
    return inside | near


def hits_of(low: str, terms: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number, start, reported) of all hits: of one term without overlaps, of terms without a blank only whole words."""
    last, found, marks = [0] * len(terms), [], []
    for end, (length, single, numbers) in _machine(terms).iter(low):
        start = end + 1 - length
        for k in numbers:
            if k < 0:
                marks.append(start)
            elif start >= last[k] and not (single and (_wordy(low, start - 1) or _wordy(low, end + 1))):
                last[k] = end + 1
                found.append((k, start, end + 1))
    hits = np.array(found, np.int64).reshape(-1, 3)
    spans = np.array([m.span() for m in _QUOTED.finditer(low)], np.int64).reshape(-1, 2) if len(hits) else np.empty((0, 2), np.int64)
    return hits[:, 0], hits[:, 1], reported(hits[:, 1], hits[:, 2], spans, np.sort(np.array(marks, np.int64)))


def term_hits(text: Column, terms: Terms) -> Column:
    """Struct of arrays (number, n, reported): for each term found, its place in `terms`, its hits, and those in reported speech."""
    names = tuple(t for t, _, _ in terms.rows)

    @F.pandas_udf("number array<int>, n array<int>, reported array<int>")
    def count(texts: pd.Series) -> pd.DataFrame:
        out = []
        for low in texts:
            number, _, told = hits_of(low, names)
            kinds, at = np.unique(number, return_inverse=True)
            out.append((kinds.astype(np.int32), np.bincount(at, minlength=len(kinds)).astype(np.int32), np.bincount(at, told, len(kinds)).astype(np.int32)))
        return pd.DataFrame(out, columns=["number", "n", "reported"])

    return count(lower_ascii(text))


def keyword_lean(articles: DataFrame, terms: Terms, text: str = "text", key: str = "article_id") -> DataFrame:
    """(key, keyword_score, left_weight, right_weight, n_terms, n_reported_only): 0 to 100, 50 without a hit.

    A hit in reported speech has half its term's weight, and a term met in reported speech only is half a term. The score moves from 50
    towards the heavier side by its share, damped by a logistic of the number of terms. Null and empty texts score 50.
    """
    sides = F.array(*(F.lit(s) for _, s, _ in terms.rows))
    weights = F.array(*(F.lit(float(w)) for _, _, w in terms.rows))
    found = articles.select(key, term_hits(F.col(text), terms).alias("h")).select(key, F.arrays_zip("h.number", "h.n", "h.reported").alias("h"))

    def weight(side: str) -> Column:
        return F.aggregate("h", F.lit(0.0), lambda acc, x: acc + F.when(F.get(sides, x["number"]) == side, F.get(weights, x["number"]) * (x["n"] - 0.5 * x["reported"])).otherwise(0.0))

    rows = found.select(key, weight("left").alias("left_weight"), weight("right").alias("right_weight"), F.size("h").cast("long").alias("n_terms"),
                        F.size(F.filter("h", lambda x: x["n"] == x["reported"])).cast("long").alias("n_reported_only"))
    both = F.col("left_weight") + F.col("right_weight")
    pull = 1 / (1 + F.exp(-0.7 * (F.col("n_terms") - 0.5 * F.col("n_reported_only") - 4)))
    return rows.withColumn("keyword_score", F.round(F.when(both > 0, 50 + (F.col("right_weight") / both - 0.5) * pull * 100).otherwise(50.0), 6))


def article_lean(articles: DataFrame, terms: Terms, framing: dict[str, float] | None = None, topic_weight: float = 0.3) -> DataFrame:
    """Columns of `keyword_lean` and text_score, lean (0 to 100), unscored.

    `articles` (article_id, text, baseline, rated, state, topic_lean): the outlet's placement, 50 where null; whether it is rated; whether
    it is a state's; the topic's running lean or null, of which the anchor takes `topic_weight`. The text's distance from 50 moves the
    anchor by at most `MOVES`, in full from 150 words on. `framing` gives phrases a direction (see `scores.framing_shift`). `unscored`
    marks unrated outlets of no state with at most two terms and a framing shift under 2.
    """
    from newsloom.operators.scores import framing_shift

    extra = articles.select("article_id", F.coalesce("baseline", F.lit(50.0)).cast("double").alias("baseline"), F.coalesce("rated", F.lit(False)).alias("rated"), F.coalesce("state", F.lit(False)).alias("state"),
                            F.col("topic_lean").cast("double").alias("topic_lean"), word_count(F.col("text")).alias("n_words"), framing_shift(F.coalesce("text", F.lit("")), framing or {}).alias("framing_shift"), "text")
    carried = extra.withColumn("article_id", F.struct(*(c for c in extra.columns if c != "text")))  # so that no join is needed
    scored = keyword_lean(carried, terms).select("article_id.*", "keyword_score", "left_weight", "right_weight", "n_terms", "n_reported_only")
    anchor = F.coalesce(F.col("baseline") * (1 - topic_weight) + F.col("topic_lean") * topic_weight, F.col("baseline"))
    most = F.when(F.col("state"), MOVES[0]).when(~F.col("rated"), MOVES[1]).otherwise(MOVES[2])
    scored = scored.withColumn("text_score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("keyword_score") + F.col("framing_shift"))))
    move = F.greatest(-most, F.least(most, F.col("text_score") - 50)) * F.least(F.lit(1.0), F.col("n_words") / FULL_WORDS)
    lean = F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.when(F.col("n_words") == 0, anchor).otherwise(anchor + move)))).cast("int")
    unscored = ~F.col("rated") & ~F.col("state") & (F.col("n_terms") <= 2) & (F.abs("framing_shift") < 2) & (F.col("n_words") > 0)
    return scored.select("article_id", "keyword_score", "left_weight", "right_weight", "n_terms", "n_reported_only", "text_score", lean.alias("lean"), unscored.alias("unscored"))


def outlet_terms(articles: DataFrame, most: int = 60, least: int = 20) -> Terms:
    """Words that outlets placed left and right use at different rates: `most` a side, weights 1 to 3.

    `articles` (text, baseline): under 45 is left, over 55 right. A word counts once an article and needs `least` of them; its ratio is
    that of its smoothed shares. Words of letters a to z, three or more; ties by word. The driver gets at most 2 x `most` rows.
    """
    side = F.when(F.col("baseline") < 45, "left").when(F.col("baseline") > 55, "right")
    placed = articles.select(side.alias("side"), F.array_distinct(F.regexp_extract_all(lower_ascii(F.col("text")), F.lit("[a-z]{3,}"), F.lit(0))).alias("words")).where("side IS NOT NULL")
    sizes = placed.agg(F.count_if(F.col("side") == "left").alias("n_left"), F.count_if(F.col("side") == "right").alias("n_right"))  # one row
    counts = placed.select("side", F.explode("words").alias("term")).groupBy("term").agg(F.count_if(F.col("side") == "left").alias("l"), F.count_if(F.col("side") == "right").alias("r")).where(F.col("l") + F.col("r") >= least)
    ratio = F.round(F.ln((F.col("r") + 1) / (F.col("n_right") + 2) * (F.col("n_left") + 2) / (F.col("l") + 1)), 9)
    rated = counts.crossJoin(F.broadcast(sizes)).select("term", ratio.alias("ratio")).where("ratio <> 0")
    tops = [rated.where(cond).orderBy(F.abs("ratio").desc(), "term").limit(most) for cond in ("ratio < 0", "ratio > 0")]
    rows = tops[0].unionByName(tops[1]).orderBy("term").collect()
    return Terms(tuple((r.term, "left" if r.ratio < 0 else "right", 3.0 if abs(r.ratio) >= 1 else 2.0 if abs(r.ratio) >= 0.5 else 1.0) for r in rows))
