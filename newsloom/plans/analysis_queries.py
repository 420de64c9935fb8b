"""Registered queries of the article axes over all documents, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.operators import analysis as A
from newsloom.plans import story_tables as S
from newsloom.plans.queries import query

_TIERS = ["us_major", "international", "independent"]


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def _n(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{_quoted(pattern)}'))"


def _found(text: str, terms: list[str]) -> str:
    pad = f"(' ' || regexp_replace(lower({text}), '[^a-z0-9]+', '  ', 'g') || ' ')"
    return _n(pad, A.alternation(sorted(terms, key=lambda t: (-len(t), t))))


def _words(text: str) -> str:
    return _n(text, r"[^ \t\n\r]+")


def _tier(table: dict[str, float], other: float) -> str:
    return "CASE tier " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in table.items()) + f" ELSE {other}e0 END"


_TEXTS = f"""texts AS (SELECT article_id, coalesce(title, '') AS t, coalesce(body, '') AS b, concat_ws(' ', title, body) AS both_text,
  ({_TIERS})[article_id % 3 + 1] AS tier FROM articles)"""


def _tiered(spark, d):
    """Articles with a tier of their outlet."""
    tier = F.element_at(F.array(*map(F.lit, _TIERS)), (F.col("article_id") % 3 + 1).cast("int"))
    return S.articles(spark, d).withColumn("tier", tier)


_BAIT = " + ".join(f"CASE WHEN regexp_matches(lower(t), '{_quoted(p)}') THEN {A.BAIT_POINTS}e0 ELSE 0e0 END" for p in A.BAIT)
_LOUD = _n(r"(' ' || regexp_replace(t, '[ \t\n\r]+', '  ', 'g') || ' ')", " [A-Z]{3,}[!?.,:;]* ")


def _part(terms: list[str], weight: float, most: float) -> str:
    return f"least({most}e0, {_found('b', terms)} / hundreds * {weight}e0)"


@query(
    f""", {_TEXTS},
counted AS (SELECT *, {_words('t')} AS nt, {_words('b')} AS nb, greatest({_words('b')} / 100, 1e0) AS hundreds,
  list_filter(list_transform(regexp_extract_all(b, '[^.!?]+'), lambda s: {_words('s')}), lambda k: k > 0) AS sentences FROM texts),
ratio AS (SELECT *, CASE WHEN len(sentences) > 0 THEN len(list_filter(sentences, lambda k: k <= 6)) / len(sentences) ELSE 0e0 END AS short FROM counted),
heads AS (SELECT *, CASE WHEN nt > 0 THEN least(100e0, {_BAIT} + least(15e0, {_n('t', '!')} * 5e0) + {_n('t', '[!?]{2,}')} * 5e0 + {_LOUD} / greatest(nt, 1) * 20e0
    + {_found('t', A.LISTS["strong"])} * 3e0 + {_found('t', A.LISTS["urgent"])} * 2e0 + {_found('t', A.LISTS["degree"])} * 2e0 + CASE WHEN nt < 5 THEN 3e0 ELSE 0e0 END) ELSE 0e0 END AS head,
  CASE WHEN nb > 0 THEN greatest(0e0, least(100e0, {_part(A.LISTS["urgent"], 8, 20)} + {_part(A.LISTS["strong"], 5, 20)} + {_part(A.LISTS["degree"], 5, 15)} + least(15e0, {_n('b', '!')} / hundreds * 5e0)
    + CASE WHEN short > 0.3e0 THEN (short - 0.3e0) * 40e0 ELSE 0e0 END + {_part(A.LISTS["hostile"], 8, 15)} * 2e0 - {_part(A.LISTS["sober"], 4, 20)})) ELSE 0e0 END AS tail FROM ratio),
knee AS (SELECT *, greatest(3e0, least(100e0, CASE WHEN 0.5e0 * head + 0.5e0 * tail <= 22 THEN (0.5e0 * head + 0.5e0 * tail) * (50e0 / 22e0)
    ELSE 50e0 + (0.5e0 * head + 0.5e0 * tail - 22e0) * (50e0 / 78e0) END)) AS raw, least(1e0, nb / 500e0) AS weight FROM heads)
SELECT article_id, round(head, 4) AS headline, round(tail, 4) AS body,
  CASE WHEN nt > 0 OR nb > 0 THEN round_even(round(greatest(raw, weight * raw + (1e0 - weight) * ({_tier(A.CALM_TIERS, A.CALM_OTHER)})), 6), 0) ELSE 5 END::INT AS sensationalism FROM knee""",
    "articles",
)
def sensationalism_scores(spark, d):
    """Headline, body and joint sensationalism of every article."""
    return A.sensationalism(_tiered(spark, d))


_MARKED = "CASE " + " ".join(f"WHEN {_found('t', terms)} > 0 THEN {w}e0" for terms, w in A.HEADED) + " ELSE 0e0 END"


@query(
    f""", {_TEXTS},
counted AS (SELECT *, {_words('b')} AS nb, greatest({_words('b')} / 100, 1e0) AS hundreds, {_found('b', A.LISTS["attribution"])} AS said, {_MARKED} AS metadata FROM texts),
halves AS (SELECT *, CASE WHEN said / hundreds >= 1 THEN 0.5e0 ELSE 1e0 END AS half FROM counted),
parts AS (SELECT article_id, tier, nb, metadata, least(100e0, {_found('b', A.LISTS["personal"])} / greatest(nb, 1) * 2500e0) AS pronoun,
  least(100e0, {_found('b', A.LISTS["deontic"])} / hundreds * 20e0 * half) AS modal, {_part(A.LISTS["hedge"], 25, 100)} AS hedging,
  CASE WHEN nb = 0 THEN 50e0 WHEN said = 0 AND nb >= 50 THEN 75e0 ELSE greatest(0e0, least(100e0, 50e0 - said / hundreds * 25e0)) END AS attribution,
  {_part(A.LISTS["attitude"], 50, 100)} AS judgement, least(100e0, {_found('b', A.LISTS["certain"])} / hundreds * 30e0 * half) AS certain FROM halves),
raws AS (SELECT *, least(1e0, nb / 150e0) AS weight, greatest(0e0, least(100e0, greatest(
    pronoun * 0.12e0 + modal * 0.12e0 + hedging * 0.06e0 + attribution * 0.15e0 + metadata * 0.12e0 + judgement * 0.06e0 + certain * 0.19e0,
    CASE WHEN metadata >= 90 THEN 70e0 WHEN metadata >= 50 THEN 45e0 WHEN metadata >= 30 THEN 35e0 ELSE 0e0 END))) AS raw FROM parts)
SELECT article_id, round(pronoun, 4) AS pronoun, round(modal, 4) AS modal, round(attribution, 4) AS attribution,
  round_even(round(greatest(raw, weight * raw + (1e0 - weight) * ({_tier(A.OPINION_TIERS, A.OPINION_OTHER)})), 6), 0)::INT AS opinion FROM raws""",
    "articles",
)
def opinion_scores(spark, d):
    """Opinion of every article with three of its parts."""
    return A.opinion(_tiered(spark, d))


_NAMED = f"len(list_distinct(regexp_extract_all(both_text, '({A.TITLED})[^.\\n]{{0,60}}?{A.SAYING}[^a-z]', 1)))"


@query(
    f""", {_TEXTS},
counted AS (SELECT *, {_words('both_text')} AS n, {_n('both_text', A.TITLED)} AS titled, {_found('both_text', A.LISTS["vague"])} AS vague FROM texts),
parts AS (SELECT *, least(100e0, {_NAMED} * 20e0) AS named, least(100e0, {_found('both_text', A.LISTS["citing"])} * 25e0) AS organisation,
  least(100e0, {_n('lower(both_text)', A.DATA)} / greatest(n / 100, 1e0) * 33e0) AS data, least(100e0, {_n('both_text', A.QUOTES)} / greatest(n / 500, 1e0) * 20e0) AS quotes,
  CASE WHEN n = 0 THEN 0e0 WHEN titled + vague = 0 THEN 50e0 ELSE titled / (titled + vague) * 100e0 END AS specificity, least(100e0, {_n('lower(both_text)', A.REFERENCES)} * 20e0) AS refs FROM counted),
raws AS (SELECT *, greatest(greatest(0e0, least(100e0, named * 0.22e0 + organisation * 0.24e0 + data * 0.27e0 + quotes * 0.17e0 + specificity * 0.1e0 + least(refs * 0.05e0, 8e0) - least(15e0, vague * 3e0))),
    CASE WHEN n <= 30 THEN 15e0 WHEN n <= 100 THEN 10e0 WHEN n < 200 THEN 8e0 ELSE 0e0 END) AS raw,
  CASE WHEN n < 100 THEN 0.4e0 WHEN n < 300 THEN 0.2e0 ELSE 0.1e0 END AS share FROM parts)
SELECT article_id, round(named, 4) AS named_source, round(organisation, 4) AS organisation, round(data, 4) AS data, round(quotes, 4) AS quotes, round(specificity, 4) AS specificity,
  CASE WHEN n > 0 THEN round_even(round(greatest(0e0, least(100e0, raw * (1e0 - share) + ({_tier(A.RIGOR_TIERS, A.RIGOR_OTHER)}) * share)), 6), 0) ELSE 10 END::INT AS rigor FROM raws""",
    "articles",
)
def rigor_scores(spark, d):
    """Factual rigor of every article with its parts."""
    return A.factual_rigor(_tiered(spark, d))
