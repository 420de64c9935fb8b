"""Scalar text functions and text signals as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Our own small lexicons for the signals.
PAYWALL = ["subscribe to continue", "sign in to read", "already a subscriber", "enable cookies", "create a free account"]
HEDGES = ["allegedly", "reportedly", "perhaps", "might", "could", "appears"]
ATTRIBUTIONS = ["according to", "said", "told", "stated", "confirmed"]
MODALS = ["should", "must", "ought", "need to"]


def words(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Runs without blanks; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r]+")), F.lit(0))


def hits(text: Column, phrases: list[str]) -> Column:
    """How many of the phrases occur at all."""
    return sum((F.when(F.contains(F.lower(text), F.lit(p)), 1).otherwise(0) for p in phrases), F.lit(0))


def occurrences(text: Column, phrase: str) -> Column:
    """How often a phrase occurs, without overlaps."""
    low = F.lower(text)
    return ((F.length(low) - F.length(F.replace(low, F.lit(phrase), F.lit("")))) / len(phrase)).cast("int")


def total(low: Column, phrases: list[str]) -> Column:
    """How often any of the phrases occurs in a lower-cased text: one pass for all of them, so none may overlap another."""
    return F.regexp_count(low, F.lit("|".join(phrases)))


def density(low: Column, n: Column, phrases: list[str], per: int = 1000) -> Column:
    """Occurrences of all phrases in a lower-cased text for each `per` of its `n` words; give both as columns, not as expressions."""
    return F.when(n > 0, total(low, phrases) * per / n).otherwise(0.0)


def looks_paywalled(text: Column) -> Column:
    """At most 500 words, with two indicators, or one and under 100 words."""
    n, found = word_count(text), hits(text, PAYWALL)
    return (n <= 500) & ((found >= 2) | ((found >= 1) & (n < 100)))


def is_garbage(title: Column, body: Column) -> Column:
    """Titles too short, or short over a body of under 80 words, or that are a domain."""
    t = F.trim(F.coalesce(title, F.lit("")))
    return (F.length(t) < 6) | t.rlike(r"^[a-z0-9-]+\.(com|org|net)$") | ((F.length(t) < 15) & (word_count(body) < 80))


def caps_count(text: Column) -> Column:
    """Words between blanks of two or more capitals."""
    return F.regexp_count(text, F.lit(r"(?<![^ \t\n\r])[A-Z][A-Z]+[!?.,]*(?![^ \t\n\r])"))


def caps_share(text: Column) -> Column:
    """Share of words of two or more capitals."""
    n = word_count(text)
    return F.when(n > 0, caps_count(text) / n).otherwise(0.0)


def suffix_stem(word: Column) -> Column:
    """A light stem: one of a few English endings cut from words of six letters or more."""
    return F.when(F.length(word) < 6, word).otherwise(F.regexp_replace(word, "(ation|tion|ing|ness|ies|ed|es|ly|s)$", ""))


def content_hash(parts: Column) -> Column:
    """SHA-256 of the sorted parts, joined by line breaks."""
    return F.sha2(F.array_join(F.array_sort(parts), "\n"), 256)


def normalised_lead(text: Column, length: int) -> Column:
    """The first characters in lower case with all else but letters and digits as single blanks."""
    return F.substring(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), 1, length)


def lean_label(lean: Column) -> Column:
    return F.when(lean <= 20, "far left").when(lean <= 35, "left").when(lean <= 45, "center left").when(lean <= 55, "center").when(lean <= 65, "center right").when(lean <= 80, "right").otherwise("far right")


def html_text(html: Column) -> Column:
    """Visible text of a page: without scripts, styles, comments and tags; entities of the basic five resolved."""
    bare = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(bare, r"[ \t\r\n]+", " "))


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
