"""Porter's stems as Spark expressions over a table of distinct words, and folded synonyms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Porter (1980) with his two later changes (bli, logi): forms of stems, then suffixes with what replaces them.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
MEASURED = f"^({_C})?{_V}{_C}"
MEASURE_ONE = f"^({_C})?{_V}{_C}({_V})?$"
MEASURE_TWO = f"^({_C})?{_V}{_C}{_V}{_C}"
VOWEL = f"^({_C})?[aeiouy]"
SHORT = f"^{_C}[aeiouy][^aeiouwxy]$"
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _cut(word: Column, suffixes: str) -> tuple[Column, Column]:
    """What stands before the longest of the suffixes, and the suffix; both empty without one."""
    pattern = f"^(.+?)({suffixes})$"
    return F.regexp_extract(word, pattern, 1), F.regexp_extract(word, pattern, 2)


def _replaced(word: Column, table: dict[str, str]) -> Column:
    stem, suffix = _cut(word, "|".join(table))
    new = F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), suffix)
    return F.when((suffix != "") & stem.rlike(MEASURED), F.concat(stem, new)).otherwise(word)


def _endings(word: Column) -> Column:
    """Step 1b, after ed or ing: the stem mended."""
    doubled = (F.right(word, F.lit(1)) == F.substring(word, -2, 1)) & (F.length(word) > 1) & word.rlike("[^aeiouylsz]$")
    return F.when(word.rlike("(at|bl|iz)$") | (~doubled & word.rlike(SHORT)), F.concat(word, F.lit("e"))).when(doubled, F.expr("substring(w, 1, length(w) - 1)")).otherwise(word)


def porter(words: DataFrame, word: str, stem: str = "stem") -> DataFrame:
    """`words` with the Porter stem of the lower-case `word`; words of up to two letters stay, null stays null.

    Give distinct words and join the stems back. Each step is a projection of its own, so that no step's expression repeats another's.
    """
    w = F.col("w")
    rows = words.select(F.struct(*words.columns).alias("row"), F.regexp_replace(F.col(word), "^y", "Y").alias("w"))
    rows = rows.withColumn("w", F.when(w.rlike(".(ss|i)es$"), F.expr("substring(w, 1, length(w) - 2)")).when(w.rlike(".[^s]s$"), F.expr("substring(w, 1, length(w) - 1)")).otherwise(w))
    agreed, past = _cut(w, "eed"), _cut(w, "ed|ing")
    is_past = ~w.rlike("eed$") & (past[1] != "") & past[0].rlike(VOWEL)
    rows = rows.select("row", F.when((agreed[1] != "") & agreed[0].rlike(MEASURED), F.concat(agreed[0], F.lit("ee"))).when(is_past, past[0]).otherwise(w).alias("w"), is_past.alias("past"))
    rows = rows.select("row", F.when(F.col("past"), _endings(w)).otherwise(w).alias("w"))
    before = _cut(w, "y")
    rows = rows.select("row", F.when((before[1] != "") & before[0].rlike(VOWEL), F.concat(before[0], F.lit("i"))).otherwise(w).alias("w"))
    rows = rows.select("row", _replaced(w, STEP_2).alias("w")).select("row", _replaced(w, STEP_3).alias("w"))
    plain, ion = _cut(w, "|".join(STEP_4)), _cut(w, "ion")
    rows = rows.select("row", F.when(plain[1] != "", F.when(plain[0].rlike(MEASURE_TWO), plain[0]).otherwise(w)).when((ion[1] != "") & ion[0].rlike("[st]$") & ion[0].rlike(MEASURE_TWO), ion[0]).otherwise(w).alias("w"))
    bare = _cut(w, "e")
    rows = rows.select("row", F.when((bare[1] != "") & (bare[0].rlike(MEASURE_TWO) | (bare[0].rlike(MEASURE_ONE) & ~bare[0].rlike(SHORT))), bare[0]).otherwise(w).alias("w"))
    last = F.when(w.rlike("ll$") & w.rlike(MEASURE_TWO), F.expr("substring(w, 1, length(w) - 1)")).otherwise(w)
    kept = F.when(F.length(F.col(f"row.{word}")) <= 2, F.col(f"row.{word}")).otherwise(F.regexp_replace(last, "^Y", "y"))
    return rows.select("row.*", kept.alias(stem))


def stemmed(rows: DataFrame, words: str, keys: list[str]) -> DataFrame:
    """Distinct (*keys, stem) of the array column `words`: every distinct word is stemmed once and joined back."""
    seen = rows.select(*keys, F.explode(F.array_distinct(words)).alias("word"))
    return seen.join(porter(seen.select("word").distinct(), "word"), "word").select(*keys, "stem").distinct()


def fold_synonyms(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """The lower-cased text with each surface replaced by its canonical form, longer surfaces first, whatever stands around them."""
    low = F.lower(text)
    for surface, canonical in sorted(pairs, key=lambda p: (-len(p[0]), p[0])):
        low = F.replace(low, F.lit(surface), F.lit(canonical))
    return low
