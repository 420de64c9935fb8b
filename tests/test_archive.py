import datetime
import random

from newsloom.operators import archive

DAY = datetime.date(2001, 11, 5)
PRINTED = "story_id long, thread long, day date, category string, source_count int"


def slow(places, alternatives):
    """(covers, density) by trying all spans. `places` is a list of (word, weight); None without a match."""
    def starts(found):
        return [p for p in range(len(places)) if [w for w, _ in places[p : p + len(found)]] == found]

    asked = {w for a in alternatives for wanted, found in a if wanted for w in found}
    spans = set()
    for a in alternatives:
        if any(not wanted and starts(found) for wanted, found in a):
            continue
        units = [[(p, p + len(f) - 1) for p in starts(f)] for wanted, f in a if wanted]
        for begin in range(len(places)):
            for end in range(begin, len(places)):
                if all(any(begin <= x and y <= end for x, y in u) for u in units):
                    spans.add((begin, end))
    least = [s for s in spans if not any(t != s and s[0] <= t[0] and t[1] <= s[1] for t in spans)]
    if not least:
        return None
    total = 0.0
    for begin, end in least:
        hit = [weight for w, weight in places[begin : end + 1] if w in asked]
        total += len(hit) / sum(1 / x for x in hit) / (1 + (end - begin + 1 - len(hit)))
    return len(least), total


def test_queries_are_read():
    assert archive.web_query('a "b c" -d or -"e f" g or -h') == [[(True, ["a"]), (True, ["b", "c"]), (False, ["d"])], [(False, ["e", "f"]), (True, ["g"])]]
    assert archive.web_query("") == archive.web_query('"" -') == []


def test_covers_equal_all_spans(spark):
    r = random.Random(7)
    texts = [(i, " ".join(r.choices("abcdef", k=r.randint(0, 4))), " ".join(r.choices("abcdef", k=r.randint(0, 25)))) for i in range(120)] + [(900, None, None), (901, None, "a b a b a b")]
    queries = {1: "a b", 2: '"a b" c', 3: "a -b or d e f", 4: '"a a"', 5: 'a or "a b" or f -"c d"', 6: "zz", 7: '-"a b" c d', 8: "a a"}
    index = archive.positional_index(spark.createDataFrame(texts, "story_id long, title string, summary string"), "story_id", [("title", "A"), ("summary", "B")])
    got = {(x.query_id, x.story_id): (x.covers, round(x.density, 9)) for x in archive.cover_density(index, archive.query_terms(spark, queries), "story_id", 3).collect()}
    want = {}
    for i, title, summary in texts:
        places = [(w, 1.0) for w in (title or "").split()] + [(w, 0.4) for w in (summary or "").split()]
        for q, text in queries.items():
            found = slow(places, archive.web_query(text))
            if found:
                want[q, i] = (found[0], round(found[1], 9))
    assert got == want and {q for q, _ in want} == {1, 2, 3, 4, 5, 7, 8}


def test_search_collapses_filters_and_stems(spark):
    texts = spark.createDataFrame([(1, "flood warnings"), (2, "flooding: a warning"), (3, "flood of the warned"), (4, "nothing"), (5, "floods warn")], "story_id long, title string")
    printed = spark.createDataFrame([(1, 7, DAY, "x", 0), (2, 7, DAY, "x", 60), (3, None, DAY, "y", 0), (4, 7, DAY, "x", 0), (5, None, DAY - datetime.timedelta(90), "x", 0)], PRINTED)
    index = archive.positional_index(texts, "story_id", [("title", "A")], ["a", "of", "the"])
    find = lambda **k: [(x.place, x.story_id, x.thread_printings) for x in archive.search_printed(printed, index, {1: "floods warning"}, "2001-11-05", stopwords=["a", "of", "the"], **k).orderBy("place").collect()]
    # 2: 1 / (1 + 1) * 1.5 = 0.75; 1: 1; 5: 0.5 + 0.5 / e = 0.68; 3: 1 / 3
    assert find() == [(1, 1, 3), (2, 5, None), (3, 3, None)]
    assert find(collapse=False) == [(1, 1, 3), (2, 2, 3), (3, 5, None), (4, 3, None)]
    assert find(category="y") == [(1, 3, None)] and find(until="2001-10-01") == [(1, 5, None)] and find(since="2001-10-01", limit=1, offset=1) == [(2, 3, None)]
    gap = archive.search_printed(printed, index, {1: '"flood of the warned"', 2: '"flood warned"', 3: "the"}, "2001-11-05", stopwords=["a", "of", "the"])
    assert sorted((x.query_id, x.story_id) for x in gap.collect()) == [(1, 3), (2, 1), (2, 5)]


def test_empty(spark):
    index = archive.positional_index(spark.createDataFrame([], "story_id long, title string"), "story_id", [("title", "A")])
    assert archive.search_printed(spark.createDataFrame([], PRINTED), index, {1: "a"}, "2001-11-05").count() == 0


def test_index_of_searched_terms_only(spark):
    texts = spark.createDataFrame([(1, "Running home", "the runs of the cats"), (2, "a cat", "nothing else")], "story_id long, title string, summary string")
    fields = [("title", "A"), ("summary", "B")]
    terms = archive.query_terms(spark, {1: "runs -cat"})
    whole = archive.positional_index(texts, "story_id", fields)
    some = archive.positional_index(texts, "story_id", fields, only=terms)
    assert sorted(map(tuple, some.collect())) == sorted(tuple(r) for r in whole.collect() if r.term in ("run", "cat")) and whole.count() > some.count() > 0
