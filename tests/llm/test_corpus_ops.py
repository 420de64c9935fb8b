"""Quality, line dedup, n-gram join, nearest neighbours, WARC and the pipeline against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from newsloom.llm import ann, avi_media, line_dedup, ngram_join, quality, queries, warc_archive  # noqa: F401

SF = "/root/testdata/sf0.001"
WIDE = "doc_id long, text string, lang string, source string, n_chars long, cls string, n string, token string, words string, x string"


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(k, t, "en", "s", len(t or ""), "c", "n", "t", "w", "x") for k, t in zip(ids or range(len(texts)), texts)], WIDE)


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(sets):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


@pytest.fixture(scope="module")
def near_copies():
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    seed = [rng.choice(vocabulary) for _ in range(150)]
    out = [None, "", " \n", "one two", "One  TWO", "one two three", " ".join(seed), " ".join(seed).upper()]
    for _ in range(60):  # a large group with differing distances
        copy = list(seed)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        out.append(" ".join(copy))
    for _ in range(30):  # a shared passage in unlike documents
        out.append(" ".join([*(rng.choice(vocabulary) for _ in range(rng.randint(20, 90))), *seed[:40]]))
    return out


@pytest.mark.parametrize("block", [ngram_join.BLOCK, 7])
def test_ngram_components(spark, near_copies, block):
    sets = {k: shingles(t) for k, t in enumerate(near_copies)}
    want = components(sets)
    got = ngram_join.ngram_jaccard_components(docs(spark, near_copies).repartition(3), block=block, frequent=200).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {k: (len(sets[k]), want[k]) for k in sets}


def test_ngram_rows_that_repeat(spark):
    rows = docs(spark, ["a b c d e f"] * 3 + [None], [5, 5, 9, 2])
    assert sorted((r.doc_id, r.component_id) for r in ngram_join.ngram_jaccard_components(rows).collect()) == [(2, 2), (5, 5), (5, 5), (9, 5)]
    assert sorted(r.doc_id for r in ngram_join.drop_near_duplicates(rows).collect()) == [2, 5]


def test_ngram_links_through_a_row_without_id(spark):
    chain = [" ".join(f"w{k}" for k in range(s, s + 60)) for s in (0, 5, 10)]
    got = ngram_join.ngram_jaccard_components(docs(spark, chain, [4, None, 7])).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 4), (4, 4), (7, 4)]


def brute_lines(texts, least=1):
    seen, want = [], {}
    for k, t in enumerate(texts):
        gone = set()
        for number, line in enumerate((t or "").split("\n")):
            s = set(words(line))
            if len(s) >= least:
                if any(100 * len(s & o) >= 80 * len(s | o) for o in seen):
                    gone.add(number)
                seen.append(s)
        want[k] = gone
    return want


@pytest.mark.parametrize(("least", "most", "more", "open_lines", "hot"), [(1, 4, 16, 1000, 9), (5, 4, 16, 0, 50_000), (1, 1, 2, 0, 1), (1, 1, 2, 1000, 50_000), (1, 4, 16, 0, 4)])
def test_line_dedup(spark, monkeypatch, least, most, more, open_lines, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    monkeypatch.setattr(line_dedup, "MOST", most)
    monkeypatch.setattr(line_dedup, "MORE", more)
    monkeypatch.setattr(line_dedup, "OPEN_LINES", open_lines)
    rng = random.Random(4)
    vocabulary = [f"v{int(rng.paretovariate(0.7))}" for _ in range(3000)]
    lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 30))) for _ in range(120)]
    texts = [None, "", "\n", "a b c d e\n\nA b c d E\n"]
    for _ in range(60):
        own = []
        for _ in range(rng.randint(1, 6)):
            w = rng.choice(lines).split(" ")
            if rng.random() < 0.6:
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            own.append(" ".join(w))
        texts.append("\n".join(own))
    want = brute_lines(texts, least)
    for r in line_dedup.dedup_lines(docs(spark, texts).repartition(3), least=least, keep=("lang", "cls")).collect():
        gone = want[r.doc_id]
        assert r.n_removed == len(gone)
        assert r.text == (None if texts[r.doc_id] is None else "\n".join(x for k, x in enumerate(texts[r.doc_id].split("\n")) if k not in gone))


def test_short_and_very_long_lines(spark):
    long = " ".join(f"w{k}" for k in range(30_000))
    texts = ["Les.\na b c d", long, "les.\na b c d e\n语言", "a b c\na c b\n\n \n语言", long + " more", "a b c x"]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    assert got == {0: "Les.\na b c d", 1: long, 2: "语言", 3: "a b c\n\n ", 4: "", 5: "a b c x"}


def test_lines_of_rows_without_a_unique_id(spark):
    rows = [(None, None), (None, "a b c d e\nown f g h i"), (None, "j k l m n\na b c d e"), (3, "o p q r s\nt u v w x"), (3, "y z aa bb cc\no p q r s"), (4, "a b c d e"), (4, "a b c d e")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    left = [line for r in got for line in (r.text or "").split("\n")]
    assert len(got) == len(rows) and sum(r.text is None for r in got) == 1
    assert sorted(x for x in left if x) == sorted(["a b c d e", "own f g h i", "j k l m n", "o p q r s", "t u v w x", "y z aa bb cc"])
    assert sorted((r.doc_id, r.n_removed) for r in got if r.doc_id) == [(3, 0), (3, 1), (4, 1), (4, 1)]


def test_a_template_word_after_the_rarest_one_makes_no_pairs():
    entries = np.zeros(300, line_dedup.ENTRY)
    entries["cls"] = entries["doc"] = np.arange(300)
    entries["n"], entries["place"] = 5, 1  # five words match only if equal, so the rarest must be in common
    assert not list(line_dedup.candidate_pairs(entries, 80))
    entries["place"] = 0
    assert sum(map(len, line_dedup.candidate_pairs(entries, 80))) == 300 * 299 // 2


def test_keys_of_hot_words():
    """Lines meet by a hot word only with a second word, and all sets that match share a key."""
    rng = np.random.default_rng(3)
    token = np.arange(1, 60, dtype=np.uint64)
    sets = []
    for _ in range(150):
        own = np.sort(rng.choice(token, rng.integers(4, 34), replace=False))
        sets += [own, np.delete(own, 1), np.sort(np.append(own[:-1], np.uint64(70)))]
    n = np.array([len(x) for x in sets])
    line, place, key = line_dedup._keys(np.repeat(np.arange(len(sets)), n), np.concatenate(sets), n, np.concatenate(sets) >= 10, 80, 24)
    keys = [set(key[line == k].tolist()) for k in range(len(sets))]
    words = [set(x.tolist()) for x in sets]
    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(words[a] & words[b]) >= 80 * len(words[a] | words[b]):
                assert keys[a] & keys[b]
    assert not any(k in range(10, 60) for j, own in enumerate(keys) if n[j] <= 19 for k in own)


def test_near_duplicates_of_an_id_over_two_texts(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = spark.createDataFrame([(5, a), (5, b), (5, b), (9, a), (2, c), (None, c)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in ngram_join.drop_near_duplicates(rows).collect()) == [(0, c), (2, c), (5, a), (5, b)]


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[100:140] = x[100]  # copies: ties by id
    rows = [(k, [float(v) for v in x[k]], "m") for k in range(600)] + [(601, None, "m"), (602, [0.0] * 16, "m"), (603, [float("nan")] * 16, "m"), (604, [1.0], "m"), (605, [None] * 16, "m"), (620, [float("inf")] + [1.0] * 15, "m"), (None, [1.0] * 16, "m"), (7, [float(v) for v in x[7]], "m")]
    got = {}
    for r in ann.nearest_by_inner_product(spark.createDataFrame(rows, "vec_id long, embedding array<float>, members string"), rerank=120).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 600, 20))
    hits = 0
    for q, found in got.items():
        s = x.astype(np.float64) @ x[q].astype(np.float64)
        best = [k for k in np.lexsort((np.arange(600), -s)) if k != q][:20]
        found = sorted(found)
        assert [f[0] for f in found] == list(range(1, 21)) and all(abs(f[2] - s[f[1]]) < 1e-9 for f in found)
        assert [(-f[2], f[1]) for f in found] == sorted((-f[2], f[1]) for f in found)
        hits += len({f[1] for f in found} & set(best))
    assert hits / (20 * len(got)) >= 0.9


def test_recall_on_the_embeddings_table(spark, monkeypatch):
    monkeypatch.setattr(ann, "INDEX_BLOCK", 1000)
    monkeypatch.setattr(ann, "FAN_IN", 3)
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    x, ids = np.stack(rows["embedding"].to_list()).astype(np.float64), rows["vec_id"].to_numpy()
    found = queries.op4_ann(spark, sf).toPandas()
    hits = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        order = np.lexsort((ids, -s))
        best = ids[order][ids[order] != q][:20]
        own = found[found["query_id"] == q]
        hits += len(set(best) & set(own["vec_id"]))
        assert len(own) == 20 and np.allclose(own["score"], [s[ids == v][0] for v in own["vec_id"]], rtol=1e-12)
    assert len(ids) > 1000 and hits / (20 * (ids % 20 == 0).sum()) >= 0.95


@pytest.mark.parametrize("shape", ["near copies", "norms"])
def test_nearest_of_other_shapes(spark, monkeypatch, shape):
    monkeypatch.setattr(ann, "INDEX_BLOCK", 1000)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 64))
    if shape == "near copies":
        x = x[np.arange(3000) % 2] + 1e-4 * x
    else:
        x *= np.exp(3 * rng.normal(size=(3000, 1))) * 1e3
    found = ann.nearest_by_inner_product(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>"), rerank=20).toPandas()
    for q in range(0, 3000, 20):
        s = x @ x[q]
        best = [k for k in np.lexsort((np.arange(3000), -s)) if k != q][:20]
        assert found[found["query_id"] == q].sort_values("rank")["vec_id"].to_list() == best


def test_few_vectors(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in ann.nearest_by_inner_product(rows).orderBy("rank").collect()] == [(1, 0.5), (2, 0.5)]
    assert ann.nearest_by_inner_product(rows.limit(0)).count() == 0


def test_quality_on_held_out_rows(spark):
    scored = queries.op1_quality(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = scored.where("held_out").join(labels, "doc_id").collect()
    assert held and sum(r.predicted == r.quality for r in held) / len(held) >= 0.95
    assert scored.count() == 200 and scored.where("score is null or score < 0 or score > 1").count() == 0


def test_quality_edge_rows(spark):
    rows = docs(spark, [None, "", "a", "ok words here."], [1, 1, None, 2])
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(rows, labels, keep=("lang", "x")).collect()
    assert len(got) == 4 and all(r.score == 0.5 and r.predicted == 1 for r in got)
    assert quality.quality_scores(rows.limit(0), labels).count() == 0
    assert quality.drop_poor(rows, labels).count() == 4


def test_warc_chain_rejects_magic_in_payloads(spark):
    inner = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    html = [None, "", "short", "short", "y" * 100, "y" * 100, inner, inner + "z" * 100, inner + "z" * 100, "é" * 60]
    rows = spark.createDataFrame([(k, "http://a\r\nB: c", h, "d") for k, h in enumerate(html)] + [(0, "again", None, "d"), (None, "no id", "q", "d")], "page_id long, url string, html string, digest string")
    got = sorted((-1 if r.page_id is None else r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc_archive.archive_pages(rows).collect())
    want = {k: (k, "response", None, len((h or "").encode())) for k, h in enumerate(html)}
    want[5], want[8] = (5, "revisit", 4, 100), (8, "revisit", 7, len(inner) + 100)
    assert got == sorted([*want.values(), (0, "response", None, 0), (-1, "response", None, 1)])


def test_warc_of_repeated_page_ids(spark):
    a, b = "A" * 150, "B" * 150
    rows = [(0, "u", b), (0, "u", a), (0, "u", a), (0, "v", a), (1, "u", a), (3, "u", a), (3, "u", b), (None, "u", a), (None, "u", a), (4, None, "x"), (4, None, "x")]
    got = warc_archive.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    digest = {t: hashlib.sha256(t.encode()).hexdigest() for t in (a, b, "x")}
    want = [(0, "response", None, 150, digest[b]), (0, "response", None, 150, digest[a])] + [(k, "revisit", 0, 150, digest[a]) for k in (0, 0, 1, 3)]
    want += [(3, "revisit", 0, 150, digest[b])] + [(None, "response", None, 150, digest[a])] * 2 + [(4, "response", None, 1, digest["x"])] * 2
    assert sorted(map(str, [(r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in got])) == sorted(map(str, want))


def test_warc_files_are_bounded_by_bytes(spark, tmp_path):
    rows = spark.createDataFrame([(k, "u", chr(97 + k) * (10 if k % 3 else 5000)) for k in range(20)], "page_id long, url string, html string").coalesce(1)
    warc_archive.write_warc(rows, str(tmp_path / "w"), tiers=((100, 6), (1 << 31, 1)))
    files = list((tmp_path / "w").rglob("part-*"))
    assert sorted(len(f.read_bytes()) > 5000 for f in files) == [False] * 3 + [True] * 7
    assert warc_archive.read_warc(spark, str(tmp_path / "w")).where("record_type = 'response'").count() == 20


def test_pointer_jumping():
    offsets = np.array([0, 10, 15, 20, 40])
    assert warc_archive.reachable(offsets, np.array([10, 20, 99, 40, 60]), 60).tolist() == [True, True, False, True, True]
    with pytest.raises(ValueError):
        warc_archive.reachable(offsets, np.array([10, 20, 99, 41, 60]), 60)


@pytest.mark.parametrize("name", ["op1_quality", "op2_line_dedup", "op4_ann", "op8_warc", "op10_ngram_jaccard"])
def test_empty_tables(spark, tmp_path, name):
    for t, schema in (("documents", "doc_id long, text string"), ("labels", "doc_id long, quality int"), ("pages", "page_id long, url string, html string"), ("embeddings", "vec_id long, embedding array<float>")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_pipeline_stages(spark):
    columns, now = ["doc_id", "text", "lang", "source", "n_chars"], spark.read.parquet(f"{SF}/documents.parquet").cache()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, after = now.collect(), stage(spark, now, SF)
        assert after.columns == columns
        now = after.cache()
        left = {r.doc_id: r.text for r in now.collect()}
        texts = {r.doc_id: r.text for r in before}
        assert set(left) <= set(texts) and all(len(r.text) == r.n_chars for r in now.collect())
        if name == "quality":
            assert all(labels.get(k, 1) == 1 for k in left) and len(left) > 100
        if name == "line_dedup":
            order = sorted(texts)
            want = brute_lines([texts[k] for k in order])
            stripped = {k: "\n".join(x for j, x in enumerate(texts[k].split("\n")) if j not in want[i]) for i, k in enumerate(order)}
            assert left == {k: t for i, (k, t) in enumerate(stripped.items()) if not want[i] or t.strip(" \t\n\x0b\f\r")}
        if name == "near_duplicates":
            want = components({k: shingles(t) for k, t in texts.items()})
            assert set(left) == set(want.values())
        if name == "secrets":
            assert set(left) == set(texts) and not any(re.search("AKIA[A-Z0-9]{14}|[0-9a-f]{16}", t) for t in left.values())
    pieces = Counter()
    for r in corpus_pipeline.STAGES[-1][1](spark, now, SF).collect():
        pieces[r.doc_id] += r.length
    assert set(pieces) == set(left)


def test_stages_with_clashing_columns(spark):
    names = "lang source spans n_removed n_kept gone part of of_part cls line words kept_lang own_3 label quality held_out score predicted token n first bucket block rank component_id n_shingles".split()
    schema = "doc_id long, text string, n_chars long, " + ", ".join(f"{c} string" for c in names)
    own = "A plain sentence of the town council stands here alone.\nIt was read twice on Monday."
    rows = [(1, own + "\npassword = abcdefgh12345678"), (2, "The other page keeps its river and its bridge.\n" + own.split("\n")[1]), (3, None), (4, "")]
    table = spark.createDataFrame([(i, t, len(t or ""), *(f"{c}-{i}" for c in names)) for i, t in rows], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, SF)
        assert out.columns == table.columns, name
        for r in out.collect():
            assert [r[c] for c in names] == [f"{c}-{r.doc_id}" for c in names] and r.n_chars == len(r.text or ""), name
    assert {r.doc_id: r.text for r in corpus_pipeline.lines(spark, table, SF).collect()}[2] == rows[1][1].split("\n")[0]
    assert "[SECRET]" in {r.doc_id: r.text for r in corpus_pipeline.secrets(spark, table, SF).collect()}[1]
    assert sorted({r.doc_id for r in corpus_pipeline.packing(spark, table, SF).collect()}) == [1, 2, 3, 4]
