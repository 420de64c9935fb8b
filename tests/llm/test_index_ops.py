"""Vector codes, token files and lexical search against brute force and the libraries."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from newsloom.llm import lexical_search, queries, token_files, vector_codes

VECTORS = "vec_id long, embedding array<float>, label int, row string, part string, code string, error string, position string, of_label string"
DOCS = "doc_id long, text string, row string, part string, n string, terms string, item string, ids string"
WORDS = P.path("word_bpe_49k.json")


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "r", "p", "c", "e", "o", "l") for r in rows], VECTORS)


def docs(spark, rows):
    return spark.createDataFrame([(*r, "r", "p", "n", "t", "i", "s") for r in rows], DOCS)


def brute_codes(rows):
    """(vec_id, code, error, label_error, sha) by plain Python integers."""
    kept = [(i, [math.floor(256 * np.float32(x).item()) for x in v], label) for i, v, label in rows if v is not None and len(v) == 32 and all(x is not None and math.isfinite(x) and abs(x) <= 1 << 19 for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:64]
    cut = lambda v: [tuple(v[2 * p : 2 * p + 2]) for p in range(16)]
    books = [[cut(v)[p] for _, v, _ in first] for p in range(16)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(2):
        for p in range(16):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(near(cut(v)[p], books[p])[1], []).append(cut(v)[p])
            books[p] = [tuple(sum(x) // len(groups[k]) for x in zip(*groups[k], strict=True)) if k in groups else e for k, e in enumerate(books[p])]
    out, of_label = [], Counter()
    for i, v, label in kept:
        found = [near(x, books[p]) for p, x in enumerate(cut(v))]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
        of_label[label] += out[-1][2]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, of_label[label], sha) for i, c, e, label in out), key=repr)


@pytest.fixture(scope="module")
def hard_vectors():
    rng = np.random.default_rng(4)
    own = [(int(k), [float(np.float32(x)) for x in rng.normal(0, 0.4, 32)], int(k % 3) if k % 5 else None) for k in rng.permutation(np.arange(-20, 160))]
    grid = [(200 + k, [float(np.float32(x)) for x in rng.integers(0, 2, 32) / 8], 7) for k in range(60)]  # parts that many vectors share
    same = [(500, [0.0] * 32, 1)] * 40 + [(501 + k, [-0.001] * 32, 1) for k in range(40)]
    odd = [(None, [0.5] * 32, 1), (None, [0.25] * 32, None), (3, [0.5] * 32, 2), (900, None, 1), (901, [None] + [0.0] * 31, 1), (902, [float("nan")] * 32, 1)]
    odd += [(903, [float("inf")] + [0.0] * 31, 1), (904, [1.0] * 16, 1), (905, [], 1), (906, [1.0] * 33, 1), (907, [1e30] * 32, 1), (908, [500_000.0] * 32, 8)]
    return own + grid + same + odd


@pytest.mark.parametrize("listed", [vector_codes.LISTED, 20, 0])
def test_vector_codes(spark, hard_vectors, listed):
    got = vector_codes.compress_vectors(vectors(spark, hard_vectors).repartition(3), listed=listed)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_codes(hard_vectors)


def test_vector_codes_of_few_and_of_no_rows(spark, monkeypatch):
    few = [(k, [k / 4] * 32, None) for k in range(5)]
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 0)
    assert sorted(map(tuple, vector_codes.compress_vectors(vectors(spark, few)).collect()), key=repr) == brute_codes(few)
    assert vector_codes.compress_vectors(vectors(spark, [])).collect() == []
    assert vector_codes.compress_vectors(vectors(spark, [(1, None, 1), (2, [0.5] * 15, 1)])).collect() == []
    bare = spark.createDataFrame([(1, [0.5] * 32)], "vec_id long, embedding array<double>")
    assert [r.label_error for r in vector_codes.compress_vectors(bare).collect()] == [0]


def test_equal_parts_are_one_row(spark, hard_vectors):
    rows = vector_codes.integer_vectors(vectors(spark, hard_vectors)).repartition(4)
    counted = rows.mapInArrow(vector_codes._count, vector_codes._COUNTED).groupBy("position", "part").sum("weight").collect()
    assert sum(r[2] for r in counted) == 16 * rows.count()
    assert max(r[2] for r in counted) >= 40


HARD = ["", " ", None, "a<|endoftext|>b", "<|startoftext|> Éa", "語ノ あ🙂", "x" * 3000, "it's I'LL", "\n\n x", "Ω ΣΣ σς", "12½³"]


def brute_ids(rows):
    library, start, out = Tokenizer.from_file(WORDS), 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes()), ids.tolist()))
        start += len(ids)
    return out


def test_token_files(spark, tmp_path):
    rows = [(3 * k - 50, t) for k, t in enumerate(HARD * 4)] + [(2**60 + k, f"far {k}") for k in range(9)]
    folder = f"file://{tmp_path}/tokens"
    token_files.write_token_files(docs(spark, rows).repartition(5), WORDS, folder)
    got = token_files.read_token_files(spark, folder, with_ids=True)
    want = brute_ids(rows)
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[1]) == want
    flat, files = [x for w in want for x in w[4]], token_files.TokenFiles(folder)
    assert files.n_tokens == len(flat) and len(files.parts) > 1
    for start, length in ((0, len(flat) + 9), (7, 1000), (len(flat) - 1, 5), (len(flat), 3), (40, 0)):
        assert files.window(start, length).tolist() == flat[start : start + length]


def test_token_files_of_one_id_and_of_none(spark, tmp_path):
    rows = [(5, f"word {k % 3}") for k in range(60)] + [(None, "lost"), (None, None), (4, "four"), (6, "six " * 20_000)]
    folder = f"{tmp_path}/hot"
    token_files.write_token_files(docs(spark, rows).repartition(4), WORDS, folder)
    got = sorted(map(tuple, token_files.read_token_files(spark, folder).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, None, 4, *[5] * 60, 6]
    assert [r[1] for r in got] == [sum(x[2] for x in got[:k]) for k in range(len(got))]
    assert Counter(r[2:] for r in got) == Counter(w[2:4] for w in brute_ids(rows))
    assert spark.read.parquet(f"{folder}/parts").where("n_docs > 10").count() > 1  # the id that repeats fills several parts
    token_files.write_token_files(docs(spark, []), WORDS, f"{tmp_path}/none")
    assert token_files.read_token_files(spark, f"{tmp_path}/none").collect() == []
    assert token_files.TokenFiles(f"{tmp_path}/none").window(0, 5).tolist() == []


def test_files_of_a_task_that_ran_twice(tmp_path):
    for _ in range(2):
        writer = token_files._PartWriter(str(tmp_path), 0)
        writer.add(7, np.array([5, 2], "<u2").tobytes(), 2)
        assert writer.close() == (0, 1, 0, 2)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["docs-00000000.bin", "ids-00000000.bin", "offsets-00000000.bin"]
    assert np.fromfile(tmp_path / "offsets-00000000.bin", "<u8").tolist() == [0, 2]


def brute_search(rows, items, k=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    of = [(i, Counter(terms(t))) for i, t in rows]
    of = [(i, c) for i, c in of if c]
    n_docs, n_terms = len(of), sum(c.total() for _, c in of)
    df, out = Counter(t for _, c in of for t in c), []
    for item, text in items:
        scored = []
        for i, c in of:
            m = 100 - 90 + 90 * c.total() * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) & c.keys())
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -score) for rank, (score, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def library():
    rng = random.Random(8)
    vocabulary = [f"t{int(rng.paretovariate(0.6))}" for _ in range(2000)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    made = [(k, text(rng.randint(0, 60))) for k in range(150)]
    passage = text(30)
    made += [(300 + k, f"{text(5)} {passage}") for k in range(12)] + [(400 + k, "one same text É ß") for k in range(15)]
    made += [(None, "one É lost"), (5, "T1 t2"), (5, "T1 t2"), (700, None), (701, " .,"), (702, "É" * 2000 + " t1" * 400_000)]
    items = [(k, text(rng.randint(1, 25))) for k in range(12)] + [(20, passage), (20, passage.upper()), (21, None), (22, ""), (23, "nowhere"), (24, "one SAME É é"), (None, "lost")]
    return made, items


@pytest.mark.parametrize(("shard", "shard_docs", "block"), [(lexical_search.SHARD, lexical_search.SHARD_DOCS, lexical_search.BLOCK_BYTES), (50, 1000, 600), (1000, 7, 1 << 20)])
def test_lexical_search(spark, library, shard, shard_docs, block):
    rows, items = library
    wide = spark.createDataFrame([(i, t, "r", "d") for i, t in items], "item_id long, text string, rank string, doc_id string")
    got = lexical_search.search_documents(docs(spark, rows).repartition(3), wide, shard=shard, shard_docs=shard_docs, block_bytes=block)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_search(rows, items)


def test_search_stops_once_the_best_are_proven(monkeypatch):
    rng = np.random.default_rng(2)
    n, completed = 20_000, []
    terms = [np.array([0, 1, 2], np.int32) if d < 3 else np.array([3], np.int32) for d in range(n)]
    counts = [rng.integers(1, 9, len(t)).astype(np.int32) for t in terms]
    offsets = np.append(0, np.cumsum([len(t) for t in terms]))
    shard = lexical_search.Shard(offsets, np.concatenate(terms), np.concatenate(counts), [c.sum() + 50 for c in counts], np.array([9000, 8000, 7000, 3]), n, 60 * n)
    complete = shard.complete
    monkeypatch.setattr(shard, "complete", lambda *a: completed.append(1) or complete(*a))
    best, scores = shard.search(np.array([0, 1, 2, 3]), 3)
    every = np.zeros(n, np.int64)
    np.add.at(every, np.repeat(np.arange(n), np.diff(offsets)), shard.impacts)
    assert sorted(best) == [0, 1, 2] and dict(zip(best, scores, strict=True)) == {d: every[d] for d in range(3)}
    assert completed == [1]


def test_search_of_empty_tables(spark):
    none, some = docs(spark, []), docs(spark, [(1, "a b")])
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.search_documents(none, items).collect() == []
    assert lexical_search.search_documents(some, items.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["op11_vector_codes", "op13_lexical_search"])
def test_twins(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    want, got = con.sql(queries.ORACLE_SQL[name]), queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(want.fetchall())
