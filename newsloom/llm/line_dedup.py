"""Removal of lines that nearly repeat an earlier line anywhere in the corpus: an exact set-similarity join.

A line's set holds its distinct words. Sets are ordered by rarity of their words; two sets of Jaccard
similarity >= t share a word among the first n - ceil(t * n) + 1 of each (prefix filter). What meets at
such a word is put to the length filter, the positional filter and, before the sets are fetched, to
a bound from bit signatures; the rest is verified. All filters are exact: they lose no match. A line goes
if any earlier line matches, so a group of near copies never becomes pairs: each line first meets its
earliest candidates only. The few lines that these leave open are sent to all tasks and verified against
every earlier line that shares a prefix word; beyond a bound of them, they meet further candidates in rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.arrow import release_memory, text_slices
from newsloom.llm.hashing import mix, shingle_hashes, single_hashes, text_buffer, word_hashes
from newsloom.shared import materialise

#: Words in the list that orders them by rarity; words beyond it are the rarest, ordered by hash.
FREQUENT = 262_144
#: Prefix entries that one task joins together.
BUCKET = 225_000
#: Occurrences from which on a listed word is hot: lines of up to SHORT words then meet by it and a second word in common.
HOT, SHORT = 50_000, 24
#: Word occurrences counted together for the list of frequent words.
COUNTED = 2_000_000
#: Rows, and numbers in their arrays, up to which a table of ids or of line numbers is broadcast; beyond, a shuffle join does it.
BROADCAST_ROWS, BROADCAST_NUMBERS = 500_000, 4_000_000
#: Open lines, and words in them, up to which they are sent to all tasks; beyond, they meet further candidates in rounds.
OPEN_LINES, OPEN_WORDS = 20_000, 2_000_000
#: Candidates of a line that a bucket hands on in the first round, and by how much a further round raises that.
MOST, MORE = 16, 1024
#: Stands for a null doc_id, before all others.
NO_ID = -(2**63)
_SEED = np.uint64(0xD6E8FEB86659FD93)
_NEWLINE = 10


def line_bounds(buffer: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the lines of all texts in the buffer (a newline ends the line it stands in), and of the texts in the lines."""
    ends = np.flatnonzero(buffer == _NEWLINE) + 1
    cuts = np.union1d(np.concatenate([ends, bounds]), [0])
    # a text that ends in a newline has an empty last line, and an empty text one empty line: neither holds words
    return cuts, np.searchsorted(cuts, bounds)


def _line_sets(batch: pa.RecordBatch):
    """Of a batch: the number of the text and the line for each line, words (line, hash) in order, counts and set names."""
    buffer, bounds = text_buffer(batch.column("text"))
    cuts, of_text = line_bounds(buffer, bounds)
    words, word_bounds = word_hashes(buffer, cuts)
    line, token = shingle_hashes(words, word_bounds, 1)
    n = np.bincount(line, minlength=len(cuts) - 1)
    sums = np.zeros(len(token) + 1, np.uint64)
    np.cumsum(mix(token ^ _SEED), out=sums[1:])
    ends = np.cumsum(n)
    cls = mix(sums[ends] - sums[ends - n] + n.astype(np.uint64)).view(np.int64)
    text = np.repeat(np.arange(batch.num_rows), np.diff(of_text))
    number = np.arange(len(text)) - of_text[:-1][text]
    return text, number, line, token, n, cls


def _survey(least: int):
    """(doc_id, part, line, cls) of each line that takes part, and (token, seen) of words that many lines nearby have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap: list[np.ndarray] = []
        held = 0
        names = ["doc_id", "part", "line", "cls", "token", "seen"]

        def counted() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(heap), return_counts=True)
            often = counts >= 4
            none = pa.nulls(int(often.sum()), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, pa.array(values[often].view(np.int64)), pa.array(counts[often])], names)

        for batch in text_slices(batches):
            text, number, line, token, n, cls = _line_sets(batch)
            use = np.flatnonzero(n >= least)
            none = pa.nulls(len(use), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(text[use])), batch.column("part").take(pa.array(text[use])), pa.array(number[use]), pa.array(cls[use]), none, none], names)
            once = np.zeros(len(n), bool)
            once[np.unique(cls, return_index=True)[1]] = True
            heap.append(token[(once & (n >= least))[line]])
            held += len(heap[-1])
            if held >= COUNTED:
                yield counted()
                heap, held = [], 0
        if heap:
            yield counted()

    return run


def _signatures(line: np.ndarray, token: np.ndarray, lines: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each line: whether an odd number of its words fall on each. Bits in which two lines differ are at
    most the words that only one of them has, however long they are."""
    out = []
    start = np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if len(line) else np.zeros(0, np.int64)
    bit = np.uint64(1) << (token >> np.uint64(1) & np.uint64(63))
    for side in (0, 1):
        own = np.zeros(lines, np.uint64)
        if len(line):
            own[line[start]] = np.bitwise_xor.reduceat(np.where(token & np.uint64(1) == side, bit, np.uint64(0)), start)
        out.append(own)
    return out[0], out[1]


#: Leading bits of a word's hash by which the list of frequent words is entered.
ENTER = 18


def _entrances(values: np.ndarray) -> np.ndarray:
    """Where in the sorted `values` the words of each ENTER leading bits begin."""
    return np.searchsorted(values, np.arange(1 << ENTER, dtype=np.uint64) << np.uint64(64 - ENTER))


def _ranks(token: np.ndarray, values: np.ndarray, ranks: np.ndarray, entrances: np.ndarray | None = None) -> np.ndarray:
    """Place of each word in the list of frequent ones, the most frequent last; 0 for the rest."""
    if not len(values):
        return np.zeros(len(token), np.int64)
    top = len(values) - 1
    if entrances is None:
        at = np.minimum(np.searchsorted(values, token), top)
    else:
        at = np.minimum(entrances[token >> np.uint64(64 - ENTER)], top)
        on = np.flatnonzero((values[at] < token) & (at < top))
        while len(on):
            at[on] += 1
            on = on[(values[at[on]] < token[on]) & (at[on] < top)]
    return np.where(values[at] == token, ranks[at], 0)


def _sorted_places(major: np.ndarray, minor: np.ndarray, width: int) -> np.ndarray:
    """Stable order by (major, minor), minor under `width`: one sort of both and the place, where 63 bits hold them."""
    n = len(major)
    if n and (int(major.max()) + 1) * width * n < 1 << 63:
        return np.sort((major * width + minor) * n + np.arange(n)) % n
    return np.lexsort((minor, major))


def _keys(line: np.ndarray, token: np.ndarray, n: np.ndarray, hot: np.ndarray, percent: int, short: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, place, key) of the prefix entries of words that stand by line, rarest first.

    The key is the word; for a hot word in a line of up to `short` words the word and a later one: two lines that match
    have a first and a second word in common, and the second is among the first n - ceil(t * n) + 2 of each. Lines whose
    partners may be longer than `short` have both forms.
    """
    first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if len(line) else np.zeros(0, np.int64)
    place = np.arange(len(line)) - np.repeat(first, np.diff(np.r_[first, len(line)]))
    least = (percent * n + 99) // 100
    near = np.flatnonzero(place <= (n - least + 1)[line])  # prefixes, and the one word after each
    line, token, place, hot = line[near], token[near], place[near], hot[near]
    reach = (n - least + 1)[line]
    inside = place < reach
    twice = inside & hot & ((n <= short) & (least >= 2))[line]
    single = np.flatnonzero(inside & (~twice | (100 * n > percent * short)[line]))
    home = np.flatnonzero(twice)
    seconds = (reach - place)[home]
    at = np.repeat(home, seconds)
    other = at + 1 + np.arange(len(at)) - np.repeat(np.cumsum(seconds) - seconds, seconds)
    both = mix(mix(token[at] ^ _SEED) + token[other])
    use = np.concatenate([single, at])
    return line[use], place[use], np.concatenate([token[single], both])


def _prefixes(least: int, percent: int, frequent, buckets: int, short: int):
    """(bucket, entries): packed prefix entries of each distinct line of a slice, by bucket of the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, ranks, least_hot = frequent.value
        entrances = _entrances(values)
        for batch in text_slices(batches):
            text, number, line, token, n, cls = _line_sets(batch)
            doc = pc.fill_null(batch.column("doc_id"), NO_ID).to_numpy(zero_copy_only=False)[text]
            part = batch.column("part").to_numpy(zero_copy_only=False)[text]
            # of copies in the slice the earliest
            order = np.lexsort((number, part, doc, cls))
            once = np.zeros(len(n), bool)
            once[order] = np.r_[True, cls[order][1:] != cls[order][:-1]][: len(n)]
            # a set so small that one word more is too much matches equal ones only
            keep = (once & (n >= least) & (100 * n >= percent * (n + 1)))[line]
            line, token = line[keep], token[keep]
            rank = _ranks(token, values, ranks, entrances)
            low, high = _signatures(line, token, len(n))
            # by line, then rarest first; within a rank the words stay in the order of their hashes
            order = _sorted_places(line, rank, len(values) + 2)
            line, place, token = _keys(line[order], token[order], n, rank[order] >= least_hot, percent, short)
            entry = np.empty(len(line), ENTRY)
            entry["token"], entry["cls"], entry["n"], entry["place"] = token >> np.uint64(32), cls[line], n[line], place
            entry["low"], entry["high"], entry["doc"], entry["part"], entry["line"] = low[line], high[line], doc[line], part[line], number[line]
            bucket = (mix(token ^ _SEED) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            entry, bucket = entry[order], bucket[order]
            cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
            planes = _planes(entry)
            packed = [planes[:, a:b].tobytes() for a, b in zip(cut, np.r_[cut[1:], len(bucket)], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cut]), pa.array(packed, pa.binary())], ["bucket", "entries"])

    return run


#: A prefix entry; of the word's hash half is enough within a bucket: a clash only makes a candidate more.
ENTRY = np.dtype([("cls", "<i8"), ("low", "<u8"), ("high", "<u8"), ("doc", "<i8"), ("part", "<i8"), ("token", "<u4"), ("n", "<i4"), ("place", "<i4"), ("line", "<i4")])


def _planes(entries: np.ndarray) -> np.ndarray:
    """Entries byte plane by byte plane: planes of small numbers compress to almost nothing."""
    return np.ascontiguousarray(entries.view(np.uint8).reshape(len(entries), ENTRY.itemsize).T)


def _unpack(packed: pa.Buffer) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(ENTRY.itemsize, -1).T).view(ENTRY)[:, 0]


def candidate_pairs(entries: np.ndarray, percent: int, step: int = 200_000) -> Iterator[np.ndarray]:
    """Rows (later, doc, part, line, earlier) of classes that share a prefix word and pass all filters; doc, part and line
    are the earlier one's place. A pair can come more than once."""
    order = np.lexsort((entries["line"], entries["part"], entries["doc"], entries["cls"], entries["n"], entries["token"]))
    token, cls = entries["token"][order], entries["cls"][order]
    fresh = np.ones(len(order), bool)  # of copies from several tasks the earliest
    fresh[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])
    order, token, cls = order[fresh], token[fresh], cls[fresh]
    n, place, line = (entries[f][order].astype(np.int64) for f in ("n", "place", "line"))
    low, high, doc, part = (entries[f][order] for f in ("low", "high", "doc", "part"))
    cut = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    ends = np.repeat(np.r_[cut[1:], len(token)], np.diff(np.r_[cut, len(token)]))
    # length filter: partners after an entry, of the same word, up to 100 / percent of its size
    group = np.repeat(np.arange(len(cut)), np.diff(np.r_[cut, len(token)]))
    width = int(n.max()) + 2
    last = np.searchsorted(group * width + n, group * width + np.minimum(n * 100 // percent, width - 1), side="right")
    partners = np.minimum(last, ends) - np.arange(len(token)) - 1
    # the first common word leaves `need` words from it on in both sets, and the need is least for partners of equal size
    partners[place > n - (2 * percent * n + 99 + percent) // (100 + percent)] = 0
    total = np.cumsum(partners)
    start = 0
    while start < len(token):
        base = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, base + step, side="right")))
        a = np.repeat(np.arange(start, stop), partners[start:stop])
        b = a + 1 + np.arange(len(a)) - np.repeat(total[start:stop] - partners[start:stop] - base, partners[start:stop])
        need = (percent * (n[a] + n[b]) + 99 + percent) // (100 + percent)  # least intersection
        # positional filter: this word is the first in common, or the pair passes at the first one
        ok = 1 + np.minimum(place[a], place[b]) + np.minimum(n[a] - place[a], n[b] - place[b]) - 1 >= need
        ok &= (place[a] <= n[a] - need) & (place[b] <= n[b] - need)
        # signatures: differing bits are words that only one has
        apart = np.bitwise_count(low[a] ^ low[b]).astype(np.int64) + np.bitwise_count(high[a] ^ high[b])
        ok &= (apart <= n[a] + n[b] - 2 * need) & (cls[a] != cls[b])
        a, b = a[ok], b[ok]
        if len(a):
            swap = (line[a] > line[b]) | (line[a] == line[b]) & (cls[a] > cls[b])
            swap = (part[a] > part[b]) | (part[a] == part[b]) & swap
            swap = (doc[a] > doc[b]) | (doc[a] == doc[b]) & swap
            later, earlier = np.where(swap, a, b), np.where(swap, b, a)
            yield np.column_stack([cls[later], doc[earlier], part[earlier], line[earlier], cls[earlier]])
        start = stop


def _earliest(pairs: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows (later, doc, part, line, earlier) the `most` earliest of each later one, and the places of rows among them."""
    pairs = pairs[np.lexsort(pairs.T[::-1])]
    pairs = pairs[np.r_[True, (pairs[1:] != pairs[:-1]).any(axis=1)][: len(pairs)]]
    first = np.flatnonzero(np.r_[True, pairs[1:, 0] != pairs[:-1, 0]][: len(pairs)])
    place = np.arange(len(pairs)) - np.repeat(first, np.diff(np.r_[first, len(pairs)]))
    return pairs[place < most], place[place < most]


def _join_bucket(percent: int, most: int, only):
    """(later, earlier, doc, part, line, more) of a bucket: the `most` earliest candidates of each line, and whether it has more."""

    def run(table: pa.Table) -> pa.Table:
        release_memory()
        entries = np.concatenate([_unpack(x.as_buffer()) for x in table.column("entries")])
        found = np.zeros((0, 5), np.int64)
        for pairs in candidate_pairs(entries, percent):
            if only is not None:
                pairs = pairs[np.isin(pairs[:, 0], only.value)]
            found = _earliest(np.concatenate([found, pairs]), most + 1)[0]
        found, place = _earliest(found, most + 1)
        over = np.isin(found[:, 0], found[place == most, 0])[place < most]
        found = found[place < most]
        return pa.table({"later": found[:, 0], "earlier": found[:, 4], "doc": found[:, 1], "part": found[:, 2], "line": found[:, 3], "more": over})

    return run


def _word_sets(least: int):
    """(cls, words) of the lines of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            _, _, _, token, n, cls = _line_sets(batch)
            ends = np.cumsum(n)
            use = np.flatnonzero(n >= least)
            words = pa.array([token[ends[k] - n[k] : ends[k]].view(np.int64) for k in use], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(cls[use]), words], ["cls", "words"])

    return run


def _few(rows: DataFrame, array: str | None = None) -> DataFrame:
    """`rows` written out, and to be broadcast in a join only if they are few, with few numbers in column `array`."""
    rows = materialise(rows, "few")
    n, numbers = rows.agg(F.count("*"), F.sum(F.size(array)) if array else F.lit(0)).first()
    return F.broadcast(rows) if n <= BROADCAST_ROWS and (numbers or 0) <= BROADCAST_NUMBERS else rows


def _sets_of(docs: DataFrame, classes: DataFrame, first: DataFrame, least: int) -> DataFrame:
    """(cls, words) of `classes` (cls), read from the documents where they stand first."""
    ends = materialise(classes.join(first, "cls").select("cls", F.col("first.doc_id").alias("doc_id")), "ends")
    homes = _few(ends.select("doc_id").where("doc_id is not null").distinct())
    sets = docs.join(homes, "doc_id", "left_semi").unionByName(docs.where("doc_id is null")).mapInArrow(_word_sets(least), "cls long, words array<long>")
    return materialise(sets.join(ends.select("cls"), "cls", "left_semi").groupBy("cls").agg(F.first("words").alias("words")), "sets")


def _verified(docs: DataFrame, pairs: DataFrame, first: DataFrame, percent: int, least: int) -> DataFrame:
    """The `later` lines of `pairs` (later, earlier) that match, by their whole sets of words."""
    pairs = materialise(pairs, "candidates")
    ends = pairs.select(F.col("later").alias("cls")).union(pairs.select(F.col("earlier").alias("cls"))).distinct()
    sets = _sets_of(docs, ends, first, least)
    left = pairs.join(sets.select(F.col("cls").alias("later"), F.col("words").alias("wa")), "later")
    both = left.join(sets.select(F.col("cls").alias("earlier"), F.col("words").alias("wb")), "earlier")
    common = F.size(F.array_intersect("wa", "wb"))
    return both.where(100 * common >= percent * (F.size("wa") + F.size("wb") - common)).select("later").distinct()


class _Open:
    """Open lines: where each stands first, its words, and its prefix words with the lines that have them."""

    def __init__(self, lines, percent: int, values: np.ndarray, ranks: np.ndarray):
        self.place = lines[["doc", "part", "line"]].to_numpy(np.int64)
        self.cls = lines["cls"].to_numpy(np.int64)
        self.words = [np.sort(np.asarray(w, np.int64).view(np.uint64)) for w in lines["words"]]
        prefix = []
        for w in self.words:
            rarest = np.argsort(_ranks(w, values, ranks), kind="stable")
            prefix.append(w[rarest[: len(w) - (percent * len(w) + 99) // 100 + 1]])
        of, tokens = np.repeat(np.arange(len(prefix)), [len(p) for p in prefix]), np.concatenate(prefix)
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.start = np.unique(tokens[order], return_index=True)
        self.of, self.counts = of[order], np.diff(np.r_[self.start, len(order)])
        self.leads = np.zeros(1 << 16, bool)  # first bits of the hashes of these words
        self.leads[self.tokens >> np.uint64(48)] = True

    def meet(self, line: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (open line, line) of which the line has a prefix word of the open line, in this order."""
        at = np.minimum(np.searchsorted(self.tokens, token), len(self.tokens) - 1)
        hit = np.flatnonzero(self.tokens[at] == token)
        many = self.counts[at[hit]]
        place = np.repeat(self.start[at[hit]] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        width = int(line.max()) + 1
        return np.divmod(np.unique(self.of[place] * width + np.repeat(line[hit], many)), width)


def _settle(percent: int, least: int, opened):
    """(later) of the open lines that match an earlier line of a task's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: _Open = opened.value
        done = np.zeros(len(lines.cls), bool)
        for batch in text_slices(batches):
            # only lines that may have a prefix word of an open one are made sets
            buffer, bounds = text_buffer(batch.column("text"))
            cuts, of_text = line_bounds(buffer, bounds)
            words, word_bounds = word_hashes(buffer, cuts)
            counts = np.diff(word_bounds)
            home = np.repeat(np.arange(len(counts)), counts)
            use = np.zeros(len(counts), bool)
            use[home[lines.leads[single_hashes(words) >> np.uint64(48)]]] = True
            if not use.any():
                continue
            line, token = shingle_hashes(words[use[home]], np.r_[0, np.cumsum(counts[use])], 1)
            n = np.bincount(line, minlength=int(use.sum()))
            text = np.repeat(np.arange(batch.num_rows), np.diff(of_text))
            number = (np.arange(len(text)) - of_text[:-1][text])[use]
            text = text[use]
            doc = pc.fill_null(batch.column("doc_id"), NO_ID).to_numpy(zero_copy_only=False)[text]
            part = batch.column("part").to_numpy(zero_copy_only=False)[text]
            ends = np.cumsum(n)
            of, other = lines.meet(line, token)
            # open and earlier
            a, b, c = lines.place[of].T
            before = (doc[other] < a) | (doc[other] == a) & ((part[other] < b) | (part[other] == b) & (number[other] < c))
            ok = ~done[of] & before & (n[other] >= least)
            of, other = of[ok], other[ok]
            cut = np.flatnonzero(np.r_[True, of[1:] != of[:-1]][: len(of)])
            for j, near in zip(of[cut].tolist(), np.split(other, cut[1:]), strict=False):
                own = lines.words[j]
                near = near[100 * np.minimum(n[near], len(own)) >= percent * np.maximum(n[near], len(own))]
                if len(near):
                    size = n[near]
                    first = np.cumsum(size) - size
                    tokens = token[np.repeat(ends[near] - size - first, size) + np.arange(size.sum())]
                    at = np.minimum(np.searchsorted(own, tokens), len(own) - 1)
                    common = np.add.reduceat((own[at] == tokens).astype(np.int64), first)
                    done[j] = (100 * common >= percent * (size + len(own) - common)).any()
        yield pa.RecordBatch.from_arrays([pa.array(lines.cls[done])], ["later"])

    return run


def row_parts(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id long, text, any other columns) with `part`: 0, or a hash of the text where doc_id is null or repeats.

    (doc_id, part) names a row, but for rows of equal id and text.
    """
    repeated = _few(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("repeats")))
    return docs.join(repeated, "doc_id", "left").withColumn("part", F.when(F.col("doc_id").isNull() | F.col("repeats"), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))).drop("repeats")


def repeated_lines(docs: DataFrame, percent: int = 80, least: int = 1, frequent: int = FREQUENT) -> DataFrame:
    """Columns (doc_id, part, line): the lines of `docs` (doc_id, text) that repeat or nearly repeat an earlier one.

    Lines are separated by newlines and numbered from 0; earlier is a smaller (doc_id, part, line), null ids first.
    `part` is that of row_parts: it tells rows without an id, or with the same one, apart by their text.
    A line is removed if 100 * common >= percent * all for its distinct words (runs without white space, A-Z in
    lower case) and those of any earlier line, be that removed itself or not. Lines without words take no part, nor do
    those of fewer than `least` distinct words: they are never removed. Rows of equal doc_id and text count as one document.
    Null and empty texts have no lines that take part; an empty table gives an empty result; further
    columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _repeated(row_parts(docs), percent, least, frequent)


def _repeated(docs: DataFrame, percent: int, least: int, frequent: int = FREQUENT) -> DataFrame:
    """repeated_lines of `docs` (doc_id, text, part)."""
    spark = docs.sparkSession
    survey = materialise(docs.mapInArrow(_survey(least), "doc_id long, part long, line long, cls long, token long, seen long"), "lines")
    lines = survey.where("cls is not null").select("doc_id", "part", "line", "cls")
    first = materialise(lines.groupBy("cls").agg(F.min(F.struct("doc_id", "part", "line")).alias("first"), F.count("*").alias("copies")), "classes")
    # bounded: at most `frequent` rows reach the driver; words by falling frequency
    often = survey.where("token is not null").groupBy("token").agg(F.sum("seen").alias("seen")).orderBy(F.desc("seen"), "token").limit(frequent).toPandas()
    values = often["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(values)
    # the most frequent word has the highest rank, hot words those from least_hot on
    least_hot = len(values) + 1 - int((often["seen"] >= HOT).sum())
    listed = spark.sparkContext.broadcast((values[order], np.arange(len(values), 0, -1)[order], least_hot))

    # about nine prefix entries a line; the smallest sets that match others than equal ones need two words in common, or no key has two
    buckets = max(1, first.count() * 9 // BUCKET)
    smallest = -(-percent // (100 - percent)) if percent < 100 else 2
    short = SHORT if percent * smallest > 100 else 0
    entries = docs.mapInArrow(_prefixes(least, percent, listed, buckets, short), "bucket long, entries binary")
    # a line is settled by its earliest candidates; only lines that these leave open meet more of them
    near, most, only = [], MOST, None
    while True:
        met = entries.groupBy("bucket").applyInArrow(_join_bucket(percent, most, only), "later long, earlier long, doc long, part long, line long, more boolean")
        pairs = materialise(met.groupBy("later", "earlier").agg(F.min(F.struct("doc", "part", "line")).alias("at"), F.max("more").alias("more")), "pairs")
        earliest = pairs.groupBy("later").agg(F.min(F.struct("at", "earlier")).alias("e")).select("later", F.col("e.earlier").alias("earlier"))
        near.append(materialise(_verified(docs, earliest, first, percent, least), "near"))
        rest = pairs.select("later", "earlier").join(near[-1], "later", "left_anti").join(earliest, ["later", "earlier"], "left_anti")
        near.append(materialise(_verified(docs, rest, first, percent, least), "near"))
        left = pairs.where("more").select("later").distinct()
        for settled in near:
            left = left.join(settled, "later", "left_anti")
        left = materialise(left, "left")
        n_left = left.count()
        if not n_left:
            break
        if n_left <= OPEN_LINES:
            lines_left = _sets_of(docs, left.select(F.col("later").alias("cls")), first, least).join(first, "cls")
            if lines_left.agg(F.sum(F.size("words"))).first()[0] <= OPEN_WORDS:
                at = [F.coalesce("first.doc_id", F.lit(NO_ID)).alias("doc"), F.col("first.part").alias("part"), F.col("first.line").alias("line")]
                opened = spark.sparkContext.broadcast(_Open(lines_left.select("cls", *at, "words").toPandas(), percent, *listed.value[:2]))
                near.append(materialise(docs.mapInArrow(_settle(percent, least, opened), "later long"), "near"))
                break
        # bounded: at most BROADCAST_ROWS ids; with more of them open, every line takes part again
        only = spark.sparkContext.broadcast(left.toPandas()["later"].to_numpy(np.int64)) if n_left <= BROADCAST_ROWS else None
        most *= MORE
    later = reduce(DataFrame.unionByName, near).distinct().select(F.col("later").alias("cls"))
    gone = first.join(later.withColumn("near", F.lit(True)), "cls", "left").where("copies > 1 or near").select("cls", F.col("first").alias("kept"), F.coalesce("near", F.lit(False)).alias("near"))
    found = lines.join(_few(gone), "cls").where(F.col("near") | (F.struct("doc_id", "part", "line") != F.col("kept")))
    return found.select("doc_id", "part", "line").distinct()


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        texts, left = [], []
        for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
            if gone and text is not None:
                drop = set(gone)
                lines = [x for k, x in enumerate(text.split("\n")) if k not in drop]
                text = "\n".join(lines)
                left.append(len(lines))
            else:
                left.append((text or "").count("\n") + 1)
            texts.append(text)
        at = batch.schema.get_field_index("text")
        columns = [*batch.columns]
        columns[at] = pa.array(texts, pa.string())
        yield pa.RecordBatch.from_arrays([*columns, pa.array(left, pa.int64())], [*batch.schema.names, "n_kept"])


def dedup_lines(docs: DataFrame, percent: int = 80, least: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """`docs` (doc_id, `keep`, text) without the lines of repeated_lines, and n_removed and n_kept lines of each row.

    Null texts stay null. Columns other than doc_id, text and `keep` are dropped.
    """
    kept = [c for c in keep if c not in ("doc_id", "text")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).alias(f"kept_{c}") for c in kept), F.col("text").cast("string").alias("text"))
    rows = row_parts(rows)
    gone = _repeated(rows.select("doc_id", "text", "part"), percent, least).groupBy("doc_id", "part").agg(F.sort_array(F.collect_list("line")).alias("gone"))
    gone = _few(gone.withColumnRenamed("doc_id", "of").withColumnRenamed("part", "of_part"), "gone")
    joined = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part")), "left").drop("of", "part", "of_part")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields)
    out = joined.mapInArrow(_strip, f"{fields}, n_kept long")
    return out.select("doc_id", *(F.col(f"kept_{c}").alias(c) for c in kept), "text", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), "n_kept")
