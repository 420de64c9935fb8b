"""Exact Jaccard join of documents on word 5-grams, by a token-group matrix.

A document's tokens are its distinct word shingles. Documents that could be alike are gathered into
blocks; in a block, similar documents form groups, each group keeps the union of its tokens (a
column of the token-group matrix), and a document is compared with a group's members only if
its overlap with that union reaches the least overlap that a link needs.

Which documents meet in a block is decided exactly: two sets of Jaccard similarity >= t must share
one of the first n - ceil(t * n) + 1 tokens of each in any common order (the prefix filter). The order
is by hash, with a bounded list of the corpus' most frequent tokens last, so that a common passage
brings nobody together. The list only affects speed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.llm.arrow import release_memory, text_slices
from newsloom.llm.hashing import SHINGLE, mix, shingle_hashes, text_buffer, word_hashes
from newsloom.operators.graph import connected_components
from newsloom.shared import materialise

#: Tokens in the list of frequent ones: 16 bytes each, whatever the corpus' size.
FREQUENT = 262_144
#: Salts over which a frequent token's documents are dealt.
SALTS = 32
#: Documents that one task opens together.
BLOCK = 512
#: Candidate documents up to which their ids (8 bytes each) are broadcast; beyond, a shuffle join does it.
BROADCAST_IDS = 1_000_000
#: Tokens with so many sets that their leaders are broadcast (32 bytes each); and blocks of several chunks up to which that is done.
HOT_TOKENS, BROADCAST_BLOCKS = 100_000, 200_000
#: Token occurrences counted together for the list of frequent ones.
COUNTED = 3_000_000

_SEED = np.uint64(0x2545F4914F6CDD1D)


def _sets(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text numbers and tokens, ordered; tokens per text; a 64-bit name of each text's set."""
    words, bounds = word_hashes(*text_buffer(batch.column("text")))
    docs, tokens = shingle_hashes(words, bounds, size)
    n = np.bincount(docs, minlength=batch.num_rows)
    sums = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(mix(tokens ^ _SEED), out=sums[1:])
    ends = np.cumsum(n)
    return docs, tokens, n, mix(sums[ends] - sums[ends - n] + n.astype(np.uint64)).view(np.int64)


def _least(n, percent: int):
    """The least overlap of a set of `n` tokens with one that it links with."""
    return (percent * n + 99) // 100


def _tenth(n):
    """Tokens that the prefixes of two linked sets share at least, for the smaller one's size."""
    return (n + 9) // 10


def _survey(size: int):
    """Pass 1: a row (doc_id, cls, n) for each document, and rows (token, seen) for tokens that several documents nearby have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        heap: list[np.ndarray] = []
        held = 0

        def counted() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(heap), return_counts=True)
            often = counts >= 3
            k = int(often.sum())
            return pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(values[often].view(np.int64)), pa.array(counts[often])], ["doc_id", "cls", "n", "token", "seen"])

        for batch in text_slices(batches):
            docs, tokens, n, cls = _sets(batch, size)
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(cls), pa.array(n), none, none], ["doc_id", "cls", "n", "token", "seen"])
            fresh = _first_seen(cls, known)
            heap.append(tokens[fresh[docs]])
            held += len(heap[-1])
            if held >= COUNTED:
                yield counted()
                heap, held = [], 0
        if heap:
            yield counted()

    return run


def _first_seen(cls: np.ndarray, known: set[int], most: int = 500_000) -> np.ndarray:
    """Which texts have a set that this task has not met; the memory of that is bounded."""
    fresh = np.zeros(len(cls), bool)
    for k, c in enumerate(cls.tolist()):
        if c not in known:
            known.add(c)
            fresh[k] = True
    if len(known) > most:
        known.clear()
    return fresh


def _postings(size: int, percent: int, frequent, salts: int):
    """Pass 2: (token, salt, cls, n) for the prefix of each set; salt is -1 but for frequent tokens. n is twice the set's size,
    and one more for tokens of the part of the prefix in which two linked sets share one at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, ranks = frequent.value
        known: set[int] = set()
        for batch in text_slices(batches):
            docs, tokens, n, cls = _sets(batch, size)
            rank = np.zeros(len(tokens), np.int64)
            if len(values):
                at = np.minimum(np.searchsorted(values, tokens), len(values) - 1)
                rank = np.where(values[at] == tokens, ranks[at], 0)
            order = np.lexsort((tokens, rank, docs))
            docs, tokens, rank = docs[order], tokens[order], rank[order]
            place = np.arange(len(tokens)) - (np.cumsum(n) - n)[docs]
            keep = (place < (n - _least(n, percent) + _tenth(n))[docs]) & _first_seen(cls, known)[docs]
            docs, tokens, rank, place = docs[keep], tokens[keep], rank[keep], place[keep]
            packed = 2 * n[docs] + (place <= (n - _least(n, percent))[docs])
            salt = np.where(rank > 0, (cls.view(np.uint64) >> np.uint64(40)).astype(np.int64)[docs] % salts, -1)
            yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(salt), pa.array(cls[docs]), pa.array(packed)], ["token", "salt", "cls", "n"])

    return run


def _token_sets(size: int):
    """(cls, tokens) of documents: the sorted tokens as little-endian unsigned 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            _, tokens, n, cls = _sets(batch, size)
            ends = np.cumsum(n)
            data = [tokens[e - k : e].tobytes() for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(data, pa.binary())], ["cls", "tokens"])

    return run


class _Block:
    """Documents opened together: their tokens as small numbers, those of one document only left out."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent, self.sizes = percent, np.array([len(s) for s in sets], np.int64)
        _, codes, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = counts > 1
        self.width = int(shared.sum())
        code = (np.cumsum(shared) - 1)[codes]
        self.tokens = [c[s] for c, s in zip(np.split(code, np.cumsum(self.sizes)[:-1]), np.split(shared[codes], np.cumsum(self.sizes)[:-1]), strict=True)]

    def links(self, one: int, others: np.ndarray) -> np.ndarray:
        """Which of `others` link with document `one`."""
        mine, n = np.zeros(self.width, bool), self.sizes[one]
        mine[self.tokens[one]] = True
        m = self.sizes[others]
        near = 100 * np.minimum(m, n) >= self.percent * np.maximum(m, n)
        out = np.zeros(len(others), bool)
        for k in np.flatnonzero(near):
            both = np.count_nonzero(mine[self.tokens[others[k]]])
            out[k] = 100 * both >= self.percent * (n + m[k] - both)
        return out

    def least(self, one: int) -> int:
        """The least overlap of a document that links with document `one`."""
        return int(_least(self.sizes[one], self.percent))


def open_block(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """The component (least position) of each set of a block, over all links in it."""
    block, m = _Block(sets, percent), len(sets)
    parent = np.arange(m)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def tie(a: int, b: int) -> None:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)

    # 1. groups: a leader and the documents that link with it
    left, groups = np.arange(m), []
    while len(left):
        leader, rest = left[0], left[1:]
        linked = block.links(leader, rest)
        groups.append(np.concatenate([[leader], rest[linked]]))
        for x in rest[linked]:
            tie(leader, x)
        left = rest[~linked]
    # 2. the token-group matrix
    if len(groups) > 1:
        matrix = np.zeros((block.width, len(groups)), bool)
        for g, members in enumerate(groups):
            matrix[np.concatenate([block.tokens[x] for x in members]), g] = True
        # 3. bound each document's overlap with each group; open those that qualify
        for x in range(m):
            bound = matrix[block.tokens[x]].sum(0)
            for g in np.flatnonzero(bound >= block.least(x)):
                others = np.array([y for y in groups[g] if root(y) != root(x)], np.int64)
                if len(others):
                    for y in others[block.links(x, others)]:
                        tie(x, y)
    return np.array([root(x) for x in range(m)])


def open_cross(queries: list[np.ndarray], members: list[np.ndarray], of: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (query, member) between two lists, one for each group of members (`of` numbers it) that a query links with."""
    block, q = _Block(queries + members, percent), len(queries)
    groups = [np.flatnonzero(of == g) + q for g in np.unique(of)]
    matrix = np.zeros((block.width, len(groups)), bool)
    for g, own in enumerate(groups):
        matrix[np.concatenate([block.tokens[x] for x in own]), g] = True
    found = []
    for x in range(q):
        bound = matrix[block.tokens[x]].sum(0)
        for g in np.flatnonzero(bound >= block.least(x)):
            hit = block.links(x, groups[g])
            if hit.any():
                found.append((x, int(groups[g][hit][0]) - q))
    return found


def _decoded(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def _open_group(percent: int):
    def run(table: pa.Table) -> pa.Table:
        release_memory()
        cls = np.array(table.column("cls").to_pylist(), np.int64)
        cls, order = np.unique(cls, return_index=True)
        sets = _decoded(table.column("tokens"))
        roots = open_block([sets[k] for k in order], percent)
        tied = roots != np.arange(len(roots))
        return pa.table({"src": cls[tied], "dst": cls[roots[tied]]})

    return run


def _open_crossing(percent: int):
    def run(table: pa.Table) -> pa.Table:
        cls = np.array(table.column("cls").to_pylist(), np.int64)
        comp = np.array(table.column("component").to_pylist(), np.int64)
        asks = np.array(table.column("asks").to_pylist(), bool)
        sets = _decoded(table.column("tokens"))
        q, m = np.flatnonzero(asks), np.flatnonzero(~asks)
        if not len(q) or not len(m):
            return pa.table({"src": pa.array([], pa.int64()), "dst": pa.array([], pa.int64())})
        found = open_cross([sets[k] for k in q], [sets[k] for k in m], comp[m], percent)
        return pa.table({"src": pa.array([int(cls[q[a]]) for a, _ in found], pa.int64()), "dst": pa.array([int(cls[m[b]]) for _, b in found], pa.int64())})

    return run


def _broadcast_if_few(ids: DataFrame) -> DataFrame:
    """One column of distinct ids, to be broadcast in a join only if there are few of them."""
    ids = materialise(ids, "ids")
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _few_blocks(rows: DataFrame) -> DataFrame:
    """A row (leader, band, ...) for each block of several chunks, to be broadcast in a join if there are few."""
    rows = materialise(rows, "chunked")
    return F.broadcast(rows) if rows.count() <= BROADCAST_BLOCKS else rows


def ngram_jaccard_components(docs: DataFrame, percent: int = 80, size: int = SHINGLE, frequent: int = FREQUENT, block: int = BLOCK) -> DataFrame:
    """Columns (doc_id, n_shingles, component_id), one row for each row of `docs` (doc_id, text).

    Words are runs of characters other than space and U+0009 to U+000D, with A-Z in lower case; a
    document's set holds its distinct shingles of `size` words (the whole sequence if it has fewer).
    Two documents link when 100 * intersection >= percent * union; component_id is the least doc_id
    reachable by links.

    Null, empty and blank texts have n_shingles 0 and component_id = doc_id. Repeated rows and equal
    texts link with each other. A null doc_id stays null and is not a component's name, unless all are
    null there. An empty table gives an empty result; further columns of `docs` are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    survey = materialise(docs.mapInArrow(_survey(size), "doc_id long, cls long, n long, token long, seen long"), "survey")
    named = survey.where("cls is not null").select("doc_id", "cls", "n")
    classes = named.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"))

    # bounded: at most `frequent` rows reach the driver
    often = survey.where("token is not null").groupBy("token").agg(F.sum("seen").alias("seen")).orderBy(F.desc("seen"), "token").limit(frequent).toPandas()
    values = often["token"].to_numpy(np.int64).view(np.uint64)
    ranks = np.arange(len(values), 0, -1)  # the most frequent token comes last
    order = np.argsort(values)
    listed = spark.sparkContext.broadcast((values[order], ranks[order]))

    postings = docs.mapInArrow(_postings(size, percent, listed, SALTS), "token long, salt long, cls long, n long")
    # sets that link differ little in size: of a token's sets ordered by size, those with a near neighbour stay
    by_size, size_of = Window.partitionBy("token", "salt").orderBy("n", "cls"), lambda n: F.floor(n / 2)
    near = (size_of(F.col("n")) * percent <= size_of(F.lag("n").over(by_size)) * 100) | (size_of(F.lead("n").over(by_size)) * percent <= size_of(F.col("n")) * 100)
    several = postings.withColumn("near", near).where("near or salt >= 0").select("token", "cls", size_of(F.col("n")).alias("n"), (F.col("n") % 2 == 1).alias("leads"))
    several = materialise(several, "several")
    # and a linked set shares a tenth of the smaller size with such neighbours
    smaller = F.floor((percent * F.col("n") + 99) / 100)
    able = several.groupBy("cls").agg(F.count("*").alias("shared"), F.max("n").alias("n")).where(F.col("shared") >= F.floor((smaller + 9) / 10)).select("cls")
    meeting = materialise(several.where("leads").join(_broadcast_if_few(able), "cls", "left_semi").select("token", "cls", "n"), "meeting")
    # sets that link differ in size by a factor of 1.25 at most: they share one of two neighbouring bands
    low = F.floor(F.log(F.col("n")) / F.log(F.lit(1.01 * 100 / percent)))
    banded = meeting.withColumn("band", F.explode(F.array(low, low + 1)))
    leaders = banded.groupBy("token", "band").agg(F.min("cls").alias("leader"), F.max("cls").alias("most"), F.count("*").alias("sets")).where("leader <> most").drop("most")
    leaders = materialise(leaders, "leaders")
    # no task gets all sets of a token: of two rows for each of `meeting` at most 2 * HOT_TOKENS tokens have that many
    many = F.col("sets") > max(block, meeting.count() // HOT_TOKENS)
    hot, rest = leaders.where(many).drop("sets"), leaders.where(~many).drop("sets")
    led = banded.join(F.broadcast(hot), ["token", "band"]).unionByName(banded.join(F.broadcast(hot), ["token", "band"], "left_anti").join(rest, ["token", "band"]))
    blocks = materialise(led.groupBy("leader", "band", "cls").agg(F.max("n").alias("n")), "seats")
    # the blocks that are opened in chunks; at most a row for each `block` seats
    chunks = _few_blocks(blocks.groupBy("leader", "band").count().where(F.col("count") > block).select("leader", "band", F.ceil(F.col("count") / F.lit(block)).cast("int").alias("chunks")))
    blocks = blocks.join(chunks, ["leader", "band"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    blocks = materialise(blocks.withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int")), "blocks")

    wanted = blocks.select("cls").distinct().join(classes, "cls").select(F.col("rep").alias("doc_id"))
    needed = docs.join(_broadcast_if_few(wanted.where("doc_id is not null")), "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
    sets = needed.mapInArrow(_token_sets(size), "cls long, tokens binary")
    sets = materialise(sets, "sets")
    # the leader takes part in each chunk of its block
    extra = blocks.where("chunks > 1 and cls = leader").select("leader", "band", "cls", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    seats = blocks.select("leader", "band", "cls", "chunk").unionByName(extra).distinct()
    links = materialise(seats.join(sets, "cls").groupBy("leader", "band", "chunk").applyInArrow(_open_group(percent), "src long, dst long"), "links")
    found = connected_components(links)

    large = blocks.where("chunks > 1")
    if large.limit(1).count():
        # blocks of several chunks: documents outside the leader's component against the other chunks
        comp = F.coalesce("component", "cls")
        placed = large.join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", comp).drop("n")
        lead = _few_blocks(placed.where("cls = leader").select("leader", "band", F.col("component").alias("main")))
        placed = placed.join(lead, ["leader", "band"])
        asking = placed.where("component <> main")
        rows = _few_blocks(asking.groupBy("leader", "band").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("askers")))
        asking = asking.join(rows, ["leader", "band"]).withColumn("ask", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("askers")).cast("int"))
        asked = asking.select("leader", "band", "ask", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "cls", "component", F.lit(True).alias("asks"))
        members = placed.join(rows, ["leader", "band"]).select("leader", "band", F.explode(F.sequence(F.lit(0), F.col("askers") - 1)).alias("ask"), "chunk", "cls", "component", F.lit(False).alias("asks"))
        crossing = asked.unionByName(members).join(sets, "cls").groupBy("leader", "band", "ask", "chunk").applyInArrow(_open_crossing(percent), "src long, dst long")
        links = materialise(links.unionByName(crossing), "links")
        found = connected_components(links)

    labelled = classes.join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = labelled.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_class = labelled.join(least, "component").select("cls", "component_id")
    return named.join(of_class, "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, percent: int = 80, size: int = SHINGLE) -> DataFrame:
    """One row of `docs` (doc_id, text, any other columns) for each component of ngram_jaccard_components: the least doc_id's.

    Rows with null doc_id stay. Of rows of equal doc_id and text one stays; an id over different texts names a document for each.
    """
    repeated = _broadcast_if_few(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if not repeated.limit(1).count():
        found = ngram_jaccard_components(docs, percent, size)
        gone = _broadcast_if_few(found.where("component_id <> doc_id").select("doc_id").distinct())
        return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    # a document of a repeated id goes by a hash of id and text
    named = docs.join(repeated.withColumn("_repeats", F.lit(True)), "doc_id", "left").withColumn("_key", F.when(F.col("_repeats"), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id").cast("long")))
    found = ngram_jaccard_components(named.select(F.col("_key").alias("doc_id"), "text"), percent, size)
    ids = named.where("_key is not null").select("_key", "doc_id").distinct()
    member = found.select(F.col("doc_id").alias("_key"), "component_id").distinct().join(ids, "_key")
    least = member.groupBy("component_id").agg(F.min(F.struct("doc_id", "_key")).alias("least"))
    gone = _broadcast_if_few(member.join(least, "component_id").where("_key <> least._key").select("_key").distinct())
    left = named.join(gone, "_key", "left_anti")
    left = left.where("_key is not null").dropDuplicates(["_key"]).unionByName(left.where("_key is null")).select(docs.columns)
    return left
