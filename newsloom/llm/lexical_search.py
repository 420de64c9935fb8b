"""Ranked lexical search over impact-ordered postings, score at a time.

A term's postings lie in groups of one exact impact, the highest first. For an item the groups of all its terms
are added to accumulators in descending order of impact; it stops only when no document outside the best can
still reach them, whatever the groups that are left hold, and completes the scores of the best from the
documents' own terms. Documents are indexed in shards of bounded size, each in the task that reads it, so that no
posting is shuffled; only the best of each shard and item are.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.llm.arrow import text_slices
from newsloom.shared import materialise

#: Postings of a shard (a document more may go beyond), and documents of a shard.
SHARD, SHARD_DOCS = 2_000_000, 100_000
#: Postings that an item's search adds before it first compares bounds; then after twice as many each time.
FIRST_CHECK = 1024
#: UTF-8 bytes of the items that are searched for together.
BLOCK_BYTES = 4 << 20
#: Bytes beyond which a text's terms are counted one after the other instead of listed.
LONG = 1 << 20

#: In UTF-8 every byte beyond ASCII is part of a term.
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")

_DOCS = "row long, doc_id long, n long, terms array<int>, counts array<int>"
_FOUND = "item long, doc_id long, row long, score long"


def term_counts(text: str | None) -> Counter:
    """Terms of a text, in UTF-8 with A-Z lower-cased, with their occurrences."""
    data = (text or "").encode().lower()
    return Counter(_TERM.findall(data) if len(data) <= LONG else (m[0] for m in _TERM.finditer(data)))


def _count(known):
    """Each document's number of terms, and its counts of the terms that are asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[bytes, int] = known.value
        for batch in text_slices(batches):
            n, terms, counts = [], [], []
            for text in batch.column("text").to_pylist():
                found = term_counts(text)
                asked = sorted((number[t], c) for t, c in found.items() if t in number)
                n.append(found.total())
                terms.append([t for t, _ in asked])
                counts.append([c for _, c in asked])
            lists = pa.list_(pa.int32())
            columns = [batch.column("row"), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(terms, lists), pa.array(counts, lists)]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n", "terms", "counts"])

    return run


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Shard:
    """Postings of some documents, by term in groups of exact impact.

    offsets (documents + 1) and terms, counts: the documents' terms with occurrences; sizes: their terms in all;
    weights: of each term by number; n_docs, n_terms: of the whole corpus.
    """

    def __init__(self, offsets: np.ndarray, terms: np.ndarray, counts: np.ndarray, sizes: list[int], weights: np.ndarray, n_docs: int, n_terms: int):
        self.offsets, self.terms = offsets, terms
        docs = np.repeat(np.arange(len(sizes)), np.diff(offsets))
        length = np.array([100 - 90 + 90 * n * n_docs // n_terms for n in sizes], np.int64)  # Python's integers: the product may exceed 64 bits
        counts = counts.astype(np.int64)
        self.impacts = weights[terms] * (1_000_000_000 * counts // (1000 * counts + 8 * length[docs]))
        order = np.lexsort((-self.impacts, terms))
        order = order[self.impacts[order] > 0]
        self.docs = docs[order]
        term, impact = terms[order], self.impacts[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (term[1:] != term[:-1]) | (impact[1:] != impact[:-1])
        #: of each group: its first posting (one more at the end), its term, its impact
        self.first = np.append(np.flatnonzero(fresh), len(order))
        self.group_impact = impact[fresh]
        self.of_term = np.searchsorted(term[fresh], np.arange(len(weights) + 1))

    def search(self, asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of at least the `k` best documents of score above 0 for the distinct term numbers `asked`."""
        n = len(self.offsets) - 1
        spans = [np.arange(a, b) for a, b in zip(self.of_term[asked], self.of_term[asked + 1], strict=True)]
        groups = np.concatenate(spans) if spans else np.zeros(0, np.int64)
        if not len(groups):
            return groups, groups
        impact = self.group_impact[groups]
        # what a term can still give falls, with each of its groups that is done, to the impact of its next one
        after = np.append(impact[1:], 0)
        after[np.cumsum([len(s) for s in spans if len(s)]) - 1] = 0
        order = np.argsort(-impact, kind="stable")
        groups, impact = groups[order], impact[order]
        bound = np.cumsum((impact - after[order])[::-1])[::-1]  # of all terms together, before each group
        start, size = self.first[groups], self.first[groups + 1] - self.first[groups]
        done = np.cumsum(size)
        score, at, step = np.zeros(n, np.int64), 0, FIRST_CHECK
        while at < len(groups):
            to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + step, side="right")))
            many = size[at:to]
            posting = np.repeat(start[at:to] - np.cumsum(many) + many, many) + np.arange(many.sum())
            np.add.at(score, self.docs[posting], np.repeat(impact[at:to], many))
            at, step = to, 2 * step
            if at < len(groups) and n > k:
                edge = np.partition(score, (n - k - 1, n - k))
                if edge[n - k] > edge[n - k - 1] + bound[at]:
                    best = np.flatnonzero(score >= edge[n - k])
                    return best, self.complete(best, asked)
        least = max(1, np.partition(score, n - k)[n - k] if n > k else 1)
        best = np.flatnonzero(score >= least)  # ties stay in until ids decide
        return best, score[best]

    def complete(self, docs: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """The full scores of documents, from all their own terms."""
        spans = [slice(self.offsets[d], self.offsets[d + 1]) for d in docs]
        return np.array([self.impacts[s][np.isin(self.terms[s], asked)].sum() for s in spans], np.int64)


def _search(plan, k: int, most: int, most_docs: int):
    """The best documents of each shard for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, n_docs, n_terms = plan.value
        held: list[pa.RecordBatch] = []

        def results() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            lists = table.column("terms").combine_chunks()
            if isinstance(lists, pa.ChunkedArray):
                lists = lists.chunk(0)
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            flat = [table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("terms", "counts")]
            shard = Shard(offsets, *flat, table.column("n").to_pylist(), weights, n_docs, n_terms)
            ids, rows = table.column("doc_id"), table.column("row").to_numpy()
            order_ids = ids.fill_null(np.iinfo(np.int64).max).to_numpy()
            for item, asked in items:
                docs, scores = shard.search(asked, k)
                best = np.lexsort((rows[docs], order_ids[docs], -scores))[:k]
                docs, scores = docs[best], scores[best]
                if len(docs):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), item)), ids.take(pa.array(docs)).combine_chunks(), pa.array(rows[docs]), pa.array(scores)], ["item", "doc_id", "row", "score"])

        total = docs = 0
        for batch in batches:
            sizes = np.diff(batch.column("terms").offsets.to_numpy()) if batch.num_rows else np.zeros(0, np.int64)
            at = 0
            while at < batch.num_rows:
                room = int(np.searchsorted(np.cumsum(sizes[at:]), most - total)) + 1
                take = min(room, batch.num_rows - at, most_docs - docs)
                held.append(batch.slice(at, take))
                total, docs, at = total + int(sizes[at : at + take].sum()), docs + take, at + take
                if total >= most or docs >= most_docs:
                    yield from results()
                    total = docs = 0
        if held:
            yield from results()

    return run


def _search_block(docs: DataFrame, items: list, k: int, shard: int, shard_docs: int) -> DataFrame:
    """(item, doc_id, row, score) of the `k` best documents of each (item, text), and more."""
    spark, asked = docs.sparkSession, [(item, term_counts(text).keys()) for item, text in items]
    number = {t: j for j, t in enumerate(sorted(set().union(*(terms for _, terms in asked))))}
    counted = docs.mapInArrow(_count(spark.sparkContext.broadcast(number)), _DOCS)
    counted = materialise(counted, "term-counts")
    whole = counted.where("n > 0").agg(F.count("*"), F.sum(F.col("n").cast("decimal(38,0)"))).first()
    df = {r.term: r["count"] for r in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}
    weights = np.array([weight(whole[0], df[j]) if j in df else 0 for j in range(len(number))], np.int64)
    numbers = [(item, np.array(sorted(number[t] for t in terms), np.int64)) for item, terms in asked]
    plan = spark.sparkContext.broadcast((numbers, weights, whole[0], int(whole[1] or 1)))
    return counted.where(F.size("terms") > 0).mapInArrow(_search(plan, k, shard, shard_docs), _FOUND)


def search_documents(docs: DataFrame, items: DataFrame, k: int = 10, shard: int = SHARD, shard_docs: int = SHARD_DOCS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Columns (item_id, rank, doc_id, score): for each row of `items` (item_id, text) the `k` rows of `docs` (doc_id, text) of the
    highest score above 0, fewer if there are no more.

    Terms are runs of letters and digits of ASCII, A-Z lower-cased, and of all characters beyond ASCII. With N documents that have a
    term, L terms in all, n in a document, tf occurrences there and df documents of a term, a term counts once for an item with
    floor(1000 ln((2N+2) / (2df+1))) * (10^9 tf div (1000 tf + 8 m)), m = 10 + (90nN div L). Equal scores rank by ascending
    doc_id, null last; rows that share a doc_id are documents of their own. Null and empty texts have no term, and an item without
    one has no rows. Rows of `items` that share an item_id are ranked each by itself. Empty tables give an empty result.

    Items are the stated query set against all documents, in blocks of `block_bytes` of text; a block's terms go to all
    tasks. A task holds one shard of `shard` postings or `shard_docs` documents. These bounds only affect speed.
    """
    spark = docs.sparkSession
    docs = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = materialise(items.where("text is not null").select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")), "items")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    found = None
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).select("item", "text").collect()
        part = _search_block(docs, mine, k, shard, shard_docs)
        found = part if found is None else found.unionByName(part)
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "row")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
