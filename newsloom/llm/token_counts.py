"""Token counts without token ids: pieces are counted once for each distinct pre-token of the corpus.

A byte-level BPE never merges across pre-tokens, so a document's count is the sum over its distinct
pre-tokens of frequency x pieces. The distinct pre-tokens of all documents are a table; their pieces are
counted there, once each, and joined to the documents' frequencies. Most occurrences are of few pre-tokens:
a bounded list of these goes to all tasks and is summed where the text is read, and only the frequencies of
the others are shuffled to the table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.arrow import text_slices
from newsloom.llm.byte_bpe import load_bpe
from newsloom.llm.line_dedup import row_parts
from newsloom.llm.pretokens import load_tokenizer, splitter
from newsloom.shared import materialise

#: Frequent pre-tokens that are joined where the texts are read, and the length up to which one is in that list.
FREQUENT, FREQUENT_CHARS = 262_144, 32
#: Distinct pre-tokens that a task counts together.
COUNTED = 300_000


def _frequencies(split: Callable[[str], list[str]], special: regex.Pattern | None, text: str) -> tuple[Counter, int]:
    """Pre-tokens of a text with their frequency, and the number of special strings in it (a token each)."""
    parts = special.split(text) if special and special.search(text) else [text]
    found: Counter = Counter()
    for part in parts:
        found.update(split(part))
    return found, len(parts) - 1


def _special(tokenizer_path: str) -> regex.Pattern | None:
    added = sorted((t.content for t in load_tokenizer(tokenizer_path).get_added_tokens_decoder().values()), key=len, reverse=True)
    return regex.compile("|".join(map(regex.escape, added))) if added else None


def _survey(tokenizer_path: str, pattern_text: str):
    """(piece, seen): pre-tokens and how many documents nearby have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, special = splitter(pattern_text), _special(tokenizer_path)
        seen: Counter = Counter()
        for batch in text_slices(batches):
            for text in batch.column("text").to_pylist():
                seen.update(set().union(*(split(part) for part in (special.split(text) if special and special.search(text) else [text]))) if text else ())
            if len(seen) > COUNTED:
                yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["piece", "seen"])
                seen = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["piece", "seen"])

    return run


def _pieces(tokenizer_path: str):
    """(piece, seen, n): the tokens of each distinct pre-token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load_bpe(tokenizer_path)
        for batch in text_slices(batches, "piece"):
            counts = bpe.count_words([w.encode() for w in batch.column("piece").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("piece"), batch.column("seen"), pa.array(counts)], ["piece", "seen", "n"])

    return run


def _occurrences(tokenizer_path: str, pattern_text: str, frequent):
    """For each document a row (doc_id, part, n_bytes, n) with the tokens of its frequent pre-tokens, and rows (doc_id, part,
    piece, times) of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, special, known = splitter(pattern_text), _special(tokenizer_path), frequent.value
        for batch in text_slices(batches):
            row, sizes, totals, pieces, times = [], [], [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                found, total = _frequencies(split, special, text or "")
                for piece, many in found.items():
                    n = known.get(piece)
                    if n is None:
                        row.append(k)
                        pieces.append(piece)
                        times.append(many)
                    else:
                        total += many * n
                sizes.append(len((text or "").encode()))
                totals.append(total)
            ids, parts = batch.column("doc_id"), batch.column("part")
            none = pa.nulls(len(ids), pa.string())
            yield pa.RecordBatch.from_arrays([ids, parts, pa.array(sizes, pa.int64()), none, pa.array(totals, pa.int64())], ["doc_id", "part", "n_bytes", "piece", "n"])
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(at), parts.take(at), pa.nulls(len(at), pa.int64()), pa.array(pieces, pa.string()), pa.array(times, pa.int64())], ["doc_id", "part", "n_bytes", "piece", "n"])

    return run


def token_counts(docs: DataFrame, tokenizer_path: str, pattern: str, limit: int = 512, frequent: int = FREQUENT) -> DataFrame:
    """Columns (doc_id, n_bytes, n_tokens, over_limit), one row for each row of `docs` (doc_id, text).

    `tokenizer_path` is a byte-level BPE file of the `tokenizers` library and `pattern` the split that
    it makes before merging. Added tokens found in a text count as one token, as the library's default
    has it; no begin or end tokens, truncation or padding. over_limit: n_tokens > limit. `frequent` bounds the
    list of pre-tokens that is sent to all tasks; it only affects speed.

    Null and empty texts have 0 bytes and tokens. Repeated rows stay, and a null doc_id stays null. An
    empty table gives an empty result; further columns are ignored.
    """
    spark = docs.sparkSession
    # rows of equal doc_id and text have equal counts
    docs = row_parts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    seen = docs.select("text").mapInArrow(_survey(tokenizer_path, pattern), "piece string, seen long").groupBy("piece").agg(F.sum("seen").alias("seen"))
    table = materialise(seen.mapInArrow(_pieces(tokenizer_path), "piece string, seen long, n long"), "pieces")
    # bounded: at most `frequent` rows of FREQUENT_CHARS characters reach the driver, those seen so often that no more are
    short, least, total = table.where(F.length("piece") <= FREQUENT_CHARS), None, 0
    for seen, n in short.groupBy("seen").count().orderBy(F.desc("seen")).limit(frequent + 1).collect():
        total += n
        if total > frequent:
            break
        least = seen
    often = (short.where(F.col("seen") >= least) if least is not None else short.limit(0)).select("piece", "n").toPandas()
    listed = spark.sparkContext.broadcast(dict(zip(often["piece"].tolist(), often["n"].tolist(), strict=True)))
    rows = materialise(docs.mapInArrow(_occurrences(tokenizer_path, pattern, listed), "doc_id long, part long, n_bytes long, piece string, n long"), "occurrences")
    rare = rows.where("piece is not null").join(table.select("piece", F.col("n").alias("each")), "piece").select("doc_id", "part", "n_bytes", (F.col("n") * F.col("each")).alias("n"))
    each = rows.where("piece is null").drop("piece").unionByName(rare).groupBy("doc_id", "part").agg(F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n"), F.count("n_bytes").alias("copies"))
    counts = each.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc_id", "n_bytes", F.expr("n div copies").alias("n_tokens"))
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
