"""Packing of documents into training sequences: bounded-space best fit.

Each partition keeps a fixed number of open windows. What is left of a document after its full windows
goes into the open window with the least room that still holds it; if none does, the fullest window
is topped up with the head of the rest and emitted. What partitions have left over, less than a
window each, is merged by the same rule in groups of partitions until one group is left.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.arrow import text_slices
from newsloom.llm.byte_bpe import load_bpe
from newsloom.llm.pretokens import PieceCache, load_tokenizer, settled, splitter
from newsloom.shared import materialise

WINDOW = 2048
OPEN = 32
#: Partitions whose leftovers one task merges; at most a window of ids each.
FAN_IN = 256

# Fixed value: the split of the word vocabulary, after lower-casing.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("home", pa.int64()), ("ids", pa.binary())]
_ROW = pa.schema(_FIELDS)
_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, home long, ids binary"


@functools.cache
def _special(path: str) -> re.Pattern:
    return re.compile("|".join(re.escape(t.content) for t in load_tokenizer(path).get_added_tokens_decoder().values()) or r"(?!)")


class WordIds:
    """Ids of texts as little-endian unsigned 32-bit integers, as the tokenizers library gives them for the file.

    Settled texts are lower-cased and split here and each distinct word is encoded once, all new words of a
    slice together; texts with added tokens or other scripts go to the library as a whole.
    """

    def __init__(self, path: str, most: int = 300_000):
        self.tokenizer, self.special, self.split, bpe = load_tokenizer(path), _special(path), splitter(WORDS), load_bpe(path)
        self.known = PieceCache(lambda words: bpe.encode_words([w.encode() for w in words]), most)

    def __call__(self, texts: list[str]) -> list[bytes]:
        plain = [settled(t) and not self.special.search(t) for t in texts]
        words = [self.split(t.lower()) if p else [] for t, p in zip(texts, plain, strict=True)]
        self.known.learn(set().union(*words))
        whole = lambda t: np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        return [b"".join(map(self.known.__getitem__, w)) if p else whole(t) for t, w, p in zip(texts, words, plain, strict=True)]


class _Piece:
    """Part of a document's ids: doc_id, its first id's place, the ids' bytes and the document's count of ids."""

    __slots__ = ("doc_id", "start", "ids", "doc_tokens")

    def __init__(self, doc_id: int | None, start: int, ids: bytes, doc_tokens: int):
        self.doc_id, self.start, self.ids, self.doc_tokens = doc_id, start, ids, doc_tokens

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, n: int) -> tuple[_Piece, _Piece]:
        return _Piece(self.doc_id, self.start, self.ids[: 4 * n], self.doc_tokens), _Piece(self.doc_id, self.start + n, self.ids[4 * n :], self.doc_tokens)


class Packer:
    """The open windows of one task. Full windows leave through `emitted`."""

    def __init__(self, first_id: int, window: int = WINDOW, open_windows: int = OPEN):
        self.next_id, self.window, self.most = first_id, window, open_windows
        self.open: list[list] = []  # [room, pieces]
        self.emitted: list[tuple] = []

    def _emit(self, pieces: list[_Piece]) -> None:
        offset = 0
        for p in pieces:
            self.emitted.append((p.doc_id, p.start, len(p), zlib.crc32(p.ids), p.doc_tokens, self.next_id, offset, None, None))
            offset += len(p)
        self.next_id += 1

    def add(self, piece: _Piece) -> None:
        while len(piece) >= self.window:
            full, piece = piece.cut(self.window)
            self._emit([full])
        while len(piece):
            fits = [w for w in self.open if w[0] >= len(piece)]
            if fits:
                best = min(fits, key=lambda w: w[0])
            elif len(self.open) < self.most:
                best = [self.window, []]
                self.open.append(best)
            else:
                best = min(self.open, key=lambda w: w[0])
            head, piece = (piece, piece.cut(len(piece))[1]) if len(piece) <= best[0] else piece.cut(best[0])
            best[0] -= len(head)
            best[1].append(head)
            if not best[0]:
                self._emit(best[1])
                self.open.remove(best)

    def merge(self) -> list[_Piece]:
        """Fill windows from the open ones; the pieces of less than a window that are left."""
        held: list[_Piece] = []
        room = self.window
        for p in [p for _, pieces in sorted(self.open, key=lambda w: w[0]) for p in pieces]:
            while len(p) >= room:
                head, p = p.cut(room)
                self._emit([*held, head])
                held, room = [], self.window
            if len(p):
                held.append(p)
                room -= len(p)
        self.open = []
        return held

    def finish(self, pieces: list[_Piece]) -> None:
        """Emit the last pieces in sequences of a power of two of ids, the largest first: these need no padding."""
        left = sum(map(len, pieces))
        while left:
            size, got = 1 << (left.bit_length() - 1), []
            left -= size
            while size:
                head, rest = pieces[0].cut(min(size, len(pieces[0])))
                got.append(head)
                size -= len(head)
                pieces = ([rest] if len(rest) else []) + pieces[1:]
            self._emit(got)

    def rows(self) -> pa.RecordBatch:
        out, self.emitted = self.emitted, []
        return pa.RecordBatch.from_pylist([dict(zip(_ROW.names, r, strict=True)) for r in out], _ROW)


def _left_over(pieces: list[_Piece], home: int) -> pa.RecordBatch:
    rows = [(p.doc_id, p.start, len(p), zlib.crc32(p.ids), p.doc_tokens, None, None, home, p.ids) for p in pieces]
    return pa.RecordBatch.from_pylist([dict(zip(_ROW.names, r, strict=True)) for r in rows], _ROW)


def _pack(path: str, end_id: int, window: int, open_windows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home = TaskContext.get().partitionId()
        packer, encode, end = Packer(home << 32, window, open_windows), WordIds(path), np.array([end_id], "<u4").tobytes()
        for batch in text_slices(batches):
            ids = encode([t or "" for t in batch.column("text").to_pylist()])
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), ids, strict=True):
                packer.add(_Piece(doc_id, 0, data + end, len(data) // 4 + 1))
            yield packer.rows()
        held = packer.merge()
        yield packer.rows()
        yield _left_over(held, home)

    return run


def _merge(level: int, last: bool, window: int):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["home"], -1 if r["doc_id"] is None else r["doc_id"], r["start"]))
        group = rows[0]["home"] // FAN_IN
        packer = Packer((1 << 61) + (level << 56) + (group << 24), window)
        packer.open = [[0, [_Piece(r["doc_id"], r["start"], r["ids"], r["doc_tokens"]) for r in rows]]]
        held = packer.merge()
        if last:
            packer.finish(held)
            held = []
        return pa.Table.from_batches([packer.rows(), _left_over(held, group)], _ROW)

    return run


def pack_documents(docs: DataFrame, path: str, end_id: int = 1, window: int = WINDOW, open_windows: int = OPEN) -> DataFrame:
    """Columns (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row for each piece.

    A document's ids are those of the tokenizers file `path`, with `end_id` after them. Each id lies in
    exactly one piece; sequences hold `window` ids, but for the last ones, which hold a power of two.
    start: ids of the document before the piece; offset: the piece's place in its sequence.

    Null and empty texts are the end id alone. Each row of `docs` (doc_id, text) is a document of its
    own, also if doc_id is null or repeats. An empty table gives an empty result; further columns
    are ignored. A task holds `open_windows` windows and the ids of one slice of texts.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = materialise(docs.mapInArrow(_pack(path, end_id, window, open_windows), _DDL), "packed")
    parts, level = [packed.where("home is null")], 0
    left = packed.where("home is not null")
    homes = left.agg(F.max("home")).first()[0]
    while homes is not None:
        last = homes < FAN_IN
        left = left.withColumn("group", F.floor(F.col("home") / FAN_IN)).groupBy("group").applyInArrow(_merge(level, last, window), _DDL)
        left = materialise(left, "leftover")
        parts.append(left.where("home is null"))
        left, level = left.where("home is not null"), level + 1
        homes = None if last else left.agg(F.max("home")).first()[0]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("home", "ids")
