"""Byte-level BPE over Arrow batches, all pre-tokens of a slice at once in numpy matrices.

Distinct pre-tokens are put in buckets by length and padded to a matrix of ids. In each round every
row merges its leftmost pair of least rank; the pairs' ranks come from a hash table; rows are shifted
together where they merged, and rows without a further merge leave the matrix. A pre-token longer than
WIDE is a row of its own that merges all places of its least pair in one round, as far as that is the same.
"""

from __future__ import annotations

import base64
import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.arrow import text_slices
from newsloom.llm.pretokens import PieceCache, splitter

_NONE = np.int32(2**31 - 1)
#: Bytes beyond which a pre-token does not join a matrix.
WIDE = 512


class PairTable:
    """Open addressing hash table from pairs of ids to the id of the merged token (also its rank)."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(len(merged) * 3).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, _NONE, np.int32)
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        at, todo = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = todo[self.keys[at[todo]] == -1]
            self.keys[at[free]] = keys[free]  # of several for a slot the last stays
            won = free[self.keys[at[free]] == keys[free]]
            self.values[at[won]] = merged[won]
            lost = np.ones(len(keys), bool)
            lost[won] = False
            todo = todo[lost[todo]]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged id of each pair, or the largest 32-bit integer; negative ids (padding) never merge."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        keys = np.where((left < 0) | (right < 0), np.int64(-2), keys)
        at = self._slot(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, self.values[at], _NONE)
        open_ = np.flatnonzero((seen != keys) & (seen != -1) & (keys != -2))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[at[open_]]
            hit = seen == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (seen != -1)]
        return out


class ByteBPE:
    """Encoder and decoder for a file of base64 tokens and ranks."""

    def __init__(self, tokens: dict[int, bytes], merges: list[tuple[int, int, int]], single: np.ndarray, last: np.ndarray, whole: dict[bytes, int]):
        """`tokens`: bytes by id; `merges`: pairs with the merged id, which rises with their rank; `single`, `last`: the id
        of each byte within a word and at its end; `whole`: words that are one token whatever the merges."""
        left, right, merged = np.array(merges, np.int32).reshape(-1, 3).T
        self.pairs, self.single, self.last, self.whole = PairTable(left, right, merged), single, last, whole
        by_id = [tokens.get(k, b"") for k in range(max(tokens) + 1)]
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.lengths = np.array([len(t) for t in by_id], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    @classmethod
    def from_ranks(cls, path: str) -> ByteBPE:
        """From lines of a base64 token and its rank, the format of tiktoken: every pair that makes up a token may merge."""
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        merges = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        return cls({r: t for t, r in ranks.items()}, merges, single, single, ranks)

    @classmethod
    def from_json(cls, path: str) -> ByteBPE:
        """From a byte-level BPE file of the tokenizers library, with or without a suffix for the end of a word."""
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model, special = data["model"], {t["content"] for t in data["added_tokens"]}
        # the printable characters that stand for bytes in these files: printable Latin-1 for itself, the rest from U+0100 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        char = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in printable)}
        byte = {c: b for b, c in char.items()}
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        merges = []
        for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"]):
            merges.append((vocab[a], vocab[b], vocab[a + b]))
        if any(x[2] >= y[2] for x, y in zip(merges, merges[1:], strict=False)) or model.get("ignore_merges"):
            raise ValueError(f"{path}: the ids of merged tokens do not rise with their rank")
        single, last = (np.array([vocab[char[b] + end] for b in range(256)], np.int32) for end in ("", suffix))
        tokens = {i: bytes(byte[c] for c in (t.removesuffix(suffix) if suffix else t)) for t, i in vocab.items() if t not in special}
        return cls(tokens, merges, single, last, {})

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as 32-bit integers of this machine."""
        out: list[bytes] = [b""] * len(words)
        for places, ids, sizes in self._merged(words):
            for place, row, size in zip(places, ids, sizes, strict=True):
                out[place] = row[:size].tobytes()
        return out

    def count_words(self, words: list[bytes]) -> np.ndarray:
        """The number of ids of each word; the ids themselves are not kept."""
        out = np.zeros(len(words), np.int64)
        for places, _, sizes in self._merged(words):
            out[places] = sizes
        return out

    def _merged(self, words: list[bytes]) -> Iterator[tuple]:
        """(places in `words`, rows of ids, ids in each row) as words are done."""
        rest: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            whole = self.whole.get(word)
            if whole is not None:
                yield [k], [np.array([whole], np.int32)], [1]
            elif len(word) > WIDE:
                ids = self._merge_wide(word)
                yield [k], [ids], [len(ids)]
            elif word:
                size = len(word)
                # buckets 2, 3, 4, 6, 8, 12, 16, ...: at most a third of a row is padding
                top = 1 << (size - 1).bit_length()
                rest.setdefault(top * 3 // 4 if size <= top * 3 // 4 else top, []).append(k)
        for width, rows in rest.items():
            step = max(1, 400_000 // width)
            for k in range(0, len(rows), step):
                yield from self._merge([words[x] for x in rows[k : k + step]], width, rows[k : k + step])

    def _merge_wide(self, word: bytes) -> np.ndarray:
        """The ids of one word, merging all places of the least pair together.

        The same as one merge at a time from the left, as long as none of the merges makes a pair of still lower rank: the
        round ends with the first that does.
        """
        ids = self.single[np.frombuffer(word, np.uint8)]
        ids[-1] = self.last[word[-1]]
        ranks = np.append(self.pairs.rank(ids[:-1], ids[1:]), _NONE)
        while (least := ranks.min()) != _NONE:
            at = np.flatnonzero(ranks == least)
            # places that overlap stand in runs: every other one of a run from its left
            run = np.flatnonzero(np.r_[True, np.diff(at) != 1])
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) % 2 == 0]
            left = np.where(at > 0, ids[at - 1], -1)
            left[1:][at[1:] - at[:-1] == 2] = least
            right = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1)
            here = np.full(len(at), least, np.int32)
            lower = np.flatnonzero(np.minimum(self.pairs.rank(left, here), self.pairs.rank(here, right)) < least)
            at = at[: lower[0] + 1] if len(lower) else at
            ids[at] = least
            ids, ranks = np.delete(ids, at + 1), np.delete(ranks, at + 1)
            at -= np.arange(len(at))
            # only the pairs left and right of merged tokens have new ranks
            new = np.union1d(at, at[at > 0] - 1)
            ranks[new] = self.pairs.rank(ids[new], np.where(new + 1 < len(ids), ids[np.minimum(new + 1, len(ids) - 1)], -1))
        return ids

    def _merge(self, words: list[bytes], width: int, places: list[int]) -> Iterator[tuple]:
        sizes = np.array([len(w) for w in words])
        ids = np.full((len(words), width), -1, np.int32)
        ids[np.arange(width) < sizes[:, None]] = self.single[np.frombuffer(b"".join(words), np.uint8)]
        ids[np.arange(len(words)), sizes - 1] = self.last[np.array([w[-1] for w in words])]
        ranks = np.full(ids.shape, _NONE, np.int32)
        ranks[:, :-1] = self.pairs.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(words), width - 1)
        places, columns = np.array(places), np.arange(width)
        while True:
            at = ranks.argmin(1)  # the first of equals is the leftmost
            every = np.arange(len(ids))
            best = ranks[every, at]
            done = best == _NONE
            if done.any():
                yield places[done], ids[done], sizes[done].tolist()
                live = ~done
                ids, ranks, sizes, places, at, best = ids[live], ranks[live], sizes[live], places[live], at[live], best[live]
                if not len(ids):
                    return
                longest = int(sizes.max())
                ids, ranks, columns = ids[:, :longest], ranks[:, :longest], columns[:longest]
                every = np.arange(len(ids))
            # close the gap that the merged pair's right half leaves
            behind = columns > at[:, None]
            shifted = np.full_like(ids, -1)
            shifted[:, :-1] = ids[:, 1:]
            ids = np.where(behind, shifted, ids)
            ids[every, at] = best
            shifted[:, :-1], shifted[:, -1] = ranks[:, 1:], _NONE
            ranks = np.where(behind, shifted, ranks)
            sizes -= 1
            # only the pairs left and right of the merged token have new ranks
            follow = np.minimum(at + 1, ids.shape[1] - 1)
            after = np.where(at + 1 < sizes, ids[every, follow], -1)
            ranks[every, at] = self.pairs.rank(ids[every, at], after)
            lead = np.flatnonzero(at > 0)
            ranks[lead, at[lead] - 1] = self.pairs.rank(ids[lead, at[lead] - 1], ids[lead, at[lead]])

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids in a row."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        shift = np.repeat(self.starts[ids] - (ends - lengths), lengths)
        return self.bytes[shift + np.arange(len(shift))]


@functools.cache
def load_bpe(path: str) -> ByteBPE:
    """One for each worker process."""
    return ByteBPE.from_json(path) if path.endswith(".json") else ByteBPE.from_ranks(path)


def _encode(path: str, pattern_text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, split = load_bpe(path), splitter(pattern_text)
        known = PieceCache(lambda words: bpe.encode_words([w.encode() for w in words]))
        for batch in text_slices(batches, limit=1 << 20):
            split_texts = [split(t or "") for t in batch.column("text").to_pylist()]
            known.learn(set().union(*split_texts))
            rows = [b"".join(map(known.__getitem__, words)) for words in split_texts]
            offsets = np.zeros(len(rows) + 1, np.int32)
            np.cumsum([len(r) // 4 for r in rows], out=offsets[1:])
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load_bpe(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                column = part.column("ids")
                bounds = column.offsets.to_numpy()
                ids = column.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]]
                ends = np.zeros(len(ids) + 1, np.int64)
                np.cumsum(bpe.lengths[ids], out=ends[1:])
                text = bpe.decode(ids).tobytes()
                cut = ends[bounds - bounds[0]].tolist()
                decoded = pa.array([text[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), column, decoded], ["doc_id", "ids", "decoded"])

    return run


def bpe_encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Columns (doc_id, ids array<int>), one row for each row of `docs` (doc_id, text).

    `path` is a file of base64 tokens and ranks; each match of `pattern` is encoded separately, without
    special tokens. Null and empty texts have no ids. Repeated rows stay, a null doc_id stays null, an
    empty table gives an empty result; further columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_encode(path, pattern), "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """Columns (doc_id, ids, decoded binary): the bytes that the ids of bpe_encode stand for (null ids: none)."""
    ids = encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return ids.mapInArrow(_decode(path), "doc_id long, ids array<int>, decoded binary")
