"""Vectorised 64-bit hashes of the words and word shingles of an Arrow batch of texts.

Every function works on whole batches: the UTF-8 bytes of all texts lie in one buffer, words are
found from the separator bytes, and a word's hash is a difference of wrapped prefix sums.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

SHINGLE = 5

_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers one to one, so that every bit of the input reaches every bit of the result."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_INSIDE = np.ones(256, bool)
_INSIDE[[32, *range(9, 14)]] = False
# the inverse of _ODD modulo 2**64
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))


#: Length of the tables of powers that a worker keeps; a longer text has tables of its own.
_KEPT = (1 << 20) + 1


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return _kept_powers(base)[:n] if n <= _KEPT else _new_powers(base, n)


@functools.cache
def _kept_powers(base: np.uint64) -> np.ndarray:
    return _new_powers(base, _KEPT)


def _new_powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the n + 1 offsets of the texts in them; null counts as empty."""
    raw = texts.cast(pa.large_string()).fill_null("")
    if isinstance(raw, pa.ChunkedArray):
        raw = raw.combine_chunks()
    _, offsets, data = raw.buffers()
    bounds = np.frombuffer(offsets, np.int64)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
    buffer = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buffer[bounds[0] : bounds[-1]], bounds - bounds[0]


def word_hashes(buffer: np.ndarray, bounds: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (a run without space, tab or line break), and the n + 1 offsets of the texts in the words.

    A-Z count as a-z if `lower`. A text's end also ends a word.
    """
    n = len(buffer)
    inside = np.zeros(n + 1, bool)
    np.take(_INSIDE, buffer, out=inside[:n], mode="clip")
    first = np.zeros(n + 1, bool)  # where a text begins a word cannot go on
    first[bounds[:-1]] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:]
    starts = np.flatnonzero(starts)
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:]
    ends = np.flatnonzero(ends) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.take(_BYTE_LOWER if lower else _BYTE, buffer, out=sums[1:], mode="clip")
    sums[1:] *= _powers(_ODD, n)
    np.cumsum(sums[1:], out=sums[1:])
    back = _powers(_INVERSE, n + 1)
    hashes = mix((sums[ends] - sums[starts]) * back[starts])
    return hashes, np.searchsorted(starts, bounds)


def _weight(k: int) -> np.uint64:
    return np.uint64((2 * k + 3) * 0x632BE59BD9B4E019 % (1 << 64))


def single_hashes(words: np.ndarray) -> np.ndarray:
    """What shingle_hashes makes of every single word, in the order of the words."""
    return mix(words * _weight(0))


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle hash), distinct and in this order; a text of fewer than `size` words is one shingle."""
    counts = np.diff(bounds)
    docs = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(words)) - np.repeat(bounds[:-1], counts)
    whole = place <= np.repeat(counts, counts) - size
    short = (place == 0) & ~whole
    out = np.zeros(len(words), np.uint64)
    room = np.concatenate([words, np.zeros(size, np.uint64)])
    for k in range(size):
        part = room[k : k + len(words)] * _weight(k)
        # the words beyond a short text's end take no part
        part[short & (k >= np.repeat(counts, counts))] = 0
        out += part
    keep = whole | short
    return distinct_sorted(docs[keep], mix(out[keep]), len(counts))


def distinct_sorted(docs: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, hash) in this order; text numbers are under `n`.

    One sort of both packed into 64 bits; in the rare case that this leaves different hashes of a text unordered,
    a sort by both.
    """
    bits = np.uint64(max(1, n).bit_length())
    order = np.argsort(docs.astype(np.uint64) << (np.uint64(64) - bits) | hashes >> bits)
    docs, hashes = docs[order], hashes[order]
    same = docs[1:] == docs[:-1]
    if (same & (hashes[1:] < hashes[:-1])).any():
        order = np.lexsort((hashes, docs))
        docs, hashes = docs[order], hashes[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = ~same | (hashes[1:] != hashes[:-1])
    return docs[fresh], hashes[fresh]
