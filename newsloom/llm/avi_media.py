"""Bytes as AVI motion-JPEG columns, and timed clips from them.

A payload is cut into grey frames of 24 x 24 samples of 8 bits. Each frame is a JPEG of its own (an
intra frame) by the lossless process of ITU-T T.81 (SOF3, predictor 1, Huffman coded), so that
decoding gives back every sample. The frames of a slice of rows are coded and decoded together: the
encoder places all codes by their bit offsets, the decoder takes one sample of every frame per step.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.arrow import text_slices

SIDE = 24
FRAME = SIDE * SIDE
RATE = 25
FILL = 255
#: Grey levels of a histogram bin, and frames on either side whose differences set the threshold.
BIN, NEAR = 16, 8
#: A cut's difference (in thousandths of the samples) is at least this, and this many deviations above the mean.
LEAST, DEVIATIONS = 150, 1.5

# The luminance DC table of ITU-T T.81, K.3.1 (codes by length 1 to 16, then the values).
DHT_COUNTS = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0])
DHT_VALUES = bytes(range(12))


def _codes(counts: bytes, values: bytes) -> list[tuple[int, int, int]]:
    """(category, code, length) of a Huffman table."""
    out, code, k = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((values[k], code, length))
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _difference(category: int, bits: int) -> int:
    return bits if category == 0 or bits >> (category - 1) else bits - (1 << category) + 1


def _coder(counts: bytes, values: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For the differences -255 to 255: code with its extra bits, and their number."""
    code, length = np.zeros(511, np.uint32), np.zeros(511, np.uint8)
    for category, huffman, n in _codes(counts, values):
        if category <= 8:
            for bits in range(1 << category):
                d = _difference(category, bits) + 255
                code[d], length[d] = huffman << category | bits, n + category
    return code, length


def _decoder(counts: bytes, values: bytes) -> np.ndarray:
    """For each 16 bits that may come next: (difference + 512) << 8 | bits used; 0 where no code fits."""
    table = np.zeros(1 << 16, np.int32)
    for category, huffman, n in _codes(counts, values):
        used = n + category
        if used <= 16 and category <= 8:
            for bits in range(1 << category):
                first = (huffman << category | bits) << (16 - used)
                table[first : first + (1 << (16 - used))] = (_difference(category, bits) + 512) << 8 | used
    return table


_CODE, _LENGTH = _coder(DHT_COUNTS, DHT_VALUES)


def _jpeg_head() -> bytes:
    table = b"\x00" + DHT_COUNTS + DHT_VALUES
    frame = struct.pack(">BHHB", 8, SIDE, SIDE, 1) + b"\x01\x11\x00"
    scan = b"\x01\x01\x00" + b"\x01\x00\x00"
    parts = [(0xFFC3, frame), (0xFFC4, table), (0xFFDA, scan)]
    return b"\xff\xd8" + b"".join(struct.pack(">HH", m, len(p) + 2) + p for m, p in parts)


_HEAD = _jpeg_head()
_END = b"\xff\xd9"


def jpeg_frames(samples: np.ndarray) -> list[bytes]:
    """Lossless JPEG of each frame of `samples` (frames, 24, 24), 8 bits."""
    x = samples.astype(np.int16)
    d = x.copy()
    d[:, :, 1:] -= x[:, :, :-1]
    d[:, 1:, 0] -= x[:, :-1, 0]
    d[:, 0, 0] -= 128
    d = d.reshape(len(x), FRAME) + 255
    code, length = _CODE[d], _LENGTH[d].astype(np.int64)
    ends = np.cumsum(length, 1)
    sizes = (ends[:, -1] + 7) // 8
    bases = np.cumsum(sizes) - sizes
    at = (ends - length + 8 * bases[:, None]).ravel()
    byte = at >> 3
    placed = code.ravel() << (24 - length.ravel() - (at & 7)).astype(np.uint32)
    total = int(sizes.sum())
    data = sum(np.bincount(byte + k, placed >> np.uint32(16 - 8 * k) & np.uint32(255), total + 2) for k in range(3))[:total].astype(np.uint8)
    last = bases + sizes - 1
    data[last] |= ((1 << (8 * sizes - ends[:, -1])) - 1).astype(np.uint8)  # the rest of the last byte is ones
    raw, begin = data.tobytes(), bases.tolist()
    return [b"".join((_HEAD, raw[a : a + n].replace(b"\xff", b"\xff\x00"), _END)) for a, n in zip(begin, sizes.tolist(), strict=True)]


def avi_file(frames: list[bytes]) -> bytes:
    """An AVI file of one motion-JPEG stream with an index."""
    most = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // RATE, most * RATE, 0, 0x10, len(frames), 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, RATE, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    chunk = lambda name, data: name + struct.pack("<I", len(data)) + data + b"\x00" * (len(data) & 1)
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    sizes = np.array([len(f) for f in frames], np.int64)
    room = sizes + (sizes & 1) + 8
    index = np.zeros((len(frames), 4), "<u4")
    index[:, 0], index[:, 1], index[:, 2], index[:, 3] = int.from_bytes(b"00dc", "little"), 0x10, 4 + np.cumsum(room) - room, sizes
    movi = chunk(b"LIST", b"movi" + b"".join(chunk(b"00dc", f) for f in frames))
    body = b"AVI " + hdrl + movi + chunk(b"idx1", index.tobytes())
    return b"RIFF" + struct.pack("<I", len(body)) + body


def _chunks(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, end) of the chunks in a range."""
    while start + 8 <= end:
        size = int.from_bytes(data[start + 4 : start + 8], "little")
        yield data[start : start + 4], start + 8, start + 8 + size
        start += 8 + size + (size & 1)


def avi_frames(data: bytes) -> list[bytes]:
    """The frames of an AVI file, by its index."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    top = {(name, data[a : a + 4] if name == b"LIST" else b""): (a, b) for name, a, b in _chunks(data, 12, 8 + int.from_bytes(data[4:8], "little"))}
    movi, (a, b) = top[b"LIST", b"movi"][0], top[b"idx1", b""]
    index = np.frombuffer(data[a:b], "<u4").reshape(-1, 4)
    video = index[index[:, 0] == int.from_bytes(b"00dc", "little")]
    return [data[o + 8 : o + 8 + n] for o, n in zip((video[:, 2].astype(np.int64) + movi).tolist(), video[:, 3].tolist(), strict=True)]


class _Heads:
    """What the markers before a scan say, parsed once for each distinct sequence of markers."""

    def __init__(self):
        self.known: dict[bytes, np.ndarray] = {}

    def scan(self, frame: bytes) -> tuple[bytes, np.ndarray]:
        """The entropy-coded bytes of a frame without stuffing, and the table to decode them."""
        for head, table in self.known.items():
            if frame.startswith(head):
                return frame[len(head) : -2].replace(b"\xff\x00", b"\xff"), table
        at, table = 2, None
        while frame[at : at + 2] != b"\xff\xda":
            marker, size = struct.unpack(">HH", frame[at : at + 4])
            body = frame[at + 4 : at + 2 + size]
            if marker == 0xFFC4:
                table = _decoder(body[1:17], body[17:])
            elif marker == 0xFFC3 and struct.unpack(">BHH", body[:5]) != (8, SIDE, SIDE):
                raise ValueError("not a frame of 24 x 24 samples of 8 bits")
            at += 2 + size
        at += 2 + int.from_bytes(frame[at + 2 : at + 4], "big")
        self.known[frame[:at]] = table
        return self.scan(frame)


def decode_frames(frames: list[bytes], heads: _Heads) -> np.ndarray:
    """The samples of lossless JPEG frames, (frames, 24, 24)."""
    scans = [heads.scan(f) for f in frames]
    table = scans[0][1]
    if any(t is not table for _, t in scans):
        return np.concatenate([decode_frames([f], heads) for f in frames])
    sizes = np.array([len(s) for s, _ in scans], np.int64)
    data = np.frombuffer(b"".join(s for s, _ in scans) + b"\xff" * 4, np.uint8).astype(np.int32)
    wide = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    at = (np.cumsum(sizes) - sizes) * 8
    most = len(wide) - 1
    found = np.empty((FRAME, len(frames)), np.int32)
    for k in range(FRAME):
        entry = table[wide[np.minimum(at >> 3, most)] >> (8 - (at & 7)) & 0xFFFF]
        found[k] = entry
        at += entry & 255
    if (found == 0).any() or (at > np.cumsum(sizes) * 8).any():
        raise ValueError("damaged entropy-coded data")
    d = ((found >> 8) - 512).T.reshape(len(frames), SIDE, SIDE)
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], 1)
    return (np.cumsum(d, 2) & 255).astype(np.uint8)


def cuts(samples: np.ndarray) -> np.ndarray:
    """Frames with which a shot begins (but the first), from differences of neighbouring frames' histograms.

    A frame begins a shot if its difference is the largest within NEAR frames, at least LEAST, and
    DEVIATIONS standard deviations above the mean of the differences there.
    """
    n = len(samples)
    if n < 2:
        return np.zeros(0, np.int64)
    bins = 256 // BIN
    flat = (samples.reshape(n, FRAME) // BIN).astype(np.int64) + np.arange(n)[:, None] * bins
    histograms = np.bincount(flat.ravel(), minlength=n * bins).reshape(n, bins)
    change = np.abs(np.diff(histograms, axis=0)).sum(1) * 500 // FRAME  # thousandths of the samples
    width = 2 * NEAR + 1
    padded = np.pad(change, NEAR, constant_values=-1)
    near = np.lib.stride_tricks.sliding_window_view(padded, width)
    inside = near >= 0
    count = inside.sum(1)
    total, squares = (near * inside).sum(1), (near * near * inside).sum(1)
    mean = total / count
    spread = np.sqrt(np.maximum(squares / count - mean * mean, 0))
    return np.flatnonzero((change >= LEAST) & (change == near.max(1)) & (change >= mean + DEVIATIONS * spread)) + 1


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, limit=1 << 20):
        payloads, sizes = [], []
        for text in batch.column("text").to_pylist():
            data = (text or "").encode()
            sizes.append(len(data))
            payloads.append(data + bytes([FILL]) * (-len(data) % FRAME if data else FRAME))
        frames = jpeg_frames(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, SIDE, SIDE))
        ends = np.cumsum([len(p) // FRAME for p in payloads]).tolist()
        media = [avi_file(frames[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


_CLIP = pa.struct([("start_frame", pa.int64()), ("end_frame", pa.int64())])


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    heads = _Heads()
    for batch in text_slices(batches, "media", 1 << 20):
        files = [avi_frames(m) for m in batch.column("media").to_pylist()]
        samples = decode_frames([f for fs in files for f in fs], heads)
        ends = np.cumsum([len(fs) for fs in files]).tolist()
        payloads, clips = [], []
        for a, b in zip([0, *ends], ends, strict=False):
            own = samples[a:b]
            payloads.append(own.tobytes())
            bounds = [0, *cuts(own).tolist(), b - a]
            clips.append([{"start_frame": s, "end_frame": e} for s, e in zip(bounds, bounds[1:], strict=False)])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(payloads, pa.binary()), pa.array(clips, pa.list_(_CLIP))], [*batch.schema.names, "payload", "clips"])


def encode_avi(docs: DataFrame) -> DataFrame:
    """Columns (doc_id, n_bytes, media), one row for each row of `docs` (doc_id, text): the UTF-8 bytes of the text,
    filled with bytes 255 to a positive multiple of 576, as an AVI file.

    Null and empty texts give one frame of 255. Repeated rows stay, a null doc_id stays null, an empty table
    gives an empty result; further columns are ignored. Equal texts give equal files.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_encode, "doc_id long, n_bytes long, media binary")


def decode_avi(media: DataFrame) -> DataFrame:
    """`media` (doc_id, n_bytes, media) with payload (all samples in order) and clips array<struct<start_frame, end_frame>>,
    the end exclusive. Rows without media are left out; a damaged file raises ValueError."""
    rows = media.select("doc_id", "n_bytes", "media").where("media is not null")
    return rows.mapInArrow(_decode, "doc_id long, n_bytes long, media binary, payload binary, clips array<struct<start_frame: long, end_frame: long>>")


def clip_rows(decoded: DataFrame) -> DataFrame:
    """A row (doc_id, clip, start_frame, end_frame, start_s, end_s) for each shot of decode_avi."""
    one = decoded.select("doc_id", F.posexplode("clips").alias("clip", "c"))
    return one.select("doc_id", "clip", "c.start_frame", "c.end_frame", (F.col("c.start_frame") / RATE).alias("start_s"), (F.col("c.end_frame") / RATE).alias("end_s"))
