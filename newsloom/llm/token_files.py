"""Flat files of token ids with 64-bit document offsets, in ascending order of doc_id.

A folder holds for each part `ids-<part>.bin` (unsigned integers of 2 or 4 bytes, little-endian, one document after the
other), `offsets-<part>.bin` (unsigned 64-bit: where each document begins in the part, and the end) and `docs-<part>.bin`
(signed 64-bit doc_ids, of which the first `n_null` stand for nulls), and the table `parts` (Parquet), whose bases are the
prefix sums of the parts before. A document's place among all ids is its part's base and its offset.
"""

from __future__ import annotations

import functools
import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.arrow import text_slices
from newsloom.llm.packing import WordIds
from newsloom.llm.pretokens import load_tokenizer

#: UTF-8 bytes of text for one part.
PART_BYTES = 256 << 20
#: Words whose ids a worker process keeps from task to task.
KNOWN = 600_000
#: Documents that a reading task gives back at a time.
STEP = 4096

_PARTS = "part long, n_docs long, n_null long, n_tokens long, base long, first_doc long, id_bytes int"
_LEAST = np.iinfo(np.int64).min


def _store(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of a folder given as a path or a URI, as Spark writes it."""
    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(folder)


class _PartWriter:
    """The three files of a part, written under names of their own and put in place at the end: a task that is run again
    replaces them by the same content."""

    NAMES = ("ids", "offsets", "docs")

    def __init__(self, folder: str, part: int):
        self.files, self.path = _store(folder)
        self.part, self.mark = part, uuid.uuid4().hex
        self.files.create_dir(self.path, recursive=True)
        self.out = {n: self.files.open_output_stream(f"{self._name(n)}.{self.mark}", buffer_size=1 << 20) for n in self.NAMES}
        self.n_docs = self.n_null = self.n_tokens = 0

    def _name(self, kind: str) -> str:
        return f"{self.path}/{kind}-{self.part:08d}.bin"

    def add(self, doc_id: int | None, ids: bytes, tokens: int) -> None:
        self.out["offsets"].write(np.uint64(self.n_tokens).astype("<u8").tobytes())
        self.out["docs"].write(np.int64(_LEAST if doc_id is None else doc_id).astype("<i8").tobytes())
        self.out["ids"].write(ids)
        self.n_docs, self.n_null, self.n_tokens = self.n_docs + 1, self.n_null + (doc_id is None), self.n_tokens + tokens

    def close(self) -> tuple[int, int, int, int]:
        self.out["offsets"].write(np.uint64(self.n_tokens).astype("<u8").tobytes())
        for n, out in self.out.items():
            out.close()
            self.files.move(f"{self._name(n)}.{self.mark}", self._name(n))
        return self.part, self.n_docs, self.n_null, self.n_tokens


@functools.cache
def _word_ids(path: str) -> WordIds:
    return WordIds(path, KNOWN)


def _encode(path: str, end_id: int, kind: str, bounds: np.ndarray):
    """(part, doc_id, row, ids): each document's ids and the part that it belongs to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = _word_ids(path), np.array([end_id], kind).tobytes()
        for batch in text_slices(batches):
            ids = [np.frombuffer(x, "<u4").astype(kind).tobytes() + end for x in encode([t or "" for t in batch.column("text").to_pylist()])]
            key, row = batch.column("doc_id").fill_null(_LEAST).to_numpy(), batch.column("row").to_numpy()
            low, high = np.searchsorted(bounds, key, "left"), np.searchsorted(bounds, key, "right")
            # a doc_id that is several bounds fills several parts
            part = low + row % np.maximum(high - low, 1)
            yield pa.RecordBatch.from_arrays([pa.array(part), batch.column("doc_id"), batch.column("row"), pa.array(ids, pa.binary())], ["part", "doc_id", "row", "ids"])

    return run


def _write(folder: str, id_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = None, []
        for batch in text_slices(batches, "ids"):
            for part, doc_id, ids in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "ids")), strict=True):
                if writer is None or writer.part != part:
                    if writer:
                        done.append(writer.close())
                    writer = _PartWriter(folder, part)
                writer.add(doc_id, ids, len(ids) // id_bytes)
        if writer:
            done.append(writer.close())
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.int64()) for k in range(4)], ["part", "n_docs", "n_null", "n_tokens"])

    return run


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int = 2, part_bytes: int = PART_BYTES) -> None:
    """Write the ids of all rows of `docs` (doc_id, text) under the tokenizers file `path`, `end_id` after each, to `folder`.

    Rows are dealt to parts by ranges of doc_id, as many as the session's shuffle partitions or, if more, one for `part_bytes` of
    text; the driver gets the ranges' bounds and one row of counts from each part. `folder` is a path or URI that driver and
    executors share. Null and empty texts are the end id alone. Rows that share a doc_id are documents of their own, one after
    the other; null ids come first. An empty table gives an empty table of parts. Further columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = "<u2" if max(load_tokenizer(path).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    id_bytes, size = np.dtype(kind).itemsize, docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes))
    cuts = [k / n for k in range(1, n)]
    key = F.coalesce("doc_id", F.lit(int(_LEAST)))
    bounds = docs.agg(F.percentile_approx(key, cuts, max(10_000, 4 * n))).first()[0] if cuts else None
    coded = docs.mapInArrow(_encode(path, end_id, kind, np.array(sorted(bounds or []), np.int64)), "part long, doc_id long, row long, ids binary")
    ordered = coded.repartition(n, "part").sortWithinPartitions("part", "doc_id", "row")
    counts = sorted(ordered.mapInArrow(_write(folder, id_bytes), "part long, n_docs long, n_null long, n_tokens long").collect())
    bases = accumulate((r.n_tokens for r in counts), initial=0)
    firsts = accumulate((r.n_docs for r in counts), initial=0)
    rows = [(*r, base, first, id_bytes) for r, base, first in zip(counts, bases, firsts, strict=False)]
    spark.createDataFrame(rows, _PARTS).coalesce(1).write.parquet(f"{folder}/parts")


class Part:
    """One part's files: memory-mapped where the folder is mounted, read as asked for elsewhere."""

    def __init__(self, folder: str, row):
        self.files, path = _store(folder)
        self.row, self.mounted = row, isinstance(self.files, pyarrow.fs.LocalFileSystem)
        name = lambda kind: f"{path}/{kind}-{row['part']:08d}.bin"
        self.ids, self.offsets = self._open(name("ids"), f"<u{row['id_bytes']}"), self._open(name("offsets"), "<u8")
        self.docs = self._open(name("docs"), "<i8")

    def _open(self, name: str, kind: str):
        if self.mounted:
            return np.memmap(name, kind, "r") if os.path.getsize(name) else np.zeros(0, kind)
        return _Remote(self.files.open_input_file(name), np.dtype(kind))


class _Remote:
    """Slices of a flat file of another store."""

    def __init__(self, file, kind: np.dtype):
        self.file, self.kind = file, kind

    def __getitem__(self, span: slice) -> np.ndarray:
        size = self.kind.itemsize
        return np.frombuffer(self.file.read_at((span.stop - span.start) * size, span.start * size), self.kind)


def _read(folder: str, with_ids: bool):
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                part = Part(folder, row)
                for at in range(0, row["n_docs"], STEP):
                    to = min(at + STEP, row["n_docs"])
                    offsets, docs = np.asarray(part.offsets[at : to + 1]).astype(np.int64), np.asarray(part.docs[at:to])
                    ids = [np.asarray(part.ids[a:b]).astype("<u4") for a, b in zip(offsets, offsets[1:], strict=False)]
                    columns = [pa.array(docs, mask=np.arange(at, to) < row["n_null"]), pa.array(offsets[:-1] + row["base"]), pa.array(np.diff(offsets)), pa.array([zlib.crc32(x) for x in ids], pa.int64())]
                    if with_ids:
                        columns.append(pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(columns, names)

    return run


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Columns (doc_id, start, n_tokens, ids_crc32) of each document of a folder of write_token_files, and its ids if asked for.

    start: the ids of all documents before it; ids_crc32: of its ids as little-endian unsigned 32-bit integers. One task reads a part.
    """
    parts = spark.read.schema(_PARTS).parquet(f"{folder}/parts")
    out = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return parts.repartition(max(1, parts.count())).mapInArrow(_read(folder, with_ids), out)


class TokenFiles:
    """Ids by their place among all ids, for a training loader."""

    def __init__(self, folder: str):
        files, path = _store(folder)
        rows = pyarrow.parquet.read_table(f"{path}/parts", filesystem=files).to_pylist()
        self.parts = [Part(folder, r) for r in sorted(rows, key=lambda r: r["part"])]
        self.bases = np.array([p.row["base"] for p in self.parts], np.int64)
        self.n_tokens = sum(r["n_tokens"] for r in rows)

    def window(self, start: int, length: int) -> np.ndarray:
        """The ids from `start` on, `length` of them or as many as there are."""
        end, out = min(start + length, self.n_tokens), []
        k = max(0, int(np.searchsorted(self.bases, start, "right")) - 1)
        while start < end:
            part, base = self.parts[k], int(self.bases[k])
            to = min(end, base + part.row["n_tokens"])
            out.append(np.asarray(part.ids[start - base : to - base]).astype(np.uint32))
            start, k = to, k + 1
        return np.concatenate(out) if out else np.zeros(0, np.uint32)
