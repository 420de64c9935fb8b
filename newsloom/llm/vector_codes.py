"""Compression of vectors to short codes: product codebooks by weighted Lloyd rounds over distinct integer parts.

Components become integers and vectors are cut into parts. At each part position equal parts are one row with
a weight, so that Lloyd's rounds read each distinct part once however many vectors hold it; codes and errors
are then joined back to the vectors. Parts that very many vectors hold go to all tasks in a bounded list, the
others meet their vectors in a shuffle join, so no part and no group of copies is one task's work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.shared import materialise

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors with a larger absolute component take no part: 64-bit integers could not hold their errors.
LARGEST = 1 << 19
#: Most frequent parts that are coded where the vectors are read (at most so many rows reach the driver).
LISTED = 65_536
#: Labels up to this number are sent to all tasks with their errors; more meet the rows in a shuffle join.
BROADCAST_LABELS = 65_536
#: Parts compared with their codebook at a time.
STEP = 8192

_COUNTED = "position int, part binary, weight long"
_CODED = "position int, part binary, weight long, entry int, distance long"
_KNOWN = "row long, codes array<struct<position: int, entry: int>>, error long, position int, part binary"


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _cut(batch: pa.RecordBatch) -> np.ndarray:
    """(rows, PARTS, width) integers of a batch's vectors."""
    return _matrix(batch.column("ints"), batch.num_rows).reshape(batch.num_rows, PARTS, -1)


def _bytes(parts: np.ndarray) -> pa.Array:
    """Parts (n, width) as binary values."""
    data = np.ascontiguousarray(parts.astype("<i4"))
    size = data.shape[1] * 4
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer((np.arange(len(data) + 1) * size).astype(np.int32)), pa.py_buffer(data)])


def _ints(parts: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(parts.to_pylist()), "<i4").reshape(len(parts), -1).astype(np.int64)


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of integer parts (n, width) the nearest entries of `book` (k, width), ties to the lower index, and the squared distances."""
    entry, distance = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
    for at in range(0, len(parts), STEP):
        gap = np.zeros((len(parts[at : at + STEP]), len(book)), np.int64)
        for k in range(parts.shape[1]):
            gap += (parts[at : at + STEP, k, None] - book[None, :, k]) ** 2
        entry[at : at + STEP] = gap.argmin(1)
        distance[at : at + STEP] = gap.min(1)
    return entry, distance


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            cut = _cut(batch)
            for p in range(PARTS):
                parts, weight = np.unique(cut[:, p], axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(parts), p, np.int32)), _bytes(parts), pa.array(weight)], ["position", "part", "weight"])


def _by_position(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(position, rows of the batch at it, their parts)."""
    position, parts = batch.column("position").to_numpy(), _ints(batch.column("part"))
    for p in np.unique(position):
        rows = np.flatnonzero(position == p)
        yield int(p), rows, parts[rows]


def _sums(books: np.ndarray):
    """(position, entry, place, total, weight): weighted sums of the distinct parts nearest to each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            if batch.num_rows:
                times = batch.column("weight").to_numpy()
                for p, rows, parts in _by_position(batch):
                    entry, _ = nearest(parts, books[p])
                    np.add.at(total[p], entry, parts * times[rows, None])
                    np.add.at(weight[p], entry, times[rows])
        p, e, k = np.nonzero(np.broadcast_to(weight[:, :, None] > 0, books.shape))
        columns = [p.astype(np.int32), e.astype(np.int32), k.astype(np.int32), total[p, e, k], weight[p, e]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["position", "entry", "place", "total", "weight"])

    return run


def _assign(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entry, distance = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            if batch.num_rows:
                for p, rows, parts in _by_position(batch):
                    entry[rows], distance[rows] = nearest(parts, books[p])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(entry), pa.array(distance)], ["position", "part", "weight", "entry", "distance"])

    return run


def _look_up(listed):
    """For each vector a row (row, codes, error) of its listed parts, and rows (row, position, part) of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, bytes], tuple[int, int]] = listed.value
        for batch in batches:
            if not batch.num_rows:
                continue
            cut, ids = _cut(batch), batch.column("row").to_pylist()
            keys = [_bytes(cut[:, p]).to_pylist() for p in range(PARTS)]
            rows, codes, errors, others = ids, [], [], []
            for k, row in enumerate(ids):
                found = [(p, known.get((p, keys[p][k]))) for p in range(PARTS)]
                codes.append([{"position": p, "entry": hit[0]} for p, hit in found if hit])
                errors.append(sum(hit[1] for _, hit in found if hit))
                others += [(row, p, keys[p][k]) for p, hit in found if not hit]
            n, m = len(rows), len(others)
            pairs = pa.list_(pa.struct([("position", pa.int32()), ("entry", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*rows, *(o[0] for o in others)], pa.int64()),
                    pa.array([*codes, *[None] * m], pairs),
                    pa.array([*errors, *[None] * m], pa.int64()),
                    pa.array([*[None] * n, *(o[1] for o in others)], pa.int32()),
                    pa.array([*[None] * n, *(o[2] for o in others)], pa.binary()),
                ],
                ["row", "codes", "error", "position", "part"],
            )

    return run


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, label, ints) of the vectors that take part: without null or non-finite components, of the most frequent
    length that 16 divides (the shorter of equally frequent ones), no component beyond 2**19; row: a number of its own."""
    x = F.col("embedding")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= F.lit(float(LARGEST))))
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), x).where(x.isNotNull() & (F.size(x) > 0) & (F.size(x) % PARTS == 0))
    rows = rows.where(F.coalesce(good, F.lit(False)))
    sizes = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).first()
    rows = rows.where(F.size("embedding") == (sizes["size"] if sizes else 0))
    ints = F.transform("embedding", lambda v: F.floor(v.cast("double") * SCALE).cast("int"))
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", ints.alias("ints"))


def fit_codebooks(rows: DataFrame, distinct: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (positions, entries, width): they start as the parts of the rows of smallest vec_id, then each round puts every
    entry to the floored mean of the parts nearest to it, counted by weight. Only codebooks pass through the driver."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).select("ints").collect()
    books = np.array([r.ints for r in first], np.int64).reshape(len(first), PARTS, -1).transpose(1, 0, 2)
    for _ in range(rounds):
        sums = distinct.mapInArrow(_sums(books), "position int, entry int, place int, total long, weight long")
        books = books.copy()
        for r in sums.groupBy("position", "entry", "place").agg(F.sum("total").alias("total"), F.sum("weight").alias("weight")).collect():
            books[r.position, r.entry, r.place] = r.total // r.weight
    return books


def codebooks_digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components by position, entry and place, in decimals with commas between."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def _frequent(coded: DataFrame, most: int) -> dict:
    """(position, part) -> (entry, distance) of the parts so frequent that no more than `most` are."""
    least, total = None, 0
    for weight, n in coded.groupBy("weight").count().orderBy(F.desc("weight")).limit(most + 1).collect():
        total += n
        if total > most:
            break
        least = weight
    if least is None:
        return {}
    return {(r.position, bytes(r.part)): (r.entry, r.distance) for r in coded.where(F.col("weight") >= least).drop("weight").collect()}


def compress_vectors(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, listed: int = LISTED) -> DataFrame:
    """Columns (vec_id, code, error, label_error, codebooks_sha256), one row for each row of `vectors` (vec_id, embedding, label)
    that takes part (see integer_vectors).

    code: the entry of each part in two hex digits; error: the squared distances to them, summed; label_error: error summed over
    the rows of an equal label, nulls together. With fewer rows than `entries` the codebooks are as small. Of rows
    that share a vec_id the one of the least vector comes first in the codebooks; null ids come last. Repeated rows stay. No
    valid row: no rows. Further columns are ignored, a missing label counts as null. `listed` only affects speed.
    """
    spark = vectors.sparkSession
    rows = materialise(integer_vectors(vectors), "integer-vectors")
    counted = rows.select("ints").mapInArrow(_count, _COUNTED)
    distinct = materialise(counted.groupBy("position", "part").agg(F.sum("weight").alias("weight")), "distinct-parts")
    if distinct.limit(1).count() == 0:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    books = fit_codebooks(rows, distinct, entries, rounds)
    coded = materialise(distinct.mapInArrow(_assign(books), _CODED), "coded-parts")
    known = spark.sparkContext.broadcast(_frequent(coded, listed))
    found = materialise(rows.select("row", "ints").mapInArrow(_look_up(known), _KNOWN), "known-parts")
    others = found.where("part is not null").select("row", "position", "part").join(coded.select("position", "part", "entry", "distance"), ["position", "part"])
    others = others.select("row", F.array(F.struct("position", "entry")).alias("codes"), F.col("distance").alias("error"))
    every = found.where("part is null").select("row", "codes", "error").unionByName(others)
    whole = every.groupBy("row").agg(F.sort_array(F.flatten(F.collect_list("codes"))).alias("codes"), F.sum("error").alias("error"))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c["entry"]), 2, "0"))), "")
    each = materialise(rows.select("row", "vec_id", "label").join(whole, "row").select("vec_id", "label", code.alias("code"), "error"), "vector-codes")
    totals = each.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of_label")
    if totals.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        totals = F.broadcast(totals)
    out = each.join(totals, F.col("label").eqNullSafe(F.col("of_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
