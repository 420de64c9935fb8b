"""WARC archives of pages: writing, and reading with a check of the chain of record boundaries.

A payload may contain what looks like a record. So tasks only propose records: every place where the
magic stands at the start of a line gives an offset and, from its Content-Length, the offset of its
successor. Real are those that the chain of successors reaches from the file's start, found by
pointer jumping over the offsets of a file.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.shared import materialise, scratch_path

#: Payloads of fewer bytes are never revisits.
LEAST_PAYLOAD = 100
#: Payload bytes and how many records of at most so many a file holds: a reading task holds about 64 MB, or one record.
TIERS = ((1 << 16, 1000), (1 << 20, 64), (1 << 24, 4), (1 << 31, 1))
#: Revisits up to which their ids (16 bytes each) are broadcast; beyond, a shuffle join does it.
BROADCAST_IDS = 500_000
_DATE = "2026-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _uri(page_id, digest, nth) -> F.Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), digest, F.lit(":"), nth, F.lit(">"))


def _one_line(text) -> F.Column:
    """A header value: without line breaks, which would end the header."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\r\n]+", " ")


def _copies_named(rows: DataFrame, names: DataFrame) -> DataFrame:
    """`rows` with `nth`: "0" for one row of each (page_id, digest), something of its own for every other."""
    repeated = materialise(names.where("page_id is not null").groupBy("page_id").count().where("count > 1").select("page_id"), "repeated")
    n_repeated = repeated.count()
    if not n_repeated and not names.where("page_id is null").limit(1).count():
        return rows.withColumn("nth", F.lit("0"))
    repeated = F.broadcast(repeated) if n_repeated <= BROADCAST_IDS else repeated
    plain = rows.where("page_id is not null").join(repeated, "page_id", "left_anti").withColumn("nth", F.lit("0"))
    odd = rows.where("page_id is not null").join(repeated, "page_id", "left_semi").unionByName(rows.where("page_id is null"))
    # equal rows are counted before they are dealt, then told apart by a number
    odd = odd.groupBy("page_id", "digest", "url", "size").agg(F.first("html").alias("html"), F.count("*").alias("copies"))
    least = odd.groupBy(F.col("page_id").alias("of"), F.col("digest").alias("of_digest")).agg(F.min("url").alias("least"))
    odd = odd.join(least, F.col("page_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("of_digest")))
    odd = odd.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)))
    own = F.concat(F.hex(F.xxhash64("url")), F.lit("-"), F.col("copy").cast("string"))
    odd = odd.withColumn("nth", F.when((F.col("url") == F.col("least")) & (F.col("copy") == 0), "0").otherwise(own))
    return plain.unionByName(odd.select(plain.columns))


def write_warc(pages: DataFrame, path: str, least: int = LEAST_PAYLOAD, tiers: tuple[tuple[int, int], ...] = TIERS) -> None:
    """Write a WARC record for each row of `pages` (page_id, url, html) to files under `path`.

    The payload is the html in UTF-8 (null: empty). Of the records with equal payloads of at least `least`
    bytes the one with the least page_id is a response, the others are revisits of it without a block;
    smaller ones are all responses. Rows that repeat a page_id each have a record: with another payload one of
    its own kind, with an equal one (of at least `least` bytes) a revisit, but for the one of least url. Rows without a
    page_id are responses that nothing refers to. Further columns are ignored. An empty table writes no record.

    `tiers` bounds files by bytes: pairs of a payload size and how many records up to that size a file holds.
    """
    columns = [F.col("page_id").cast("long").alias("page_id"), (F.coalesce(F.col("url").cast("string"), F.lit("")) if "url" in pages.columns else F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")]
    rows = pages.select(columns).withColumn("size", F.octet_length("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    names = materialise(rows.select("page_id", "size", "digest"), "digests")
    known = names.where((F.col("size") >= least) & F.col("page_id").isNotNull())
    first = known.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first <> last").drop("last")
    revisits = materialise(known.join(first, "digest").where("page_id <> first").select("page_id", "digest", "first").distinct(), "revisits")
    rows = _copies_named(rows, names)
    few = revisits.count() <= BROADCAST_IDS
    rows = rows.join(F.broadcast(revisits) if few else revisits, ["page_id", "digest"], "left")
    again = (F.col("size") >= least) & F.col("page_id").isNotNull() & (F.col("nth") != "0")
    rows = rows.withColumn("first", F.coalesce("first", F.when(again, F.col("page_id"))))

    again = F.col("first").isNotNull()
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(again, F.lit("")).otherwise(F.concat(head, F.col("html")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", _uri(F.col("page_id"), F.col("digest"), F.col("nth"))),
        line("WARC-Date", F.lit(_DATE)),
        line("WARC-Target-URI", _one_line(F.col("url"))),
        F.when(again, F.concat(line("WARC-Profile", F.lit(_REVISIT)), line("WARC-Refers-To", _uri(F.col("first"), F.col("digest"), F.lit("0"))))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    # the text writer ends each record with the second of the two line breaks that close it
    records = rows.select("size", F.concat(header, block, F.lit("\r\n")).alias("record"))
    tops, below = [top for top, _ in tiers], -1
    held = names.agg(*(F.sum((F.col("size") <= top).cast("long")).alias(f"up_to_{k}") for k, top in enumerate(tops))).first()
    known_rows = 0
    for k, (top, most) in enumerate(tiers):
        if (held[k] or 0) > known_rows or k == 0:
            records.where((F.col("size") > below) & (F.col("size") <= top)).select("record").write.option("lineSep", "\r\n").option("maxRecordsPerFile", most).text(f"{path}/up-to-{top}")
        known_rows, below = held[k] or 0, top


_MAGIC = re.compile(rb"(?:\A|(?<=\n))WARC/1\.[01]\r\n")
_CANDIDATE = "path string, offset long, successor long, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string"
_SCHEMA = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("successor", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])


def _number(value: bytes | None) -> int | None:
    found = re.fullmatch(rb"<urn:page:(-?\d+)(?::[0-9A-Za-z:-]*)?>|(\d+)", value or b"")
    return int(found[1] or found[2]) if found else None


def candidate(data: bytes, offset: int) -> dict | None:
    """What stands at the magic at `offset`, if it has the form of a record."""
    end = data.find(b"\r\n\r\n", offset)
    if end < 0:
        return None
    fields = dict(x.split(b": ", 1) for x in data[offset:end].split(b"\r\n")[1:] if b": " in x)
    length = _number(fields.get(b"Content-Length"))
    if length is None or end + 4 + length + 4 > len(data):
        return None
    block = data[end + 4 : end + 4 + length]
    http = block.find(b"\r\n\r\n")
    payload = block[http + 4 :] if http >= 0 else block
    kind = fields.get(b"WARC-Type", b"").decode("latin-1")
    own = {"payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest()}
    if kind == "revisit":
        own = {"payload_bytes": None, "payload_digest": fields.get(b"WARC-Payload-Digest", b"").decode("latin-1").removeprefix("sha256:")}
    return {"offset": offset, "successor": end + 4 + length + 4, "page_id": _number(fields.get(b"WARC-Record-ID")), "record_type": kind, "refers_to": _number(fields.get(b"WARC-Refers-To"))} | own


def reachable(offsets: np.ndarray, successors: np.ndarray, size: int) -> np.ndarray:
    """Which of the records at rising `offsets` the chain from offset 0 reaches, by pointer jumping."""
    n = len(offsets)
    jump = np.full(n + 1, n)  # n: the end, or a gap
    at = np.searchsorted(offsets, successors)
    hit = (at < n) & (offsets[np.minimum(at, n - 1)] == successors)
    jump[:n] = np.where(hit, at, n)
    seen = np.zeros(n + 1, bool)
    seen[0] = n > 0 and offsets[0] == 0
    while True:
        # all that a known record reaches in 1, 2, 4, ... steps
        before = seen.sum()
        seen[jump[np.flatnonzero(seen)]] = True
        jump = jump[jump]
        if seen.sum() == before and (jump == n).all():
            break
    seen = seen[:n]
    last = np.flatnonzero(seen)
    if n and (not len(last) or successors[last[-1]] != size):
        raise ValueError("the chain of records breaks off before the end of the file")
    return seen


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            data = data.as_py()
            found = [c for m in _MAGIC.finditer(data) if (c := candidate(data, m.start()))]
            yield pa.RecordBatch.from_pylist([{"path": path} | c for c in found] + [{"path": path, "offset": len(data)}], _SCHEMA)


def _verify(table: pa.Table) -> pa.Table:
    table = table.sort_by("offset")
    ends = pc.is_null(table.column("successor"))  # the row that holds the file's size
    size = table.filter(ends).column("offset")[0].as_py()
    records = table.filter(pc.invert(ends))
    if not records.num_rows:
        return records
    keep = reachable(records.column("offset").to_numpy(), records.column("successor").to_numpy(), size)
    return records.filter(pa.array(keep))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records under `path`: (path, offset, successor, page_id, record_type, refers_to, payload_bytes, payload_digest).

    Payload sizes and digests are taken from the stored bytes; a revisit's are those of the response that
    it names. A file whose chain of records does not reach its end raises ValueError. No files: no rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).where("length > 0").select("path", "content")
    proposed = files.mapInArrow(_propose, _CANDIDATE)
    found = materialise(proposed.groupBy("path").applyInArrow(_verify, _CANDIDATE), "records")
    revisited = found.where("record_type = 'revisit'").select(F.col("refers_to").alias("page")).distinct()
    whole = found.where("record_type = 'response'").join(revisited, F.col("page_id") == F.col("page"), "left_semi").select(F.col("page_id").alias("page"), F.col("payload_bytes").alias("whole_bytes"), F.col("payload_digest").alias("whole_digest"))
    out = found.join(whole, (F.col("refers_to") == F.col("page")) & (F.col("payload_digest") == F.col("whole_digest")), "left")
    return out.select("path", "offset", "successor", "page_id", "record_type", "refers_to", F.coalesce("payload_bytes", "whole_bytes").alias("payload_bytes"), "payload_digest")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write `pages` (page_id, url, html) as WARC to the shared folder and read the archives back; see write_warc and read_warc."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_warc(pages, path)
    return read_warc(spark, path)
