"""Secrets in texts: fixed patterns, and a token-efficiency test for random strings.

A vocabulary trained on ordinary text covers words and identifiers with few tokens; a random string
costs about one token for each character and a half. Runs of key-like characters whose characters per
token stay under a limit are reported, unless they are a known kind of digest or identifier.
"""

from __future__ import annotations

import base64
import functools
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.arrow import text_slices

# The base patterns, in the order in which they are listed.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")

#: What could be a random string, and the least length to judge it by.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])")
#: Characters per token under which a candidate counts as random.
MAX_CHARS_PER_TOKEN = 2.1
#: Bits per character from which it does.
MIN_ENTROPY = 3.5
# Known digests and identifiers, which are no secrets: hexadecimal digests, UUIDs, digests after their name.
KNOWN = re.compile(
    r"[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}"
    r"|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
    r"|sha(?:1|256|384|512)[-=][A-Za-z0-9+/]+={0,2}"
)


@functools.cache
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("scan", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) by the fixed patterns, leftmost and non-overlapping for each kind."""
    found = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    lower = text.lower()
    if any(h in lower for h in ASSIGN_HINTS):
        # a match too short to count still takes its place, so the length is checked afterwards
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    return sorted(found)


def random_spans(text: str, encoding, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates that pass the token-efficiency test and that no span of `taken` holds whole."""
    found = []
    for m in CANDIDATE.finditer(text):
        run, start, end = m[0], m.start(), m.end()
        if any(s <= start and end <= e for s, _, e in taken):
            continue
        if KNOWN.fullmatch(run):
            continue
        bits = -sum(n / len(run) * math.log2(n / len(run)) for n in Counter(run).values())
        if bits >= MIN_ENTROPY and len(run) < MAX_CHARS_PER_TOKEN * len(encoding.encode_ordinary(run)):
            found.append((start, 3, end))
    return found


def _scan(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path, pattern)
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in text_slices(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                spans = sorted(base + random_spans(text or "", encoding, base))
                rows.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(kind))], [*batch.schema.names, "spans"])

    return run


def find_secrets(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """`docs` (doc_id, text) with the columns `keep` and spans array<struct<kind, start, end>>, by start and then kind.

    Positions are code points, the end exclusive. Kinds: assign, access, hex (fixed patterns), random
    (token-efficiency test under the tiktoken file `path` and its split `pattern`; never within one of the
    others, but it can reach beyond one; its candidates are runs of 20 key characters or more without a dot and with at least 3.5 bits of
    entropy a character, so a run of digits alone is none). Null and empty texts have no spans. Repeated rows stay, a null doc_id stays null, an empty
    table gives an empty result; columns other than doc_id, text and `keep` are dropped.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(c for c in keep if c not in ("doc_id", "text")))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_scan(path, pattern), f"{fields}, spans array<struct<kind: string, start: long, end: long>>")


def _listed(spans) -> F.Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digests(found: DataFrame) -> DataFrame:
    """Counts and digests of the spans of find_secrets, one row a document."""
    spans = F.col("spans")
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    base = F.filter(spans, lambda s: s["kind"] != "random")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(spans).alias("spans"), count("random").alias("n_random"))


def redacted(text: F.Column, spans: F.Column, mark: str = "[SECRET]") -> F.Column:
    """`text` with every span, or run of overlapping spans, replaced by `mark`."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc, s):
        fresh = s["start"] >= acc["at"]
        put = F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark))
        return F.struct(F.when(fresh, put).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    def finish(acc):
        return F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))

    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, finish)).otherwise(text)
