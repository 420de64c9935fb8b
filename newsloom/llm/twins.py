"""DuckDB twins of the queries of this subpackage that SQL can express."""

from __future__ import annotations

WARC = """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), f AS (
            SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
        FROM f
    """


def vector_codes(parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> str:
    """SQL for compress_vectors: each round compares every distinct part with its codebook."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
        a{k} AS (
            SELECT d.pos, d.part, d.weight, e.entry, e.gap FROM distinct_parts d, LATERAL (
                SELECT b.entry, list_sum(list_transform(list_zip(d.part, b.words), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS gap
                FROM book{k} b WHERE b.pos = d.pos ORDER BY gap, b.entry LIMIT 1) e
        )""")
        if k < rounds:
            steps.append(f"""
        m{k} AS (
            SELECT pos, entry, k, sum(part[k] * weight)::BIGINT AS total, sum(weight)::BIGINT AS n
            FROM a{k}, range(1, len(part) + 1) t(k) GROUP BY ALL
        ), n{k} AS (
            SELECT pos, entry, list((total - ((total % n) + n) % n) // n ORDER BY k) AS words FROM m{k} GROUP BY pos, entry
        ), book{k + 1} AS (
            SELECT b.pos, b.entry, coalesce(n.words, b.words) AS words FROM book{k} b LEFT JOIN n{k} n USING (pos, entry)
        )""")
    return f"""
        WITH v AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS ints FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), p AS (
            SELECT vec_id, label, pos, ints[pos * (len(ints) // {parts}) + 1 : (pos + 1) * (len(ints) // {parts})] AS part FROM v, range({parts}) t(pos)
        ), distinct_parts AS (
            SELECT pos, part, count(*) AS weight FROM p GROUP BY ALL
        ), first AS (
            SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT {entries}
        ), book0 AS (
            SELECT p.pos, f.entry, p.part AS words FROM p JOIN first f USING (vec_id)
        ), {",".join(steps)},
        each AS (
            SELECT p.vec_id, any_value(p.label) AS label, string_agg(printf('%02x', a.entry), '' ORDER BY p.pos) AS code, sum(a.gap)::BIGINT AS error
            FROM p JOIN a{rounds} a ON p.pos = a.pos AND p.part = a.part GROUP BY p.vec_id
        ), digest AS (
            SELECT sha256(string_agg(array_to_string(words, ','), ',' ORDER BY pos, entry)) AS codebooks_sha256 FROM book{rounds}
        )
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM each, digest
    """


def lexical_search(k: int = 10) -> str:
    """SQL for search_documents."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    term = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    return f"""
        WITH d AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '{term}')) AS term FROM documents
        ), sizes AS (
            SELECT doc_id, count(*)::BIGINT AS n FROM d GROUP BY doc_id
        ), whole AS (
            SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM sizes
        ), q AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '{term}')) AS term FROM benchmark
        ), tf AS (
            SELECT doc_id, term, count(*)::BIGINT AS tf FROM d SEMI JOIN q USING (term) GROUP BY ALL
        ), df AS (
            SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, whole GROUP BY term, docs
        ), impacts AS (
            SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))) AS impact
            FROM tf JOIN df USING (term) JOIN sizes USING (doc_id), whole
        ), scored AS (
            SELECT item_id, doc_id, sum(impact)::BIGINT AS score FROM q JOIN impacts USING (term) GROUP BY ALL
        )
        SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
        FROM scored WHERE score > 0 QUALIFY rank <= {k}
    """
