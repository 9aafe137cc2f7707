"""DuckDB SQL for the operators that SQL can express. The others are tested against brute force in tests/llm."""

from __future__ import annotations

from .op10_sharding import LIMIT

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _bits(hexadecimal: str) -> str:
    """A string of binary digits of a string of hex digits."""
    out = f"translate({hexadecimal}, '01', 'gh')"
    for digit, value in (("g", 0), ("h", 1), *(("23456789abcdef"[k], k + 2) for k in range(14))):
        out = f"replace({out}, '{digit}', '{value:04b}')"
    return out


def _words(column: str) -> str:
    return rf"coalesce(regexp_extract_all(translate({column}, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"


_OP2 = f"""
WITH d AS (SELECT doc_id, {_words("text")} AS ws FROM documents), b AS (SELECT item_id, {_words("text")} AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(ws), 10)::BIGINT AS n, array_to_string(ws[k : k + least(len(ws), 10) - 1], ' ') AS s FROM b, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) t(k) WHERE len(ws) > 0),
lens AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, i, n, array_to_string(ws[i : i + n - 1], ' ') AS s FROM d, lens, unnest(range(1, greatest(len(ws) - n + 2, 1))) t(i)),
hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN win USING (n, s)),
places AS (SELECT doc_id, count(DISTINCT i + o) AS n_hit FROM hit, unnest(range(n)) t(o) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)"""

_OP4 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, {_bits("sha1(coalesce(html, ''))")} AS bits FROM pages),
c AS (SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (16 * substr(bits, 5 * j + 1, 1)::INT + 8 * substr(bits, 5 * j + 2, 1)::INT + 4 * substr(bits, 5 * j + 3, 1)::INT + 2 * substr(bits, 5 * j + 4, 1)::INT + substr(bits, 5 * j + 5, 1)::INT), 1), '' ORDER BY j) AS digest
      FROM p, (SELECT unnest(range(32))::INT AS j) GROUP BY 1),
m AS (SELECT html, max(page_id) AS best FROM p GROUP BY 1)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to
FROM p JOIN c USING (page_id) JOIN m USING (html)"""

_OP10 = f"""
WITH d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes, {_bits("substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15)")} AS bits FROM documents),
x AS (SELECT doc_id, n_bytes, depth, substr(bits, 1, depth) AS prefix FROM d, (SELECT unnest(range(61))::INT AS depth)),
s AS (SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs FROM x GROUP BY ALL)
SELECT x.doc_id, x.n_bytes, 's' || x.prefix AS shard, x.depth, s.shard_bytes, s.shard_docs, s.shard_bytes <= {LIMIT} AS fits FROM x JOIN s USING (depth, prefix)
WHERE s.shard_bytes <= {LIMIT} OR x.depth = 60 QUALIFY row_number() OVER (PARTITION BY x.doc_id ORDER BY x.depth) = 1"""

_OP8 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, i AS s, substr(h, 2 * i + 1, 2) AS b, CASE WHEN i <= length(h) // 2 - 100 THEN md5_number(substr(h, 2 * i + 1, 200)) END AS w FROM d, unnest(range(length(h) // 2)) t(i)),
f AS (SELECT doc_id, s, b, w IS NOT NULL AND row_number() OVER (PARTITION BY w ORDER BY doc_id, s) > 1 AS again FROM p),
g AS (SELECT doc_id, s, b, max(again::INT) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM f),
e AS (SELECT *, (gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY s), 0) = 0)::INT AS begins FROM g),
r AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, sum(begins)::BIGINT AS n_spans, string_agg(b, '' ORDER BY s) FILTER (WHERE gone = 0) AS kept FROM e GROUP BY 1)
SELECT doc_id, length(h)::BIGINT // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)"""

ORACLES = {"op2_decontamination": _OP2, "op4_warc": _OP4, "op8_substrings": _OP8, "op10_sharding": _OP10}
