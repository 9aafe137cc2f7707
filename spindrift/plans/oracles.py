"""DuckDB SQL for the catalogue's queries, written apart from the Spark code."""

from __future__ import annotations

_VIEWS = """
v(kind, ord, w) AS (VALUES ('full', 0, 64), ('center90', 1, 58), ('center80', 2, 52), ('center70', 3, 44), ('center60', 4, 38)),
e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
s AS (SELECT vec_id, kind, ord, w, x[(64 - w) // 2 + 1 : (64 - w) // 2 + w] AS s FROM e, v),
m AS (SELECT *, (list_sort(s)[w // 2] + list_sort(s)[w // 2 + 1]) / 2 AS med FROM s),
b AS (SELECT vec_id, kind, ord, i, (s[(i * w) // 64 + 1] > med)::BIGINT AS p, (s[((i * w) // 64 + 1) % w + 1] > s[(i * w) // 64 + 1])::BIGINT AS d FROM m, range(64) t(i)),
h AS (SELECT vec_id, kind, ord,
        sum(CASE WHEN i < 32 THEN p * (1::BIGINT << (31 - i)) ELSE 0 END)::BIGINT AS p1, sum(CASE WHEN i >= 32 THEN p * (1::BIGINT << (63 - i)) ELSE 0 END)::BIGINT AS p2,
        sum(CASE WHEN i < 32 THEN d * (1::BIGINT << (31 - i)) ELSE 0 END)::BIGINT AS d1, sum(CASE WHEN i >= 32 THEN d * (1::BIGINT << (63 - i)) ELSE 0 END)::BIGINT AS d2
      FROM b GROUP BY ALL),
sv AS (SELECT vec_id, kind, ord, format('{:08x}{:08x}', p1, p2) AS phash, format('{:08x}{:08x}', d1, d2) AS dhash FROM h
       QUALIFY row_number() OVER (PARTITION BY vec_id, p1, p2, d1, d2 ORDER BY ord) = 1)"""

_BANDS = _VIEWS + """,
bi AS (SELECT DISTINCT vec_id, j AS band, substr(phash, 2 * j + 1, 2) AS value FROM sv, range(8) t(j)),
bc AS (SELECT q.vec_id AS query_id, c.vec_id AS cand_id, count(*) AS hits FROM bi q JOIN bi c ON q.band = c.band AND q.value = c.value WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id GROUP BY ALL),
cand AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, cand_id DESC) AS rank FROM bc QUALIFY rank <= 120)"""

_BEST = _BANDS + """,
ham AS (SELECT c.query_id, c.cand_id, a.ord AS qo, z.ord AS co,
          100.0::DOUBLE * (1 - (bit_count(xor(('0x' || a.phash)::UBIGINT, ('0x' || z.phash)::UBIGINT)))::DOUBLE / 64) AS p,
          100.0::DOUBLE * (1 - (bit_count(xor(('0x' || a.dhash)::UBIGINT, ('0x' || z.dhash)::UBIGINT)))::DOUBLE / 64) AS d
        FROM cand c JOIN sv a ON a.vec_id = c.query_id JOIN sv z ON z.vec_id = c.cand_id),
bp AS (SELECT query_id, cand_id, p, d, round(0.62::DOUBLE * p + 0.18::DOUBLE * d, 6) AS light FROM ham
       QUALIFY row_number() OVER (PARTITION BY query_id, cand_id ORDER BY p + 0.25::DOUBLE * d DESC, qo, co) = 1)"""

_COSINE = """
ce AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
cs AS (SELECT q.vec_id AS query_id, c.vec_id AS cand_id, round(list_cosine_similarity(q.x, c.x), 6) AS score FROM ce q JOIN ce c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
ck AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cand_id DESC) AS rank FROM cs QUALIFY rank <= 48)"""

_LSH = """
pl AS (SELECT j, i, CASE WHEN substr(md5(j::VARCHAR || ':' || i::VARCHAR), 1, 1) < '8' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS s FROM range(64) a(j), range(64) b(i)),
ve AS (SELECT vec_id, (embedding::DOUBLE[])[i + 1] AS x, i FROM embeddings, range(64) t(i)),
sb AS (SELECT vec_id, j, (sum(x * s) >= 0)::BIGINT AS bit FROM ve JOIN pl USING (i) GROUP BY ALL),
lb AS (SELECT vec_id, j // 8 AS band, sum(bit << (7 - j % 8))::BIGINT AS value FROM sb GROUP BY ALL),
lc AS (SELECT q.vec_id AS query_id, c.vec_id AS cand_id, count(*) AS hits FROM lb q JOIN lb c ON q.band = c.band AND q.value = c.value WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id GROUP BY ALL),
lv AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, cand_id DESC) AS rank FROM lc QUALIFY rank <= 2500)"""


def _percent(a: int, b: int, low: int) -> str:
    return f"({low} + (event_id * {a} + {b}) % 1000 * ({(100 - low) / 1000.0!r}::DOUBLE))::DOUBLE"


_SIGNALS = f"""
sg AS (SELECT event_id % 97 AS query_id, event_id AS cand_id, {_percent(7, 3, 70)} AS p, {_percent(11, 5, 70)} AS d, {_percent(13, 1, 70)} AS roi, {_percent(17, 2, 60)} AS hist, {_percent(19, 4, 40)} AS orb, {_percent(23, 6, 0)} AS ai, {_percent(29, 8, 55)} AS cp, {_percent(31, 9, 50)} AS g,
       event_id * 3 % 40 AS inl, (event_id * 37 % 100)::DOUBLE / 100 AS rat, (event_id * 41 % 100)::DOUBLE / 400 AS cq, (event_id * 43 % 100)::DOUBLE / 250 AS cc, {_percent(47, 10, 0)} AS ssim, (event_id * 53 % 100)::DOUBLE / 200 AS ov, event_id % 5 <> 0 AS sane, event_id % 7 = 0 AS low FROM events),
f1 AS (SELECT *, least(cq, cc) AS lo, greatest(cq, cc) AS hi,
       (p >= 92)::INT + (d >= 90)::INT + (roi >= 90)::INT + (orb >= 75)::INT + (g >= 84)::INT + (cp >= 82)::INT AS independent,
       0.24::DOUBLE * p + 0.08::DOUBLE * d + 0.10::DOUBLE * roi + 0.07::DOUBLE * hist + 0.15::DOUBLE * orb + 0.06::DOUBLE * ai + 0.30::DOUBLE * cp AS base FROM sg),
f2 AS (SELECT *, g >= 96 AND inl >= 24 AND rat >= 0.60 AND sane AND lo >= 0.055 AND hi >= 0.18 AND ssim >= 62 AND ov >= 0.10 AS ultra,
       g >= 90 AND inl >= 16 AND rat >= 0.50 AND sane AND lo >= 0.025 AND hi >= 0.10 AND (cp >= 68 OR p >= 88 OR roi >= 88) AS geo,
       NOT low AND p >= 98 AND greatest(d, roi) >= 95 AND hist >= 82 AND (cp >= 72 OR orb >= 72 OR g >= 82) AS hsh,
       NOT low AND p >= 92 AND orb >= 72 AND (cp >= 66 OR g >= 72) AND independent >= 3 AS combo,
       NOT low AND cp >= 84 AND (g >= 72 OR p >= 84 OR roi >= 84 OR orb >= 66) AS scp,
       NOT low AND cp >= 94 AND (p >= 78 OR roi >= 78 OR orb >= 55 OR g >= 60) AS vcp,
       low AND p >= 99 AND d >= 97 AND hist >= 98 AND cp >= 94 AND g >= 70 AS safe,
       g >= 84 AND inl >= 9 AND rat >= 0.40 AND sane AND lo >= 0.015 AND hi >= 0.065 AS mid FROM f1),
f3 AS (SELECT *, ultra OR geo OR safe OR (NOT low AND (hsh OR combo OR scp OR vcp)) AS strong,
       cp >= 80 AS s_copy, greatest(p, roi) >= 88 AND d >= 76 AS s_hash, mid OR orb >= 72 AS s_local, ssim >= 46 AND ov >= 0.10 AND hist >= 68 AS s_look FROM f2),
f4 AS (SELECT *, strong OR (NOT low AND ((s_copy AND (s_hash OR s_local OR s_look)) OR (s_local AND s_hash) OR (cp >= 90 AND (p >= 76 OR roi >= 76 OR mid)))) AS suspect,
       (ultra AND ssim >= 70) OR (geo AND cp >= 72 AND (ssim >= 30 OR p >= 90)) OR (NOT low AND cp >= 90 AND g >= 82 AND inl >= 12) OR (hsh AND cp >= 80) AS learn_safe,
       greatest(base, g, CASE WHEN hsh THEN 90 + (p - 96) * 1.5::DOUBLE ELSE 0 END,
         CASE WHEN scp THEN 90 + least(9.3::DOUBLE, greatest(0, cp - 82) * 0.62::DOUBLE + greatest(0, g - 76) * 0.08::DOUBLE) WHEN vcp THEN 92 + least(7.0::DOUBLE, (cp - 91) * 0.75::DOUBLE) WHEN cp >= 70 THEN least(89.75::DOUBLE, 82 + (cp - 70) * 0.48::DOUBLE) ELSE 0 END,
         CASE WHEN safe THEN 92 + least(5.0::DOUBLE, (hist - 97) * 0.6::DOUBLE + (cp - 90) * 0.25::DOUBLE) ELSE 0 END) AS raw FROM f3),
fu AS (SELECT *, least(99.6::DOUBLE, greatest(0::DOUBLE, least(raw, CASE WHEN strong THEN 1000::DOUBLE ELSE 89.75::DOUBLE END, CASE WHEN suspect THEN 1000::DOUBLE ELSE 84.75::DOUBLE END))) AS score FROM f4)"""

_HALVES = """
o AS (SELECT c_custkey, c_name AS name, c_mktsegment AS segment, c_acctbal AS balance FROM customer WHERE c_custkey % 3 <> 0),
n AS (SELECT c_custkey, upper(c_name) AS name, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE lower(c_mktsegment) END AS segment, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal + 1 END AS balance FROM customer WHERE c_custkey % 2 = 0)"""

_TURNS = """
t AS (SELECT conv_id, turn, role, length(coalesce(text, '')) AS n, role = 'system' AS service, length(coalesce(text, '')) % 3 = 0 AS joined,
      CASE WHEN length(coalesce(text, '')) % 4 = 0 THEN length(coalesce(text, '')) END AS media, length(coalesce(text, '')) % 5 = 0 AS record FROM conversations)"""

_FUSE = "f1 AS" + _SIGNALS.split("f1 AS", 1)[1]
_EMB = """
emb AS (SELECT vec_id, embedding::DOUBLE[] AS embedding FROM embeddings UNION ALL
        SELECT vec_id + 1000000, list_transform(range(64), lambda i: CASE WHEN i % 8 = 0 AND vec_id % 100 <> 0 THEN 0.0 ELSE embedding[i + 1] END)::DOUBLE[] FROM embeddings WHERE vec_id % 20 = 0)"""


def _apart(sql: str) -> str:
    """The same search, of altered copies in the library."""
    return sql.replace("FROM embeddings", "FROM emb").replace("q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id", "q.vec_id >= 1000000 AND c.vec_id < 1000000").replace("JOIN ce c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0", "JOIN ce c ON q.vec_id >= 1000000 AND c.vec_id < 1000000")


_CHECK = f"""
WITH {_EMB}, {_apart(_BANDS)}, {_apart(_COSINE)},
dg AS (SELECT vec_id, string_agg(ord::VARCHAR || ':' || phash || ':' || dhash, ',' ORDER BY ord) AS dig FROM sv GROUP BY 1),
same AS (SELECT q.vec_id AS query_id, min(c.vec_id) AS cand_id FROM dg q JOIN dg c USING (dig) WHERE q.vec_id >= 1000000 AND c.vec_id < 1000000 GROUP BY 1),
pr AS (SELECT query_id, cand_id FROM cand UNION SELECT query_id, cand_id FROM ck),
hm AS (SELECT c.query_id, c.cand_id, a.ord AS qo, z.ord AS co, 100.0::DOUBLE * (1 - (bit_count(xor(('0x' || a.phash)::UBIGINT, ('0x' || z.phash)::UBIGINT)))::DOUBLE / 64) AS p, 100.0::DOUBLE * (1 - (bit_count(xor(('0x' || a.dhash)::UBIGINT, ('0x' || z.dhash)::UBIGINT)))::DOUBLE / 64) AS d
       FROM pr c JOIN sv a ON a.vec_id = c.query_id JOIN sv z ON z.vec_id = c.cand_id),
bq AS (SELECT query_id, cand_id, p, d FROM hm QUALIFY row_number() OVER (PARTITION BY query_id, cand_id ORDER BY p + 0.25::DOUBLE * d DESC, qo, co) = 1),
sg AS (SELECT query_id, cand_id, p, d, 0::DOUBLE AS roi, 0::DOUBLE AS hist, 0::DOUBLE AS orb, 0::DOUBLE AS ai, greatest(0, 100 * score)::DOUBLE AS cp, 0::DOUBLE AS g, 0 AS inl, 0::DOUBLE AS rat, 0::DOUBLE AS cq, 0::DOUBLE AS cc, 0::DOUBLE AS ssim, 0::DOUBLE AS ov, false AS sane, false AS low FROM bq JOIN cs USING (query_id, cand_id)),
{_FUSE},
pick AS (SELECT * REPLACE (round(score, 6) AS score) FROM fu WHERE query_id NOT IN (SELECT query_id FROM same) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, cand_id DESC) = 1)
SELECT query_id, cand_id, CASE WHEN score >= 85 THEN round(score, 2) ELSE 0.0::DOUBLE END AS score, CASE WHEN score >= 85 THEN 'similar' ELSE 'new' END AS verdict,
  CASE WHEN score < 85 THEN NULL WHEN cp >= 82 AND cp >= greatest(g, p) THEN 'copy_model' WHEN g >= 84 THEN 'local_match' WHEN p >= 92 THEN 'high_similarity' ELSE 'visual_similarity' END AS match_type, CASE WHEN score >= 90 THEN 'confirm' WHEN score >= 85 THEN 'review' ELSE 'none' END AS action FROM pick
UNION ALL SELECT query_id, cand_id, 100.0::DOUBLE, 'same', 'digest', 'confirm' FROM same"""

_KIND = "CASE WHEN cp >= 82 AND cp >= greatest(g, p) THEN 'copy_model' WHEN g >= 84 THEN 'local_match' WHEN p >= 92 THEN 'high_similarity' ELSE 'visual_similarity' END"

ORACLES = {
    "cascade12": f"""
        WITH {_SIGNALS}, l AS (SELECT query_id, cand_id, cp, round(0.62::DOUBLE * p + 0.18::DOUBLE * d + 0.20::DOUBLE * roi, 6) AS light, round(base, 6) AS base FROM fu),
        a AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY greatest(light, cp) DESC, cand_id DESC) <= 32)
        SELECT query_id, cand_id, light, base, row_number() OVER (PARTITION BY query_id ORDER BY greatest(base, light, cp) DESC, cand_id DESC) AS place FROM a QUALIFY place <= 12""",
    "review_records": f"""
        WITH {_SIGNALS}, r AS (SELECT * REPLACE (round(score, 6) AS score, cand_id // 3 AS query_id) FROM fu QUALIFY row_number() OVER (PARTITION BY cand_id // 3 ORDER BY round(score, 6) DESC, cand_id DESC) = 1) SELECT query_id, cand_id AS matched_id, {_KIND} AS match_type, round(score, 2) AS score, 'pending' AS status FROM r WHERE score >= 85 AND score < 90""",
    "buffer_state": """
        SELECT user_id, event_type, event_id, ts FROM events WHERE event_type = 'view' UNION ALL
        SELECT user_id, event_type, event_id, ts FROM events WHERE event_type = 'click' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "buffer_restore": """
        WITH a AS (SELECT event_id, (epoch_us(m.now) - epoch_us(ts))::DOUBLE / 1000000 + 1800 AS age FROM events, (SELECT max(ts) AS now FROM events) m)
        SELECT event_id, CASE WHEN age > 7200 THEN 'purged' WHEN age > 3600 THEN 'expired' ELSE 'live' END AS state, CASE WHEN age <= 3600 THEN greatest(1::DOUBLE, 3600 - age) END AS left FROM a""",
    "last_wins_lookup": """
        SELECT c_custkey AS user_id, l.event_type FROM customer LEFT JOIN (SELECT user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) l ON l.user_id = c_custkey""",
    "most_frequent_type": """
        SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, length(event_type) DESC, event_type DESC) = 1""",
    "import_counters": f"""
        WITH {_TURNS} SELECT count(*) AS scanned, count(*) FILTER (WHERE service) AS services, count(media) AS with_media, count(*) FILTER (WHERE record) AS records, count(*) FILTER (WHERE media IS NOT NULL AND NOT record) AS media_without_record FROM t""",
    "stale_paths": "SELECT page_id, url FROM pages WHERE url IS NULL OR url = '' OR url NOT LIKE 'https://%'",
    "supplier_cards": """
        SELECT s_suppkey, 'name: ' || s_name || CASE WHEN s_nationkey BETWEEN 10 AND 14 THEN '' WHEN s_nationkey < 5 THEN chr(10) || 'nation: ' || s_name ELSE chr(10) || 'nation: ' || s_nationkey END AS card FROM supplier""",
    "backlog_batch": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 20",
    "check_library": _CHECK,
    "import_clusters": """
        WITH RECURSIVE r AS (SELECT conv_id * 1000 + turn AS id, role, turn FROM conversations), p AS (SELECT id, id - 1 AS up FROM r WHERE turn > 0 AND role <> 'system' AND id - 1 IN (SELECT id FROM r)),
        w AS (SELECT id, id AS cluster_id FROM r WHERE id NOT IN (SELECT id FROM p) UNION ALL SELECT p.id, w.cluster_id FROM w JOIN p ON p.up = w.id) SELECT id, cluster_id FROM w""",
    "dup_documents": """
        SELECT d.doc_id, c.canonical_id FROM documents d
        JOIN (SELECT md5(text) AS k, min(doc_id) AS canonical_id, count(*) AS n FROM documents GROUP BY 1) c ON md5(d.text) = c.k WHERE c.n > 1""",
    "digest_any": """
        SELECT q.doc_id AS query_id, min(l.doc_id) AS matched_id FROM documents q JOIN documents l ON sha256(q.text) = sha256(l.text) OR md5(q.text) = md5(l.text) GROUP BY 1""",
    "insert_if_absent": """
        WITH k AS (SELECT DISTINCT doc_id FROM labels), f AS (SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM k) AND text NOT IN (SELECT text FROM documents JOIN k USING (doc_id)))
        SELECT doc_id, length(text)::BIGINT AS n FROM f QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""",
    "coverage_stats": """
        SELECT total, indexed, greatest(0, total - indexed) AS backlog, CASE WHEN total = 0 THEN 100.0::DOUBLE ELSE round(100.0::DOUBLE * indexed / total, 6) END AS percent
        FROM (SELECT count(*) AS total FROM documents), (SELECT count(DISTINCT doc_id) AS indexed FROM labels)""",
    "label_backlog": "SELECT d.doc_id, d.source FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL",
    "orphan_keys": "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) AND o_orderkey NOT IN (SELECT user_id FROM events WHERE user_id < 0)",
    "sig_views": f"WITH {_VIEWS} SELECT vec_id, kind, ord, phash, dhash FROM sv",
    "band_index": f"WITH {_VIEWS} SELECT DISTINCT vec_id, j::INT AS band, substr(phash, (2 * j + 1)::INT, 2) AS value FROM sv, range(8) t(j)",
    "band_candidates": f"WITH {_BANDS} SELECT query_id, cand_id, hits, rank FROM cand",
    "hamming_best_pair": f"WITH {_BEST} SELECT query_id, cand_id, p, d, light FROM bp",
    "cosine_topk": f"WITH {_COSINE} SELECT query_id, cand_id, score, rank FROM ck",
    "simhash_lsh_vote": f"WITH {_LSH} SELECT query_id, cand_id, hits, rank FROM lv",
    "exact_or_lsh": f"WITH {_COSINE} SELECT query_id, cand_id, score, rank FROM ck",
    "lsh_rescored": f"WITH {_COSINE}, {_LSH} SELECT query_id, cand_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cand_id DESC) AS rank FROM cs JOIN (SELECT query_id, cand_id FROM lv) USING (query_id, cand_id) QUALIFY rank <= 48",
    "candidate_union": f"WITH {_BEST}, {_COSINE} SELECT query_id, cand_id, max(score) AS score FROM (SELECT query_id, cand_id, light / 100 AS score FROM bp UNION ALL SELECT query_id, cand_id, score FROM ck) GROUP BY ALL",
    "knn_mutual": """
        WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
        p AS (SELECT a.vec_id AS a_id, b.vec_id AS b_id, round(list_cosine_similarity(a.x, b.x), 6) AS score FROM e a JOIN e b ON a.label = b.label AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1),
        f AS (SELECT *, sqrt(greatest(2 - 2 * score, 0)) AS far FROM p),
        r AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY score DESC, b_id) AS ra, lead(far) OVER (PARTITION BY a_id ORDER BY score DESC, b_id) AS na,
                        row_number() OVER (PARTITION BY b_id ORDER BY score DESC, a_id) AS rb, lead(far) OVER (PARTITION BY b_id ORDER BY score DESC, a_id) AS nb FROM f)
        SELECT a_id, b_id, score FROM r WHERE ra = 1 AND rb = 1 AND (na IS NULL OR far < na * 0.99::DOUBLE) AND (nb IS NULL OR far < nb * 0.99::DOUBLE)""",
    "fusion_scores": f"WITH {_SIGNALS} SELECT query_id, cand_id, round(base, 6) AS base, round(score, 6) AS score, strong, suspect, learn_safe, independent FROM fu",
    "fusion_verdict": f"""
        WITH {_SIGNALS}, b AS (SELECT * REPLACE (round(score, 6) AS score) FROM fu QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, cand_id DESC) = 1)
        SELECT query_id, cand_id, CASE WHEN score >= 85 THEN round(score, 2) ELSE 0.0::DOUBLE END AS score, CASE WHEN score >= 85 THEN 'similar' ELSE 'new' END AS verdict,
          CASE WHEN score < 85 THEN NULL WHEN cp >= 82 AND cp >= greatest(g, p) THEN 'copy_model' WHEN g >= 84 THEN 'local_match' WHEN p >= 92 THEN 'high_similarity' ELSE 'visual_similarity' END AS match_type,
          CASE WHEN score >= 90 THEN 'confirm' WHEN score >= 85 THEN 'review' ELSE 'none' END AS action, strong, learn_safe FROM b""",
    "veto": f"WITH {_SIGNALS} SELECT query_id, cand_id, round(CASE WHEN ssim < 56 THEN 0 ELSE score END, 6) AS score, strong AND ssim >= 56 AS strong FROM fu",
    "exclusion_filter": f"""
        WITH {_BANDS}, fv AS (SELECT vec_id, phash FROM sv WHERE kind = 'full'),
        c AS (SELECT query_id, cand_id, phash, label AS cluster_id FROM cand JOIN fv ON fv.vec_id = query_id JOIN embeddings l ON l.vec_id = cand_id),
        x AS (SELECT phash, vec_id + 1 AS m, CASE WHEN vec_id % 400 = 0 THEN label END AS k FROM fv JOIN embeddings USING (vec_id) WHERE vec_id % 200 = 0),
        hit AS (SELECT DISTINCT query_id, m, k FROM c JOIN x ON md5(c.phash) = md5(x.phash) OR bit_count(xor(('0x' || c.phash)::UBIGINT, ('0x' || x.phash)::UBIGINT)) <= 2)
        SELECT query_id, cand_id, cluster_id FROM c WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.query_id = c.query_id AND (hit.m = c.cand_id OR hit.k = c.cluster_id))""",
    "exclusion_vectors": f"""
        WITH {_COSINE}, c AS (SELECT query_id, cand_id, rank, label AS cluster_id FROM ck JOIN embeddings l ON l.vec_id = cand_id),
        x AS (SELECT e.label AS k, ck.cand_id AS m, list_transform(range(64), lambda i: CASE WHEN i % 16 = 0 THEN e.embedding[i + 1]::DOUBLE / 2 ELSE e.embedding[i + 1]::DOUBLE END) AS y FROM embeddings e JOIN ck ON ck.query_id = e.vec_id AND rank = 1 WHERE e.vec_id % 100 = 0),
        hit AS (SELECT DISTINCT vec_id AS query_id, m, k FROM ce JOIN x ON vec_id % 20 = 0 AND round(list_cosine_similarity(ce.x, x.y), 6) >= 0.96)
        SELECT query_id, cand_id, cluster_id FROM c WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.query_id = c.query_id AND (hit.m = c.cand_id OR hit.k = c.cluster_id))""",
    "review_transition": """
        SELECT user_id AS review_id, CASE WHEN event_type = 'click' THEN 'confirmed' ELSE 'false_positive' END AS status, ts FROM events WHERE event_type IN ('click', 'error')
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1""",
    "merge_upsert": f"""
        WITH {_HALVES} SELECT c_custkey, CASE WHEN n.c_custkey IS NULL THEN o.name ELSE n.name END AS name, CASE WHEN n.c_custkey IS NULL OR n.segment = '' THEN o.segment ELSE n.segment END AS segment,
        round(coalesce(n.balance, o.balance), 2) AS balance FROM o FULL JOIN n USING (c_custkey)""",
    "audit_log": f"""
        WITH {_HALVES}, j AS (SELECT o.c_custkey, o.name AS a1, n.name AS b1, o.segment AS a2, n.segment AS b2 FROM o JOIN n USING (c_custkey))
        SELECT c_custkey, 'name' AS field, a1 AS old_value, b1 AS new_value FROM j WHERE a1 IS DISTINCT FROM b1 UNION ALL SELECT c_custkey, 'segment', a2, b2 FROM j WHERE a2 IS DISTINCT FROM b2""",
    "field_conflicts": f"""
        WITH {_HALVES}, j AS (SELECT o.c_custkey, o.name AS a1, n.name AS b1, o.segment AS a2, n.segment AS b2 FROM o JOIN n USING (c_custkey))
        SELECT c_custkey, 'name' AS field, a1 AS existing, b1 AS incoming FROM j WHERE a1 <> '' AND b1 <> '' AND a1 <> b1 UNION ALL SELECT c_custkey, 'segment', a2, b2 FROM j WHERE a2 <> '' AND b2 <> '' AND a2 <> b2""",
    "label_parse": "SELECT s_suppkey, s_name AS vendor, s_nationkey::VARCHAR AS code, 'n' || s_nationkey::VARCHAR AS nation, true AS valid FROM supplier",
    "short_text_filter": r"""SELECT conv_id, turn, length(text)::BIGINT AS n FROM conversations WHERE trim(text, ' ') <> '' AND length(trim(text, ' ')) <= 120 AND regexp_matches(trim(text, ' '), '(?i)the|que|der|\.\s*$')""",
    "sender_carry_forward": f"""
        WITH {_TURNS}, p AS (SELECT *, sum(service::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS part FROM t)
        SELECT conv_id, turn, coalesce(last_value(CASE WHEN NOT service AND NOT joined THEN role END IGNORE NULLS) OVER (PARTITION BY conv_id, part ORDER BY turn), 'history') AS carried FROM p""",
    "reply_chain4": f"""
        WITH RECURSIVE {_TURNS}, r AS (
          SELECT c.conv_id, c.turn, p.turn AS up, p.media, 1 AS hops FROM t c JOIN t p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1
          UNION ALL SELECT r.conv_id, r.turn, p.turn, p.media, r.hops + 1 FROM r JOIN t p ON p.conv_id = r.conv_id AND p.turn = r.up - 1 WHERE r.media IS NULL AND r.hops < 4)
        SELECT conv_id, turn, up AS found_key, media::BIGINT AS found, hops FROM r WHERE media IS NOT NULL""",
    "lookback7": f"""
        WITH {_TURNS}, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM t),
        p AS (SELECT a.conv_id, a.turn, a.k, b.k AS bk, b.turn AS bt, CASE WHEN b.service THEN 'stop' WHEN b.role <> a.role AND NOT b.joined THEN 'stop' WHEN b.role <> a.role THEN 'pass' WHEN b.record THEN 'stop' WHEN b.media IS NOT NULL THEN 'hit' ELSE 'pass' END AS act
              FROM n a JOIN n b ON a.conv_id = b.conv_id AND b.k BETWEEN a.k - 7 AND a.k - 1),
        f AS (SELECT * FROM p WHERE act <> 'pass' QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY bk DESC) = 1)
        SELECT n.conv_id, n.turn, CASE WHEN f.act = 'hit' AND (n.turn - f.bt) * 100 BETWEEN 0 AND 600 THEN f.bt END AS linked FROM n LEFT JOIN f ON n.conv_id = f.conv_id AND n.turn = f.turn""",
    "latest_asof": """
        WITH a AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase'), f AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'view'),
        j AS (SELECT a.event_id AS ask_id, f.event_id AS fact_id, (epoch_us(a.ts) - epoch_us(f.ts))::DOUBLE / 1000000 AS age, row_number() OVER (PARTITION BY a.event_id ORDER BY f.ts DESC, f.event_id DESC) AS r FROM a JOIN f ON a.user_id = f.user_id AND f.ts <= a.ts)
        SELECT ask_id, fact_id, age FROM j WHERE r = 1 AND age <= 10800""",
    "interval_pair": """
        SELECT a.user_id, a.event_id AS open_id, z.event_id AS close_id, (epoch_us(z.ts) - epoch_us(a.ts))::DOUBLE / 1000000 AS gap FROM events a JOIN events z ON a.user_id = z.user_id
        WHERE a.event_type = 'view' AND z.event_type = 'purchase' AND epoch_us(z.ts) - epoch_us(a.ts) BETWEEN 0 AND 3600000000""",
    "ttl_expiry": """
        SELECT event_id, (epoch_us(m.now) - epoch_us(ts))::DOUBLE / 1000000 AS age, (epoch_us(m.now) - epoch_us(ts))::DOUBLE / 1000000 > 86400 AS gone FROM events, (SELECT max(ts) AS now FROM events) m WHERE event_type = 'view'""",
    "html_extract": r"""
        SELECT page_id, replace(replace(replace(replace(replace(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&') AS title, len(regexp_extract_all(html, '<a [^>]*href="[^"]+"'))::BIGINT AS n_links, true AS has_text FROM pages""",
    "entropy_quality": """
        WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents WHERE length(text) > 0), n AS (SELECT doc_id, ch, count(*)::DOUBLE AS k FROM c GROUP BY ALL),
        s AS (SELECT doc_id, sum(k) AS total FROM n GROUP BY 1), h AS (SELECT doc_id, -sum(k / total * log2(k / total)) AS bits FROM n JOIN s USING (doc_id) GROUP BY 1)
        SELECT d.doc_id, length(coalesce(d.text, ''))::BIGINT AS n_symbols, round(coalesce(bits, 0), 6) AS entropy, coalesce(bits, 0) < 2.5 AS low_info FROM documents d LEFT JOIN h USING (doc_id)""",
    "record_text": r"""
        SELECT o_orderkey, regexp_replace(upper(o_orderpriority), '[^A-Z0-9]', '', 'g') AS ident, 'images/' || substr(regexp_replace(o_orderpriority || o_orderkey::VARCHAR, '[^A-Za-z0-9_.\-]', '', 'g'), 1, 80) || '.jpg' AS object,
        CASE WHEN length(o_orderpriority) > 6 THEN substr(o_orderpriority, 1, 3) || '...' ELSE o_orderpriority END AS clip, '\_' || o_orderstatus || '\*' AS escaped, date_trunc('second', o_orderdate) AS parsed FROM orders""",
}
