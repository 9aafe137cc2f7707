from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindrift.functions import geometry, pixels
from spindrift.functions import signatures as S
from spindrift.functions import text as T
from spindrift.functions import vectors
from spindrift.operators import candidates, clusters, coverage, digests, dml, feedback, fusion, link


def test_hamming_and_bands(spark):
    rnd = random.Random(1)
    rows = []
    for _ in range(300):
        a = rnd.getrandbits(64)
        b = a
        for _ in range(rnd.randint(0, 9)):
            b ^= 1 << rnd.randrange(64)
        rows.append((f"{a:016x}", f"{b:016x}", (a ^ b).bit_count()))
    df = spark.createDataFrame(rows, "a string, b string, n int")
    shared = F.size(F.filter(F.zip_with(S.bands(F.col("a")), S.bands(F.col("b")), lambda x, y: x == y), lambda e: e)) > 0
    got = df.select("n", S.hamming(F.col("a"), F.col("b")).alias("h"), S.hamming(F.col("b"), F.col("a")).alias("r"), shared.alias("s")).collect()
    assert all(g.n == g.h == g.r for g in got)
    assert all(g.s for g in got if g.n <= 7)  # eight bands find every pair up to seven bits
    odd = spark.createDataFrame([(None, "00"), ("", "00"), ("zz", "00"), ("0", "1")], "a string, b string")
    assert [r.s for r in odd.select(S.similarity(F.col("a"), F.col("b")).alias("s")).collect()] == [0.0, 0.0, 0.0, 100 * (1 - 1 / 64)]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert [r.c for r in df.select(vectors.cosine_score(F.col("a"), F.col("b")).alias("c")).collect()] == [100.0, 0.0, 0.0, 0.0]
    q = vectors.quantised(np.array([[3.0, 4.0], [0.0, 0.0]], np.float32))
    assert np.allclose(q, [[0.6, 0.8], [0, 0]], atol=1e-3)


BASE = {"p": 50.0, "d": 50.0, "roi": 50.0, "hist": 50.0, "orb": 0.0, "ai": 0.0, "copy": 0.0, "geometry": 0.0, "inliers": 0, "ratio": 0.0, "coverage_q": 0.0, "coverage_c": 0.0, "ssim": 0.0, "overlap": 0.0, "sane": False, "low_info": False}
WIDE = {"sane": True, "coverage_q": 0.2, "coverage_c": 0.3}


@pytest.mark.parametrize(
    ("signals", "strong", "low", "high"),
    [
        ({"geometry": 96.0, "inliers": 24, "ratio": 0.6, "ssim": 62.0, "overlap": 0.1, **WIDE}, True, 96, 96),
        ({"geometry": 96.0, "inliers": 23, "ratio": 0.6, "ssim": 62.0, "overlap": 0.1, **WIDE}, False, 84.75, 84.75),
        ({"geometry": 90.0, "inliers": 16, "ratio": 0.5, "copy": 68.0, **WIDE}, True, 90, 90),
        ({"p": 98.0, "d": 95.0, "hist": 82.0, "orb": 72.0}, True, 93, 93),
        ({"copy": 84.0, "p": 84.0}, True, 91.24, 91.24),
        ({"copy": 94.0, "orb": 55.0}, True, 94.25, 94.25),
        ({"copy": 83.0, "geometry": 84.0, "inliers": 9, "ratio": 0.4, **WIDE}, False, 88, 89.75),
        ({"copy": 94.0, "p": 99.0, "d": 97.0, "hist": 98.0, "geometry": 70.0, "low_info": True}, True, 93, 97),
        ({"copy": 94.0, "p": 99.0, "d": 97.0, "hist": 97.9, "geometry": 70.0, "low_info": True}, False, 84.75, 84.75),
        ({}, False, 0, 84.75),
    ],
)
def test_fusion_golden(spark, signals, strong, low, high):
    row = fusion.fuse(spark.createDataFrame([BASE | signals])).first()
    assert row.strong is strong
    assert low - 1e-9 <= row.score <= high + 1e-9


def test_fusion_nulls_and_ties(spark):
    rows = spark.createDataFrame([(1, 5, None, 95.0), (1, 9, None, 95.0), (2, 3, None, None)], "q int, c int, p double, geometry double")
    fused = fusion.fuse(rows)
    assert {r.strong for r in fused.collect()} == {False}
    best = fusion.best(fused, "q", "c").collect()
    assert {(r.q, r.c) for r in best} == {(1, 9), (2, 3)}


def test_exclusions_and_transitions(spark):
    rows = spark.createDataFrame([(1, "x", "0" * 16, 10, 7), (1, "x", "0" * 16, 11, None), (2, "y", "f" * 16, 10, 7), (3, "z", "0" * 15 + "3", 10, 7), (3, "z", "0" * 15 + "3", 12, 8)], "query_id int, query_digest string, query_hash string, cand_id int, cluster_id int")
    rules = spark.createDataFrame([("y", None, 99, 7), (None, "0" * 16, 10, None)], "digest string, hash string, matched_id int, cluster_id int")
    got = {(r.query_id, r.cand_id) for r in feedback.excluded(rows, rules).collect()}
    assert got == {(1, 11), (3, 12)}
    t = spark.createDataFrame([(1, 5, 1, "reject"), (1, 4, 2, "confirm"), (2, 1, 3, "reject")], "r int, t int, e int, d string")
    assert {tuple(x) for x in feedback.transitions(t, "r", "t", "e", "d").collect()} == {(1, "confirmed", 4), (2, "false_positive", 1)}


def test_merge_fan_out_upsert(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, n string, v double")
    new = spark.createDataFrame([(2, "", None), (3, "c", 3.0)], "k int, n string, v double")
    got = {r.k: (r.n, r.v) for r in dml.merge(old, new, "k", {"n": dml.KEEP_IF_EMPTY, "v": dml.COALESCE}).collect()}
    assert got == {1: ("a", 1.0), 2: ("b", 2.0), 3: ("c", 3.0)}
    assert {(r.k, r.n) for r in dml.upsert(old, new, "k").collect()} == {(1, "a"), (2, ""), (3, "c")}
    rows = spark.createDataFrame([(1, None, "s"), (2, 1, "s"), (3, 9, "s")], "m int, src int, status string")
    got = {r.m: r.status for r in dml.fan_out(rows, spark.createDataFrame([(1, "new")], "m int, status string"), "m", "src", "status").collect()}
    assert got == {1: "new", 2: "new", 3: "s"}


def test_insert_if_absent_and_empty(spark):
    old = spark.createDataFrame([(1, "a", True), (2, "b", False)], "id int, body string, trusted boolean")
    new = spark.createDataFrame([(5, "a"), (6, "b"), (7, "c"), (8, "c")], "id int, body string")
    assert {r.id for r in digests.insert_if_absent(old, new, "id", "body", "trusted").collect()} == {6, 7}
    empty = new.limit(0)
    assert digests.canonical(empty, "id", "body").count() == 0
    row = coverage.stats(empty, empty, "id").first()
    assert (row.total, row.backlog, row.percent) == (0, 0, 100.0)


def test_labelled_fields(spark):
    text = ["Name: Ann Lee  AGE=30, city：Rome", "prename: x\nName : \nage:1\nage: 2;", None, "nothing", "city hall: 7 / city: X"]
    labels = {"name": ["name"], "age": ["age"], "city": ["city", "city hall"]}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "i int, t string").select("i", T.labelled_fields(F.col("t"), labels).alias("f"))
    got = [r.f for r in df.orderBy("i").collect()]
    assert got[0] == {"name": "Ann Lee", "age": "30", "city": "Rome"}
    assert got[1] == {"name": "", "age": "2"}
    assert got[2] == got[3] == {}
    assert got[4] == {"city": "X"}


def _chain(rows, depth):
    parent = {k: (p, v) for k, p, v in rows}
    out = {}
    for k, p, _ in rows:
        seen, step = set(), 0
        while p is not None and p not in seen and p in parent and step < depth:
            step += 1
            seen.add(p)
            if parent[p][1] is not None:
                out[k] = (p, step)
                break
            p = parent[p][0]
    return out


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 8)), st.booleans()), min_size=1, max_size=9))
def test_reply_chain(spark, drawn):
    rows = [(k, p, 1 if v else None) for k, (p, v) in enumerate(drawn)]
    df = spark.createDataFrame([(0, *r) for r in rows], "g int, k bigint, p bigint, v int")
    got = {r.k: (r.found_key, r.hops) for r in link.reply_chain(df, "g", "k", "p", "v").collect()}
    assert got == _chain(rows, 4)


def _events(seed: int, n: int = 200):
    rnd = random.Random(seed)
    t0 = datetime(2024, 1, 1)
    return [(k, t0 + timedelta(seconds=rnd.randint(0, 40_000)), rnd.randint(1, 5), rnd.choice(["view", "purchase", "click"])) for k in range(n)]


def _paired(events, seconds=3600):
    out, waiting = set(), {}
    for k, t, u, kind in sorted(events, key=lambda e: (e[1], e[0])):
        w = waiting.setdefault(u, [])
        while w and (t - w[0][1]).total_seconds() > seconds:
            w.pop(0)
        if kind == "view":
            w.append((k, t))
        elif kind == "purchase" and w:
            out.add((u, w.pop()[0], k))
    return out


def test_consume_once_and_intervals(spark):
    events = _events(2)
    df = spark.createDataFrame(events, "event_id bigint, ts timestamp, user_id bigint, event_type string")
    got = {(r.user_id, r.open_id, r.close_id) for r in link.consume_once(df, "user_id", "event_id", "ts", "event_type", "view", "purchase").collect()}
    assert got == _paired(events)
    views, buys = (df.filter(F.col("event_type") == k).select("user_id", F.col("event_id").alias(n), "ts") for k, n in (("view", "a"), ("purchase", "b")))
    got = {(r.a, r.b) for r in link.interval_pairs(views, buys, "user_id", "a", "b", "ts").collect()}
    assert got == {(a[0], b[0]) for a in events for b in events if a[3] == "view" and b[3] == "purchase" and a[2] == b[2] and 0 <= (b[1] - a[1]).total_seconds() <= 3600}


def test_cosine_blocks_and_exact_lsh(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.standard_normal((60, 64)))]
    df = spark.createDataFrame(rows, "id bigint, v array<float>")
    asked = df.filter("id % 20 = 0")
    exact = {(r.query_id, r.cand_id): r.score for r in candidates.cosine_topk(df, asked, "id", "v", 5).collect()}
    assert len(exact) == 15
    lsh = {(r.query_id, r.cand_id): r.score for r in candidates.exact_or_lsh(df, asked, "id", "v", 60, exact_limit=10).collect()}
    every = {(r.query_id, r.cand_id): r.score for r in candidates.cosine_topk(df, asked, "id", "v", 60).collect()}
    assert lsh.items() <= every.items()


def test_exact_or_lsh_recall(spark):
    """Beyond the limit the nearest are found as well: recall against brute force is 1."""
    rng = np.random.default_rng(2)
    v = rng.standard_normal((600, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id bigint, v array<float>").repartition(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        got = candidates.exact_or_lsh(df, df.filter("id % 100 = 0"), "id", "v", 20, exact_limit=10).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    unit = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    for q in range(0, 600, 100):
        score = np.round(unit @ unit[q], 6)
        best = [i for i in sorted(range(600), key=lambda i: (-score[i], -i)) if i != q][:20]
        assert [r.cand_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == best


def test_pixels(spark):
    rng = np.random.default_rng(3)
    noisy, flat = rng.integers(0, 256, (64, 80), dtype=np.uint8), np.full((64, 80), 120, np.uint8)
    assert pixels.information(flat)["low_info"] and not pixels.information(noisy)["low_info"]
    assert pixels.perceptual_hash(noisy) == pixels.perceptual_hash(noisy.copy())
    assert len(pixels.views(noisy)) >= 5 and len(pixels.views(flat)) <= 3
    assert pixels.structural_similarity(noisy, noisy) == pytest.approx(100)
    assert pixels.homography_sane(np.eye(3), 64, 80) and not pixels.homography_sane(np.zeros((3, 3)), 64, 80)
    smooth = np.add.outer(np.arange(64), np.arange(80)).astype(np.uint8)
    assert S is not None and pixels.difference_hash(smooth) == "f" * 16
    assert np.linalg.norm(pixels.colour_histogram(np.stack([noisy] * 3, -1))) == pytest.approx(1)
    df = spark.createDataFrame([(64, 80, noisy.tobytes()), (1, 1, b"xx"), (None, 1, None)], "h int, w int, d binary")
    got = [r.v for r in df.select(pixels.image_views(F.col("h"), F.col("w"), F.col("d")).alias("v")).collect()]
    assert [v.phash for v in got[0]] == [p for _, p, _ in pixels.views(noisy)] and got[1] is None and got[2] is None


def _frames(seed: int, n: int = 60):
    rng = np.random.default_rng(seed)
    points = rng.uniform(20, 280, (n, 2))
    desc = rng.standard_normal((n, 32)).astype(np.float64)
    shift = np.array([[1.1, 0.05, 8], [-0.04, 0.95, 5], [1e-4, 0, 1]])
    z = np.c_[points, np.ones(n)] @ shift.T
    return points, desc, z[:, :2] / z[:, 2:], desc + rng.standard_normal(desc.shape) * 0.02


def test_geometry(spark):
    p, dp, q, dq = _frames(4)
    m = geometry.verify(p, dp, (300, 300), q, dq, (300, 330))
    assert m.sane and m.inliers == 60 and m.score >= 97
    other = np.random.default_rng(9)
    wrong = geometry.verify(p, dp, (300, 300), other.uniform(0, 300, (60, 2)), other.standard_normal((60, 32)), (300, 300))
    assert wrong.score < 75 and wrong.inliers < 7
    assert geometry.verify(p[:5], dp[:5], (300, 300), q, dq, (300, 300)).score == 0
    assert geometry.score(18, 0.52, 30, 0.025, 0.10, True) > 90 > geometry.score(17, 0.52, 30, 0.025, 0.10, True)
    bits = other.integers(0, 256, (40, 32), dtype=np.uint8)
    assert geometry.binary_score(bits, bits) == 100 and geometry.binary_score(bits, bits[:4]) == 0
    mirrored = p * [-1, 1] + [300, 0]
    lists = lambda x: [[float(v) for v in row] for row in x]
    rows = [(1, 2, lists(mirrored), lists(dp), lists(q), lists(dq), 300, 300, 300, 330), (1, 3, None, None, lists(q), lists(dq), 300, 300, 300, 330)]
    df = spark.createDataFrame(rows, "query_id long, cand_id long, points_q array<array<float>>, desc_q array<array<float>>, points_c array<array<float>>, desc_c array<array<float>>, height_q int, width_q int, height_c int, width_c int")
    got = {r.cand_id: r for r in geometry.verified(df).collect()}
    assert got[2].geometry >= 97 and got[3].geometry == 0


def test_clusters(spark):
    rows = spark.createDataFrame([(i,) for i in range(1, 9)], "id long")
    found = [(2, 1, 95.0, True, True), (3, 2, 95.0, True, True), (3, 1, 91.0, True, True), (5, 4, 99.0, True, False), (6, 5, 89.0, True, True), (7, 8, 99.0, True, True), (8, 3, 92.0, True, True)]
    m = spark.createDataFrame(found, "new_id long, old_id long, score double, strong boolean, learn_safe boolean")
    assert {r.id: r.cluster_id for r in clusters.imported(rows, m, "id").collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 1}
    with pytest.raises(RuntimeError):
        clusters.resolve(spark.createDataFrame([(1, 2), (2, 1)], "id long, parent long"), 5)
