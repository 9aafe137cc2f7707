"""Candidate generation and top-k: bands, exact cosine, sign-hash votes, and their union."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import signatures as S
from ..functions.vectors import dot

#: Fixed limits of the cascade.
LIGHT, TOP_K, LSH_CANDIDATES, EXACT_LIMIT = 120, 48, 2500, 15_000
_QUERY_BLOCK = 4096


def views(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, kind, ord, phash, dhash): each vector's views, repeated pairs of hashes left out after the first."""
    x = F.transform(vector, lambda v: v.cast("double"))
    every = []
    for k, (kind, width) in enumerate(S.VIEWS):
        p, d = S.view_hashes(F.col("_x"), width)
        every.append(F.struct(F.lit(kind).alias("kind"), F.lit(k).alias("ord"), p.alias("phash"), d.alias("dhash")))
    rows = vectors.select(F.col(key), x.alias("_x")).select(key, F.array(*every).alias("v"))
    fresh = F.filter("v", lambda a: ~F.exists(F.col("v"), lambda b: (b["ord"] < a["ord"]) & (b["phash"] == a["phash"]) & (b["dhash"] == a["dhash"])))
    return rows.select(key, F.explode(fresh).alias("s")).select(key, "s.kind", "s.ord", "s.phash", "s.dhash")


def band_index(signatures: DataFrame, key: str, signature: str = "phash") -> DataFrame:
    """(key, band, value) of all signatures of a key, once each."""
    return signatures.select(key, F.posexplode(S.bands(F.col(signature))).alias("band", "value")).distinct()


def ranked(rows: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group in a total order; Spark keeps k a group before it shuffles."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= k)


def band_search(asked: DataFrame, index: DataFrame, key: str, k: int = LIGHT) -> DataFrame:
    """(query_id, cand_id, hits, rank): keys of an index that share a band with a key of another, most bands first, then the largest key."""
    q = asked.select(F.col(key).alias("query_id"), "band", "value")
    hits = q.join(index.select(F.col(key).alias("cand_id"), "band", "value"), ["band", "value"]).filter("query_id <> cand_id").groupBy("query_id", "cand_id").agg(F.count(F.lit(1)).alias("hits"))
    return ranked(hits, "query_id", [F.desc("hits"), F.desc("cand_id")], k)


def band_candidates(index: DataFrame, queries: DataFrame, key: str, k: int = LIGHT) -> DataFrame:
    """band_search of the index's own keys that queries name."""
    return band_search(index.join(queries.select(key), key, "left_semi"), index, key, k)


def best_pairs(candidates: DataFrame, signatures: DataFrame, key: str) -> DataFrame:
    """(query_id, cand_id, p, d, light): the pair of views that maximises p + d / 4, the first on ties, and its light rank."""
    own = signatures.select(F.col(key).alias("query_id"), F.col("ord").alias("qo"), F.col("phash").alias("qp"), F.col("dhash").alias("qd"))
    other = signatures.select(F.col(key).alias("cand_id"), F.col("ord").alias("co"), F.col("phash").alias("cp"), F.col("dhash").alias("cd"))
    pairs = candidates.select("query_id", "cand_id").join(own, "query_id").join(other, "cand_id")
    p, d = S.similarity(F.col("qp"), F.col("cp")), S.similarity(F.col("qd"), F.col("cd"))
    scored = pairs.select("query_id", "cand_id", p.alias("p"), d.alias("d"), "qo", "co")
    best = scored.groupBy("query_id", "cand_id").agg(F.max_by(F.struct("p", "d"), F.struct((F.col("p") + 0.25 * F.col("d")).alias("a"), (-F.col("qo")).alias("b"), (-F.col("co")).alias("c"))).alias("s"))
    return best.select("query_id", "cand_id", "s.p", "s.d", (0.62 * F.col("s.p") + 0.18 * F.col("s.d")).alias("light"))


def cosine_topk(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int = TOP_K) -> DataFrame:
    """(query_id, cand_id, score, rank): exact cosine of each query against all vectors, rounded to 6 digits, ties by largest id.

    Queries go in blocks of fixed size: a block is broadcast, each task keeps its own k best by one matrix product a
    batch, and the tasks' lists meet by query. Zero vectors score 0.
    """
    spark = vectors.sparkSession
    numbered = queries.select(F.col(key).alias("id"), F.col(vector).alias("x"))
    blocks = max(1, -(-numbered.count() // _QUERY_BLOCK))
    out = None
    for n in range(blocks):
        rows = numbered.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == n).toPandas()
        ids = rows["id"].to_numpy(np.int64)
        matrix = np.stack(rows["x"].to_numpy()).astype(np.float64) if len(rows) else np.empty((0, 1))
        shared = spark.sparkContext.broadcast((ids, _unit(matrix)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, units = shared.value
            kept: list[np.ndarray] = []
            for b in batches:
                if not b.num_rows or not len(own):
                    continue
                other = b.column(0).to_numpy(zero_copy_only=False)
                scores = np.round(units @ _unit(np.stack(b.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)).T, 6)
                for q in range(len(own)):
                    s, o = scores[q], other
                    keep = o != own[q]
                    s, o = s[keep], o[keep]
                    top = np.lexsort((-o, -s))[:k]
                    kept.append(np.stack([np.full(len(top), own[q], np.float64), o[top].astype(np.float64), s[top]], axis=1))
                if sum(map(len, kept)) > 4 * k * len(own):  # a task's lists stay as small as the block's, whatever it reads
                    every = np.concatenate(kept)
                    every = every[np.lexsort((-every[:, 1], -every[:, 2], every[:, 0]))]
                    first = np.flatnonzero(np.r_[True, every[1:, 0] != every[:-1, 0]])
                    kept = [every[np.arange(len(every)) - np.repeat(first, np.diff(np.r_[first, len(every)])) < k]]
            if kept:
                every = np.concatenate(kept)
                yield pa.RecordBatch.from_arrays([pa.array(every[:, 0].astype(np.int64)), pa.array(every[:, 1].astype(np.int64)), pa.array(every[:, 2])], names=["query_id", "cand_id", "score"])

        part = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("x")).mapInArrow(run, "query_id long, cand_id long, score double")
        out = part if out is None else out.unionByName(part)
    return ranked(out, "query_id", [F.desc("score"), F.desc("cand_id")], k)


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms >= 1e-8)


def lsh_votes(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int = LSH_CANDIDATES, normals: np.ndarray | None = None) -> DataFrame:
    """(query_id, cand_id, hits, rank): bands of sign hashes that a query and a vector share."""
    hashed = vectors.select(key, S.simhash(F.col(vector), normals).alias("hash"))
    return band_candidates(band_index(hashed, key, "hash"), queries, key, k)


def scored(pairs: DataFrame, vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(query_id, cand_id, score): exact cosine of given pairs, rounded to 6 digits; zero vectors score 0."""
    x = lambda name, id_: vectors.select(F.col(key).alias(id_), F.col(vector).alias(name))
    rows = pairs.select("query_id", "cand_id").join(x("a", "query_id"), "query_id").join(x("b", "cand_id"), "cand_id")
    norms = F.sqrt(dot(F.col("a"), F.col("a"))) * F.sqrt(dot(F.col("b"), F.col("b")))
    return rows.select("query_id", "cand_id", F.round(F.when(norms < 1e-16, 0.0).otherwise(dot(F.col("a"), F.col("b")) / norms), 6).alias("score"))


def rescored(candidates: DataFrame, vectors: DataFrame, key: str, vector: str, k: int = TOP_K) -> DataFrame:
    """Exact cosine of given candidates, best k of each query."""
    return ranked(scored(candidates, vectors, key, vector), "query_id", [F.desc("score"), F.desc("cand_id")], k)


def exact_or_lsh(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int = TOP_K, exact_limit: int = EXACT_LIMIT) -> DataFrame:
    """The exact scan at every size: it goes by blocks of queries, so its memory does not follow the library.

    exact_limit is the library size from which sign hashes were once used instead; they find too few of the nearest, so
    it has no effect on the result. lsh_votes and rescored remain for those who ask for them.
    """
    return cosine_topk(vectors, queries, key, vector, k)


def union_max(*ranked_sets: DataFrame) -> DataFrame:
    """(query_id, cand_id, score): candidates of several generators, each with its best score."""
    every = reduce(DataFrame.unionByName, [r.select("query_id", "cand_id", "score") for r in ranked_sets])
    return every.groupBy("query_id", "cand_id").agg(F.max("score").alias("score"))


def mutual_matches(vectors: DataFrame, key: str, vector: str, label: str, ratio: float = 0.9) -> DataFrame:
    """(a_id, b_id, score) between even and odd keys of a label: each other's nearest, and clearly nearer than the second.

    The test is on distances of unit vectors, in both directions. The even keys of a label meet its odd keys only.
    """
    rows = vectors.select(F.col(key), F.col(label), F.col(vector).alias("x"), F.sqrt(dot(F.col(vector), F.col(vector))).alias("norm"))
    a = rows.filter(F.col(key) % 2 == 0).select(label, F.col(key).alias("a_id"), F.col("x").alias("ax"), F.col("norm").alias("an"))
    b = rows.filter(F.col(key) % 2 == 1).select(label, F.col(key).alias("b_id"), F.col("x").alias("bx"), F.col("norm").alias("bn"))
    pairs = a.join(b, label).select("a_id", "b_id", F.round(dot(F.col("ax"), F.col("bx")) / (F.col("an") * F.col("bn")), 6).alias("score"))
    far = F.sqrt(F.greatest(2 - 2 * F.col("score"), F.lit(0.0)))
    sides = []
    for own, other in (("a_id", "b_id"), ("b_id", "a_id")):
        w = Window.partitionBy(own).orderBy(F.desc("score"), F.col(other))
        sides.append(pairs.select("a_id", "b_id", "score", F.row_number().over(w).alias("r"), F.lead(far).over(w).alias("next"), far.alias("far")).filter("r = 1 AND (next IS NULL OR far < next * %s)" % ratio).select("a_id", "b_id", "score"))
    return sides[0].join(sides[1].select("a_id", "b_id"), ["a_id", "b_id"])
