"""Review decisions and exclusions learned from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import signatures as S


def transitions(decisions: DataFrame, review: str, at: str, order: str, decision: str) -> DataFrame:
    """(review, status, at): the first decision of each review wins; later ones change nothing."""
    first = decisions.groupBy(review).agg(F.min_by(F.struct(F.col(decision).alias("d"), F.col(at).alias("t")), F.struct(at, order)).alias("s"))
    return first.select(review, F.when(F.col("s.d") == "confirm", "confirmed").otherwise("false_positive").alias("status"), F.col("s.t").alias(at))


def near_vectors(left: DataFrame, right: DataFrame, least: float, block: int = 4096) -> DataFrame:
    """(l, r): ids of rows of left (l, x) and right (r, y) whose vectors of one length have a cosine of at least so much.

    Right goes in blocks of a fixed number of vectors, each broadcast; a task compares a batch of left with one matrix
    product. Exact at every size. Null and zero vectors match nothing.
    """
    spark = left.sparkSession
    usable = right.filter("y IS NOT NULL")
    out = None
    for n in range(blocks := max(1, -(-usable.count() // block))):
        rows = usable.filter(F.pmod(F.xxhash64("r"), F.lit(blocks)) == n).toArrow()
        sides: dict[int, tuple[list, list]] = {}
        for r, y in zip(rows.column("r").to_pylist(), rows.column("y").to_pylist(), strict=True):
            ids, vectors = sides.setdefault(len(y), ([], []))
            ids.append(r)
            vectors.append(y)
        shared = spark.sparkContext.broadcast({k: (np.array(i), _units(v)) for k, (i, v) in sides.items()})

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                by: dict[int, tuple[list, list]] = {}
                for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if x is not None and len(x) in shared.value:
                        ids, vectors = by.setdefault(len(x), ([], []))
                        ids.append(i)
                        vectors.append(x)
                for size, (ids, vectors) in by.items():
                    other, units = shared.value[size]
                    for k in range(0, len(ids), 512):
                        a, z = np.nonzero(np.round(_units(vectors[k : k + 512]) @ units.T, 6) >= least)
                        yield pa.RecordBatch.from_arrays([pa.array([ids[k + j] for j in a.tolist()], pa.int64()), pa.array(other[z].astype(np.int64))], names=["l", "r"])

        part = left.select(F.col("l").cast("long"), "x").mapInArrow(run, "l long, r long")
        out = part if out is None else out.unionByName(part)
    return out


def _units(vectors: list) -> np.ndarray:
    m = np.array(vectors, np.float64)
    norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norms, out=np.zeros_like(m), where=norms >= 1e-8)


def excluded(candidates: DataFrame, exclusions: DataFrame, most_bits: int = 2, least_cosine: float = 0.96) -> DataFrame:
    """Candidates (query_id, query_digest, query_hash, cand_id, cluster_id and, if known, query_vector) that no exclusion covers.

    An exclusion (digest, hash, matched_id, cluster_id and, if known, vector) covers a query with its digest, or with a
    hash at most so many bits away, or with a vector of at least such a cosine; it takes out the matched item and its
    cluster. Null clusters exclude and are excluded by nothing. Hashes meet by bands: with 8 bands, a pair within 7 bits
    shares one, so the equality join loses none.
    """
    if most_bits > 7:
        raise ValueError("bands find all pairs up to 7 bits")
    queries = candidates.select("query_id", "query_digest", "query_hash").distinct()
    rules = exclusions.select("digest", "hash", F.col("matched_id").alias("m"), F.col("cluster_id").alias("c"))
    by_digest = queries.join(rules, queries["query_digest"] == rules["digest"]).select("query_id", "m", "c")
    left = queries.select("query_id", "query_hash", F.posexplode(S.bands(F.col("query_hash"))).alias("band", "value"))
    right = rules.select("hash", "m", "c", F.posexplode(S.bands(F.col("hash"))).alias("band", "value"))
    by_hash = left.join(right, ["band", "value"]).filter(S.hamming(F.col("query_hash"), F.col("hash")) <= most_bits).select("query_id", "m", "c")
    hits = by_digest.unionByName(by_hash)
    if "query_vector" in candidates.columns and "vector" in exclusions.columns:
        asked = candidates.select(F.col("query_id").alias("l"), F.col("query_vector").alias("x")).dropDuplicates(["l"])
        known = exclusions.select(F.xxhash64("matched_id", "cluster_id", "vector").alias("r"), F.col("vector").alias("y"), F.col("matched_id").alias("m"), F.col("cluster_id").alias("c")).dropDuplicates(["r"])
        hits = hits.unionByName(near_vectors(asked, known, least_cosine).join(known, "r").select(F.col("l").alias("query_id"), "m", "c"))
    hits = hits.distinct()
    items = hits.select("query_id", F.col("m").alias("cand_id")).distinct()
    clusters = hits.filter(F.col("c").isNotNull()).select("query_id", F.col("c").alias("cluster_id")).distinct()
    return candidates.join(items, ["query_id", "cand_id"], "left_anti").join(clusters, ["query_id", "cluster_id"], "left_anti").select(*candidates.columns)


def variants(verdicts: DataFrame, library: DataFrame, least: float = 90.0) -> DataFrame:
    """Rows to add to clusters: strong, safe verdicts whose match is trusted and has a cluster."""
    base = library.filter(F.coalesce(F.col("trusted"), F.lit(True)) & F.col("cluster_id").isNotNull()).select(F.col("id").alias("cand_id"), "cluster_id")
    return verdicts.filter((F.col("score") >= least) & F.col("strong") & F.col("learn_safe")).join(base, "cand_id").select("query_id", F.col("cand_id").alias("parent_id"), "cluster_id", "score")
