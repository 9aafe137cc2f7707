"""The whole check of queries against a library: exact digests first, then candidates, signals, fusion and verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import candidates, fusion

#: Signals of vectors: what pixel, colour and keypoint families would add is absent, and counts as 0.
COLUMNS = ("query_id", "cand_id", "score", "verdict", "match_type", "action")


def _digest(signatures: DataFrame, key: str) -> DataFrame:
    """One digest of all views of a key."""
    every = F.array_sort(F.collect_list(F.concat_ws(":", F.col("ord").cast("string"), "phash", "dhash")))
    return signatures.groupBy(key).agg(F.md5(F.array_join(every, ",").cast("binary")).alias("digest"))


def check(queries: DataFrame, library: DataFrame, key: str, vector: str) -> DataFrame:
    """COLUMNS for each query: same (equal digest, the smallest id), similar (the best fused candidate), or new.

    Queries with an equal digest leave before the costly steps. Light candidates come from bands of all views and from
    exact cosine; fusion runs on their union.
    """
    own, other = candidates.views(queries, key, vector), candidates.views(library, key, vector)
    digests = _digest(own, key).withColumnRenamed(key, "query_id")
    same = digests.join(_digest(other, key), "digest").groupBy("query_id").agg(F.min(key).alias("cand_id"))
    exact = same.select("query_id", "cand_id", F.lit(100.0).alias("score"), F.lit("same").alias("verdict"), F.lit("digest").alias("match_type"), F.lit("confirm").alias("action"))
    rest = queries.join(same.select(F.col("query_id").alias(key)), key, "left_anti")
    light = candidates.band_search(candidates.band_index(own.join(rest.select(key), key, "left_semi"), key), candidates.band_index(other, key), key)
    near = candidates.cosine_topk(library, rest, key, vector)
    pairs = light.select("query_id", "cand_id").unionByName(near.select("query_id", "cand_id")).distinct()
    both = queries.select(key, vector).unionByName(library.select(key, vector))
    views = candidates.best_pairs(pairs, own.unionByName(other), key)
    copy = candidates.scored(pairs, both, key, vector).select("query_id", "cand_id", F.greatest(F.lit(0.0), 100 * F.col("score")).alias("copy"))
    signals = views.select("query_id", "cand_id", "p", "d").join(copy, ["query_id", "cand_id"])
    fused = fusion.fuse(signals.withColumn("geometry", F.lit(0.0))).withColumn("score", F.round("score", 6))
    judged = fusion.verdict(fusion.best(fused, "query_id", "cand_id")).select(*COLUMNS)
    return exact.unionByName(judged)
