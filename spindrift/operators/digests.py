"""Exact duplicates by content digest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def canonical(rows: DataFrame, key: str, content: str) -> DataFrame:
    """(key, canonical_id) of rows whose content occurs more than once; the smallest key is canonical.

    Only digests and keys are shuffled, and the smaller side holds repeated digests alone.
    """
    digests = rows.select(F.col(key), F.md5(F.col(content).cast("binary")).alias("digest")).filter("digest IS NOT NULL")
    groups = digests.groupBy("digest").agg(F.min(key).alias("canonical_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return digests.join(groups, "digest").select(key, "canonical_id")


def digest_any(queries: DataFrame, library: DataFrame, key: str, content: str, own_key: str) -> DataFrame:
    """(own_key, matched_id): the smallest library key with the same SHA-256 or the same MD5 as a query.

    Either digest is an equality join of its own; their union is aggregated, so OR needs no nested loop.
    """
    digest = lambda frame, id_, name: frame.select(F.col(id_).alias(name), F.sha2(F.col(content).cast("binary"), 256).alias("sha"), F.md5(F.col(content).cast("binary")).alias("md5"))
    q, lib = digest(queries, own_key, "_q"), digest(library, key, "_l")
    lib = lib.groupBy("sha", "md5").agg(F.min("_l").alias("_l"))
    found = q.join(lib.select("sha", "_l"), "sha").select("_q", "_l").unionByName(q.join(lib.select("md5", "_l"), "md5").select("_q", "_l"))
    return found.groupBy("_q").agg(F.min("_l").alias("matched_id")).withColumnRenamed("_q", own_key)


def insert_if_absent(existing: DataFrame, incoming: DataFrame, key: str, content: str, trusted: str | None = None) -> DataFrame:
    """Incoming rows whose content no trusted existing row has, the smallest key of each content."""
    known = existing if trusted is None else existing.filter(F.coalesce(F.col(trusted), F.lit(True)))
    digest = F.sha2(F.col(content).cast("binary"), 256)
    fresh = incoming.withColumn("_digest", digest).join(known.select(digest.alias("_digest")).distinct(), "_digest", "left_anti")
    first = fresh.groupBy("_digest").agg(F.min(key).alias(key))
    return fresh.join(first, ["_digest", key], "left_semi").dropDuplicates(["_digest"]).drop("_digest")
