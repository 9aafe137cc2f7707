"""Index coverage, backlog and orphans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stats(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """One row: total, indexed (distinct keys done), backlog and percent, 100 where there is nothing to do."""
    total = items.agg(F.count(F.lit(1)).alias("total"))
    indexed = done.agg(F.countDistinct(key).alias("indexed"))
    both = total.withColumn("_", F.lit(1)).join(indexed.withColumn("_", F.lit(1)), "_").drop("_")
    return both.select("total", "indexed", F.greatest(F.lit(0), F.col("total") - F.col("indexed")).alias("backlog"), F.when(F.col("total") == 0, 100.0).otherwise(F.round(100.0 * F.col("indexed") / F.col("total"), 6)).alias("percent"))


def backlog(items: DataFrame, done: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Items without a result; the first `limit` by key if a batch is asked for."""
    missing = items.join(done.select(key).distinct(), key, "left_anti")
    return missing if limit is None else missing.orderBy(key).limit(limit)


def orphans(files: DataFrame, key: str, *references: tuple[DataFrame, str]) -> DataFrame:
    """Files that none of the references names."""
    named = None
    for frame, column in references:
        own = frame.select(F.col(column).alias(key)).filter(F.col(key).isNotNull())
        named = own if named is None else named.unionByName(own)
    return files.join(named, key, "left_anti")
