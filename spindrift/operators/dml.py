"""Upserts and merges over immutable tables: each returns the new state."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How a merge treats a column: the new value, the new unless empty, or the new unless null.
OVERWRITE, KEEP_IF_EMPTY, COALESCE = "overwrite", "keep_if_empty", "coalesce"


def merge(old: DataFrame, new: DataFrame, key: str, rules: Mapping[str, str]) -> DataFrame:
    """old and new by key, each column by its rule; keys of one side alone are kept as they are."""
    left = old.select(F.col(key), *[F.col(c).alias(f"_o_{c}") for c in rules]).withColumn("_old", F.lit(True))
    right = new.select(F.col(key), *[F.col(c).alias(f"_n_{c}") for c in rules]).withColumn("_new", F.lit(True))
    both = left.join(right, key, "full")

    def value(column: str, rule: str):
        o, n = F.col(f"_o_{column}"), F.col(f"_n_{column}")
        taken = {OVERWRITE: n, KEEP_IF_EMPTY: F.when(F.coalesce(n.cast("string"), F.lit("")) != "", n).otherwise(o), COALESCE: F.coalesce(n, o)}[rule]
        return F.when(F.col("_new").isNull(), o).otherwise(taken).alias(column)

    return both.select(key, *[value(c, r) for c, r in rules.items()])


def upsert(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """New rows in place of old ones with their key."""
    return new.unionByName(old.join(new.select(*key).distinct(), list(key), "left_anti"))


def fan_out(rows: DataFrame, updates: DataFrame, key: str, source: str, *columns: str) -> DataFrame:
    """Updates reach the row with their key and every row whose source it is; OR as a union of two equality joins."""
    own = updates.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_u_{c}") for c in columns])
    hit = rows.join(own, rows[key] == own["_k"]).select(key, *[f"_u_{c}" for c in columns])
    linked = rows.join(own, rows[source] == own["_k"]).select(key, *[f"_u_{c}" for c in columns])
    every = hit.withColumn("_r", F.lit(0)).unionByName(linked.withColumn("_r", F.lit(1)))
    best = every.groupBy(key).agg(F.min_by(F.struct(*[f"_u_{c}" for c in columns]), "_r").alias("_u"))
    joined = rows.join(best, key, "left")
    return joined.select(*[F.when(F.col("_u").isNotNull(), F.col(f"_u._u_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])


def audited(old: DataFrame, new: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, field, old_value, new_value) of every allowed field that changes."""
    left = old.select(F.col(key), *[F.col(c).cast("string").alias(f"_o_{c}") for c in columns])
    right = new.select(F.col(key), *[F.col(c).cast("string").alias(f"_n_{c}") for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"_o_{c}").alias("old_value"), F.col(f"_n_{c}").alias("new_value")) for c in columns])
    every = left.join(right, key).select(key, F.explode(pairs).alias("x")).select(key, "x.*")
    return every.filter(~F.col("old_value").eqNullSafe(F.col("new_value")))
