"""Records around a check: cascade of candidates, review records, pending buffers, lookups and run counters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fusion import WEIGHTS

#: Fixed weights of the light rank and fixed limits of the deep and geometry steps.
LIGHT_WEIGHTS = {"p": 0.62, "d": 0.18, "roi": 0.20}
DEEP, GEOMETRY = 32, 12


def light_rank() -> Column:
    return sum((w * F.coalesce(F.col(c), F.lit(0.0)) for c, w in LIGHT_WEIGHTS.items()), F.lit(0.0))


def cascade(signals: DataFrame, query: str, candidate: str, deep: int = DEEP, last: int = GEOMETRY) -> DataFrame:
    """signals of the candidates that reach the geometry step, with light, base and place: the first by light rank or copy score, then the first of these by the best of base, light and copy."""
    base = sum((w * F.coalesce(F.col(c), F.lit(0.0)) for c, w in WEIGHTS.items()), F.lit(0.0))
    rows = signals.withColumns({"light": F.round(light_rank(), 6), "base": F.round(base, 6)})
    first = Window.partitionBy(query).orderBy(F.desc(F.greatest("light", "copy")), F.desc(candidate))
    kept = rows.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= deep).drop("_r")
    second = Window.partitionBy(query).orderBy(F.desc(F.greatest("base", "light", "copy")), F.desc(candidate))
    return kept.withColumn("place", F.row_number().over(second)).filter(F.col("place") <= last)


def review_records(verdicts: DataFrame) -> DataFrame:
    """(query_id, matched_id, match_type, score, status): a pending review for each verdict that asks for one."""
    return verdicts.filter("action = 'review'").select("query_id", F.col("cand_id").alias("matched_id"), "match_type", "score", F.lit("pending").alias("status"))


def buffered(rows: DataFrame, group: str, key: str, at: str, kind: str, single: Sequence[str]) -> DataFrame:
    """The buffer after all puts: of a kind in single the newest of each group, of other kinds the newest of each key."""
    slot = F.when(F.col(kind).isin(*single), F.lit("")).otherwise(F.col(key).cast("string"))
    newest = F.max_by(F.struct(F.col(key).alias("k"), F.col(at).alias("t")), F.struct(at, key))
    return rows.groupBy(group, kind, slot.alias("_slot")).agg(newest.alias("s")).select(group, kind, F.col("s.k").alias(key), F.col("s.t").alias(at))


def restored(buffer: DataFrame, key: str, age: Column, expire: float = 3600, purge: float = 7200) -> DataFrame:
    """(key, state, left): what a restart does with a buffered row by its age in seconds: purged, expired, or live for so many seconds, 1 at least."""
    state = F.when(age > purge, "purged").when(age > expire, "expired").otherwise("live")
    return buffer.select(key, state.alias("state"), F.when(state == "live", F.greatest(F.lit(1.0), F.lit(float(expire)) - age)).alias("left"))


def last_wins(rows: DataFrame, facts: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """rows with value of the last fact of their key, or null."""
    last = facts.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))
    return rows.join(last, key, "left")


def most_frequent(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, n): each group's most frequent value; on ties the longest, then the last in order."""
    counts = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    best = F.max(F.struct("n", F.length(value).alias("size"), F.col(value).alias("x")))
    return counts.groupBy(group).agg(best.alias("s")).select(group, F.col("s.x").alias(value), F.col("s.n").alias("n"))


def run_counters(rows: DataFrame, counters: Mapping[str, Column]) -> DataFrame:
    """One row with the number of rows for which each condition holds."""
    return rows.agg(*[F.count_if(c).alias(k) for k, c in counters.items()])


def stale(rows: DataFrame, path: str, prefix: str) -> DataFrame:
    """Rows whose path is absent, empty or not below the prefix."""
    return rows.filter(F.col(path).isNull() | (F.col(path) == "") | ~F.col(path).startswith(prefix))


def summary(fields: Mapping[str, Column]) -> Column:
    """`label: value` lines of the fields that are not empty."""
    lines = F.array(*[F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{k}: "), v)) for k, v in fields.items()])
    return F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n")


def alias_of(value: Column, words: Sequence[str], own: Column) -> Column:
    """own where value is one of the words for oneself."""
    return F.when(value.isin(*words), own).otherwise(value)
