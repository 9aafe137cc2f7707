"""Linkage of ordered records: carry-forward, reply chains, bounded look-back, latest-as-of and interval pairing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(column) -> Column:
    """Microseconds since 1970 of a timestamp column, with or without a time zone."""
    return F.unix_micros((F.col(column) if isinstance(column, str) else column).cast("timestamp"))


def carry_forward(rows: DataFrame, group: str, order: str, value: str, reset: str, default: str) -> DataFrame:
    """rows with `carried`: the last non-null value since the last reset row of the group, else the default."""
    running = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    part = rows.withColumn("_part", F.sum(F.col(reset).cast("int")).over(running))
    within = Window.partitionBy(group, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(~F.col(reset), F.col(value))
    return part.withColumn("carried", F.coalesce(F.last(own, ignorenulls=True).over(within), F.lit(default))).drop("_part")


def reply_chain(rows: DataFrame, group: str, key: str, parent: str, payload: str, depth: int = 4) -> DataFrame:
    """(group, key, found_key, found, hops): the first payload up the chain of parents, at most depth steps, cycles cut.

    Each step is an equality join on (group, key); rows that have found theirs leave before the next.
    """
    base = rows.select(group, F.col(key).alias("_k"), F.col(parent).alias("_p"), F.col(payload).alias("_v"))
    open_ = rows.select(group, F.col(key), F.col(parent).alias("_next"), F.array().cast("array<bigint>").alias("_seen"))
    done = None
    for step in range(1, depth + 1):
        live = open_.filter(F.col("_next").isNotNull() & ~F.array_contains("_seen", F.col("_next").cast("bigint")))
        joined = live.join(base.withColumnRenamed("_k", "_next"), [group, "_next"])
        hit = joined.filter(F.col("_v").isNotNull()).select(group, key, F.col("_next").alias("found_key"), F.col("_v").alias("found"), F.lit(step).alias("hops"))
        done = hit if done is None else done.unionByName(hit)
        open_ = joined.filter(F.col("_v").isNull()).select(group, key, F.col("_p").alias("_next"), F.concat("_seen", F.array(F.col("_next").cast("bigint"))).alias("_seen"))
    return done


def look_back(rows: DataFrame, group: str, order: str, sender: str, joined: str, service: str, record: str, payload: str, at: str, reach: int = 7, seconds: int = 600) -> DataFrame:
    """rows with `linked`: the order value of the nearest earlier payload, or null.

    Of up to `reach` rows before, from the nearest: a service row, a foreign sender's row that is not joined, or another
    record of the same sender ends the search; a foreign joined row is passed over. The first payload counts if it is
    0 to `seconds` earlier, and ends the search either way. `at` is a number of seconds; null finds nothing.
    """
    before = Window.partitionBy(group).orderBy(order).rowsBetween(-reach, -1)
    row = F.struct(F.col(order).alias("o"), F.col(sender).alias("s"), F.col(joined).alias("j"), F.col(service).alias("v"), F.col(record).alias("r"), F.col(payload).isNotNull().alias("p"), F.col(at).cast("double").alias("t"))
    listed = rows.withColumn("_b", F.reverse(F.collect_list(row).over(before))).withColumn("_own", F.col(sender)).withColumn("_t", F.col(at).cast("double"))
    start = F.struct(F.lit(False).alias("end"), F.lit(None).cast("bigint").alias("hit"))

    def step(s, x):
        foreign = ~x["s"].eqNullSafe(F.col("_own"))
        stop = x["v"] | (foreign & ~x["j"]) | (~foreign & x["r"])
        age = F.col("_t") - x["t"]
        found = F.when(x["p"] & age.between(0, seconds), x["o"].cast("bigint"))
        next_ = F.when(stop, F.struct(F.lit(True).alias("end"), F.lit(None).cast("bigint").alias("hit"))).when(foreign, s).when(x["p"], F.struct(F.lit(True).alias("end"), found.alias("hit"))).otherwise(s)
        return F.when(s["end"], s).otherwise(next_)

    return listed.withColumn("linked", F.aggregate("_b", start, step)["hit"]).drop("_b", "_own", "_t")


def latest_as_of(asks: DataFrame, facts: DataFrame, group: str, ask: str, ask_at: str, fact: str, fact_at: str, seconds: int = 900) -> DataFrame:
    """(ask, fact, age): the newest fact of the group not after the ask, kept only if it is young enough.

    One window over both kinds of rows instead of a range join; the age test comes after the newest is chosen.
    """
    a = asks.select(F.col(group), F.col(ask_at).alias("_at"), F.lit(1).alias("_kind"), F.col(ask).alias("_ask"), F.lit(None).cast("bigint").alias("_fact"))
    f = facts.select(F.col(group), F.col(fact_at).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast("bigint").alias("_ask"), F.col(fact).alias("_fact"))
    w = Window.partitionBy(group).orderBy("_at", "_kind", "_fact").rowsBetween(Window.unboundedPreceding, 0)
    newest = F.last(F.when(F.col("_kind") == 0, F.struct("_fact", "_at")), ignorenulls=True).over(w)
    rows = a.unionByName(f).withColumn("_n", newest).filter("_kind = 1 AND _n IS NOT NULL")
    age = micros("_at") - micros("_n._at")
    return rows.select(F.col("_ask").alias(ask), F.col("_n._fact").alias(fact), (age / 1e6).alias("age")).filter(F.col("age") <= seconds)


def interval_pairs(left: DataFrame, right: DataFrame, group: str, left_id: str, right_id: str, at: str, seconds: int = 3600) -> DataFrame:
    """(left_id, right_id, gap): every right within so many seconds after a left of the same group.

    The time axis is cut in buckets of that length, so a left meets only its own and the next bucket: an equality join
    that spreads a busy group over its buckets.
    """
    bucket = F.floor(micros(at) / F.lit(seconds * 1_000_000))
    a = left.select(F.col(group), F.col(left_id), micros(at).alias("_a"), F.explode(F.array(bucket, bucket + 1)).alias("_b"))
    b = right.select(F.col(group), F.col(right_id), micros(at).alias("_z"), bucket.alias("_b"))
    gap = F.col("_z") - F.col("_a")
    return a.join(b, [group, "_b"]).filter(gap.between(0, seconds * 1_000_000)).select(group, left_id, right_id, (gap / 1e6).alias("gap"))


def consume_once(rows: DataFrame, group: str, key: str, at: str, kind: str, opens: str, closes: str, seconds: int = 3600) -> DataFrame:
    """(group, open_id, close_id, gap): each closing row takes the latest open one that is young enough and not yet taken.

    A fold over each group's rows in (at, key) order; state is the list of open rows within the interval. Groups stream
    through a task in sorted order, so a busy group needs memory for its open rows alone.
    """
    # open_id and close_id keep the key's type
    schema = f"{group} {dict(rows.dtypes)[group]}, open_id long, close_id long, gap double"
    lean = rows.filter(F.col(kind).isin(opens, closes)).select(group, key, micros(at).alias("_t"), kind)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, waiting = None, []
        for frame in frames:
            out = []
            for g, k, t, what in frame.itertuples(index=False, name=None):
                if g != now:
                    now, waiting = g, []
                while waiting and t - waiting[0][1] > seconds * 1_000_000:
                    waiting.pop(0)
                if what == opens:
                    waiting.append((k, t))
                elif waiting:
                    o, s = waiting.pop()
                    out.append((g, o, k, (t - s) / 1e6))
            yield pd.DataFrame(out, columns=[group, "open_id", "close_id", "gap"])

    return lean.repartition(group).sortWithinPartitions(group, "_t", key).mapInPandas(run, schema)


def expired(rows: DataFrame, key: str, at: str, now, seconds: int = 3600) -> DataFrame:
    """(key, age, gone): age at a given time and whether the row's time is up."""
    age = (micros(now) - micros(at)) / 1e6
    return rows.select(key, age.alias("age"), (age > seconds).alias("gone"))
