"""Connected components of a distributed edge list by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


#: A key with over a HUB-th of the rows is a hub; so there are fewer than HUB of them, and their rows are broadcast. Up
#: to PLAIN rows of two longs even all of them may meet in a task.
HUB, PLAIN = 1000, 100_000


def joined_by_hub(rows: DataFrame, unique: DataFrame, key: str, counts: DataFrame | None = None, total: int | None = None) -> DataFrame:
    """rows and unique (one row a key, narrow) by key; keys that hold much of rows are joined by broadcast, so no task gets all of one."""
    total = rows.count() if total is None else total
    if total <= PLAIN:
        return rows.join(unique, key)
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts
    hubs = checkpointed(counts.filter(F.col("n") > max(HUB, total // HUB)).select(key))
    if hubs.isEmpty():
        return rows.join(unique, key)
    few = F.broadcast(hubs)
    spread = rows.join(F.broadcast(unique.join(few, key, "left_semi")), key)
    return rows.join(few, key, "left_anti").join(unique, key).unionByName(spread)


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """One step over (a, b). Minima come from a map-side combined aggregation; a hub's edges stay where they are in the join with them."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    joined = joined_by_hub(both, least.drop("n"), "a", least, total)
    if large:
        moved = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.filter(F.col("a") != F.col("b")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b: long); root is the smallest node of its component.

    Each round is checkpointed. It ends when a round changes no edge: then every edge points from a node to its root.
    """
    now, last = checkpointed(edges.filter(F.col("a") != F.col("b")).distinct()), None
    for _ in range(max_rounds):
        told = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if told == last:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root")))
        last, total = told, 2 * told["n"]
        now = checkpointed(_star(_star(now, True, total), False, total))
    raise RuntimeError("components did not settle")
