"""Clusters of records that are imported in order: each record joins the cluster of its best earlier match."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _checkpointed(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="spindrift-"))
    return df.checkpoint(eager=True)


def parents(matches: DataFrame, least: float = 90.0) -> DataFrame:
    """(id, parent): of strong, safe matches (new_id, old_id, score, strong, learn_safe) to smaller ids, the best; ties by the largest old id."""
    good = matches.filter((F.col("old_id") < F.col("new_id")) & (F.col("score") >= least) & F.col("strong") & F.col("learn_safe"))
    w = Window.partitionBy("new_id").orderBy(F.desc("score"), F.desc("old_id"))
    return good.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(F.col("new_id").alias("id"), F.col("old_id").alias("parent"))


def resolve(parent: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(id, root): ends of the chains of parents, by pointer doubling; a chain of n links takes log2(n) joins."""
    now = _checkpointed(parent.select("id", F.col("parent").alias("root")))
    for _ in range(max_rounds):
        up = now.select(F.col("id").alias("root"), F.col("root").alias("_up"))
        step = _checkpointed(now.join(up, "root", "left").select("id", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("_moved")))
        now = step.select("id", "root")
        if step.filter("_moved").isEmpty():
            return now
    raise RuntimeError("chains did not end: parents have a cycle")


def imported(records: DataFrame, matches: DataFrame, key: str, least: float = 90.0) -> DataFrame:
    """(key, cluster_id): every record with the first record of its cluster."""
    roots = resolve(parents(matches, least)).withColumnRenamed("id", key)
    return records.select(key).join(roots, key, "left").select(key, F.coalesce("root", key).alias("cluster_id"))
