"""Sharding by extendible hashing.

A document's hash has 60 bits. The directory is indexed by prefixes of it: a shard is the shortest prefix whose
documents fit the byte limit, while every shorter one is oversized. So only oversized buckets split, each on one more
bit, until all fit.

The directory comes from bytes by cell, a prefix long enough for about 16 cells a shard; splitting below a cell goes
on in the same way, and only for cells that are still oversized.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, shared_dir, table, texts

LIMIT = 32 << 20
BITS = 60
#: A directory of at most so many cells, each under 200 bytes, is broadcast; a larger one is joined by a shuffle.
BROADCAST_CELLS = 50_000


def hash_bits(key: Column) -> Column:
    """60 bits of a key's MD5 as a string of 0 and 1; null counts as the empty string."""
    return F.lpad(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 2), BITS, "0")


def _directory(sized: DataFrame, limit: int, low: int, high: int) -> DataFrame:
    """(cell, shard, shard_bytes, shard_docs, fits): for each prefix of length high, the shard at a length of low to high."""
    cells = sized.groupBy(F.substring("bits", 1, high).alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("docs"))
    cells = checkpointed(cells)
    every = cells.select("cell", "bytes", "docs", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")).withColumn("prefix", F.expr("substring(cell, 1, depth)"))
    buckets = every.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"))
    usable = buckets.filter((F.col("shard_bytes") <= limit) | (F.col("depth") == high))
    best = every.join(usable, ["depth", "prefix"]).groupBy("cell").agg(F.min(F.struct("depth", "prefix", "shard_bytes", "shard_docs")).alias("s"))
    return best.select("cell", F.col("s.prefix").alias("shard"), "s.shard_bytes", "s.shard_docs", (F.col("s.shard_bytes") <= limit).alias("fits"))


def assign(docs: DataFrame, limit: int = LIMIT, key: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, n_bytes, shard (s and the prefix), depth, shard_bytes, shard_docs, fits for each row of docs.

    n_bytes is the text's length in UTF-8, 0 for null. The hash is of the id, so rows that repeat an id stay together.
    fits is false only where no bit is left: a document beyond the limit, or repeats of one id. Other columns are not
    read; an empty table gives no rows. carry: the text comes along as a last column.
    """
    sized = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), hash_bits(F.col(key)).alias("bits"), *([F.col(text).alias("text")] if carry else []))
    total = sized.agg(F.sum("n_bytes")).first()[0] or 0
    low, high = 0, min(BITS, max(4, math.ceil(math.log2(max(1.0, total / limit))) + 4))
    done, rest = None, sized
    while True:
        directory = checkpointed(_directory(rest.select("bits", "n_bytes"), limit, low, high))
        open_ = directory.filter(~F.col("fits") & (F.col("shard_docs") > 1)) if high < BITS else directory.limit(0)
        last = high >= BITS or open_.isEmpty()
        closed = directory if last else directory.join(open_.select("cell"), "cell", "left_anti")
        rows = rest.withColumn("cell", F.substring("bits", 1, high))
        small = directory.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS
        joined = rows.join(F.broadcast(closed) if small else closed, "cell")
        placed = joined.select("doc_id", "n_bytes", F.concat(F.lit("s"), "shard").alias("shard"), F.length("shard").alias("depth"), "shard_bytes", "shard_docs", "fits", *(["text"] if carry else []))
        done = placed if done is None else done.unionByName(placed)
        if last:
            return done
        rest = rows.join(open_.select("cell"), "cell", "left_semi").drop("cell")
        low, high = high, min(BITS, high + 8)


def write(docs: DataFrame, folder: str, limit: int = LIMIT) -> DataFrame:
    """Writes docs (doc_id, text) to one folder a shard below folder and returns all rows of assign() as read back.

    The text is shuffled once, by shard; a shard is at most the limit, so no task holds more than a few limits.
    """
    rows = assign(docs, limit, carry=True)
    rows.repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(f"{folder}/shards")
    return docs.sparkSession.read.schema(rows.schema).parquet(f"{folder}/shards")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write(texts(table(spark, sf_dir, "documents"), "doc_id", "text"), shared_dir(spark)).drop("text")
