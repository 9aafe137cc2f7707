"""Shared helpers of the training-data operators.

Every operator of this subpackage reads DataFrames only; nothing opens an input path with plain file calls.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share.

    A local folder is made only where the session names none, as in tests on one machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="spindrift-")
    return f"{base.rstrip('/')}/spindrift-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Lets DataFrame.checkpoint() work; keeps whatever the session has."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="spindrift-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Writes df as Parquet in a shared folder and reads it back: columnar, compressed, and safe from lost executors."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of intermediate tables that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def texts(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that extra columns of any name do no harm and the scan is pruned."""
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def cells(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column's cells."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type):
        column = column.view(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.view(pa.large_binary())
    return column.to_pylist()


def pieces(batches: Iterator[pa.RecordBatch], max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that none holds much more than max_bytes, or one row, and gives memory back behind each batch.

    What a worker makes of a text is several times the text, and workers keep what they once had.
    """
    for batch in batches:
        rows = max(1, int(batch.num_rows * max_bytes / max(batch.nbytes, 1)))
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
        del batch
        pa.default_memory_pool().release_unused()


def signed(values) -> np.ndarray:
    """Unsigned 64-bit hashes as Spark's long."""
    return np.asarray(values, dtype=np.uint64).view(np.int64)
