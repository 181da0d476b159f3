"""What the operators of this package share: work folders, sizes, Arrow batches."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes of text that a Python kernel holds at once; a longer single text is a block of its own.
BLOCK_BYTES = 1 << 20
#: Bytes of an Arrow batch that goes to a Python worker; a longer single row is a batch of its own.
BATCH_BYTES = 8 << 20


def bounded(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches of at most BATCH_BYTES (Spark's own bound of 64 MB counts for each task)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def work_dir(spark: SparkSession) -> str:
    """A new folder name below the shared folder that the session names in spark.checkpoint.dir.

    Only where the session names none (a local session in tests) is a temporary folder used.
    """
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = tempfile.mkdtemp(prefix="colligate")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/colligate-{uuid.uuid4().hex}"


def written(df: DataFrame, spark: SparkSession) -> DataFrame:
    """The same rows from Parquet in the shared folder: cuts lineage and survives lost executors."""
    schema, path = df.schema, work_dir(spark)
    df.write.parquet(path, compression="zstd")
    return spark.read.schema(schema).parquet(path)


def freed(df: DataFrame) -> DataFrame:
    """df as it is; lets Spark delete the shuffle files of what was written before and is no longer referred to.

    Just after a job its last events still refer to it, hence a second time. Only disk use depends on it.
    """
    for pause in (0.5, 0):
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
        time.sleep(pause)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def planned_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a table's bytes (for files: what they take on disk)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions_for(df: DataFrame, target: int) -> int:
    """As many partitions as the session deals, more where one would pass target bytes on disk."""
    least, size = shuffle_partitions(df.sparkSession), planned_bytes(df)
    return least if size > 1 << 60 else max(least, -(-size // target))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column's texts, one after the other, and the n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_string() if pa.types.is_string(column.type) else pa.large_binary())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that each holds at most limit bytes of the column, or one row, and at most rows rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = texts(batch.column(column))[1]
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(ends, ends[first] + limit, "right")) - 1
            last = min(max(last, first + 1), first + rows, batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the splitmix64 finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes starts[i], starts[i] + 1, ... of all runs, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def sha_hex(of: F.Column | str) -> F.Column:
    return F.sha2(of, 256)
