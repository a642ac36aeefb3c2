"""Small helpers that the corpus operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a vectorised helper handles at once.
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of few rows, so that very long texts don't add up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a temporary one only where that is unset (tests)."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        top = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/barquet-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: lost executors can't take it along.

    What was shuffled to make it isn't needed any more. Spark drops such files when the driver's JVM
    collects its garbage, so that is asked for; else they would add up over the steps of an operator.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    gc.collect()
    if jvm := getattr(spark.sparkContext, "_jvm", None):
        jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def held(remainder: int, modulus: int, of: str = "doc_id") -> Column:
    """Whether crc32(id as text) leaves ``remainder``; a null id counts as not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(of).cast("string")), F.lit(modulus)) == remainder, F.lit(False))


def partitions_for(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column as one array, and each row's bounds in it (nulls are empty)."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), bounds


def blocks(bounds: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows [first, last) of about ``size`` bytes; a longer row is a run of its own."""
    first = 0
    for row in range(1, len(bounds)):
        if row == len(bounds) - 1 or bounds[row + 1] - bounds[first] > size:
            yield first, row
            first = row


def whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """One task's rows together, for tasks whose number of rows is bounded; None without rows."""
    rows = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(rows) if rows else None
