"""Column helpers over series: all bars of one (symbol, tf), in order of t."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

SERIES = ["symbol", "tf"]
DAY_MS = 86_400_000
# fixed values: milliseconds of a bar by timeframe
STEP_MS = {"1m": 60_000, "3m": 180_000, "5m": 300_000, "15m": 900_000, "30m": 1_800_000, "1h": 3_600_000, "2h": 7_200_000, "4h": 14_400_000, "6h": 21_600_000, "8h": 28_800_000, "12h": 43_200_000, "1d": DAY_MS, "3d": 3 * DAY_MS, "1w": 7 * DAY_MS}


def in_order(*more: str) -> WindowSpec:
    """A series in time order. All operators share this window, so one shuffle and one sort serve them."""
    return Window.partitionBy(*SERIES, *more).orderBy("t")


def last_rows(n: int, *more: str) -> WindowSpec:
    return in_order(*more).rowsBetween(1 - n, 0)


def index() -> Column:
    """Position in the series, from 0."""
    return (F.row_number().over(in_order()) - 1).cast("long")


def full(n: int, value: Column) -> Column:
    """``value`` from the series' n-th bar on, null before."""
    return F.when(F.row_number().over(in_order()) >= n, value)


def step_ms(tf: Column) -> Column:
    """Milliseconds of a timeframe; null for an unknown one."""
    return F.create_map(*[F.lit(x) for pair in STEP_MS.items() for x in pair])[tf]


def clamp(x: Column, low: float, high: float) -> Column:
    """``x`` within bounds, null where it is null (which least and greatest alone pass over)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x)))


def rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """``columns`` rounded as ``F.round`` does. Doubles far from a half are rounded by whole numbers, as decimals cost many times as much."""
    double = {f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)}
    return compiled(df).withColumns({c: _rounded(F.col(c), digits) if c in double else F.round(F.col(c), digits) for c in columns})


def _rounded(x: Column, digits: int) -> Column:
    """Equal to ``F.round``: below 10^9 the product is off by less than a millionth, and a whole number by a power of ten is the nearest double."""
    y = F.abs(x) * float(10**digits)
    whole = F.floor(y + 0.5)
    sure = (y < 1e9) & (F.abs(y - F.floor(y) - 0.5) > 1e-6)
    return F.when(sure, F.when(x < 0, -whole).otherwise(whole) / F.lit(float(10**digits))).otherwise(F.round(x, digits))


def plus(schema: T.StructType, more: str) -> T.StructType:
    """A schema and further columns, given as DDL."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(more).fields])


def in_time(rows: pa.Table) -> pa.Table:
    """A series' rows in order of t; they mostly come so, as the windows before have sorted them."""
    t = rows["t"].to_numpy()
    return rows if (t[1:] >= t[:-1]).all() else rows.sort_by("t")


def numbers(rows: pa.Table, *columns: str) -> tuple[np.ndarray, ...]:
    """These columns as doubles, nan for null."""
    return tuple(rows[c].to_numpy().astype(float) for c in columns)


def with_columns(rows: pa.Table, columns: dict[str, pa.Array]) -> pa.Table:
    for name, x in columns.items():
        rows = rows.append_column(name, x)
    return rows


def compiled(df: DataFrame) -> DataFrame:
    """``df``, for plans with many columns of arithmetic over one row.

    Spark puts all columns of a stage into one method, and the JVM leaves methods beyond 8000 bytes to its interpreter. With
    this limit Spark gives such a stage's columns small methods instead. It is a setting of the session and holds when the plan runs.
    """
    df.sparkSession.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return df


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once for the many branches that read it: a checkpoint in the shared folder if the session has one, else a cache.

    Both keep the partitioning of the series.
    """
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once, as compressed columns in the shared folder if the session has one, else in a cache.

    Smaller on disk than ``settled``, but without the partitioning; Spark gives back what was shuffled before once the driver's JVM has collected its garbage.
    """
    spark = df.sparkSession
    top = spark.sparkContext.getCheckpointDir()
    if not top:
        return df.persist()
    path = f"{top}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)
