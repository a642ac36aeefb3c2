"""Bars out of the given tables, and bar tables on disk."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.series import SERIES
from ..operators.cleaning import upsert

BAR_SCHEMA = "symbol string, tf string, t long, o double, h double, l double, c double, v double, closed boolean"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars_of(ticks: DataFrame, keys: tuple[str, ...] = (*SERIES, "t")) -> DataFrame:
    """Bars of ticks (``keys``, price, size, at): open and close by the order of ``at`` within the bar.

    Of ticks with one ``at`` the first by ``place``, a whole number, opens and closes, if there is such a column.
    """
    first, last = (F.struct("at", "place"), F.struct("at", F.bitwise_not("place"))) if "place" in ticks.columns else ("at", "at")
    return ticks.groupBy(*keys).agg(F.min_by("price", first).alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", last).alias("c"), F.sum("size").alias("v"))


def lineitem_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of unit prices by supplier. Of two lines with one order and number the first of the file counts.

    Lines are shuffled by series, and bars are made where their series is: nearly every line is a bar of its own, so making
    them before would save nothing, and the windows over a series need no shuffle of bars.
    """
    li = table(spark, sf_dir, "lineitem")
    ticks = li.select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"),
        F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("t"),
        (F.col("l_extendedprice").cast("double") / F.col("l_quantity").cast("double")).alias("price"),
        F.col("l_quantity").cast("double").alias("size"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("at"),
        F.col("_metadata.row_index").alias("place"),
    )
    return bars_of(ticks.repartition("symbol"), ("symbol", "t")).select("symbol", F.lit("1d").alias("tf"), "t", "o", "h", "l", "c", "v")


def event_bars(spark: SparkSession, sf_dir: str, tf: str = "1h", step: int = 3_600_000) -> DataFrame:
    """Bars of event values by event type."""
    ev = table(spark, sf_dir, "events").filter(F.col("value").isNotNull())
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return bars_of(ev.select(F.col("event_type").alias("symbol"), F.lit(tf).alias("tf"), (ms - F.pmod(ms, F.lit(step))).alias("t"), F.col("value").cast("double").alias("price"), F.lit(1.0).alias("size"), F.struct(ms.alias("ms"), "event_id").alias("at")))


#: Rows of a file at most, and shards up to which their list goes to all tasks.
FILE_ROWS, SHARDS = 1_000_000, 100_000
SHARD = [*SERIES, "day"]


def _by_day(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.date_format(F.timestamp_millis("t"), "yyyy-MM-dd"))


def write_bars(df: DataFrame, path: str, mode: str = "append", file_rows: int = FILE_ROWS) -> None:
    """One folder for each (symbol, tf, day), so that a read of a range opens only its days.

    Rows are dealt by series and day, so a task holds some days of some series and no series whole; a file has at most
    ``file_rows`` rows.
    """
    _by_day(df).repartition(*SHARD).sortWithinPartitions(*SHARD, "t").write.mode(mode).option("maxRecordsPerFile", file_rows).partitionBy(*SHARD).parquet(path)


def upsert_bars(new: DataFrame, path: str, order: str | None = None, file_rows: int = FILE_ROWS) -> None:
    """Put ``new`` bars into the stored ones: of two with one (symbol, tf, t) the later by ``order`` stays, the new one without an order.

    Only days that ``new`` has rows of are read and written again (dynamic partition overwrite). What they will hold is first written
    to a folder beside the shards that readers pass over, so that an executor lost half way takes no stored bar along.
    """
    spark = new.sparkSession
    new = _by_day(new)
    touched = new.select(*SHARD).distinct()
    few = touched.limit(SHARDS + 1).count() <= SHARDS
    stored = spark.read.option("mergeSchema", "true").schema(new.schema).parquet(path)
    old = stored.join(F.broadcast(touched) if few else touched, SHARD, "left_semi").select(new.columns)
    staged = f"{path.rstrip('/')}/_staged-{uuid.uuid4().hex}"
    upsert(old, new, [*SERIES, "t"], order).select(new.columns).write.parquet(staged)
    rows = spark.read.schema(new.schema).parquet(staged)
    out = rows.repartition(*SHARD).sortWithinPartitions(*SHARD, "t").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", file_rows)
    out.partitionBy(*SHARD).parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(staged)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def read_bars(spark: SparkSession, path: str, symbol: str | None = None, tf: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Bars of [start, end] in ms; folders of other series and days aren't opened."""
    df = spark.read.schema(BAR_SCHEMA.replace(", closed boolean", "") + ", closed boolean, day string").parquet(path)
    for column, value in (("symbol", symbol), ("tf", tf)):
        if value is not None:
            df = df.filter(F.col(column) == value)
    if start is not None:
        df = df.filter((F.col("day") >= F.date_format(F.timestamp_millis(F.lit(start)), "yyyy-MM-dd")) & (F.col("t") >= start))
    if end is not None:
        df = df.filter((F.col("day") <= F.date_format(F.timestamp_millis(F.lit(end)), "yyyy-MM-dd")) & (F.col("t") <= end))
    return df.drop("day")
