"""Exact order statistics and distribution steps of groups of any size.

A sketch cuts each group's values into up to a thousand buckets of about equal counts. Counts of buckets, summed
before they are shuffled, tell where a rank lies, and only values of the buckets asked for are sorted, each bucket
by itself and equal values as one row. No task holds a group, be there three of them or millions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .series import settled

#: Buckets of a group; at most 1024. A task sorts about that share of its largest group's different values.
BUCKETS = 1000
#: Groups up to which the bounds of all buckets are sent to every task.
GROUPS = 4000


def _bounds(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, _bounds): rising bounds of the buckets of each group, one fixed set for all that use it."""
    sketch = F.percentile_approx(value, [k / BUCKETS for k in range(1, BUCKETS)], 10 * BUCKETS)
    found = df.groupBy(*keys).agg(F.array_sort(F.array_distinct(sketch)).alias("_bounds"))
    rows = found.limit(GROUPS + 1).collect()
    if len(rows) > GROUPS:
        return settled(found)
    return F.broadcast(df.sparkSession.createDataFrame(rows, found.schema))


def _bucket(x: Column) -> Column:
    """How many bounds are less than ``x``, by halving."""
    steps = F.array(*[F.lit(1 << k) for k in range(9, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get("_bounds", at + step - 1) < x, step).otherwise(0))


def _join(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """``a`` with the columns of ``b``, keys that are null being equal."""
    b = b.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return a.join(b, on).drop(*[f"_k_{k}" for k in keys])


def in_buckets(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``df`` with _bucket, the number of each value's bucket in its group; greater values have no lesser buckets."""
    return _join(df, _bounds(df, keys, value), keys).withColumn("_bucket", _bucket(F.col(value))).drop("_bounds")


def order_statistics(df: DataFrame, keys: list[str], value: str, wanted: DataFrame) -> DataFrame:
    """``wanted`` (keys, rank: 0 is the least) with value, the value of that rank in its group; ranks beyond a group have no row.

    Null values have no rank, nan is the greatest.
    """
    rows = in_buckets(df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_x")), keys, "_x")
    counts = rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    over = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)  # a row a bucket
    ends = counts.withColumn("_end", F.sum("_n").over(over)).withColumn("_begin", F.col("_end") - F.col("_n"))
    asked = _join(wanted.select(*keys, "rank"), ends, keys).filter((F.col("rank") >= F.col("_begin")) & (F.col("rank") < F.col("_end")))
    asked = asked.groupBy(*keys, "_bucket", "_begin").agg(F.collect_set("rank").alias("_ranks"))
    few = _join(rows, asked, [*keys, "_bucket"]).groupBy(*keys, "_bucket", "_begin", "_ranks", "_x").agg(F.count("*").alias("_n"))
    within = Window.partitionBy(*keys, "_bucket").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    few = few.withColumn("_end", F.col("_begin") + F.sum("_n").over(within))
    return few.withColumn("rank", F.explode(F.filter("_ranks", lambda r: (r < F.col("_end")) & (r >= F.col("_end") - F.col("_n"))))).select(*keys, "rank", F.col("_x").alias(value))


def running_counts(df: DataFrame, keys: list[str], value: str, counts: list[str]) -> DataFrame:
    """(keys, value, c_<count>, n_<count>): for each different value the sums of ``counts`` up to it and in the whole group."""
    steps = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(*[F.sum(c).alias(c) for c in counts])
    steps = in_buckets(steps, keys, value)
    sums = steps.groupBy(*keys, "_bucket").agg(*[F.sum(c).alias(f"_s_{c}") for c in counts])
    every, before = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    sums = sums.select(*keys, "_bucket", *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_before_{c}") for c in counts], *[F.sum(f"_s_{c}").over(every).alias(f"n_{c}") for c in counts])
    within = Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = _join(steps, sums, [*keys, "_bucket"])
    return placed.select(*keys, value, *[(F.col(f"_before_{c}") + F.sum(c).over(within)).alias(f"c_{c}") for c in counts], *[f"n_{c}" for c in counts])


def group_sizes(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n) of the values that are not null."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"))
