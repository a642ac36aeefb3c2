"""Checking, aligning, de-duplicating and completing bars; filters over rows of any table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.series import DAY_MS, SERIES, in_order, step_ms

OLDEST_MS, AHEAD_MS, LARGEST = 946_684_800_000, 120_000, 1e15
#: Share of a bar by which a time may be late and is still put on the grid.
LATE = 0.25


def validate(df: DataFrame, now: int) -> DataFrame:
    """Add ok and reason (null if ok): the first rule that a bar breaks. Prices may be strings.

    ``t`` must be on the grid of its timeframe, or up to a quarter of a bar late (see ``align``).
    An unknown timeframe has no grid.
    """
    num = {k: F.expr(f"try_cast({k} as double)") for k in "ohlcv"}
    bad = lambda x: x.isNull() | F.isnan(x)
    rule = F.when(F.lit(False), "")
    for k, x in num.items():
        rule = rule.when(bad(x), f"bad-{k}")
    o, h, low, c, v = num.values()
    late = F.pmod(F.col("t"), step_ms(F.col("tf")))
    rule = (
        rule.when(F.greatest(*[F.abs(x) for x in num.values()]) > LARGEST, "overflow").when(F.least(o, h, low, c) <= 0, "non-positive-price").when(v < 0, "neg-volume")
        .when(h < F.greatest(o, c), "h<max").when(low > F.least(o, c), "l>min").when(F.col("t").isNull() | (F.col("t") < OLDEST_MS), "t-too-old").when(F.col("t") > now + AHEAD_MS, "t-in-future")
        .when(late > step_ms(F.col("tf")) * LATE, "t-not-aligned")
    )
    return df.withColumn("reason", rule).withColumn("ok", F.col("reason").isNull())


def align(df: DataFrame) -> DataFrame:
    """Move t down to its grid where it is late by at most a quarter of a bar; soft_aligned tells so."""
    step = step_ms(F.col("tf"))
    late = F.pmod(F.col("t"), step)
    move = (late > 0) & (late <= step * LATE)
    return df.withColumn("soft_aligned", F.coalesce(move, F.lit(False))).withColumn("t", F.when(F.col("soft_aligned"), F.col("t") - late).otherwise(F.col("t")))


def validation_report(checked: DataFrame) -> DataFrame:
    return checked.groupBy(*SERIES, F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key: the last by ``order``. Keys compare null to null."""
    w = Window.partitionBy(*keys).orderBy(*[x.desc() for x in order])
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows of both, one of each key: the later by ``order``, and the new one if equal or without an order."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, [*([F.col(order)] if order else []), F.col("_new")]).drop("_new")


def dedupe(bars: DataFrame) -> DataFrame:
    return latest(bars, [*SERIES, "t"], [F.col(c) for c in ("v", "o", "h", "l", "c") if c in bars.columns])


def gaps(bars: DataFrame) -> DataFrame:
    """(symbol, tf, from_t, to_t, missing): runs of absent bars between those that are there."""
    step = step_ms(F.col("tf"))
    w = in_order()
    out = bars.select(*SERIES, "t", F.lead("t").over(w).alias("_next"), step.alias("_step"))
    return out.filter(F.col("_next") - F.col("t") > F.col("_step")).select(*SERIES, (F.col("t") + F.col("_step")).alias("from_t"), (F.col("_next") - F.col("_step")).alias("to_t"), (F.floor((F.col("_next") - F.col("t")) / F.col("_step")) - 1).cast("long").alias("missing"))


def missing_bars(bars: DataFrame) -> DataFrame:
    """(symbol, tf, t) of every absent bar."""
    return gaps(bars).select(*SERIES, F.explode(F.sequence("from_t", "to_t", step_ms(F.col("tf")))).alias("t"))


# fixed values: days that bars of a timeframe stay hot; others stay 30
HOT_DAYS = {"1m": 30, "5m": 90, "15m": 180, "1h": 730, "4h": 1825, "1d": 3650}


def retention_split(bars: DataFrame, now: int, hot_days: dict[str, int] = HOT_DAYS) -> tuple[DataFrame, DataFrame]:
    """(hot, cold) bars, by age and timeframe."""
    days = F.coalesce(F.create_map(*[F.lit(x) for pair in hot_days.items() for x in pair])[F.col("tf")], F.lit(30))
    hot = F.col("t") >= now - days.cast("long") * DAY_MS
    return bars.filter(hot), bars.filter(~hot)


# fixed values: days that rows of other tables are kept
KEPT_DAYS = {"features": 90, "predictions": 365, "validations": 365, "training": 365, "regimes": 365, "news": 30}


def unexpired(rows: DataFrame, table: str, now: int, time: str = "t", kept_days: dict[str, int] = KEPT_DAYS) -> DataFrame:
    """Rows of a table of this kind that aren't older than it keeps them; rows without a time stay."""
    return rows.filter(F.col(time).isNull() | (F.col(time) >= now - kept_days[table] * DAY_MS))


def matching(df: DataFrame, since: int | None = None, until: int | None = None, time: str = "t", **equal) -> DataFrame:
    """Rows with ``time`` in [since, until] and the given values; None asks for nothing."""
    for column, value in equal.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    if since is not None:
        df = df.filter(F.col(time) >= since)
    return df if until is None else df.filter(F.col(time) <= until)


def last_n(bars: DataFrame, n: int) -> DataFrame:
    """The newest n bars of each series."""
    w = Window.partitionBy(*SERIES).orderBy(F.desc("t"))
    return bars.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def open_at(t: Column, tf: Column) -> Column:
    """When the bar that a prediction made at bar t is about opens: one bar later."""
    return t + step_ms(tf)


def close_at(t: Column, tf: Column, grace_ms: int = 4000) -> Column:
    """When a prediction made at bar t can be graded: two bars later and a grace."""
    return t + 2 * step_ms(tf) + grace_ms
