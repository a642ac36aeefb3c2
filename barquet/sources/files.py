"""Market files: kline JSON, daily CSV, chart JSON, exchange listings and derivative histories.

Each reader parses with an explicit schema on the executors; rows that don't parse are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.series import SERIES

_PRICES = ("o", "h", "l", "c", "v")


def _bars(df: DataFrame, symbol: str, tf: str) -> DataFrame:
    out = df.select(F.lit(symbol).alias("symbol"), F.lit(tf).alias("tf"), F.col("t").cast("long").alias("t"), *[F.col(k) for k in _PRICES])
    for k in ("t", "o", "h", "l", "c"):
        out = out.filter(F.col(k).isNotNull())
    return out.fillna(0.0, ["v"])


def read_klines(spark: SparkSession, path: str, symbol: str, tf: str, dialect: str = "binance") -> DataFrame:
    """Kline arrays [t, o, h, l, c, v, ...], as a bare array or under result.list ("bybit"); numbers may be strings."""
    text = spark.read.text(path, wholetext=True)
    rows = F.from_json("value", "array<array<string>>") if dialect == "binance" else F.from_json("value", "result struct<list: array<array<string>>>")["result"]["list"]
    parts = text.select(F.explode(rows).alias("k"))
    num = lambda i: F.expr(f"try_cast(k[{i}] as double)")
    return _bars(parts.select(F.expr("try_cast(k[0] as bigint)").alias("t"), *[num(i + 1).alias(k) for i, k in enumerate(_PRICES)]), symbol, tf)


def read_daily_csv(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """Date,Open,High,Low,Close,Volume; t is UTC midnight, a missing volume 0."""
    df = spark.read.option("header", True).schema("Date string, Open string, High string, Low string, Close string, Volume string").csv(path)
    num = [F.expr(f"try_cast({n} as double)").alias(k) for n, k in zip(("Open", "High", "Low", "Close", "Volume"), _PRICES, strict=True)]
    return _bars(df.select(F.expr("unix_millis(try_to_timestamp(Date, 'yyyy-MM-dd'))").alias("t"), *num), symbol, "1d")


def read_chart_json(spark: SparkSession, path: str, symbol: str, tf: str = "1d") -> DataFrame:
    """Arrays beside each other: chart.result[].timestamp[] (seconds) and indicators.quote[0].open[] and so on."""
    quote = "struct<open: array<double>, high: array<double>, low: array<double>, close: array<double>, volume: array<double>>"
    schema = f"chart struct<result: array<struct<timestamp: array<bigint>, indicators: struct<quote: array<{quote}>>>>>"
    one = spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("chart.result").alias("r")).select("r.timestamp", F.col("r.indicators.quote")[0].alias("q"))
    zipped = one.select(F.explode(F.arrays_zip("timestamp", "q.open", "q.high", "q.low", "q.close", "q.volume")).alias("z"))
    return _bars(zipped.select((F.col("z.timestamp") * 1000).alias("t"), *[F.col(f"z.{n}").alias(k) for n, k in zip(("open", "high", "low", "close", "volume"), _PRICES, strict=True)]), symbol, tf)


def read_universe(spark: SparkSession, path: str, market: str = "spot") -> DataFrame:
    """(id, base, quote, market) of the symbols that trade; id has a suffix for linear (:PERP) and inverse (:CM) contracts."""
    schema = "symbols array<struct<symbol: string, status: string, contractStatus: string, contractType: string, baseAsset: string, quoteAsset: string, isSpotTradingAllowed: boolean>>"
    s = spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("symbols").alias("s")).select("s.*").filter(F.coalesce("status", "contractStatus") == "TRADING")
    s = s.filter(F.coalesce("isSpotTradingAllowed", F.lit(True))) if market == "spot" else s.filter(F.col("contractType") == "PERPETUAL")
    suffix = {"spot": "", "linear": ":PERP", "inverse": ":CM"}[market]
    return s.select(F.concat("symbol", F.lit(suffix)).alias("id"), F.col("baseAsset").alias("base"), F.col("quoteAsset").alias("quote"), F.lit(market).alias("market"))


def read_deriv_history(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(symbol, t, value) of open interest (oi), funding (funding) or long/short ratios (ratio)."""
    time, value = {"oi": ("timestamp", "sumOpenInterest"), "funding": ("fundingTime", "fundingRate"), "ratio": ("timestamp", "longShortRatio")}[kind]
    df = spark.read.option("multiLine", True).schema(f"symbol string, {time} string, {value} string").json(path)
    out = df.select("symbol", F.expr(f"try_cast({time} as bigint)").alias("t"), F.expr(f"try_cast({value} as double)").alias("value"))
    return out.filter(F.col("t").isNotNull() & F.col("value").isNotNull())


def deriv_snapshot(oi: DataFrame, funding: DataFrame, ratio: DataFrame, lag: int = 24, marks: DataFrame | None = None) -> DataFrame:
    """(symbol, oi, oi_change, funding, crowding): newest values, the change over ``lag`` periods, tanh of the ratio's excess over 1.

    With ``marks`` (symbol, t, mark, index) also basis, the mark's share above the index.
    """
    from pyspark.sql.window import Window

    w = Window.partitionBy("symbol").orderBy("t")
    change = oi.withColumn("_p", F.lag("value", lag - 1).over(w)).withColumn("_c", F.when(F.col("_p") > 0, F.col("value") / F.col("_p") - 1))
    newest = lambda df, x, name: df.groupBy("symbol").agg(F.max_by(x, "t").alias(name))
    out = newest(change, "value", "oi").join(newest(change, "_c", "oi_change"), "symbol", "full").join(newest(funding, "value", "funding"), "symbol", "full").join(newest(ratio, "value", "_r"), "symbol", "full")
    if marks is not None:
        basis = F.when(F.col("index") > 0, F.col("mark") / F.col("index") - 1)
        out = out.join(newest(marks.withColumn("_basis", basis), "_basis", "basis"), "symbol", "full")
    return out.withColumn("crowding", F.tanh(F.col("_r") - 1)).drop("_r")


def search_universe(universe: DataFrame, text: str, market: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows whose id, assets, name, description, region or currency hold the text, without regard to case."""
    words = [c for c in ("id", "base", "quote", "name", "desc", "description", "region", "currency") if c in universe.columns]
    out = universe.filter(F.contains(F.lower(F.concat_ws(" ", *words)), F.lit(text.lower())))
    out = (out if market is None else out.filter(F.col("market") == market)).orderBy("id")
    return out if limit is None else out.limit(limit)


def merge_universe(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row of each id: new values where given, old ones elsewhere."""
    both = old.alias("a").join(new.alias("b"), "id", "full")
    return both.select("id", *[F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in old.columns if c != "id"])


def universe_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(added, updated, total): one row on ``merge_universe`` of both: ids that only ``new`` has, those that both have, and all."""
    both = old.select("id", F.lit(True).alias("_old")).join(new.select("id", F.lit(True).alias("_new")), "id", "full")
    return both.agg(F.count_if(F.col("_old").isNull()).alias("added"), F.count_if(F.coalesce(F.col("_old") & F.col("_new"), F.lit(False))).alias("updated"), F.count("*").alias("total"))


def with_asset(rows: DataFrame, universe: DataFrame, most: int = 100_000) -> DataFrame:
    """``rows`` with their symbol's universe columns; the universe is broadcast up to ``most`` rows."""
    u = universe.withColumnRenamed("id", "symbol")
    return rows.join(F.broadcast(u) if u.count() <= most else u, "symbol", "left")


__all__ = ["SERIES", "deriv_snapshot", "merge_universe", "read_chart_json", "read_daily_csv", "read_deriv_history", "read_klines", "read_universe", "search_universe", "universe_changes", "with_asset"]
