"""Live forms of the jobs: forming bars, validation and news, on Structured Streaming; with those of ``stateful``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.series import SERIES, STEP_MS
from ..operators.cleaning import validate
from ..operators.news import annotate
from .stateful import PENDING, order_closes, reorder_and_gaps, stream_calibration, stream_drift  # noqa: F401

def stream_bars(bars: DataFrame, now: int, delay: str = "10 minutes") -> DataFrame:
    """Valid bars of a stream, each (symbol, tf, t) once within the watermark."""
    good = validate(bars, now).filter("ok").drop("ok", "reason")
    return good.withColumn("at", F.timestamp_millis("t")).withWatermark("at", delay).dropDuplicatesWithinWatermark([*SERIES, "t"])


def form_bars(ticks: DataFrame, tf: str = "1m", delay: str = "1 minute") -> DataFrame:
    """Bars of ticks (symbol, ts, price, size): forming ones in update mode, each closed once in append mode."""
    width = f"{STEP_MS[tf] // 1000} seconds"
    by = ticks.withWatermark("ts", delay).groupBy("symbol", F.window("ts", width).alias("w"))
    out = by.agg(F.min_by("price", "ts").alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", "ts").alias("c"), F.sum("size").alias("v"))
    return out.select("symbol", F.lit(tf).alias("tf"), F.unix_millis("w.start").alias("t"), "o", "h", "l", "c", "v")


def stream_validate(preds: DataFrame, bars: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Predictions of a stream joined to the stream of closed bars at t plus a step; those without stay null past the watermark."""
    step = F.create_map(*[F.lit(x) for pair in STEP_MS.items() for x in pair])[F.col("tf")]
    p = preds.withColumn("target", F.col("t") + step).withColumn("p_at", F.timestamp_millis("target")).withWatermark("p_at", delay)
    b = bars.select(F.col("symbol").alias("b_symbol"), F.col("tf").alias("b_tf"), F.col("t").alias("b_t"), "o", "c").withColumn("b_at", F.timestamp_millis("b_t")).withWatermark("b_at", delay)
    on = F.expr("symbol = b_symbol and tf = b_tf and target = b_t and b_at >= p_at - interval 1 minute and b_at <= p_at + interval 1 minute")
    return p.join(b, on, "left_outer")


def stream_news(news: DataFrame, lexicon: dict[str, float], delay: str = "1 day") -> DataFrame:
    """Annotated news of a stream, each guid once within the watermark."""
    return annotate(news.withWatermark("pub", delay).dropDuplicatesWithinWatermark(["guid"]), lexicon)


def stream_news_tally(annotated: DataFrame, every: str = "10 minutes") -> DataFrame:
    return annotated.groupBy(F.window("pub", every).alias("w"), "primary").agg(F.count("*").alias("n"), F.sum(F.col("high_impact").cast("int")).alias("n_high"))
