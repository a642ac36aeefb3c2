"""Volume profiles: volume by price, its peak and the area that holds most of it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.series import SERIES
from .reports import tpo_letter


def profile_buckets(bars: DataFrame, buckets: int = 24, lookback: int = 200, session_start: int | None = None) -> DataFrame:
    """(symbol, tf, bucket, low, high, total, up, down, tpo) of the last ``lookback`` bars' typical prices; empty buckets too.

    tpo: the letters of the bucket's bars in order, A being the first bar of the window. With ``session_start`` (ms) the window
    begins there, unless it has no bar since then.
    """
    buckets = min(256, max(4, buckets))
    w = Window.partitionBy(*SERIES).orderBy(F.desc("t"))
    last = bars.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= lookback)
    all_ = Window.partitionBy(*SERIES)
    if session_start is not None:
        last = last.withColumn("_late", F.max("t").over(all_) >= session_start).filter(~F.col("_late") | (F.col("t") >= session_start))
    last = last.withColumn("_k", F.max("_r").over(all_) - F.col("_r"))
    last = last.withColumns({"_lo": F.min("l").over(all_), "_hi": F.max("h").over(all_), "_tp": (F.col("h") + F.col("l") + F.col("c")) / 3}).filter("_hi > _lo")
    b = F.least(F.lit(buckets - 1), F.floor((F.col("_tp") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * buckets)).cast("int")
    filled = last.groupBy(*SERIES, b.alias("bucket")).agg(F.sum("v").alias("total"), F.sum(F.when(F.col("c") >= F.col("o"), F.col("v")).otherwise(0.0)).alias("up"), F.array_sort(F.collect_list(F.struct("_k", tpo_letter(F.col("_k") % 702).alias("x")))).alias("_tpo"))
    grid = last.groupBy(*SERIES).agg(F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi")).withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    step = (F.col("_hi") - F.col("_lo")) / buckets
    out = grid.join(filled, [*SERIES, "bucket"], "left").fillna(0.0, ["total", "up"])
    return out.select(*SERIES, "bucket", (F.col("_lo") + F.col("bucket") * step).alias("low"), (F.col("_lo") + (F.col("bucket") + 1) * step).alias("high"), "total", "up", (F.col("total") - F.col("up")).alias("down"), F.coalesce(F.transform("_tpo", lambda x: x["x"]), F.array().cast("array<string>")).alias("tpo"))


def volume_profile(bars: DataFrame, buckets: int = 24, lookback: int = 200, area: float = 0.7, session_start: int | None = None) -> DataFrame:
    """(symbol, tf, poc, vah, val, total, hvn, lvn): the fullest bucket's middle, the bounds of the value area, and how many buckets are high or low in volume.

    The lowest bucket wins a tie for the fullest. The area grows towards the fuller neighbour, up on ties.
    """

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("bucket")
        v, low, high = (p[c].to_numpy() for c in ("total", "low", "high"))
        top = int(v.argmax())
        a = b = top
        inside = v[top]
        while inside < area * v.sum() and (a > 0 or b < len(v) - 1):
            under, over = (v[a - 1] if a else -1.0), (v[b + 1] if b < len(v) - 1 else -1.0)
            a, b = (a, b + 1) if over >= under else (a - 1, b)
            inside += max(over, under)
        base = np.sort(v)[len(v) // 2] or (v[v > 0].mean() if (v > 0).any() else 0.0)
        key = [p["symbol"].iloc[0], p["tf"].iloc[0]]
        return pd.DataFrame([[*key, (low[top] + high[top]) / 2, high[b], low[a], v.sum(), int((v >= 1.5 * base).sum()), int(((v > 0) & (v <= 0.4 * base)).sum())]], columns=["symbol", "tf", "poc", "vah", "val", "total", "hvn", "lvn"])

    return profile_buckets(bars, buckets, lookback, session_start).drop("tpo").groupBy(*SERIES).applyInPandas(run, "symbol string, tf string, poc double, vah double, val double, total double, hvn int, lvn int")
