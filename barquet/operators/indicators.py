"""Indicators of every bar of every series.

Frame indicators are window columns over one partitioning and order. Recursive ones (EMA, Wilder,
PSAR) go through one grouped-map pass that sees a whole series; a series is bounded by its bars,
and many series make the parallelism.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.series import DAY_MS, SERIES, clamp, full, in_order, in_time, last_rows, numbers, plus, with_columns


def sma(n: int, x: str = "c") -> Column:
    return full(n, F.avg(x).over(last_rows(n)))


def wma(n: int, x: str = "c") -> Column:
    w = in_order()
    total = sum((F.lag(x, k).over(w) if k else F.col(x)) * (n - k) for k in range(n))
    return full(n, total / (n * (n + 1) / 2))


def roc(n: int = 10, x: str = "c") -> Column:
    before = F.lag(x, n).over(in_order())
    return F.when(before != 0, (F.col(x) / before - 1) * 100)


def log_return(x: str = "c") -> Column:
    before = F.lag(x).over(in_order())
    return F.when((before > 0) & (F.col(x) > 0), F.ln(F.col(x) / before))


def true_range() -> Column:
    before = F.lag("c").over(in_order())
    return F.when(before.isNull(), F.col("h") - F.col("l")).otherwise(F.greatest(F.col("h") - F.col("l"), F.abs(F.col("h") - before), F.abs(F.col("l") - before)))


def moving(df: DataFrame) -> DataFrame:
    return df.withColumns({"sma20": sma(20), "wma10": wma(10), "roc10": roc(10), "log_ret": log_return(), "tr": true_range()})


def bands(df: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    """Bollinger bands with the population deviation, and their width."""
    w = last_rows(n)
    mid, sd = F.avg("c").over(w), F.stddev_pop("c").over(w)
    return df.withColumns({"bb_mid": full(n, mid), "bb_up": full(n, mid + k * sd), "bb_lo": full(n, mid - k * sd), "bb_width": full(n, F.when(mid != 0, 2 * k * sd / mid))})


def cci(df: DataFrame, n: int = 20) -> DataFrame:
    """Commodity channel index: distance from the mean in mean absolute deviations; 0 where these are 0."""
    df = df.withColumn("_tp", (F.col("h") + F.col("l") + F.col("c")) / 3)
    w = last_rows(n)
    df = df.withColumns({"_tps": F.collect_list("_tp").over(w), "_mean": F.avg("_tp").over(w)})
    mad = F.aggregate("_tps", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("_mean"))) / n
    return df.withColumn("cci20", full(n, F.when(mad == 0, 0.0).otherwise((F.col("_tp") - F.col("_mean")) / (0.015 * mad)))).drop("_tp", "_tps", "_mean")


def stochastic(df: DataFrame, n: int = 14, smooth: int = 3) -> DataFrame:
    """%K (50 where the range is flat), %D, and Williams %R (-50 where flat)."""
    hh, ll = F.max("h").over(last_rows(n)), F.min("l").over(last_rows(n))
    k = F.when(hh == ll, 50.0).otherwise((F.col("c") - ll) / (hh - ll) * 100)
    r = F.when(hh == ll, -50.0).otherwise((hh - F.col("c")) / (hh - ll) * -100)
    df = df.withColumns({"stoch_k": full(n, k), "williams_r": full(n, r)})
    return df.withColumn("stoch_d", full(n + smooth - 1, F.avg("stoch_k").over(last_rows(smooth))))


def ichimoku(df: DataFrame, fast: int = 9, mid: int = 26, slow: int = 52, shift: int = 26) -> DataFrame:
    line = lambda n: full(n, (F.max("h").over(last_rows(n)) + F.min("l").over(last_rows(n))) / 2)
    df = df.withColumns({"tenkan": line(fast), "kijun": line(mid), "_b": line(slow)})
    w = in_order()
    return df.withColumns({"senkou_a": F.lag((F.col("tenkan") + F.col("kijun")) / 2, shift).over(w), "senkou_b": F.lag("_b", shift).over(w), "chikou": F.lead("c", shift).over(w)}).drop("_b")


def vwap(df: DataFrame, n: int = 20, anchor_ms: int = DAY_MS) -> DataFrame:
    """Volume-weighted price over the last n bars, and since the anchor (a UTC day)."""
    tp = (F.col("h") + F.col("l") + F.col("c")) / 3
    df = df.withColumns({"_pv": tp * F.col("v"), "_anchor": F.floor(F.col("t") / anchor_ms)})
    w, a = last_rows(n), in_order("_anchor").rowsBetween(Window.unboundedPreceding, 0)
    ratio = lambda x, y: F.when(y > 0, x / y)
    return df.withColumns({"vwap20": full(n, ratio(F.sum("_pv").over(w), F.sum("v").over(w))), "vwap_day": ratio(F.sum("_pv").over(a), F.sum("v").over(a))}).drop("_pv", "_anchor")


def volume(df: DataFrame, n_cmf: int = 20, n_mfi: int = 14) -> DataFrame:
    """OBV, Chaikin money flow, money flow index (100 without negative flow), volume against its mean."""
    return flows(balance(df), n_cmf, n_mfi)


def balance(df: DataFrame) -> DataFrame:
    """OBV alone: the one of the volume's columns that looks back without end."""
    w = in_order()
    before = F.lag("c").over(w)
    signed = F.when(before.isNull(), 0.0).when(F.col("c") > before, F.col("v")).when(F.col("c") < before, -F.col("v")).otherwise(0.0)
    return df.withColumn("_signed", signed).withColumn("obv", F.sum("_signed").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_signed")


def flows(df: DataFrame, n_cmf: int = 20, n_mfi: int = 14) -> DataFrame:
    """The volume's columns but OBV: none looks further back than its number of bars."""
    w = in_order()
    span, tp = F.col("h") - F.col("l"), (F.col("h") + F.col("l") + F.col("c")) / 3
    df = df.withColumns({"_mfv": F.when(span == 0, 0.0).otherwise(((F.col("c") - F.col("l")) - (F.col("h") - F.col("c"))) / span * F.col("v")), "_tp": tp})
    last_tp = F.lag("_tp").over(w)
    df = df.withColumns({"_up": F.when(F.col("_tp") > last_tp, F.col("_tp") * F.col("v")).otherwise(0.0), "_down": F.when(F.col("_tp") < last_tp, F.col("_tp") * F.col("v")).otherwise(0.0)})
    up, down = F.sum("_up").over(last_rows(n_mfi)), F.sum("_down").over(last_rows(n_mfi))
    total = F.sum("v").over(last_rows(n_cmf))
    return df.withColumns({
        "cmf20": full(n_cmf, F.when(total == 0, 0.0).otherwise(F.sum("_mfv").over(last_rows(n_cmf)) / total)),
        "mfi14": full(n_mfi + 1, F.when(down == 0, 100.0).otherwise(100 - 100 / (1 + up / down))),
        "rel_volume": full(20, F.when(F.avg("v").over(last_rows(20)) > 0, F.col("v") / F.avg("v").over(last_rows(20)))),
    }).drop("_mfv", "_tp", "_up", "_down")


def return_std(df: DataFrame, n: int = 20) -> DataFrame:
    """Deviation of log returns over the last n, in units of price."""
    df = df.withColumn("_r", log_return())
    return df.withColumn("ret_std20", full(n + 1, F.stddev_pop("_r").over(last_rows(n)) * F.col("c"))).drop("_r")


# ---- recursive indicators: one pass over a series ----


def smoothed(x: np.ndarray, n: int, alpha: float) -> np.ndarray:
    """y += alpha * (x - y), seeded with the mean of the first n inputs; nan before."""
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        seeded = np.concatenate([[x[:n].mean()], x[n:]])
        out[n - 1 :] = _followed(seeded.tolist(), alpha) if np.isfinite(seeded).all() else pd.Series(seeded).ewm(alpha=alpha, adjust=False).mean().to_numpy()
    return out


def _followed(xs: list[float], alpha: float) -> list[float]:
    """The weighted means of pandas' ewm, without the time that it takes to be set up for each of many short series."""
    keep, y = 1 - alpha, xs[0]
    total = keep + alpha
    if total == 1:
        return [y := (keep * y + alpha * x if y != x else y) for x in xs]
    return [y := ((keep * y + alpha * x) / total if y != x else y) for x in xs]


def ema(x: np.ndarray, n: int) -> np.ndarray:
    return smoothed(x, n, 2 / (n + 1))


def wilder(x: np.ndarray, n: int) -> np.ndarray:
    return smoothed(x, n, 1 / n)


def _after(x: np.ndarray, n: int) -> np.ndarray:
    """Put what begins at bar 1 back in line with the bars."""
    return np.concatenate([[np.nan], x])[:n]


def _psar(h: np.ndarray, low: np.ndarray, start: float = 0.02, step: float = 0.02, most: float = 0.2) -> tuple[np.ndarray, np.ndarray]:
    """Stop and reverse: the stop closes in on the price as the trend makes new extremes."""
    n = len(h)
    if n < 2:
        return np.full(n, np.nan), np.zeros(n, np.int32)
    two = lambda x, f: np.concatenate([x[:1], x[:1], f(x[:-2], x[1:-1])]).tolist()  # noqa: E731  (of the two bars before each)
    floors, roofs = two(low, np.minimum), two(h, np.maximum)
    highs, lows = h.tolist(), low.tolist()
    up = highs[1] >= highs[0]
    extreme, stop, speed = (highs[0], lows[0], start) if up else (lows[0], highs[0], start)
    stops, trend = [stop], [1 if up else -1]
    for hi, lo, floor, roof in zip(highs[1:], lows[1:], floors[1:], roofs[1:], strict=True):
        stop += speed * (extreme - stop)
        if up:
            stop = floor if floor < stop else stop
            if lo < stop:
                up, stop, extreme, speed = False, extreme, lo, start
            elif hi > extreme:
                extreme, speed = hi, min(speed + step, most)
        else:
            stop = roof if roof > stop else stop
            if hi > stop:
                up, stop, extreme, speed = True, extreme, hi, start
            elif lo < extreme:
                extreme, speed = lo, min(speed + step, most)
        stops.append(stop)
        trend.append(1 if up else -1)
    return np.array(stops), np.array(trend, np.int32)


RECURSIVE = ["ema12", "ema20", "ema26", "ema50", "ema200", "dema20", "tema20", "macd", "macd_signal", "macd_hist", "rsi14", "atr14", "plus_di", "minus_di", "adx14", "psar"]


def _recursive(bars: pa.Table) -> pa.Table:
    bars = in_time(bars)
    h, low, c = numbers(bars, "h", "l", "c")
    n = len(c)
    out: dict[str, np.ndarray] = {f"ema{k}": ema(c, k) for k in (12, 20, 26, 50, 200)}
    zero = lambda x: np.nan_to_num(x, nan=0.0)  # noqa: E731  (warm-up of a nested average counts as zero)
    e1 = out["ema20"]
    e2 = ema(zero(e1), 20)
    e3 = ema(zero(e2), 20)
    ready = lambda x, k: np.where(np.arange(n) >= k, x, np.nan)
    out["dema20"], out["tema20"] = ready(2 * e1 - e2, 38), ready(3 * e1 - 3 * e2 + e3, 57)
    macd = out["ema12"] - out["ema26"]
    out["macd"] = macd
    out["macd_signal"] = ready(ema(zero(macd), 9), 33)
    out["macd_hist"] = macd - out["macd_signal"]
    step = np.diff(c)
    gain, loss = wilder(np.maximum(step, 0), 14), wilder(np.maximum(-step, 0), 14)
    with np.errstate(divide="ignore", invalid="ignore"):
        out["rsi14"] = _after(np.where(np.isnan(loss), np.nan, np.where(loss == 0, 100.0, 100 - 100 / (1 + gain / loss))), n)
        tr = np.maximum(h[1:] - low[1:], np.maximum(np.abs(h[1:] - c[:-1]), np.abs(low[1:] - c[:-1])))
        atr = wilder(tr, 14)
        out["atr14"] = _after(atr, n)
        up, down = np.diff(h), -np.diff(low)
        plus, minus = wilder(np.where((up > down) & (up > 0), up, 0.0), 14), wilder(np.where((down > up) & (down > 0), down, 0.0), 14)
        live = atr > 0
        p, m = np.where(live, plus / atr * 100, np.nan), np.where(live, minus / atr * 100, np.nan)
        dx = np.where(p + m == 0, 0.0, np.abs(p - m) / (p + m) * 100)[live]
    adx = np.full(len(tr), np.nan)
    adx[np.flatnonzero(live)] = wilder(dx, 14)
    out["plus_di"], out["minus_di"], out["adx14"] = _after(p, n), _after(m, n), _after(adx, n)
    out["psar"], trend = _psar(h, low)
    return with_columns(bars, {k: pa.array(out[k], from_pandas=True) for k in RECURSIVE} | {"psar_trend": pa.array(trend)})  # nan becomes null


RECURSIVE_SCHEMA = ", ".join(f"{x} double" for x in RECURSIVE) + ", psar_trend int"


def recursive(df: DataFrame) -> DataFrame:
    """Add ``RECURSIVE`` and psar_trend. A null price has no place in a series: filter (see cleaning) before."""
    df = df.select([c for c in df.columns if c not in {*RECURSIVE, "psar_trend"}])
    return df.groupBy(*SERIES).applyInArrow(_recursive, plus(df.schema, RECURSIVE_SCHEMA))


def keltner(df: DataFrame, k: float = 1.5) -> DataFrame:
    """EMA20 and k average true ranges around it; needs the recursive columns."""
    return df.withColumns({"kc_up": F.col("ema20") + k * F.col("atr14"), "kc_lo": F.col("ema20") - k * F.col("atr14")})


# ---- regimes ----


def bull_features(df: DataFrame) -> DataFrame:
    """Share of rising bars of 30, slope of the mean volume over 20 bars in [-1, 1], range of the bar in percent."""
    rising = F.when(F.col("c") > F.col("o"), 1.0).otherwise(0.0)
    mean = F.avg("v").over(last_rows(20))
    df = df.withColumn("_mean_v", full(20, mean))
    before = F.lag("_mean_v", 20).over(in_order())
    return df.withColumns({"bull_pct30": full(30, F.avg(rising).over(last_rows(30))), "volume_slope": F.when(before > 0, clamp(F.col("_mean_v") / before - 1, -1, 1)), "range_pct": F.when(F.col("c") != 0, (F.col("h") - F.col("l")) / F.col("c"))}).drop("_mean_v")


def classify_regime(df: DataFrame, structure: str | None = None) -> DataFrame:
    """Strength, volatility, alignment, trend and momentum of every bar, and their label.

    Needs the recursive columns and bands. A missing input leaves its part at the neutral value. ``structure``: a column with the
    trend of the pivots; if it says up or down, it goes before the alignment where directional strength is weak.
    """
    # fixed values: thresholds
    strength = F.when(F.col("adx14") >= 40, "strong").when(F.col("adx14") >= 25, "moderate").otherwise("weak")
    atr_pct = F.when(F.col("c") > 0, F.col("atr14") / F.col("c"))
    volatility = F.when(atr_pct.isNotNull(), F.when(atr_pct <= 0.003, "low").when(atr_pct >= 0.02, "high").otherwise("normal")).when(F.col("bb_width") <= 0.02, "low").when(F.col("bb_width") >= 0.08, "high").otherwise("normal")
    known = F.col("ema20").isNotNull() & F.col("ema50").isNotNull() & F.col("ema200").isNotNull()
    rising, falling = (F.col("ema20") > F.col("ema50")) & (F.col("ema50") > F.col("ema200")), (F.col("ema20") < F.col("ema50")) & (F.col("ema50") < F.col("ema200"))
    alignment = F.when(known & rising, "bullish-stack").when(known & falling, "bearish-stack").when(known, "mixed").otherwise("flat")
    df = df.withColumns({"strength": strength, "volatility": volatility, "alignment": alignment})
    by_di = (F.col("strength") != "weak") & F.col("plus_di").isNotNull() & F.col("minus_di").isNotNull()
    pivots = F.col(structure) if structure else F.lit(None).cast("string")
    trend = F.when(by_di, F.when(F.col("plus_di") > F.col("minus_di"), "up").otherwise("down")).when(pivots.isin("up", "down"), pivots).when(F.col("alignment") == "bullish-stack", "up").when(F.col("alignment") == "bearish-stack", "down").otherwise("range")
    speed = clamp(F.coalesce(F.when(F.col("c") > 0, clamp(F.col("macd_hist") / F.col("c") * 1000, -1, 1)), F.lit(0.0)) + F.coalesce((F.col("rsi14") - 50) / 100, F.lit(0.0)), -1, 1)
    df = df.withColumns({"trend": trend, "momentum_score": speed, "momentum": F.when(speed > 0.15, "up").when(speed < -0.15, "down").otherwise("flat")})
    return df.withColumn("regime", F.concat(F.when(F.col("trend") == "range", "range").otherwise(F.concat(F.lit("trending-"), "trend")), F.lit("-"), "strength", F.lit("-"), "volatility", F.lit("-vol")))


def regime_scores(df: DataFrame, structure: str | None = None, lookback: int = 10) -> DataFrame:
    """``classify_regime``'s rows with trend_score in [-1, 1], vol_score in [0, 1] and, with break_side and break_age, breakout (up, down, none).

    trend_score is the share of directional movement, or 0.4 by the pivots' trend, or 0.3 by the alignment, as the trend was decided;
    breakout is the side of the last structure break, if it is at most ``lookback`` bars old.
    """
    p, m = F.col("plus_di"), F.col("minus_di")
    sign = lambda up: F.when(up, 1.0).otherwise(-1.0)
    by_di = (F.col("strength") != "weak") & p.isNotNull() & m.isNotNull()
    pivots = F.col(structure) if structure else F.lit(None).cast("string")
    trend = (
        F.when(by_di, sign(p > m) * F.abs(p - m) / F.greatest(F.lit(1.0), p + m)).when(pivots.isin("up", "down"), 0.4 * sign(pivots == "up"))
        .when(F.col("alignment") == "bullish-stack", 0.3).when(F.col("alignment") == "bearish-stack", -0.3).otherwise(0.0)
    )
    # fixed values: bounds of low and high volatility
    atr = F.when(F.col("c") > 0, F.col("atr14") / F.col("c"))
    vol = F.when(atr.isNotNull(), (atr - 0.003) / (0.02 - 0.003)).when(F.col("bb_width").isNotNull(), (F.col("bb_width") - 0.02) / (0.08 - 0.02)).otherwise(0.0)
    out = df.withColumns({"trend_score": trend, "vol_score": clamp(vol, 0, 1)})
    if "break_age" not in df.columns:
        return out
    near = F.coalesce(F.col("break_age") <= lookback, F.lit(False))
    return out.withColumn("breakout", F.when(near & (F.col("break_side") > 0), "up").when(near & (F.col("break_side") < 0), "down").otherwise("none"))
