"""One row for each series: what its indicators and structure say at the last bar."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.series import SERIES, settled
from . import indicators as I
from . import structure as S
from .structure import session_of

_LAST = ["c", "ema20", "ema50", "ema200", "rsi14", "atr14", "adx14", "plus_di", "minus_di", "macd_hist", "bb_width"]


def _events_and_last(b: pa.Table) -> list[dict]:
    """The events of a series, and its last bar with the indicators (tag bar; top and bottom: the range of all bars)."""
    b = I._recursive(b)
    last = {k: b[k].slice(len(b) - 1) for k in ("t", *_LAST)}
    return [*S._events(b), {**last, "tag": ["bar"], "i": [len(b) - 1], "top": [pc.max(b["h"]).as_py()], "bottom": [pc.min(b["l"]).as_py()]}]


def series_summary(bars: DataFrame) -> DataFrame:
    """(symbol, tf, t, close, ema20 ... regime): a row a series.

    Bars are shuffled and sorted once: window columns and one pass over each series give all events, tagged, next to the
    last bar; levels join them as further tagged rows, and one aggregate merges what all the tables say. Counts of a
    series without such events are 0, its prices null. support and resistance are the nearest of the twenty strongest levels.
    """
    df = S.structure_columns(I.bands(bars.select(*SERIES, "t", "o", "h", "l", "c")))
    events = settled(S._tagged(df, _events_and_last, ", " + ", ".join(f"{x} double" for x in _LAST)))
    levels = S.sr_levels(events.filter("tag = 'pivot'").select(*SERIES, "i", "t", "price", "kind", (F.col("atr") * 0.5).alias("tolerance")), None)
    rows = events.unionByName(levels.select(*SERIES, F.lit("level").alias("tag"), "price"), allowMissingColumns=True)
    tag, kind, is_open = F.col("tag"), F.col("kind"), F.col("hit_i").isNull()
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    pivot = lambda side, x, near=None: F.max(F.when((tag == "pivot") & (kind == side) & (F.lit(True) if near is None else F.col("rest") < near), F.struct("i", x)))
    out = rows.groupBy(*SERIES).agg(
        F.max(F.when(tag == "bar", F.struct("t", *_LAST, "top", "bottom"))).alias("b"),
        n(tag == "break").alias("breaks"), n((tag == "gap") & is_open).alias("gaps_open"), n((tag == "block") & is_open).alias("blocks_open"),
        n((tag == "block") & is_open & (kind == "bull")).alias("bull_blocks_open"), n((tag == "block") & is_open & (kind == "bear")).alias("bear_blocks_open"),
        n((tag == "pool") & (kind == "high")).alias("equal_highs"), n((tag == "pool") & (kind == "low")).alias("equal_lows"),
        F.max(F.when((tag == "pool") & ~is_open, F.struct("hit_i", "kind", "price"))).alias("sweep"),
        pivot("high", "name", 4).alias("_h"), pivot("low", "name", 4).alias("_l"), pivot("high", "price").alias("_ph"), pivot("low", "price").alias("_pl"),
        F.collect_list(F.when(tag == "level", F.col("price"))).alias("_levels"),
    )
    trend = F.when(F.col("_h").isNull() | F.col("_l").isNull(), "unknown").when((F.col("_h.name") == "HH") & (F.col("_l.name") == "HL"), "up").when((F.col("_h.name") == "LH") & (F.col("_l.name") == "LL"), "down").otherwise("range")
    both = F.col("_ph").isNotNull() & F.col("_pl").isNotNull()
    out = out.select(*SERIES, "b.*", trend.alias("structure_trend"), *[c for c in out.columns if c not in (*SERIES, "b")])
    top, bottom = F.when(both, F.col("_ph.price")).otherwise(F.col("top")), F.when(both, F.col("_pl.price")).otherwise(F.col("bottom"))
    place = F.when(top > bottom, (F.col("c") - bottom) / (top - bottom))
    zone = F.when(place.isNull(), "unknown").when((place < 0) | (place > 1), "outside").when(place < 0.45, "discount").when(place <= 0.55, "equilibrium").otherwise("premium")
    out = out.withColumns({
        "support": F.array_max(F.filter("_levels", lambda x: x <= F.col("c"))), "resistance": F.array_min(F.filter("_levels", lambda x: x >= F.col("c"))),
        "zone": zone, "session": session_of(F.col("t")), "sweep_kind": F.col("sweep.kind"), "sweep_price": F.col("sweep.price"), "sweep_i": F.col("sweep.hit_i"),
    })
    out = I.classify_regime(out)
    return out.select(
        *SERIES, "t", F.col("c").alias("close"), "ema20", "ema50", "ema200", "rsi14", "atr14", "adx14", F.col("structure_trend").alias("structure"), "support", "resistance", "breaks", "gaps_open",
        "blocks_open", "bull_blocks_open", "bear_blocks_open", "equal_highs", "equal_lows", "sweep_kind", "sweep_price", "sweep_i", "zone", "session", "regime", "trend", "strength", "volatility",
    )
