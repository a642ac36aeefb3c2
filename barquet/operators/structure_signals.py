"""Signals of a series' last bar out of its structure: levels, order blocks, liquidity, ranges, lines, patterns, displacement.

Each function takes ``last`` (symbol, tf, t, i, c, atr14: one row a series) and structure tables, and
gives (symbol, tf, module, signal, confidence), so they stack by union and join the score by weight.
``stacked`` makes the tables and gives all of them, ``in_columns`` puts them side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.series import SERIES, clamp, in_order, index, last_rows, settled
from . import features as X
from . import structure as S
from .structure import session_of

# fixed values: weights by module
WEIGHTS = {"support-resistance": 0.9, "order-blocks": 0.9, "liquidity": 0.9, "premium-discount": 0.7, "cisd": 1.1, "trendline": 1.0, "chart-patterns": 1.0}


def _out(df: DataFrame, module: str, signal: Column, confidence: Column) -> DataFrame:
    return df.select(*SERIES, F.lit(module).alias("module"), clamp(F.coalesce(signal, F.lit(0.0)), -1, 1).alias("signal"), clamp(F.coalesce(confidence, F.lit(0.0)), 0, 1).alias("confidence"))


def _range(last: DataFrame) -> Column:
    """The true range that tolerances are counted in."""
    return F.coalesce(F.col("atr14"), F.col("c") * 0.005)


def support_resistance(last: DataFrame, levels: DataFrame) -> DataFrame:
    """At the nearest level below or above (half a true range): expect it to hold; between them a mild pull to the middle."""
    near = last.join(levels.select(*SERIES, "price", "strength"), SERIES)
    below, above = F.col("price") <= F.col("c"), F.col("price") >= F.col("c")
    near = near.groupBy(*SERIES, "c", "atr14").agg(
        F.max(F.when(below, F.struct("price", "strength"))).alias("s"), F.min(F.when(above, F.struct("price", "strength"))).alias("r"),
    )
    tol = F.coalesce(F.col("atr14") * 0.5, F.col("c") * 0.005)
    ds, dr = F.col("c") - F.col("s.price"), F.col("r.price") - F.col("c")
    at_s, at_r = F.coalesce(ds <= tol, F.lit(False)), F.coalesce(dr <= tol, F.lit(False))
    power = lambda x: F.least(F.lit(1.0), F.col(f"{x}.strength") / 5)
    pull = F.when(ds + dr > 0, (0.5 - ds / (ds + dr)) * 0.5)
    signal = F.when(at_s & ~at_r, 0.4 + 0.4 * power("s")).when(at_r & ~at_s, -(0.4 + 0.4 * power("r"))).otherwise(pull)
    return _out(near, "support-resistance", signal, F.when(at_s & ~at_r, 0.4 + 0.3 * power("s")).when(at_r & ~at_s, 0.4 + 0.3 * power("r")).otherwise(F.abs(pull) * 2))


def order_blocks(last: DataFrame, blocks: DataFrame) -> DataFrame:
    """The nearest untouched block around the close: with it, the more so the fresher it is."""
    tol = F.coalesce(F.col("atr14") * 0.25, F.col("c") * 0.0025)
    b = last.select(*SERIES, F.col("i").alias("last_i"), "c", "atr14").join(blocks.select(*SERIES, "i", "kind", "top", "bottom", F.col("mitigated_i").isNull().alias("_open")), SERIES)
    gap = F.greatest(F.lit(0.0), F.col("bottom") - F.col("c"), F.col("c") - F.col("top"))
    b = b.withColumn("_d", F.when(gap <= tol, 0.0).otherwise(gap)).withColumn("_tol", tol)
    near = F.when(F.col("_open") & (F.col("_d") < 2 * F.col("_tol")), F.struct("_d", "i"))
    best = b.groupBy(*SERIES, "last_i").agg(F.min_by(F.struct("i", "kind", "_d", "_tol"), near).alias("b"), F.max("_open").alias("_open"))
    age = F.col("last_i") - F.col("b.i")
    fresh = F.when(age <= 5, 1.0).when(age <= 20, 0.7).when(age <= 50, 0.4).otherwise(0.2)
    conf = F.least(F.lit(1.0), 0.3 + 0.4 * fresh + 0.3 * (1 - F.col("b._d") / (2 * F.col("b._tol"))))
    return _out(best, "order-blocks", F.when(F.col("b.kind") == "bull", 0.3 + 0.7 * conf).when(F.col("b.kind") == "bear", -0.3 - 0.7 * conf), F.when(F.col("b").isNotNull(), conf).when(F.col("_open"), 0.08).otherwise(0.05))


def liquidity(last: DataFrame, swept: DataFrame, lookback: int = 5) -> DataFrame:
    """A sweep of equal highs in the last bars trades up, of equal lows down (with the trap); else a mild pull to the nearer pool."""
    z = last.select(*SERIES, F.col("i").alias("last_i"), "c", "atr14").join(swept.select(*SERIES, "kind", "price", "touches", "swept_i"), SERIES, "left")
    above, below = (F.col("kind") == "high") & (F.col("price") > F.col("c")), (F.col("kind") == "low") & (F.col("price") < F.col("c"))
    g = z.groupBy(*SERIES, "last_i", "c", "atr14").agg(
        F.max_by("kind", "swept_i").alias("kind"), F.max("swept_i").alias("at"),
        F.min(F.when(above, F.struct("price", "touches"))).alias("up"), F.max(F.when(below, F.struct("price", "touches"))).alias("down"),
    )
    age, far = F.col("last_i") - F.col("at"), F.lit(float("inf"))
    fresh = F.when(age == 0, 1.0).when(age <= 2, 0.8).otherwise(0.5)
    trap = F.coalesce(age <= lookback, F.lit(False))
    up, down, reach = F.coalesce(F.col("up.price") - F.col("c"), far), F.coalesce(F.col("c") - F.col("down.price"), far), 8 * _range(g)
    to_up, to_down = (up < down) & (up < reach), (down < up) & (down < reach)
    power = F.least(F.lit(1.0), F.when(to_up, F.col("up.touches")).otherwise(F.col("down.touches")) / 4)
    signal = F.when(trap, F.when(F.col("kind") == "high", 1.0).otherwise(-1.0) * (0.4 + 0.4 * fresh)).when(to_up, 0.15 + 0.2 * power).when(to_down, -0.15 - 0.2 * power)
    return _out(g, "liquidity", signal, F.when(trap, 0.35 + 0.45 * fresh).when(to_up | to_down, 0.2 + 0.2 * power).otherwise(0.05))


def premium_discount(ranges: DataFrame) -> DataFrame:
    """Cheap in the range is bought, dear sold, the more so the further."""
    low, high = F.greatest(F.lit(0.0), (0.45 - F.col("pct")) / 0.45), F.greatest(F.lit(0.0), (F.col("pct") - 0.55) / 0.45)
    signal = F.when(F.col("zone") == "discount", 0.2 + 0.4 * low).when(F.col("zone") == "premium", -(0.2 + 0.4 * high)).otherwise(0.0)
    return _out(ranges, "premium-discount", signal, F.when(F.col("zone") == "discount", 0.25 + 0.35 * low).when(F.col("zone") == "premium", 0.25 + 0.35 * high).otherwise(0.1))


def trendline(last: DataFrame, lines: DataFrame) -> DataFrame:
    """The better line's slope, a close beyond a line by half a true range, and the place between both; ``lines`` with touches."""
    at = last.join(lines, SERIES).withColumn("y", F.col("slope") * F.col("i") + F.col("intercept"))
    side = lambda k: F.max(F.when(F.col("kind") == k, F.struct("y", "slope", "score", "touches"))).alias(k)
    g = at.groupBy(*SERIES, "c", "atr14").agg(side("high"), side("low"))
    upper = F.coalesce(F.col("low").isNull() | (F.col("high.score") >= F.col("low.score")), F.lit(False))
    best = lambda x: F.when(upper, F.col(f"high.{x}")).otherwise(F.col(f"low.{x}"))
    half = 0.5 * _range(g)
    up, down = F.coalesce(F.col("c") - F.col("high.y") >= half, F.lit(False)), F.coalesce(F.col("low.y") - F.col("c") >= half, F.lit(False))
    place = clamp(2 * (F.col("c") - F.col("low.y")) / (F.col("high.y") - F.col("low.y")) - 1, -1, 1)
    signal = 0.5 * F.tanh(4 * best("slope") / F.when(F.col("atr14") > 0, F.col("atr14")).otherwise(1.0)) + F.when(up, 0.3).when(down, -0.3).otherwise(0.0)
    signal += F.when(F.col("high.y") > F.col("low.y"), -0.2 * place).otherwise(0.0)
    weak = (best("score") < 0.3) | (best("touches") < 3)
    return _out(g, "trendline", F.when(weak, 0.0).otherwise(signal), F.when(weak, F.least(F.lit(0.3), best("score"))).otherwise(best("score") * F.when(up | down, 1.0).otherwise(0.85)))


def chart_patterns(found: DataFrame) -> DataFrame:
    """The newest pattern's side, six tenths of it while its trigger holds. ``found``: see ``features.chart_patterns``."""
    newest = found.groupBy(*SERIES).agg(F.max_by(F.struct("bias", "confidence", "broken"), F.struct("i", "confidence", "place")).alias("p"))
    side, conf = F.when(F.col("p.bias") == "bullish", 1.0).otherwise(-1.0), F.col("p.confidence")
    return _out(newest, "chart-patterns", side * conf * F.when(F.col("p.broken"), 1.0).otherwise(0.6), conf)


#: Bars from a series' end on that ``displacements`` reads: 80 and 12 that it marks, and the 103 before these that tell whether they are calm.
DISPLACEMENT_BARS = 200


def displacements(bars: DataFrame, breaks: DataFrame, swept: DataFrame, gaps: DataFrame, within: int = 80) -> DataFrame:
    """(symbol, tf, inducement_i, swept_i, i, side, wick, volume): calm, a weak break, its sweep, then a turn with a gap and volume.

    ``bars`` with atr14, bb_width; the turn lies in the last ``within`` bars of its series. A weak break
    (under 1.5 true ranges) follows a compressed bar; within five bars a wick of 1.5 bodies goes beyond
    its level and closes back; within six the structure turns, with a gap of its side and 1.5 times the
    usual volume. Only breaks, sweeps and gaps near the end meet, so the joins stay small. ``bars`` with i may
    be the last ``DISPLACEMENT_BARS`` of each series.
    """
    w = in_order()
    body, upper, lower = F.abs(F.col("c") - F.col("o")), F.col("h") - F.greatest("o", "c"), F.least("o", "c") - F.col("l")
    long_ = lambda wick: F.when(wick > 0, F.when(body <= 1e-12, float("inf")).otherwise(wick / body)).otherwise(0.0)
    b = X.compression(bars).withColumns({"i": F.col("i") if "i" in bars.columns else index(), "_rest": F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.desc("t"))) - 1, "_calm": F.col("compressed") | F.coalesce(F.lag("compressed").over(w), F.lit(False)), "_up": long_(upper), "_low": long_(lower), "_mean": F.avg("v").over(last_rows(20))})
    b = b.filter(F.col("_rest") <= within + 12).select(*SERIES, "i", "_rest", "h", "l", "c", "atr14", "_calm", "_up", "_low", F.when(F.col("_mean") > 0, F.col("v") / F.col("_mean")).alias("_rel"))
    marks = breaks.join(b, [*SERIES, "i"])
    weak = marks.filter((F.col("type") == "BoS") & (F.col("atr14") > 0) & (F.abs(F.col("c") - F.col("level")) < 1.5 * F.col("atr14"))).select(*SERIES, F.col("i").alias("inducement_i"), "dir", "level", "_calm")
    turns = marks.filter((F.col("type") == "CHoCH") & (F.col("_rest") <= within)).select(*SERIES, F.col("i").alias("_turn"), F.col("dir").alias("_way"), F.col("_rel").alias("volume"), "_rest")
    hits = swept.filter("swept_i is not null").select(*SERIES, F.when(F.col("kind") == "high", "up").otherwise("down").alias("dir"), F.col("swept_i").alias("i")).distinct().join(b, [*SERIES, "i"]).withColumnRenamed("i", "swept_i").drop("_calm", "_rest")
    near = weak.join(hits, [*SERIES, "dir"]).filter(F.col("swept_i").between(F.col("inducement_i") + 1, F.col("inducement_i") + 5))
    beyond = F.when(F.col("dir") == "up", (F.col("h") > F.col("level")) & (F.col("c") < F.col("level"))).otherwise((F.col("l") < F.col("level")) & (F.col("c") > F.col("level")))
    near = near.withColumn("wick", F.when(F.col("dir") == "up", F.col("_up")).otherwise(F.col("_low"))).withColumn("_good", beyond & (F.col("wick") >= 1.5))
    newest = F.max("inducement_i").over(Window.partitionBy(*SERIES, "dir", "swept_i"))
    latest = F.max(F.when(F.col("_good"), F.col("swept_i"))).over(Window.partitionBy(*SERIES, "dir", "inducement_i"))
    near = near.withColumns({"_newest": newest, "_latest": latest}).filter("_good and _calm and inducement_i = _newest and swept_i = _latest").withColumn("_way", F.when(F.col("dir") == "up", "down").otherwise("up"))
    near = near.select(*SERIES, "inducement_i", "swept_i", "wick", "_way").join(turns, [*SERIES, "_way"]).filter(F.col("_turn").between(F.col("swept_i") + 1, F.col("swept_i") + 6))
    last_turn = F.max("_turn").over(Window.partitionBy(*SERIES, "_way", "swept_i"))
    near = near.withColumn("_last", last_turn).filter("_turn = _last and volume >= 1.5")
    made = gaps.select(*SERIES, F.when(F.col("kind") == "bull", "up").otherwise("down").alias("_way"), F.col("i").alias("_gap"))
    keys = near.join(made, [*SERIES, "_way"]).filter(F.col("_gap").between(F.col("swept_i"), F.col("swept_i") + 6)).select(*SERIES, "_way", "swept_i").distinct()
    return near.join(keys, [*SERIES, "_way", "swept_i"], "left_semi").select(*SERIES, "inducement_i", "swept_i", F.col("_turn").alias("i"), F.when(F.col("_way") == "up", 1).otherwise(-1).alias("side"), "wick", "volume")


def cisd(last: DataFrame, found: DataFrame, least: int = 109) -> DataFrame:
    """The newest displacement's side, by its age, wick and volume. ``found``: see ``displacements``; under ``least`` bars nothing is said."""
    best = found.groupBy(*SERIES).agg(F.max_by(F.struct("side", "i", "wick", "volume"), F.struct("i", "swept_i", "inducement_i")).alias("p"))
    g = last.filter(F.col("i") + 1 >= least).select(*SERIES, F.col("i").alias("last_i")).join(best, SERIES, "left")
    age = F.col("last_i") - F.col("p.i")
    fresh = F.when(age == 0, 1.0).when(age <= 2, 0.85).when(age <= 5, 0.65).otherwise(0.4)
    over = lambda x: F.least(F.lit(1.0), (F.col(x) - 1.5) / 2)
    strength = clamp(0.5 + 0.25 * fresh + 0.125 * (over("p.wick") + over("p.volume")), 0.4, 1)
    return _out(g, "cisd", F.col("p.side") * strength, F.when(F.col("p").isNull(), 0.05).otherwise(0.45 + 0.25 * fresh + 0.15 * over("p.wick") + 0.15 * over("p.volume")))


def stacked(bars: DataFrame) -> DataFrame:
    """All signals of this module, one below the other, out of bars with atr14 and bb_width.

    The structure comes from one pass over the series, which its branches read: see ``structure_events``.
    """
    bars = bars.select(*SERIES, "t", "o", "h", "l", "c", "v", "atr14", "bb_width")
    last = settled(bars.groupBy(*SERIES).agg(F.max_by(F.struct("t", "c", "atr14"), "t").alias("b"), (F.count("*") - 1).alias("i")).select(*SERIES, "b.*", "i"))
    return of_events(settled(S.structure_events(bars)), last, bars, bars)


def of_events(events: DataFrame, last: DataFrame, ranges: DataFrame, bars: DataFrame) -> DataFrame:
    """``stacked`` out of the structure: ``last`` (symbol, tf, t, i, c, atr14) and ``ranges`` (h, l, t, c) a row a series or more, ``bars`` those that ``displacements`` reads."""
    piv, swept, gaps, breaks, blocks = (S.of_tag(events, k) for k in ("pivot", "pool", "gap", "break", "block"))
    tol = lambda k: last.select(*SERIES, (_range(last) * k).alias("tolerance"))
    ends = last.select(*SERIES, F.col("i").alias("last_i"), "c", _range(last).alias("atr14"))
    parts = [
        support_resistance(last, S.sr_levels(piv, tol(0.5))), order_blocks(last, blocks), liquidity(last, swept), premium_discount(S.premium_discount(ranges, piv)),
        trendline(last, S.trendlines(piv, tolerance=tol(0.5))), chart_patterns(X.chart_patterns(piv, ends)), cisd(last, displacements(bars, breaks, swept, gaps)),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def in_columns(signals: DataFrame) -> DataFrame:
    """(symbol, tf, s_<module>, c_<module>...) of ``stacked``."""
    each = lambda x, m: F.max(F.when(F.col("module") == m, F.col(x)))
    return signals.groupBy(*SERIES).agg(*[each(x, m).alias(f"{x[0]}_{m}") for m in WEIGHTS for x in ("signal", "confidence")])


def session_multiplier(t: Column, in_event: Column | None = None) -> Column:
    """What all confidences are multiplied by: less off hours, a little more in London and New York mornings, much less around an event."""
    s = session_of(t)
    base = F.when(s == "off-hours", 0.6).when(s.isin("london", "ny-am"), 1.1).otherwise(1.0)
    return base if in_event is None else base * F.when(in_event, 0.4).otherwise(1.0)


def fuse(signals: DataFrame, last: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(symbol, tf, t, score, probability, confidence, participating, direction) of stacked signals; modules with nothing to say don't take part."""
    weight = F.coalesce(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])[F.col("module")], F.lit(1.0))
    s = signals.join(last.select(*SERIES, "t"), SERIES).withColumn("_c", F.least(F.lit(1.0), F.col("confidence") * session_multiplier(F.col("t")))).withColumn("_w", weight)
    s = s.filter(~((F.col("_c") < 0.05) & (F.abs("signal") < 0.1)))
    out = s.groupBy(*SERIES, "t").agg((F.sum(F.col("signal") * F.col("_c") * F.col("_w")) / F.sum("_w")).alias("score"), F.avg("_c").alias("confidence"), F.count("*").alias("participating"))
    out = out.withColumn("probability", 1 / (1 + F.exp(F.col("score") * -3)))
    return out.withColumn("direction", F.when(F.col("probability") > 0.55, "long").when(F.col("probability") < 0.45, "short").otherwise("neutral"))


def hybrid_decision(df: DataFrame, parts: dict[str, float]) -> DataFrame:
    """Add p: the weighted mean of the probabilities in ``parts`` that aren't null, weights shared anew."""
    total = sum((F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0) for c, w in parts.items()), F.lit(0.0))
    mix = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in parts.items()), F.lit(0.0))
    return df.withColumn("p", F.when(total > 0, mix / total))
