"""Every module's signal of every bar, the score and the backtest, against a plain reading of the rules bar by bar."""

import math

import pytest
from pyspark.sql import functions as F

from barquet.functions.series import in_order
from barquet.operators import scoring as M
from barquet.sources.bars import lineitem_bars


def fine(*values):
    return all(v is not None and math.isfinite(v) for v in values)


def sign(x):
    return (x > 0) - (x < 0)


def trend_follow(r, past):
    if not fine(r.ema20, r.ema50, r.ema200, r.adx14, r.plus_di, r.minus_di):
        return 0, 0
    side = 1 if r.ema20 > r.ema50 > r.ema200 else -1 if r.ema20 < r.ema50 < r.ema200 else 0
    if not side:
        return 0, 0.1
    if r.adx14 < 20:
        return side * 0.15, 0.15
    if not (r.plus_di > r.minus_di if side > 0 else r.minus_di > r.plus_di):
        return side * 0.2, 0.25
    conf = 0.2 if r.adx14 < 25 else 0.2 + (r.adx14 - 25) / 15 * 0.7 if r.adx14 < 40 else min(1, 0.9 + (r.adx14 - 40) / 400)
    return side * (0.4 + 0.6 * conf), conf


def mean_reversion(r, past):
    if not fine(r.rsi14, r.bb_up, r.bb_mid):
        return 0, 0
    half = r.bb_up - r.bb_mid
    z = (r.c - r.bb_mid) / half if half else 0
    boost = 0.5 if not fine(r.adx14) else 1.0 if r.adx14 < 20 else 0.7 if r.adx14 < 25 else 0.4 if r.adx14 < 30 else 0.15
    if z <= -1 and r.rsi14 < 35:
        return (0.4 + 0.4 * min(1, -z - 1) + 0.2 * max(0, (35 - r.rsi14) / 35)) * boost, min(1, 0.4 + 0.3 * (abs(z) - 1) + 0.3 * boost)
    if z >= 1 and r.rsi14 > 65:
        return -(0.4 + 0.4 * min(1, z - 1) + 0.2 * max(0, (r.rsi14 - 65) / 35)) * boost, min(1, 0.4 + 0.3 * (z - 1) + 0.3 * boost)
    if r.rsi14 < 30:
        return 0.15 * boost, 0.15
    return (-0.15 * boost, 0.15) if r.rsi14 > 70 else (0, 0.05)


def momentum(r, past):
    before, earlier = (past[-k].macd_hist if len(past) >= k else None for k in (1, 2))
    if not fine(r.macd_hist, before):
        return 0, 0
    side, toward = sign(r.macd_hist), -1 if r.macd_hist < 0 else 1
    size = min(1, abs(r.macd_hist) / r.c * 2000) if r.c > 0 else 0
    grows = (r.macd_hist - before) * toward > 0
    twice = grows and fine(earlier) and (before - earlier) * toward > 0
    drift = sign(r.roc10) if fine(r.roc10) else 0
    agree = 0.3 if drift == side else 0 if drift == 0 else -0.2
    return side * (0.3 + 0.7 * size) + side * (0.4 if grows else -0.1) + side * agree, 0.5 * size + 0.25 * grows + 0.1 * twice + 0.15 * (drift == side)


def breakout(r, past):
    if r.break_age is None:
        return 0, 0
    if r.break_age > 10:
        return 0, 0.05
    rel = r.break_volume if fine(r.break_volume) else 1
    crowd = 0.3 if rel >= 2 else 0.2 if rel >= 1.5 else 0.1 if rel >= 1.2 else 0
    fresh = 0.25 if r.break_age <= 2 else 0.15 if r.break_age <= 5 else 0.05
    base = 0.4 if r.break_type == "CHoCH" else 0.5
    return r.break_side * min(1, base + crowd + fresh), min(1, base + crowd + 0.8 * fresh)


def volatility(r, past):
    if not fine(r.bb_width):
        return 0, 0
    widths = [x.bb_width for x in [*past[-49:], r] if fine(x.bb_width)]
    mean = sum(widths) / len(widths)
    side = sign(r.macd_hist) if fine(r.macd_hist) else 0
    if len(widths) >= 2 and r.bb_width < 0.7 * mean:
        return 0.25 * side, 0.3 if side else 0.1
    return (0, 0.1) if len(widths) >= 2 and r.bb_width > 1.3 * mean else (0, 0.15)


def volume(r, past):
    then = past[-20].obv if len(past) >= 20 else None
    slope = (r.obv - then) / abs(then) if fine(then) and abs(then) > 1 else 0
    flow = r.cmf20 if fine(r.cmf20) else 0
    obv, cmf = ((x > least) - (x < -least) for x, least in ((slope, 0.005), (flow, 0.05)))
    usual = [x.v for x in past[-20:]]
    surge = bool(usual) and sum(usual) > 0 and r.v >= 1.5 * sum(usual) / len(usual)
    agree = obv != 0 and obv == cmf
    strength = max(min(1, 2 * abs(flow)), min(1, 10 * abs(slope)))
    return (obv or cmf) * (0.3 + 0.5 * strength + 0.1 * surge + 0.1 * agree), 0.25 + 0.35 * strength + 0.2 * agree + 0.1 * surge


def candles(r, past):
    if r.shape_age is None:
        return 0, 0
    if r.shape_age > 3:
        return 0, 0.05
    best, side = 0, 0
    for names, way, against in ((M.RISING, 1, "down"), (M.FALLING, -1, "up")):
        if set(names) & set(r.shape_names):
            score = 0.7 if r.trend == against else 0.45 if r.trend == "range" else 0.25
            if score > best:
                best, side = score, way
    if not side:
        return 0, 0
    fresh = 0.15 if r.shape_age == 0 else 0.08 if r.shape_age == 1 else 0
    return side * min(1, best + fresh), min(1, 0.9 * best + fresh)


def session(r, past):
    hour = r.t // 3_600_000 % 24
    return 0, 0.2 if hour >= 22 or hour < 2 or 15 <= hour < 16 else 0.25 if 7 <= hour < 10 or 12 <= hour < 15 else 0.1


REPLAYS = {"trend-follow": trend_follow, "mean-reversion": mean_reversion, "momentum": momentum, "breakout": breakout, "volatility-regime": volatility, "volume-profile": volume, "candle-patterns": candles, "session-calendar": session}


@pytest.fixture(scope="module")
def series(spark, sf_dir):
    df = M.orchestrate(M.module_signals(M.prepared(lineitem_bars(spark, sf_dir)))).withColumn("exit", F.lead("c", 5).over(in_order()))
    out: dict = {}
    for r in df.orderBy("t").collect():
        out.setdefault(r.symbol, []).append(r)
    return out


@pytest.mark.parametrize("name", sorted(M.MODULES))
def test_a_module_says_what_its_rule_says(series, name):
    said = 0
    for rows in series.values():
        for k, r in enumerate(rows):
            s, c = REPLAYS[name](r, rows[max(0, k - 60) : k])
            s, c = max(-1, min(1, s)), max(0, min(1, c))
            assert (r[f"s_{name}"], r[f"c_{name}"]) == (pytest.approx(s, abs=1e-9), pytest.approx(c, abs=1e-9)), (r.symbol, r.t)
            said += s != 0
    assert said > 20 or name == "session-calendar"


def test_the_score_joins_the_modules(series):
    for rows in series.values():
        for r in rows:
            hour = r.t // 3_600_000 % 24
            factor = 1.1 if 7 <= hour < 10 or 12 <= hour < 15 else 1.0 if hour >= 22 or hour < 2 or 15 <= hour < 16 else 0.6
            total = weight = conf = n = 0
            for name, (w, _) in M.MODULES.items():
                s, c = r[f"s_{name}"], r[f"c_{name}"]
                c = c if name == "session-calendar" else min(1, c * factor)
                if not (c < 0.05 and abs(s) < 0.1):
                    total, weight, conf, n = total + s * c * w, weight + w, conf + c, n + 1
            score = total / weight if weight else 0
            p = 1 / (1 + math.exp(-3 * score))
            assert r.score == pytest.approx(score, abs=1e-9) and r.probability == pytest.approx(p, abs=1e-9) and r.participating == n and r.confidence == pytest.approx(conf / n if n else 0, abs=1e-9)
            assert r.direction == ("long" if p > 0.55 else "short" if p < 0.45 else "neutral")


def test_the_backtest_trades_the_directions(spark, sf_dir, series):
    got = {r.symbol: r for r in M.backtest_metrics(M.backtest(M.orchestrate(M.module_signals(M.prepared(lineitem_bars(spark, sf_dir)))))).collect()}
    for symbol, rows in series.items():
        pnl = [(1 if r.direction == "long" else -1) * (r.exit / r.c - 1) for k, r in enumerate(rows) if k >= 200 and r.direction != "neutral" and r.exit is not None and r.c]
        if not pnl:
            assert symbol not in got
            continue
        equity, peak, fall = 1.0, 1.0, 0.0
        for x in pnl:
            equity *= max(1e-12, 1 + x)
            peak = max(peak, equity)
            fall = max(fall, 1 - equity / peak)
        m = got[symbol]
        assert m.n == len(pnl) and m.hit_rate == pytest.approx(sum(x > 0 for x in pnl) / len(pnl)) and m.best == pytest.approx(max(pnl)) and m.worst == pytest.approx(min(pnl))
        assert m.total_return == pytest.approx(equity - 1, rel=1e-6, abs=1e-9) and m.max_drawdown == pytest.approx(fall, rel=1e-6, abs=1e-9)
        lost = -sum(x for x in pnl if x < 0)
        assert (m.profit_factor is None) if not lost else m.profit_factor == pytest.approx(sum(x for x in pnl if x > 0) / lost)
