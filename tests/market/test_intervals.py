"""Reusable intervals and sets, zones of stops, and the scores of regimes."""

import math

import pytest

from barquet.operators import features, indicators, statistics, structure


def test_normalized_intervals_scale_with_sigma(spark):
    calibration = spark.createDataFrame([("a", 0.0, float(k), 2.0) for k in range(1, 20)] + [("a", 0.0, None, 1.0), ("a", 0.0, float("nan"), 1.0), ("b", 1.0, 2.0, 0.0)], "g string, yhat double, y double, sigma double")
    plain = {r.g: (r.n, r.q) for r in statistics.fit_conformal(calibration, ["g"]).collect()}
    scaled = statistics.fit_conformal(calibration, ["g"], True)
    assert plain == {"a": (19, 18.0), "b": (1, math.inf)} and {r.g: r.q for r in scaled.collect()} == {"a": 9.0, "b": math.inf}
    asked = spark.createDataFrame([("a", 5.0, 0.5), ("a", 5.0, None), ("c", 5.0, 1.0)], "g string, yhat double, sigma double")
    got = sorted(statistics.conformal_interval(asked, scaled, ["g"], True).collect(), key=lambda r: r.width)
    assert [r.width for r in got] == pytest.approx([1.8e-7, 9.0, math.inf]) and (got[1].lo, got[1].hi) == (0.5, 9.5)
    flat = statistics.conformal_interval(asked.limit(1), statistics.fit_conformal(calibration.filter("g = 'a'"), []), [])
    assert [(r.lo, r.hi) for r in flat.collect()] == [(-13.0, 23.0)]


def test_prediction_sets_have_four_outcomes(spark):
    calibration = spark.createDataFrame([(0.9, 1), (0.2, 0), (0.7, 1), (0.4, 0), (0.3, 2), (None, 1)], "p double, y int").selectExpr("'k' as g", "*")
    fitted = statistics.fit_prediction_set(calibration, ["g"], 0.4)
    r = fitted.first()
    assert r.n == 4 and r.q == pytest.approx(0.3)
    rows = spark.createDataFrame([("k", p) for p in (0.95, 0.1, 0.5)], "g string, p double")
    assert {x.p: x.direction for x in features.prediction_sets(rows, fitted, ["g"]).collect()} == {0.95: "long", 0.1: "short", 0.5: "abstain"}
    wide = spark.createDataFrame([("k", 4, 0.6)], "g string, n long, q double")
    assert features.prediction_sets(rows.filter("p = 0.5"), wide, ["g"]).first().direction == "uncertain"


def test_zones_come_from_pools_and_true_ranges(spark):
    pools = spark.createDataFrame([("A", "1h", "high", 100.0 + k, 2 + k % 3) for k in range(8)] + [("A", "1h", "low", 90.0, 4)], "symbol string, tf string, kind string, price double, touches int")
    last = spark.createDataFrame([("A", "1h", 95.0, 2.0), ("B", "1h", 10.0, None)], "symbol string, tf string, c double, atr14 double")
    got = structure.liquidation_zones(pools, last).collect()
    assert len(got) == 6 + 1 + 6 and {r.symbol for r in got} == {"A"}
    assert {(r.side, r.price, round(r.score, 4)) for r in got if r.atr} == {("long", 93.0, 1.0), ("long", 91.0, 0.5), ("long", 89.0, 0.3333), ("short", 97.0, 1.0), ("short", 99.0, 0.5), ("short", 101.0, 0.3333)}
    assert sorted(r.price for r in got if r.atr is None and r.side == "long") == [100.0, 101.0, 102.0, 104.0, 105.0, 107.0]


def test_regime_scores_follow_what_decided_the_trend(spark):
    names = "c, adx14, plus_di, minus_di, atr14, bb_width, ema20, ema50, ema200, macd_hist, rsi14, shape, break_side, break_age"
    rows = [
        (100.0, 30.0, 30.0, 10.0, 1.0, None, 3.0, 2.0, 1.0, 0.0, 50.0, "down", 1, 4), (100.0, 10.0, 30.0, 10.0, 0.3, None, 3.0, 2.0, 1.0, 0.0, 50.0, "down", -1, 10),
        (100.0, 10.0, 30.0, 10.0, None, 0.05, 3.0, 2.0, 1.0, 0.0, 50.0, "range", -1, 11), (100.0, None, None, None, None, None, None, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {'string' if n == 'shape' else 'int' if 'break' in n else 'double'}" for n in names.split(", ")))
    got = indicators.regime_scores(indicators.classify_regime(df, "shape"), "shape").collect()
    assert [(r.trend, round(r.trend_score, 6), r.breakout) for r in got] == [("up", 0.5, "up"), ("down", -0.4, "down"), ("up", 0.3, "none"), ("range", 0.0, "none")]
    assert [round(r.vol_score, 6) for r in got] == [round((0.01 - 0.003) / 0.017, 6), 0.0, 0.5, 0.0]


def test_what_is_not_known_stays_unknown(spark):
    from pyspark.sql import functions as F

    from barquet.functions.series import clamp
    from barquet.operators import reports

    df = spark.createDataFrame([(None,), (5.0,), (-5.0,), (0.5,)], "x double").select("x", clamp(F.col("x"), -1, 1).alias("y"))
    assert {r.x: r.y for r in df.collect()} == {None: None, 5.0: 1.0, -5.0: -1.0, 0.5: 0.5}
    hits = spark.createDataFrame([("A", "1d", 1, ["doji"]), ("B", "1d", 1, ["hammer"])], "symbol string, tf string, t long, patterns array<string>")
    assert {r.symbol: r.bias for r in reports.pattern_bias(hits).collect()} == {"A": 0.0, "B": 1.0}
    bars = spark.createDataFrame([(100.0, None, None, None, None, None, None, None, None, None, None)], ", ".join(f"{c} double" for c in "c adx14 plus_di minus_di atr14 bb_width ema20 ema50 ema200 macd_hist rsi14".split()))
    r = indicators.classify_regime(bars).first()
    assert (r.momentum, r.momentum_score) == ("flat", 0.0)
