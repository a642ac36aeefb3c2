"""Small inputs with known answers."""

import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barquet.functions.series import STEP_MS
from barquet.operators import cleaning, indicators, learning, news, predictions, profile, reports, scoring, statistics, structure
from barquet.sources import bars as B
from barquet.sources import files
from barquet.streaming import live

DAY = 86_400_000
T0 = 1_700_006_400_000


def bars(spark, rows, symbol="A", tf="1d"):
    """rows: (o, h, l, c) or (o, h, l, c, v)."""
    return spark.createDataFrame([(symbol, tf, T0 + k * DAY, *map(float, (*r, 1)[:5])) for k, r in enumerate(rows)], "symbol string, tf string, t long, o double, h double, l double, c double, v double")


def closes(spark, xs, **k):
    return bars(spark, [(x, x, x, x) for x in xs], **k)


def column(df, name):
    return [r[name] for r in df.orderBy("t").select(name).collect()]


def test_averages_begin_when_full(spark):
    df = closes(spark, [1, 2, 3, 4, 5])
    out = df.withColumns({"sma": indicators.sma(3), "wma": indicators.wma(3)})
    assert column(out, "sma") == [None, None, 2, 3, 4]
    assert column(out, "wma")[2] == pytest.approx(14 / 6)
    assert list(indicators.ema(np.array([1.0, 2, 3, 4, 5]), 3)[2:]) == [2, 3, 4]


@pytest.mark.parametrize("xs, rsi", [(list(range(1, 31)), 100.0), ([5] * 30, 100.0), (list(range(30, 0, -1)), 0.0)])
def test_rsi_extremes(spark, xs, rsi):
    got = column(indicators.recursive(closes(spark, xs)), "rsi14")
    assert got[:14] == [None] * 14 and got[14:] == [rsi] * 16


def test_recursive_warm_up(spark):
    r = random.Random(1)
    x = [100.0]
    for _ in range(259):
        x.append(x[-1] * math.exp(r.gauss(0, 0.01)))
    out = indicators.recursive(bars(spark, [(a, a * 1.01, a * 0.99, a) for a in x])).orderBy("t").toPandas()
    first = {k: int(out[k].notna().to_numpy().argmax()) for k in ("ema20", "ema200", "macd", "macd_signal", "atr14", "plus_di", "adx14", "dema20", "tema20", "psar")}
    assert first == {"ema20": 19, "ema200": 199, "macd": 25, "macd_signal": 33, "atr14": 14, "plus_di": 14, "adx14": 27, "dema20": 38, "tema20": 57, "psar": 0}


def test_gaps_and_their_touch(spark):
    rows = [(100, 101, 99, 100), (101, 103, 100, 102), (103, 104, 102, 104), (104, 105, 103, 104), (103, 104, 101.5, 102)]
    df = bars(spark, rows)
    zone = structure.zone_mitigation(structure.fvg_zones(df), df).orderBy("i").first()
    assert (zone.kind, zone.i, zone.top, zone.bottom, zone.mitigated_i) == ("bull", 2, 102, 101, 4)


def test_pivots_and_breaks(spark):
    df = closes(spark, [1, 2, 3, 4, 5, 4, 3, 2, 3, 4, 5, 6, 7, 6, 5, 6])
    piv = structure.pivots(df)
    assert [(r.i, r.kind, r["class"]) for r in piv.orderBy("i").collect()] == [(4, "high", "H"), (7, "low", "L"), (12, "high", "HH")]
    b = structure.structure_breaks(df, piv).orderBy("i").first()
    assert (b.i, b.type, b.dir, b.level) == (11, "BoS", "up", 5)


def test_candle_shapes(spark):
    got = {r.t: r.patterns for r in structure.candle_patterns(bars(spark, [(10, 11, 9, 10.01), (10, 10.6, 7, 10.5), (10.5, 12, 10.4, 10), (9.9, 13, 9.8, 12)])).collect()}
    assert "doji" in got[T0] and "hammer" in got[T0 + DAY] and "bullEngulf" in got[T0 + 3 * DAY]


def test_sessions():
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    hours = spark.range(24).select("id", structure.session_of(F.col("id") * 3_600_000).alias("s")).collect()
    assert [r.s for r in hours] == ["asia"] * 2 + ["off-hours"] * 5 + ["london"] * 3 + ["off-hours"] * 2 + ["ny-am"] * 3 + ["ny-pm"] + ["off-hours"] * 6 + ["asia"] * 2


def test_levels_chain_and_cluster(spark):
    p = spark.createDataFrame([("A", "1d", i, i, float(x), k) for i, (x, k) in enumerate([(100, "high"), (100.3, "low"), (99.8, "high"), (95, "low"), (95.2, "low"), (120, "high")])], "symbol string, tf string, i long, t long, price double, kind string")
    tol = spark.createDataFrame([("A", "1d", 0.5)], "symbol string, tf string, tolerance double")
    sr = {round(r.price, 2): (r.touches, r.kind) for r in structure.sr_levels(p, tol).collect()}
    assert sr == {100.0: (3, "both"), 95.1: (2, "support"), 120.0: (1, "resistance")}
    levels = {(r.kind, round(r.price, 2)): r.touches for r in structure.liquidity_levels(p, tol).collect()}
    assert levels == {("high", 99.9): 2, ("low", 95.1): 2}


def test_validation_reasons(spark):
    good = (10.0, 11.0, 9.0, 10.0, 1.0)
    cases = {None: (T0, *good), "bad-o": (T0, "bad", *good[1:]), "overflow": (T0, *good[:4], 1e20), "neg-volume": (T0, *good[:4], -1.0), "h<max": (T0, 10.0, 9.5, 9.0, 10.0, 1.0), "l>min": (T0, 10.0, 11.0, 10.5, 10.0, 1.0), "t-too-old": (0, *good), "t-in-future": (T0 + 400 * DAY, *good), "t-not-aligned": (T0 + DAY // 2, *good), "non-positive-price": (T0, 10.0, 11.0, 0.0, 10.0, 1.0)}
    rows = [("A", "1d", t, *map(str, x)) for t, *x in cases.values()]
    got = [r.reason for r in cleaning.validate(spark.createDataFrame(rows, "symbol string, tf string, t long, o string, h string, l string, c string, v string"), T0 + DAY).collect()]
    assert got == list(cases)


def test_upsert_and_gaps(spark):
    old, new = closes(spark, [1, 2, 3]), closes(spark, [9, 8]).filter(F.col("t") == T0)
    assert column(cleaning.upsert(old, new, ["symbol", "tf", "t"]), "c") == [9, 2, 3]
    holes = closes(spark, range(10)).filter(~F.col("t").isin(T0 + 3 * DAY, T0 + 4 * DAY, T0 + 7 * DAY))
    assert sorted(r.missing for r in cleaning.gaps(holes).collect()) == [1, 2] and cleaning.missing_bars(holes).count() == 3


def test_triple_barrier(spark):
    up = closes(spark, [100, 101, 102, 103, 104, 105]).withColumn("sigma", F.lit(1.0))
    r = statistics.triple_barrier(up, horizon=3).orderBy("t").first()
    assert (r.side, r.touched, r.t1, r.ret) == (1, "upper", 2, pytest.approx(0.02))
    flat = closes(spark, [100] * 6).withColumn("sigma", F.lit(1.0))
    assert [x.touched for x in statistics.triple_barrier(flat, horizon=3).collect()] == ["time"] * 6
    both = bars(spark, [(100, 100, 100, 100), (100, 110, 90, 100)]).withColumn("sigma", F.lit(1.0))
    assert statistics.triple_barrier(both, horizon=3).orderBy("t").first().touched == "upper"


def test_conformal_coverage(spark):
    r = np.random.default_rng(42)
    y, noise = r.normal(size=1000), r.normal(size=1000)
    df = spark.createDataFrame([("g", k, float(a), float(a + b)) for k, (a, b) in enumerate(zip(y, noise, strict=True))], "g string, k int, yhat double, y double")
    q = statistics.conformal_quantiles(df.filter("k < 500").withColumn("score", F.abs(F.col("y") - F.col("yhat"))), ["g"]).drop("n")
    test = df.filter("k >= 500").join(q, "g").select("g", "y", (F.col("yhat") - F.col("q")).alias("lo"), (F.col("yhat") + F.col("q")).alias("hi"))
    assert 0.85 <= statistics.coverage(test, ["g"]).first().coverage <= 0.96
    few = statistics.conformal_quantiles(df.filter("k < 3").withColumn("score", F.col("y")), ["g"]).first()
    assert few.q == float("inf")


def test_drift_detectors():
    r = random.Random(0)
    adwin = predictions.Adwin()
    assert not any(adwin.push(r.gauss(0, 0.1)) for _ in range(300))
    assert any(adwin.push(r.gauss(1, 0.1)) for _ in range(100)) and len(adwin.values) < 150
    ph = predictions.PageHinkley(threshold=1.0)
    assert not any(ph.push(0.5) for _ in range(200))
    assert "up" in [ph.push(0.9) for _ in range(50)]


def test_verdicts(spark):
    df = bars(spark, [(100, 101, 99, 100), (100, 103, 99, 102)])
    shape = "symbol string, tf string, t long, kind string, dir string, prob double, yhat double, sigma double, lo double, hi double, classes array<string>"
    base = ("A", "1d", T0)
    rows = [(*base, "direction", "up", 0.6, None, None, None, None, None), (*base, "return", None, None, 0.01, 0.01, None, None, None), (*base, "interval", None, None, None, None, 0.0, 0.01, None), (*base, "set", None, None, None, None, None, None, ["long"]), ("A", "1d", T0 + DAY, "direction", "up", None, None, None, None, None, None), (*base, "interval", None, None, None, None, 1.0, 0.0, None)]
    got = predictions.validate_predictions(spark.createDataFrame(rows, shape), df).collect()
    d, ret, inter, sets, later, bad = sorted(got, key=lambda r: (r.missing, not r.ok, ["direction", "return", "interval", "set"].index(r.kind)))[:4] + [r for r in got if r.missing] + [r for r in got if not r.missing and not r.ok]
    assert d.hit and d.brier == pytest.approx(0.16) and ret.residual == pytest.approx(0.01) and ret.z == pytest.approx(1.0)
    assert inter.covered is False and sets.covered is True and later.missing and not bad.ok


def test_profile(spark):
    df = bars(spark, [(10, 20, 10, 15, 1), (15, 15, 15, 15, 50), (19, 19, 19, 19, 2), (11, 11, 11, 11, 5)])
    b = profile.profile_buckets(df, 10).orderBy("bucket").toPandas()
    assert len(b) == 10 and b["total"].sum() == 58 and int(b["total"].to_numpy().argmax()) == 5
    p = profile.volume_profile(df, 10).first()
    assert p.poc == pytest.approx(15.5) and p.val <= p.poc <= p.vah


def test_scores_scan_backtest(spark):
    r = random.Random(3)
    frames = []
    for name, drift in (("UP", 0.004), ("DOWN", -0.004), ("FLAT", 0.0)):
        x = [100.0]
        for _ in range(299):
            x.append(x[-1] * math.exp(drift + r.gauss(0, 0.005)))
        frames.append(bars(spark, [(a, a * 1.004, a * 0.996, b, 10) for a, b in zip(x, x[1:], strict=False)], symbol=name))
    df = frames[0].unionByName(frames[1]).unionByName(frames[2]).unionByName(closes(spark, [1, 2, 3], symbol="SHORT"))
    got = {x.symbol: x for x in scoring.scan(df).collect()}
    assert got["UP"].direction == "long" and got["DOWN"].direction == "short" and got["SHORT"].status == "no-data"
    scored = scoring.orchestrate(scoring.module_signals(scoring.prepared(df)))
    m = {x.symbol: x for x in scoring.backtest_metrics(scoring.backtest(scored)).collect()}
    assert m["UP"].hit_rate > 0.8 and m["UP"].total_return > 0 and 0 <= m["UP"].max_drawdown < 1
    past = df.filter(F.col("t") <= T0 + 250 * DAY)
    a = scored.filter((F.col("symbol") == "UP") & (F.col("t") == T0 + 250 * DAY)).first().score
    b = scoring.orchestrate(scoring.module_signals(scoring.prepared(past))).filter((F.col("symbol") == "UP") & (F.col("t") == T0 + 250 * DAY)).first().score
    assert a == pytest.approx(b)  # a bar's score knows nothing of later bars


def test_news(spark):
    rows = [("1", "Breaking: missile strike, BTC and $SOL plunge", "war fears", "Reuters"), ("2", "<b>Fed</b> rate cut &amp; rally", None, "x"), ("3", "Fails to also rally", "", None)]
    got = {r.guid: r for r in news.annotate(spark.createDataFrame([(g, t, s, src) for g, t, s, src in rows], "guid string, title string, summary string, source string"), {"rally": 1.5, "plunge": -2.0}).collect()}
    assert got["1"].primary == "WAR" and got["1"].high_impact and set(got["1"].symbols) == {"SOL", "BTC"}
    assert got["1"].label == "bearish" and got["1"].sentiment < 0
    assert got["2"].title == "Fed rate cut & rally" and got["2"].primary == "FED" and got["2"].sentiment > 0
    assert got["3"].sentiment < 0


def test_files(spark, tmp_path):
    (tmp_path / "k.json").write_text(json.dumps([[T0, "1", "2", "0.5", "1.5", "10", 0], [T0 + DAY, "x", "2", "1", "2", "3", 0]]))
    assert [tuple(r)[2:] for r in files.read_klines(spark, str(tmp_path / "k.json"), "A", "1d").collect()] == [(T0, 1.0, 2.0, 0.5, 1.5, 10.0)]
    (tmp_path / "b.json").write_text(json.dumps({"result": {"list": [[str(T0), "1", "2", "0.5", "1.5", "10"]]}}))
    assert files.read_klines(spark, str(tmp_path / "b.json"), "A", "1d", "bybit").count() == 1
    (tmp_path / "d.csv").write_text("Date,Open,High,Low,Close,Volume\n2024-01-02,1,2,0.5,1.5,\nbad,1,2,3,4,5\n")
    assert [(r.t, r.v) for r in files.read_daily_csv(spark, str(tmp_path / "d.csv"), "A").collect()] == [(1704153600000, 0.0)]
    (tmp_path / "c.json").write_text(json.dumps({"chart": {"result": [{"timestamp": [10, 20], "indicators": {"quote": [{"open": [1, None], "high": [2, 2], "low": [1, 1], "close": [1, 1], "volume": [None, 3]}]}}]}}))
    assert [(r.t, r.v) for r in files.read_chart_json(spark, str(tmp_path / "c.json"), "A").collect()] == [(10_000, 0.0)]
    (tmp_path / "u.json").write_text(json.dumps({"symbols": [{"symbol": "BTCUSDT", "status": "TRADING", "baseAsset": "BTC", "quoteAsset": "USDT", "isSpotTradingAllowed": True}, {"symbol": "OLD", "status": "BREAK"}]}))
    u = files.read_universe(spark, str(tmp_path / "u.json"))
    assert [r.id for r in u.collect()] == ["BTCUSDT"] and files.search_universe(u, "btc").count() == 1
    (tmp_path / "r.xml").write_text("<rss><channel><item><title>A</title><link>l</link></item><item><title> </title></item></channel></rss>")
    assert [(r.guid, r.title) for r in news.read_rss(spark, str(tmp_path / "r.xml")).collect()] == [("l", "A")]
    B.write_bars(closes(spark, range(10)).withColumn("closed", F.lit(True)), str(tmp_path / "bars"))
    assert B.read_bars(spark, str(tmp_path / "bars"), "A", "1d", T0 + 2 * DAY, T0 + 4 * DAY).count() == 3


def test_learning(spark):
    r = random.Random(5)
    rows = [("S", "1d", k, (x := r.uniform(-1, 1)), int(r.random() < 1 / (1 + math.exp(-3 * x)))) for k in range(600)]
    df = spark.createDataFrame(rows, "symbol string, tf string, t long, score double, y int")
    model = learning.fit_platt(df)
    assert model.coefficients[0] == pytest.approx(3, abs=0.8)
    p = learning.apply_isotonic(learning.fit_isotonic(df), df).orderBy("score").toPandas()["p"]
    assert p.is_monotonic_increasing
    weights = {x.module: x for x in learning.adaptive_weights(spark.createDataFrame([("a", k, 1) for k in range(50)] + [("b", k, 0) for k in range(50)], "module string, t long, hit int")).collect()}
    ewma = 0.5
    for _ in range(50):
        ewma += 0.05 * (1 - ewma)
    assert weights["a"].rate == pytest.approx(ewma) and weights["a"].weight + weights["b"].weight == pytest.approx(1)
    x = df.withColumns({"regime": F.when(F.col("score") > 0, "up").otherwise("down"), "f": F.col("score") * 2})
    models = learning.train_per_regime(x, ["score", "f"], layers=(4,))
    assert set(models) == {None, "up", "down"}
    out = learning.predict_per_regime(models, x, ["score", "f"])
    assert out.filter("p is null or p < 0 or p > 1").count() == 0


def test_order_of_closes():
    step = STEP_MS["1m"]
    rows = [(k * step, float(k)) for k in (3, 1, 2, 2)]
    out, last = live.order_closes(rows, None, {}, step)
    assert [x[1] // step for x in out] == [1, 2, 3] and last == 3 * step
    pending = {}
    out, last = live.order_closes([(5 * step, 5.0)], last, pending, step)
    assert not out and pending  # one missing bar is waited for
    out, last = live.order_closes([(4 * step, 4.0), (2 * step, 2.0)], last, pending, step)
    assert [x[1] // step for x in out] == [4, 5] and not pending
    out, last = live.order_closes([(9 * step, 9.0)], last, pending, step)
    assert [(k, a // step, b // step) for k, a, b, _ in out] == [("gap", 6, 8), ("bar", 9, 9)]


def test_streams(spark, tmp_path):
    minute = STEP_MS["1m"]
    for n, own in enumerate(([3, 1, 2], [5, 4, 4], [9])):
        pd.DataFrame({"symbol": "A", "tf": "1m", "t": [T0 + k * minute for k in own], "o": 1.0, "h": 9.0, "l": 1.0, "c": [float(k) for k in own], "v": 1.0}).to_parquet(tmp_path / f"{n}.parquet")
    source = lambda: spark.readStream.schema("symbol string, tf string, t long, o double, h double, l double, c double, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))

    def rows(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    closed = rows(live.reorder_and_gaps(source()), "closed")
    assert [(r.kind, (r.from_t - T0) // minute) for r in sorted(closed, key=lambda r: r.from_t)] == [("bar", 1), ("bar", 2), ("bar", 3), ("bar", 4), ("bar", 5), ("gap", 6), ("bar", 9)]
    once = rows(live.stream_bars(source(), T0 + DAY), "once")
    assert sorted((r.t - T0) // minute for r in once) == [1, 2, 3, 4, 5, 9]
    ticks = source().select("symbol", F.timestamp_millis("t").alias("ts"), F.col("c").alias("price"), F.col("v").alias("size"))
    formed = rows(live.form_bars(ticks, "5m", "1 minute"), "formed")
    assert [(r.o, r.h, r.v) for r in sorted(formed, key=lambda r: r.t)][0] == (1.0, 4.0, 5.0)


def test_committed_states(spark):
    """Three bars of another state commit it; shorter runs, and a return, don't."""
    states = ["a", "b", "b", "a", "b", "b", "b", "b", "a", "a", "c", "c", "c", "a", "a", "a"]
    df = spark.createDataFrame([("S", "1d", T0 + k * DAY, x) for k, x in enumerate(states)], "symbol string, tf string, t long, x string")
    got = reports.committed_states(df, F.col("x")).orderBy("t").collect()
    current, pending, count, want = None, None, 0, []
    for x in states:
        if current is None:
            current = x
        elif x == current:
            pending, count = None, 0
        else:
            pending, count = x, count + 1 if pending == x else 1
            if count >= 3:
                current, pending, count = x, None, 0
        want.append(current)
    assert [r.committed for r in got] == want
    assert [r.changed for r in got] == [k == 0 or want[k] != want[k - 1] for k in range(len(want))]
    assert got[5].dwell == 5 and got[6].dwell == 0 and got[7].dwell == 1


def test_reports(spark):
    f = spark.createDataFrame([("S", "1d", k, k != 3, float(k), 1.0) for k in range(4)], "symbol string, tf string, t long, valid boolean, x double, y double")
    got = {r.name: r for r in reports.latest_feature_z(f, ["x", "y"]).collect()}
    assert got["x"].t == 2 and got["x"].raw == 2.0 and got["x"].z == 1.0 and got["y"].z == 0.0
    s = spark.createDataFrame([("S", "1d", 1, 0.5, 0.5, -1.0, 1.0, None, None)], "symbol string, tf string, t long, s_a double, c_a double, `s_b-c` double, `c_b-c` double, s_d double, c_d double")
    assert [(r["rank"], r.module, r.signal) for r in reports.top_modules(s, ["a", "b-c", "d"], 2).orderBy("rank").collect()] == [(1, "b-c", -1.0), (2, "a", 0.5)]
    times = spark.createDataFrame([("A", 1000), ("B", 1000), ("A", 90_000)], "symbol string, t long")
    cal = spark.createDataFrame([(1, 900, 50, 2.0, ["A"]), (2, 1000, None, 3.0, None), (3, 1900, None, 0.5, None)], "id long, at long, duration_ms long, impact double, symbols array<string>")
    got = sorted((r.symbol, r.event_id, r.phase, r["rank"]) for r in reports.events_near(times, cal, 1000, 1.0).collect())
    assert got == [("A", 1, "after", 2), ("A", 2, "during", 1), ("B", 2, "during", 1)]
    letters = spark.createDataFrame([(k,) for k in (0, 25, 26, 701)], "i long").select(reports.tpo_letter(F.col("i")).alias("x")).collect()
    assert [r.x for r in letters] == ["A", "Z", "AA", "ZZ"]


def test_equal_rows_stay_as_many(spark):
    bars = spark.createDataFrame([("A", "1h", 0)] * 2 + [("A", "1h", 10**9)], "symbol string, tf string, t long")
    cal = spark.createDataFrame([(7, 1000, 0, 1.0)], "id long, at long, duration_ms long, impact double")
    got = [(r.t, r.event_id, r.phase) for r in predictions.tag_events(bars, cal).collect()]
    assert got.count((0, 7, "pre")) == 2 and (10**9, None, None) in got and len(got) == 3
    left = spark.createDataFrame([("A", 5)] * 2, "symbol string, t long")
    right = spark.createDataFrame([("A", 4, 1), ("A", 6, 2)], "symbol string, t long, id long")
    assert [(r.near_t, r.near_id) for r in predictions.nearest_in_time(left, right, ["symbol"], 10, ["id"]).collect()] == [(6, 2)] * 2
