"""Small rules: vetoes, drift of a champion, letters of a profile, channels, kept rows, mistakes with context, listings."""

import pytest

from barquet.operators import cleaning, learning, predictions, profile, scoring, statistics, structure
from barquet.sources import files
from barquet.streaming import live

DAY = 86_400_000


def test_meta_veto(spark):
    rows = [(True, 0.2, 0.8, 0.6, "long"), (True, 0.4, 0.8, 0.6, "long"), (True, 0.3, 0.8, 0.1, "short"), (True, 0.5, 0.8, 0.6, "long"), (False, 0.1, 0.8, 0.6, "long"), (None, None, 0.8, 0.6, "long")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, in_radius boolean, hit_rate double, confidence double, signal double, direction string")
    got = [(r.action, r.confidence, round(r.signal, 9), r.direction) for r in learning.meta_veto(df).orderBy("k").collect()]
    assert got == [("veto", 0.0, 0.0, "neutral"), ("soften", 0.4, 0.24, "long"), ("soften", 0.4, 0.04, "neutral"), *[("pass", 0.8, 0.6, "long")] * 3]
    assert [r.confidence for r in learning.meta_veto(df.drop("signal", "direction")).orderBy("k").collect()] == [0.0, 0.4, 0.4, 0.8, 0.8, 0.8]


def test_champion_drift(spark):
    hits = [k % 3 != 0 if k < 60 else k % 4 == 0 for k in range(90)]
    df = spark.createDataFrame([(k, h) for k, h in enumerate(hits)] + [(1000, None)], "t long, hit boolean")
    own = hits[-50:]
    ewma = float(own[0])
    for h in own[1:]:
        ewma = 0.9 * ewma + 0.1 * h
    r = learning.champion_drift(df, 0.6).first()
    assert r.n == 50 and r.ewma == pytest.approx(ewma) and r.drifted == (ewma < 0.5) and r.drifted
    few = learning.champion_drift(df.filter("t < 19"), 0.6).first()
    assert (few.n, few.ewma, few.drifted) == (19, None, False)
    assert learning.champion_drift(df.limit(0), 0.6).first().n == 0


def test_letters_and_session_of_a_profile(spark):
    bars = spark.createDataFrame([("A", "1h", k, 10.0, 12.0 + k % 2, 8.0, 9.0 + k % 4, 1.0) for k in range(30)], "symbol string, tf string, t long, o double, h double, l double, c double, v double")
    rows = profile.profile_buckets(bars, 4, 28).orderBy("bucket").collect()
    names = [chr(65 + k) if k < 26 else "A" + chr(65 + k - 26) for k in range(28)]
    seen = sorted((x for r in rows for x in r.tpo), key=names.index)
    assert seen == names and all(r.total == len(r.tpo) and r.tpo == sorted(r.tpo, key=names.index) for r in rows)
    for r in rows:
        for x in r.tpo:
            k = 2 + names.index(x)
            tp = (12.0 + k % 2 + 8.0 + 9.0 + k % 4) / 3
            assert r.low <= tp < r.high
    assert sum(r.total for r in profile.profile_buckets(bars, 4, 28, session_start=20).collect()) == 10
    assert sum(r.total for r in profile.profile_buckets(bars, 4, 28, session_start=99).collect()) == 28
    assert profile.volume_profile(bars, 4, 28, session_start=20).first().total == 10


def test_a_channel_and_its_breakout(spark):
    lines = spark.createDataFrame([(s, "1h", k, 1.0, b) for s in "ABCD" for k, b in (("high", 10.0), ("low", 0.0))] + [("E", "1h", "high", 0.0, 5.0)], "symbol string, tf string, kind string, slope double, intercept double")
    last = spark.createDataFrame([(s, "1h", 5, c, 2.0) for s, c in zip("ABCDE", (10.0, 17.0, 3.0, 15.5, 7.0), strict=True)], "symbol string, tf string, i int, c double, atr14 double")
    got = {r.symbol: (r.upper, r.lower, r.place, r.breakout, r.strength) for r in structure.trend_channel(lines, last).collect()}
    assert got == {"A": (15, 5, 0, None, None), "B": (15, 5, 1.4, "up", 1.0), "C": (15, 5, -1.4, "down", 1.0), "D": (15, 5, pytest.approx(1.1), None, None), "E": (5, None, None, "up", 1.0)}


def test_signals_are_bounded(spark):
    df = spark.createDataFrame([(2.0, 3.0), (-0.06, 0.5), (0.05, -1.0), (None, None), (float("nan"), float("nan"))], "signal double, confidence double")
    assert [(r.signal, r.confidence, r.direction) for r in scoring.clamp_signal(df).collect()] == [(1.0, 1.0, "long"), (-0.06, 0.5, "short"), (0.05, 0.0, "neutral"), (0.0, 0.0, "neutral"), (0.0, 0.0, "neutral")]


def test_rows_expire_by_their_table(spark):
    df = spark.createDataFrame([(0,), (60 * DAY,), (99 * DAY,), (None,)], "t long")
    count = lambda table: cleaning.unexpired(df, table, 100 * DAY).count()
    assert (count("news"), count("features"), count("predictions")) == (2, 3, 4)
    r = spark.createDataFrame([(0, "1h")], "t long, tf string").select(cleaning.open_at(cleaning.F.col("t"), cleaning.F.col("tf")).alias("o"), cleaning.close_at(cleaning.F.col("t"), cleaning.F.col("tf")).alias("c")).first()
    assert (r.o, r.c) == (3_600_000, 7_204_000)


def test_mistakes_keep_their_context(spark):
    verdicts = spark.createDataFrame([("A", "1h", 1, "direction", True, False, False, None, None), ("A", "1h", 2, "direction", True, True, False, None, None), ("A", "1h", 3, "interval", True, None, None, False, None)], "symbol string, tf string, t long, kind string, ok boolean, hit boolean, abstain boolean, covered boolean, z double")
    context = spark.createDataFrame([("A", "1h", 1, "range", 0.5)], "symbol string, tf string, t long, regime string, atr14 double")
    modules = spark.createDataFrame([("A", "1h", 1, 2, "m2", 0.1, 0.2), ("A", "1h", 1, 1, "m1", 0.5, 0.6)], "symbol string, tf string, t long, rank int, module string, signal double, confidence double")
    got = {r.t: r for r in predictions.to_mistakes(verdicts, context, modules).collect()}
    assert set(got) == {1, 3} and got[1].error_type == "direction" and got[1].regime == "range" and [m.module for m in got[1].top_modules] == ["m1", "m2"]
    assert got[3].error_type == "interval-miss" and got[3].regime is None and got[3].top_modules is None


def test_listings(spark):
    old = spark.createDataFrame([("a", "Alpha"), ("b", None)], "id string, name string")
    new = spark.createDataFrame([("b", "Beta"), ("c", "Gamma")], "id string, name string")
    assert tuple(files.universe_changes(old, new).first()) == (1, 1, 3)
    assert [r.id for r in files.search_universe(files.merge_universe(old, new), "eta").collect()] == ["b"]
    assert {r.symbol: r.name for r in files.with_asset(spark.createDataFrame([("a",), ("z",)], "symbol string"), old).collect()} == {"a": "Alpha", "z": None}
    v = "symbol string, t long, value double"
    marks = spark.createDataFrame([("a", 1, 99.0, 100.0), ("a", 2, 101.0, 100.0)], "symbol string, t long, mark double, index double")
    r = files.deriv_snapshot(spark.createDataFrame([("a", k, 100.0 + k) for k in range(30)], v), spark.createDataFrame([("a", 1, 0.01)], v), spark.createDataFrame([("a", 1, 2.0)], v), marks=marks).first()
    assert r.basis == pytest.approx(0.01) and r.oi_change == pytest.approx(129 / 106 - 1) and r.funding == 0.01


def test_wilson_bounds(spark):
    from pyspark.sql import functions as F

    low, high = statistics.wilson(F.col("h"), F.col("n"))
    got = [(r.a, r.b) for r in spark.createDataFrame([(8, 10), (0, 5), (0, 0)], "h int, n int").select(low.alias("a"), high.alias("b")).collect()]
    assert got[0] == (pytest.approx(0.490162, abs=1e-5), pytest.approx(0.943318, abs=1e-5)) and got[1][0] == pytest.approx(0, abs=1e-12) and got[2] == (None, None)


def test_champion_against_challenger(spark):
    df = spark.createDataFrame([(1.0, 0.5, 1), (-1.0, 0.5, 1), (1.0, -0.5, -1), (1.0, 0.5, 1)], "a double, b double, y int")
    r = learning.champion_challenger(df, "a", "b").first()
    assert (r.champion, r.challenger, r.promote) == (0.5, 1.0, True)


def test_a_stream_of_predictions_meets_its_bars(spark, tmp_path):
    minute = 60_000
    for name, rows, schema in (("p", [("A", "1m", k * minute) for k in range(3)], "symbol string, tf string, t long"), ("b", [("A", "1m", k * minute, 1.0, 2.0 + k) for k in (1, 2)] + [("A", "1m", 500 * minute, 1.0, 1.0)], "symbol string, tf string, t long, o double, c double")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name))
    read = lambda name, schema: spark.readStream.schema(schema).parquet(str(tmp_path / name))
    q = live.stream_validate(read("p", "symbol string, tf string, t long"), read("b", "symbol string, tf string, t long, o double, c double"), "1 minute").writeStream.format("memory").queryName("met").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.t // minute: r.c for r in spark.table("met").filter("b_t is not null").collect()} == {0: 3.0, 1: 4.0}
