"""Passes over a series: few and cheap calls for each of many short series, with the numbers of a plain reading."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barquet.functions.series import rounded
from barquet.operators import indicators as I
from barquet.operators import learning as L
from barquet.operators import predictions
from barquet.operators import scoring as M
from barquet.operators import statistics as T
from barquet.operators import structure as S
from barquet.plans import study

DAY = 86_400_000


@pytest.fixture(scope="module")
def bars(spark):
    rng, rows = random.Random(5), []
    for s in range(3):
        c = 100.0
        for k in range(90 + s):
            o, c = c, c * math.exp(rng.gauss(0, 0.03))
            rows.append((f"s{s}", "1d", k * DAY, o, max(o, c) + rng.random(), min(o, c) - rng.random(), c, 10 * rng.random()))
    return spark.createDataFrame(rows, "symbol string, tf string, t long, o double, h double, l double, c double, v double")


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_passes_over_series_build_no_pandas_frames(bars):
    full = I.recursive(bars)
    piv = S.pivots(bars)
    zones = S.fvg_zones(bars)
    for df in (full, S.structure_events(full), S.running_structure(bars), S.zone_mitigation(zones, bars), S.structure_breaks(bars, piv)):
        assert "InPandas" not in _plan(df)


def test_weights_take_one_pass_over_the_labels(spark):
    labels = spark.createDataFrame([("a", "1d", i, min(19, i + i % 4)) for i in range(20)] + [("b", "1d", 3, 9), ("b", "1d", 50, 50), ("b", "1d", 60, None)], "symbol string, tf string, i long, t1 long")
    df = T.uniqueness_weights(labels)
    assert "Join" not in _plan(df)
    rows = labels.filter("t1 is not null").collect()
    live = lambda s, k: sum(r.symbol == s and r.i <= k <= r.t1 for r in rows)
    want = {(r.symbol, r.i): np.mean([1 / live(r.symbol, k) for k in range(r.i, r.t1 + 1)]) for r in rows}
    got = {(r.symbol, r.i): r.weight for r in df.collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


@pytest.mark.parametrize("values", [[3.0] * 30, [float(k % 7) for k in range(40)], [1.0, 2.0, math.nan, 4.0, 5.0, 6.0]])
def test_smoothing_is_that_of_pandas(values):
    x = np.array(values)
    for n, alpha in ((1, 0.4), (3, 2 / 4), (5, 1 / 14)):
        seeded = np.concatenate([[x[:n].mean()], x[n:]])
        np.testing.assert_array_equal(I.smoothed(x, n, alpha)[n - 1 :], pd.Series(seeded).ewm(alpha=alpha, adjust=False).mean().to_numpy())


def test_columns_of_modules_are_compiled(spark, bars):
    """No stage of a score leaves its columns in a method that the JVM only interprets."""
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    M.orchestrate(M.module_signals(M.prepared(bars)))
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_features_take_one_pass_and_no_join(spark, sf_dir):
    plan = _plan(study.feature_matrix(spark, sf_dir))
    assert "CoGroups" not in plan and "InArrow" not in plan and "Join" not in plan  # bars and events are settled before


def test_rounding_is_that_of_spark(spark):
    rng = random.Random(3)
    odd = [None, math.nan, math.inf, -math.inf, -0.0, -1e-9, 5e-7, -5e-7, 2.5e-7, 1e300, 999.9999995, -999.9999995, 0.1234565, 123456789012.3456785]
    near = [k / 2e6 + s for k in range(-99, 99) for s in (0.0, 1e-13, -1e-13)] + [rng.uniform(-1, 1) * 10 ** rng.uniform(-9, 15) for _ in range(2000)]
    df = spark.createDataFrame([(x,) for x in odd + near], "x double")
    for digits in (4, 6):
        got = rounded(df.withColumn("y", F.col("x")), ["y"], digits).select("x", F.col("y").cast("string").alias("y"), F.round("x", digits).cast("string").alias("z")).collect()
        assert [r for r in got if r.y != r.z] == []


def test_drift_is_one_arrow_pass_with_the_cuts_of_a_plain_window(bars):
    assert "InPandas" not in _plan(predictions.drift(bars, ["symbol", "tf"], "c"))
    rng = random.Random(9)
    for most in (200, 2048):
        own, held = predictions.Adwin(most=most), np.zeros(0)
        for k in range(1500):
            x = rng.gauss(0, 0.1) + (0.3 if k % 500 > 300 else 0)
            held, cut = np.append(held, x)[-most:], None
            n, sums = len(held), np.cumsum(held)
            if n >= 32:
                at = np.arange(16, n - 15)
                hits = np.flatnonzero(np.abs(sums[at - 1] / at - (sums[-1] - sums[at - 1]) / (n - at)) > np.ptp(held) * np.sqrt(np.log(4 * n / 0.002) * (1 / at + 1 / (n - at)) / 2))
                cut = at[hits[0]] if len(hits) else None
            held = held if cut is None else held[cut:]
            assert own.push(x) == (cut is not None) and len(own.values) == len(held)
        assert (own.values == held).all()


def test_structure_scores_read_no_columns_of_modules(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(M, "prepared", None)
    assert study.structure_scores(spark, sf_dir).columns


def test_calibrators_read_their_split_from_one_settled_table(bars):
    rows = bars.selectExpr("symbol", "tf", "t", "v / 10 as score", "cast(c > o as int) as y")
    assert "Window" not in _plan(L.compare_calibrators(rows))
