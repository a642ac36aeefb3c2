"""Features out of one pass over a series are those of the stacked tables, and shuffle no bars."""

import math
import random

import pytest

from barquet.functions.series import stored
from barquet.operators import features as X
from barquet.operators import indicators as I
from barquet.operators import structure as S
from barquet.plans import reports, study

DAY = 86_400_000


@pytest.fixture(scope="module")
def windows(spark):
    rng, rows = random.Random(11), []
    for s, n in enumerate((1, 2, 4, 6, 21, 60, 190)):
        c = 100.0
        for k in range(n):
            o, c = c * math.exp(rng.gauss(0, 0.02)), c * math.exp(rng.gauss(0, 0.03))
            rows.append((f"s{s}", "1d", k * DAY, o, max(o, c) + rng.random(), min(o, c) - rng.random(), c, 10 * rng.random()))
    rows += [("flat", "1d", k * DAY, 5.0, 5.0, 5.0, 5.0, 0.0) for k in range(70)]
    bars = spark.createDataFrame(rows, "symbol string, tf string, t long, o double, h double, l double, c double, v double")
    return I.moving(I.stochastic(I.volume(I.bands(S.indexed(bars)))))


@pytest.mark.parametrize("confirm", [2, 4])
def test_one_pass_gives_the_features_of_stacked_tables(windows, confirm):
    full = I.recursive(windows).cache()
    events = S.structure_events(full).cache()
    piv, breaks, zones, blocks = (S.of_tag(events, k) for k in ("pivot", "break", "gap", "block"))
    want = {(r.symbol, r.i): r.asDict() for r in X.feature_matrix(full, breaks, zones, blocks, piv, 50, confirm).collect()}
    got = {(r.symbol, r.i): r.asDict() for r in X.features_of(windows, 50, confirm).collect()}
    assert got.keys() == want.keys() and len(got) == 354
    for key, row in want.items():
        assert all(row[k] == got[key][k] or math.isclose(row[k], got[key][k], rel_tol=1e-12) for k in row), key
    for name in ("trend_up", "trend_dn", "break_recent", "fvg_open_rel", "ob_open_rel", "zone_premium"):
        assert any(r[name] for r in got.values()), name


def test_features_of_a_series_shuffle_only_lines(spark, sf_dir):
    plan = study.features(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "RDD" not in plan
    plan = reports.latest_feature_z(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "RDD" not in plan and plan.count("Exchange") <= 2


def test_stored_rows_come_back(spark):
    df = spark.range(50).selectExpr("id", "id / 7 as x", "cast(id as string) as s")
    again = stored(df)
    assert again.dtypes == df.dtypes and sorted(again.collect()) == sorted(df.collect())
    assert "Range" not in again._jdf.queryExecution().toString()
