"""Cells of all pairs: as many symbols as a task can hold the returns of, packed, and multiplied by tiles."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from barquet.operators import statistics as T


@pytest.mark.parametrize("times", [[5], [-7, 0, 9], [86_400_000 * k for k in (1, 2, 5, 900)], [3, 3, 1], [0, 2**60]])
def test_a_series_comes_back_in_order(times):
    r = [math.nan if k == 1 else 0.1 * k - 0.3 for k in range(len(times))]
    batch = pa.RecordBatch.from_arrays([pa.array(["a"]), pa.array(["1d"]), pa.array([times]), pa.array([r])], ["symbol", "tf", "t", "r"])
    packed = next(T._packed(iter([batch])))
    cell = pa.RecordBatch.from_arrays([*packed.columns, *[pa.array([k]) for k in (1, 1, 2)]], [*packed.schema.names, "_own", "_i", "_j"])
    (_, symbol, own, t, back), *_ = T._rows(cell)
    order = np.argsort(times, kind="stable")
    assert (symbol, own) == ("a", 1) and t.tolist() == np.array(times)[order].tolist()
    np.testing.assert_array_equal(back, np.array(r)[order])


def _returns(spark, symbols):
    rng = random.Random(1)
    rows = [(f"s{k:03}", "1d", t * 86_400_000, rng.gauss(0, 0.1)) for k in range(symbols) for t in sorted(rng.sample(range(90), 30))]
    return spark.createDataFrame(rows, "symbol string, tf string, t long, r double")


def test_tiles_leave_no_pair_out(spark, monkeypatch):
    rets = _returns(spark, 40).cache()
    want = {(r.a, r.b): (r.n, r.corr, r.beta) for r in T.correlation_matrix(rets).collect()}
    monkeypatch.setattr(T, "BLOCK_SYMBOLS", 3)
    got = {(r.a, r.b): (r.n, r.corr, r.beta) for r in T.correlation_matrix(rets).collect()}
    assert len(got) > 700 and got.keys() == want.keys() and all(a < b for a, b in got)
    assert all(got[k][0] == want[k][0] and math.isclose(got[k][1], want[k][1], abs_tol=1e-12) for k in want)


def test_copies_of_a_series_follow_the_returns_and_not_the_symbols(spark, monkeypatch):
    """Many symbols with few returns each fit in few blocks, so each travels a few times only."""
    monkeypatch.setattr(T, "BLOCK_SYMBOLS", 2)
    plan = T.correlation_matrix(_returns(spark, 40))._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Repartition\w* .*\b21\b", plan)  # six blocks have 21 cells
