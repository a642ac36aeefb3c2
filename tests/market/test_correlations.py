import math

import pytest

from barquet.operators import statistics as T


@pytest.fixture(scope="module")
def rets(spark):
    rows = [(f"s{k}", "1d", t, math.sin(k * t) + 0.01 * k) for k in range(9) for t in range(0, 700, 1 + k % 4)]
    rows += [("flat", "1d", t, 0.3) for t in range(40)] + [("twice", "1d", t // 2, float(t % 5)) for t in range(60)]
    rows += [("short", "1d", t, float(t)) for t in range(2)] + [("s1", "1h", t, float(t % 7)) for t in range(9)] + [("s2", "1h", t, float(t % 3)) for t in range(9)]
    rows += [("odd", "1d", t, math.nan if t == 3 else float(t % 4)) for t in range(12)] + [("step", "1d", t, 0.1 if t < 4 else 5.0) for t in range(8)] + [("few", "1d", t, 0.5 * t) for t in range(4)]
    return spark.createDataFrame(rows, "symbol string, tf string, t long, r double")


def _same(x, y):
    return (math.isnan(x) and math.isnan(y)) or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12)


@pytest.mark.parametrize("returns_of_a_block", [4_000_000, 300])
def test_all_pairs_are_those_of_a_join(rets, monkeypatch, returns_of_a_block):
    monkeypatch.setattr(T, "BLOCK_RETURNS", returns_of_a_block)
    symbols = [r.symbol for r in rets.select("symbol").distinct().collect()]
    joined = {(r.tf, r.a, r.b): r for r in T.correlation_matrix(rets, symbols).filter("a < b").collect()}
    found = T.correlation_matrix(rets).collect()
    assert len(found) == len(joined) and {(r.tf, r.a, r.b) for r in found} == set(joined)
    for r in found:
        other = joined[r.tf, r.a, r.b]
        assert r.n == other.n and _same(r.corr, other.corr) and _same(r.beta, other.beta), (r, other)


def test_all_pairs_make_no_row_of_two_returns(rets):
    plan = T.correlation_matrix(rets)._jdf.queryExecution().toString()
    assert "Join" not in plan and "MapInArrow" in plan


def test_no_returns_have_no_pairs(rets):
    assert T.correlation_matrix(rets.filter("false")).count() == 0
