"""The one pass over a series gives what the separate jobs give."""

import math
import random

import pytest
from pyspark.sql import functions as F

from barquet.operators import indicators as I
from barquet.operators import scoring as M
from barquet.operators import structure as S
from barquet.operators import summary

DAY = 86_400_000


@pytest.fixture(scope="module")
def bars(spark):
    r, rows = random.Random(11), []
    for symbol, n in (("A", 400), ("B", 60), ("C", 12), ("D", 1)):
        c = 100.0
        for k in range(n):
            o = c + r.gauss(0, 0.6)
            c = max(5.0, o + r.gauss(0, 1.5))
            rows.append((symbol, "1d", k * DAY, o, max(o, c) + abs(r.gauss(0, 1)), min(o, c) - abs(r.gauss(0, 1)), c, r.random() * 100))
    return spark.createDataFrame(rows, "symbol string, tf string, t long, o double, h double, l double, c double, v double")


def as_set(df, *columns):
    clean = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v
    return sorted(tuple(map(str, (clean(v) for v in r))) for r in df.select("symbol", "tf", *columns).collect())


def test_events_are_those_of_the_separate_jobs(bars):
    full = I.recursive(bars)
    events = S.structure_events(full)
    piv = S.pivots(full)
    last = full.groupBy("symbol", "tf").agg(F.max_by("atr14", "t").alias("a"), F.max_by("c", "t").alias("c"))
    tol = last.select("symbol", "tf", (F.coalesce(F.col("a"), F.col("c") * 0.01) * 0.25).alias("tolerance"))
    for tag, want, columns in (
        ("pivot", piv, ["i", "t", "price", "kind", "prior", "class"]), ("break", S.structure_breaks(full, piv), ["i", "t", "type", "dir", "level"]),
        ("gap", S.zone_mitigation(S.fvg_zones(full), full), ["i", "t", "kind", "top", "bottom", "mitigated_i", "mitigated_at"]),
        ("block", S.zone_mitigation(S.order_blocks(full, piv), full), ["i", "t", "kind", "top", "bottom", "mitigated_i", "mitigated_at"]),
        ("pool", S.sweeps(S.liquidity_levels(piv, tol), full), ["kind", "price", "touches", "last_i", "swept_i"]),
    ):
        got = as_set(S.of_tag(events, tag), *columns)
        assert got == as_set(want, *columns) and got, tag


def test_pivots_are_counted_from_the_newest(bars):
    rows = [r for r in S.structure_events(I.recursive(bars)).filter("tag = 'pivot' and symbol = 'A'").collect()]
    rows.sort(key=lambda r: (-r.i, r.kind))
    assert [r.rest for r in rows] == list(range(len(rows)))


def test_a_summary_has_a_row_for_each_series_and_plain_values_for_short_ones(bars):
    got = {r.symbol: r for r in summary.series_summary(bars).collect()}
    assert set(got) == {"A", "B", "C", "D"}
    d = got["D"]
    assert (d.breaks, d.gaps_open, d.blocks_open, d.equal_highs, d.sweep_i, d.support, d.structure, d.ema20) == (0, 0, 0, 0, None, None, "unknown", None)
    assert got["A"].ema200 is not None and got["A"].support <= got["A"].close <= (got["A"].resistance or math.inf)


def test_a_pass_with_both_recursions_gives_the_columns_of_two(bars):
    one = S.running_structure(bars, I._recursive, I.RECURSIVE_SCHEMA)
    two = I.recursive(S.running_structure(bars))
    columns = [c for c in two.columns if c not in ("symbol", "tf")]
    assert as_set(one, *columns) == as_set(two, *columns)
    assert set(M.prepared(bars).columns) >= set(columns)
