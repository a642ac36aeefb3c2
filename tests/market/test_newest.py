"""The signals of the last bars are made of few bars, and are those that all bars give."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barquet.functions.series import SERIES
from barquet.operators import scoring as M
from barquet.operators import structure_signals as G
from barquet.sources.bars import lineitem_bars


@pytest.fixture(scope="module")
def bars(spark, sf_dir):
    """Series longer than any look back, and one of three bars."""
    long = lineitem_bars(spark, sf_dir)
    w = Window.partitionBy("tf").orderBy("t", "symbol")
    short = long.withColumn("_r", F.row_number().over(w)).filter("_r <= 3").drop("_r").withColumn("symbol", F.lit("short"))
    return long.unionByName(short.dropDuplicates([*SERIES, "t"]))


def by_series(df):
    return {r.symbol: r.asDict() for r in df.collect()}


def test_newest_signals_are_those_of_all_bars(bars):
    got = by_series(M.newest_signals(bars))
    all_ = M.prepared(bars)
    w = Window.partitionBy(*SERIES).orderBy(F.desc("t"))
    wanted = by_series(M.module_signals(all_).withColumns({"_r": F.row_number().over(w), "n_bars": F.count("*").over(Window.partitionBy(*SERIES))}).filter("_r = 1").drop("_r").join(G.in_columns(G.stacked(all_)), SERIES, "left").fillna(0.0, [f"{x}_{m}" for m in G.WEIGHTS for x in "sc"]))
    assert got.keys() == wanted.keys() and max(r["n_bars"] for r in got.values()) > G.DISPLACEMENT_BARS
    for symbol, row in wanted.items():
        assert got[symbol] == row


def test_only_the_last_bars_leave_the_pass(bars):
    rows = M.walked(bars, 60).groupBy(*SERIES).agg(F.count(F.when(F.col("tag") == "bar", 1)).alias("n"), F.max(F.when(F.col("tag") == "bar", F.col("i"))).alias("last")).collect()
    sizes = {r.symbol: r.n for r in bars.groupBy("symbol").agg(F.count("*").alias("n")).collect()}
    assert {r.symbol: (r.n, r.last) for r in rows} == {s: (min(n, 60), n - 1) for s, n in sizes.items()}


def test_a_module_without_a_bound_sees_all_bars(bars, monkeypatch):
    monkeypatch.setattr(M, "MODULES", dict(M.MODULES))
    monkeypatch.setattr(M, "LOOKS_BACK", dict(M.LOOKS_BACK))
    seen = F.count("*").over(M.in_order()) / 10_000
    M.register_module("everything", 1.0)(lambda: (seen, F.lit(1.0)))
    got = by_series(M.newest_signals(bars))
    assert all(r["s_everything"] == pytest.approx(r["n_bars"] / 10_000) for r in got.values())
