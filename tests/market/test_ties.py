"""Lines of one order and number: the first of the file opens and closes a bar, as in the SQL."""

import random
from datetime import datetime, timedelta

import duckdb
import pytest

from barquet.plans import registry
from barquet.sources.bars import lineitem_bars


@pytest.fixture(scope="module")
def tied(spark, tmp_path_factory):
    rng, rows = random.Random(7), []
    for day in range(160):
        for _ in range(3):  # three lines with one number, and at times a later one
            rows.append((day, 1, 5, 1.0, round(10 + rng.random(), 4), datetime(1995, 1, 1) + timedelta(days=day)))
        if day % 3 == 0:
            rows.append((day, 2, 5, 2.0, round(20 + rng.random(), 4), datetime(1995, 1, 1) + timedelta(days=day)))
    folder = str(tmp_path_factory.mktemp("tied"))
    columns = "l_orderkey bigint, l_linenumber int, l_suppkey bigint, l_quantity double, l_extendedprice double, l_shipdate timestamp"
    spark.createDataFrame(rows, columns).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    return folder


@pytest.mark.parametrize("name", ["bars_lineitem", "rolling_conformal", "conformal_intervals"])
def test_a_tie_goes_to_the_first_line(spark, tied, name):
    duck = duckdb.connect(config={"threads": 1})
    duck.sql(f"create view lineitem as select * from '{tied}/lineitem.parquet/*.parquet'")
    want = duck.sql(registry.ORACLE_SQL[name])
    got = registry.QUERIES[name](spark, tied)
    columns = sorted(want.columns)
    norm = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    plain = sorted(tuple(norm(r[want.columns.index(c)]) for c in columns) for r in want.fetchall())
    assert sorted(tuple(norm(r[c]) for c in columns) for r in got.collect()) == plain and len(plain) > 40


def test_windows_over_a_series_shuffle_no_bars(spark, tied):
    plan = registry.QUERIES["bollinger"](spark, tied)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert lineitem_bars(spark, tied).columns == ["symbol", "tf", "t", "o", "h", "l", "c", "v"]
