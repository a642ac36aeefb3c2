"""Bar tables by series and day: what an upsert touches; grading by nearest time; profiles of mistakes."""

import glob
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from barquet.operators import features, learning, scoring, statistics
from barquet.sources import bars as B

DAY, HOUR = 86_400_000, 3_600_000
T0 = 19_700 * DAY
SCHEMA = "symbol string, tf string, t long, o double, h double, l double, c double, v double, closed boolean"


def rows_of(spark, rows):
    return spark.createDataFrame([(s, "1h", t, c, c, c, c, 1.0, True) for s, t, c in rows], SCHEMA)


def files(path):
    return {f: (os.stat(f).st_mtime_ns, os.stat(f).st_size) for f in glob.glob(f"{path}/symbol=*/**/*.parquet", recursive=True)}


def test_an_upsert_rewrites_only_the_days_it_touches(spark, tmp_path):
    path = str(tmp_path / "bars")
    B.write_bars(rows_of(spark, [(s, T0 + k * HOUR, float(k)) for s in "AB" for k in range(96)]), path)
    before = files(path)
    assert len(before) == 8  # two series, four days
    new = rows_of(spark, [("A", T0 + 30 * HOUR, -1.0), ("A", T0 + 30 * HOUR + 60_000, -2.0), ("B", T0 + 96 * HOUR, -3.0)])
    B.upsert_bars(new, path)
    after = files(path)
    day = lambda k: f"day={__import__('datetime').datetime.fromtimestamp((T0 + k * DAY) / 1000, __import__('datetime').timezone.utc):%Y-%m-%d}"
    assert {f for f in before if f not in after} == {f for f in before if "symbol=A" in f and day(1) in f}
    assert all(after[f] == x for f, x in before.items() if f in after) and len(after) == 9
    got = {(r.symbol, r.t): r.c for r in B.read_bars(spark, path).collect()}
    want = {(s, T0 + k * HOUR): float(k) for s in "AB" for k in range(96)} | {("A", T0 + 30 * HOUR): -1.0, ("A", T0 + 30 * HOUR + 60_000): -2.0, ("B", T0 + 96 * HOUR): -3.0}
    assert got == want and not glob.glob(f"{path}/_staged*")


def test_the_later_of_two_bars_stays(spark, tmp_path):
    path = str(tmp_path / "bars")
    one = rows_of(spark, [("A", T0, 1.0), ("A", T0 + HOUR, 9.0)]).withColumn("at", F.col("c"))
    B.write_bars(one, path)
    B.upsert_bars(rows_of(spark, [("A", T0, 2.0), ("A", T0 + HOUR, 3.0)]).withColumn("at", F.col("c")), path, "at")
    got = spark.read.parquet(path).select("t", "c").collect()
    assert {r.t: r.c for r in got} == {T0: 2.0, T0 + HOUR: 9.0} and len(got) == 2


def test_files_are_bounded_and_days_are_dealt_to_tasks(spark, tmp_path):
    path = str(tmp_path / "bars")
    B.write_bars(rows_of(spark, [("A", T0 + k * 60_000, float(k)) for k in range(3 * 1440)]), path, file_rows=500)
    assert len(files(path)) == 9 and spark.read.parquet(path).count() == 3 * 1440
    assert B.read_bars(spark, path, "A", "1h", T0 + DAY, T0 + 2 * DAY - 1).count() == 1440


def test_forecasts_are_graded_at_the_nearest_bar(spark):
    bar = "k int, t long, c double, lo double, hi double"
    asked = [(T0 + k * HOUR + shift, 10.0 + k) for k, shift in enumerate((0, 60_000, -HOUR // 2, HOUR // 2, 25 * 60_000))]
    ghosts = spark.createDataFrame([("A", "1h", T0 - HOUR, 10.0, HOUR, [(k, t, c, c - 1, c + 2) for k, (t, c) in enumerate(asked)])], f"symbol string, tf string, t long, c double, step_ms long, bars array<struct<{bar.replace(' ', ':').replace(',:', ',')}>>")
    real = [(T0 + k * HOUR, 10.5 + 2 * k) for k in range(4)]
    got = sorted(features.grade_bars(ghosts, rows_of(spark, [("A", t, c) for t, c in real])).collect(), key=lambda r: r.k)
    want = []
    for k, (t, c) in enumerate(asked):
        near = [(abs(x - t), -x, y) for x, y in real if abs(x - t) <= HOUR / 2]
        if near:
            _, later, y = min(near)
            want.append((k, t, -later, abs(y - c), c - 1 <= y <= c + 2, (y > 10) == (c > 10) if c != 10 else False, 3.0))
    assert [(r.k, r.t, r.real_t, r.abs_error, r.covered, r.hit, r.width) for r in got] == want and len(want) == 4
    total = features.grade_ghosts(ghosts, rows_of(spark, [("A", t, c) for t, c in real])).first()
    assert total.n == 4 and total.final_error == want[-1][3] and total.width == 3.0 and total.mae == pytest.approx(sum(w[3] for w in want) / 4)


def test_profiles_equal_a_plain_count(spark):
    r = random.Random(9)
    centers = [[0.0, 0.0], [5.0, 0.0], [50.0, 50.0]]
    rows = [(k, [r.gauss(5 * (k % 2), 1.5), r.gauss(0, 1.5)] if k % 17 else None, k % 3 != 0, r.choice(["direction", "magnitude", None]), r.choice(["long", "long", "short", None]), r.choice(["up", "down", None])) for k in range(400)]
    got = {x.cluster: x for x in learning.pattern_profiles(spark.createDataFrame(rows, "id int, vec array<double>, mistake boolean, error_type string, direction string, regime string"), centers).collect()}
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assert set(got) == {0, 1}
    for c, x in got.items():
        own = [m for m in rows if m[1] and m[2] and min(range(3), key=lambda k: d(m[1], centers[k])) == c]
        mean = [sum(m[1][j] for m in own) / len(own) for j in (0, 1)]
        radius = sorted(d(m[1], mean) for m in own)[math.floor(0.9 * (len(own) - 1))]
        right = sum(1 for m in rows if m[1] and not m[2] and d(m[1], mean) <= radius * (1 + 1e-12))
        count = lambda k: {v: sum((m[k] or "unknown") == v for m in own) for v in {m[k] or "unknown" for m in own}}  # noqa: B023, E731
        assert x.n_mistakes == len(own) and x.centroid == pytest.approx(mean) and x.radius == pytest.approx(radius) and x.n_correct == right
        assert x.errors == count(3) and x.regime == min(count(5), key=lambda v: (-count(5)[v], v))
        n_long, n_short = (sum(m[4] == side for m in own) for side in ("long", "short"))
        assert x.direction == ("long" if n_long > 2 * n_short else "short" if n_short > 2 * n_long else "mixed")


def test_patterns_of_one_regime(spark):
    patterns = spark.createDataFrame([(0, [0.0], 1.0, "up"), (1, [10.0], 1.0, "down")], "cluster int, centroid array<double>, radius double, regime string")
    rows = spark.createDataFrame([([1.0],)], "vec array<double>")
    assert learning.nearest_pattern(rows, patterns).first().cluster == 0 and learning.nearest_pattern(rows, patterns, "down").first().cluster == 1


def test_metrics_by_regime_and_shares(spark):
    trades = spark.createDataFrame([("A", "1h", x, p) for x, p in [("up", 0.2), ("up", -0.1), ("down", 0.3), (None, 0.0)]], "symbol string, tf string, regime string, pnl double")
    got = {(r.symbol, r.regime, r.regime_total): r for r in scoring.metrics_by_regime(trades).collect()}
    assert len(got) == 5 and got["A", "up", False].profit_factor == pytest.approx(2.0) and got["A", None, False].n == 1
    assert got["A", None, True].n == 4 == got[None, None, True].n and got["A", None, True].avg_win == pytest.approx(0.25) and got["A", "down", False].avg_loss is None
    counts = spark.createDataFrame([(10, 5, 3, 2)], "n int, up int, down int, flat int")
    r = statistics.label_shares(counts).first()
    assert (r.up_share, r.down_share, r.flat_share) == (0.5, 0.3, 0.2) and r.imbalance == pytest.approx(0.3)


def test_order_statistics_of_few_large_and_many_small_groups(spark):
    from barquet.functions import ranks

    r = random.Random(1)
    rows = [("hot" if r.random() < 0.6 else f"g{r.randrange(40)}" if r.random() < 0.9 else None, r.choice([1.0, 2.0, round(r.gauss(0, 5), 2), None])) for _ in range(6000)]
    df = spark.createDataFrame(rows, "g string, x double")
    groups: dict = {}
    for g, x in rows:
        if x is not None:
            groups.setdefault(g, []).append(x)
    wanted = [(g, k) for g, own in groups.items() for k in {0, len(own) // 3, len(own) - 1, len(own)}]
    got = {(x.g, x.rank): x.x for x in ranks.order_statistics(df, ["g"], "x", spark.createDataFrame(wanted, "g string, rank long")).collect()}
    assert got == {(g, k): sorted(groups[g])[k] for g, k in wanted if k < len(groups[g])}
    steps = ranks.running_counts(df.withColumn("n", F.lit(1)), ["g"], "x", ["n"]).collect()
    assert {(s.g, s.x): (s.c_n, s.n_n) for s in steps} == {(g, x): (sum(y <= x for y in own), len(own)) for g, own in groups.items() for x in own}
