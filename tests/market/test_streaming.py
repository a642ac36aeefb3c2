"""Stateful streams against plain replays of the same rows, with restarts from the checkpoint."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barquet.functions import rolling
from barquet.functions.series import STEP_MS
from barquet.operators import features
from barquet.operators.predictions import Adwin
from barquet.streaming import stateful

T0, MINUTE = 1_700_000_040_000 // 60_000 * 60_000, 60_000


class Feed:
    """Files in a folder, read as a stream one file a batch; every run goes on from the checkpoint."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.n = spark, folder, schema, 0
        (folder / "in").mkdir()

    def put(self, rows):
        names = [c.split()[0] for c in self.schema.split(", ")]
        self.spark.createDataFrame(rows, self.schema).toPandas()[names].to_parquet(self.folder / "in" / f"{self.n:04d}.parquet")
        self.n += 1

    def run(self, job):
        source = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(str(self.folder / "in"))
        q = job(source).writeStream.format("parquet").option("path", str(self.folder / "out")).option("checkpointLocation", str(self.folder / "at")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None
        return self.spark.read.parquet(str(self.folder / "out")).collect()


def plain_quantile(scores, alpha):
    k = math.ceil((len(scores) + 1) * (1 - alpha) - 1e-9)
    return sorted(scores)[k - 1] if 1 <= k <= len(scores) else math.inf


@pytest.mark.parametrize("n,alpha", [(500, 0.1), (7, 0.1), (30, 0.5), (1, 0.5)])
def test_rolling_conformal_equals_a_sorted_window(n, alpha):
    r = np.random.default_rng(n)
    scores = np.round(r.exponential(1, 1500), 1)  # many ties
    scores[r.random(1500) < 0.1] = np.nan
    want = [plain_quantile([x for x in scores[max(0, i - n) : i] if x == x], alpha) for i in range(1500)]
    assert rolling.rolling_conformal(scores, n, alpha).tolist() == want
    window = rolling.LastScores(n)
    for x in scores[~np.isnan(scores)]:
        window.push(float(x))
    assert window.conformal(alpha) == plain_quantile([x for x in scores if x == x][-n:], alpha)


def test_a_calibration_stream_equals_the_batch_form_over_a_restart(spark, tmp_path):
    r = random.Random(3)
    rows = [(s, "1m", T0 + k * MINUTE, r.expovariate(1), r.random() < 0.8) for s in "AB" for k in range(60)]
    feed = Feed(spark, tmp_path, "symbol string, tf string, t long, abs_error double, covered boolean")
    job = lambda df: stateful.stream_calibration(df, 20, 0.2)
    for first in (0, 25):
        own = [x for x in rows if first <= (x[2] - T0) // MINUTE < first + 25]
        r.shuffle(own)
        feed.put(own)
    assert len(feed.run(job)) == 100
    feed.put([x for x in rows if (x[2] - T0) // MINUTE >= 50])  # after a restart
    got = {(x.symbol, x.t): x for x in feed.run(job)}
    batch = features.rolling_conformal(spark.createDataFrame(rows, feed.schema), 20, 0.2, "abs_error").collect()
    assert len(got) == len(batch) == 120
    for x in batch:
        g = got[x.symbol, x.t]
        assert (math.inf if g.q_before is None else g.q_before) == x.q and g.missed == (x.abs_error > x.q)
    for s in "AB":
        past = [x for x in rows if x[0] == s]
        last = got[s, T0 + 59 * MINUTE]
        assert last.samples == 20 and last.coverage == pytest.approx(np.mean([x[4] for x in past])) and last.mean_error == pytest.approx(np.mean([x[3] for x in past]))
        assert last.q == plain_quantile([x[3] for x in past][-20:], 0.2)


def test_calibration_passes_over_bad_scores(spark, tmp_path):
    feed = Feed(spark, tmp_path, "symbol string, tf string, t long, abs_error double, covered boolean")
    feed.put([("A", "1m", T0, 1.0, True), ("A", "1m", T0 + 1, None, None), ("A", "1m", T0 + 2, float("nan"), False), ("A", "1m", T0 + 3, -1.0, None), ("A", "1m", T0 + 4, float("inf"), None), ("A", "1m", T0 + 5, 3.0, True)])
    got = sorted(feed.run(lambda df: stateful.stream_calibration(df, 5, 0.5)), key=lambda x: x.t)
    assert [x.samples for x in got] == [1, 1, 1, 1, 1, 2] and [x.q for x in got] == [1, 1, 1, 1, 1, 3] and got[-1].coverage == pytest.approx(2 / 3)


def test_closes_in_order_with_many_waiting_late_bars_and_a_restart(spark, tmp_path):
    feed = Feed(spark, tmp_path, "symbol string, tf string, t long, c double")
    put = lambda *own: feed.put([("A", "1m", T0 + k * MINUTE, float(k)) for k in own])
    put(0)
    put(*range(2, 100))  # wait for 1
    feed.run(stateful.reorder_and_gaps)
    put(*range(100, 121))  # 119 wait
    before = feed.run(stateful.reorder_and_gaps)
    assert [x.from_t for x in before] == [T0]
    put(121)  # 120 wait: 1 is a gap
    put(1, 50, 122)  # late ones go
    put(125, 124, 124)  # 123 may come
    put(123)
    put(130)
    got = sorted(((x.from_t - T0) // MINUTE, (x.to_t - T0) // MINUTE, x.kind) for x in feed.run(stateful.reorder_and_gaps))
    assert got == [(0, 0, "bar"), (1, 1, "gap"), *[(k, k, "bar") for k in range(2, 126)], (126, 129, "gap"), (130, 130, "bar")]


def test_a_missing_bar_is_given_up_when_the_watermark_passes(spark, tmp_path):
    feed = Feed(spark, tmp_path, "symbol string, tf string, t long, c double")
    job = lambda df: stateful.reorder_and_gaps(df.withColumn("at", F.timestamp_millis("t")).withWatermark("at", "0 seconds"), patience=5 * MINUTE)
    put = lambda s, *own: feed.put([(s, "1m", T0 + k * MINUTE, float(k)) for k in own])
    put("A", 0, 2)
    put("B", 4)
    assert [x.symbol for x in feed.run(job)] == ["A", "B"] or len(feed.run(job)) == 2
    put("B", 5, 6, 7, 8)  # the watermark moves past 2 + 5
    put("B", 9)
    got = sorted((x.symbol, (x.from_t - T0) // MINUTE, x.kind) for x in feed.run(job))
    assert [x for x in got if x[0] == "A"] == [("A", 0, "bar"), ("A", 1, "gap"), ("A", 2, "bar")]


def test_the_histogram_equals_the_list_where_every_cut_is_tried():
    r = np.random.default_rng(0)
    x = np.concatenate([r.random(400) < p for p in (0.9, 0.4, 0.4, 0.8, 0.1)]).astype(float)
    plain, own = Adwin(most=600), rolling.AdwinHistogram(most=600, each=601)
    assert [plain.push(v) for v in x] == [own.push(v) for v in x]


def test_the_histogram_finds_the_shifts_of_the_list_in_little_memory():
    r = np.random.default_rng(1)
    means = [0.9, 0.5, 0.9, 0.6] * 5
    x = np.concatenate([(r.random(5000) < p).astype(float) for p in means])
    assert len(x) == 100_000
    plain, own, most = Adwin(), rolling.AdwinHistogram(), 0
    a = [i for i, v in enumerate(x) if plain.push(v)]
    b = []
    for i, v in enumerate(x):
        if own.push(v):
            b.append(i)
        most = max(most, len(own.buckets))
    assert most <= 5 * (math.log2(2048) + 2)
    for k in range(1, len(means)):  # both see every shift, the histogram no later than a bucket's share of the window
        first = lambda cuts: min(c for c in cuts if c >= 5000 * k) - 5000 * k  # noqa: E731, B023
        assert first(a) < 400 and first(b) <= first(a) + 100
    stray = lambda cuts: sum(c % 5000 > 1500 for c in cuts)
    assert stray(b) <= stray(a) + 2


def test_a_drift_stream_equals_a_replay_over_a_restart(spark, tmp_path):
    r = random.Random(5)
    rows = []
    for kind in ("direction", "return", "interval", "set"):
        for k in range(700):
            late = k >= 400
            rows.append(("A", "1m", kind, T0 + k, (r.random() < (0.3 if late else 0.9)) if kind != "return" else None, r.random() + (4 if late else 0) if kind in ("return", "interval") else None))
    feed = Feed(spark, tmp_path, "symbol string, tf string, kind string, t long, hit boolean, abs_error double")
    job = lambda df: stateful.stream_drift(df, threshold=30.0)
    feed.put([x for x in rows if x[3] < T0 + 350])
    feed.run(job)
    feed.put([x for x in rows if T0 + 350 <= x[3] < T0 + 420])
    feed.put([x for x in rows if x[3] >= T0 + 420])
    got = sorted((x.kind, x.t, x.cause) for x in feed.run(job))
    want = []
    for kind in ("direction", "return", "interval", "set"):
        hits, errors, ph = rolling.AdwinHistogram(), rolling.AdwinHistogram(), stateful.PageHinkley(0.005, 30.0)
        past, base, checked = [], None, 0
        for _, _, k, t, hit, error in rows:
            if k != kind:
                continue
            if hit is not None and hits.push(float(hit)):
                want.append((kind, t, "accuracy-adwin" if kind == "direction" else "coverage-adwin"))
            if error is not None:
                past.append(error)
                if kind == "return" and errors.push(error):
                    want.append((kind, t, "residual-adwin"))
                if ph.push(error):
                    want.append((kind, t, "residual-pagehinkley"))
                if base is None and len(past) >= 200:
                    base, checked = np.array(past), len(past)
                elif base is not None and len(past) - checked >= 50:
                    checked = len(past)
                    if rolling.psi(base, np.array(past[-200:])) > 0.25:
                        want.append((kind, t, "residual-psi"))
    assert got == sorted(want) and {x[2] for x in got} == {"accuracy-adwin", "coverage-adwin", "residual-adwin", "residual-pagehinkley", "residual-psi"}
    assert {x[0] for x in got} == {"direction", "return", "interval", "set"}


def test_psi_of_equal_and_moved_values():
    x = np.arange(1000.0)
    assert rolling.psi(x, x) == pytest.approx(0) and rolling.psi(x, x + 900) > 0.25 and math.isnan(rolling.psi(x, np.zeros(0)))
    assert STEP_MS["1m"] == MINUTE and pd.notna(rolling.psi(np.ones(50), np.ones(50)))
