"""Live jobs with state of their own: ordered closes with gaps, calibration of forecasts, drift of gradings.

They run on transformWithState, so a batch reads and writes only the state that it touches. The session
needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.rolling import AdwinHistogram, LastScores, psi
from ..functions.series import SERIES, STEP_MS
from ..operators.predictions import PageHinkley

#: Bars that wait for one before them, for each series.
PENDING = 120


def order_closes(rows: list[tuple], last: int | None, pending: dict[int, tuple], step: int, most: int = PENDING, due: bool = False) -> tuple[list[tuple], int | None]:
    """Emit (kind, from, to, row) in order: bars, and gaps where more than one bar is missing and later ones wait.

    Late bars go; a single missing bar is waited for until ``most`` bars wait, or no longer if it is ``due``.
    """
    out = []
    for row in sorted(rows):
        if last is None or row[0] > last:
            pending.setdefault(row[0], row)
    order = sorted(pending)
    for at, first in enumerate(order):
        hole = last is not None and first > last + step
        if hole and first <= last + 2 * step and len(order) - at < most and not due:
            break
        if hole:
            out.append(("gap", last + step, first - step, None))
        out.append(("bar", first, first, pending.pop(first)))
        last, due = first, False
    return out, last


class _Closes(StatefulProcessor):
    """Emits bars in order; waiting ones lie in map state by their time, so that a batch writes what comes and what goes."""

    def __init__(self, most: int, patience: int | None) -> None:
        self.most, self.patience = most, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t long")
        self.waiting = handle.getMapState("waiting", "t long", "c double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [row for frame in rows for row in zip(frame["t"].tolist(), frame["c"].tolist(), strict=True)]
        yield from self._go(key, new, False, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._go(key, [], True, timerValues)

    def _go(self, key, new: list[tuple[int, float]], due: bool, timers) -> Iterator[pd.DataFrame]:
        held = {k[0]: (k[0], v[0]) for k, v in self.waiting.iterator()}
        before = self.last.get()[0] if self.last.exists() else None
        due = due and bool(held) and min(held) + self.patience <= timers.getCurrentWatermarkInMs()
        rest = dict(held)
        out, last = order_closes(new, before, rest, STEP_MS[key[1]], self.most, due)
        for t in held.keys() - rest.keys():
            self.waiting.removeKey((t,))
        for t in rest.keys() - held.keys():
            self.waiting.updateValue((t,), (rest[t][1],))
        if last != before:
            self.last.update((last,))
        if self.patience is not None and held.keys() != rest.keys():
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if rest:
                self.handle.registerTimer(max(min(rest) + self.patience, timers.getCurrentWatermarkInMs() + 1))
        if out:
            yield pd.DataFrame([(*key, kind, a, b, row and row[1]) for kind, a, b, row in out], columns=["symbol", "tf", "kind", "from_t", "to_t", "c"])

    def close(self) -> None:
        pass


def reorder_and_gaps(bars: DataFrame, most: int = PENDING, patience: int | None = None) -> DataFrame:
    """(symbol, tf, kind, from_t, to_t, c) of closed bars in order, with gaps, for each series of a stream.

    Late bars go, of bars with one time the first counts. Two or more missing bars are a gap at once. A single one
    is waited for until ``most`` bars wait or, with ``patience`` (milliseconds), the watermark of event time has passed the first
    waiting bar by that much; ``bars`` then needs a watermark on a column ``at``.
    """
    columns = [*SERIES, "t", "c", *(["at"] if patience is not None else [])]
    mode = "EventTime" if patience is not None else "None"
    return bars.select(*columns).groupBy(*SERIES).transformWithStateInPandas(_Closes(most, patience), "symbol string, tf string, kind string, from_t long, to_t long, c double", "append", mode)


class _Ring:
    """The last ``most`` values of a series, in map state by their number: a batch writes the slots that it fills."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, most: int) -> None:
        self.most = most
        self.slots = handle.getMapState(f"{name}_slots", "slot int", "x double")
        self.pushed = handle.getValueState(f"{name}_pushed", "n long")

    def read(self) -> tuple[int, list[float]]:
        """How many values came so far, and the last ones in order."""
        n = self.pushed.get()[0] if self.pushed.exists() else 0
        by_slot = {k[0]: v[0] for k, v in self.slots.iterator()} if n else {}
        return n, [by_slot[k % self.most] for k in range(max(0, n - self.most), n)]

    def append(self, n: int, values: list[float]) -> None:
        """``values`` after the first ``n``."""
        for k in range(max(0, len(values) - self.most), len(values)):
            self.slots.updateValue(((n + k) % self.most,), (float(values[k]),))
        if values:
            self.pushed.update((n + len(values),))

    def clear(self) -> None:
        self.slots.clear()
        self.pushed.clear()


class _Calibration(StatefulProcessor):
    def __init__(self, most: int, alpha: float, idle: int | None) -> None:
        self.most, self.alpha, self.idle = most, alpha, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = _Ring(handle, "scores", self.most)
        self.totals = handle.getValueState("totals", "graded long, covered long, error double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, scores = self.ring.read()
        window, fresh, out = LastScores(self.most, scores), [], []
        graded, covered, error = self.totals.get() if self.totals.exists() else (0, 0, 0.0)
        frame = pd.concat(list(rows)).sort_values("t", kind="stable")
        for t, score, inside in zip(frame["t"].tolist(), frame["abs_error"].tolist(), frame["covered"].tolist(), strict=True):
            q = window.conformal(self.alpha)
            if inside is not None and inside == inside:
                graded, covered = graded + 1, covered + bool(inside)
            good = score is not None and np.isfinite(score) and score >= 0
            if good:
                window.push(score)
                fresh.append(score)
                error += score
            now, seen = window.conformal(self.alpha), n + len(fresh)
            out.append((*key, t, *(None if np.isinf(x) else x for x in (q, now)), len(window.ring), covered / graded if graded else None, error / seen if seen else None, bool(good and score > q)))
        self.ring.append(n, fresh)
        self.totals.update((graded, covered, error))
        if self.idle is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        yield pd.DataFrame(out, columns=["symbol", "tf", "t", "q_before", "q", "samples", "coverage", "mean_error", "missed"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.ring.clear()
        self.totals.clear()
        yield pd.DataFrame([], columns=["symbol", "tf", "t", "q_before", "q", "samples", "coverage", "mean_error", "missed"])

    def close(self) -> None:
        pass


def stream_calibration(graded: DataFrame, most: int = 500, alpha: float = 0.1, idle_ms: int | None = None) -> DataFrame:
    """Rolling conformal calibration of forecasts: a row for each graded bar of a stream.

    ``graded``: (symbol, tf, t, abs_error, covered). Adds to the series' last ``most`` errors and gives q_before and q (the
    conformal quantile without and with this bar, null while the errors are too few), samples, the share covered and
    the mean error so far, and whether the error is beyond q_before. Rows of a batch count in order of t, batches as they
    come. An error that is null, not finite or negative counts for nothing, a null ``covered`` not for the share. A series
    silent for ``idle_ms`` is forgotten.
    """
    schema = "symbol string, tf string, t long, q_before double, q double, samples int, coverage double, mean_error double, missed boolean"
    rows = graded.select(*SERIES, "t", F.col("abs_error").cast("double").alias("abs_error"), "covered")
    return rows.groupBy(*SERIES).transformWithStateInPandas(_Calibration(most, alpha, idle_ms), schema, "append", "None" if idle_ms is None else "ProcessingTime")


#: Of a kind of grading: whether the hit or coverage share and whether the error is watched.
WATCHED = {"direction": (True, False), "return": (False, True), "interval": (True, True), "set": (True, False)}


class _Drift(StatefulProcessor):
    def __init__(self, delta: float, ph_delta: float, threshold: float, baseline: int, bins: int, major: float, rings: tuple[int, int]) -> None:
        self.delta, self.ph, self.baseline, self.bins, self.major, self.rings = delta, (ph_delta, threshold), max(40, baseline), bins, major, rings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hits, self.errors = _Ring(handle, "hits", self.rings[0]), _Ring(handle, "errors", self.rings[1])
        bucket = "n array<long>, s array<double>, lo array<double>, hi array<double>"
        self.adwin = [handle.getValueState(f"adwin_{of}", bucket) for of in ("hits", "errors")]
        self.walk = handle.getValueState("page_hinkley", "n long, mean double, up double, down double")
        self.frozen = handle.getValueState("baseline", "x array<double>")
        self.checked = handle.getValueState("checked", "n long")

    def _histogram(self, state) -> AdwinHistogram:
        return AdwinHistogram(self.delta, buckets=list(zip(*state.get(), strict=True)) if state.exists() else ())

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        (n_hits, hits), (n_errors, errors) = self.hits.read(), self.errors.read()
        adwin = [self._histogram(x) for x in self.adwin]
        ph = PageHinkley(*self.ph)
        if self.walk.exists():
            ph.n, ph.mean, ph.up, ph.down = self.walk.get()
        baseline = np.array(self.frozen.get()[0]) if self.frozen.exists() else None
        checked = self.checked.get()[0] if self.checked.exists() else 0
        share, size = WATCHED.get(key[2], (False, False))
        new_hits, new_errors, out = [], [], []
        frame = pd.concat(list(rows)).sort_values("t", kind="stable")
        for t, hit, error in zip(frame["t"].tolist(), frame["hit"].tolist(), frame["abs_error"].tolist(), strict=True):
            found = []
            if share and hit is not None and hit == hit:
                new_hits.append(float(hit))
                if adwin[0].push(float(hit)):
                    found.append(("accuracy-adwin" if key[2] == "direction" else "coverage-adwin", None))
            if size and error is not None and np.isfinite(error):
                new_errors.append(float(error))
                if key[2] == "return" and adwin[1].push(float(error)):
                    found.append(("residual-adwin", None))
                if ph.push(float(error)):
                    found.append(("residual-pagehinkley", None))
                n = n_errors + len(new_errors)
                if baseline is None and n >= self.baseline:
                    baseline = np.array((errors + new_errors)[-self.rings[1] :])
                    self.frozen.update((baseline.tolist(),))
                    checked = n
                elif baseline is not None and n - checked >= max(20, self.baseline // 4):
                    checked = n
                    value = psi(baseline, np.array((errors + new_errors)[-self.baseline :]), self.bins)
                    if value > self.major:
                        found.append(("residual-psi", value))
            if found:
                own, past = (hits + new_hits)[-self.rings[0] :], (errors + new_errors)[-self.rings[1] :]
                kpis = (float(np.mean(own)) if own else None, len(own), float(np.mean(past)) if past else None, float(np.std(past, ddof=1)) if len(past) > 1 else None)
                out += [(*key, t, cause, value, *kpis) for cause, value in found]
        self.hits.append(n_hits, new_hits)
        self.errors.append(n_errors, new_errors)
        for state, own in zip(self.adwin, adwin, strict=True):
            if own.buckets:
                state.update(tuple(map(list, zip(*own.buckets, strict=True))))
            else:
                state.clear()
        self.walk.update((ph.n, ph.mean, ph.up, ph.down))
        self.checked.update((checked,))
        if out:
            yield pd.DataFrame(out, columns=["symbol", "tf", "kind", "t", "cause", "psi", "share", "n", "mean_error", "sd_error"])

    def close(self) -> None:
        pass


def stream_drift(gradings: DataFrame, delta: float = 0.002, ph_delta: float = 0.005, threshold: float = 0.05, baseline: int = 200, bins: int = 10, major: float = 0.25, rings: tuple[int, int] = (200, 500)) -> DataFrame:
    """Drift alarms over a stream of gradings (symbol, tf, kind, t, hit, abs_error), for each series and kind.

    Watched are the share of hits (of direction, interval and set) by ADWIN, errors (of return and interval) by
    Page-Hinkley, those of return by ADWIN too, and errors against their first ``baseline``, once in a while, by PSI.
    A row for each alarm: cause, psi where it is one, and share, its count, mean and deviation of the errors in the rings.
    Rows of a batch count in order of t. Null hits (abstentions) and errors that aren't finite count for nothing.
    State: two rings, two histograms of a logarithm of the window, four sums and the baseline.
    """
    schema = "symbol string, tf string, kind string, t long, cause string, psi double, share double, n int, mean_error double, sd_error double"
    rows = gradings.select(*SERIES, "kind", "t", F.col("hit").cast("double").alias("hit"), F.col("abs_error").cast("double").alias("abs_error"))
    return rows.groupBy(*SERIES, "kind").transformWithStateInPandas(_Drift(delta, ph_delta, threshold, baseline, bins, major, rings), schema, "append", "None")
