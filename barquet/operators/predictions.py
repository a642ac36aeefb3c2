"""Grading predictions against realised bars, summaries, drift detectors, stability and mistakes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.series import SERIES, clamp, plus, step_ms, with_columns


def realized_direction(ret: Column, band: float = 0.0) -> Column:
    return F.when(ret > band, "up").when(ret < -band, "down").otherwise("flat")


def validate_predictions(preds: DataFrame, bars: DataFrame, band: float = 0.0) -> DataFrame:
    """Verdict columns for each prediction (symbol, tf, t, kind, dir, prob, yhat, sigma, lo, hi, classes), from the bar after t.

    kinds: direction (hit, abstain, brier), return (residual, abs_error, z), interval (covered,
    width), set (covered, set_size, abstain). A missing bar: missing true and no verdict. An
    impossible payload: ok false.
    """
    target = bars.select(*[F.col(k).alias(f"_{k}") for k in SERIES], F.col("t").alias("_t"), F.col("o").alias("_o"), F.col("c").alias("_c"))
    out = preds.join(target, (F.col("symbol") == F.col("_symbol")) & (F.col("tf") == F.col("_tf")) & (F.col("t") + step_ms(F.col("tf")) == F.col("_t")), "left")
    ret = F.when(F.col("_o") != 0, F.col("_c") / F.col("_o") - 1)
    out = out.withColumns({"missing": F.col("_t").isNull(), "realized": ret}).withColumn("realized_dir", F.when(F.col("realized").isNotNull(), realized_direction(F.col("realized"), band)))
    kind = F.col("kind")
    good = F.when(kind == "direction", F.col("dir").isin("up", "down", "flat")).when(kind == "return", F.col("yhat").isNotNull()).when(kind == "interval", F.col("lo") <= F.col("hi")).when(kind == "set", F.col("classes").isNotNull())
    out = out.withColumn("ok", ~F.col("missing") & F.col("realized").isNotNull() & F.coalesce(good, F.lit(False)))
    of = lambda k, x: F.when(F.col("ok") & (kind == k), x)
    hit = of("direction", (F.col("dir") != "flat") & (F.col("dir") == F.col("realized_dir")))
    out = out.withColumn("hit", hit)
    residual = F.col("realized") - F.col("yhat")
    key = F.when(F.col("realized_dir") == "up", "long").when(F.col("realized_dir") == "down", "short").otherwise(F.col("realized_dir"))
    covered = of("interval", F.col("realized").between(F.col("lo"), F.col("hi")))
    return out.withColumns({
        "brier": F.when(F.col("prob").isNotNull(), F.pow(F.col("prob") - F.col("hit").cast("double"), F.lit(2))),
        "abstain": F.coalesce(of("direction", F.col("dir") == "flat"), of("set", F.size("classes") == 0)),
        "residual": of("return", residual), "abs_error": of("return", F.abs(residual)), "z": of("return", F.when(F.col("sigma") > 0, residual / F.col("sigma"))),
        "covered": F.coalesce(covered, of("set", F.array_contains("classes", key) | F.array_contains("classes", F.col("realized_dir")))),
        "width": of("interval", F.col("hi") - F.col("lo")), "set_size": of("set", F.size("classes")),
    }).drop("_symbol", "_tf", "_t", "_o", "_c")


def summarize_verdicts(verdicts: DataFrame) -> DataFrame:
    """One row by (symbol, tf), by symbol, and over all (nulls): accuracy, errors, coverage and Brier of each kind."""
    kind = F.col("kind")
    sure = (kind == "direction") & ~F.col("abstain")
    num = lambda x: F.col(x).cast("double")
    return verdicts.filter("ok").rollup(*SERIES).agg(
        F.count("*").alias("n"), F.count_if(kind == "direction").alias("n_direction"), F.count_if((kind == "direction") & F.col("abstain")).alias("n_abstain"),
        F.avg(F.when(sure, num("hit"))).alias("accuracy"), F.avg("abs_error").alias("mae"), F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("rmse"), F.avg("residual").alias("mean_residual"),
        F.avg(F.when(kind == "interval", num("covered"))).alias("interval_coverage"), F.avg("width").alias("mean_width"),
        F.avg(F.when(kind == "set", num("covered"))).alias("set_coverage"), F.avg("set_size").alias("mean_set_size"), F.avg("brier").alias("brier"),
    )


def classify_error(verdicts: DataFrame, large: float = 2.0) -> DataFrame:
    """Keep the failures and add error_type: direction, interval-miss, set-miss, magnitude (|z| over ``large``)."""
    kind = F.col("kind")
    error = F.when((kind == "direction") & ~F.col("hit") & ~F.col("abstain"), "direction").when((kind == "interval") & ~F.col("covered"), "interval-miss").when((kind == "set") & ~F.col("covered"), "set-miss").when((kind == "return") & (F.abs("z") > large), "magnitude")
    return verdicts.filter("ok").withColumn("error_type", error).filter("error_type is not null")


def to_mistakes(verdicts: DataFrame, contexts: DataFrame, modules: DataFrame | None = None, large: float = 2.0) -> DataFrame:
    """``classify_error``'s rows with what was known when the prediction was made.

    ``contexts``: (symbol, tf, t, and any of regime, phase, macro, atr14, vec), a row a bar; ``modules``: ``reports.top_modules``, which
    become top_modules, an array of (rank, module, signal, confidence). Mistakes without a context keep nulls.
    """
    out = classify_error(verdicts, large).join(contexts, [*SERIES, "t"], "left")
    if modules is None:
        return out
    top = modules.groupBy(*SERIES, "t").agg(F.array_sort(F.collect_list(F.struct("rank", "module", "signal", "confidence"))).alias("top_modules"))  # four a bar
    return out.join(top, [*SERIES, "t"], "left")


def mistake_summary(mistakes: DataFrame) -> DataFrame:
    """Counts by error type, by symbol, and in all; last_t is the newest of each."""
    return mistakes.groupingSets([[F.col("error_type")], [F.col("symbol")], []], "error_type", "symbol").agg(F.count("*").alias("n"), F.max("t").alias("last_t"))


def rolling_accuracy(verdicts: DataFrame, n: int = 200) -> DataFrame:
    """Accuracy and residual statistics over the last n gradings of each series, in time order."""
    w = Window.partitionBy(*SERIES).orderBy("t").rowsBetween(1 - n, 0)
    return verdicts.withColumns({"acc": F.avg(F.col("hit").cast("double")).over(w), "res_mean": F.avg("residual").over(w), "res_std": F.stddev_samp("residual").over(w)})


@lru_cache(2048)
def _cuts(n: int, least: int, delta: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where a window of ``n`` values may be cut, what is left behind each cut, and the bound of each but for the values' spread."""
    cut = np.arange(least, n - least + 1)
    return cut, n - cut, np.sqrt(np.log(4 * n / delta) * (1 / cut + 1 / (n - cut)) / 2)


class Adwin:
    """A window of recent values that drops its older part when the means of two parts differ too much."""

    def __init__(self, delta: float = 0.002, most: int = 2048, least: int = 16) -> None:
        self.delta, self.most, self.least = delta, most, least
        self._hold(np.zeros(0))

    @property
    def values(self) -> np.ndarray:
        return self._values[: self._n]

    def _hold(self, values: np.ndarray) -> None:
        """Take these values as the window, with their running sums and bounds; both grow by themselves until values go."""
        n = self._n = len(values)
        self._values, self._sums = np.empty(2 * n + 64), np.empty(2 * n + 64)
        self._values[:n], self._sums[:n] = values, np.cumsum(values)
        self._low, self._high = (float(values.min()), float(values.max())) if n else (np.inf, -np.inf)

    def push(self, x: float) -> bool:
        n = self._n
        if n >= self.most:
            self._hold(np.append(self.values, x)[-self.most :])
        else:
            if n == len(self._values):
                self._hold(self.values)
            self._values[n], self._sums[n] = x, self._sums[n - 1] + x if n else x
            self._low, self._high = x if x < self._low or x != x else self._low, x if x > self._high or x != x else self._high
            self._n = n + 1
        n = self._n
        if n < 2 * self.least:
            return False
        cut, rest, bound = _cuts(n, self.least, self.delta)
        before = self._sums[self.least - 1 : n - self.least]
        hits = np.abs(before / cut - (self._sums[n - 1] - before) / rest) > (self._high - self._low) * bound
        if not hits.any():
            return False
        self._hold(self.values[cut[hits.argmax()] :].copy())
        return True


class PageHinkley:
    """Two-sided cumulative deviation from the running mean; starts anew after each alarm."""

    def __init__(self, delta: float = 0.005, threshold: float = 0.05) -> None:
        self.delta, self.threshold = delta, threshold
        self.n, self.mean, self.up, self.down = 0, 0.0, 0.0, 0.0

    def push(self, x: float) -> str | None:
        self.n += 1
        self.mean += (x - self.mean) / self.n
        self.up = max(0.0, self.up + x - self.mean - self.delta)
        self.down = max(0.0, self.down + self.mean - x - self.delta)
        side = "up" if self.up > self.threshold else "down" if self.down > self.threshold else None
        if side:
            self.n, self.mean, self.up, self.down = 0, 0.0, 0.0, 0.0
        return side


def drift(df: DataFrame, keys: list[str], value: str = "x", order: str = "t", delta: float = 0.002, ph_delta: float = 0.005, ph_threshold: float = 0.05) -> DataFrame:
    """Add adwin (a cut was made) and page_hinkley (up, down or null) after each value, by key in order."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(order)
        adwin, ph = Adwin(delta), PageHinkley(ph_delta, ph_threshold)
        x = rows[value].to_pylist()
        known = [v is not None and v == v for v in x]
        cuts = [k and adwin.push(v) for k, v in zip(known, x, strict=True)]
        return with_columns(rows, {"adwin": pa.array(cuts, pa.bool_()), "page_hinkley": pa.array([ph.push(v) if k else None for k, v in zip(known, x, strict=True)], pa.string())})

    return df.groupBy(*keys).applyInArrow(run, plus(df.schema, "adwin boolean, page_hinkley string"))


def stability(history: DataFrame, n: int = 30) -> DataFrame:
    """(symbol, tf, n, bias_stability, direction_stability, interval_stability, score, label) of the last n decisions (bias, direction, width)."""
    rank = Window.partitionBy(*SERIES).orderBy(F.desc("t"))
    w = Window.partitionBy(*SERIES).orderBy("t")
    tail = history.withColumn("_r", F.row_number().over(rank)).filter(F.col("_r") <= n).withColumn("_d", F.signum("direction")).withColumn("_p", F.lag("_d").over(w))
    live = (F.col("_d") != 0) & (F.col("_p") != 0)
    out = tail.groupBy(*SERIES).agg(
        F.count("*").alias("n"), F.coalesce(F.stddev_samp("bias"), F.lit(0.0)).alias("_sd"), F.coalesce(F.avg(F.when(live, (F.col("_d") != F.col("_p")).cast("double"))), F.lit(0.0)).alias("_flips"),
        F.count("width").alias("_nw"), F.min_by("width", F.when(F.col("width").isNotNull(), F.col("t"))).alias("_w0"), F.max_by("width", F.when(F.col("width").isNotNull(), F.col("t"))).alias("_w1"),
    )
    growth = F.when(F.col("_w0") > 0, F.greatest(F.lit(0.0), (F.col("_w1") - F.col("_w0")) / F.col("_w0"))).otherwise(0.0)
    out = out.withColumns({"bias_stability": clamp(1 - F.col("_sd") / 0.5, 0, 1), "direction_stability": clamp(1 - F.col("_flips"), 0, 1), "interval_stability": F.when(F.col("_nw") >= 3, clamp(1 - growth, 0, 1)).otherwise(0.5)})
    score = F.when(F.col("n") < 3, 0.0).otherwise(0.4 * F.col("bias_stability") + 0.4 * F.col("direction_stability") + 0.2 * F.col("interval_stability"))
    label = F.when(F.col("n") < 3, "unknown").when(F.col("score") >= 0.7, "stable").when(F.col("score") >= 0.45, "moderate").otherwise("volatile")
    return out.withColumn("score", score).withColumn("label", label).drop("_sd", "_flips", "_nw", "_w0", "_w1")


def tag_events(bars: DataFrame, calendar: DataFrame, pre_ms: int = 300_000, post_ms: int = 1_800_000) -> DataFrame:
    """Bars with event_id, impact and phase (pre, during, post) of the earliest event whose window holds them; null without.

    ``calendar``: (id, at, duration_ms, impact). Windows and bars meet by day, so the join is an equi-join
    whatever the sizes. Equal bars stay as many.
    """
    day = 86_400_000
    end = F.col("at") + F.coalesce("duration_ms", F.lit(0))
    cal = calendar.select(F.col("id").alias("event_id"), "at", end.alias("_end"), "impact")
    cal = cal.withColumn("_day", F.explode(F.sequence(F.floor((F.col("at") - pre_ms) / day), F.floor((F.col("_end") + post_ms) / day))))
    counted = bars.groupBy(*bars.columns).agg(F.count("*").alias("_times"))
    on = (F.floor(F.col("t") / day) == F.col("_day")) & (F.col("t") >= F.col("at") - pre_ms) & (F.col("t") <= F.col("_end") + post_ms)
    first = counted.join(cal, on, "left").groupBy(*bars.columns, "_times").agg(F.min(F.struct("at", "event_id", "_end", "impact")).alias("e"))
    first = first.withColumn("_time", F.explode(F.sequence(F.lit(1).cast("long"), "_times")))
    phase = F.when(F.col("t") >= F.col("e._end"), "post").when(F.col("t") >= F.col("e.at"), "during").when(F.col("e.at").isNotNull(), "pre")
    return first.select(*bars.columns, F.col("e.event_id").alias("event_id"), F.col("e.impact").alias("impact"), phase.alias("phase"))


def nearest_in_time(left: DataFrame, right: DataFrame, keys: list[str], within_ms: int, columns: list[str]) -> DataFrame:
    """Each left row with ``columns`` of the right row nearest to its t, at most ``within_ms`` away; ties go to the later.

    Rows meet in buckets of ``within_ms`` and those beside, so the join is an equi-join.
    """
    bucket = lambda t: F.floor(F.col(t) / within_ms)
    r = right.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("t").alias("_t"), *[F.col(c).alias(f"_c_{c}") for c in columns]).withColumn("_b", F.explode(F.array(bucket("_t") - 1, bucket("_t"), bucket("_t") + 1)))
    own = left.columns
    left = left.groupBy(*own).agg(F.count("*").alias("_times")).withColumn("_row", F.struct(*own, "_times"))  # equal rows stay as many
    on = [F.col(k) == F.col(f"_{k}") for k in keys] + [bucket("t") == F.col("_b"), F.abs(F.col("t") - F.col("_t")) <= within_ms]
    best = left.join(r, on, "left").groupBy("_row").agg(F.min_by(F.struct("_t", *[f"_c_{c}" for c in columns]), F.struct(F.abs(F.col("t") - F.col("_t")), -F.col("_t"))).alias("_n"))
    best = best.withColumn("_time", F.explode(F.sequence(F.lit(1).cast("long"), "_row._times")))
    return best.select(*[f"_row.{c}" for c in own], F.col("_n._t").alias("near_t"), *[F.col(f"_n._c_{c}").alias(f"near_{c}") for c in columns])
