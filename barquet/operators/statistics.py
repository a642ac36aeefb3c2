"""Statistics of series and predictions: correlation, drift, calibration, conformal intervals, weights."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import ranks
from ..functions.series import SERIES, clamp, in_order, index, settled
from .indicators import log_return


def returns(bars: DataFrame) -> DataFrame:
    return bars.select(*SERIES, "t", log_return().alias("r")).filter("r is not null")


#: Returns of a block's series at most, about, of which a task of all pairs holds two; and least parts of all symbols.
BLOCK_RETURNS, BLOCKS = 8_000_000, 6
#: Symbols of each side and different times that a task lays out at once.
BLOCK_SYMBOLS, BLOCK_TIMES = 2048, 512


def _relation(tf: Column, a: Column, b: Column, n: Column, vx: Column, vy: Column, c: Column) -> list[Column]:
    flat = (vx < 1e-18) | (vy < 1e-18)
    return [tf, a, b, n, F.when(flat, 0.0).otherwise(c / F.sqrt(vx * vy)).alias("corr"), F.when(vy < 1e-18, 0.0).otherwise(c / vy).alias("beta")]


def correlation_matrix(rets: DataFrame, bases: list[str] | None = None) -> DataFrame:
    """(tf, a, b, n, corr, beta) of each pair of symbols a < b, over the times that both have.

    With ``bases`` a runs over these symbols alone and b over all others, which many symbols need: all
    pairs grow with their square. Under three common times there is no row; without variance corr and beta are 0.

    All pairs are the cells of two blocks of symbols: a task gets the series of both, packed, and multiplies them, so a return
    travels once a block and no row of two returns is ever made. A block has as many symbols as a task can hold the returns of.
    """
    if bases is not None:
        one, other = rets.select("tf", "t", F.col("symbol").alias("a"), F.col("r").alias("x")).filter(F.col("a").isin(bases)), rets.select("tf", "t", F.col("symbol").alias("b"), F.col("r").alias("y"))
        by = one.join(other, ["tf", "t"]).filter("a != b").groupBy("tf", "a", "b")
        out = by.agg(F.count("*").alias("n"), F.var_pop("x").alias("_vx"), F.var_pop("y").alias("_vy"), F.covar_pop("x", "y").alias("_c")).filter("n >= 3")
        return out.select(*_relation(*map(F.col, ("tf", "a", "b", "n", "_vx", "_vy", "_c"))))
    kept = rets.filter("r is not null and t is not null and symbol is not null and tf is not null")
    lists = kept.groupBy(*SERIES).agg(F.collect_list(F.struct("t", "r")).alias("p")).select(*SERIES, F.col("p.t").alias("t"), F.col("p.r").alias("r"))
    series = settled(lists.mapInArrow(_packed, "symbol string, tf string, n long, t0 long, step long, body binary"))
    held = series.groupBy("tf").agg(F.sum("n").alias("held")).agg(F.max("held")).first()[0] or 0
    cores = rets.sparkSession.sparkContext.defaultParallelism
    blocks = max(BLOCKS, math.isqrt(2 * cores), -(-held // BLOCK_RETURNS))
    own = F.pmod(F.xxhash64("symbol"), F.lit(blocks)).cast("int")
    dealt = series.withColumn("_own", own).withColumn("_with", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    cells = dealt.withColumns({"_i": F.least("_own", "_with"), "_j": F.greatest("_own", "_with")}).drop("_with")
    # a cell's number names its task, so that cells don't meet by the chance of a hash
    number = (F.col("_i") * blocks - F.floor(F.col("_i") * (F.col("_i") - 1) / 2) + F.col("_j") - F.col("_i")).cast("int")
    tasks = min(blocks * (blocks + 1) // 2, 20_000)
    placed = cells.repartitionById(tasks, F.pmod(number, F.lit(tasks)).cast("int")).sortWithinPartitions("tf", "_i", "_j")
    found = placed.mapInArrow(_cells, "tf string, a string, b string, n long, vx double, vy double, c double")
    return found.select(*_relation(*map(F.col, ("tf", "a", "b", "n", "vx", "vy", "c"))))


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of each cell (tf, _i, _j) of a task, cells being stretches of its rows."""
    cell, rows = None, []
    for batch in batches:
        for row in _rows(batch):
            if row[0] != cell:
                yield from _pairs(cell, rows)
                cell, rows = row[0], []
            rows.append(row[1:])
    yield from _pairs(cell, rows)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(symbol, tf, n, t0, step, body) of each series (t, r): its times, in order, as steps from the first, and its returns, compressed byte by byte of all values."""
    for batch in batches:
        made = []
        for t, r in zip(batch["t"], batch["r"], strict=True):
            t, r = t.values.to_numpy(), r.values.to_numpy(zero_copy_only=False)
            order = np.argsort(t, kind="stable")
            apart = np.diff(t[order], prepend=t[order[0]])
            step = max(1, int(np.gcd.reduce(apart)))
            both = np.stack([apart // step, r[order].view(np.int64)])
            made.append((len(t), int(t[order[0]]), step, pa.compress(both.view(np.uint8).reshape(2, -1, 8).transpose(0, 2, 1).tobytes(), codec="zstd", asbytes=True)))
        packed = [pa.array([x[k] for x in made], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
        yield pa.RecordBatch.from_arrays([batch["symbol"], batch["tf"], *packed], ["symbol", "tf", "n", "t0", "step", "body"])


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """((tf, _i, _j), symbol, _own, times, returns) of each row, the last two as arrays."""
    columns = (batch[k].to_pylist() for k in ("symbol", "tf", "_own", "_i", "_j", "n", "t0", "step"))
    for symbol, tf, own, i, j, n, t0, step, body in zip(*columns, batch["body"], strict=True):
        planes = np.frombuffer(pa.decompress(body.as_buffer(), decompressed_size=16 * n, codec="zstd"), np.uint8).reshape(2, 8, n)
        both = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.int64).reshape(2, n)
        yield (tf, i, j), symbol, own, t0 + step * np.cumsum(both[0]), both[1].view(np.float64).copy()


def _pairs(cell: tuple | None, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """(tf, a, b, n, vx, vy, c) of the pairs of two blocks, by tiles of ``BLOCK_SYMBOLS`` symbols of each."""
    if cell is None:
        return
    tf, first, second = cell
    rows.sort(key=lambda x: x[0])
    names, owns = pa.array([x[0] for x in rows], pa.string()), [x[1] for x in rows]
    times = np.zeros(0, np.int64)
    for k in range(0, len(rows), 1000):
        times = np.unique(np.concatenate([times, *[x[2] for x in rows[k : k + 1000]]]))
    at, values, bad = [], [], []
    for k, (_, _, t, r) in enumerate(rows):
        rows[k] = None  # a cell's series are held once
        at.append(np.searchsorted(times, t).astype(np.int32))
        b = ~np.isfinite(r)
        if b.any():
            r = np.where(b, 0.0, r - (r[~b].mean() if not b.all() else 0.0))
        else:
            r -= r.mean()
            b = None
        values.append(r)
        bad.append(b)
    left = [k for k, own in enumerate(owns) if own == first]
    right = [k for k, own in enumerate(owns) if own == second]
    tiles = lambda side: [side[k : k + BLOCK_SYMBOLS] for k in range(0, len(side), BLOCK_SYMBOLS)]
    for k, x in enumerate(tiles(left)):
        for y in tiles(right)[k if first == second else 0 :]:
            yield from _tile(tf, names, len(times), at, values, bad, x, y)


def _tile(tf: str | None, names: pa.Array, n_times: int, at: list[np.ndarray], values: list[np.ndarray], bad: list[np.ndarray | None], left: list[int], right: list[int]) -> Iterator[pa.RecordBatch]:
    """(tf, a, b, n, vx, vy, c) of the pairs of ``left`` and ``right``, or of all of ``left`` if they are the same: sums over common times as products of matrices of symbols by times.

    Returns count from their series' mean, which changes neither variance nor covariance. Where next to nothing is left
    of the squares, the pair is taken again from its own times.
    """

    def laid(chosen: list[int], low: int) -> tuple[np.ndarray, ...]:
        """Counts, values, squares and unknown values of these series at the times from ``low`` on."""
        span = min(BLOCK_TIMES, n_times - low)
        out = np.zeros((4, len(chosen), span))
        for line, k in enumerate(chosen):
            begin, end = np.searchsorted(at[k], (low, low + span))
            here, x = at[k][begin:end] - low, values[k][begin:end]
            for plane, what in enumerate((np.ones(len(x)), x, x * x, *(() if bad[k] is None else (bad[k][begin:end],)))):
                np.add.at(out[plane, line], here, what)
        return out

    same = left == right
    n, sx, sy, sxx, syy, sxy = (np.zeros((len(left), len(right))) for _ in range(6))
    unknown_x = unknown_y = None
    if any(bad[k] is not None for k in (*left, *right)):
        unknown_x, unknown_y = np.zeros_like(n), np.zeros_like(n)
    for low in range(0, n_times, BLOCK_TIMES):
        p, x, xx, bx = laid(left, low)
        q, y, yy, by = (p, x, xx, bx) if same else laid(right, low)
        n += p @ q.T
        sx += x @ q.T
        sy += p @ y.T
        sxx += xx @ q.T
        syy += p @ yy.T
        sxy += x @ y.T
        if unknown_x is not None:
            unknown_x += bx @ q.T
            unknown_y += p @ by.T
    left, right = np.array(left, np.int64), np.array(right, np.int64)
    step = max(1, 100_000 // max(1, len(right)))
    for top in range(0, len(left), step):
        part = slice(top, top + step)
        fine = n[part] >= 3
        if same:
            fine &= left[part, None] < right[None, :]
        i, j = np.nonzero(fine)
        if not len(i):
            continue
        count = n[part][i, j]
        mean_x, mean_y = sx[part][i, j] / count, sy[part][i, j] / count
        square_x, square_y = sxx[part][i, j] / count, syy[part][i, j] / count
        vx, vy, c = np.maximum(square_x - mean_x**2, 0), np.maximum(square_y - mean_y**2, 0), sxy[part][i, j] / count - mean_x * mean_y
        i, j = left[part][i], right[j]
        for k in np.flatnonzero((vx < 1e-6 * square_x) | (vy < 1e-6 * square_y)):
            vx[k], vy[k], c[k] = _anew(at[i[k]], values[i[k]], at[j[k]], values[j[k]])
        if unknown_x is not None:
            ux, uy = unknown_x[part][fine] > 0, unknown_y[part][fine] > 0
            vx, vy, c = np.where(ux, np.nan, vx), np.where(uy, np.nan, vy), np.where(ux | uy, np.nan, c)
        turned = i > j  # a is the lesser name
        i, j, vx, vy = np.where(turned, j, i), np.where(turned, i, j), np.where(turned, vy, vx), np.where(turned, vx, vy)
        yield pa.RecordBatch.from_arrays([pa.array([tf]).take(pa.array(np.zeros(len(i), np.int64))), names.take(pa.array(i)), names.take(pa.array(j)), pa.array(count.astype(np.int64)), pa.array(vx), pa.array(vy), pa.array(c)], ["tf", "a", "b", "n", "vx", "vy", "c"])


def _anew(at: np.ndarray, x: np.ndarray, other: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Variances and covariance over the common times, from differences to their means; times that repeat meet each other."""
    order = np.argsort(other, kind="stable")
    begin, end = np.searchsorted(other[order], at, "left"), np.searchsorted(other[order], at, "right")
    i = np.repeat(np.arange(len(at)), end - begin)
    j = order[np.concatenate([np.arange(b, e) for b, e in zip(begin, end, strict=True)])]
    x, y = x[i], y[j]
    dx, dy = (np.zeros_like(v) if np.ptp(v) == 0 else v - v.mean() for v in (x, y))
    return float((dx * dx).mean()), float((dy * dy).mean()), float((dx * dy).mean())


def autocorrelation(rets: DataFrame) -> DataFrame:
    """(symbol, tf, autocorr): correlation of each return with the one before."""
    return rets.withColumn("_p", F.lag("r").over(in_order())).groupBy(*SERIES).agg(F.corr("r", "_p").alias("autocorr"))


def relative_strength(bars: DataFrame, base: str, n: int = 20) -> DataFrame:
    """(symbol, tf, t, rel): return over n bars less the base's at the same time."""
    over = bars.withColumn("_r", F.col("c") / F.lag("c", n).over(in_order()) - 1).filter("_r is not null").select(*SERIES, "t", "_r")
    ref = over.filter(F.col("symbol") == base).select("tf", "t", F.col("_r").alias("_b"))
    return over.filter(F.col("symbol") != base).join(ref, ["tf", "t"]).select(*SERIES, "t", (F.col("_r") - F.col("_b")).alias("rel"))


def psi(baseline: DataFrame, live: DataFrame, keys: list[str], value: str = "x", bins: int = 10, eps: float = 1e-6) -> DataFrame:
    """(keys, psi, level): population stability index over equal-frequency bins of the baseline.

    Bin edges are baseline order statistics, repeats removed; shares get ``eps``. A key needs rows
    of both sides. level: stable under 0.1, shift under 0.25, else major.
    """
    at = F.array(*[F.floor(F.lit(b / bins) * F.col("n")) for b in range(1, bins)])
    wanted = ranks.group_sizes(baseline, keys, value).select(*keys, F.explode(F.array_distinct(at)).alias("rank"))
    edges = ranks.order_statistics(baseline, keys, value, wanted).groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias("_edges"))

    def shares(df: DataFrame, name: str) -> DataFrame:
        bucket = F.size(F.filter("_edges", lambda e: e < F.col(value)))
        counts = df.filter(F.col(value).isNotNull()).join(edges, keys).groupBy(*keys, bucket.alias("_b")).agg(F.count("*").alias("_k"))
        return counts.withColumn(name, F.col("_k") / F.sum("_k").over(Window.partitionBy(*keys))).drop("_k")

    grid = edges.select(*keys, F.explode(F.sequence(F.lit(0), F.size("_edges"))).alias("_b"))
    both = baseline.select(*keys).distinct().join(live.select(*keys).distinct(), keys, "left_semi")
    out = grid.join(both, keys, "left_semi").join(shares(baseline, "_p"), [*keys, "_b"], "left").join(shares(live, "_q"), [*keys, "_b"], "left")
    p, q = F.coalesce("_p", F.lit(0.0)) + eps, F.coalesce("_q", F.lit(0.0)) + eps
    out = out.groupBy(*keys).agg(F.sum((q - p) * F.ln(q / p)).alias("psi"))
    return out.withColumn("level", F.when(F.col("psi") < 0.1, "stable").when(F.col("psi") < 0.25, "shift").otherwise("major"))


def ks_two_sample(a: DataFrame, b: DataFrame, keys: list[str], value: str = "x") -> DataFrame:
    """(keys, n_a, n_b, d, p): largest distance of the two distribution functions, and its asymptotic p-value."""
    both = a.select(*keys, F.col(value).alias("_x"), F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(*keys, F.col(value).alias("_x"), F.lit(0).alias("_a"), F.lit(1).alias("_b"))).filter("_x is not null")
    steps = ranks.running_counts(both, keys, "_x", ["_a", "_b"]).filter("n__a > 0 and n__b > 0")
    out = steps.groupBy(*keys).agg(F.max("n__a").alias("n_a"), F.max("n__b").alias("n_b"), F.max(F.abs(F.col("c__a") / F.col("n__a") - F.col("c__b") / F.col("n__b"))).alias("d"))
    n = F.sqrt(F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b")))
    lam = (n + 0.12 + 0.11 / n) * F.col("d")
    series = functools.reduce(lambda acc, j: acc + (2 if j % 2 else -2) * F.exp(-2.0 * j * j * lam * lam), range(1, 101), F.lit(0.0))
    return out.withColumn("p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(lam < 0.2, 1.0).otherwise(series))))


def calibration_bins(df: DataFrame, keys: list[str], p: str = "p", y: str = "y", bins: int = 10) -> DataFrame:
    """(keys, bin, n, predicted, observed) of equal-width bins of probability."""
    b = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(F.col(p) * bins))).cast("int")
    return df.groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("predicted"), F.avg(F.col(y).cast("double")).alias("observed"))


def calibration_report(df: DataFrame, keys: list[str], p: str = "p", y: str = "y", bins: int = 10) -> DataFrame:
    """(keys, n, ece, brier, log_loss)."""
    q = F.least(F.lit(1 - 1e-12), F.greatest(F.lit(1e-12), F.col(p)))
    loss = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.pow(F.col(p) - F.col(y), F.lit(2))).alias("brier"), F.avg(-(F.col(y) * F.ln(q) + (1 - F.col(y)) * F.ln(1 - q))).alias("log_loss"))
    ece = calibration_bins(df, keys, p, y, bins).groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("predicted") - F.col("observed"))) / F.sum("n")).alias("ece"))
    return loss.join(ece, keys) if keys else loss.crossJoin(F.broadcast(ece))  # one row each


def conformal_quantiles(scores: DataFrame, keys: list[str], score: str = "score", alpha: float = 0.1) -> DataFrame:
    """(keys, n, q): the ceil((n + 1)(1 - alpha))-th smallest score, infinite where that is beyond n."""
    sizes = ranks.group_sizes(scores, keys, score).withColumn("rank", F.ceil((F.col("n") + 1) * F.lit(1 - alpha) - 1e-9) - 1)
    found = ranks.order_statistics(scores, keys, score, sizes.select(*keys, "rank"))
    return sizes.join(found, [*keys, "rank"], "left").select(*keys, "n", F.coalesce(score, F.lit(float("inf"))).alias("q"))


def fit_conformal(calibration: DataFrame, keys: list[str], normalized: bool = False, alpha: float = 0.1) -> DataFrame:
    """(keys, n, q) of ``calibration`` (yhat, y, and sigma if normalized): the conformal quantile of |y - yhat|, or of that over sigma.

    Rows whose score is null, nan or infinite don't count.
    """
    score = F.abs(F.col("y") - F.col("yhat"))
    score = score / _scale() if normalized else score
    known = calibration.withColumn("_score", score).filter(~F.isnan("_score") & (F.col("_score") < float("inf")))
    return conformal_quantiles(known, keys, "_score", alpha)


def _scale() -> Column:
    return F.greatest(F.abs(F.coalesce("sigma", F.lit(0.0))), F.lit(1e-8))


def conformal_interval(df: DataFrame, fitted: DataFrame, keys: list[str], normalized: bool = False) -> DataFrame:
    """``df`` (yhat, and sigma if normalized) with q, lo, hi and width of its key's ``fitted`` quantile; without one nothing is known: infinite."""
    out = (df.join(fitted.select(*keys, "q"), keys, "left") if keys else df.crossJoin(F.broadcast(fitted.select("q")))).withColumn("q", F.coalesce("q", F.lit(float("inf"))))
    half = F.col("q") * _scale() if normalized else F.col("q")
    return out.withColumns({"lo": F.col("yhat") - half, "hi": F.col("yhat") + half, "width": 2 * half})


def fit_prediction_set(calibration: DataFrame, keys: list[str], alpha: float = 0.1) -> DataFrame:
    """(keys, n, q) of ``calibration`` (p of up, y 0 or 1): the conformal quantile of one less the probability of what came. See ``features.prediction_sets``."""
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p"))))
    known = calibration.filter(F.col("y").isin(0, 1) & F.col("p").isNotNull() & ~F.isnan("p"))
    return conformal_quantiles(known.withColumn("_score", 1 - p), keys, "_score", alpha)


def coverage(df: DataFrame, keys: list[str], y: str = "y", lo: str = "lo", hi: str = "hi") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.when(F.col(y).between(F.col(lo), F.col(hi)), 1.0).otherwise(0.0)).alias("coverage"), F.avg(F.col(hi) - F.col(lo)).alias("mean_width"))


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Bounds of a share's interval."""
    p = hits / n
    mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(n > 0, (mid - half) / (1 + z * z / n)), F.when(n > 0, (mid + half) / (1 + z * z / n))


def uniqueness_weights(labels: DataFrame) -> DataFrame:
    """(symbol, tf, i, weight) of spans [i, t1] (columns i and t1, bar positions): mean of 1 / spans at each bar of the span.

    Sums up to each bar serve every span, so spans aren't unrolled; one pass over a series makes them.
    """

    def run(rows: pa.Table) -> pa.Table:
        first, end = rows["i"].to_numpy(), rows["t1"].to_numpy() + 1
        steps, place = np.unique(np.concatenate([first, end]), return_inverse=True)
        live = np.cumsum(np.bincount(place[: len(first)], minlength=len(steps)) - np.bincount(place[len(first) :], minlength=len(steps)))[:-1]
        mass = np.where(live > 0, np.diff(steps) / np.maximum(live, 1), 0.0)
        before = np.concatenate([[0.0], np.cumsum(mass)])
        weight = (before[place[len(first) :]] - before[place[: len(first)]]) / (end - first)
        return pa.table({**{k: rows[k] for k in (*SERIES, "i")}, "weight": weight})

    live = labels.filter("t1 is not null and t1 >= i").select(*SERIES, F.col("i").cast("long").alias("i"), F.col("t1").cast("long").alias("t1"))
    return live.groupBy(*SERIES).applyInArrow(run, "symbol string, tf string, i long, weight double")


def fit_zscore(train: DataFrame, columns: list[str]) -> DataFrame:
    """One row: mean_<c> and sd_<c> (sample deviation; 1 where it is under 1e-12 or missing)."""
    sd = {c: F.stddev_samp(c) for c in columns}
    return train.agg(*[F.avg(c).alias(f"mean_{c}") for c in columns], *[F.when(s >= 1e-12, s).otherwise(1.0).alias(f"sd_{c}") for c, s in sd.items()])


def apply_zscore(df: DataFrame, stats: DataFrame, columns: list[str], most: float = 5.0) -> DataFrame:
    """Z-scores under ``stats`` (one row), cut at ``most``."""
    out = df.crossJoin(F.broadcast(stats))
    z = {c: clamp((F.col(c) - F.col(f"mean_{c}")) / F.col(f"sd_{c}"), -most, most) for c in columns}
    return out.withColumns(z).drop(*stats.columns)


def fit_minmax(train: DataFrame, columns: list[str]) -> DataFrame:
    """One row: low_<c> and span_<c> (1 where it is under 1e-12 or missing)."""
    span = lambda c: F.max(c) - F.min(c)
    return train.agg(*[F.min(c).alias(f"low_{c}") for c in columns], *[F.when(span(c) >= 1e-12, span(c)).otherwise(1.0).alias(f"span_{c}") for c in columns])


def apply_minmax(df: DataFrame, stats: DataFrame, columns: list[str]) -> DataFrame:
    """Values as shares of the span of ``stats`` (one row), not cut: later ones may lie outside [0, 1]."""
    out = df.crossJoin(F.broadcast(stats))
    return out.withColumns({c: (F.col(c) - F.col(f"low_{c}")) / F.col(f"span_{c}") for c in columns}).drop(*stats.columns)


def triple_barrier(bars: DataFrame, sigma: str = "sigma", horizon: int = 20, up: float = 2.0, down: float = 2.0, least: float = 0.0) -> DataFrame:
    """(symbol, tf, t, i, t1, side, touched, upper, lower, ret): which barrier the next ``horizon`` bars touch first.

    A bar that touches both counts as the upper one. Without sigma: touched nan, side 0, ret 0.
    """
    ahead = in_order().rowsBetween(1, horizon)
    df = bars.select(*SERIES, "t", "c", F.col(sigma).alias("_s"), index().alias("i"), F.collect_list(F.struct("h", "l", "c")).over(ahead).alias("_a"))
    ok = F.col("_s") > 0
    df = df.withColumns({"upper": F.when(ok, F.col("c") + up * F.col("_s")), "lower": F.when(ok, F.col("c") - down * F.col("_s"))})
    hits = F.transform("_a", lambda x: (x["h"] >= F.col("upper")) | (x["l"] <= F.col("lower")))
    df = df.withColumn("_k", F.array_position(hits, True))
    bar = F.get(F.col("_a"), (F.col("_k") - 1).cast("int"))
    touched = F.when(~ok | F.col("_s").isNull(), "nan").when(F.col("_k") == 0, "time").when(bar["h"] >= F.col("upper"), "upper").otherwise("lower")
    df = df.withColumns({"touched": touched, "_end": F.when(F.size("_a") > 0, F.element_at("_a", -1)["c"]).otherwise(F.col("c"))})
    exit_ = F.when(F.col("touched") == "upper", F.col("upper")).when(F.col("touched") == "lower", F.col("lower")).otherwise(F.col("_end"))
    ret = F.when(F.col("touched") == "nan", 0.0).otherwise((exit_ - F.col("c")) / F.col("c"))
    df = df.withColumns({"ret": ret, "t1": F.when(F.col("touched") == "nan", None).otherwise(F.col("i") + F.when(F.col("_k") > 0, F.col("_k")).otherwise(F.size("_a")))})
    side = F.when(F.abs("ret") < least, 0).when(F.col("touched") == "upper", 1).when(F.col("touched") == "lower", -1).otherwise(0)
    return df.select(*SERIES, "t", "i", F.col("t1").cast("long").alias("t1"), side.alias("side"), "touched", "upper", "lower", "ret")


def label_distribution(labels: DataFrame) -> DataFrame:
    side = F.col("side")
    return labels.groupBy(*SERIES).agg(F.count("*").alias("n"), F.count_if(side == 1).alias("up"), F.count_if(side == -1).alias("down"), F.count_if(side == 0).alias("flat"))


def label_shares(counts: DataFrame) -> DataFrame:
    """``label_distribution`` with the share of each side, and imbalance: the commonest side's share less the rarest's."""
    sides = ["up", "down", "flat"]
    shares = {f"{x}_share": F.col(x) / F.col("n") for x in sides}
    return counts.withColumns(shares).withColumn("imbalance", F.greatest(*shares) - F.least(*shares))


def walk_forward(df: DataFrame, train: float = 0.7, valid: float = 0.15, embargo: int = 0) -> DataFrame:
    """Add split: train, valid, test by position in the series; the last ``embargo`` rows of train and valid are null."""
    n = F.count("*").over(Window.partitionBy(*SERIES))
    i = index()
    a, b = F.floor(n * train), F.floor(n * (train + valid))
    return df.withColumn("split", F.when(i < a - embargo, "train").when((i >= a) & (i < b - embargo), "valid").when(i >= b, "test"))
