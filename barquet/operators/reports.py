"""What a reader of the results asks for: nearest events, votes of patterns, states with hysteresis, last rows, ranked parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.series import SERIES, clamp, in_order

DAY_MS = 86_400_000
# fixed values: patterns that speak for a rise and for a fall
BULL_PATTERNS = ["hammer", "bullEngulf", "bullHarami", "morningStar", "invHammer"]
BEAR_PATTERNS = ["bearEngulf", "bearHarami", "eveningStar"]


def events_near(times: DataFrame, calendar: DataFrame, window_ms: int, least_impact: float | None = None) -> DataFrame:
    """Each row of ``times`` (t, and symbol if events name theirs) with every event at most ``window_ms`` away.

    ``calendar``: (id, at, duration_ms, impact), and symbols (array) if events are for some symbols only;
    a null array is for all. Adds event_id, at, delta_ms, impact, phase (before, during, after) and rank by
    distance, ties by id. Times without an event have no row. Rows and events meet in buckets of
    ``window_ms`` and those beside, so the join is an equi-join.
    """
    bucket = lambda c: F.floor(c / window_ms)
    named = "symbols" in calendar.columns
    cal = calendar if least_impact is None else calendar.filter(F.col("impact") >= least_impact)
    cal = cal.select(F.col("id").alias("event_id"), "at", F.coalesce("duration_ms", F.lit(0)).alias("_for"), "impact", *(["symbols"] if named else []))
    cal = cal.withColumn("_b", F.explode(F.array(*[bucket(F.col("at")) + k for k in (-1, 0, 1)])))
    on = (bucket(F.col("t")) == F.col("_b")) & (F.abs(F.col("at") - F.col("t")) <= window_ms)
    if named:
        on &= F.col("symbols").isNull() | F.array_contains("symbols", F.col("symbol"))
    met = times.join(cal, on).withColumn("delta_ms", F.col("at") - F.col("t"))
    phase = F.when(F.col("t") > F.col("at") + F.col("_for"), "after").when(F.col("t") >= F.col("at"), "during").otherwise("before")
    w = Window.partitionBy(*times.columns).orderBy(F.abs("delta_ms"), "event_id")
    return met.withColumn("phase", phase).withColumn("rank", F.row_number().over(w)).select(*times.columns, "event_id", "at", "delta_ms", "impact", "phase", "rank")


def pattern_bias(hits: DataFrame, last: int = 3, decay: float = 0.18) -> DataFrame:
    """(symbol, tf, bias) in [-1, 1]: the vote of the ``last`` bars with patterns, the newer the heavier; 0 if none takes a side."""
    w = Window.partitionBy(*SERIES).orderBy(F.desc("t"))
    recent = hits.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= last)
    one = recent.select(*SERIES, F.exp(-decay * (F.col("_r") - 1)).alias("_w"), F.explode("patterns").alias("_p"))
    side = F.when(F.col("_p").isin(BULL_PATTERNS), 1.0).when(F.col("_p").isin(BEAR_PATTERNS), -1.0)
    sums = one.withColumn("_s", side).groupBy(*SERIES).agg(F.sum(F.col("_s") * F.col("_w")).alias("_v"), F.sum(F.when(F.col("_s").isNotNull(), F.col("_w"))).alias("_n"))
    return sums.select(*SERIES, F.coalesce(clamp(F.col("_v") / F.col("_n"), -1, 1), F.lit(0.0)).alias("bias"))


def committed_states(df: DataFrame, state: Column, confirm: int = 3) -> DataFrame:
    """``df`` with committed, changed and dwell: a state is taken over once ``confirm`` bars in a row show it.

    The first bar's state holds from the start. Only runs of equal states that grow to ``confirm`` can change
    what is committed, so the last such run decides, and windows do without a loop. changed: whether this
    bar committed another state (the first bar does); dwell: bars since then.
    """
    w = in_order()
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_s", state)
    df = df.withColumn("_run", F.sum(F.when(F.lag("_s").over(w).eqNullSafe(F.col("_s")), 0).otherwise(1)).over(run))
    df = df.withColumn("_k", F.row_number().over(Window.partitionBy(*SERIES, "_run").orderBy("t"))).withColumn("_i", F.row_number().over(w))
    df = df.withColumn("committed", F.last(F.when((F.col("_k") == confirm) | (F.col("_i") == 1), F.col("_s")), True).over(run))
    df = df.withColumn("changed", (F.col("_i") == 1) | ~F.lag("committed").over(w).eqNullSafe(F.col("committed")))
    return df.withColumn("dwell", F.col("_i") - F.last(F.when(F.col("changed"), F.col("_i")), True).over(run)).drop("_s", "_run", "_k", "_i")


def latest_feature_z(features: DataFrame, names: list[str]) -> DataFrame:
    """(symbol, tf, t, name, raw, z): the newest valid row of each series, each feature against all valid rows of the series.

    Without a valid row the newest one is taken, and z is null; a feature that never changes has its distance as z.
    """
    good = F.col("valid")
    stats = [F.avg(F.when(good, F.col(n))).alias(f"_m_{n}") for n in names] + [F.stddev_samp(F.when(good, F.col(n))).alias(f"_d_{n}") for n in names]
    last = F.max_by(F.struct("t", *names), F.struct(good, F.col("t"))).alias("_last")
    by = features.groupBy(*SERIES).agg(last, *stats)
    spread = lambda n: F.when(F.coalesce(F.col(f"_d_{n}"), F.lit(0.0)) == 0, 1.0).otherwise(F.col(f"_d_{n}"))
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"_last.{n}").alias("raw"), ((F.col(f"_last.{n}") - F.col(f"_m_{n}")) / spread(n)).alias("z")) for n in names])
    return by.select(*SERIES, F.col("_last.t").alias("t"), F.explode(rows).alias("x")).select(*SERIES, "t", "x.*")


def universe_counts(universe: DataFrame, by: str = "type") -> DataFrame:
    """(type, n) of each type, and of all (null)."""
    return universe.rollup(by).agg(F.count("*").alias("n"))


def top_modules(signals: DataFrame, modules: list[str], k: int = 4) -> DataFrame:
    """(symbol, tf, t, rank, module, signal, confidence): the ``k`` modules with the largest |signal * confidence| of each row."""
    each = F.array(*[F.struct((-F.abs(F.col(f"`s_{m}`") * F.col(f"`c_{m}`"))).alias("w"), F.lit(place).alias("place"), F.lit(m).alias("module"), F.round(f"`s_{m}`", 3).alias("signal"), F.round(f"`c_{m}`", 3).alias("confidence")) for place, m in enumerate(modules)])
    best = F.slice(F.array_sort(F.filter(each, lambda x: x["w"].isNotNull())), 1, k)
    return signals.select(*SERIES, "t", F.posexplode(best).alias("rank", "x")).select(*SERIES, "t", (F.col("rank") + 1).alias("rank"), "x.module", "x.signal", "x.confidence")


def nearest_levels(levels: DataFrame, last: DataFrame, k: int = 3) -> DataFrame:
    """(symbol, tf, kind, price, distance, rank): the ``k`` levels of each kind nearest to the last close (symbol, tf, c)."""
    far = levels.join(last.select(*SERIES, "c"), SERIES).withColumn("distance", F.abs(F.col("price") - F.col("c")))
    w = Window.partitionBy(*SERIES, "kind").orderBy("distance", "price")
    return far.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(*SERIES, "kind", "price", "distance", "rank")


def recent(rows: DataFrame, at: str, n: int, by: list[str] = SERIES, tie: str | None = None) -> DataFrame:
    """The newest ``n`` rows of each group by the column ``at``."""
    w = Window.partitionBy(*by).orderBy(F.desc(at), *([tie] if tie else []))
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def due_predictions(predictions: DataFrame, now: int) -> DataFrame:
    """Those not validated whose close_at is over."""
    return predictions.filter(~F.coalesce("validated", F.lit(False)) & (F.col("close_at") <= now))


def label_training_pool(contexts: DataFrame, verdicts: DataFrame, most: int = 5000, tie: str = "realised_direction") -> DataFrame:
    """``contexts`` (prediction_id, created_at, ...) with label: 1, -1 or 0 by the verdict's realised_direction, null while there is none.

    The verdict validated last counts, of several at that time the one with the greatest ``tie``. Of the labelled rows the newest ``most`` are kept, which is the pool's size; pending rows all stay.
    """
    side = F.when(F.col("realised_direction") == "up", 1).when(F.col("realised_direction") == "down", -1).otherwise(0)
    known = verdicts.groupBy("prediction_id").agg(F.max_by("realised_direction", F.struct("validated_at", tie)).alias("realised_direction")).withColumn("label", side).drop("realised_direction")
    rows = contexts.join(known, "prediction_id", "left")
    newest = rows.filter("label is not null").orderBy(F.desc("created_at"), "prediction_id").limit(most)
    return newest.unionByName(rows.filter("label is null"))


def tpo_letter(i: Column) -> Column:
    """A to Z, then AA to ZZ."""
    letter = lambda k: F.char((F.lit(65) + k).cast("int"))
    return F.when(i < 26, letter(i)).otherwise(F.concat(letter(F.floor(i / 26) - 1), letter(i % 26)))


def day_key(t: Column) -> Column:
    """The UTC day of epoch milliseconds, yyyy-mm-dd."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(t / DAY_MS).cast("int")), "yyyy-MM-dd")
