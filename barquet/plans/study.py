"""Queries of cleaning, statistics, labels, predictions, scores, news and learning, with SQL where it says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.series import DAY_MS, SERIES, in_order, rounded, settled, stored
from ..operators import cleaning as C
from ..operators import features as X
from ..operators import indicators as I
from ..operators import learning as L
from ..operators import news as N
from ..operators import predictions as P
from ..operators import profile as V
from ..operators import scoring as M
from ..operators import statistics as T
from ..operators import structure as S
from ..operators import structure_signals as G
from ..sources.bars import event_bars, lineitem_bars, table
from .sql import BARS, W, lag

KEY = [*SERIES, "t"]
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: "Now" of the queries that need one: after all bars.
NOW = 1_100_000_000_000


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def _raw(spark, sf_dir) -> DataFrame:
    """Order lines as raw bars, one each: many of them break a rule."""
    li = table(spark, sf_dir, "lineitem")
    t = F.unix_millis(F.col("l_shipdate").cast("timestamp")) + F.col("l_linenumber") * 4_000_000
    return li.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"), F.lit("1d").alias("tf"), t.alias("t"), F.col("l_quantity").alias("o"), (F.col("l_quantity") + F.col("l_linenumber") - 2).alias("h"), (F.col("l_quantity") - 10 * F.col("l_discount")).alias("l"), (F.col("l_quantity") - 20 * F.col("l_tax")).alias("c"), F.col("l_extendedprice").alias("v"))


_RAW = """raw as (select 'S' || l_suppkey symbol, '1d' tf, epoch_ms(l_shipdate) + l_linenumber * 4000000 t, l_quantity o, l_quantity + l_linenumber - 2 h, l_quantity - 10 * l_discount l, l_quantity - 20 * l_tax c, l_extendedprice v from lineitem),
checked as (select *, case when least(o, h, l, c) <= 0 then 'non-positive-price' when v < 0 then 'neg-volume' when h < greatest(o, c) then 'h<max' when l > least(o, c) then 'l>min' when t < 946684800000 then 't-too-old' when t > 1100000120000 then 't-in-future' when t % 86400000 > 21600000 then 't-not-aligned' else 'ok' end reason from raw)"""


@query("validation_report", f"with {_RAW} select symbol, tf, reason, count(*) n from checked group by all")
def validation_report(spark, sf_dir):
    return C.validation_report(C.validate(_raw(spark, sf_dir), NOW))


@query("align", f"with {_RAW} select symbol, tf, case when t % 86400000 <= 21600000 then t - t % 86400000 else t end t, t % 86400000 between 1 and 21600000 soft_aligned, count(*) n from checked where reason = 'ok' or reason = 't-not-aligned' group by all")
def align(spark, sf_dir):
    good = C.validate(_raw(spark, sf_dir), NOW).filter("ok or reason = 't-not-aligned'")
    return C.align(good).groupBy(*SERIES, "t", "soft_aligned").agg(F.count("*").alias("n"))


@query("gaps", f"with {BARS}, x as (select *, lead(t) over ({W}) nx from b) select symbol, tf, t + 86400000 from_t, nx - 86400000 to_t, (nx - t) // 86400000 - 1 missing from x where nx - t > 86400000")
def gaps(spark, sf_dir):
    return C.gaps(lineitem_bars(spark, sf_dir))


@query("missing_bars", f"with {BARS}, x as (select *, lead(t) over ({W}) nx from b) select symbol, tf, unnest(generate_series(t + 86400000, nx - 86400000, 86400000)) t from x where nx - t > 86400000")
def missing_bars(spark, sf_dir):
    return C.missing_bars(lineitem_bars(spark, sf_dir))


@query("retention", f"with {BARS} select symbol, tf, t, t >= 1100000000000 - 3650 * 86400000::bigint hot from b")
def retention(spark, sf_dir):
    hot, cold = C.retention_split(lineitem_bars(spark, sf_dir), NOW)
    return hot.select(*KEY, F.lit(True).alias("hot")).unionByName(cold.select(*KEY, F.lit(False).alias("hot")))


@query("upsert", """
with o as (select l_suppkey k, l_linenumber n, l_orderkey q, l_shipdate ts, l_quantity x from lineitem),
r as (select *, row_number() over (partition by k, n order by ts desc, q desc, x desc) r from o) select k, n, q, x from r where r = 1
""")
def upsert(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_orderkey").alias("q"), F.struct("l_shipdate", "l_orderkey", "l_quantity").alias("at"), F.col("l_quantity").alias("x"))
    return C.upsert(li.filter("q % 2 = 0"), li.filter("q % 2 = 1"), ["k", "n"], "at").select("k", "n", "q", "x")


@query("last_bars", f"with {BARS}, r as (select *, row_number() over (partition by symbol, tf order by t desc) r from b) select symbol, tf, t, round(c, 6) c from r where r <= 30")
def last_bars(spark, sf_dir):
    return rounded(C.last_n(lineitem_bars(spark, sf_dir), 30).select(*KEY, "c"), ["c"])


_RET = f"rets as (select * from (select symbol, tf, t, ln(c / {lag('c')}) r from b) where r is not null)"


@query("correlations", f"""
with {BARS}, {_RET}
select x.tf, x.symbol a, y.symbol b, count(*) n, round(covar_pop(x.r, y.r) / sqrt(var_pop(x.r) * var_pop(y.r)), 6) corr, round(covar_pop(x.r, y.r) / var_pop(y.r), 6) beta
from rets x join rets y on x.tf = y.tf and x.t = y.t and x.symbol < y.symbol group by 1, 2, 3 having count(*) >= 3
""")
def correlations(spark, sf_dir):
    return rounded(T.correlation_matrix(T.returns(lineitem_bars(spark, sf_dir))), ["corr", "beta"])


@query("autocorrelation", f"with {BARS}, {_RET}, x as (select *, lag(r) over ({W}) p from rets) select symbol, tf, round(corr(r, p), 6) autocorr from x group by 1, 2")
def autocorrelation(spark, sf_dir):
    return rounded(T.autocorrelation(T.returns(lineitem_bars(spark, sf_dir))), ["autocorr"])


@query("relative_strength", f"""
with {BARS}, x as materialized (select symbol, tf, t, c / {lag('c', 20)} - 1 r from b), s as materialized (select t, r from x where symbol = 'S1' and r is not null)
select x.symbol, x.tf, x.t, round(x.r - s.r, 6) rel from x join s on s.t = x.t where x.symbol <> 'S1' and x.r is not null
""")
def relative_strength(spark, sf_dir):
    return rounded(T.relative_strength(lineitem_bars(spark, sf_dir), "S1"), ["rel"])


def _halves(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("x"), F.col("l_discount"))
    return li.filter("l_discount < 0.05").select("flag", "x"), li.filter("l_discount >= 0.05").select("flag", "x")


@query("psi", """
with a as (select l_returnflag flag, l_extendedprice x from lineitem where l_discount < 0.05), q as (select l_returnflag flag, l_extendedprice x from lineitem where l_discount >= 0.05),
r as (select *, row_number() over (partition by flag order by x) - 1 r, count(*) over (partition by flag) n from a),
e as (select distinct r.flag, x from r, (select unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])::double f) where r = floor(f * n)),
l as (select flag, list_sort(list(x)) es from e group by 1), g as (select flag, unnest(range(len(es) + 1)) b from l),
pa as (select a.flag, len(list_filter(es, lambda v: v < x)) b, count(*) k from a join l using (flag) group by 1, 2), pq as (select q.flag, len(list_filter(es, lambda v: v < x)) b, count(*) k from q join l using (flag) group by 1, 2),
s as (select g.flag, coalesce(pa.k / sum(pa.k) over (partition by g.flag), 0) + 1e-6 p, coalesce(pq.k / sum(pq.k) over (partition by g.flag), 0) + 1e-6 q from g left join pa on pa.flag = g.flag and pa.b = g.b left join pq on pq.flag = g.flag and pq.b = g.b)
select flag, round(sum((q - p) * ln(q / p)), 6) psi, case when sum((q - p) * ln(q / p)) < 0.1 then 'stable' when sum((q - p) * ln(q / p)) < 0.25 then 'shift' else 'major' end as level from s group by 1
""")
def psi(spark, sf_dir):
    return rounded(T.psi(*_halves(spark, sf_dir), ["flag"]), ["psi"])


@query("ks", """
with u as (select l_returnflag flag, l_extendedprice x, (l_discount < 0.05)::int a from lineitem),
s as (select flag, x, sum(a) a, sum(1 - a) b from u group by 1, 2), c as (select flag, sum(a) over w ca, sum(b) over w cb, sum(a) over (partition by flag) na, sum(b) over (partition by flag) nb from s window w as (partition by flag order by x))
select flag, max(na)::bigint n_a, max(nb)::bigint n_b, round(max(abs(ca / na - cb / nb)), 6) d from c group by 1
""")
def ks(spark, sf_dir):
    return rounded(T.ks_two_sample(*_halves(spark, sf_dir), ["flag"]).drop("p"), ["d"])


_PRED = f"""pred as (select symbol, tf, t, 1 / (1 + exp(-10 * r)) p, (nx > 0)::int y, r, nx from (select *, lead(r) over ({W}) nx from rets) where nx is not null)"""


def _predicted(spark, sf_dir) -> DataFrame:
    """The next return by the last: a probability of a rise, and what came."""
    rets = T.returns(lineitem_bars(spark, sf_dir)).withColumn("nx", F.lead("r").over(in_order())).filter("nx is not null")
    return rets.select(*KEY, (1 / (1 + F.exp(-10 * F.col("r")))).alias("p"), (F.col("nx") > 0).cast("int").alias("y"), "r", "nx")


@query("calibration_bins", f"with {BARS}, {_RET}, {_PRED} select symbol, least(9, floor(p * 10))::int bin, count(*) n, round(avg(p), 6) predicted, round(avg(y), 6) observed from pred group by 1, 2")
def calibration_bins(spark, sf_dir):
    return rounded(T.calibration_bins(_predicted(spark, sf_dir), ["symbol"]), ["predicted", "observed"])


@query("calibration_report", f"""
with {BARS}, {_RET}, {_PRED}, bins as (select symbol, least(9, floor(p * 10)) bin, count(*) n, avg(p) p, avg(y) y from pred group by 1, 2), e as (select symbol, sum(n * abs(p - y)) / sum(n) ece from bins group by 1),
s as (select symbol, count(*) n, avg(pow(p - y, 2)) brier, avg(-(y * ln(least(1 - 1e-12, greatest(1e-12, p))) + (1 - y) * ln(1 - least(1 - 1e-12, greatest(1e-12, p))))) log_loss from pred group by 1)
select symbol, n, round(brier, 6) brier, round(log_loss, 6) log_loss, round(ece, 6) ece from s join e using (symbol)
""")
def calibration_report(spark, sf_dir):
    return rounded(T.calibration_report(_predicted(spark, sf_dir), ["symbol"]), ["brier", "log_loss", "ece"])


@query("conformal", f"""
with {BARS}, {_RET}, {_PRED}, x as (select symbol, abs(nx - r) s, row_number() over (partition by symbol order by abs(nx - r)) k, count(*) over (partition by symbol) n from pred)
select symbol, max(n) n, round(max(s) filter (k = ceil((n + 1) * 0.9 - 1e-9)), 6) q from x group by 1
""")
def conformal(spark, sf_dir):
    scores = _predicted(spark, sf_dir).withColumn("score", F.abs(F.col("nx") - F.col("r")))
    return rounded(T.conformal_quantiles(scores, ["symbol"]), ["q"])


@query("coverage", f"""
with {BARS}, {_RET}, {_PRED}, h as (select *, row_number() over (partition by symbol order by t) - 1 k, count(*) over (partition by symbol) m from pred),
x as (select symbol, abs(nx - r) s, row_number() over (partition by symbol order by abs(nx - r)) j, count(*) over (partition by symbol) n from h where k < floor(m * 0.5)),
q as (select symbol, coalesce(max(s) filter (j = ceil((n + 1) * 0.9 - 1e-9)), 'infinity'::double) q from x group by 1)
select symbol, count(*) n, round(avg((nx between r - q and r + q)::int), 6) coverage, round(avg(2 * q), 6) mean_width from h join q using (symbol) where k >= floor(m * 0.5) group by 1
""")
def coverage(spark, sf_dir):
    """Intervals of the first half's scores over the second half."""
    pred = _predicted(spark, sf_dir).withColumn("score", F.abs(F.col("nx") - F.col("r")))
    pred = T.walk_forward(pred, 0.5, 0.0)
    q = T.conformal_quantiles(pred.filter("split = 'train'"), ["symbol"]).drop("n")
    test = pred.filter("split = 'test'").join(q, "symbol").select("symbol", F.col("nx").alias("y"), (F.col("r") - F.col("q")).alias("lo"), (F.col("r") + F.col("q")).alias("hi"))
    return rounded(T.coverage(test, ["symbol"]), ["coverage", "mean_width"])


_SIGMA = "case when abs(r) > 1e-8 then abs(r) else 1e-8 end"


@query("conformal_intervals", f"""
with {BARS}, {_RET}, {_PRED}, h as (select *, row_number() over (partition by symbol order by t) - 1 k, count(*) over (partition by symbol) m from pred),
x as (select symbol, abs(nx) / {_SIGMA} s, row_number() over (partition by symbol order by abs(nx) / {_SIGMA}) j, count(*) over (partition by symbol) n from h where k < floor(m * 0.5)),
q as (select symbol, max(s) filter (j = ceil((n + 1) * 0.9 - 1e-9)) q from x group by 1)
select symbol, tf, t, round(-q * {_SIGMA}, 6) lo, round(q * {_SIGMA}, 6) hi, round(2 * q * {_SIGMA}, 6) width from h join q using (symbol) where k >= floor(m * 0.5)
""")
def conformal_intervals(spark, sf_dir):
    """Intervals around no move, in multiples of the last move, for the second half of each series; fitted on the first."""
    pred = T.walk_forward(_predicted(spark, sf_dir), 0.5, 0.0).select(*KEY, F.lit(0.0).alias("yhat"), F.col("nx").alias("y"), F.col("r").alias("sigma"), "split")
    fitted = T.fit_conformal(pred.filter("split = 'train'"), ["symbol"], True)
    return rounded(T.conformal_interval(pred.filter("split = 'test'"), fitted, ["symbol"], True).select(*KEY, "lo", "hi", "width"), ["lo", "hi", "width"])


@query("prediction_sets", f"""
with {BARS}, {_RET}, {_PRED}, h as (select *, row_number() over (partition by symbol order by t) - 1 k, count(*) over (partition by symbol) m from pred),
x as (select symbol, 1 - case when y = 1 then p else 1 - p end s, row_number() over (partition by symbol order by 1 - case when y = 1 then p else 1 - p end) j, count(*) over (partition by symbol) n from h where k < floor(m * 0.5)),
q as (select symbol, coalesce(max(s) filter (j = ceil((n + 1) * 0.5 - 1e-9)), 'infinity'::double) q from x group by 1)
select symbol, tf, t, case when p <= q and 1 - p <= q then 'uncertain' when 1 - p <= q then 'long' when p <= q then 'short' else 'abstain' end direction from h join q using (symbol) where k >= floor(m * 0.5)
""")
def prediction_sets(spark, sf_dir):
    """Sets of sides at even odds for the second half of each series; fitted on the first."""
    pred = T.walk_forward(_predicted(spark, sf_dir), 0.5, 0.0)
    fitted = T.fit_prediction_set(pred.filter("split = 'train'"), ["symbol"], 0.5)
    return X.prediction_sets(pred.filter("split = 'test'"), fitted, ["symbol"]).select(*KEY, "direction")


def _labelled(spark, sf_dir) -> DataFrame:
    bars = I.return_std(lineitem_bars(spark, sf_dir)).withColumnRenamed("ret_std20", "sigma")
    return T.triple_barrier(bars, horizon=10)


_LABELS = f"""vol as (select *, case when i >= 20 then stddev_pop(r) over ({W} rows between 19 preceding and current row) * c end s from (select *, ln(c / {lag('c')}) r from b)),
bar as (select *, c + 2 * s up, c - 2 * s dn, max(i) over (partition by symbol, tf) last from vol),
hit as (select a.symbol, a.tf, a.i, min(z.i) k from bar a join b z on z.symbol = a.symbol and z.i > a.i and z.i <= a.i + 10 and (z.h >= a.up or z.l <= a.dn) where a.s > 0 group by 1, 2, 3),
lab as (select a.symbol, a.tf, a.t, a.i, case when coalesce(a.s, 0) <= 0 then null else coalesce(hit.k, least(a.last, a.i + 10)) end t1,
  case when coalesce(a.s, 0) <= 0 then 'nan' when hit.k is null then 'time' when z.h >= a.up then 'upper' else 'lower' end touched from bar a left join hit on hit.symbol = a.symbol and hit.i = a.i left join b z on z.symbol = a.symbol and z.i = hit.k)"""


@query("triple_barrier", f"with {BARS}, {_LABELS} select symbol, tf, t, i, t1, touched, case touched when 'upper' then 1 when 'lower' then -1 else 0 end side from lab")
def triple_barrier(spark, sf_dir):
    return _labelled(spark, sf_dir).select(*KEY, "i", "t1", "touched", "side")


@query("label_distribution", f"with {BARS}, {_LABELS} select symbol, tf, count(*) n, count_if(touched = 'upper') as up, count_if(touched = 'lower') as down, count_if(touched not in ('upper', 'lower')) flat from lab group by 1, 2")
def label_distribution(spark, sf_dir):
    return T.label_distribution(_labelled(spark, sf_dir))


@query("uniqueness_weights", f"""
with {BARS}, {_LABELS}, s as (select * from lab where t1 is not null), conc as (select b.symbol, b.i, count(*) n from b join s on s.symbol = b.symbol and b.i between s.i and s.t1 group by 1, 2)
select s.symbol, s.tf, s.i, round(avg(1 / n), 6) weight from s join conc on conc.symbol = s.symbol and conc.i between s.i and s.t1 group by 1, 2, 3
""")
def uniqueness_weights(spark, sf_dir):
    return rounded(T.uniqueness_weights(_labelled(spark, sf_dir)), ["weight"])


@query("walk_forward", f"with {BARS}, x as (select *, count(*) over (partition by symbol, tf) n from b), y as (select *, floor(n * 0.7) a, floor(n * (0.7 + 0.15)) z from x) select symbol, tf, t, case when i < a - 5 then 'train' when i >= a and i < z - 5 then 'valid' when i >= z then 'test' end split from y")
def walk_forward(spark, sf_dir):
    return T.walk_forward(lineitem_bars(spark, sf_dir), embargo=5).select(*KEY, "split")


@query("zscores", f"""
with {BARS}, s as (select avg(c) mc, stddev_samp(c) sc, avg(v) mv, stddev_samp(v) sv from bars where t < 852076800000)
select symbol, tf, t, round(greatest(-5, least(5, (c - mc) / sc)), 6) c, round(greatest(-5, least(5, (v - mv) / sv)), 6) v from bars, s
""")
def zscores(spark, sf_dir):
    bars = lineitem_bars(spark, sf_dir)
    stats = T.fit_zscore(bars.filter("t < 852076800000"), ["c", "v"])
    return rounded(T.apply_zscore(bars, stats, ["c", "v"]).select(*KEY, "c", "v"), ["c", "v"])


def _verdicts(spark, sf_dir) -> DataFrame:
    """Predictions of all four kinds, made from each bar, and their verdicts."""
    bars = lineitem_bars(spark, sf_dir)
    made = bars.withColumn("m", F.col("c") / F.col("o") - 1)
    none = lambda t: F.lit(None).cast(t)
    dir_ = F.when(F.col("m") > 0.1, "up").when(F.col("m") < -0.1, "down").otherwise("flat")
    shape = {"dir": "string", "prob": "double", "yhat": "double", "sigma": "double", "lo": "double", "hi": "double", "classes": "array<string>"}
    kind = lambda name, **has: F.struct(F.lit(name).alias("kind"), *[has.get(k, none(t)).cast(t).alias(k) for k, t in shape.items()])
    m = F.col("m")
    kinds = F.array(
        kind("direction", dir=dir_, prob=F.lit(0.6)), kind("return", yhat=m / 2, sigma=F.lit(0.1)), kind("interval", lo=m - 1, hi=m + 1),
        kind("set", classes=F.when(m > 0, F.array(F.lit("long"))).otherwise(F.array(F.lit("short"), F.lit("flat")))),
    )
    preds = made.select(*KEY, F.explode(kinds).alias("k")).select(*KEY, "k.*")
    return P.validate_predictions(preds, bars)


_VERDICTS = """m as (select *, c / o - 1 m from b), g as (select m.symbol, m.tf, m.t, m.m, z.c / z.o - 1 r from m join b z on z.symbol = m.symbol and z.t = m.t + 86400000),
k as (select *, case when m > 0.1 then 'up' when m < -0.1 then 'down' else 'flat' end dir, case when r > 0 then 'up' when r < 0 then 'down' else 'flat' end rd from g)"""


@query("verdict_summary", f"""
with {BARS}, {_VERDICTS}
select symbol, tf, 4 * count(*) n, count(*) n_direction, count_if(dir = 'flat') n_abstain, round(avg((dir = rd)::int) filter (dir <> 'flat'), 6) accuracy, round(avg(abs(r - m / 2)), 6) mae, round(sqrt(avg((r - m / 2) * (r - m / 2))), 6) rmse, round(avg(r - m / 2), 6) mean_residual,
  round(avg((r between m - 1 and m + 1)::int), 6) interval_coverage, round(avg(m + 1 - (m - 1)), 6) mean_width, round(avg((case when m > 0 then rd = 'up' else rd in ('down', 'flat') end)::int), 6) set_coverage, round(avg(case when m > 0 then 1 else 2 end), 6) mean_set_size, round(avg(pow(0.6 - (dir <> 'flat' and dir = rd)::int, 2)), 6) brier
from k group by rollup (symbol, tf)
""")
def verdict_summary(spark, sf_dir):
    return rounded(P.summarize_verdicts(_verdicts(spark, sf_dir)), ["accuracy", "mae", "rmse", "mean_residual", "interval_coverage", "mean_width", "set_coverage", "mean_set_size", "brier"])


@query("mistakes", f"""
with {BARS}, {_VERDICTS}, e as (select symbol, t, 'direction' et from k where dir <> 'flat' and dir <> rd union all select symbol, t, 'magnitude' from k where abs((r - m / 2) / 0.1) > 2 union all select symbol, t, 'interval-miss' from k where not r between m - 1 and m + 1 union all select symbol, t, 'set-miss' from k where not case when m > 0 then rd = 'up' else rd in ('down', 'flat') end)
select et error_type, symbol, count(*) n, max(t) last_t from e group by grouping sets ((et), (symbol), ())
""")
def mistakes(spark, sf_dir):
    return P.mistake_summary(P.classify_error(_verdicts(spark, sf_dir)))


@query("rolling_accuracy", f"with {BARS}, {_VERDICTS} select symbol, tf, t, round(avg((dir <> 'flat' and dir = rd)::int) over ({W} rows between 199 preceding and current row), 6) acc from k")
def rolling_accuracy(spark, sf_dir):
    return P.rolling_accuracy(_verdicts(spark, sf_dir).filter("ok and kind = 'direction'"), 200).select(*KEY, F.round("acc", 6).alias("acc"))


@query("drift")
def drift(spark, sf_dir):
    rets = T.returns(lineitem_bars(spark, sf_dir)).select(*KEY, F.tanh("r").alias("x"))
    return P.drift(rets, SERIES, ph_threshold=5.0).filter("adwin or page_hinkley is not null").select(*KEY, "adwin", "page_hinkley")


@query("stability", f"""
with {BARS}, r as (select *, row_number() over (partition by symbol, tf order by t desc) r from (select *, tanh(c / o - 1) bias, sign(c - o) d, h - l w from b)), x as (select *, lag(d) over ({W}) p from r where r <= 30),
a as (select symbol, tf, count(*) n, coalesce(stddev_samp(bias), 0) sd, coalesce(avg((d <> p)::int) filter (d <> 0 and p <> 0), 0) fl, arg_min(w, t) w0, arg_max(w, t) w1 from x group by 1, 2),
s as (select symbol, tf, n, greatest(0, least(1, 1 - sd / 0.5)) bs, greatest(0, least(1, 1 - fl)) ds, case when w0 > 0 then greatest(0, least(1, 1 - greatest(0, (w1 - w0) / w0))) else 1 end xs from a)
select symbol, tf, n, round(bs, 6) bias_stability, round(ds, 6) direction_stability, round(xs, 6) interval_stability, round(0.4 * bs + 0.4 * ds + 0.2 * xs, 6) score, case when 0.4 * bs + 0.4 * ds + 0.2 * xs >= 0.7 then 'stable' when 0.4 * bs + 0.4 * ds + 0.2 * xs >= 0.45 then 'moderate' else 'volatile' end as label from s
""")
def stability(spark, sf_dir):
    history = lineitem_bars(spark, sf_dir).select(*KEY, F.tanh(F.col("c") / F.col("o") - 1).alias("bias"), F.signum(F.col("c") - F.col("o")).alias("direction"), (F.col("h") - F.col("l")).alias("width"))
    return rounded(P.stability(history), ["bias_stability", "direction_stability", "interval_stability", "score"])


@query("tag_events", """
with e as (select event_type symbol, '1h' tf, epoch_ms(date_trunc('hour', ts)) t from events where value is not null group by 1, 2, 3),
c as (select event_id id, epoch_us(ts) // 1000 st, 3600000 dur, value impact from events where event_type = 'purchase'),
j as (select e.*, c.*, row_number() over (partition by symbol, t order by st, id) r from e left join c on t >= st - 300000 and t <= st + dur + 1800000)
select symbol, tf, t, id event_id, impact, case when t >= st + dur then 'post' when t >= st then 'during' when st is not null then 'pre' end phase from j where r = 1
""")
def tag_events(spark, sf_dir):
    calendar = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select(F.col("event_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.lit(3_600_000).alias("duration_ms"), F.col("value").alias("impact"))
    return P.tag_events(event_bars(spark, sf_dir).select(*KEY), calendar)


@query("nearest_bars", """
with a as (select user_id, epoch_us(ts) // 1000 t, event_id id from events where event_type <> 'purchase'), b as (select user_id, epoch_us(ts) // 1000 bt, event_id bid from events where event_type = 'purchase'),
j as (select a.*, bt, bid, row_number() over (partition by a.id order by abs(a.t - bt), bt desc, bid) r from a left join b on b.user_id = a.user_id and abs(a.t - bt) <= 86400000) select id, bt near_t from j where r = 1
""")
def nearest_bars(spark, sf_dir):
    """The purchase of the same user that is nearest to each other event, within a day."""
    ev = table(spark, sf_dir, "events").select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("t"), F.col("event_id").alias("id"), "event_type")
    return P.nearest_in_time(ev.filter("event_type <> 'purchase'").drop("event_type"), ev.filter("event_type = 'purchase'"), ["user_id"], 86_400_000, ["id"]).select("id", "near_t")


@query("volume_profile")
def volume_profile(spark, sf_dir):
    return rounded(V.volume_profile(lineitem_bars(spark, sf_dir)), ["poc", "vah", "val", "total"])


@query("module_scores")
def module_scores(spark, sf_dir):
    scored = M.orchestrate(M.module_signals(M.prepared(lineitem_bars(spark, sf_dir))))
    return rounded(scored.select(*KEY, "score", "probability", "confidence", "direction", "participating"), ["score", "probability", "confidence"])


@query("market_scan")
def market_scan(spark, sf_dir):
    return rounded(M.scan(lineitem_bars(spark, sf_dir)), ["c", "score", "confidence", "probability", "rank_value"])


@query("backtest")
def backtest(spark, sf_dir):
    scored = M.orchestrate(M.module_signals(M.prepared(lineitem_bars(spark, sf_dir))))
    return rounded(M.backtest_metrics(M.backtest(scored)), ["hit_rate", "total_return", "sharpe", "sortino", "max_drawdown", "profit_factor", "best", "worst"], 5)


#: Weights of words that the news queries use; users bring their own.
WORDS = {"rally": 0.7, "surge": 0.8, "gain": 0.5, "bullish": 0.85, "record": 0.5, "approval": 0.6, "crash": -0.85, "plunge": -0.8, "bearish": -0.85, "loss": -0.5, "hack": -0.8, "lawsuit": -0.6}


def _news(spark, sf_dir) -> DataFrame:
    """Documents as news: the first line is the title."""
    docs = table(spark, sf_dir, "documents")
    first = F.instr("text", "\n")
    return docs.select(F.col("doc_id").cast("string").alias("guid"), F.when(first > 0, F.substring_index("text", "\n", 1)).otherwise(F.col("text")).alias("title"), F.when(first > 0, F.expr("substring(text, instr(text, '\n') + 1)")).alias("summary"), "source", F.lit("").alias("link"))


@query("news_annotated")
def news_annotated(spark, sf_dir):
    return N.annotate(_news(spark, sf_dir), WORDS).select("guid", F.round("sentiment", 6).alias("sentiment"), "label", "primary", F.round("impact", 6).alias("impact"), "high_impact", F.array_join("symbols", ",").alias("symbols"))


@query("news_tally")
def news_tally(spark, sf_dir):
    return N.tally(N.annotate(_news(spark, sf_dir), WORDS))


@query("news_dedupe", "select count(*) n from (select distinct coalesce(nullif(trim(split_part(text, chr(10), 1)), ''), null) k from documents) where k is not null")
def news_dedupe(spark, sf_dir):
    items = _news(spark, sf_dir).withColumn("guid", F.lit(None).cast("string"))
    return N.dedupe(items).agg(F.count("*").alias("n"))


@query("page_text", "select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '\\s+', ' ', 'g')) as text from pages")
def page_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", N.clean_headline(F.col("html")).alias("text"))


@query("platt_isotonic")
def platt_isotonic(spark, sf_dir):
    pred = _predicted(spark, sf_dir).select("symbol", "tf", "t", F.col("p").alias("score"), "y")
    return rounded(L.compare_calibrators(pred), ["brier", "log_loss", "ece"])


@query("anti_patterns")
def anti_patterns(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), (F.col("label") % 2 == 0).alias("mistake"))
    return rounded(L.anti_patterns(emb, k=4).drop("centroid"), ["radius", "hit_rate"], 4)


def features(spark, sf_dir) -> DataFrame:
    """The features of all bars, out of one pass over each series: only order lines are shuffled."""
    return rounded(X.features_of(I.moving(I.stochastic(I.volume(I.bands(S.indexed(lineitem_bars(spark, sf_dir))))))), X.NAMES, 5)


@query("feature_matrix")
def feature_matrix(spark, sf_dir):
    """Settled as they are returned, so that whoever reads them twice doesn't make them twice."""
    return stored(features(spark, sf_dir))


@query("wyckoff")
def wyckoff(spark, sf_dir):
    return X.classify_wyckoff(X.compression(I.bull_features(I.bands(I.recursive(lineitem_bars(spark, sf_dir)))))).select(*KEY, "phase", "bias", "compressed")


@query("purged_kfold", f"""
with {BARS}, {_LABELS}, x as (select symbol, tf, i, coalesce(t1, i) e, count(*) over (partition by symbol, tf) n from lab), y as (select *, least(4, i // (n // 5))::int own from x),
f as (select symbol, tf, own fold, min(i) a, max(i) b, max(e) far from y group by 1, 2, 3)
select y.symbol, y.tf, y.i, fold, case when own = fold then 'test' else 'train' end as role from y join f on f.symbol = y.symbol
where own = fold or ((e < a or i > b) and not (i > b and i <= least(n - 1, greatest(far, b) + 3)))
""")
def purged_kfold(spark, sf_dir):
    return X.purged_kfold(_labelled(spark, sf_dir), embargo=3)


@query("meta_labels", f"with {BARS}, {_LABELS}, p as (select symbol, i, sign(c - o) s from b) select lab.symbol, lab.tf, lab.i, (s <> 0 and s = case touched when 'upper' then 1 when 'lower' then -1 else 0 end)::int meta from lab join p on p.symbol = lab.symbol and p.i = lab.i")
def meta_labels(spark, sf_dir):
    bars = S.indexed(lineitem_bars(spark, sf_dir)).select(*SERIES, "i", (F.col("c") - F.col("o")).alias("signal"))
    return X.meta_labels(_labelled(spark, sf_dir), bars)


@query("macro_state", f"""
with {BARS}, m as (select * from (values ('S1', 0.25, -1), ('S2', 0.25, 1), ('S3', 0.2, -1), ('S4', 0.15, -1)) v(symbol, w, s)),
r as (select b.symbol, t, c, w, s, row_number() over (partition by b.symbol order by t desc) r from b join m on m.symbol = b.symbol), e as (select symbol, w::double w, s * tanh((arg_max(c, t) / avg(c) - 1) * 8) x from r where r <= 20 group by symbol, w, s having count(*) >= 3),
z as (select sum(w) coverage, sum(x * w) / sum(w) score from e) select round(score, 6) score, case when score >= 0.15 then 'risk-on' when score <= -0.15 then 'risk-off' else 'mixed' end as label, round(coverage, 6) coverage from z
""")
def macro_state(spark, sf_dir):
    closes = lineitem_bars(spark, sf_dir).select(F.col("symbol").alias("proxy"), "t", F.col("c").alias("close"))
    return rounded(X.macro_state(closes, proxies={"S1": (0.25, -1), "S2": (0.25, 1), "S3": (0.2, -1), "S4": (0.15, -1)}), ["score", "coverage"])


@query("rolling_conformal", f"""
with {BARS}, {_RET}, {_PRED}, x as (select symbol, tf, t, abs(nx - r) s from pred), y as (select symbol, tf, t, list_sort(list(s) over (partition by symbol, tf order by t rows between 100 preceding and 1 preceding)) l from x)
select symbol, tf, t, round(coalesce(l[ceil((len(l) + 1) * 0.9 - 1e-9)::int], 'infinity'::double), 6) q from y
""")
def rolling_conformal(spark, sf_dir):
    scores = _predicted(spark, sf_dir).withColumn("score", F.abs(F.col("nx") - F.col("r")))
    return rounded(X.rolling_conformal(scores, 100).select(*KEY, "q"), ["q"])


@query("forecasts")
def forecasts(spark, sf_dir):
    """Paths from each series' 100th bar before its end, and how they were met."""
    scored = M.orchestrate(M.module_signals(M.prepared(lineitem_bars(spark, sf_dir))))
    w = Window.partitionBy(*SERIES).orderBy(F.desc("t"))
    start = X.expected_move(scored).withColumn("_r", F.row_number().over(w)).filter("_r = 100").withColumn("step_ms", F.lit(DAY_MS))
    graded = X.grade_ghosts(X.ghost_forecast(start), lineitem_bars(spark, sf_dir))
    return rounded(graded, ["coverage", "mae", "direction_hit"], 4)


@query("head_and_shoulders")
def head_and_shoulders(spark, sf_dir):
    bars = S.indexed(I.recursive(lineitem_bars(spark, sf_dir)))
    last = bars.groupBy(*SERIES).agg(F.max("i").alias("last_i"), F.max_by("c", "t").alias("c"), F.max_by("atr14", "t").alias("atr14"))
    return rounded(X.head_and_shoulders(S.pivots(bars.drop("i")), last), ["neckline", "target", "invalidation"], 4)


@query("bias_grid")
def bias_grid(spark, sf_dir):
    bars = event_bars(spark, sf_dir).unionByName(event_bars(spark, sf_dir, "4h", 14_400_000))
    scored = M.orchestrate(M.module_signals(M.prepared(bars)))
    return rounded(X.bias_grid(scored, ["1h", "4h"]), ["1h", "4h"])


@query("structure_scores")
def structure_scores(spark, sf_dir):
    bars = settled(I.recursive(I.bands(lineitem_bars(spark, sf_dir))).select(*KEY, "o", "h", "l", "c", "v", "atr14", "bb_width"))  # all that the structure is read from
    last = bars.groupBy(*SERIES).agg(F.max("t").alias("t"))
    return rounded(G.fuse(G.stacked(bars), last), ["score", "confidence", "probability"], 5)


@query("chart_patterns")
def chart_patterns(spark, sf_dir):
    bars = S.indexed(I.recursive(lineitem_bars(spark, sf_dir)))
    last = bars.groupBy(*SERIES).agg(F.max("i").alias("last_i"), F.max_by("c", "t").alias("c"), F.max_by("atr14", "t").alias("atr14"))
    return rounded(X.chart_patterns(S.pivots(bars.drop("i")), last), ["neckline", "target", "invalidation"], 4)


@query("module_signals")
def module_signals(spark, sf_dir):
    """Every module's signal and confidence on the last bar of each series."""
    newest = M.newest_signals(lineitem_bars(spark, sf_dir))
    names = [c for c in newest.columns if c[:2] in ("s_", "c_")]
    return newest.select(*KEY, *[F.round(f"`{c}`", 5).alias(c.replace("-", "_")) for c in names])
