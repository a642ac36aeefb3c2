"""Queries of bars, indicators and structure over the given tables, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.series import SERIES, rounded
from ..operators import indicators as I
from ..operators import structure as S
from ..sources.bars import event_bars, lineitem_bars
from .sql import BARS, PIVOTS, W, frame, full, lag, smoothed

KEY = [*SERIES, "t"]
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def _show(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return rounded(df.select(*KEY, *columns), columns, digits)


@query("bars_lineitem", f"with {BARS} select symbol, tf, t, round(o, 6) o, round(h, 6) h, round(l, 6) l, round(c, 6) c, round(v, 6) v from bars")
def bars_lineitem(spark, sf_dir):
    return _show(lineitem_bars(spark, sf_dir), ["o", "h", "l", "c", "v"])


@query("bars_events", """
select event_type symbol, '1h' tf, epoch_ms(date_trunc('hour', ts)) t, arg_min(value, event_id) o, max(value) h, min(value) l, arg_max(value, event_id) c, count(*)::double v
from events where value is not null group by 1, 2, 3
""")
def bars_events(spark, sf_dir):
    return event_bars(spark, sf_dir).select(*KEY, "o", "h", "l", "c", "v")


@query("moving_averages", f"""
with {BARS} select symbol, tf, t, {full(20, f'avg(c) {frame(20)}')} sma20,
  {full(10, '(' + ' + '.join(f'{10 - k} * ' + (lag('c', k) if k else 'c') for k in range(10)) + ') / 55')} wma10,
  round((c / {lag('c', 10)} - 1) * 100, 6) roc10, round(ln(c / {lag('c')}), 6) log_ret,
  round(case when {lag('c')} is null then h - l else greatest(h - l, abs(h - {lag('c')}), abs(l - {lag('c')})) end, 6) tr
from b
""")
def moving_averages(spark, sf_dir):
    return _show(I.moving(lineitem_bars(spark, sf_dir)), ["sma20", "wma10", "roc10", "log_ret", "tr"])


@query("bollinger", f"""
with {BARS}, x as (select *, avg(c) {frame(20)} m, stddev_pop(c) {frame(20)} s from b)
select symbol, tf, t, {full(20, 'm')} bb_mid, {full(20, 'm + 2 * s')} bb_up, {full(20, 'm - 2 * s')} bb_lo, {full(20, '4 * s / m')} bb_width from x
""")
def bollinger(spark, sf_dir):
    return _show(I.bands(lineitem_bars(spark, sf_dir)), ["bb_mid", "bb_up", "bb_lo", "bb_width"])


@query("cci", f"""
with {BARS}, x as (select *, (h + l + c) / 3 tp from b), y as (select *, list(tp) {frame(20)} tps, avg(tp) {frame(20)} m from x),
z as (select *, list_sum(list_transform(tps, lambda e: abs(e - m))) / 20 mad from y)
select symbol, tf, t, {full(20, 'case when mad = 0 then 0 else (tp - m) / (0.015 * mad) end')} cci20 from z
""")
def cci(spark, sf_dir):
    return _show(I.cci(lineitem_bars(spark, sf_dir)), ["cci20"])


@query("stochastic", f"""
with {BARS}, x as (select *, max(h) {frame(14)} hh, min(l) {frame(14)} ll from b),
y as (select *, case when i >= 13 then case when hh = ll then 50 else (c - ll) / (hh - ll) * 100 end end k, case when i >= 13 then case when hh = ll then -50 else (hh - c) / (hh - ll) * -100 + 0 end end r from x)
select symbol, tf, t, round(k, 6) stoch_k, round(r, 6) williams_r, {full(16, f'avg(k) {frame(3)}')} stoch_d from y
""")
def stochastic(spark, sf_dir):
    return _show(I.stochastic(lineitem_bars(spark, sf_dir)), ["stoch_k", "williams_r", "stoch_d"])


_line = lambda n: f"case when i >= {n - 1} then (max(h) {frame(n)} + min(l) {frame(n)}) / 2 end"


@query("ichimoku", f"""
with {BARS}, x as (select *, {_line(9)} tenkan, {_line(26)} kijun, {_line(52)} s from b)
select symbol, tf, t, round(tenkan, 6) tenkan, round(kijun, 6) kijun, round(lag((tenkan + kijun) / 2, 26) over ({W}), 6) senkou_a, round({lag('s', 26)}, 6) senkou_b, round(lead(c, 26) over ({W}), 6) chikou from x
""")
def ichimoku(spark, sf_dir):
    return _show(I.ichimoku(lineitem_bars(spark, sf_dir)), ["tenkan", "kijun", "senkou_a", "senkou_b", "chikou"])


@query("vwap", f"""
with {BARS}, x as (select *, (h + l + c) / 3 * v pv from b)
select symbol, tf, t, {full(20, f'sum(pv) {frame(20)} / sum(v) {frame(20)}')} vwap20, round(sum(pv) over (partition by symbol, tf, t // 86400000 order by t) / sum(v) over (partition by symbol, tf, t // 86400000 order by t), 6) vwap_day from x
""")
def vwap(spark, sf_dir):
    return _show(I.vwap(lineitem_bars(spark, sf_dir)), ["vwap20", "vwap_day"])


@query("volume_flow", f"""
with {BARS}, x as (select *, (h + l + c) / 3 tp, case when h = l then 0 else ((c - l) - (h - c)) / (h - l) * v end mfv, {lag('c')} pc from b),
y as (select *, case when pc is null then 0 when c > pc then v when c < pc then -v else 0 end sg, case when tp > {lag('tp')} then tp * v else 0 end up, case when tp < {lag('tp')} then tp * v else 0 end dn from x)
select symbol, tf, t, round(sum(sg) over ({W}), 4) obv, {full(20, f'sum(mfv) {frame(20)} / sum(v) {frame(20)}', 4)} cmf20,
  {full(15, f'case when sum(dn) {frame(14)} = 0 then 100 else 100 - 100 / (1 + sum(up) {frame(14)} / sum(dn) {frame(14)}) end', 4)} mfi14, {full(20, f'v / avg(v) {frame(20)}', 4)} rel_volume from y
""")
def volume_flow(spark, sf_dir):
    return _show(I.volume(lineitem_bars(spark, sf_dir)), ["obv", "cmf20", "mfi14", "rel_volume"], 4)


@query("return_std", f"with {BARS}, x as (select *, ln(c / {lag('c')}) r from b) select symbol, tf, t, {full(21, f'stddev_pop(r) {frame(20)} * c')} ret_std20 from x")
def return_std(spark, sf_dir):
    return _show(I.return_std(lineitem_bars(spark, sf_dir)), ["ret_std20"])


_EMA = f"""
with recursive {BARS}, src as (select symbol, tf, i j, c x from b), {smoothed('e20', 'src', 20, '(2.0/21)')}, {smoothed('e12', 'src', 12, '(2.0/13)')}, {smoothed('e26', 'src', 26, '(2.0/27)')}
select b.symbol, b.tf, b.t, round(e20.y, 6) ema20, round(e12.y - e26.y, 6) macd
from b left join e20 on e20.symbol = b.symbol and e20.j = b.i left join e12 on e12.symbol = b.symbol and e12.j = b.i left join e26 on e26.symbol = b.symbol and e26.j = b.i
"""


@query("ema_macd", _EMA)
def ema_macd(spark, sf_dir):
    return _show(I.recursive(lineitem_bars(spark, sf_dir)), ["ema20", "macd"])


_WILDER = f"""
with recursive {BARS}, d as (
  select symbol, tf, i - 1 j, c - {lag('c')} dc, greatest(h - l, abs(h - {lag('c')}), abs(l - {lag('c')})) tr, h - {lag('h')} um, {lag('l')} - l dm from b
), g as (select symbol, tf, j, greatest(dc, 0) x from d where j >= 0), s as (select symbol, tf, j, greatest(-dc, 0) x from d where j >= 0), r as (select symbol, tf, j, tr x from d where j >= 0),
pd as (select symbol, tf, j, case when um > dm and um > 0 then um else 0 end x from d where j >= 0), md as (select symbol, tf, j, case when dm > um and dm > 0 then dm else 0 end x from d where j >= 0),
{smoothed('gy', 'g', 14, '(1.0/14)')}, {smoothed('sy', 's', 14, '(1.0/14)')}, {smoothed('ry', 'r', 14, '(1.0/14)')}, {smoothed('py', 'pd', 14, '(1.0/14)')}, {smoothed('my', 'md', 14, '(1.0/14)')},
di as (select ry.symbol, ry.tf, ry.j, py.y / ry.y * 100 p, my.y / ry.y * 100 m from ry join py using (symbol, tf, j) join my using (symbol, tf, j) where ry.y > 0),
dx as (select symbol, tf, row_number() over (partition by symbol, tf order by j) - 1 j, j j0, case when p + m = 0 then 0 else abs(p - m) / (p + m) * 100 end x from di),
{smoothed('ax', 'dx', 14, '(1.0/14)')}
select b.symbol, b.tf, b.t, round(case when sy.y = 0 then 100 else 100 - 100 / (1 + gy.y / sy.y) end, 6) rsi14, round(ry.y, 6) atr14, round(di.p, 6) plus_di, round(di.m, 6) minus_di, round(ax.y, 6) adx14
from b left join gy on gy.symbol = b.symbol and gy.j = b.i - 1 left join sy on sy.symbol = b.symbol and sy.j = b.i - 1 left join ry on ry.symbol = b.symbol and ry.j = b.i - 1
left join di on di.symbol = b.symbol and di.j = b.i - 1 left join dx on dx.symbol = b.symbol and dx.j0 = b.i - 1 left join ax on ax.symbol = dx.symbol and ax.j = dx.j
"""


@query("wilder", _WILDER)
def wilder(spark, sf_dir):
    return _show(I.recursive(lineitem_bars(spark, sf_dir)), ["rsi14", "atr14", "plus_di", "minus_di", "adx14"])


_PSAR = f"""
with recursive {BARS}, x as (select *, {lag('l')} l1, {lag('l', 2)} l2, {lag('h')} h1, {lag('h', 2)} h2 from b),
init as (select a.symbol, a.tf, a.h h0, a.l l0, z.h >= a.h up from b a join b z on z.symbol = a.symbol and z.i = 1 where a.i = 0),
r as (
  select symbol, tf, 0::bigint i, up, case when up then h0 else l0 end ep, case when up then l0 else h0 end sar, 0.02::double af from init
  union all
  select symbol, tf, i, case when flip then not up else up end,
    case when flip then case when up then l else h end when up and h > ep then h when not up and l < ep then l else ep end,
    case when flip then ep else s end,
    case when flip then 0.02 when (up and h > ep) or (not up and l < ep) then least(af + 0.02, 0.2) else af end
  from (
    select *, case when up then l < s else h > s end flip from (
      select r.symbol, r.tf, x.i, r.up, r.ep, r.af, x.h, x.l,
        case when r.up then least(r.sar + r.af * (r.ep - r.sar), x.l1, coalesce(x.l2, x.l1)) else greatest(r.sar + r.af * (r.ep - r.sar), x.h1, coalesce(x.h2, x.h1)) end s
      from r join x on x.symbol = r.symbol and x.tf = r.tf and x.i = r.i + 1))
)
select b.symbol, b.tf, b.t, round(r.sar + 1e-9, 6) psar, coalesce(case when r.up then 1 else -1 end, 0)::int psar_trend from b join r on r.symbol = b.symbol and r.i = b.i
"""


@query("psar", _PSAR)
def psar(spark, sf_dir):
    return I.recursive(lineitem_bars(spark, sf_dir)).select(*KEY, F.round(F.col("psar") + 1e-9, 6).alias("psar"), "psar_trend")


@query("nested_averages")
def nested_averages(spark, sf_dir):
    return _show(I.keltner(I.recursive(lineitem_bars(spark, sf_dir))), ["dema20", "tema20", "macd_signal", "macd_hist", "ema50", "ema200", "kc_up", "kc_lo"])


@query("regimes")
def regimes(spark, sf_dir):
    return I.classify_regime(I.bull_features(I.bands(I.recursive(lineitem_bars(spark, sf_dir))))).select(*KEY, "trend", "strength", "volatility", "alignment", "momentum", "regime")


@query("pivots", f"with {BARS}, {PIVOTS} select symbol, tf, i, t, round(price, 6) price, kind, class from piv")
def pivots(spark, sf_dir):
    return rounded(S.pivots(lineitem_bars(spark, sf_dir)).drop("prior"), ["price"])


@query("current_trend", f"""
with {BARS}, {PIVOTS}, r as (select *, row_number() over (partition by symbol, tf order by i desc, kind) r from piv),
x as (select symbol, tf, arg_max(class, i) filter (kind = 'high') h, arg_max(class, i) filter (kind = 'low') l from r where r <= 4 group by 1, 2)
select symbol, tf, case when h is null or l is null then 'unknown' when h = 'HH' and l = 'HL' then 'up' when h = 'LH' and l = 'LL' then 'down' else 'range' end trend from x
""")
def current_trend(spark, sf_dir):
    return S.current_trend(S.pivots(lineitem_bars(spark, sf_dir)))


_FVG = f"""fvg as (
  select symbol, tf, i, t, 'bull' kind, l top, h2 bottom from (select *, {lag('h', 2)} h2 from b) where h2 < l
  union all select symbol, tf, i, t, 'bear', l2, h from (select *, {lag('l', 2)} l2, {lag('h', 2)} h2 from b) where l2 > h and not coalesce(h2 < l, false)
)"""


@query("fvg_mitigation", f"""
with {BARS}, {_FVG}
select f.symbol, f.tf, f.i, f.t, f.kind, round(top, 6) top, round(bottom, 6) bottom, min(b.i) mitigated_i, min(b.t) mitigated_at
from fvg f left join b on b.symbol = f.symbol and b.i > f.i and b.l <= f.top and b.h >= f.bottom group by all
""")
def fvg_mitigation(spark, sf_dir):
    bars = lineitem_bars(spark, sf_dir)
    return rounded(S.zone_mitigation(S.fvg_zones(bars), bars), ["top", "bottom"])


@query("structure_breaks", f"""
with recursive {BARS}, {PIVOTS},
x as (select b.symbol, b.tf, b.i, b.t, b.c, hp.price ph, lp.price pl from b left join piv hp on hp.symbol = b.symbol and hp.i = b.i and hp.kind = 'high' left join piv lp on lp.symbol = b.symbol and lp.i = b.i and lp.kind = 'low'),
r as (
  select symbol, tf, -1::bigint i, null::bigint t, 0 trend, 0 side, 0 was, null::double hi, null::double lo, null::double level from x where i = 0
  union all
  select symbol, tf, i, t, case when side = 0 then trend else side end, side, trend, case when side = 1 then null else hi end, case when side = -1 then null else lo end, case when side = 1 then hi when side = -1 then lo end
  from (select r.symbol, r.tf, x.i, x.t, r.trend, coalesce(x.ph, r.hi) hi, coalesce(x.pl, r.lo) lo,
      case when x.c > coalesce(x.ph, r.hi) then 1 when x.c < coalesce(x.pl, r.lo) then -1 else 0 end side
    from r join x on x.symbol = r.symbol and x.tf = r.tf and x.i = r.i + 1)
)
select symbol, tf, i, t, case when was = -side then 'CHoCH' else 'BoS' end as type, case when side = 1 then 'up' else 'down' end dir, round(level, 6) as level from r where side <> 0
""")
def structure_breaks(spark, sf_dir):
    bars = lineitem_bars(spark, sf_dir)
    return rounded(S.structure_breaks(bars, S.pivots(bars)), ["level"])


@query("order_blocks")
def order_blocks(spark, sf_dir):
    bars = I.recursive(lineitem_bars(spark, sf_dir))
    return rounded(S.zone_mitigation(S.order_blocks(bars, S.pivots(bars)), bars), ["top", "bottom"])


def _tolerance(bars: DataFrame, share: float) -> DataFrame:
    """A share of each series' mean range."""
    return bars.groupBy(*SERIES).agg((F.avg(F.col("h") - F.col("l")) * share).alias("tolerance"))


@query("liquidity")
def liquidity(spark, sf_dir):
    bars = lineitem_bars(spark, sf_dir)
    return rounded(S.sweeps(S.liquidity_levels(S.pivots(bars), _tolerance(bars, 0.25)), bars), ["price"])


@query("sr_levels", f"""
with {BARS}, {PIVOTS}, tol as (select symbol, tf, avg(h - l) * 0.05 tolerance from b group by 1, 2),
x as (select piv.*, tolerance, max(i) over (partition by symbol, tf) newest, case when price - lag(price) over (partition by symbol, tf order by price, i) <= tolerance then 0 else 1 end fresh from piv join tol using (symbol, tf)),
y as (select *, sum(fresh) over (partition by symbol, tf order by price, i) cl from x),
z as (select symbol, tf, median(price) price, sum(pow(0.5, (newest - i) / 500)) strength, count(*) touches, case when count(distinct kind) = 2 then 'both' when max(kind) = 'high' then 'resistance' else 'support' end kind, max(t) last_t from y group by symbol, tf, cl)
select symbol, tf, round(price, 6) price, round(strength, 6) strength, touches, kind, last_t from z qualify row_number() over (partition by symbol, tf order by round(strength, 9) desc, price) <= 20
""")
def sr_levels(spark, sf_dir):
    bars = lineitem_bars(spark, sf_dir)
    return rounded(S.sr_levels(S.pivots(bars), _tolerance(bars, 0.05)), ["price", "strength"])


@query("trendlines", f"""
with {BARS}, {PIVOTS}, r as (select *, row_number() over (partition by symbol, tf, kind order by i desc) r from piv)
select symbol, tf, kind, round(regr_slope(price, i), 6) slope, round(regr_intercept(price, i), 4) intercept, round(greatest(0, least(1, regr_r2(price, i))), 6) r2, count(*) n from r where r <= 8 group by 1, 2, 3 having count(*) >= 3
""")
def trendlines(spark, sf_dir):
    return rounded(rounded(S.trendlines(S.pivots(lineitem_bars(spark, sf_dir))), ["slope", "r2"]), ["intercept"], 4)


@query("premium_discount", f"""
with {BARS}, {PIVOTS}, x as (select symbol, tf, arg_max(price, i) filter (kind = 'high') ph, arg_max(price, i) filter (kind = 'low') pl from piv group by 1, 2),
y as (select symbol, tf, max(h) hh, min(l) ll, arg_max(c, t) c from b group by 1, 2),
z as (select symbol, tf, c, case when ph is null or pl is null then hh else ph end rh, case when ph is null or pl is null then ll else pl end rl from y left join x using (symbol, tf))
select symbol, tf, round(c, 6) as close, round(rh, 6) range_high, round(rl, 6) range_low, round((c - rl) / (rh - rl), 6) pct,
  case when (c - rl) / (rh - rl) < 0 or (c - rl) / (rh - rl) > 1 then 'outside' when (c - rl) / (rh - rl) < 0.45 then 'discount' when (c - rl) / (rh - rl) <= 0.55 then 'equilibrium' else 'premium' end as zone from z where rh > rl
""")
def premium_discount(spark, sf_dir):
    bars = lineitem_bars(spark, sf_dir)
    return rounded(S.premium_discount(bars, S.pivots(bars)), ["close", "range_high", "range_low", "pct"])


@query("session_stats", """
with e as (select event_type symbol, epoch_ms(date_trunc('hour', ts)) t, max(value) h, min(value) l, count(*) v from events where value is not null group by 1, 2),
x as (select *, (t // 3600000) % 24 hr from e)
select symbol, '1h' tf, case when hr >= 22 or hr < 2 then 'asia' when hr >= 7 and hr < 10 then 'london' when hr >= 12 and hr < 15 then 'ny-am' when hr >= 13 and hr < 16 then 'ny-pm' else 'off-hours' end as session,
  count(*) n, round(avg(h - l), 6) avg_range, round(avg(v), 6) avg_volume from x group by 1, 2, 3
""")
def session_stats(spark, sf_dir):
    return rounded(S.session_stats(event_bars(spark, sf_dir)), ["avg_range", "avg_volume"])


@query("prev_day_high_low", """
with d as (select event_type symbol, '1h' tf, epoch_ms(date_trunc('day', ts)) // 86400000 as day, max(value) high, min(value) low from events where value is not null group by all)
select *, lag(high) over (partition by symbol order by day) prev_high, lag(low) over (partition by symbol order by day) prev_low from d
""")
def prev_day_high_low(spark, sf_dir):
    return S.prev_day_high_low(event_bars(spark, sf_dir))


@query("candle_patterns", f"""
with {BARS}, x as (select *, abs(c - o) body, h - l span, h - greatest(o, c) upper_, least(o, c) - l lower_, {lag('o')} o1, {lag('c')} c1, {lag('h')} - {lag('l')} span1, {lag('o', 2)} o2, {lag('c', 2)} c2 from b),
y as (select symbol, tf, t, list_filter([
  case when span > 0 and body / span <= 0.05 then 'doji' end, case when body <> 0 and lower_ >= 2 * body and upper_ <= body then 'hammer' end, case when body <> 0 and upper_ >= 2 * body and lower_ <= body then 'invHammer' end,
  case when c1 < o1 and c > o and c >= o1 and o <= c1 then 'bullEngulf' end, case when c1 > o1 and c < o and o >= c1 and c <= o1 then 'bearEngulf' end,
  case when c1 < o1 and c > o and greatest(o, c) <= greatest(o1, c1) and least(o, c) >= least(o1, c1) then 'bullHarami' end, case when c1 > o1 and c < o and greatest(o, c) <= greatest(o1, c1) and least(o, c) >= least(o1, c1) then 'bearHarami' end,
  case when c2 < o2 and c > o and span1 <> 0 and abs(c1 - o1) / span1 <= 0.3 and c > (o2 + c2) / 2 then 'morningStar' end, case when c2 > o2 and c < o and span1 <> 0 and abs(c1 - o1) / span1 <= 0.3 and c < (o2 + c2) / 2 then 'eveningStar' end
], lambda e: e is not null) patterns from x)
select symbol, tf, t, array_to_string(patterns, ',') patterns from y where len(patterns) > 0
""")
def candle_patterns(spark, sf_dir):
    return S.candle_patterns(lineitem_bars(spark, sf_dir)).withColumn("patterns", F.array_join("patterns", ","))
