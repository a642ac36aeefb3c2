"""Queries of the report operators, with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.series import SERIES, rounded
from ..operators import features as X
from ..operators import indicators as I
from ..operators import reports as R
from ..operators import scoring as M
from ..operators import structure as S
from ..sources.bars import event_bars, lineitem_bars, table
from .market import ORACLE_SQL as MARKET_SQL
from .sql import BARS, PIVOTS
from .study import features

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


@query("events_near", """
with e as (select event_type symbol, '1h' tf, epoch_ms(date_trunc('hour', ts)) t from events where value is not null group by 1, 2, 3),
c as (select event_id, epoch_us(ts) // 1000 as "at", 600000 dur, value impact, event_type s from events where event_type <> 'error' and value >= 10)
select symbol, tf, t, event_id, "at", "at" - t delta_ms, impact, case when t > "at" + dur then 'after' when t >= "at" then 'during' else 'before' end phase,
  row_number() over (partition by symbol, tf, t order by abs("at" - t), event_id) as rank
from e join c on abs("at" - t) <= 1800000 and s = symbol
""")
def events_near(spark, sf_dir):
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    calendar = table(spark, sf_dir, "events").filter("event_type <> 'error'").select(F.col("event_id").alias("id"), at.alias("at"), F.lit(600_000).alias("duration_ms"), F.col("value").alias("impact"), F.array("event_type").alias("symbols"))
    return R.events_near(event_bars(spark, sf_dir).select(*KEY), calendar, 1_800_000, 10.0)


@query("pattern_bias", f"""
with p as ({MARKET_SQL['candle_patterns']}), r as (select *, row_number() over (partition by symbol, tf order by t desc) r from p),
x as (select symbol, tf, exp(-0.18 * (r - 1)) w, unnest(string_split(patterns, ',')) p from r where r <= 3),
y as (select *, case when p in ('hammer', 'bullEngulf', 'bullHarami', 'morningStar', 'invHammer') then 1.0 when p in ('bearEngulf', 'bearHarami', 'eveningStar') then -1.0 end s from x)
select symbol, tf, round(case when count(s) = 0 then 0 else greatest(-1, least(1, sum(s * w) / sum(case when s is not null then w end))) end, 6) bias from y group by 1, 2
""")
def pattern_bias(spark, sf_dir):
    return rounded(R.pattern_bias(S.candle_patterns(lineitem_bars(spark, sf_dir))), ["bias"])


@query("committed_moves", f"""
with {BARS}, s as (select *, case when c > o then 'up' when c < o then 'down' else 'flat' end s from b),
r as (select *, sum(case when s is not distinct from p then 0 else 1 end) over (partition by symbol, tf order by t) run from (select *, lag(s) over (partition by symbol, tf order by t) p from s)),
k as (select *, row_number() over (partition by symbol, tf, run order by t) k from r),
c as (select *, last_value(case when k = 3 or i = 0 then s end ignore nulls) over (partition by symbol, tf order by t) committed from k),
g as (select *, i = 0 or committed <> lag(committed) over (partition by symbol, tf order by t) changed from c)
select symbol, tf, t, committed, changed, i - last_value(case when changed then i end ignore nulls) over (partition by symbol, tf order by t) dwell from g
""")
def committed_moves(spark, sf_dir):
    """The direction of bars with hysteresis."""
    state = F.when(F.col("c") > F.col("o"), "up").when(F.col("c") < F.col("o"), "down").otherwise("flat")
    return R.committed_states(lineitem_bars(spark, sf_dir), state).select(*KEY, "committed", "changed", F.col("dwell").cast("long"))


@query("regime_states")
def regime_states(spark, sf_dir):
    """Regimes that held for three bars."""
    regimes = I.classify_regime(I.bull_features(I.bands(I.recursive(lineitem_bars(spark, sf_dir)))))
    return R.committed_states(regimes, F.concat_ws("|", "trend", "strength", "volatility")).select(*KEY, "committed", "changed", "dwell")


@query("latest_feature_z")
def latest_feature_z(spark, sf_dir):
    return rounded(R.latest_feature_z(features(spark, sf_dir), X.NAMES), ["raw", "z"], 4)


@query("universe_counts", "select n_name as type, count(*) n from supplier join nation on s_nationkey = n_nationkey group by rollup (n_name)")
def universe_counts(spark, sf_dir):
    nations = F.broadcast(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("type")))  # a row a nation
    return R.universe_counts(table(spark, sf_dir, "supplier").join(nations, "s_nationkey"))


@query("top_modules")
def top_modules(spark, sf_dir):
    return R.top_modules(M.module_signals(M.prepared(lineitem_bars(spark, sf_dir))), list(M.MODULES))


@query("nearest_levels", f"""
with {BARS}, {PIVOTS}, e as (select symbol, tf, arg_max(c, t) c from b group by 1, 2),
d as (select piv.symbol, piv.tf, kind, round(price, 6) price, round(abs(price - c), 6) distance, row_number() over (partition by piv.symbol, piv.tf, kind order by abs(price - c), price) as rank from piv join e on e.symbol = piv.symbol and e.tf = piv.tf)
select * from d where rank <= 3
""")
def nearest_levels(spark, sf_dir):
    bars = lineitem_bars(spark, sf_dir)
    return rounded(R.nearest_levels(S.pivots(bars), bars.groupBy(*SERIES).agg(F.max_by("c", "t").alias("c"))), ["price", "distance"])


@query("recent_orders", "select o_custkey, o_orderkey, o_orderdate from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) r from orders) where r <= 2")
def recent_orders(spark, sf_dir):
    """The two newest orders of each customer: the feature is the number a group."""
    return R.recent(table(spark, sf_dir, "orders"), "o_orderdate", 2, ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey", "o_orderdate")


@query("due_predictions", "select event_id, epoch_us(ts) // 1000 + 60000 close_at from events where event_type <> 'purchase' and epoch_us(ts) // 1000 + 60000 <= 1705276800000")
def due_predictions(spark, sf_dir):
    """Events as predictions that close a minute on, purchases being validated; now is 2024-01-15."""
    rows = table(spark, sf_dir, "events").select("event_id", (F.unix_millis(F.col("ts").cast("timestamp")) + 60_000).alias("close_at"), (F.col("event_type") == "purchase").alias("validated"))
    return R.due_predictions(rows, 1_705_276_800_000).select("event_id", "close_at")


@query("training_pool", """
with l as (select l_orderkey k, l_shipdate::varchar || l_linenumber ts, case l_returnflag when 'R' then 'up' when 'A' then 'down' else 'flat' end d from lineitem),
v as (select k, d from (select *, row_number() over (partition by k order by ts desc, d desc) r from l) where r = 1),
x as (select o_orderkey prediction_id, o_orderdate created_at, case when d = 'up' then 1 when d = 'down' then -1 when d is not null then 0 end as label from orders left join v on k = o_orderkey)
select * from (select * from x where label is not null order by created_at desc, prediction_id limit 5000) union all select * from x where label is null
""")
def training_pool(spark, sf_dir):
    """Orders as contexts, the last line's return flag as what came of them."""
    contexts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("prediction_id"), F.col("o_orderdate").alias("created_at"))
    side = F.when(F.col("l_returnflag") == "R", "up").when(F.col("l_returnflag") == "A", "down").otherwise("flat")
    verdicts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("prediction_id"), side.alias("realised_direction"), F.concat(F.col("l_shipdate").cast("date").cast("string"), F.col("l_linenumber").cast("string")).alias("validated_at"))
    return R.label_training_pool(contexts, verdicts)


@query("bar_letters", f"""
with {BARS} select symbol, tf, t, strftime(epoch_ms(t), '%Y-%m-%d') as day, case when k < 26 then chr((65 + k)::int) else chr((64 + k // 26)::int) || chr((65 + k % 26)::int) end as letter from (select *, i % 702 as k from b)
""")
def bar_letters(spark, sf_dir):
    bars = S.indexed(lineitem_bars(spark, sf_dir))
    return bars.select(*KEY, R.day_key(F.col("t")).alias("day"), R.tpo_letter(F.col("i") % 702).alias("letter"))
