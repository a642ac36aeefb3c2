"""Queries of profiles of mistakes, trades by regime and shares, with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.series import rounded
from ..operators import learning as L
from ..operators import scoring as M
from ..operators import statistics as T
from ..sources.bars import lineitem_bars, table
from .sql import BARS

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


_D = "list_sum(list_transform(list_zip({a}, {b}), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"


@query("pattern_profiles", f"""
with e as (
  select vec_id id, embedding::double[] v, label % 2 = 0 mistake, case vec_id % 4 when 0 then 'direction' when 1 then 'interval-miss' when 2 then 'magnitude' end error_type,
    case when vec_id % 5 = 0 then 'short' when vec_id % 7 = 0 then null else 'long' end direction, case label % 3 when 0 then 'up' when 1 then 'down' end regime from embeddings
),
c as (select row_number() over (order by vec_id) - 1 k, embedding::double[] v from embeddings order by vec_id limit 4),
a as (select id, e.v, error_type, direction, regime, k as cluster from e, c where mistake qualify row_number() over (partition by id order by {_D.format(a='e.v', b='c.v')}, k) = 1),
m as (select cluster, list(x order by j) v from (select cluster, j, avg(x) x from (select cluster, generate_subscripts(v, 1) j, unnest(v) x from a) group by 1, 2) group by 1),
r as (select a.cluster, {_D.format(a='a.v', b='m.v')} d, row_number() over (partition by a.cluster order by {_D.format(a='a.v', b='m.v')}) - 1 k, count(*) over (partition by a.cluster) n from a join m using (cluster)),
q as (select cluster, d radius from r where k = floor(0.9 * (n - 1) + 1e-9)),
ok as (select q.cluster, count(*) n from e, q join m using (cluster) where not mistake and {_D.format(a='e.v', b='m.v')} <= radius group by 1),
er as (select cluster, string_agg(t || ':' || n, ',' order by t) errors from (select cluster, coalesce(error_type, 'unknown') t, count(*) n from a group by 1, 2) group by 1),
rg as (select cluster, t regime from (select cluster, coalesce(regime, 'unknown') t, count(*) n from a group by 1, 2) qualify row_number() over (partition by cluster order by n desc, t) = 1),
s as (select cluster, count(*) n, count(*) filter (direction = 'long') l, count(*) filter (direction = 'short') h from a group by 1)
select s.cluster::int as cluster, s.n n_mistakes, coalesce(ok.n, 0) n_correct, round(coalesce(ok.n, 0) / (coalesce(ok.n, 0) + s.n), 6) hit_rate, s.n >= 20 and coalesce(ok.n, 0) / (coalesce(ok.n, 0) + s.n) < 0.45 is_bad, round(radius, 6) radius,
  errors, case when l > 2 * h then 'long' when h > 2 * l then 'short' else 'mixed' end direction, rg.regime
from s join q using (cluster) join er using (cluster) join rg using (cluster) left join ok using (cluster)
""")
def pattern_profiles(spark, sf_dir):
    """Vectors of even labels as mistakes, around the vectors of the four smallest ids."""
    emb = table(spark, sf_dir, "embeddings")
    centers = [list(r.embedding) for r in emb.orderBy("vec_id").limit(4).collect()]
    k = F.col("vec_id")
    rows = emb.select(
        k.alias("id"), F.col("embedding").cast("array<double>").alias("vec"), (F.col("label") % 2 == 0).alias("mistake"),
        F.when(k % 4 == 0, "direction").when(k % 4 == 1, "interval-miss").when(k % 4 == 2, "magnitude").alias("error_type"),
        F.when(k % 5 == 0, "short").when(k % 7 != 0, "long").alias("direction"), F.when(F.col("label") % 3 == 0, "up").when(F.col("label") % 3 == 1, "down").alias("regime"),
    )
    out = L.pattern_profiles(rows, centers).drop("centroid")
    errors = F.array_join(F.transform(F.map_entries("errors"), lambda x: F.concat(x["key"], F.lit(":"), x["value"].cast("string"))), ",")
    return rounded(out.withColumn("errors", errors), ["hit_rate", "radius"])


@query("trade_metrics", """
with t as (select 'S' || l_suppkey symbol, '1d' tf, l_returnflag regime, (l_tax - l_discount) / 7 pnl from lineitem)
select symbol, tf, regime, count(*) n, round(avg((pnl > 0)::int), 6) hit_rate, round(avg(pnl) filter (pnl > 0), 6) avg_win, round(avg(pnl) filter (pnl < 0), 6) avg_loss, round(avg(pnl), 6) mean_pnl,
  round(case when sum(pnl) filter (pnl < 0) < 0 then coalesce(sum(pnl) filter (pnl > 0), 0) / -(sum(pnl) filter (pnl < 0)) end, 6) profit_factor, round(max(pnl), 6) best, round(min(pnl), 6) worst, grouping(regime) = 1 regime_total
from t group by grouping sets ((symbol, tf, regime), (symbol, tf), ())
""")
def trade_metrics(spark, sf_dir):
    """Order lines as trades of a supplier, the return flag as regime."""
    li = table(spark, sf_dir, "lineitem")
    trades = li.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"), F.lit("1d").alias("tf"), F.col("l_returnflag").alias("regime"), ((F.col("l_tax") - F.col("l_discount")) / 7).alias("pnl"))
    return rounded(M.metrics_by_regime(trades), ["hit_rate", "avg_win", "avg_loss", "mean_pnl", "profit_factor", "best", "worst"])


@query("minmax", f"""
with {BARS}, s as (select min(c) lc, max(c) - min(c) sc, min(v) lv, max(v) - min(v) sv from b where t < 900000000000)
select symbol, tf, t, round((c - lc) / sc, 6) c, round((v - lv) / sv, 6) v from b, s
""")
def minmax(spark, sf_dir):
    """Closes and volumes in spans of the bars before mid-1998."""
    bars = lineitem_bars(spark, sf_dir)
    out = T.apply_minmax(bars, T.fit_minmax(bars.filter("t < 900000000000"), ["c", "v"]), ["c", "v"])
    return rounded(out.select("symbol", "tf", "t", "c", "v"), ["c", "v"])
