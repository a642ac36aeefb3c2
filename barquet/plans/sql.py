"""SQL building blocks of the oracles: the same bars as the library's, and windows over them."""

BARS = """
bars as (
  select 'S' || l_suppkey as symbol, '1d' as tf, epoch_ms(l_shipdate) as t,
    arg_min(p, k) o, max(p) h, min(p) l, arg_max(p, k) c, sum(q) v
  from (select l_suppkey, l_shipdate, l_extendedprice / l_quantity p, l_quantity q, l_orderkey * 10 + l_linenumber k from lineitem)
  group by l_suppkey, l_shipdate
),
b as (select *, row_number() over (partition by symbol, tf order by t) - 1 as i from bars)
"""
W = "partition by symbol, tf order by t"


def frame(n: int) -> str:
    return f"over ({W} rows between {n - 1} preceding and current row)"


def full(n: int, x: str, digits: int = 6) -> str:
    return f"case when i >= {n - 1} then round({x}, {digits}) end"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) over ({W})"


PIVOTS = f"""
p0 as (
  select *, count(*) over (partition by symbol, tf) n,
    max(h) over ({W} rows between 2 preceding and 1 preceding) hb, max(h) over ({W} rows between 1 following and 2 following) ha,
    min(l) over ({W} rows between 2 preceding and 1 preceding) lb, min(l) over ({W} rows between 1 following and 2 following) la
  from b
),
p1 as (
  select symbol, tf, i, t, h price, 'high' kind from p0 where i >= 2 and i < n - 2 and hb < h and ha <= h
  union all select symbol, tf, i, t, l, 'low' from p0 where i >= 2 and i < n - 2 and lb > l and la >= l
),
piv as (
  select *, case when kind = 'high' then case when prior is null then 'H' when price > prior then 'HH' else 'LH' end
    else case when prior is null then 'L' when price > prior then 'HL' else 'LL' end end as class
  from (select *, lag(price) over (partition by symbol, tf, kind order by i) prior from p1)
)
"""


def smoothed(name: str, source: str, n: int, alpha: str) -> str:
    """A recursive table ``name`` (symbol, tf, j, y): exponential smoothing of ``source`` (symbol, tf, j, x), j from 0."""
    return f"""
{name} as (
  select symbol, tf, {n - 1}::bigint j, avg(x)::double y from {source} where j < {n} group by symbol, tf having count(*) = {n}
  union all
  select r.symbol, r.tf, s.j, r.y + {alpha} * (s.x - r.y) from {name} r join {source} s on s.symbol = r.symbol and s.tf = r.tf and s.j = r.j + 1
)
"""
