"""Shared CTE texts and rounding for the query / SQL pairs."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# events as trades
TICKS = """ticks AS (SELECT user_id AS symbol, ts, event_id AS trade_id, value AS price,
  CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE) + 1 AS volume,
  CASE WHEN event_type IN ('purchase','signup') THEN 'buy' ELSE 'sell' END AS side, event_type FROM events)"""
# events as order messages
ORDERS_EV = """ev0 AS (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k FROM events),
oev AS (SELECT ts, event_id, user_id || '-' || (k % 3) AS order_id, value AS price, CAST(k + 1 AS DOUBLE) AS size,
  CASE WHEN k % 2 = 0 THEN 'buy' ELSE 'sell' END AS side,
  CASE WHEN event_type IN ('purchase','signup') THEN 'place' WHEN event_type = 'click' THEN 'fill' ELSE 'cancel' END AS event_type,
  user_id AS account_id, k % 5 AS symbol FROM ev0)"""
TRADES = """trades AS (SELECT l_suppkey AS symbol, l_shipdate AS ts, l_orderkey AS order_id, l_linenumber AS line_no,
  l_partkey AS item_id, l_extendedprice / l_quantity AS price, l_quantity AS volume,
  CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side FROM lineitem)"""
BARS = TRADES + """,
bars AS (SELECT symbol, ts, arg_min(price, row(order_id, line_no, item_id)) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, row(order_id, line_no, item_id)) AS close, sum(volume) AS volume, count(*) AS n_trades FROM trades GROUP BY symbol, ts)"""
HBARS = TICKS + """,
bars AS (SELECT symbol, date_trunc('hour', ts) AS ts, arg_min(price, row(ts, trade_id)) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, row(ts, trade_id)) AS close, sum(volume) AS volume, count(*) AS n_trades FROM ticks GROUP BY symbol, date_trunc('hour', ts))"""
MARKET = """market AS (SELECT n_name AS symbol, l_shipdate AS ts, sum(l_extendedprice) / sum(l_quantity) AS close, sum(l_quantity) AS volume
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name, l_shipdate)"""


def rd(c, d: int = 4, infinite: bool = False) -> Column:
    """Round half up with the boundary moved off exact decimal ties, so both engines agree.

    ``infinite`` is for columns that may hold infinities or NaN; these stay as they are.
    """
    c = F.col(c) if isinstance(c, str) else c
    k = float(10 ** d)
    out = F.floor(c.cast("double") * k + 0.5003).cast("double") / k
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), c).otherwise(out) if infinite else out


def rcols(df, keep, cols, d: int = 4, infinite: bool = False):
    return df.select(*keep, *[rd(c, d, infinite).alias(c) for c in cols])


def R(expr: str, name: str | None = None, d: int = 4) -> str:
    return f"floor(CAST({expr} AS DOUBLE) * {10 ** d}.0::DOUBLE + 0.5003::DOUBLE) / {10 ** d}.0::DOUBLE AS {name or expr}"


def RS(names, d: int = 4) -> str:
    return ", ".join(R(n, n, d) for n in names)


def ema_sql(x: str, span: float, skip: int = 0) -> str:
    """Closed form of the adjust=False recurrence over the window ``w`` of positions ``rn``."""
    a = 1 - 2.0 / (span + 1)
    return (f"(pow({a!r}, rn) * sum(({x}) * (CASE WHEN rn = {skip + 1} THEN 1.0 ELSE {1 - a!r} END) * pow({a!r}, -rn)) OVER w)")
