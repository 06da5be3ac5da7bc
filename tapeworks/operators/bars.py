"""Bars, resampling and returns.

Every aggregate here is map-side combined, so a symbol holding a third of the ticks
costs one partial row per (task, bar). After this step a symbol has at most
(time span / bar width) rows, which is what bounds the window operators on bars.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.plans.panel import Panel

PANEL = Panel()


def bar_start(freq: str, ts: str = "ts") -> Column:
    """Epoch-aligned bar start."""
    return F.window(F.col(ts), freq)["start"]


def packed(*parts: tuple[Column | str, int]) -> Column:
    """One exact number that sorts like the parts, non-negative integers with their digits, 38 digits in all.

    Minima and maxima by a number fit in a hash aggregate; by a struct they make Spark sort all rows first.
    """
    digits = [n for _, n in parts]
    if sum(digits) > 38:
        raise ValueError(f"{sum(digits)} digits don't fit in 38")
    out = None
    for i, (c, _) in enumerate(parts):
        part = (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")
        unit = sum(digits[i + 1:])
        part = (part * F.lit("1" + "0" * unit).cast(f"decimal({unit + 1},0)")).cast("decimal(38,0)") if unit else part.cast("decimal(38,0)")
        out = part if out is None else (out + part).cast("decimal(38,0)")
    return out


def time_order(ts: str = "ts", tie: Sequence[str] = ()) -> Column:
    """Order by time and ties: one number for at most one tie, a long, and a struct for more."""
    if len(tie) > 1:
        return F.struct(ts, *tie)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return packed((micros, 19), (tie[0], 19)) if tie else micros


def trade_bars(df: DataFrame, freq: str, *, keys: Sequence[str] = ("symbol",), ts: str = "ts", price: str = "price",
               volume: str = "volume", tie: Sequence[str] = (), order: Column | None = None) -> DataFrame:
    """OHLCV bars. ``order`` says which trade of a bar is first and last, by default time and ties; a number keeps the aggregate hashed."""
    order = time_order(ts, tie) if order is None else order
    return (df.groupBy(*keys, F.window(ts, freq).alias("_w"))
              .agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
                   F.max_by(price, order).alias("close"), F.sum(volume).alias("volume"),
                   F.count(F.lit(1)).alias("n_trades"))
              .select(*keys, F.col("_w.start").alias("ts"), "open", "high", "low", "close", "volume", "n_trades"))


def resample_last(df: DataFrame, freq: str, value: str = "close", *, keys: Sequence[str] = ("symbol",),
                  ts: str = "ts", tie: Sequence[str] = ()) -> DataFrame:
    """Last non-null value per bar; bars without one are absent."""
    order = time_order(ts, tie)
    return (df.where(F.col(value).isNotNull()).groupBy(*keys, F.window(ts, freq).alias("_w"))
              .agg(F.max_by(value, order).alias(value))
              .select(*keys, F.col("_w.start").alias("ts"), value))


def merge_duplicates(df: DataFrame, numeric: Sequence[str], keys: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in numeric])


def pct_change(c: str | Column, panel: Panel = PANEL, n: int = 1) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    p = F.lag(c, n).over(panel.w)
    return F.when(p != 0, c / F.when(p != 0, p) - 1).when(p.isNotNull(), 0.0)


def log_return(c: str | Column, panel: Panel = PANEL, n: int = 1) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    p = F.lag(c, n).over(panel.w)
    ok = (c > 0) & (p > 0)
    return F.when(ok, F.ln(F.when(ok, c / p))).when(p.isNotNull(), 0.0)


def with_returns(df: DataFrame, price: str = "close", panel: Panel = PANEL) -> DataFrame:
    """simple_return, log_return; first row null, non-finite zero."""
    return df.withColumn("simple_return", pct_change(price, panel)).withColumn("log_return", log_return(price, panel))


def portfolio_bars(df: DataFrame, values: Sequence[str], symbols: Sequence, key: str = "symbol", ts: str = "ts") -> DataFrame:
    """Long to wide: one column per (symbol, value) for an explicit symbol list."""
    aggs = [F.max(v).alias(v) for v in values]
    return df.groupBy(ts).pivot(key, list(symbols)).agg(*aggs)
