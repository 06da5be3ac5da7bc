"""Multi-symbol state vectors: per-symbol feature blocks pivoted to one row per time and packed into a fixed-length array.

A block is a long frame (symbol, ts, features...) for an explicit symbol list; each block is one
projection over shared windows, one pivot, and all blocks meet in an equi join on ts.
"""
from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.functions.mathx import clip, ratio, safe_div
from tapeworks.operators import indicators as I
from tapeworks.operators.cleaning import rolling_znorm
from tapeworks.operators.volatility import range_volatility
from tapeworks.plans.panel import Panel, on_chunks

PANEL = Panel()
SIZES = {"v1": 768, "v2": 1024}
#: fixed values: groups of the 768-position vector in order, with their widths
LAYOUT = {"ohlcv": 20, "technical": 160, "volume": 32, "orderbook": 80, "cross_asset": 20, "regime": 10, "portfolio": 50, "symbol": 16, "temporal": 10, "history": 370}
#: fixed values: look-back periods of the history group, in bars
PERIODS = (1, 2, 4, 8, 12, 24, 48, 72, 168)


def pivot_block(df: DataFrame, symbols: Sequence, cols: Sequence[str]) -> DataFrame:
    """One row per ts, columns <symbol>_<feature> in symbol-major order."""
    g = df.groupBy("ts").pivot("symbol", list(symbols)).agg(*[F.max(c).alias(c) for c in cols])
    if len(cols) == 1:
        g = g.select("ts", *[F.col(f"`{s}`").alias(f"{s}_{cols[0]}") for s in symbols])
    return g.select("ts", *[f"`{s}_{c}`" for s in symbols for c in cols])


def ohlcv_block(df: DataFrame, n: int = 24, p: Panel = PANEL) -> tuple[DataFrame, list[str]]:
    cols = ["open", "high", "low", "close", "volume"]
    return df.select(*p.keys, *p.order, *[rolling_znorm(c, n, p).alias(c) for c in cols]), cols


def technical_block(df: DataFrame, p: Panel = PANEL) -> tuple[DataFrame, list[str]]:
    """Indicators scaled to about [-1, 1] plus derived distances."""
    d = I.feature_set(df, p)
    c = F.col("close")
    out = {"rsi": F.col("rsi_14") / 50 - 1, "stoch": F.col("stoch_k") / 50 - 1, "williams": F.col("williams_r") / 50 + 1, "adx": F.col("adx") / 100, "bb_pct": clip(F.col("bb_pct"), -1.0, 2.0), "bb_width": F.col("bb_width"),
           "atr_rel": ratio("atr_14", "close"), "macd_rel": ratio("macd_hist", "close"), "sma_gap": ratio(c - F.col("sma_20"), "sma_20"), "roc": clip(F.col("roc_10") / 100, -1.0, 1.0), "mfi": F.col("mfi") / 50 - 1, "cmf": F.col("cmf")}
    return d.select(*p.keys, *p.order, *[F.coalesce(e, F.lit(0.0)).alias(k) for k, e in out.items()]), list(out)


def risk_block(df: DataFrame, n: int = 30, p: Panel = PANEL) -> tuple[DataFrame, list[str]]:
    """Range volatility, VaR and CVaR of trailing returns, drawdown and their trailing ranks."""
    d = range_volatility(df, n, p).withColumn("_r", ratio("close", F.lag("close").over(p.w)) - 1)
    w = p.trailing(n)
    d = d.withColumn("_l", F.array_sort(F.collect_list("_r").over(w)))
    k = max(1, int(0.05 * n))
    d = d.withColumn("var", F.when(F.size("_l") == n, -F.get("_l", F.lit(k - 1)))).withColumn("cvar", F.when(F.size("_l") == n, -F.aggregate(F.slice("_l", 1, k), F.lit(0.0), lambda a, x: a + x) / k))
    d = d.withColumn("drawdown", 1 - F.col("close") / F.max("close").over(w)).withColumn("vol", F.when(F.size("_l") == n, F.stddev_samp("_r").over(w)))
    cols = ["parkinson", "garman_klass", "var", "cvar", "drawdown", "vol"]
    return d.select(*p.keys, *p.order, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in cols]), cols


def level_block(df: DataFrame, c: str, n: int = 20, p: Panel = PANEL) -> tuple[DataFrame, list[str]]:
    """Dominance-type series: level, change, RSI, band position, z-score, regime."""
    d = I.bollinger(I.rsi(df, 14, c, p), n, 2.0, c, p)
    z = rolling_znorm(c, n, p)
    d = d.withColumn("z", z).withColumn("change", F.col(c) - F.lag(c).over(p.w))
    reg = F.when(F.col("z") > 1, 1.0).when(F.col("z") < -1, -1.0).otherwise(0.0)
    out = {"level": F.col(c), "change": F.col("change"), "rsi": F.col("rsi_14"), "band": F.col("bb_pct"), "z": F.col("z"), "regime": reg}
    return d.select(*p.keys, *p.order, *[F.coalesce(e, F.lit(0.0)).alias(k) for k, e in out.items()]), list(out)


def portfolio_block(positions: DataFrame, prices: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Per symbol and ts: weight, unrealized return and holding days of positions joined to prices (missing = flat)."""
    k = list(keys)
    j = prices.select(*k, "ts", "close").join(positions.select(*k, "quantity", "entry", "opened"), k, "left")
    v = F.coalesce(F.col("quantity") * F.col("close"), F.lit(0.0))
    from pyspark.sql import Window
    live = F.coalesce(F.col("ts") >= F.col("opened"), F.lit(False))
    j = j.withColumn("_v", F.when(live, v).otherwise(0.0))
    tot = F.sum(F.abs("_v")).over(Window.partitionBy("ts"))
    return j.select(*k, "ts", safe_div("_v", tot).alias("weight"), F.when(live, ratio("close", "entry") - 1).otherwise(0.0).alias("unrealized"), F.when(live, F.datediff("ts", "opened").cast("double")).otherwise(0.0).alias("held_days"))


def index_map(blocks: Mapping[str, Sequence[str]]) -> list[tuple]:
    """(block, feature, position) in packing order."""
    out, at = [], 0
    for b, cols in blocks.items():
        for c in cols:
            out.append((b, c, at))
            at += 1
    return out


def assemble(blocks: Mapping[str, DataFrame], size: int) -> tuple[DataFrame, list[tuple]]:
    """Join blocks on ts and pack them into ``state`` ARRAY<FLOAT> of fixed length (zero padded); returns (frame, index map)."""
    names = {b: [c for c in d.columns if c != "ts"] for b, d in blocks.items()}
    imap = index_map(names)
    if len(imap) > size:
        raise ValueError(f"{len(imap)} features exceed the vector size {size}")
    out, packed = None, []
    for b, d in blocks.items():
        x = d.select("ts", *[F.col(f"`{c}`").alias(f"{b}__{c}") for c in names[b]])
        out = x if out is None else out.join(x, "ts")
        packed += [F.coalesce(F.col(f"`{b}__{c}`"), F.lit(0.0)).cast("float") for c in names[b]]
    pad = F.array_repeat(F.lit(0.0).cast("float"), size - len(packed))
    return out.select("ts", F.concat(F.array(*packed), pad).alias("state")), imap


# -- fixed layout -------------------------------------------------------------------------

def volume_block(df: DataFrame, p: Panel = PANEL) -> tuple[DataFrame, list[str]]:
    """Volume against its means of 20 and 50 bars, changes over 1, 4 and 24 bars, rank in the last 169, spike flag, correlation with price over 25."""
    v, cols = F.col("volume"), ["ratio_20", "ratio_50", "change_1", "change_4", "change_24", "rank", "spike", "price_corr"]
    full = lambda n: F.when(F.count("volume").over(p.trailing(n)) == n, F.avg("volume").over(p.trailing(n)))
    within = lambda x, lo, hi, default: F.when(x.isNotNull(), clip(x, lo, hi) / 5).otherwise(default)
    share = lambda n: within(v / (full(n) + 1e-8), 0.0, 5.0, 0.2)
    change = lambda n: within((v - F.lag(v, n).over(p.w)) / (F.lag(v, n).over(p.w) + 1e-8), -5.0, 5.0, 0.0)
    d = df.withColumn("_l", F.collect_list("volume").over(p.trailing(169))).withColumn("_c", F.corr("volume", "close").over(p.trailing(25)))
    out = [share(20), share(50), change(1), change(4), change(24), F.size(F.filter("_l", lambda x: x <= v)) / F.size("_l"),
           F.coalesce((v > 2 * full(20)).cast("double"), F.lit(0.0)), F.coalesce(F.nanvl("_c", F.lit(0.0)), F.lit(0.0))]
    return d.select(*p.keys, *p.order, *[e.alias(c) for e, c in zip(out, cols)]), cols


def history_block(df: DataFrame, periods: Sequence[int] = PERIODS, p: Panel = PANEL, bucket=None, rows: int = 50_000) -> tuple[DataFrame, list[str]]:
    """Return, volatility, range, change of return and change of volume over each period, 0 until the period is full.

    All of them are cut from one array of the last ``max(periods) + 1`` bars, collected once per row on chunks with that halo.
    """
    n = max(periods)
    names = [f"{f}_{q}" for f in ("return", "volatility", "range", "momentum", "volume_change") for q in periods]

    def cut(d: DataFrame, q: Panel) -> DataFrame:
        bar = F.struct(F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").alias("v"))
        d = d.withColumn("_b", F.collect_list(bar).over(q.trailing(n + 1)))
        at = lambda back: F.get(F.col("_b"), F.size("_b") - 1 - back)
        d = d.withColumn("_ret", F.expr("transform(slice(_b, 2, greatest(size(_b) - 1, 0)), (x, i) -> (x.c - _b[i].c) / (_b[i].c + 1e-8D))"))
        c, v = F.col("close"), F.col("volume")
        ret = lambda back: F.get(F.col("_ret"), F.size("_ret") - 1 - back)

        def deviation(k: int):
            last = F.slice("_ret", -k, k)
            mean = F.array(F.aggregate(last, F.lit(0.0), lambda a, x: a + x) / k)  # bound by a lambda, or each element would sum anew
            return F.sqrt(F.get(F.transform(mean, lambda m: F.aggregate(last, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / k), F.lit(0)))

        def spread(k: int):
            last = F.slice("_b", -(k + 1), k + 1)
            return (F.array_max(F.transform(last, lambda x: x["h"])) - F.array_min(F.transform(last, lambda x: x["l"]))) / (c + 1e-8)

        def when(k: int, e):  # the period is full where there is a bar k back
            return F.when(F.size("_b") > k, e).otherwise(0.0)
        out = [when(k, clip((c - at(k)["c"]) / (at(k)["c"] + 1e-8), -1.0, 1.0)) for k in periods]
        out += [when(k, clip(deviation(k), 0.0, 1.0)) for k in periods]
        out += [when(k, clip(spread(k), 0.0, 1.0)) for k in periods]
        out += [F.when(F.col("_rn") > k + 1, clip(ret(0) - ret(1), -1.0, 1.0)).otherwise(0.0) for k in periods]
        out += [when(k, clip((v - at(k)["v"]) / (at(k)["v"] + 1e-8), -5.0, 5.0) / 5) for k in periods]
        return d.select("_chunk", "_home", "_rn", "_pos", *p.keys, *p.order, *[e.alias(x) for e, x in zip(out, names)])

    return on_chunks(df, p, cut, before=n, bucket=bucket, rows=rows), names


def temporal_block(times: DataFrame) -> tuple[DataFrame, list[str]]:
    """Hour, weekday, day and month as points on a circle, weekend, and 1 for a market that never closes; one row per ts."""
    turn = {"hour": F.hour("ts") / 24, "weekday": F.weekday("ts") / 7, "day": (F.dayofmonth("ts") - 1) / 31, "month": (F.month("ts") - 1) / 12}
    out = {f"{k}_{f}": g(2 * math.pi * e) for k, e in turn.items() for f, g in (("sin", F.sin), ("cos", F.cos))}
    out |= {"weekend": (F.weekday("ts") >= 5).cast("double"), "open": F.lit(1.0)}
    return times.select("ts", *[e.alias(k) for k, e in out.items()]), list(out)


def positions(symbols: Sequence, by_symbol: Mapping[str, Sequence[str]], by_time: Mapping[str, Sequence[str]], layout: Mapping[str, int] = LAYOUT) -> list[tuple]:
    """(position, group, symbol, feature) of the whole layout; symbol and feature are None where a position is padding."""
    out = []
    for group, width in layout.items():
        held = [(str(s), f) for s in symbols for f in by_symbol.get(group, ())] or [(None, f) for f in by_time.get(group, ())]
        if len(held) > width:
            raise ValueError(f"{len(held)} features exceed the {width} positions of {group}")
        out += [(len(out) + i, group, *(held[i] if i < len(held) else (None, None))) for i in range(width)]
    return out


def laid_out(symbols: Sequence, by_symbol: Mapping[str, tuple[DataFrame, Sequence[str]]], by_time: Mapping[str, tuple[DataFrame, Sequence[str]]],
             layout: Mapping[str, int] = LAYOUT, kind: str = "float") -> tuple[DataFrame, list[tuple]]:
    """One row per ts that every symbol has, with ``state`` in the fixed layout, and its map.

    ``by_symbol`` holds frames of (symbol, ts, features), ``by_time`` frames of (ts, features); groups in neither are zeros.
    """
    out = None
    parts = {}
    for group, (d, cols) in by_symbol.items():
        packed = F.array(*[F.coalesce(F.col(c).cast(kind), F.lit(0.0).cast(kind)) for c in cols])
        g = d.groupBy("ts").agg(*[F.first(F.when(F.col("symbol") == s, packed), ignorenulls=True).alias(f"{group}__{i}") for i, s in enumerate(symbols)]).dropna()
        parts[group] = [F.col(f"{group}__{i}") for i in range(len(symbols))], len(symbols) * len(cols)
        out = g if out is None else out.join(g, "ts")
    for group, (d, cols) in by_time.items():
        g = d.select("ts", F.array(*[F.coalesce(F.col(c).cast(kind), F.lit(0.0).cast(kind)) for c in cols]).alias(group))
        parts[group] = [F.col(group)], len(cols)
        out = g if out is None else out.join(g, "ts")
    arrays = []
    for group, width in layout.items():
        have, n = parts.get(group, ([], 0))
        arrays += have + ([F.array_repeat(F.lit(0.0).cast(kind), width - n)] if width > n else [])
    names = {g: c for g, (_d, c) in by_symbol.items()}, {g: c for g, (_d, c) in by_time.items()}
    return out.select("ts", F.concat(*arrays).alias("state")), positions(symbols, *names, layout)


def slice_windows(states: DataFrame, start: int, end: int) -> DataFrame:
    """Rows [start, end) of the whole history by position in time (one row per grid step, so the numbering is grid-bounded)."""
    from pyspark.sql import Window
    d = states.withColumn("_m", F.date_trunc("month", "ts"))
    c = d.groupBy("_m").agg(F.count(F.lit(1)).alias("_c"))
    off = c.select("_m", F.coalesce(F.sum("_c").over(Window.orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    d = d.join(off, "_m").withColumn("pos", F.col("_o") + F.row_number().over(Window.partitionBy("_m").orderBy("ts")) - 1)
    return d.where((F.col("pos") >= start) & (F.col("pos") < end)).drop("_m", "_o")
