"""Technical indicators as window expressions over a panel of bars.

Each function adds columns and returns the frame; windows share one (key, order) spec so
Spark sorts once per call chain. Values are null until their window is full. A frame's sums
are columns before they are used (``frame_parts``): Spark computes a window function anew wherever it is written.

Recursive averages (EMA family) are written as weighted running sums. Their memory decays,
so rows further back than ``ema_memory`` cannot change a double; ``with_emas`` therefore
runs them on chunks with that halo instead of one scan per key.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.mathx import ratio, safe_div
from tapeworks.plans.panel import Panel, frame_parts, on_chunks, running

PANEL = Panel()
OHLCV = ("open", "high", "low", "close", "volume")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def full(expr: Column, c, n: int, p: Panel) -> Column:
    """Null until n non-null values are in the trailing frame."""
    return F.when(F.count(_col(c)).over(p.trailing(n)) == n, expr)


# -- moving averages and bands ------------------------------------------------------------

def sma(df: DataFrame, n: int, c: str = "close", p: Panel = PANEL, out: str | None = None) -> DataFrame:
    return df.withColumn(out or f"sma_{n}", full(F.avg(c).over(p.trailing(n)), c, n, p))


def wma(df: DataFrame, n: int, c: str = "close", p: Panel = PANEL, out: str | None = None) -> DataFrame:
    total = sum((F.lag(c, n - k).over(p.w) * float(k) for k in range(1, n)), F.col(c) * float(n))
    return df.withColumn(out or f"wma_{n}", total / (n * (n + 1) / 2))


def bollinger(df: DataFrame, n: int = 20, k: float = 2.0, c: str = "close", p: Panel = PANEL, sample: bool = False) -> DataFrame:
    """bb_mid, bb_upper, bb_lower, bb_width, bb_pct."""
    w = p.trailing(n)
    sd = F.stddev_samp(c).over(w) if sample else F.stddev_pop(c).over(w)
    d = df.withColumn("bb_mid", full(F.avg(c).over(w), c, n, p)).withColumn("_sd", sd)
    d = d.withColumn("bb_upper", F.col("bb_mid") + k * F.col("_sd")).withColumn("bb_lower", F.col("bb_mid") - k * F.col("_sd"))
    return (d.withColumn("bb_width", ratio(F.col("bb_upper") - F.col("bb_lower"), F.col("bb_mid")))
             .withColumn("bb_pct", ratio(F.col(c) - F.col("bb_lower"), F.col("bb_upper") - F.col("bb_lower"))).drop("_sd"))


def true_range(df: DataFrame, p: Panel = PANEL, out: str = "tr") -> DataFrame:
    pc = F.lag("close").over(p.w)
    return df.withColumn(out, F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc)))


def atr(df: DataFrame, n: int = 14, p: Panel = PANEL, out: str | None = None) -> DataFrame:
    d = true_range(df, p, "_tr")
    return d.withColumn(out or f"atr_{n}", full(F.avg("_tr").over(p.trailing(n)), "_tr", n, p)).drop("_tr")


def rolling_std(df: DataFrame, n: int, c: str = "close", p: Panel = PANEL, out: str | None = None) -> DataFrame:
    return df.withColumn(out or f"std_{n}", full(F.stddev_pop(c).over(p.trailing(n)), c, n, p))


def donchian(df: DataFrame, n: int = 20, p: Panel = PANEL) -> DataFrame:
    w = p.trailing(n)
    d = df.withColumn("dc_upper", full(F.max("high").over(w), "high", n, p)).withColumn("dc_lower", full(F.min("low").over(w), "low", n, p))
    return d.withColumn("dc_mid", (F.col("dc_upper") + F.col("dc_lower")) / 2)


def historical_volatility(df: DataFrame, n: int = 20, periods: float = 365, c: str = "close", p: Panel = PANEL, out: str = "hist_vol") -> DataFrame:
    d = df.withColumn("_r", F.ln(F.col(c) / F.lag(c).over(p.w)))
    return d.withColumn(out, full(F.stddev_pop("_r").over(p.trailing(n)), "_r", n, p) * math.sqrt(periods)).drop("_r")


def relative_volatility_index(df: DataFrame, n: int = 14, vol_n: int = 10, c: str = "close", p: Panel = PANEL, out: str = "rvi") -> DataFrame:
    """RSI form on the rolling deviation of the previous ``vol_n`` prices, split by direction of the move."""
    d = df.withColumn("_s", F.when(F.count(c).over(p.prior(vol_n)) == vol_n, F.stddev_pop(c).over(p.prior(vol_n))))
    d = d.withColumn("_up", F.when(F.col(c) > F.lag(c).over(p.w), F.col("_s")).when(F.col("_s").isNotNull(), 0.0))
    d = d.withColumn("_dn", F.col("_s") - F.col("_up"))
    u, v = F.avg("_up").over(p.trailing(n)), F.avg("_dn").over(p.trailing(n))
    return d.withColumn(out, full(F.when(v == 0, 100.0).otherwise(100 - 100 / (1 + ratio(u, v))), "_s", n, p)).drop("_s", "_up", "_dn")


# -- oscillators --------------------------------------------------------------------------

def rsi(df: DataFrame, n: int = 14, c: str = "close", p: Panel = PANEL, out: str | None = None) -> DataFrame:
    """Simple-mean RSI; flat = 50, no losses = 100."""
    d = df.withColumn("_d", F.col(c) - F.lag(c).over(p.w))
    w = p.trailing(n)
    g, l = F.avg(F.greatest(F.col("_d"), F.lit(0.0))).over(w), F.avg(F.greatest(-F.col("_d"), F.lit(0.0))).over(w)
    v = F.when((g == 0) & (l == 0), 50.0).when(l == 0, 100.0).otherwise(100 - 100 / (1 + ratio(g, l)))
    return d.withColumn(out or f"rsi_{n}", full(v, "_d", n, p)).drop("_d")


def stochastic(df: DataFrame, n: int = 14, d_n: int = 3, p: Panel = PANEL) -> DataFrame:
    w = p.trailing(n)
    hh, ll = F.max("high").over(w), F.min("low").over(w)
    k = F.when(hh == ll, 50.0).otherwise(100 * ratio(F.col("close") - ll, hh - ll))
    d = df.withColumn("stoch_k", full(k, "close", n, p))
    return d.withColumn("stoch_d", full(F.avg("stoch_k").over(p.trailing(d_n)), "stoch_k", d_n, p))


def stochastic_rsi(df: DataFrame, n: int = 14, c: str = "close", p: Panel = PANEL, out: str = "stoch_rsi") -> DataFrame:
    d = rsi(df, n, c, p, "_rsi")
    w = p.trailing(n)
    hi, lo = F.max("_rsi").over(w), F.min("_rsi").over(w)
    v = F.when(hi == lo, 0.5).otherwise(ratio(F.col("_rsi") - lo, hi - lo))
    return d.withColumn(out, full(v, "_rsi", n, p)).drop("_rsi")


def williams_r(df: DataFrame, n: int = 14, p: Panel = PANEL, out: str = "williams_r") -> DataFrame:
    w = p.trailing(n)
    hh, ll = F.max("high").over(w), F.min("low").over(w)
    return df.withColumn(out, full(F.when(hh == ll, -50.0).otherwise(-100 * ratio(hh - F.col("close"), hh - ll)), "close", n, p))


def cci(df: DataFrame, n: int = 20, p: Panel = PANEL, out: str = "cci") -> DataFrame:
    w = p.trailing(n)
    d = df.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    d = d.withColumn("_m", F.avg("_tp").over(w)).withColumn("_l", F.collect_list("_tp").over(w))
    md = F.aggregate("_l", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("_m"))) / n
    d = d.withColumn("_md", md)
    v = F.when(F.col("_md") == 0, 0.0).otherwise((F.col("_tp") - F.col("_m")) / F.nullif(0.015 * F.col("_md"), F.lit(0.0)))
    return d.withColumn(out, F.when(F.size("_l") == n, v)).drop("_tp", "_m", "_l", "_md")


def adx(df: DataFrame, n: int = 14, smooth: bool = False, p: Panel = PANEL) -> DataFrame:
    """plus_di, minus_di, adx. Without ``smooth`` adx is the DX of mean directional moves; with it, DX averaged over n."""
    up, dn = F.col("high") - F.lag("high").over(p.w), F.lag("low").over(p.w) - F.col("low")
    d = true_range(df, p, "_tr").withColumn("_u", up).withColumn("_v", dn)
    d = d.withColumn("_has", F.lag("close").over(p.w))
    pdm = F.when((F.col("_u") > F.col("_v")) & (F.col("_u") > 0), F.col("_u")).when(F.col("_u").isNotNull(), 0.0)
    mdm = F.when((F.col("_v") > F.col("_u")) & (F.col("_v") > 0), F.col("_v")).when(F.col("_u").isNotNull(), 0.0)
    w = p.trailing(n)
    d = d.withColumn("_p", pdm).withColumn("_q", mdm).withColumn("_trd", F.when(F.col("_has").isNotNull(), F.col("_tr")))
    t = F.avg("_trd").over(w)
    d = (d.withColumn("plus_di", full(safe_div(100 * F.avg("_p").over(w), t), "_u", n, p))
          .withColumn("minus_di", full(safe_div(100 * F.avg("_q").over(w), t), "_u", n, p)))
    dx = safe_div(100 * F.abs(F.col("plus_di") - F.col("minus_di")), F.col("plus_di") + F.col("minus_di"))
    d = d.withColumn("adx", F.when(F.col("plus_di").isNotNull(), dx)).drop("_tr", "_u", "_v", "_has", "_p", "_q", "_trd")
    return d.withColumn("adx", full(F.avg("adx").over(w), "adx", n, p)) if smooth else d


def roc(df: DataFrame, n: int = 10, c: str = "close", p: Panel = PANEL, out: str | None = None) -> DataFrame:
    past = F.lag(c, n).over(p.w)
    return df.withColumn(out or f"roc_{n}", F.when(past == 0, 0.0).otherwise(100 * (ratio(F.col(c), past) - 1)))


def momentum(df: DataFrame, n: int = 10, c: str = "close", p: Panel = PANEL, out: str | None = None) -> DataFrame:
    return df.withColumn(out or f"mom_{n}", F.col(c) - F.lag(c, n).over(p.w))


def aroon(df: DataFrame, n: int = 25, p: Panel = PANEL) -> DataFrame:
    """Position of the latest extreme in the window, 0 to 100."""
    w = p.trailing(n)
    last = lambda c, pick: F.size(c) - F.array_position(F.reverse(c), pick(c))
    d = df.withColumn("_h", F.collect_list("high").over(w)).withColumn("_l", F.collect_list("low").over(w))
    ok = F.size("_h") == n
    d = (d.withColumn("aroon_up", F.when(ok, 100.0 * (last(F.col("_h"), F.array_max) + 1) / n))
          .withColumn("aroon_down", F.when(ok, 100.0 * (last(F.col("_l"), F.array_min) + 1) / n)))
    return d.withColumn("aroon_osc", F.col("aroon_up") - F.col("aroon_down")).drop("_h", "_l")


def ultimate_oscillator(df: DataFrame, n: Sequence[int] = (7, 14, 28), p: Panel = PANEL, out: str = "uo") -> DataFrame:
    pc = F.lag("close").over(p.w)
    low = F.least(F.col("low"), pc)
    tr = F.greatest(F.col("high"), pc) - low
    has = pc.isNotNull()
    d = df.withColumn("_bp", F.when(has, F.col("close") - low)).withColumn("_tr", F.when(has, F.when(tr > 0, tr).otherwise(0.001)))
    a = [F.sum("_bp").over(p.trailing(k)) / F.greatest(F.sum("_tr").over(p.trailing(k)), F.lit(0.001)) for k in n]
    return d.withColumn(out, full(100 * (4 * a[0] + 2 * a[1] + a[2]) / 7, "_bp", n[2], p)).drop("_bp", "_tr")


def kst(df: DataFrame, c: str = "close", p: Panel = PANEL, out: str = "kst") -> DataFrame:
    d, terms = df, []
    for i, (r, s) in enumerate(((10, 10), (15, 10), (20, 10), (30, 15)), 1):
        d = roc(d, r, c, p, f"_r{i}")
        terms.append(full(F.avg(f"_r{i}").over(p.trailing(s)), f"_r{i}", s, p) * float(i))
    return d.withColumn(out, sum(terms[1:], terms[0])).drop("_r1", "_r2", "_r3", "_r4")


def dpo(df: DataFrame, n: int = 20, c: str = "close", p: Panel = PANEL, out: str = "dpo") -> DataFrame:
    return df.withColumn(out, full(F.lag(c, n // 2 + 1).over(p.w) - F.avg(c).over(p.trailing(n)), c, n, p))


# -- volume -------------------------------------------------------------------------------

def vwap(df: DataFrame, n: int | None = None, p: Panel = PANEL, out: str = "vwap", price: str | None = None) -> DataFrame:
    """Rolling (n) or cumulative volume-weighted price."""
    px = F.col(price) if price else (F.col("high") + F.col("low") + F.col("close")) / 3
    d = df.withColumn("_pv", px * F.col("volume"))
    if n:
        d = frame_parts(d, p, n, {"_num": F.col("_pv"), "_den": F.col("volume")})
    else:
        d = d.select("*", F.sum("_pv").over(p.cum).alias("_num"), F.sum("volume").over(p.cum).alias("_den"))
    v = safe_div("_num", "_den", None)
    return d.withColumn(out, F.when(F.col("_num_n") == n, v) if n else v).drop("_pv", "_num", "_den", "_num_n", "_den_n")


def mfi(df: DataFrame, n: int = 14, p: Panel = PANEL, out: str = "mfi") -> DataFrame:
    d = df.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    d = d.withColumn("_ptp", F.lag("_tp").over(p.w))
    mf = F.col("_tp") * F.col("volume")
    d = (d.withColumn("_in", F.when(F.col("_tp") > F.col("_ptp"), mf).when(F.col("_ptp").isNotNull(), 0.0))
          .withColumn("_out", F.when(F.col("_tp") < F.col("_ptp"), mf).when(F.col("_ptp").isNotNull(), 0.0)))
    d = frame_parts(d, p, n, {"_a": F.col("_in"), "_b": F.col("_out")})
    a, b = F.col("_a"), F.col("_b")
    v = F.when((a == 0) & (b == 0), 50.0).when(b == 0, 100.0).otherwise(100 - 100 / (1 + ratio(a, b)))
    return d.withColumn(out, F.when(F.col("_b_n") == n, v)).drop("_tp", "_ptp", "_in", "_out", "_a", "_b", "_a_n", "_b_n")


def _clv() -> Column:
    return safe_div((F.col("close") - F.col("low")) - (F.col("high") - F.col("close")), F.col("high") - F.col("low"))


def cmf(df: DataFrame, n: int = 21, p: Panel = PANEL, out: str = "cmf") -> DataFrame:
    d = df.withColumn("_mfv", _clv() * F.col("volume"))
    d = frame_parts(d, p, n, {"_num": F.col("_mfv"), "_den": F.col("volume")})
    return d.withColumn(out, F.when(F.col("_num_n") == n, safe_div("_num", "_den"))).drop("_mfv", "_num", "_den", "_num_n", "_den_n")


def cumulative_volume(df: DataFrame, p: Panel = PANEL, bucket: Column | None = None) -> DataFrame:
    """obv, ad_line, pvt, nvi, pvi: running totals over the key.

    Growth indices are running sums of ln(1+r), so all five are plain sums; ``bucket``
    computes them from bucket partials plus a carry for keys of unbounded length.
    """
    pc, pv = F.lag("close").over(p.w), F.lag("volume").over(p.w)
    d = df.withColumn("_pc", pc).withColumn("_pv", pv)
    r = F.coalesce(ratio(F.col("close") - F.col("_pc"), F.col("_pc")), F.lit(0.0))
    lg = F.log1p(F.greatest(r, F.lit(-0.999999999)))
    terms = {
        "obv": F.coalesce(F.signum(F.col("close") - F.col("_pc")), F.lit(0.0)) * F.col("volume"),
        "ad_line": _clv() * F.col("volume"),
        "pvt": F.col("volume") * r,
        "nvi": F.when(F.col("volume") < F.col("_pv"), lg).otherwise(0.0),
        "pvi": F.when(F.col("volume") > F.col("_pv"), lg).otherwise(0.0),
    }
    if bucket is None:
        for n, e in terms.items():
            d = d.withColumn(f"_t_{n}", e)
        d = d.select("*", *[F.sum(f"_t_{n}").over(p.cum).alias(n) for n in terms]).drop(*[f"_t_{n}" for n in terms])
    else:
        d = running(d, p, {n: ("sum", e) for n, e in terms.items()}, bucket)
    return d.withColumn("nvi", 1000 * F.exp("nvi")).withColumn("pvi", 1000 * F.exp("pvi")).drop("_pc", "_pv")


def ease_of_movement(df: DataFrame, n: int = 14, p: Panel = PANEL, out: str = "eom") -> DataFrame:
    mid = (F.col("high") + F.col("low")) / 2
    box = (F.col("volume") / 1e6) / (F.col("high") - F.col("low") + 1e-10)
    d = df.withColumn("_mid", mid)
    d = d.withColumn("_e", F.coalesce((F.col("_mid") - F.lag("_mid").over(p.w)) / (box + 1e-10), F.lit(0.0)))
    return d.withColumn(out, full(F.avg("_e").over(p.trailing(n)), "_e", n, p)).drop("_mid", "_e")


def volume_price_confirmation(df: DataFrame, n: int = 10, p: Panel = PANEL, out: str = "vp_confirm") -> DataFrame:
    """Percent of directional bars among the last n-1 moves in which volume rose."""
    d = df.withColumn("_ps", F.signum(F.col("close") - F.lag("close").over(p.w))).withColumn("_vs", F.signum(F.col("volume") - F.lag("volume").over(p.w)))
    w = p.trailing(n - 1)
    sig = F.sum(F.when((F.col("_ps") != 0) & (F.col("_vs") != 0), 1).otherwise(0)).over(w)
    hit = F.sum(F.when((F.col("_ps") != 0) & (F.col("_vs") > 0), 1).otherwise(0)).over(w)
    enough = F.count("close").over(p.trailing(n)) == n
    return d.withColumn(out, F.when(enough, F.when(sig == 0, 50.0).otherwise(100.0 * ratio(hit, sig)))).drop("_ps", "_vs")


# -- levels, flags, signals ---------------------------------------------------------------

def pivot_points(df: DataFrame, p: Panel = PANEL) -> DataFrame:
    d = df.select("*", *[F.lag(x).over(p.w).alias(f"_{x[0]}") for x in ("high", "low", "close")])
    d = d.withColumn("pivot", (F.col("_h") + F.col("_l") + F.col("_c")) / 3)
    H, L, V = F.col("_h"), F.col("_l"), F.col("pivot")
    return d.select(*df.columns, "pivot", (2 * V - L).alias("r1"), (2 * V - H).alias("s1"), (V + H - L).alias("r2"), (V - H + L).alias("s2"),
                    (H + 2 * (V - L)).alias("r3"), (L - 2 * (H - V)).alias("s3"))


# retracement ratios (fixed values)
FIB_RATIOS = (0.236, 0.382, 0.5, 0.618, 0.786)


def rolling_levels(df: DataFrame, n: int = 20, p: Panel = PANEL) -> DataFrame:
    """trend_strength (slope), fib_* of the trailing range, centred support and resistance carried forward."""
    names = ("high", "low", "close")
    d = frame_parts(df, p, n, {f"_s_{x}": F.col(x) for x in names}, {"_hi": F.col("high")}, {"_lo": F.col("low")}, {"_back": F.col("close")})
    at = lambda k, x: F.when(F.col(f"_s_{k}_n") == n, x)
    middle, spread = (n - 1) / 2, n * (n * n - 1) / 12
    d = d.withColumns({"trend_strength": at("close", (middle * F.col("_s_close") - F.col("_back")) / spread), "_hh": at("high", F.col("_hi")), "_ll": at("low", F.col("_lo")),
                       "_s": at("close", F.col("_lo")), "_r": at("close", F.col("_hi"))})
    ahead = n - 1 - n // 2  # the centred frame is the trailing frame of the row that ends it
    d = d.select(*[c for c in d.columns if c not in ("_s", "_r")], *[F.lead(c, ahead).over(p.w).alias(c) for c in ("_s", "_r")])
    for r in FIB_RATIOS:
        d = d.withColumn(f"fib_{int(round(r * 1000))}", F.col("_hh") - r * (F.col("_hh") - F.col("_ll")))
    return (d.withColumn("support", F.last("_s", True).over(p.cum)).withColumn("resistance", F.last("_r", True).over(p.cum))
             .drop("_hh", "_ll", "_s", "_r", "_hi", "_lo", "_back", *[f"_s_{x}{e}" for x in names for e in ("", "_n")]))


def swing_flags(df: DataFrame, n: int = 5, p: Panel = PANEL, tolerance: float = 0.02) -> DataFrame:
    """higher_high, lower_low, double_top, double_bottom (peaks strict in +-n rows, similar to the previous one)."""
    h, l = F.col("high"), F.col("low")
    lg = lambda c, k: F.lag(c, k).over(p.w) if k > 0 else F.lead(c, -k).over(p.w)
    d = (df.withColumn("higher_high", F.coalesce(((lg("high", n) < h) & (lg("high", -n) < h) & (h > lg("high", 2 * n))).cast("int"), F.lit(0)))
           .withColumn("lower_low", F.coalesce(((lg("low", n) > l) & (lg("low", -n) > l) & (l < lg("low", 2 * n))).cast("int"), F.lit(0))))
    pk = (h > F.max("high").over(p.frame(-n, -1))) & (h > F.max("high").over(p.frame(1, n)))
    tr = (l < F.min("low").over(p.frame(-n, -1))) & (l < F.min("low").over(p.frame(1, n)))
    d = d.withColumn("_pk", F.when(pk, h)).withColumn("_tr", F.when(tr, l))
    before = p.w.rowsBetween(Window.unboundedPreceding, -1)
    near = lambda a, b: F.coalesce((F.abs(a - b) / F.greatest(a, b) < tolerance).cast("int"), F.lit(0))
    return (d.withColumn("double_top", near(F.col("_pk"), F.last("_pk", True).over(before)))
             .withColumn("double_bottom", near(F.col("_tr"), F.last("_tr", True).over(before))).drop("_pk", "_tr"))


def cross_signals(df: DataFrame, a: str, b: str | float, name: str, p: Panel = PANEL) -> DataFrame:
    """<name>_up / <name>_down: a crosses above / below b."""
    x, y = F.col(a), F.lit(b) if not isinstance(b, str) else F.col(b)
    px, py = F.lag(x).over(p.w), y if not isinstance(b, str) else F.lag(y).over(p.w)
    z = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    return df.withColumn(f"{name}_up", z((x > y) & (px <= py))).withColumn(f"{name}_down", z((x < y) & (px >= py)))


def divergence(df: DataFrame, osc: str, lookback: int = 14, c: str = "close", p: Panel = PANEL) -> DataFrame:
    pc, po = F.lag(c, lookback).over(p.w), F.lag(osc, lookback).over(p.w)
    z = lambda e: F.coalesce(e.cast("int"), F.lit(0))
    return (df.withColumn(f"{osc}_bull_div", z((F.col(c) < pc) & (F.col(osc) > po)))
              .withColumn(f"{osc}_bear_div", z((F.col(c) > pc) & (F.col(osc) < po))))


# -- recursive averages -------------------------------------------------------------------

def _decay(span: float) -> float:
    return 1 - 2.0 / (span + 1)


def ema_memory(span: float) -> int:
    """Rows after which an EMA's weight is below 1e-17 of the newest."""
    a = _decay(span)
    return 1 if a <= 0 else int(math.ceil(17 / -math.log10(a)))


def ema_expr(c, span: float, p: Panel, skip: int = 0, adjust: bool = False) -> Column:
    """EMA inside ``with_emas``: a^pos * running sum of weight * x * a^-pos.

    ``skip`` leading nulls of the input shift the seed. ``adjust`` normalizes by the finite weight sum.
    """
    a, x = _decay(span), _col(c)
    if a <= 0:
        return x
    pos, la = F.col("_pos"), math.log(a)
    if adjust:
        live = F.when(x.isNotNull(), 1.0)
        num = F.sum(x * F.exp(-la * pos)).over(p.cum)
        den = F.sum(live * F.exp(-la * pos)).over(p.cum)
        return num / den
    weight = F.when(F.col("_rn") == skip + 1, 1.0).otherwise(1 - a)
    return F.exp(la * pos) * F.sum(weight * x * F.exp(-la * pos)).over(p.cum)


def with_emas(df: DataFrame, fn: Callable[[DataFrame, Panel], DataFrame], spans: Sequence[float], p: Panel = PANEL,
              chain: int = 1, extra: int = 0, bucket: Column | None = None) -> DataFrame:
    """Run ``fn`` (using ``ema_expr`` with the given spans, at most ``chain`` deep) on chunks whose halo
    covers the memory of the chain plus ``extra`` rows; chunk length keeps a^-pos inside double range."""
    mem = sorted((ema_memory(s) for s in spans), reverse=True)
    halo = mem[0] * chain + extra
    fastest = min(-1 / math.log10(_decay(s)) if _decay(s) > 0 else 1e9 for s in spans)
    limit = int(295 * fastest)
    if limit <= halo:
        raise ValueError("spans differ too much for one pass; compute them in separate calls")
    return on_chunks(df, p, fn, before=halo, rows=min(limit - halo, 50_000), bucket=bucket)


def ema(df: DataFrame, span: float, c: str = "close", p: Panel = PANEL, out: str | None = None, adjust: bool = False,
        bucket: Column | None = None) -> DataFrame:
    return with_emas(df, lambda d, q: d.withColumn(out or f"ema_{span}", ema_expr(c, span, q, adjust=adjust)), [span], p, bucket=bucket)


def exponential_smoothing(df: DataFrame, alpha: float, c: str, p: Panel = PANEL, out: str = "smoothed", bucket: Column | None = None) -> DataFrame:
    return ema(df, 2.0 / alpha - 1, c, p, out, bucket=bucket)


def rsi_ewm(df: DataFrame, n: int = 14, c: str = "close", p: Panel = PANEL, out: str | None = None, bucket: Column | None = None) -> DataFrame:
    def fn(d, q):
        d = d.withColumn("_d", F.col(c) - F.lag(c).over(q.w))
        d = d.withColumn("_g", ema_expr(F.greatest("_d", F.lit(0.0)), n, q, 1)).withColumn("_l", ema_expr(F.greatest(-F.col("_d"), F.lit(0.0)), n, q, 1))
        v = F.when(F.col("_l") <= 1e-300, F.when(F.col("_g") <= 1e-300, 50.0).otherwise(100.0)).otherwise(100 - 100 / (1 + ratio("_g", "_l")))
        return d.withColumn(out or f"rsi_ewm_{n}", F.when(F.col("_d").isNotNull(), v)).drop("_d", "_g", "_l")
    return with_emas(df, fn, [n], p, extra=1, bucket=bucket)


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, c: str = "close", p: Panel = PANEL,
         bucket: Column | None = None) -> DataFrame:
    def fn(d, q):
        d = d.withColumn("macd", ema_expr(c, fast, q) - ema_expr(c, slow, q))
        d = d.withColumn("macd_signal", ema_expr("macd", signal, q))
        return d.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))
    return with_emas(df, fn, [fast, slow, signal], p, chain=2, bucket=bucket)


def tsi(df: DataFrame, long: int = 25, short: int = 13, c: str = "close", p: Panel = PANEL, out: str = "tsi",
        double: bool = True, bucket: Column | None = None) -> DataFrame:
    """True strength index; ``double=False`` smooths once with the long span only."""
    def fn(d, q):
        d = d.withColumn("_m", F.col(c) - F.lag(c).over(q.w)).withColumn("_a", F.abs("_m"))
        for x in ("_m", "_a"):
            d = d.withColumn(f"{x}1", ema_expr(x, long, q, 1))
        s = 1
        if double:
            for x in ("_m", "_a"):
                d = d.withColumn(f"{x}2", ema_expr(f"{x}1", short, q, 1))
            s = 2
        v = F.when(F.col(f"_a{s}") == 0, 0.0).otherwise(100 * ratio(f"_m{s}", f"_a{s}"))
        return d.withColumn(out, F.when(F.col("_rn") > 1, v)).drop("_m", "_a", "_m1", "_a1", "_m2", "_a2")
    return with_emas(df, fn, [long, short], p, chain=2, extra=1, bucket=bucket)


def trix(df: DataFrame, n: int = 15, c: str = "close", p: Panel = PANEL, out: str = "trix", bucket: Column | None = None) -> DataFrame:
    def fn(d, q):
        d = d.withColumn("_e1", ema_expr(c, n, q))
        d = d.withColumn("_e2", ema_expr("_e1", n, q))
        d = d.withColumn("_e3", ema_expr("_e2", n, q))
        return d.withColumn(out, 100 * (ratio(F.col("_e3"), F.lag("_e3").over(q.w)) - 1)).drop("_e1", "_e2", "_e3")
    return with_emas(df, fn, [n], p, chain=3, extra=1, bucket=bucket)


def keltner(df: DataFrame, n: int = 20, m: float = 2.0, p: Panel = PANEL, bucket: Column | None = None) -> DataFrame:
    def fn(d, q):
        d = atr(d.withColumn("kc_mid", ema_expr("close", n, q)), n, q, "_atr")
        return d.withColumn("kc_upper", F.col("kc_mid") + m * F.col("_atr")).withColumn("kc_lower", F.col("kc_mid") - m * F.col("_atr")).drop("_atr")
    return with_emas(df, fn, [n], p, extra=n + 1, bucket=bucket)


def volume_oscillators(df: DataFrame, p: Panel = PANEL, bucket: Column | None = None) -> DataFrame:
    """adosc (3,10 on the running A/D line), efi (13), kvo (34,55)."""
    d0 = cumulative_volume(df, p, bucket).drop("obv", "pvt", "nvi", "pvi")

    def fast(d, q):
        return d.withColumn("adosc", ema_expr("ad_line", 3, q) - ema_expr("ad_line", 10, q))

    def slow(d, q):
        force = F.coalesce((F.col("close") - F.lag("close").over(q.w)) * F.col("volume"), F.lit(0.0))
        d = d.withColumn("_hlc", (F.col("high") + F.col("low") + F.col("close")) / 3).withColumn("_f", force)
        d = d.withColumn("_cm", F.coalesce(F.col("_hlc") - F.lag("_hlc").over(q.w), F.lit(0.0)))
        d = d.withColumn("_vf", F.col("volume") * F.when(F.col("_cm") > 0, 1.0).otherwise(-1.0) * F.abs(2 * F.col("_cm") / (F.col("high") - F.col("low") + 1e-10)))
        d = d.withColumn("efi", ema_expr("_f", 13, q)).withColumn("kvo", ema_expr("_vf", 34, q) - ema_expr("_vf", 55, q))
        return d.drop("_hlc", "_f", "_cm", "_vf")

    d1 = with_emas(d0, fast, [3, 10], p, bucket=bucket)
    return with_emas(d1, slow, [13, 34, 55], p, extra=2, bucket=bucket).drop("ad_line")


def parabolic_sar(df: DataFrame, step: float = 0.02, maximum: float = 0.2, p: Panel = PANEL, out: str = "psar") -> DataFrame:
    """Stop-and-reverse: the state update is not associative, so each key's bars run in order in one
    grouped task. Bars bound the group (span / bar width rows, however hot the symbol is)."""
    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(p.order), ignore_index=True)
        high, low = pdf["high"].to_numpy(), pdf["low"].to_numpy()
        rising, accel, stop, peak = True, step, low[0], high[0]
        stops = [stop]
        for h, l in zip(high[1:], low[1:]):
            stop += accel * (peak - stop)
            crossed = l <= stop if rising else h >= stop
            if crossed:
                stop, rising, accel = peak, not rising, step
                peak = h if rising else l
            elif (h > peak) if rising else (l < peak):
                peak, accel = (h if rising else l), min(accel + step, maximum)
            stops.append(stop)
        pdf[out] = stops
        return pdf

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*p.keys, *p.order, "high", "low").schema.fields)
    return df.select(*p.keys, *p.order, "high", "low").groupBy(*p.keys).applyInPandas(walk, f"{fields}, {out} double")


# -- sets ---------------------------------------------------------------------------------

def feature_set(df: DataFrame, p: Panel = PANEL, bucket: Column | None = None) -> DataFrame:
    """The standard indicator table: one chunked pass, one sort, every window sharing the spec."""
    def fn(d, q):
        for n in (5, 10, 20, 50):
            d = sma(d, n, p=q)
        for n in (12, 26):
            d = d.withColumn(f"ema_{n}", ema_expr("close", n, q))
        d = d.withColumn("macd", F.col("ema_12") - F.col("ema_26"))
        d = d.withColumn("macd_signal", ema_expr("macd", 9, q)).withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))
        d = bollinger(rsi(d, 14, p=q), p=q)
        d = atr(stochastic(d, p=q), 14, q)
        d = adx(williams_r(d, p=q), p=q)
        d = cci(roc(d, 10, p=q), p=q)
        d = cmf(mfi(historical_volatility(d, p=q), p=q), p=q)
        return d
    return with_emas(df, fn, [12, 26, 9], p, chain=2, extra=60, bucket=bucket)


FEATURE_SET_COLUMNS = ("sma_5", "sma_10", "sma_20", "sma_50", "ema_12", "ema_26", "macd", "macd_signal", "macd_hist", "rsi_14", "bb_mid", "bb_upper",
                       "bb_lower", "bb_width", "bb_pct", "stoch_k", "stoch_d", "atr_14", "williams_r", "plus_di", "minus_di", "adx", "roc_10", "cci",
                       "hist_vol", "mfi", "cmf")


def clip_normalize(df: DataFrame, cols: Sequence[str], n: int = 100, limit: float = 5.0, p: Panel = PANEL) -> DataFrame:
    """Rolling z-scores of indicator columns clipped to +-limit."""
    w = p.trailing(n)
    z = lambda c: F.greatest(F.least((F.col(c) - F.avg(c).over(w)) / (F.stddev_samp(c).over(w) + 1e-8), F.lit(limit)), F.lit(-limit))
    return df.select(*[c for c in df.columns if c not in cols], *[F.coalesce(z(c), F.lit(0.0)).alias(c) for c in cols])


def write_indicator_table(df: DataFrame, path: str, p: Panel = PANEL, bucket: Column | None = None) -> None:
    """Materialize the indicator table once, partitioned by year; later lookups are pruned scans or equi joins."""
    out = feature_set(df, p, bucket).withColumn("_year", F.year(p.order[0]))
    out.repartitionByRange(F.col("_year"), *p.keys).write.mode("overwrite").partitionBy("_year").parquet(path)


def lookup_indicators(spark, path: str, keys: DataFrame, p: Panel = PANEL) -> DataFrame:
    t = spark.read.parquet(path)
    return keys.withColumn("_year", F.year(p.order[0])).join(t, [*p.keys, *p.order, "_year"], "left").drop("_year")
