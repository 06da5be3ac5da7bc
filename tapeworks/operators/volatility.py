"""Realized, range-based, regime and implied volatility."""
from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.mathx import clip, float_div, float_ln, norm_cdf, norm_sf, ratio, safe_div, two_sided_p
from tapeworks.operators.bars import resample_last
from tapeworks.operators.models import assembled
from tapeworks.plans.panel import Panel, islands, join_on

PANEL = Panel()
# daily volatility thresholds: low < 1.5 %, medium < 3 %, high < 5 % (fixed values)
REGIME_THRESHOLDS = (0.015, 0.03, 0.05)


def with_log_returns(df: DataFrame, c: str = "close", p: Panel = PANEL, drop_gaps: bool = False) -> DataFrame:
    """r, first row null; infinite to and from a price of zero. ``drop_gaps`` nulls returns whose time gap exceeds twice the key's median gap."""
    ts = p.order[0]
    d = df.withColumn("r", float_ln(float_div(F.col(c), F.lag(c).over(p.w))))
    if drop_gaps:
        d = d.withColumn("_g", F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(p.w)))
        med = d.groupBy(*p.keys).agg(F.percentile("_g", 0.5).alias("_med"))
        d = join_on(d, med, p.keys).withColumn("r", F.when(F.col("_g") <= 2 * F.col("_med"), F.col("r"))).drop("_g", "_med")
    return d


def realized_measures(df: DataFrame, by: Sequence[str] = ("symbol",), c: str = "close", p: Panel = PANEL, annual: float = 252, drop_gaps: bool = False) -> DataFrame:
    """n, rv, vol, vol_annual, bipower, tripower, jump z and p in one pass over lagged returns."""
    d = with_log_returns(df, c, p, drop_gaps)
    a0, a1, a2 = (F.abs(F.lag("r", k).over(p.w)) if k else F.abs(F.col("r")) for k in (0, 1, 2))
    d = d.withColumn("_a1", a1).withColumn("_a2", a2).withColumn("_a0", a0)
    tri = F.pow("_a0", 4 / 3) * F.pow("_a1", 4 / 3) * F.pow("_a2", 4 / 3)
    mu = 2 ** (2 / 3) * math.gamma(7 / 6) / math.gamma(1 / 2)
    g = d.groupBy(*by).agg(
        F.count("r").alias("n"), F.sum(F.col("r") ** 2).alias("rv"),
        (math.pi / 2 * F.sum(F.col("_a0") * F.col("_a1"))).alias("bipower"),
        (F.count("r") * mu ** -3 * F.sum(tri)).alias("tripower"))
    jump = ratio(1 - ratio("bipower", "rv"), F.sqrt((math.pi ** 2 / 4 + math.pi - 5) / F.col("n") * F.greatest(F.lit(1.0), ratio("tripower", F.col("bipower") ** 2))))
    return (g.withColumn("vol", F.sqrt("rv")).withColumn("vol_annual", F.sqrt(F.col("rv") / F.col("n") * annual))
             .withColumn("jump_z", jump).withColumn("jump_p", two_sided_p("jump_z"))
             .withColumn("jump", (F.abs("jump_z") > 1.959963984540054).cast("int")).withColumn("jump_size", F.greatest(F.col("rv") - F.col("bipower"), F.lit(0.0))))


def intraday_seasonality(df: DataFrame, c: str = "close", p: Panel = PANEL) -> DataFrame:
    d = with_log_returns(df, c, p)
    return d.groupBy(*p.keys, F.hour(p.order[0]).alias("hour")).agg(F.sqrt(F.sum(F.col("r") ** 2)).alias("vol"), F.count("r").alias("n"))


def signature(df: DataFrame, freqs: Sequence[str], c: str = "close", p: Panel = PANEL, tie: Sequence[str] = ()) -> DataFrame:
    """Realized variance per sampling frequency."""
    out = None
    for f in freqs:
        d = with_log_returns(resample_last(df, f, c, keys=p.keys, ts=p.order[0], tie=tie), c, Panel(p.keys, ("ts",)))
        g = d.groupBy(*p.keys).agg(F.sum(F.col("r") ** 2).alias("rv"), F.count("r").alias("n")).withColumn("freq", F.lit(f))
        out = g if out is None else out.unionByName(g)
    return out


def kernel_weight(h: Column, bandwidth: int, kind: str) -> Column:
    x = h / float(bandwidth)
    if kind == "bartlett":
        return 1 - h / float(bandwidth + 1)
    if kind == "parzen":
        return F.when(h <= bandwidth // 2, 1 - 6 * x ** 2 + 6 * x ** 3).otherwise(2 * (1 - x) ** 3)
    if kind == "qs":
        y = 6 * math.pi * h / (5.0 * bandwidth)
        return F.when(h == 0, 1.0).otherwise(3 * (F.sin(y) / y - F.cos(y)) / F.nullif(y * y, F.lit(0.0)))
    return F.lit(1.0)


def realized_kernel(df: DataFrame, bandwidth: int = 10, kind: str = "parzen", c: str = "close", p: Panel = PANEL) -> DataFrame:
    """Weighted mean autocovariances of returns; lags are extra columns of one window pass, not a self join."""
    d = with_log_returns(df, c, p)
    d = d.select(*p.keys, "r", *[F.lag("r", h).over(p.w).alias(f"_l{h}") for h in range(1, bandwidth + 1)])
    g = d.groupBy(*p.keys).agg(F.avg(F.col("r") ** 2).alias("_g0"), *[F.avg(F.col("r") * F.col(f"_l{h}")).alias(f"_g{h}") for h in range(1, bandwidth + 1)])
    total = F.col("_g0") * kernel_weight(F.lit(0), bandwidth, kind)
    for h in range(1, bandwidth + 1):
        total = total + 2 * kernel_weight(F.lit(h), bandwidth, kind) * F.coalesce(F.col(f"_g{h}"), F.lit(0.0))
    return g.select(*p.keys, F.col("_g0").alias("variance"), total.alias("kernel")).withColumn("kernel_vol", F.sqrt(F.greatest("kernel", F.lit(0.0))))


def two_scale(df: DataFrame, slow: str, c: str = "close", p: Panel = PANEL, tie: Sequence[str] = ()) -> DataFrame:
    """RV of all returns minus (n_fast/n_slow) times the slow-grid RV, floored at zero."""
    f = with_log_returns(df, c, p).groupBy(*p.keys).agg(F.sum(F.col("r") ** 2).alias("rv_fast"), F.count("r").alias("n_fast"))
    s = with_log_returns(resample_last(df, slow, c, keys=p.keys, ts=p.order[0], tie=tie), c, Panel(p.keys, ("ts",)))
    s = s.groupBy(*p.keys).agg(F.sum(F.col("r") ** 2).alias("rv_slow"), F.count("r").alias("n_slow"))
    j = join_on(f, s, p.keys)
    return j.withColumn("tsrv", F.greatest(F.col("rv_fast") - ratio("n_fast", "n_slow") * F.col("rv_slow"), F.lit(0.0)))


def consensus(estimates: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """mean, median, trimmed mean (min and max removed) over a long (key, estimator, value) table of few estimators."""
    n = F.count(value)
    return estimates.groupBy(*keys).agg(
        n.alias("n"), F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("median"),
        F.when(n > 2, (F.sum(value) - F.max(value) - F.min(value)) / F.nullif(n - 2, F.lit(0))).otherwise(F.avg(value)).alias("trimmed"),
        (F.max(value) - F.min(value)).alias("spread"))


def range_volatility(df: DataFrame, n: int = 20, p: Panel = PANEL) -> DataFrame:
    """Rolling Parkinson and Garman-Klass volatility per bar."""
    d = df.withColumn("_hl", F.ln(F.col("high") / F.col("low")) ** 2).withColumn("_co", F.ln(F.col("close") / F.col("open")) ** 2)
    w, ok = p.trailing(n), F.count("close").over(p.trailing(n)) == n
    pk = F.sqrt(F.avg("_hl").over(w) / (4 * math.log(2)))
    gk = F.sqrt(F.greatest(0.5 * F.avg("_hl").over(w) - (2 * math.log(2) - 1) * F.avg("_co").over(w), F.lit(0.0)))
    return d.withColumn("parkinson", F.when(ok, pk)).withColumn("garman_klass", F.when(ok, gk)).drop("_hl", "_co")


# -- GARCH over a parameter grid -----------------------------------------------------------

def garch_grid(families: Sequence[str] = ("garch", "gjr", "egarch"), alphas=(0.03, 0.05, 0.1, 0.15, 0.2), betas=(0.6, 0.7, 0.8, 0.85, 0.9),
               gammas=(0.05, 0.1)) -> list[tuple]:
    """(family, alpha, beta, gamma) candidates; variance targeting fixes omega. EGARCH uses beta as log-variance persistence."""
    out = []
    for f in families:
        for a in alphas:
            for b in betas:
                for g in ((0.0,) if f == "garch" else gammas):
                    if f == "egarch" or a + b + g / 2 < 0.999:
                        out.append((f, a, b, g))
    return out


def fit_garch(df: DataFrame, grid: Sequence[tuple] | None = None, c: str = "close", p: Panel = PANEL, horizon: int = 10) -> DataFrame:
    """Best grid point per key by AIC with likelihood, BIC and the horizon variance forecast.

    The variance recursion is sequential in time but independent over grid points: a task walks one
    key's return bars once and updates all candidates as a vector. Bars bound the group.
    """
    grid = list(grid or garch_grid())
    fam = np.array([g[0] for g in grid])
    al, be, ga = (np.array([g[i] for g in grid], dtype=float) for i in (1, 2, 3))
    eg, kpar = fam == "egarch", np.where(fam == "garch", 3, 4)
    d = with_log_returns(df, c, p).where(F.col("r").isNotNull()).select(*p.keys, *p.order, "r")
    key_fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.select(*p.keys).schema.fields)
    keys, order = list(p.keys), list(p.order)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        r = pdf["r"].to_numpy() - pdf["r"].mean()
        n, v0 = len(r), max(float(np.mean(r ** 2)), 1e-12)
        omega = np.where(eg, (1 - be) * math.log(v0), v0 * (1 - al - be - ga / 2))
        var, ll = np.full(len(grid), v0), np.zeros(len(grid))
        for x in r:
            ll -= 0.5 * (math.log(2 * math.pi) + np.log(var) + x * x / var)
            z = x / np.sqrt(var)
            arch = omega + (al + ga * (x < 0)) * x * x + be * var
            logv = omega + be * np.log(var) + al * (np.abs(z) - math.sqrt(2 / math.pi)) - ga * z
            var = np.maximum(np.where(eg, np.exp(np.clip(logv, -60, 60)), arch), 1e-12)
        aic, bic = 2 * kpar - 2 * ll, kpar * math.log(max(n, 2)) - 2 * ll
        i = int(np.argmin(aic))
        pers = be[i] if eg[i] else al[i] + be[i] + ga[i] / 2
        fc = math.exp(math.log(v0) + pers ** (horizon - 1) * (math.log(var[i]) - math.log(v0))) if eg[i] else v0 + pers ** (horizon - 1) * (var[i] - v0)
        row = {k: pdf[k].iloc[0] for k in keys}
        row.update(family=fam[i], alpha=al[i], beta=be[i], gamma=ga[i], omega=float(omega[i]), loglik=ll[i], aic=aic[i], bic=bic[i], n=n, var_next=var[i], var_horizon=fc)
        return pd.DataFrame([row])

    schema = key_fields + ", family string, alpha double, beta double, gamma double, omega double, loglik double, aic double, bic double, n bigint, var_next double, var_horizon double"
    return d.groupBy(*keys).applyInPandas(fit, schema)


# -- models on realized volatility --------------------------------------------------------

def har_features(df: DataFrame, c: str = "rv", p: Panel = PANEL, lags: Sequence[int] = (1, 5, 22)) -> DataFrame:
    """har_1, har_5, har_22: means of the previous days' value (target is ``c``)."""
    names = [f"har_{n}" for n in lags]
    return df.select("*", *[F.when(F.count(c).over(p.prior(n)) == n, F.avg(c).over(p.prior(n))).alias(m) for n, m in zip(lags, names)])


def fit_har(df: DataFrame, c: str = "rv", p: Panel = PANEL):
    """Pooled HAR regression; returns (model, scored frame)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    d = har_features(df, c, p).dropna(subset=["har_22", c])
    v = VectorAssembler(inputCols=["har_1", "har_5", "har_22"], outputCol="_x").transform(d)
    m = LinearRegression(featuresCol="_x", labelCol=c, solver="normal", predictionCol="prediction").fit(v)
    return m, m.transform(v).drop("_x")


def volatility_matrix(df: DataFrame, n: int = 20, c: str = "close", p: Panel = PANEL) -> DataFrame:
    """Feature matrix for volatility models: lags, means, range, stress, jump share, calendar."""
    from tapeworks.operators.rolling import jump_flag, market_stress
    d = with_log_returns(df, c, p)
    d = d.withColumn("rv", F.sqrt(F.sum(F.col("r") ** 2).over(p.trailing(n))))
    d = d.select("*", *[F.lag("rv", k).over(p.w).alias(f"rv_lag_{k}") for k in (1, 2, 5)], *[F.avg("rv").over(p.trailing(m)).alias(f"rv_mean_{m}") for m in (5, 22)])
    d = market_stress(jump_flag(d, n, 3.0, c, p), n, c, p)
    d = d.withColumn("jump_share", F.avg("jump").over(p.trailing(n)))
    return d.withColumn("dow", F.weekday(p.order[0])).withColumn("month", F.month(p.order[0])).withColumn("target", F.lead("rv").over(p.w))


def fit_volatility_forest(df: DataFrame, features: Sequence[str], label: str, trees: int = 50, depth: int = 6, seed: int = 42):
    from pyspark.ml import Pipeline
    from pyspark.ml.regression import RandomForestRegressor
    st = [*assembled(features, "_x"), RandomForestRegressor(featuresCol="_x", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)]
    return Pipeline(stages=st).fit(df.where(F.col(label).isNotNull()))


def ensemble_weights(scores: DataFrame, model: str = "model", y: str = "y", pred: str = "prediction") -> DataFrame:
    """Weight max(0, R2 - MSE) per model on a long validation table, normalized; equal when all are zero."""
    g = scores.groupBy(model).agg(F.avg((F.col(y) - F.col(pred)) ** 2).alias("mse"), F.var_pop(y).alias("_v"))
    g = g.withColumn("r2", 1 - ratio("mse", "_v")).withColumn("raw", F.greatest(F.col("r2") - F.col("mse"), F.lit(0.0)))
    tot = g.agg(F.struct(F.sum("raw").alias("t"), F.count(F.lit(1)).alias("k")).alias("s")).scalar()
    g = g.withColumn("_s", tot)
    return g.select(model, "mse", "r2", F.when(F.col("_s.t") > 0, F.col("raw") / F.nullif(F.col("_s.t"), F.lit(0.0))).otherwise(1.0 / F.col("_s.k")).alias("weight"))


def volatility_cone(df: DataFrame, horizons: Sequence[int] = (5, 22, 63, 126, 252), c: str = "close", p: Panel = PANEL, annual: float = 252) -> DataFrame:
    """Quantiles of rolling volatility per horizon, the latest value, its rank and a regime name."""
    d = with_log_returns(df, c, p)
    cols = [F.when(F.count("r").over(p.trailing(h)) == h, F.stddev_samp("r").over(p.trailing(h)) * math.sqrt(annual)).alias(f"v{h}") for h in horizons]
    d = d.select(*p.keys, *p.order, *cols)
    stack = ", ".join(f"{h}, v{h}" for h in horizons)
    long = d.select(*p.keys, *p.order, F.expr(f"stack({len(horizons)}, {stack}) as (horizon, vol)")).where(F.col("vol").isNotNull())
    cur = long.groupBy(*p.keys, "horizon").agg(F.max_by("vol", F.struct(*p.order)).alias("current"))
    j = join_on(long, cur, [*p.keys, "horizon"])
    g = j.groupBy(*p.keys, "horizon").agg(F.percentile("vol", F.array(*[F.lit(x) for x in (.1, .25, .5, .75, .9)])).alias("q"), F.min("vol").alias("min"), F.max("vol").alias("max"),
                                          F.first("current").alias("current"), (100 * F.avg((F.col("vol") < F.col("current")).cast("double"))).alias("rank"))
    reg = F.when(F.col("rank") < 20, "low").when(F.col("rank") < 80, "normal").otherwise("high")
    return g.select(*p.keys, "horizon", "min", *[F.col("q")[i].alias(n) for i, n in enumerate(("p10", "p25", "p50", "p75", "p90"))], "max", "current", "rank", reg.alias("regime"))


def persistence(df: DataFrame, c: str = "close", p: Panel = PANEL) -> DataFrame:
    """AR(1) half-life of absolute returns' level and lag-1 autocorrelation of squared returns."""
    d = with_log_returns(df, c, p).withColumn("_a", F.abs("r")).withColumn("_s", F.col("r") ** 2)
    d = d.withColumn("_la", F.lag("_a").over(p.w)).withColumn("_ls", F.lag("_s").over(p.w))
    g = d.groupBy(*p.keys).agg(F.regr_slope("_a", "_la").alias("beta"), F.corr("_s", "_ls").alias("clustering"))
    return g.withColumn("half_life", F.when((F.col("beta") > 0) & (F.col("beta") < 1), math.log(.5) / F.ln(F.when((F.col("beta") > 0) & (F.col("beta") < 1), F.col("beta")))))


def volatility_regime(df: DataFrame, n: int = 24, thresholds: Sequence[float] = REGIME_THRESHOLDS, c: str = "close", p: Panel = PANEL) -> DataFrame:
    """realized (root of summed squares), regime 0..3 (1 while short), duration in rows, share of regime changes over n rows."""
    d = with_log_returns(df, c, p)
    v = F.when(F.count("r").over(p.trailing(n)) == n, F.sqrt(F.sum(F.col("r") ** 2).over(p.trailing(n))))
    d = d.withColumn("realized", v)
    lo, mid, hi = thresholds
    x = F.col("realized")
    d = d.withColumn("regime", F.when(x.isNull(), 1).when(x < lo, 0).when(x < mid, 1).when(x < hi, 2).otherwise(3))
    d = islands(d, p, F.col("regime"), "_isl")
    d = d.withColumn("duration", F.row_number().over(Window.partitionBy(*p.keys, "_isl").orderBy(*p.order)))
    ch = (F.col("_isl") != F.lag("_isl").over(p.w)).cast("int")
    d = d.withColumn("_ch", F.coalesce(ch, F.lit(0)))
    return d.withColumn("stability", 1 - F.sum("_ch").over(p.trailing(n)) / float(n)).drop("_isl", "_ch", "r")


# -- options ------------------------------------------------------------------------------

def model_free_variance(q: DataFrame, keys: Sequence[str] = ("symbol", "expiry")) -> DataFrame:
    """Model-free volatility per expiry from (strike, option_type, price, underlying_price, tte).

    Put-call parity forward (median over strikes), at-the-money strike nearest to it, spacing-weighted
    out-of-the-money prices and the central correction. Quotes of one expiry are a short chain.
    """
    k = list(keys)
    s = q.groupBy(*k, "strike").agg(F.max(F.when(F.col("option_type") == "call", F.col("price"))).alias("c"), F.max(F.when(F.col("option_type") == "put", F.col("price"))).alias("pt"),
                                    F.max("underlying_price").alias("u"), F.max("tte").alias("t"))
    f = s.groupBy(*k).agg(F.coalesce(F.percentile(F.col("strike") + F.col("c") - F.col("pt"), 0.5), F.max("u")).alias("forward"), F.count(F.lit(1)).alias("n_strikes"), F.max("t").alias("t0"))
    d = join_on(s, f, k)
    atm = d.groupBy(*k).agg(F.min_by("strike", F.struct(F.abs(F.col("strike") - F.col("forward")), "strike")).alias("atm"))
    d = join_on(d, atm, k)
    w = Window.partitionBy(*k).orderBy("strike")
    lo, hi = F.lag("strike").over(w), F.lead("strike").over(w)
    dk = F.when(lo.isNull() & hi.isNull(), F.col("strike") * 0.1).when(lo.isNull(), hi - F.col("strike")).when(hi.isNull(), F.col("strike") - lo).otherwise((hi - lo) / 2)
    px = F.when(F.col("strike") < F.col("atm"), F.col("pt")).otherwise(F.coalesce("c", "pt"))
    d = d.withColumn("_dk", dk).withColumn("_px", px)
    g = d.groupBy(*k).agg(F.sum(2 / F.col("t0") * F.col("_dk") / F.col("strike") ** 2 * F.col("_px")).alias("_v"), F.max("forward").alias("forward"), F.max("atm").alias("atm"),
                          F.max("t0").alias("tte"), F.max("n_strikes").alias("n_strikes"))
    var = F.col("_v") - (F.col("forward") / F.col("atm") - 1) ** 2 / F.col("tte")
    return g.where(F.col("n_strikes") >= 3).withColumn("vol", F.sqrt(F.greatest(var, F.lit(0.0)))).drop("_v")


def interpolate_tenor(terms: DataFrame, targets: Sequence[float], keys: Sequence[str] = ("symbol",), x: str = "days", y: str = "vol") -> DataFrame:
    """Linear interpolation of a short term structure at target days, flat beyond its ends."""
    k = list(keys)
    t = terms.select(*k).distinct().select(*k, F.explode(F.array(*[F.lit(float(v)) for v in targets])).alias("_x"))
    u = (terms.select(*k, F.col(x).cast("double").alias("_x"), F.struct(F.col(x).cast("double").alias("x"), F.col(y).alias("y")).alias("_p"))
              .unionByName(t.withColumn("_p", F.lit(None).cast("struct<x:double,y:double>"))))
    w = Window.partitionBy(*k).orderBy("_x")
    u = u.withColumn("a", F.last("_p", True).over(w.rangeBetween(Window.unboundedPreceding, 0))).withColumn("b", F.first("_p", True).over(w.rangeBetween(0, Window.unboundedFollowing)))
    frac = (F.col("_x") - F.col("a.x")) / F.nullif(F.col("b.x") - F.col("a.x"), F.lit(0.0))
    v = F.when(F.col("a").isNull(), F.col("b.y")).when(F.col("b").isNull(), F.col("a.y")).otherwise(F.col("a.y") + F.coalesce(frac, F.lit(0.0)) * (F.col("b.y") - F.col("a.y")))
    return u.where(F.col("_p").isNull()).select(*k, F.col("_x").alias(x), v.alias(y))


def black_scholes(s, k, t, r, sigma, kind) -> dict[str, Column]:
    """Price and greeks as Column expressions (kind: 'call' / 'put')."""
    s, k, t, r, sigma, kind = (F.col(c) if isinstance(c, str) else c for c in (s, k, t, r, sigma, kind))
    sq = sigma * F.sqrt(t)
    d1 = (F.ln(s / k) + (r + sigma * sigma / 2) * t) / sq
    d2 = d1 - sq
    pdf, disc, call = F.exp(-d1 * d1 / 2) / math.sqrt(2 * math.pi), F.exp(-r * t), kind == "call"
    price = F.when(call, s * norm_cdf(d1) - k * disc * norm_cdf(d2)).otherwise(k * disc * norm_sf(d2) - s * norm_sf(d1))
    theta = -s * pdf * sigma / (2 * F.sqrt(t)) + F.when(call, -r * k * disc * norm_cdf(d2)).otherwise(r * k * disc * norm_sf(d2))
    return {"price": price, "delta": F.when(call, norm_cdf(d1)).otherwise(-norm_sf(d1)), "gamma": pdf / (s * sq), "vega": s * pdf * F.sqrt(t), "theta": theta}


def normal_cdf(x: np.ndarray) -> np.ndarray:
    """Normal distribution function of a whole array: the series of the error function near zero, its continued fraction beyond."""
    z = np.minimum(np.abs(x) / math.sqrt(2), 27.0)
    near = np.where(z < 2.5, z, 0.0)
    term, series = near.copy(), near.copy()
    for k in range(1, 40):
        term = -term * near * near / k
        series = series + term / (2 * k + 1)
    far = np.maximum(z, 2.5)
    below = far.copy()
    for k in range(60, 0, -1):
        below = far + k / 2 / below
    tail = np.where(z < 2.5, 1 - 2 / math.sqrt(math.pi) * series, np.exp(-far * far) / below / math.sqrt(math.pi)) / 2
    return np.where(np.isnan(x), np.nan, np.where(x > 0, 1 - tail, tail))


def implied_volatility(price: str, s: str, k: str, t: str, r: str, kind: str) -> Column:
    """Vectorized Newton with bisection fallback over Arrow batches; null outside arbitrage bounds."""
    @F.pandas_udf("double")
    def solve(price: pd.Series, s: pd.Series, k: pd.Series, t: pd.Series, r: pd.Series, kind: pd.Series) -> pd.Series:
        P, S, K, T, Rr = (x.to_numpy(dtype=float) for x in (price, s, k, t, r))
        call = kind.to_numpy() == "call"
        cdf = normal_cdf
        disc = K * np.exp(-Rr * T)
        floor_, cap = np.where(call, np.maximum(S - disc, 0), np.maximum(disc - S, 0)), np.where(call, S, disc)
        lo, hi, v = np.full(len(P), 1e-6), np.full(len(P), 10.0), np.full(len(P), 0.5)
        for _ in range(100):
            sq = v * np.sqrt(T)
            d1 = (np.log(S / K) + (Rr + v * v / 2) * T) / sq
            value = np.where(call, S * cdf(d1) - disc * cdf(d1 - sq), disc * cdf(sq - d1) - S * cdf(-d1))
            over = value > P
            hi, lo = np.where(over, v, hi), np.where(over, lo, v)
            vega = S * np.exp(-d1 * d1 / 2) / math.sqrt(2 * math.pi) * np.sqrt(T)
            with np.errstate(all="ignore"):
                step = v - (value - P) / vega
            new = np.where(np.isfinite(step) & (step > lo) & (step < hi), step, (lo + hi) / 2)
            if np.nanmax(np.abs(new - v), initial=0) < 1e-13:
                v = new
                break
            v = new
        return pd.Series(np.where((P > floor_) & (P < cap) & (T > 0), v, np.nan)).replace({np.nan: None}).astype("float64")

    return solve(price, s, k, t, r, kind)


def enrich_chain(q: DataFrame) -> DataFrame:
    """iv, bid_iv, ask_iv and greeks at iv for a quote table."""
    a = ("underlying_price", "strike", "tte", "risk_free_rate", "option_type")
    d = q.withColumn("iv", implied_volatility("price", *a))
    for side in ("bid", "ask"):
        if side in q.columns:
            d = d.withColumn(f"{side}_iv", implied_volatility(side, *a))
    g = black_scholes("underlying_price", "strike", "tte", "risk_free_rate", "iv", "option_type")
    return d.select("*", *[g[n].alias(n) for n in ("delta", "gamma", "vega", "theta")])


def smile_metrics(q: DataFrame, keys: Sequence[str] = ("symbol", "expiry"), x: str = "log_moneyness", y: str = "iv") -> DataFrame:
    """Quadratic least squares iv = a + b x + c x^2 per expiry from power sums, with r2 and rmse; skew = b, convexity = 2c."""
    X, Y = F.col(x), F.col(y)
    g = q.where(X.isNotNull() & Y.isNotNull()).groupBy(*keys).agg(F.count(Y).alias("n"), *[F.sum(X ** i).alias(f"s{i}") for i in (1, 2, 3, 4)],
                                                                  F.sum(Y).alias("t0"), F.sum(X * Y).alias("t1"), F.sum(X * X * Y).alias("t2"), F.sum(Y * Y).alias("yy"))
    n, s1, s2, s3, s4, t0, t1, t2 = (F.col(c).cast("double") for c in ("n", "s1", "s2", "s3", "s4", "t0", "t1", "t2"))
    det3 = lambda a, b, c, d, e, f, h, i, j: a * (e * j - f * i) - b * (d * j - f * h) + c * (d * i - e * h)
    det = det3(n, s1, s2, s1, s2, s3, s2, s3, s4)
    a, b, c = det3(t0, s1, s2, t1, s2, s3, t2, s3, s4), det3(n, t0, s2, s1, t1, s3, s2, t2, s4), det3(n, s1, t0, s1, s2, t1, s2, s3, t2)
    d = g.where(F.col("n") >= 3).withColumn("level", ratio(a, det)).withColumn("skew", ratio(b, det)).withColumn("_c", ratio(c, det))
    sse = F.col("yy") - F.col("level") * t0 - F.col("skew") * t1 - F.col("_c") * t2
    return d.select(*keys, "n", "level", "skew", (2 * F.col("_c")).alias("convexity"), F.sqrt(F.greatest(sse, F.lit(0.0)) / F.col("n")).alias("rmse"),
                    (1 - ratio(F.greatest(sse, F.lit(0.0)), F.col("yy") - t0 * t0 / n)).alias("r2"))


def quote_quality(q: DataFrame, keys: Sequence[str] = ("symbol", "expiry")) -> DataFrame:
    """Call / put average volatility, relative spread and a 0..1 liquidity score per chain."""
    mid = (F.col("bid") + F.col("ask")) / 2
    spread = ratio(F.col("ask") - F.col("bid"), mid)
    ok = ((F.col("bid") > 0) & (F.col("ask") >= F.col("bid"))).cast("double")
    return q.groupBy(*keys).agg(F.avg(F.when(F.col("option_type") == "call", F.col("iv"))).alias("call_vol"), F.avg(F.when(F.col("option_type") == "put", F.col("iv"))).alias("put_vol"),
                                F.avg(spread).alias("rel_spread"), F.avg(ok * clip(1 - spread, 0.0, 1.0)).alias("liquidity"), F.count(F.lit(1)).alias("n"))


def history_rank(df: DataFrame, c: str, windows: Mapping[str, int], p: Panel = PANEL) -> DataFrame:
    """Share of the trailing window below the current value, times 100."""
    out = df
    for name, n in windows.items():
        l = F.collect_list(c).over(p.trailing(n))
        out = out.withColumn(name, 100.0 * F.size(F.filter(l, lambda x: x < F.col(c))) / F.size(l))
    return out
