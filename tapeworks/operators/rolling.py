"""Rolling statistics, lags, feature blocks and signal operations over a panel."""
from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.functions.mathx import ratio, safe_div
from tapeworks.plans.orderstats import attach_stats, median_mad, quantiles
from tapeworks.plans.panel import Panel

PANEL = Panel()
OPS = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum, "median": lambda c: F.percentile(c, 0.5)}


def rolling(c: str, op: str, n: int, p: Panel = PANEL, full_only: bool = True) -> Column:
    w = p.trailing(n)
    e = OPS[op](c).over(w)
    return F.when(F.count(c).over(w) == n, e) if full_only else e


def _quantile(c: str, n: int, share: float) -> Column:
    """The interpolated quantile of ``n`` sorted values, as ``percentile`` has it, without its table of counts for each frame."""
    at = (n - 1) * share
    lo, hi = math.floor(at), math.ceil(at)
    a, b = F.col(c)[lo], F.col(c)[hi]
    return a if lo == hi else F.when(a == b, a).otherwise((hi - at) * a + (at - lo) * b)


def moments_block(df: DataFrame, c: str, windows: Sequence[int] = (5, 10, 20, 50), p: Panel = PANEL) -> DataFrame:
    """mean, std, min, max, median, q25, q75, skew, kurt (bias-corrected), zscore, position per window."""
    d = df
    for n in windows:
        w, ok = p.trailing(n), F.count(c).over(p.trailing(n)) == n
        pre = f"{c}_{n}_"
        f = lambda e: F.when(ok, e)
        d = d.select("*", f(F.avg(c).over(w)).alias(pre + "mean"), f(F.stddev_samp(c).over(w)).alias(pre + "std"),
                     f(F.min(c).over(w)).alias(pre + "min"), f(F.max(c).over(w)).alias(pre + "max"),
                     f(F.sort_array(F.collect_list(F.col(c).cast("double")).over(w))).alias("_q"))
        # central moments of the frame's values about its mean; of equal values skewness and kurtosis are null
        gap = [F.col("_q")[i] - F.col(pre + "mean") for i in range(n)]
        d = d.select("*", sum((x * x for x in gap[1:]), gap[0] * gap[0]).alias("_m2"), sum((x * x * x for x in gap[1:]), gap[0] * gap[0] * gap[0]).alias("_m3"),
                     sum((x * x * x * x for x in gap[1:]), gap[0] * gap[0] * gap[0] * gap[0]).alias("_m4"))
        d = d.withColumn("_m2", F.when((F.col("_q")[n - 1] - F.col("_q")[0]) != 0, F.col("_m2")))
        d = d.select("*", (math.sqrt(n) * F.col("_m3") / F.sqrt(F.col("_m2") * F.col("_m2") * F.col("_m2"))).alias("_g1"),
                     (n * F.col("_m4") / (F.col("_m2") * F.col("_m2")) - 3).alias("_g2"))
        d = (d.withColumn(pre + "q25", _quantile("_q", n, .25)).withColumn(pre + "median", _quantile("_q", n, .5)).withColumn(pre + "q75", _quantile("_q", n, .75))
              .withColumn(pre + "skew", F.col("_g1") * (math.sqrt(n * (n - 1)) / (n - 2)))
              .withColumn(pre + "kurt", ((n + 1) * F.col("_g2") + 6) * ((n - 1) / ((n - 2) * (n - 3))))
              .withColumn(pre + "zscore", ratio(F.col(c) - F.col(pre + "mean"), F.col(pre + "std")))
              .withColumn(pre + "position", ratio(F.col(c) - F.col(pre + "min"), F.col(pre + "max") - F.col(pre + "min")))
              .drop("_q", "_m2", "_m3", "_m4", "_g1", "_g2"))
    return d


def lag_block(df: DataFrame, cols: Sequence[str], lags: Sequence[int] = (1, 2, 3, 5, 10), p: Panel = PANEL) -> DataFrame:
    out = []
    for c in cols:
        for k in lags:
            past = F.lag(c, k).over(p.w)
            out += [past.alias(f"{c}_lag_{k}"), (F.col(c) - past).alias(f"{c}_diff_{k}"), ratio(F.col(c) - past, past).alias(f"{c}_pct_{k}")]
    return df.select("*", *out)


def interaction_block(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    out = []
    for a, b in combinations(cols, 2):
        out += [(F.col(a) * F.col(b)).alias(f"{a}_x_{b}"), safe_div(a, F.when(F.abs(F.col(b)) > 1e-8, F.col(b)).otherwise(0.0)).alias(f"{a}_div_{b}")]
    return df.select("*", *out)


def polynomial_block(df: DataFrame, cols: Sequence[str], degree: int = 2, out: str = "poly") -> DataFrame:
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PolynomialExpansion, VectorAssembler
    st = [VectorAssembler(inputCols=list(cols), outputCol="_v", handleInvalid="keep"), PolynomialExpansion(degree=degree, inputCol="_v", outputCol=out)]
    return Pipeline(stages=st).fit(df).transform(df).drop("_v")


def series_summary(df: DataFrame, c: str, p: Panel = PANEL) -> DataFrame:
    """length, abs_energy, mean_abs_change, autocorr1, c3, n_peaks per key (one window pass + one aggregation)."""
    x = F.col(c)
    d = df.select(*p.keys, x.alias("_x"), F.lag(x).over(p.w).alias("_p"), F.lag(x, 2).over(p.w).alias("_pp"), F.lead(x).over(p.w).alias("_n"))
    return d.groupBy(*p.keys).agg(
        F.count("_x").alias("length"), F.sum(F.col("_x") ** 2).alias("abs_energy"), F.avg(F.abs(F.col("_x") - F.col("_p"))).alias("mean_abs_change"),
        F.corr("_x", "_p").alias("autocorr1"), F.avg(F.col("_x") * F.col("_p") * F.col("_pp")).alias("c3"),
        F.sum(((F.col("_x") > F.col("_p")) & (F.col("_x") > F.col("_n"))).cast("bigint")).alias("n_peaks"))


def volatility_block(df: DataFrame, windows: Sequence[int] = (10, 20), periods: float = 252, p: Panel = PANEL) -> DataFrame:
    """Annualized rolling deviation, its own deviation, and Parkinson range volatility."""
    d = df.withColumn("_r", F.ln(F.col("close") / F.lag("close").over(p.w))).withColumn("_hl", F.ln(F.col("high") / F.col("low")) ** 2)
    for n in windows:
        w = p.trailing(n)
        d = d.withColumn(f"vol_{n}", F.when(F.count("_r").over(w) == n, F.stddev_samp("_r").over(w) * math.sqrt(periods)))
        d = d.withColumn(f"vol_of_vol_{n}", F.when(F.count(f"vol_{n}").over(w) == n, F.stddev_samp(f"vol_{n}").over(w)))
        d = d.withColumn(f"parkinson_{n}", F.when(F.count("_hl").over(w) == n, F.sqrt(F.avg("_hl").over(w) / (4 * math.log(2)) * periods)))
    return d.drop("_r", "_hl")


def price_volatility_features(df: DataFrame, n: int = 20, p: Panel = PANEL) -> DataFrame:
    """return_1/5/10, hl_ratio, oc_ratio, close z-score over n rows."""
    c, w = F.col("close"), p.trailing(n)
    rets = [ratio(c - F.lag(c, k).over(p.w), F.lag(c, k).over(p.w)).alias(f"return_{k}") for k in (1, 5, 10)]
    z = F.when(F.count("close").over(w) == n, ratio(c - F.avg("close").over(w), F.stddev_samp("close").over(w))).alias("price_z")
    return df.select("*", *rets, ratio(F.col("high"), F.col("low")).alias("hl_ratio"), ratio(c, F.col("open")).alias("oc_ratio"), z)


def supervised_frame(df: DataFrame, cols: Sequence[str], lags: Sequence[int] = (1, 2, 3), windows: Sequence[int] = (5, 10), fill: float = 0.0,
                     p: Panel = PANEL) -> DataFrame:
    """Lags, rolling mean/std, log returns and realized volatility for every column, nulls filled."""
    d = df
    for c in cols:
        d = d.withColumn(f"{c}_logret", F.when((F.col(c) > 0) & (F.lag(c).over(p.w) > 0), F.ln(F.col(c) / F.lag(c).over(p.w))))
    for c in cols:
        d = d.select("*", *[F.lag(c, k).over(p.w).alias(f"{c}_lag{k}") for k in lags],
                     *[F.avg(c).over(p.trailing(n)).alias(f"{c}_mean{n}") for n in windows],
                     *[F.stddev_samp(c).over(p.trailing(n)).alias(f"{c}_std{n}") for n in windows],
                     *[F.sqrt(F.sum(F.col(f"{c}_logret") ** 2).over(p.trailing(n))).alias(f"{c}_rv{n}") for n in windows])
    new = [c for c in d.columns if c not in df.columns]
    return d.fillna(fill, new)


def percentile_rank(c: str, n: int, p: Panel = PANEL) -> Column:
    """Average-tie percent rank of the current value in its trailing window. Needs a full window."""
    lst = F.collect_list(c).over(p.trailing(n))
    below, ties = F.size(F.filter(lst, lambda x: x < F.col(c))), F.size(F.filter(lst, lambda x: x == F.col(c)))
    return F.when(F.size(lst) == n, (below + (ties + 1) / 2) / n)


def trimmed_mean(df: DataFrame, c: str, share: float = 0.1, keys: Sequence[str] = ()) -> DataFrame:
    """Mean of values between the share and 1-share quantiles, and MAD / IQR based deviation estimates."""
    q = quantiles(df, F.col(c), {"lo": share, "hi": 1 - share, "q1": .25, "q3": .75}, keys)
    d = attach_stats(df.select(*keys, c), q, keys, ["lo", "hi", "q1", "q3"])
    t = d.groupBy(*keys).agg(F.avg(F.when(F.col(c).between(F.col("lo"), F.col("hi")), F.col(c))).alias("trimmed_mean"),
                             F.first((F.col("q3") - F.col("q1")) / 1.349).alias("iqr_std"))
    return attach_stats(t, median_mad(df, F.col(c), keys).withColumnRenamed("mad", "mad_std"), keys, ["mad_std"])


def detrend(df: DataFrame, c: str, p: Panel = PANEL, out: str = "detrended") -> DataFrame:
    """Residual of the per-key linear fit on the row position."""
    d = df.withColumn("_i", F.row_number().over(p.w) - 1)
    fit = d.groupBy(*p.keys).agg(F.regr_slope(c, "_i").alias("_b"), F.regr_intercept(c, "_i").alias("_a"))
    return attach_stats(d, fit, list(p.keys), ["_b", "_a"]).withColumn(out, F.col(c) - F.col("_a") - F.col("_b") * F.col("_i")).drop("_i", "_a", "_b")


def smooth(c: str, n: int = 5, p: Panel = PANEL) -> Column:
    """Centred moving average with shrinking ends."""
    return F.avg(c).over(p.frame(-(n // 2), n // 2))


def normalize_signal(df: DataFrame, c: str, method: str = "zscore", p: Panel = PANEL, out: str = "normalized") -> DataFrame:
    w = p.whole
    e = safe_div(F.col(c) - F.avg(c).over(w), F.stddev_pop(c).over(w)) if method == "zscore" else \
        safe_div(F.col(c) - F.min(c).over(w), F.max(c).over(w) - F.min(c).over(w))
    return df.withColumn(out, e)


def jump_flag(df: DataFrame, n: int = 20, k: float = 3.0, c: str = "close", p: Panel = PANEL) -> DataFrame:
    d = df.withColumn("_r", ratio(F.col(c), F.lag(c).over(p.w)) - 1)
    w = p.trailing(n)
    z = ratio(F.abs(F.col("_r") - F.avg("_r").over(w)), F.stddev_samp("_r").over(w))
    return d.withColumn("jump", F.coalesce((z > k) & (F.count("_r").over(w) == n), F.lit(False)).cast("int")).drop("_r")


def market_stress(df: DataFrame, n: int = 20, c: str = "close", p: Panel = PANEL) -> DataFrame:
    """Mean absolute negative return times the share of negative returns."""
    d = df.withColumn("_r", ratio(F.col(c), F.lag(c).over(p.w)) - 1)
    w = p.trailing(n)
    mag = F.coalesce(F.avg(F.when(F.col("_r") < 0, -F.col("_r"))).over(w), F.lit(0.0))
    share = F.avg(F.when(F.col("_r").isNotNull(), (F.col("_r") < 0).cast("double"))).over(w)
    return d.withColumn("stress", F.when(F.count("_r").over(w) == n, mag * share)).drop("_r")


def return_history(df: DataFrame, n: int = 10, c: str = "close", p: Panel = PANEL, out: str = "history") -> DataFrame:
    """Array of the last n log returns, oldest first; null until complete."""
    d = df.withColumn("_r", F.ln(F.col(c) / F.lag(c).over(p.w)))
    l = F.collect_list("_r").over(p.trailing(n))
    return d.withColumn(out, F.when(F.size(l) == n, l)).drop("_r")
