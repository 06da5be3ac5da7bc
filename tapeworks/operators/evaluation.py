"""Forecast, classification and model-comparison metrics over long prediction tables."""
from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.mathx import ratio, safe_div, two_sided_p
from tapeworks.functions.sampling import hash_uniform
from tapeworks.plans.orderstats import average_ranks
from tapeworks.plans.panel import Panel, join_on

Y, P = "y", "prediction"


def regression_metrics(df: DataFrame, keys: Sequence[str] = (), y: str = Y, p: str = P, previous: str | None = None) -> DataFrame:
    """n, mae, mse, rmse, mape, smape, r2, bias; mase against a naive column when given."""
    e, a = F.col(y) - F.col(p), F.col(y)
    aggs = [F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), (100 * F.avg(ratio(F.abs(e), F.abs(a)))).alias("mape"),
            (100 * F.avg(safe_div(2 * F.abs(e), F.abs(a) + F.abs(F.col(p))))).alias("smape"), (1 - safe_div(F.avg(e * e), F.var_pop(F.when(e.isNotNull(), a)))).alias("r2"), F.avg(e).alias("bias")]
    if previous:
        aggs.append(safe_div(F.avg(F.abs(e)), F.avg(F.abs(a - F.col(previous)))).alias("mase"))
    return df.groupBy(*keys).agg(*aggs)


def directional_interval(df: DataFrame, panel: Panel, y: str = Y, p: str = P, lo: str = "lower", hi: str = "upper") -> DataFrame:
    """Sign accuracy of changes, interval coverage and mean width per key."""
    prev = F.lag(y).over(panel.w)
    d = df.withColumn("_up", F.signum(F.col(y) - prev)).withColumn("_pp", F.signum(F.col(p) - prev))
    return d.groupBy(*panel.keys).agg(F.avg((F.col("_up") == F.col("_pp")).cast("double")).alias("direction"), F.avg(F.col(y).between(F.col(lo), F.col(hi)).cast("double")).alias("coverage"), F.avg(F.col(hi) - F.col(lo)).alias("width"))


def residual_diagnostics(df: DataFrame, panel: Panel, lags: Sequence[int] = tuple(range(1, 11)), y: str = Y, p: str = P) -> DataFrame:
    """Residual autocorrelation at each lag, skew, excess kurtosis and Jarque-Bera per key."""
    d = df.withColumn("_e", F.col(y) - F.col(p)).where(F.col("_e").isNotNull())
    d = d.select(*panel.keys, "_e", *[F.lag("_e", k).over(panel.w).alias(f"_l{k}") for k in lags])
    g = d.groupBy(*panel.keys).agg(F.count("_e").alias("n"), *[F.corr("_e", f"_l{k}").alias(f"acf_{k}") for k in lags], F.skewness("_e").alias("skew"), F.kurtosis("_e").alias("kurt"))
    return g.withColumn("jarque_bera", F.col("n") / 6 * (F.col("skew") ** 2 + F.col("kurt") ** 2 / 4))


def error_analysis(df: DataFrame, panel: Panel, y: str = Y, p: str = P) -> DataFrame:
    """Skew, kurtosis, time trend of errors, and first-half against second-half RMSE."""
    d = df.withColumn("_e", F.col(y) - F.col(p)).where(F.col("_e").isNotNull()).withColumn("_i", F.row_number().over(panel.w)).withColumn("_n", F.count(F.lit(1)).over(panel.whole))
    h = F.col("_i") <= F.col("_n") / 2
    rm = lambda c: F.sqrt(F.avg(F.when(c, F.col("_e") ** 2)))
    return d.groupBy(*panel.keys).agg(F.skewness("_e").alias("skew"), F.kurtosis("_e").alias("kurt"), F.regr_slope("_e", F.col("_i").cast("double")).alias("trend"), rm(h).alias("rmse_first"), rm(~h).alias("rmse_second"))


def strategy_metrics(df: DataFrame, panel: Panel, y: str = Y, p: str = P, periods: float = 252) -> DataFrame:
    """Long/short on the predicted direction: total return, Sharpe, Sortino, drawdown, win rate, profit factor per key."""
    from tapeworks.operators.risk import performance
    prev = F.lag(y).over(panel.w)
    d = df.withColumn("_prev", prev)
    d = d.withColumn("r", F.signum(F.col(p) - F.col("_prev")) * (ratio(F.col(y), F.col("_prev")) - 1)).where(F.col("r").isNotNull() & (F.col("r") > -1))
    return performance(d, "r", panel, periods=periods)


def classification_metrics(df: DataFrame, label: str = "label", pred: str = P) -> DataFrame:
    """accuracy, macro precision / recall / F1 and per-class counts from one confusion table."""
    c = df.groupBy(label, pred).agg(F.count(F.lit(1)).alias("n"))
    cls = c.select(F.explode(F.array(F.struct(F.col(label).alias("k"), F.when(F.col(label) == F.col(pred), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("act"), F.lit(0).cast("bigint").alias("prd")),
                                     F.struct(F.col(pred).alias("k"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("act"), F.col("n").alias("prd")))).alias("x")).select("x.*")
    g = cls.groupBy("k").agg(F.sum("tp").alias("tp"), F.sum("act").alias("act"), F.sum("prd").alias("prd"))
    g = g.withColumn("precision", safe_div(F.col("tp").cast("double"), "prd")).withColumn("recall", safe_div(F.col("tp").cast("double"), "act"))
    g = g.withColumn("f1", safe_div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return g.agg((F.sum("tp") / F.sum("act")).alias("accuracy"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.sum("act").alias("n"))


def auc_logloss(df: DataFrame, label: str = "label", score: str = "score", eps: float = 1e-15) -> DataFrame:
    """Exact AUC from average ranks (distributed) and log loss."""
    d = average_ranks(df.select(F.col(label).cast("double").alias("_y"), F.col(score).cast("double").alias("_s")), "_s", "_r")
    q = F.greatest(F.least(F.col("_s"), F.lit(1 - eps)), F.lit(eps))
    g = d.agg(F.sum("_y").alias("_p"), F.sum(1 - F.col("_y")).alias("_n"), F.sum(F.col("_y") * F.col("_r")).alias("_rs"), (-F.avg(F.col("_y") * F.ln(q) + (1 - F.col("_y")) * F.ln(1 - q))).alias("logloss"))
    return g.select(safe_div(F.col("_rs") - F.col("_p") * (F.col("_p") + 1) / 2, F.col("_p") * F.col("_n")).alias("auc"), "logloss", F.col("_p").alias("positives"))


# cumulative Poisson(1) probabilities (fixed values by formula)
_POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(8)]


def bootstrap_interval(df: DataFrame, value: Column, row_id: str, replicates: int = 200, level: float = 0.95, keys: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """Percentile interval of a mean: Poisson(1) weights per (row, replicate) by hash, aggregated per replicate.

    Weighted sums combine map-side, so only replicates x keys x tasks partial rows are shuffled.
    """
    d = df.select(*keys, row_id, value.alias("_x")).where(F.col("_x").isNotNull())
    d = d.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    u = hash_uniform(seed, row_id, "rep")
    w = F.lit(float(len(_POISSON)))
    for k in range(len(_POISSON) - 1, -1, -1):
        w = F.when(u < _POISSON[k], float(k)).otherwise(w)
    r = d.withColumn("_w", w).groupBy(*keys, "rep").agg(safe_div(F.sum(F.col("_x") * F.col("_w")), F.sum("_w")).alias("_m"))
    a = (1 - level) / 2
    return r.groupBy(*keys).agg(F.avg("_m").alias("mean"), F.percentile("_m", a).alias("lower"), F.percentile("_m", 1 - a).alias("upper"))


def compare_metrics(a: DataFrame, b: DataFrame, limit: float = 0.05, keys: Sequence[str] = ("metric",)) -> DataFrame:
    """Absolute and relative change of a metric table against another, with a significance flag."""
    j = a.withColumnRenamed("value", "value_a").join(b.withColumnRenamed("value", "value_b"), list(keys))
    rel = safe_div(F.col("value_b") - F.col("value_a"), F.abs("value_a"), None)
    return j.withColumn("difference", F.col("value_b") - F.col("value_a")).withColumn("relative", rel).withColumn("significant", F.coalesce(F.abs(rel) > limit, F.lit(False)).cast("int"))


def latency_stats(df: DataFrame, ms: str, ts: str, keys: Sequence[str] = ()) -> DataFrame:
    """p50 / p95 / p99 by sketch, mean, max and events per second."""
    span = (F.unix_micros(F.max(F.col(ts).cast("timestamp"))) - F.unix_micros(F.min(F.col(ts).cast("timestamp")))) / 1e6
    return df.groupBy(*keys).agg(F.count(ms).alias("n"), F.avg(ms).alias("mean"), F.max(ms).alias("max"), F.percentile_approx(ms, 0.5, 10000).alias("p50"), F.percentile_approx(ms, 0.95, 10000).alias("p95"), F.percentile_approx(ms, 0.99, 10000).alias("p99"),
                                 safe_div(F.count(ms).cast("double"), span).alias("per_second"))


def prediction_stability(df: DataFrame, key: str, version: str = "version", p: str = P) -> DataFrame:
    """Pairwise correlation and mean absolute difference between versions (a handful) of the same rows."""
    a, b = df.select(key, F.col(version).alias("v1"), F.col(p).alias("p1")), df.select(key, F.col(version).alias("v2"), F.col(p).alias("p2"))
    return a.join(b, key).where("v1 < v2").groupBy("v1", "v2").agg(F.corr("p1", "p2").alias("corr"), F.avg(F.abs(F.col("p1") - F.col("p2"))).alias("mad"), F.stddev_samp(F.col("p1") - F.col("p2")).alias("diff_std"))


def regression_test(current: DataFrame, baseline: DataFrame, limits: Mapping[str, float], higher_better: Sequence[str] = ()) -> DataFrame:
    """Degradation of each metric against a stored baseline with severity (limit, 2x, 4x)."""
    j = current.withColumnRenamed("value", "current").join(baseline.withColumnRenamed("value", "baseline"), "metric")
    up = F.col("metric").isin(list(higher_better))
    deg = safe_div(F.when(up, F.col("baseline") - F.col("current")).otherwise(F.col("current") - F.col("baseline")), F.abs("baseline"))
    lim = F.lit(0.05)
    for k, v in limits.items():
        lim = F.when(F.col("metric") == k, v).otherwise(lim)
    d = j.withColumn("degradation", deg).withColumn("limit", lim)
    return d.withColumn("severity", F.when(F.col("degradation") > 4 * F.col("limit"), "critical").when(F.col("degradation") > 2 * F.col("limit"), "high").when(F.col("degradation") > F.col("limit"), "medium").otherwise("none"))


def volatility_losses(df: DataFrame, keys: Sequence[str] = (), y: str = Y, p: str = P) -> DataFrame:
    """QLIKE, R2 of logs and hit rate (within 20 %) for positive volatility forecasts."""
    a, f = F.col(y), F.col(p)
    ok = (a > 0) & (f > 0)
    q = F.when(ok, F.ln(F.when(ok, f)) + a / F.when(ok, f))
    return df.groupBy(*keys).agg(F.avg(q).alias("qlike"), (F.corr(F.when(ok, F.ln(F.when(ok, a))), F.when(ok, F.ln(F.when(ok, f)))) ** 2).alias("r2_log"), F.avg(F.when(ok, (F.abs(a - f) <= .2 * a).cast("double"))).alias("hit_rate"))


def diebold_mariano(df: DataFrame, a: str, b: str, y: str = Y, keys: Sequence[str] = ()) -> DataFrame:
    """Mean squared-loss difference over its standard error, two-sided normal p."""
    l = (F.col(y) - F.col(a)) ** 2 - (F.col(y) - F.col(b)) ** 2
    g = df.groupBy(*keys).agg(F.count(l).alias("n"), F.avg(l).alias("mean_diff"), safe_div(F.avg(l), F.sqrt(F.var_samp(l) / F.count(l))).alias("dm"))
    return g.withColumn("p", two_sided_p("dm"))


def confidence_set(scores: DataFrame, z: float = 1.645, lower_better: bool = True) -> DataFrame:
    """Models within best + z * deviation of the model scores, rank and normalized weights (one row per model)."""
    s = F.col("score") if lower_better else -F.col("score")
    st = scores.agg(F.struct(F.min(s).alias("b"), F.coalesce(F.stddev_samp(s), F.lit(0.0)).alias("sd")).alias("t")).scalar()
    d = scores.withColumn("_t", st).withColumn("_s", s)
    d = d.withColumn("rank", F.rank().over(Window.orderBy("_s"))).withColumn("in_set", (F.col("_s") <= F.col("_t.b") + z * F.col("_t.sd")).cast("int"))
    inv = 1 / (F.abs("score") + 1e-12)
    return d.withColumn("weight", inv / F.sum(inv).over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).drop("_t", "_s")


def rolling_performance(df: DataFrame, panel: Panel, n: int = 30, y: str = Y, p: str = P) -> DataFrame:
    """Rolling RMSE and its stability 1 / (1 + cv) per key."""
    d = df.withColumn("_e2", (F.col(y) - F.col(p)) ** 2)
    w = panel.trailing(n)
    return d.withColumn("roll_rmse", F.when(F.count("_e2").over(w) == n, F.sqrt(F.avg("_e2").over(w)))).drop("_e2")


def stability_gap(rolled: DataFrame, keys: Sequence[str], train_rows: Column) -> DataFrame:
    """Stability of rolling RMSE and the relative train-to-test gap."""
    x = F.col("roll_rmse")
    g = rolled.groupBy(*keys).agg(safe_div(F.stddev_samp(x), F.avg(x)).alias("cv"), F.avg(F.when(train_rows, x)).alias("train"), F.avg(F.when(~train_rows, x)).alias("test"))
    return g.select(*keys, "cv", (1 / (1 + F.col("cv"))).alias("stability"), safe_div(F.col("test") - F.col("train"), "train").alias("overfit_gap"))


def forgetting(history: DataFrame, keys: Sequence[str] = ("task", "metric")) -> DataFrame:
    """Per step: best so far, forgetting (best earlier - current), retention and event flag (> .05)."""
    w = Window.partitionBy(*keys).orderBy("step")
    d = history.withColumn("best", F.max("value").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("first", F.first("value").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("forgetting", F.greatest(F.col("best") - F.col("value"), F.lit(0.0))).withColumn("retention", safe_div("value", "best", None)).withColumn("backward_transfer", F.col("value") - F.col("first"))
    return d.withColumn("event", F.coalesce(F.col("forgetting") > .05, F.lit(False)).cast("int")).drop("first")


def plasticity(history: DataFrame, target: float, keys: Sequence[str] = ("task", "metric")) -> DataFrame:
    """First step reaching the target, learning efficiency (area over steps), adaptation rate and speed-up over the first task."""
    g = history.groupBy(*keys).agg(F.min(F.when(F.col("value") >= target, F.col("step"))).alias("first_step"), F.avg("value").alias("efficiency"), F.regr_slope("value", F.col("step").cast("double")).alias("adaptation"))
    w = Window.partitionBy(*keys[1:]).orderBy(keys[0]) if len(keys) > 1 else Window.orderBy(keys[0])
    return g.withColumn("speed_up", safe_div(F.first("first_step").over(w).cast("double"), "first_step", None))


def validate_predictions(df: DataFrame, p: str = P, lo: float | None = None, hi: float | None = None) -> DataFrame:
    x = F.col(p)
    i = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    rng = F.lit(False)
    rng = rng | (x < lo) if lo is not None else rng
    rng = rng | (x > hi) if hi is not None else rng
    return df.agg(F.count(F.lit(1)).alias("n"), i(x.isNull()).alias("nulls"), i(F.isnan(x)).alias("nans"), i(F.abs(x) == float("inf")).alias("infinite"), i(rng).alias("out_of_range"))


def determinism(a: DataFrame, b: DataFrame, key: Sequence[str], p: str = P, tol: float = 1e-9) -> DataFrame:
    j = a.select(*key, F.col(p).alias("_a")).join(b.select(*key, F.col(p).alias("_b")), list(key), "full")
    return j.agg(F.count(F.lit(1)).alias("n"), F.sum((~(F.abs(F.col("_a") - F.col("_b")) <= tol) | F.col("_a").isNull() | F.col("_b").isNull()).cast("bigint")).alias("different"))


# -- splits and ensembles -----------------------------------------------------------------

def time_folds(df: DataFrame, panel: Panel, folds: int = 5, kind: str = "expanding", train: int = 252, test: int = 63) -> DataFrame:
    """(fold, role) per row from its position: expanding, rolling, walk_forward or holdout. Rows can serve several folds."""
    d = df.withColumn("_rn", F.row_number().over(panel.w)).withColumn("_n", F.count(F.lit(1)).over(panel.whole))
    if kind == "holdout":
        return d.withColumn("fold", F.lit(0)).withColumn("role", F.when(F.col("_rn") <= 0.8 * F.col("_n"), "train").otherwise("test")).drop("_rn", "_n")
    if kind == "walk_forward":
        d = d.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
        start = F.col("fold") * test
        role = F.when((F.col("_rn") > start) & (F.col("_rn") <= start + train), "train").when((F.col("_rn") > start + train) & (F.col("_rn") <= start + train + test), "test")
        return d.withColumn("role", role).where(F.col("role").isNotNull()).drop("_rn", "_n")
    d = d.withColumn("_k", F.least(F.floor((F.col("_rn") - 1) * (folds + 1) / F.col("_n")), F.lit(folds)))
    d = d.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    before = (F.col("_k") <= F.col("fold")) if kind == "expanding" else (F.col("_k") == F.col("fold"))
    return d.withColumn("role", F.when(before, "train").when(F.col("_k") == F.col("fold") + 1, "test")).where(F.col("role").isNotNull()).drop("_rn", "_n", "_k")


def blend(long: DataFrame, keys: Sequence[str], weights: DataFrame | None = None) -> DataFrame:
    """Mean or weighted mean prediction per row from (keys, model, prediction)."""
    d = long.withColumn("weight", F.lit(1.0)) if weights is None else long.join(F.broadcast(weights.select("model", "weight")), "model")
    return d.groupBy(*keys).agg(safe_div(F.sum(F.col(P) * F.col("weight")), F.sum("weight")).alias(P), F.max(Y).alias(Y))


def recent_error_weights(long: DataFrame, keys: Sequence[str], n: int = 100) -> DataFrame:
    """Inverse mean absolute error over the last n rows, per row and model, as weights (current row excluded)."""
    w = Window.partitionBy(*keys, "model").orderBy("ts").rowsBetween(-n, -1)
    d = long.withColumn("_e", F.avg(F.abs(F.col(Y) - F.col(P))).over(w))
    d = d.withColumn("_w", F.coalesce(1 / (F.col("_e") + 1e-8), F.lit(1.0)))
    return d.groupBy(*keys, "ts").agg((F.sum(F.col(P) * F.col("_w")) / F.sum("_w")).alias(P), F.max(Y).alias(Y))


def blend_horizons(forecasts: DataFrame, keys: Sequence[str] = ("series", "ts")) -> DataFrame:
    """Horizon forecasts blended by inverse interval width with bounds and confidence."""
    wd = F.col("upper") - F.col("lower")
    w = 1 / (wd + 1e-8)
    g = forecasts.withColumn("_w", w).groupBy(*keys).agg(*[(F.sum(F.col(c) * F.col("_w")) / F.sum("_w")).alias(c) for c in ("yhat", "lower", "upper")], F.count(F.lit(1)).alias("n_horizons"))
    return g.withColumn("confidence", F.greatest(1 - safe_div(F.col("upper") - F.col("lower"), 2 * F.abs("yhat")), F.lit(0.0)))
