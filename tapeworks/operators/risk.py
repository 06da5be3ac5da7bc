"""Return, drawdown, tail and portfolio measures over (strategy, ts, r) tables."""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.mathx import chi2_sf, clip, ratio, safe_div
from tapeworks.functions.sampling import hash_index
from tapeworks.plans.orderstats import attach_stats, quantiles
from tapeworks.plans.panel import Panel, islands, join_on, number_rows, running

STRATEGY = Panel(("strategy",), ("ts",))
INF = float("inf")


def cumulative_return(df: DataFrame, r: str = "r", p: Panel = STRATEGY, bucket: Column | None = None, out: str = "equity") -> DataFrame:
    """Product of 1+r as a running sum of logs (r > -1)."""
    lg = F.log1p(F.col(r))
    if bucket is None:
        return df.withColumn(out, F.exp(F.sum(lg).over(p.cum)))
    return running(df, p, {out: ("sum", lg)}, bucket).withColumn(out, F.exp(out))


def with_drawdown(df: DataFrame, r: str = "r", p: Panel = STRATEGY, bucket: Column | None = None) -> DataFrame:
    """equity, peak (starting at 1), drawdown in [0, 1)."""
    d = cumulative_return(df, r, p, bucket)
    if bucket is None:
        d = d.withColumn("peak", F.greatest(F.max("equity").over(p.cum), F.lit(1.0)))
    else:
        d = running(d, p, {"peak": ("max", F.col("equity"))}, bucket).withColumn("peak", F.greatest("peak", F.lit(1.0)))
    return d.withColumn("drawdown", 1 - F.col("equity") / F.col("peak"))


def _aggs(r: Column, rf: float, periods: float) -> list[Column]:
    e = r - rf / periods
    n, gain, loss = F.count(r), F.sum(F.when(r > 0, r).otherwise(0.0)), F.sum(F.when(r < 0, -r).otherwise(0.0))
    sd, down = F.stddev_samp(e), F.sqrt(F.avg(F.when(e < 0, e * e)))
    return [
        n.alias("n"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("volatility"),
        F.when((n < 2) | (sd < 1e-10), 0.0).otherwise(ratio(F.avg(e), sd) * math.sqrt(periods)).alias("sharpe"),
        F.when(n < 2, 0.0).when(F.sum((e < 0).cast("int")) == 0, F.when(F.avg(e) > 0, INF).otherwise(0.0)).otherwise(safe_div(F.avg(e), down) * math.sqrt(periods)).alias("sortino"),
        F.avg((r > 0).cast("double")).alias("win_rate"),
        F.when(gain == 0, 1.0).when(loss == 0, INF).otherwise(ratio(gain, loss)).alias("profit_factor"),
        (F.exp(F.sum(F.log1p(r))) - 1).alias("total_return"), F.skewness(r).alias("skew"), F.kurtosis(r).alias("kurtosis"),
        F.sqrt(F.avg(F.when(r < 0, r * r))).alias("downside_vol"),
    ]


def performance(df: DataFrame, r: str = "r", p: Panel = STRATEGY, rf: float = 0.02, periods: float = 252) -> DataFrame:
    """One row per strategy: Sharpe, Sortino, Calmar, drawdown, win rate, profit factor, moments."""
    d = with_drawdown(df, r, p)
    g = d.groupBy(*p.keys).agg(*_aggs(F.col(r), rf, periods), F.max("drawdown").alias("max_drawdown"))
    ann = F.pow(1 + F.col("total_return"), periods / F.col("n")) - 1
    g = g.withColumn("annual_return", ann)
    return g.withColumn("calmar", F.when(F.col("n") < 2, 0.0).when(F.col("max_drawdown") == 0, F.when(F.col("annual_return") > 0, INF).otherwise(0.0))
                        .otherwise(ratio("annual_return", "max_drawdown")))


def value_at_risk(df: DataFrame, r: str = "r", keys: Sequence[str] = ("strategy",), level: float = 0.05) -> DataFrame:
    """Historical and parametric VaR, CVaR, as positive losses; zero under 10 rows. Two passes: quantile, tail mean."""
    z = {0.05: -1.6448536269514729, 0.01: -2.3263478740408408, 0.1: -1.2815515655446004}[level]
    q = quantiles(df, F.col(r), {"_q": level, "_q95": .95, "_q05": .05}, keys)
    d = attach_stats(df.select(*keys, r), q, keys, ["_q", "_q95", "_q05"])
    x = F.col(r)
    g = d.groupBy(*keys).agg(F.count(x).alias("n"), (-F.first("_q")).alias("var_hist"), (-(F.avg(x) + z * F.stddev_samp(x))).alias("var_param"),
                             (-F.avg(F.when(x <= F.col("_q"), x))).alias("cvar"), F.abs(ratio(F.first("_q95"), F.first("_q05"))).alias("tail_ratio"))
    few = lambda c: F.when(F.col("n") < 10, 0.0).otherwise(F.col(c)).alias(c)
    return g.select(*keys, "n", few("var_hist"), few("var_param"), few("cvar"), "tail_ratio")


def bootstrap_var(df: DataFrame, sims: int = 1000, horizon: int = 10, level: float = 0.05, r: str = "r", p: Panel = STRATEGY, seed: int = 42, bucket: Column | None = None) -> DataFrame:
    """Resample ``horizon`` returns per simulation by position; draws are hashes, so reruns agree."""
    d = df.where(F.col(r).isNotNull())
    if bucket is None:
        d = d.withColumn("_rn", F.row_number().over(p.w).cast("bigint"))
    else:
        d = number_rows(d, p, bucket)
    n = d.groupBy(*p.keys).agg(F.count(F.lit(1)).alias("_n"))
    draws = (n.withColumn("sim", F.explode(F.sequence(F.lit(1), F.lit(sims)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
              .withColumn("_rn", (hash_index(F.col("_n"), seed, *p.keys, "sim", "step") + 1).cast("bigint")))
    paths = join_on(draws, d.select(*p.keys, "_rn", r), [*p.keys, "_rn"]).groupBy(*p.keys, "sim").agg((F.exp(F.sum(F.log1p(r))) - 1).alias("path"))
    g = paths.groupBy(*p.keys).agg(F.percentile("path", level).alias("_q"), F.avg("path").alias("mean_path"))
    return g.select(*p.keys, (-F.col("_q")).alias("var_boot"), "mean_path")


def benchmark_measures(df: DataFrame, r: str = "r", b: str = "b", keys: Sequence[str] = ("strategy",), rf: float = 0.02, periods: float = 252) -> DataFrame:
    """beta, alpha (Jensen, annual), information ratio, tracking error, Treynor on aligned rows."""
    x, y = F.col(r), F.col(b)
    g = df.where(x.isNotNull() & y.isNotNull()).groupBy(*keys).agg(
        F.count(x).alias("n"), safe_div(F.covar_samp(x, y), F.var_samp(y)).alias("beta"), F.avg(x).alias("_mr"), F.avg(y).alias("_mb"),
        (F.stddev_samp(x - y) * math.sqrt(periods)).alias("tracking_error"), F.avg(x - y).alias("_ex"), F.corr(x, y).alias("correlation"))
    f = rf / periods
    return (g.withColumn("alpha", (F.col("_mr") - (f + F.col("beta") * (F.col("_mb") - f))) * periods)
             .withColumn("information_ratio", safe_div(F.col("_ex") * periods, F.col("tracking_error")))
             .withColumn("treynor", safe_div((F.col("_mr") - f) * periods, F.col("beta"))).drop("_mr", "_mb", "_ex"))


def rolling_metrics(df: DataFrame, n: int = 252, r: str = "r", p: Panel = STRATEGY, rf: float = 0.02, periods: float = 252) -> DataFrame:
    w, x = p.trailing(n), F.col(r)
    ok = F.count(x).over(w) == n
    sd = F.stddev_samp(x).over(w)
    d = df.withColumn("roll_sharpe", F.when(ok, F.when(sd < 1e-10, 0.0).otherwise(ratio(F.avg(x).over(w) - rf / periods, sd) * math.sqrt(periods))))
    d = d.withColumn("roll_vol", F.when(ok, sd * math.sqrt(periods))).withColumn("roll_win", F.when(ok, F.avg((x > 0).cast("double")).over(w)))
    step = lambda a, v: F.struct((a["e"] * (1 + v)).alias("e"), F.greatest(a["k"], a["e"] * (1 + v)).alias("k"), F.greatest(a["m"], 1 - a["e"] * (1 + v) / F.greatest(a["k"], a["e"] * (1 + v))).alias("m"))
    start = F.struct(F.lit(1.0).alias("e"), F.lit(1.0).alias("k"), F.lit(0.0).alias("m"))
    d = d.withColumn("_l", F.collect_list(x).over(w))
    return d.withColumn("roll_drawdown", F.when(ok, F.aggregate("_l", start, step)["m"])).drop("_l")


def rank_strategies(perf: DataFrame, by: str = "sharpe") -> DataFrame:
    """Rank of a one-row-per-strategy table."""
    return perf.withColumn("rank", F.rank().over(Window.orderBy(F.desc(by))))


def drawdown_periods(df: DataFrame, r: str = "r", p: Panel = STRATEGY) -> DataFrame:
    """start, trough, end, depth, rows, recovered per contiguous stretch under water."""
    d = with_drawdown(df, r, p).withColumn("_uw", F.col("drawdown") > 1e-12)
    d = islands(d, p, F.col("_uw"), "_isl")
    d = d.withColumn("_last", F.lead("ts").over(p.w).isNull())
    g = d.where("_uw").groupBy(*p.keys, "_isl").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.min_by("ts", F.struct(-F.col("drawdown"), "ts")).alias("trough"),
                                                   F.max("drawdown").alias("depth"), F.count(F.lit(1)).alias("rows"), (~F.max("_last")).cast("int").alias("recovered"))
    return g.drop("_isl")


def monthly_returns(df: DataFrame, r: str = "r", keys: Sequence[str] = ("strategy",), ts: str = "ts") -> DataFrame:
    return df.groupBy(*keys, F.date_trunc("month", ts).alias("month")).agg((F.exp(F.sum(F.log1p(r))) - 1).alias("ret"), F.count(r).alias("n"))


def performance_features(df: DataFrame, n: int = 168, e: str = "equity", p: Panel = STRATEGY, steps: Sequence[int] = (1, 7, 30), periods: float = 8760) -> DataFrame:
    """PnL, multi-step returns, trailing Sharpe and drawdown from an equity history."""
    d = df.withColumn("pnl", F.col(e) - F.lag(e).over(p.w)).withColumn("_r", ratio(e, F.lag(e).over(p.w)) - 1)
    for k in steps:
        d = d.withColumn(f"ret_{k}", ratio(e, F.lag(e, k).over(p.w)) - 1)
    w = p.trailing(n)
    d = d.withColumn("sharpe_n", safe_div(F.avg("_r").over(w), F.stddev_samp("_r").over(w)) * math.sqrt(periods))
    return d.withColumn("drawdown_n", 1 - F.col(e) / F.max(e).over(w)).drop("_r")


def exposure(positions: DataFrame, by: Sequence[str] = ("account",), value: str = "value", item: str = "symbol") -> DataFrame:
    """gross, net, n, Herfindahl and largest share of absolute weights per book; weights never leave the aggregation."""
    v = F.col(value)
    per = positions.groupBy(*by, item).agg(F.sum(v).alias("_v"))
    g = per.groupBy(*by).agg(F.sum(F.abs("_v")).alias("gross"), F.sum("_v").alias("net"), F.count(F.lit(1)).alias("n"), F.sum(F.col("_v") ** 2).alias("_q"), F.max(F.abs("_v")).alias("_m"))
    return g.select(*by, "gross", "net", "n", safe_div("_q", F.col("gross") ** 2).alias("herfindahl"), safe_div("_m", "gross").alias("top_share"))


def valuation(ledger: DataFrame, prices: DataFrame, p: Panel, legacy: bool = False) -> DataFrame:
    """Average-cost valuation of a buy/sell ledger per key: quantity, cost, realized, unrealized at the given price.

    For long-only average cost, realized = proceeds - fees - cost of what was sold; the average is taken over
    all buys, so the result is a pair of sums. ``legacy`` leaves the cost basis out of realized.
    """
    b, q, px, fee = F.col("side") == "buy", F.col("quantity"), F.col("price"), F.col("fee")
    g = ledger.groupBy(*p.keys).agg(F.sum(F.when(b, q).otherwise(0.0)).alias("bought"), F.sum(F.when(b, q * px + fee).otherwise(0.0)).alias("paid"),
                                    F.sum(F.when(b, 0.0).otherwise(q)).alias("sold"), F.sum(F.when(b, 0.0).otherwise(q * px - fee)).alias("proceeds"))
    g = join_on(g, prices.select(*p.keys, F.col("price").alias("mark")), p.keys, "left").withColumn("avg_cost", safe_div("paid", "bought"))
    pos = F.col("bought") - F.col("sold")
    real = F.col("proceeds") if legacy else F.col("proceeds") - F.col("sold") * F.col("avg_cost")
    return g.select(*p.keys, pos.alias("quantity"), "avg_cost", real.alias("realized"), (pos * (F.col("mark") - F.col("avg_cost"))).alias("unrealized"))


def risk_limits(df: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Rows breaching any column limit, with the names of the breached ones."""
    hits = F.array_compact(F.array(*[F.when(F.col(c) > v, F.lit(c)) for c, v in limits.items()]))
    return df.withColumn("breaches", hits).where(F.size("breaches") > 0)


def position_sizes(df: DataFrame, capital: float = 100_000.0, risk: float = 0.02, target_vol: float = 0.15, max_share: float = 0.25) -> DataFrame:
    """kelly, fixed_fraction, vol_target, var_size and a regime factor from win_rate, payoff, volatility, var, stop_distance, regime."""
    k = clip(F.col("win_rate") - safe_div(1 - F.col("win_rate"), F.col("payoff")), 0.0, max_share)
    factor = F.when(F.col("regime") == 0, 1.2).when(F.col("regime") == 1, 1.0).when(F.col("regime") == 2, 0.6).otherwise(0.3)
    return df.select("*", (k * capital).alias("kelly"), F.least(safe_div(F.lit(capital * risk), F.col("stop_distance")), F.lit(capital * max_share)).alias("fixed_fraction"),
                     (capital * F.least(safe_div(F.lit(target_vol), F.col("volatility")), F.lit(1.0))).alias("vol_target"),
                     F.least(safe_div(F.lit(capital * risk), F.col("var")), F.lit(capital)).alias("var_size"), factor.alias("regime_factor"))


def stop_levels(df: DataFrame, n: int = 14, m: float = 2.0, p: Panel = Panel()) -> DataFrame:
    """Long-side stops: mean absolute return, Bollinger, volatility; the lowest is combined; trailing follows the running high."""
    w, c = p.trailing(n), F.col("close")
    d = df.withColumn("_r", ratio(c, F.lag("close").over(p.w)) - 1)
    ok = F.count("_r").over(w) == n
    d = (d.withColumn("stop_mar", F.when(ok, c * (1 - m * F.avg(F.abs("_r")).over(w)))).withColumn("stop_band", F.when(ok, F.avg("close").over(w) - m * F.stddev_pop("close").over(w)))
          .withColumn("stop_vol", F.when(ok, c * (1 - m * F.stddev_samp("_r").over(w)))))
    d = d.withColumn("stop", F.least("stop_mar", "stop_band", "stop_vol"))
    return d.withColumn("stop_trailing", F.max("stop_vol").over(p.cum)).drop("_r")


def var_backtest(df: DataFrame, level: float = 0.95, r: str = "r", v: str = "var", p: Panel = STRATEGY) -> DataFrame:
    """Violations, Kupiec and Christoffersen likelihood ratios with p-values, longest cluster, traffic light."""
    d = df.where(F.col(r).isNotNull() & F.col(v).isNotNull()).withColumn("_h", (F.col(r) < -F.col(v)).cast("int"))
    d = d.withColumn("_p", F.lag("_h").over(p.w))
    d = islands(d, p, F.col("_h"), "_isl")
    d = d.withColumn("_run", F.when(F.col("_h") == 1, F.row_number().over(Window.partitionBy(*p.keys, "_isl").orderBy(*p.order))).otherwise(0))
    cnt = lambda a, b: F.sum(((F.col("_p") == a) & (F.col("_h") == b)).cast("double"))
    g = d.groupBy(*p.keys).agg(F.count(F.lit(1)).alias("n"), F.sum("_h").cast("bigint").alias("violations"), cnt(0, 0).alias("n00"), cnt(0, 1).alias("n01"), cnt(1, 0).alias("n10"), cnt(1, 1).alias("n11"),
                               F.max("_run").cast("bigint").alias("max_cluster"), F.max(F.when(F.col("_h") == 1, -F.col(r) - F.col(v))).alias("worst_excess"), F.avg(F.when(F.col("_h") == 1, -F.col(r) - F.col(v))).alias("mean_excess"))
    q = 1 - level
    xl = lambda k, pr: F.when(k == 0, 0.0).otherwise(k * F.ln(F.when(pr > 0, pr)))
    n, x = F.col("n").cast("double"), F.col("violations").cast("double")
    rate = x / n
    kup = -2 * (xl(n - x, F.lit(1 - q)) + xl(x, F.lit(q)) - xl(n - x, 1 - rate) - xl(x, rate))
    p01, p11 = safe_div("n01", F.col("n00") + F.col("n01")), safe_div("n11", F.col("n10") + F.col("n11"))
    pi = safe_div(F.col("n01") + F.col("n11"), F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11"))
    chris = -2 * (xl(F.col("n00") + F.col("n10"), 1 - pi) + xl(F.col("n01") + F.col("n11"), pi) - xl(F.col("n00"), 1 - p01) - xl(F.col("n01"), p01) - xl(F.col("n10"), 1 - p11) - xl(F.col("n11"), p11))
    rel = rate / q
    return (g.withColumn("rate", rate).withColumn("kupiec", F.greatest(kup, F.lit(0.0))).withColumn("kupiec_p", chi2_sf("kupiec", 1))
             .withColumn("christoffersen", F.greatest(chris, F.lit(0.0))).withColumn("christoffersen_p", chi2_sf("christoffersen", 1))
             .withColumn("light", F.when(rel <= 1.2, "green").when(rel <= 1.8, "yellow").otherwise("red")))


def signal_backtest(df: DataFrame, pred: str = "prediction", price: str = "close", cost: float = 0.001, p: Panel = STRATEGY) -> DataFrame:
    """Per-row strategy return: sign of the prediction change is held until the next signal; cost on position change."""
    d = df.withColumn("_s", F.signum(F.col(pred) - F.lag(pred).over(p.w)))
    d = d.withColumn("position", F.coalesce(F.last(F.when(F.col("_s") != 0, F.col("_s")), True).over(p.cum), F.lit(0.0)))
    prev = F.coalesce(F.lag("position").over(p.w), F.lit(0.0))
    d = d.withColumn("_prev", prev).withColumn("_ret", F.coalesce(ratio(price, F.lag(price).over(p.w)) - 1, F.lit(0.0)))
    return d.withColumn("r", F.col("_prev") * F.col("_ret") - cost * F.abs(F.col("position") - F.col("_prev"))).drop("_s", "_prev", "_ret")


def trade_summary(trades: DataFrame, keys: Sequence[str], pnl: str = "pnl") -> DataFrame:
    x = F.col(pnl)
    g, l = F.sum(F.when(x > 0, x).otherwise(0.0)), F.sum(F.when(x < 0, -x).otherwise(0.0))
    return trades.groupBy(*keys).agg(F.count(x).alias("n_trades"), F.avg((x > 0).cast("double")).alias("win_rate"), F.when(l == 0, F.when(g > 0, INF).otherwise(1.0)).otherwise(ratio(g, l)).alias("profit_factor"),
                                     F.avg(x).alias("mean_pnl"), F.sum(x).alias("total_pnl"), F.max(x).alias("best"), F.min(x).alias("worst"))


def walk_forward(df: DataFrame, train: int = 252, test: int = 63, r: str = "r", p: Panel = STRATEGY, rf: float = 0.02, periods: float = 252) -> DataFrame:
    """Metrics of consecutive test blocks after a training span."""
    d = df.withColumn("_rn", F.row_number().over(p.w)).where(F.col("_rn") > train).withColumn("block", F.floor((F.col("_rn") - train - 1) / test))
    return d.groupBy(*p.keys, "block").agg(*_aggs(F.col(r), rf, periods))
