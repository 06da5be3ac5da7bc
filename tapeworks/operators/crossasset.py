"""Cross-asset correlation, spread, beta, regime and graph operators.

Pairs come from an explicit list (see ``plans.pairs``); each row fans out to the pairs it
belongs to and every measure is an aggregate or a window over the aligned pair series.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.mathx import clip, ratio, safe_div
from tapeworks.plans.orderstats import average_ranks
from tapeworks.plans.pairs import align_pairs, pair_table
from tapeworks.plans.panel import Panel, islands, join_on
from tapeworks.session import ensure_checkpoint_dir

PANEL = Panel()
PAIR = Panel(("a", "b"), ("ts",))


def with_symbol_returns(df: DataFrame, c: str = "close", p: Panel = PANEL, out: str = "r") -> DataFrame:
    return df.withColumn(out, F.ln(F.col(c) / F.lag(c).over(p.w)))


def pair_correlation(df: DataFrame, pairs: DataFrame, c: str = "r", method: str = "pearson") -> DataFrame:
    """(a, b, n, corr); 0 when undefined. pearson, spearman (average ranks per symbol pair) or absdev."""
    al = align_pairs(df.where(F.col(c).isNotNull()), pairs, [c])
    x, y = f"x_{c}", f"y_{c}"
    if method == "spearman":
        al = average_ranks(average_ranks(al, x, "_rx", ["a", "b"]), y, "_ry", ["a", "b"])
        x, y = "_rx", "_ry"
    elif method == "absdev":
        m = al.groupBy("a", "b").agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
        al = join_on(al, m, ["a", "b"]).withColumn("_ax", F.abs(F.col(x) - F.col("_mx"))).withColumn("_ay", F.abs(F.col(y) - F.col("_my")))
        x, y = "_ax", "_ay"
    g = al.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("corr"))
    return g.withColumn("corr", F.coalesce(F.when(~F.isnan("corr"), F.col("corr")), F.lit(0.0)))


def rolling_kendall(df: DataFrame, pairs: DataFrame, c: str = "r", n: int = 24) -> DataFrame:
    """Kendall tau-a over a trailing window of n aligned rows (bounded work per row)."""
    al = align_pairs(df.where(F.col(c).isNotNull()), pairs, [c])
    l = F.collect_list(F.struct(F.col(f"x_{c}").alias("x"), F.col(f"y_{c}").alias("y"))).over(PAIR.trailing(n))
    d = al.withColumn("_l", l)
    conc = F.aggregate("_l", F.lit(0.0), lambda acc, u: acc + F.aggregate("_l", F.lit(0.0), lambda s, v: s + F.signum(u["x"] - v["x"]) * F.signum(u["y"] - v["y"])))
    return d.select("a", "b", "ts", F.when(F.size("_l") == n, conc / float(n * (n - 1))).alias("tau"))


def mutual_information(df: DataFrame, pairs: DataFrame, c: str = "r", bins: int = 10) -> DataFrame:
    """Binned mutual information (nats) of aligned pairs; equal-width bins per symbol."""
    s = df.where(F.col(c).isNotNull())
    mm = s.groupBy("symbol").agg(F.min(c).alias("_lo"), F.max(c).alias("_hi"))
    b = join_on(s, mm, ["symbol"]).withColumn("bin", F.least(F.floor(safe_div((F.col(c) - F.col("_lo")) * bins, F.col("_hi") - F.col("_lo"))), F.lit(bins - 1)))
    al = align_pairs(b.select("symbol", "ts", "bin"), pairs, ["bin"])
    return contingency_information(al, ["a", "b"], "x_bin", "y_bin")


def contingency_information(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Sum p ln(p / (px py)) from one count table; margins are windows over its few cells."""
    k = list(keys)
    cells = df.groupBy(*k, x, y).agg(F.count(F.lit(1)).alias("_n"))
    w = lambda *c: Window.partitionBy(*k, *c) if (k or c) else Window.partitionBy(F.lit(0))
    t = cells.select(*k, "_n", F.sum("_n").over(w()).alias("_t"), F.sum("_n").over(w(x)).alias("_px"), F.sum("_n").over(w(y)).alias("_py"))
    return t.groupBy(*k).agg(F.sum(F.col("_n") / F.col("_t") * F.ln(F.col("_n").cast("double") * F.col("_t") / (F.col("_px").cast("double") * F.col("_py")))).alias("mi"))


def rolling_correlation(df: DataFrame, pairs: DataFrame, windows: Sequence[int] = (24,), c: str = "r", minimum: int | None = None) -> DataFrame:
    al = align_pairs(df.where(F.col(c).isNotNull()), pairs, [c])
    cols = []
    for n in windows:
        w = PAIR.trailing(n)
        cols.append(F.when(F.count(F.lit(1)).over(w) >= (minimum or n), F.corr(f"x_{c}", f"y_{c}").over(w)).alias(f"corr_{n}"))
    return al.select("a", "b", "ts", *cols)


def lagged_correlation(df: DataFrame, pairs: DataFrame, lags: Sequence[int] = (1, 2, 3, 4, 5), c: str = "r") -> DataFrame:
    """(a, b, lag, corr): x lagged by k rows against y, all lags as columns of one window pass."""
    al = align_pairs(df.where(F.col(c).isNotNull()), pairs, [c])
    d = al.select("a", "b", f"y_{c}", *[F.lag(f"x_{c}", k).over(PAIR.w).alias(f"_l{k}") for k in lags])
    g = d.groupBy("a", "b").agg(*[F.corr(f"_l{k}", f"y_{c}").alias(f"c{k}") for k in lags])
    st = ", ".join(f"{k}, c{k}" for k in lags)
    return g.select("a", "b", F.expr(f"stack({len(lags)}, {st}) as (lag, corr)"))


def correlation_row(df: DataFrame, pairs: Sequence[tuple], focus: tuple, n: int = 24, c: str = "r") -> DataFrame:
    """One wide row: a column per pair plus mean/std/min/max of the focus pair's rolling correlation."""
    spark = df.sparkSession
    typ = df.schema["symbol"].dataType.simpleString()
    g = pair_correlation(df, pair_table(spark, pairs, typ), c).withColumn("_p", F.concat_ws("_", "a", "b"))
    wide = g.groupBy().pivot("_p", [f"{a}_{b}" for a, b in pairs]).agg(F.max("corr"))
    roll = rolling_correlation(df, pair_table(spark, [focus], typ), (n,), c).agg(F.avg(f"corr_{n}").alias("roll_mean"), F.stddev_samp(f"corr_{n}").alias("roll_std"), F.min(f"corr_{n}").alias("roll_min"), F.max(f"corr_{n}").alias("roll_max"))
    s = roll.select(F.struct("*").alias("s")).scalar()
    return wide.withColumn("_s", s).select(*wide.columns, "_s.*")


def regime_correlation(df: DataFrame, pairs: DataFrame, n: int = 20, c: str = "r") -> DataFrame:
    """Correlation split by whether x's trailing deviation is above its pair's median."""
    al = align_pairs(df.where(F.col(c).isNotNull()), pairs, [c])
    d = al.withColumn("_v", F.when(F.count(f"x_{c}").over(PAIR.trailing(n)) == n, F.stddev_samp(f"x_{c}").over(PAIR.trailing(n)))).where(F.col("_v").isNotNull())
    med = d.groupBy("a", "b").agg(F.percentile("_v", 0.5).alias("_m"))
    d = join_on(d, med, ["a", "b"]).withColumn("regime", F.when(F.col("_v") > F.col("_m"), "high").otherwise("low"))
    return d.groupBy("a", "b", "regime").agg(F.count(F.lit(1)).alias("n"), F.corr(f"x_{c}", f"y_{c}").alias("corr"))


def partial_correlation(df: DataFrame, symbols: Sequence, c: str = "r", ridge: float = 1e-6) -> DataFrame:
    """Partial correlations from the ridge-regularized precision matrix.

    Pairwise covariances are aggregated on executors; only the small |symbols|^2 matrix reaches the driver.
    """
    if len(symbols) > 200:
        raise ValueError("partial correlation inverts a dense matrix; request at most 200 symbols")
    spark = df.sparkSession
    typ = df.schema["symbol"].dataType.simpleString()
    at = {v: i for i, v in enumerate(symbols)}
    al = align_pairs(df.where(F.col(c).isNotNull()), pair_table(spark, [(x, y) for i, x in enumerate(symbols) for y in symbols[i + 1:]], typ), [c])
    cov = np.zeros((len(symbols), len(symbols)))
    for row in al.groupBy("a", "b").agg(F.covar_samp(f"x_{c}", f"y_{c}").alias("v")).collect():
        cov[at[row.a], at[row.b]] = cov[at[row.b], at[row.a]] = row.v or 0.0
    for row in df.where(F.col("symbol").isin(list(symbols))).groupBy("symbol").agg(F.var_samp(c).alias("v")).collect():
        cov[at[row.symbol], at[row.symbol]] = row.v or 0.0
    prec = np.linalg.inv(cov + ridge * np.eye(len(cov)))
    dg = np.sqrt(np.abs(np.diag(prec)))
    pc = -prec / np.outer(dg, dg)
    rows = [(symbols[i], symbols[j], float(pc[i, j])) for i in range(len(symbols)) for j in range(i + 1, len(symbols))]
    return spark.createDataFrame(rows, f"a {typ}, b {typ}, partial double")


def volatility_adjusted_correlation(df: DataFrame, pairs: DataFrame, n: int = 20, c: str = "r") -> DataFrame:
    """Correlation of returns divided by their own trailing deviation."""
    w = PANEL.trailing(n)
    d = df.withColumn("_z", F.when(F.count(c).over(w) == n, ratio(F.col(c), F.stddev_samp(c).over(w)))).select("symbol", "ts", "_z")
    return pair_correlation(d, pairs, "_z")


def edge_list(corr: DataFrame, transform: str = "abs", threshold: float = 0.3, top_k: int | None = None) -> DataFrame:
    """Both directions of each pair with weight, corr, abs_corr, sign; optionally the strongest k per source."""
    both = corr.select(F.col("a").alias("src"), F.col("b").alias("dst"), "corr").unionByName(corr.select(F.col("b").alias("src"), F.col("a").alias("dst"), "corr"))
    f = {"abs": F.abs("corr"), "squared": F.col("corr") ** 2, "tanh": F.tanh("corr")}[transform]
    e = both.withColumn("weight", f).withColumn("abs_corr", F.abs("corr")).withColumn("sign", F.signum("corr")).where(F.abs("weight") >= threshold)
    if top_k:
        w = Window.partitionBy("src").orderBy(F.desc(F.abs("weight")), "dst")
        e = e.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top_k).drop("_r")
    return e


def dynamic_edges(df: DataFrame, pairs: DataFrame, n: int = 24, threshold: float = 0.3, c: str = "r") -> DataFrame:
    """Edge list per timestamp from trailing-window correlation."""
    r = rolling_correlation(df, pairs, (n,), c).where(F.abs(f"corr_{n}") >= threshold)
    return r.select("ts", F.col("a").alias("src"), F.col("b").alias("dst"), F.col(f"corr_{n}").alias("corr"))


def spanning_tree(edges: DataFrame, src: str = "a", dst: str = "b", weight: str = "w") -> DataFrame:
    """Minimum spanning forest by Boruvka rounds: cheapest outgoing edge per component, merge, relabel.

    Each round is grouping and joins; component labels are checkpointed to cut lineage. At most
    log2(nodes) rounds run.
    """
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b"), F.col(weight).alias("w")).where("a <> b").checkpoint()
    lab = e.select(F.col("a").alias("node")).union(e.select("b")).distinct().withColumn("comp", F.col("node")).checkpoint()
    picked = None
    while True:
        la, lb = lab.select(F.col("node").alias("a"), F.col("comp").alias("ca")), lab.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
        live = e.join(la, "a").join(lb, "b").where("ca <> cb")
        out = live.select(F.col("ca").alias("comp"), F.col("cb").alias("other"), "w", "a", "b").unionByName(live.select(F.col("cb").alias("comp"), F.col("ca").alias("other"), "w", "a", "b"))
        best = out.groupBy("comp").agg(F.min(F.struct("w", F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q"), "other", "a", "b")).alias("m")).select("comp", "m.other", "m.w", "m.a", "m.b").checkpoint()
        if best.isEmpty():
            break
        new = best.select("a", "b", "w").distinct()
        picked = new if picked is None else picked.unionByName(new).checkpoint()
        # root = smaller end of each mutual choice; every other component points at its choice
        back = best.select(F.col("comp").alias("other"), F.col("other").alias("_o2"))
        par = best.select("comp", "other").join(back, "other", "left").select("comp", F.when((F.col("_o2") == F.col("comp")) & (F.col("comp") < F.col("other")), F.col("comp")).otherwise(F.col("other")).alias("parent")).checkpoint()
        while True:
            up = par.select(F.col("comp").alias("parent"), F.col("parent").alias("gp"))
            nxt = par.join(up, "parent", "left").select("comp", "parent", F.coalesce("gp", "parent").alias("gp")).checkpoint()
            done = nxt.where("parent <> gp").isEmpty()
            par = nxt.select("comp", F.col("gp").alias("parent"))
            if done:
                break
        lab = lab.join(par, "comp", "left").select("node", F.coalesce("parent", "comp").alias("comp")).checkpoint()
    return picked if picked is not None else e.limit(0)


def node_features(df: DataFrame, c: str = "r", volume: str = "volume", n: int = 10) -> DataFrame:
    """mean, std, skew, kurtosis, momentum (last n returns), volume mean and std per symbol."""
    w = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    d = df.withColumn("_k", F.row_number().over(w))
    return d.groupBy("symbol").agg(F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.skewness(c).alias("skew"), F.kurtosis(c).alias("kurt"),
                                   F.sum(F.when(F.col("_k") <= n, F.col(c))).alias("momentum"), F.avg(volume).alias("volume_mean"), F.stddev_samp(volume).alias("volume_std"))


def spread_measures(df: DataFrame, pairs: DataFrame, n: int = 24, c: str = "close") -> DataFrame:
    """log_spread, pct_spread, volatility, convergence (negative lag-1 autocorrelation of changes), momentum z over n rows."""
    al = align_pairs(df, pairs, [c])
    x, y = F.col(f"x_{c}"), F.col(f"y_{c}")
    d = al.withColumn("log_spread", F.ln(x / y)).withColumn("pct_spread", 100 * ratio(x - y, y))
    w = PAIR.trailing(n)
    ok = F.count("log_spread").over(w) == n
    d = d.withColumn("_p", F.lag("log_spread").over(PAIR.w))
    d = d.withColumn("volatility", F.when(ok, F.stddev_pop("log_spread").over(w))).withColumn("convergence", F.when(ok, -F.corr("log_spread", "_p").over(w)))
    z = safe_div(F.col("log_spread") - F.avg("log_spread").over(w), F.stddev_pop("log_spread").over(w))
    return d.withColumn("momentum", F.when(ok, z)).drop("_p", f"x_{c}", f"y_{c}")


def latest_wide(df: DataFrame, pairs: Sequence[tuple], cols: Sequence[str], ts: str = "ts") -> DataFrame:
    """Latest value of each measure per pair pivoted to one row."""
    g = df.groupBy("a", "b").agg(*[F.max_by(c, ts).alias(c) for c in cols]).withColumn("_p", F.concat_ws("_", "a", "b"))
    return g.groupBy().pivot("_p", [f"{a}_{b}" for a, b in pairs]).agg(*[F.max(c).alias(c) for c in cols])


def beta_measures(df: DataFrame, market: str, n: int = 60, fast: int = 5, slow: int = 20, c: str = "close", p: Panel = PANEL) -> DataFrame:
    """Rolling beta on log returns, relative strength (1+ra)/(1+rm) over n rows and momentum divergence vs a market series joined by time.

    The market leg is a filtered copy of the same table joined on ts only.
    """
    d = df.select(*p.keys, "ts", F.ln(F.col(c) / F.lag(c).over(p.w)).alias("r"), (ratio(c, F.lag(c, n).over(p.w)) - 1).alias("_ra"),
                  (F.avg(c).over(p.trailing(fast)) / F.avg(c).over(p.trailing(slow)) - 1).alias("_mo"))
    m = d.where(F.col(p.keys[0]) == market).select("ts", F.col("r").alias("_rm1"), F.col("_ra").alias("_rm"), F.col("_mo").alias("_mm"))
    j = d.join(m, "ts").where(F.col("r").isNotNull() & F.col("_rm1").isNotNull())
    w = p.trailing(n)
    ok = F.count("r").over(w) == n
    j = j.withColumn("beta", F.when(ok, safe_div(F.covar_pop("r", "_rm1").over(w), F.var_pop("_rm1").over(w))))
    return j.withColumn("relative_strength", ratio(1 + F.col("_ra"), 1 + F.col("_rm"))).withColumn("divergence", F.col("_mo") - F.col("_mm")).select(*p.keys, "ts", "beta", "relative_strength", "divergence")


def trend_regime(df: DataFrame, n: int = 24, weak: float = 0.02, strong: float = 0.05, c: str = "close", p: Panel = PANEL) -> DataFrame:
    """-2..2 from window return and slope, with R2, duration in rows and acceleration of slope."""
    w = p.trailing(n)
    d = df.withColumn("_i", F.row_number().over(p.w).cast("double")).withColumn("_first", F.lag(c, n - 1).over(p.w))
    d = d.withColumn("_ret", ratio(c, "_first") - 1).withColumn("slope", F.when(F.count(c).over(w) == n, F.regr_slope(c, "_i").over(w) * n / F.col("_first"))).withColumn("r2", F.when(F.count(c).over(w) == n, F.regr_r2(c, "_i").over(w)))
    r, s = F.col("_ret"), F.col("slope")
    reg = F.when(r.isNull(), 0).when((r > strong) & (s > 0), 2).when((r > weak) & (s > 0), 1).when((r < -strong) & (s < 0), -2).when((r < -weak) & (s < 0), -1).otherwise(0)
    d = d.withColumn("trend", reg)
    d = islands(d, p, F.col("trend"), "_isl")
    d = d.withColumn("duration", F.row_number().over(Window.partitionBy(*p.keys, "_isl").orderBy(*p.order))).withColumn("acceleration", F.col("slope") - F.lag("slope", n // 2).over(p.w))
    return d.drop("_i", "_first", "_isl").withColumnRenamed("_ret", "window_return")


def market_phase(df: DataFrame, trend: str = "trend", vol: str = "regime", volume_z: str = "volume_z") -> DataFrame:
    """accumulation, markup, distribution, markdown or transition from three labels."""
    t, v, z = F.col(trend), F.col(vol), F.col(volume_z)
    ph = F.when((t > 0) & (v <= 2), "markup").when((t < 0) & (v >= 1), "markdown").when((t == 0) & (z > 0.5), F.when(v >= 2, "distribution").otherwise("accumulation")).otherwise("transition")
    return df.withColumn("phase", ph)


def cross_market(spot: DataFrame, futures: DataFrame, n: int = 24, minimum: int = 12, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Spot/futures join: basis, its z-score, rolling price and volume correlation, breakdown flag."""
    k = list(keys)
    j = join_on(spot.select(*k, "ts", F.col("close").alias("spot"), F.col("volume").alias("_vs")), futures.select(*k, "ts", F.col("close").alias("future"), F.col("volume").alias("_vf")), [*k, "ts"])
    p = Panel(tuple(k), ("ts",))
    w = p.trailing(n)
    j = j.withColumn("basis", ratio(F.col("future") - F.col("spot"), F.col("spot")))
    ok = F.count("basis").over(w) >= minimum
    j = j.withColumn("basis_z", F.when(ok, safe_div(F.col("basis") - F.avg("basis").over(w), F.stddev_samp("basis").over(w)))).withColumn("price_corr", F.when(ok, F.corr("spot", "future").over(w))).withColumn("volume_corr", F.when(ok, F.corr("_vs", "_vf").over(w)))
    return j.withColumn("breakdown", F.coalesce(F.col("price_corr") < 0.5, F.lit(False)).cast("int")).drop("_vs", "_vf")


def futures_block(df: DataFrame, p: Panel = PANEL) -> DataFrame:
    """Funding (now, lag 1, 24-row mean/std), open-interest change, liquidation ratio, premium and OI-weighted funding."""
    w = p.trailing(24)
    oi = F.col("open_interest")
    return df.select(*p.keys, *p.order, F.col("funding_rate").alias("funding"), F.lag("funding_rate").over(p.w).alias("funding_lag"), F.avg("funding_rate").over(w).alias("funding_mean"), F.stddev_samp("funding_rate").over(w).alias("funding_std"),
                     ratio(oi - F.lag(oi).over(p.w), F.lag(oi).over(p.w)).alias("oi_change"), safe_div(F.col("liquidations_long") - F.col("liquidations_short"), F.col("liquidations_long") + F.col("liquidations_short")).alias("liq_imbalance"),
                     ratio(F.col("mark_price") - F.col("index_price"), F.col("index_price")).alias("premium"), safe_div(F.sum(F.col("funding_rate") * oi).over(w), F.sum(oi).over(w)).alias("funding_oi_weighted"))
