"""Realized, range, regime and implied volatility."""
from __future__ import annotations

from pyspark.sql import functions as F

from tapeworks.operators import volatility as V
from tapeworks.plans.panel import Panel
from tapeworks.queries import query
from tapeworks.queries.common import BARS, HBARS, MARKET, R, RS, TICKS, rcols, rd
from tapeworks.sources import adapters as A

MR = MARKET + """, mr AS (SELECT *, ln(close/lag(close) OVER s) AS r, row_number() OVER s AS rn FROM market WINDOW s AS (PARTITION BY symbol ORDER BY ts))"""
S = "WINDOW s AS (PARTITION BY symbol ORDER BY ts)"
MU = "pow(pow(2,2.0/3)*1.0/1.0, -3)"


def tr(n):
    return f"(PARTITION BY symbol ORDER BY ts ROWS {n - 1} PRECEDING)"


import math
_MU3 = (2 ** (2 / 3) * math.gamma(7 / 6) / math.gamma(1 / 2)) ** -3

RM = f"""a AS (SELECT *, abs(r) AS a0, abs(lag(r) OVER s) AS a1, abs(lag(r,2) OVER s) AS a2 FROM mr {S}),
 g AS (SELECT symbol, count(r) AS n, sum(r*r) AS rv, pi()/2*sum(a0*a1) AS bipower, count(r)*{_MU3!r}*sum(pow(a0,4.0/3)*pow(a1,4.0/3)*pow(a2,4.0/3)) AS tripower FROM a GROUP BY symbol),
 j AS (SELECT *, (1-bipower/rv)/sqrt((pi()*pi()/4+pi()-5)/n*greatest(1, tripower/(bipower*bipower))) AS jump_z FROM g)"""


@query("vol_realized_bipower_jump", f"WITH {MR}, {RM} SELECT symbol, n, {RS(['rv', 'bipower', 'jump_z'])}, {R('tripower', 'tripower', 2)}, {R('sqrt(rv)', 'vol')}, {R('sqrt(rv/n*252)', 'vol_annual')}, CAST(abs(jump_z) > 1.959963984540054 AS INTEGER) AS jump, {R('greatest(rv-bipower,0)', 'jump_size')} FROM j")
def _(s, d):
    g = V.realized_measures(A.market_daily(s, d))
    return g.select("symbol", "n", *[rd(c).alias(c) for c in ("rv", "bipower", "jump_z", "vol", "vol_annual", "jump_size")], rd("tripower", 2).alias("tripower"), "jump")


HR = HBARS + """, hr AS (SELECT *, ln(close/lag(close) OVER s) AS r FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY ts))"""


@query("vol_intraday_seasonality", f"WITH {HR} SELECT symbol, CAST(hour(ts) AS INTEGER) AS hour, {R('sqrt(sum(r*r))', 'vol')}, count(r) AS n FROM hr GROUP BY ALL")
def _(s, d):
    return rcols(V.intraday_seasonality(A.hourly_bars(s, d)), ["symbol", "hour", "n"], ["vol"], infinite=True)


@query("vol_signature", " UNION ALL ".join(f"""(WITH {TICKS}, b AS (SELECT symbol, time_bucket(INTERVAL {h} HOUR, ts, TIMESTAMP '1970-01-01') AS ts, arg_max(price, row(ts, trade_id)) AS close FROM ticks GROUP BY ALL),
 r AS (SELECT symbol, ln(close/lag(close) OVER s) AS r FROM b {S}) SELECT symbol, {R('sum(r*r)', 'rv')}, count(r) AS n, '{h} hours' AS freq FROM r GROUP BY symbol)""" for h in (2, 6, 12)))
def _(s, d):
    t = A.ticks(s, d).withColumn("close", F.col("price"))
    return rcols(V.signature(t, ["2 hours", "6 hours", "12 hours"], tie=("trade_id",)), ["symbol", "n", "freq"], ["rv"], infinite=True)


def _parzen(h, H=10):
    x = h / H
    return 1 - 6 * x ** 2 + 6 * x ** 3 if h <= H // 2 else 2 * (1 - x) ** 3


@query("vol_realized_kernel", f"WITH {MR}, l AS (SELECT symbol, r, " + ", ".join(f"lag(r,{h}) OVER s AS l{h}" for h in range(1, 11)) + f" FROM mr {S}) SELECT symbol, {R('avg(r*r)', 'variance', 6)}, {R('avg(r*r)' + ''.join(f'+2*{_parzen(h)!r}*avg(r*l{h})' for h in range(1, 11)), 'kernel', 6)} FROM l GROUP BY symbol")
def _(s, d):
    return rcols(V.realized_kernel(A.market_daily(s, d)), ["symbol"], ["variance", "kernel"], 6)


@query("vol_two_scale", f"""WITH {MR}, f AS (SELECT symbol, sum(r*r) AS rf, count(r) AS nf FROM mr GROUP BY 1), b AS (SELECT symbol, time_bucket(INTERVAL 5 DAY, ts, TIMESTAMP '1970-01-01') AS ts, arg_max(close, ts) AS close FROM market GROUP BY ALL),
 sr AS (SELECT symbol, ln(close/lag(close) OVER s) AS r FROM b {S}), g AS (SELECT symbol, sum(r*r) AS rs, count(r) AS ns FROM sr GROUP BY 1) SELECT symbol, {R('rf', 'rv_fast')}, {R('rs', 'rv_slow')}, {R('greatest(rf-nf/ns*rs,0)', 'tsrv')} FROM f JOIN g USING (symbol)""")
def _(s, d):
    return rcols(V.two_scale(A.market_daily(s, d), "5 days"), ["symbol"], ["rv_fast", "rv_slow", "tsrv"])


@query("vol_estimator_consensus", f"""WITH {MR}, {RM}, e AS (SELECT symbol, sqrt(rv) AS v FROM j UNION ALL SELECT symbol, sqrt(bipower) FROM j UNION ALL SELECT symbol, sqrt(greatest(rv-bipower,0)) FROM j)
 SELECT symbol, {R('avg(v)', 'mean')}, {R('median(v)', 'median')}, {R('sum(v)-max(v)-min(v)', 'trimmed')}, {R('max(v)-min(v)', 'spread')} FROM e GROUP BY symbol""")
def _(s, d):
    g = V.realized_measures(A.market_daily(s, d))
    e = g.select("symbol", F.explode(F.array(F.sqrt("rv"), F.sqrt("bipower"), F.sqrt("jump_size"))).alias("value"))
    return rcols(V.consensus(e, ["symbol"]), ["symbol"], ["mean", "median", "trimmed", "spread"])


@query("vol_range_estimators", f"""WITH {BARS}, x AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn, pow(ln(high/low),2) AS hl, pow(ln(close/open),2) AS co FROM bars)
 SELECT symbol, ts, {R('CASE WHEN rn>=20 THEN sqrt(avg(hl) OVER w/(4*ln(2))) END', 'parkinson', 6)}, {R('CASE WHEN rn>=20 THEN sqrt(greatest(0.5*avg(hl) OVER w-(2*ln(2)-1)*avg(co) OVER w,0)) END', 'garman_klass', 4)} FROM x WINDOW w AS {tr(20)}""")
def _(s, d):
    b = V.range_volatility(A.daily_bars(s, d))
    return b.select("symbol", "ts", rd("parkinson", 6).alias("parkinson"), rd("garman_klass", 4).alias("garman_klass"))


@query("vol_garch_panel")
def _(s, d):
    g = V.fit_garch(A.market_daily(s, d))
    return g.select("symbol", "family", "n", rd("alpha").alias("alpha"), rd("beta").alias("beta"), rd("gamma").alias("gamma"), rd("aic", 2).alias("aic"), rd("var_horizon").alias("var_horizon"))


HAR = f"hr AS (SELECT symbol, ts, abs(r) AS rv FROM mr WHERE r IS NOT NULL), hf AS (SELECT *, row_number() OVER s AS k, avg(rv) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING) AS h1, avg(rv) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS h5, avg(rv) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 22 PRECEDING AND 1 PRECEDING) AS h22 FROM hr {S})"


@query("vol_har_features", f"WITH {MR}, {HAR} SELECT symbol, ts, {R('h1', 'har_1', 6)}, {R('CASE WHEN k>5 THEN h5 END', 'har_5', 6)}, {R('CASE WHEN k>22 THEN h22 END', 'har_22', 6)} FROM hf")
def _(s, d):
    r = V.with_log_returns(A.market_daily(s, d)).where("r is not null").withColumn("rv", F.abs("r"))
    return rcols(V.har_features(r), ["symbol", "ts"], ["har_1", "har_5", "har_22"], 6)


@query("vol_har_model")
def _(s, d):
    r = V.with_log_returns(A.market_daily(s, d)).where("r is not null").withColumn("rv", F.abs("r"))
    m, scored = V.fit_har(r)
    return scored.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), rd(F.avg((F.col("rv") - F.col("prediction")) ** 2)).alias("mse"))


@query("vol_feature_matrix", f"""WITH {MR}, v AS (SELECT *, CASE WHEN rn>1 THEN sqrt(sum(r*r) OVER w) END AS rv, exp(r)-1 AS sr FROM mr WINDOW w AS {tr(20)})
 SELECT symbol, ts, {R('rv', 'rv', 6)}, {R('lag(rv) OVER s', 'rv_lag_1', 6)}, {R('avg(rv) OVER w5', 'rv_mean_5', 6)}, {R('lead(rv) OVER s', 'target', 6)},
 {R('CASE WHEN rn>20 THEN coalesce(avg(CASE WHEN sr<0 THEN -sr END) OVER w20,0)*avg(CASE WHEN sr<0 THEN 1.0 WHEN sr IS NOT NULL THEN 0.0 END) OVER w20 END', 'stress', 4)}, CAST(isodow(ts)-1 AS INTEGER) AS dow FROM v {S}, w5 AS {tr(5)}, w20 AS {tr(20)}""")
def _(s, d):
    m = V.volatility_matrix(A.market_daily(s, d))
    return m.select("symbol", "ts", *[rd(c, 6).alias(c) for c in ("rv", "rv_lag_1", "rv_mean_5", "target")], rd("stress").alias("stress"), "dow")


@query("vol_forest_ensemble")
def _(s, d):
    m = V.volatility_matrix(A.market_daily(s, d)).dropna(subset=["rv_lag_5", "rv_mean_22", "stress", "target"])
    cut = m.select(F.percentile_approx(F.unix_timestamp("ts"), 0.8)).scalar()
    m = m.withColumn("is_train", F.unix_timestamp("ts") <= cut)
    f = ["rv", "rv_lag_1", "rv_lag_5", "rv_mean_5", "rv_mean_22", "stress"]
    model = V.fit_volatility_forest(m.where("is_train"), f, "target", trees=10, depth=4)
    val = model.transform(m.where("not is_train"))
    long = val.select(F.lit("forest").alias("model"), F.col("target").alias("y"), "prediction").unionByName(val.select(F.lit("naive").alias("model"), F.col("target").alias("y"), F.col("rv").alias("prediction")))
    return rcols(V.ensemble_weights(long), ["model"], ["mse", "r2", "weight"], 3)


@query("vol_cone", f"""WITH {MR}, v AS (""" + " UNION ALL ".join(f"SELECT symbol, ts, {h} AS horizon, CASE WHEN rn>{h} THEN stddev_samp(r) OVER {tr(h)}*sqrt(252) END AS vol FROM mr" for h in (5, 22, 63, 126, 252)) + f"""),
 c AS (SELECT symbol, horizon, arg_max(vol, ts) AS cur FROM v WHERE vol IS NOT NULL GROUP BY ALL) SELECT symbol, horizon, {R('min(vol)', 'min', 5)}, {R('quantile_cont(vol,.1)', 'p10', 5)}, {R('median(vol)', 'p50', 5)}, {R('quantile_cont(vol,.9)', 'p90', 5)}, {R('max(vol)', 'max', 5)}, {R('max(cur)', 'current', 5)},
 {R('100*avg(CASE WHEN vol<cur THEN 1.0 ELSE 0.0 END)', 'rank')}, CASE WHEN 100*avg(CASE WHEN vol<cur THEN 1.0 ELSE 0.0 END)<20 THEN 'low' WHEN 100*avg(CASE WHEN vol<cur THEN 1.0 ELSE 0.0 END)<80 THEN 'normal' ELSE 'high' END AS regime FROM v JOIN c USING (symbol, horizon) WHERE vol IS NOT NULL GROUP BY ALL""")
def _(s, d):
    c = V.volatility_cone(A.market_daily(s, d))
    return c.select("symbol", "horizon", *[rd(x, 5).alias(x) for x in ("min", "p10", "p50", "p90", "max", "current")], rd("rank").alias("rank"), "regime")


@query("vol_half_life_clustering", f"WITH {MR}, l AS (SELECT symbol, abs(r) AS a, lag(abs(r)) OVER s AS la FROM mr {S}), g AS (SELECT symbol, regr_slope(a, la) AS beta, corr(a*a, la*la) AS cl FROM l GROUP BY 1) SELECT symbol, {R('beta', 'beta', 6)}, {R('cl', 'clustering', 6)}, {R('CASE WHEN beta>0 AND beta<1 THEN ln(0.5)/ln(beta) END', 'half_life', 4)} FROM g")
def _(s, d):
    g = V.persistence(A.market_daily(s, d))
    return g.select("symbol", rd("beta", 6).alias("beta"), rd("clustering", 6).alias("clustering"), rd("half_life", 4).alias("half_life"))


@query("vol_regime", f"""WITH {MR}, v AS (SELECT symbol, ts, CASE WHEN rn>24 THEN sqrt(sum(r*r) OVER {tr(24)}) END AS v FROM mr), g AS (SELECT *, CASE WHEN v IS NULL THEN 1 WHEN v<1.0 THEN 0 WHEN v<1.5 THEN 1 WHEN v<2 THEN 2 ELSE 3 END AS regime FROM v),
 c AS (SELECT *, CASE WHEN regime <> lag(regime) OVER s THEN 1 ELSE 0 END AS ch FROM g {S}), i AS (SELECT *, sum(ch) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS isl FROM c)
 SELECT symbol, ts, {R('v', 'realized', 6)}, CAST(regime AS INTEGER) AS regime, CAST(row_number() OVER (PARTITION BY symbol, isl ORDER BY ts) AS INTEGER) AS duration, {R(f'1-sum(ch) OVER {tr(24)}/24.0', 'stability', 6)} FROM i""")
def _(s, d):
    g = V.volatility_regime(A.market_daily(s, d), 24, (1.0, 1.5, 2.0))
    return g.select("symbol", "ts", rd("realized", 6).alias("realized"), "regime", "duration", rd("stability", 6).alias("stability"))


OPT = f"""und AS (SELECT l_suppkey AS symbol, sum(l_extendedprice)/sum(l_quantity) AS u FROM lineitem GROUP BY 1),
 g AS (SELECT l_suppkey AS symbol, l_returnflag, l_linenumber, 0.2+4*avg(l_discount) AS sig FROM lineitem GROUP BY ALL),
 o AS (SELECT symbol, CASE l_returnflag WHEN 'A' THEN 30 WHEN 'N' THEN 60 ELSE 90 END AS days, CASE l_returnflag WHEN 'A' THEN 30 WHEN 'N' THEN 60 ELSE 90 END/365.0::DOUBLE AS t, u, u*(0.6+0.1*l_linenumber) AS k, 0.6+0.1*l_linenumber AS m, sig FROM g JOIN und USING (symbol)),
 ch AS (SELECT *, greatest(u-k,0)+0.4*u*sig*sqrt(t)*exp(-8*pow(m-1,2)) AS c FROM o), cp AS (SELECT *, c-u+k AS p FROM ch)"""
MFV = f"""f AS (SELECT symbol, days, median(k+c-p) AS fw, count(*) AS n FROM cp GROUP BY ALL), x AS (SELECT * FROM cp JOIN f USING (symbol, days)), am AS (SELECT symbol, days, arg_min(k, row(abs(k-fw), k)) AS atm FROM x GROUP BY ALL),
 y AS (SELECT x.*, atm, lag(k) OVER w AS lo, lead(k) OVER w AS hi FROM x JOIN am USING (symbol, days) WINDOW w AS (PARTITION BY symbol, days ORDER BY k)),
 z AS (SELECT *, CASE WHEN lo IS NULL AND hi IS NULL THEN k*0.1 WHEN lo IS NULL THEN hi-k WHEN hi IS NULL THEN k-lo ELSE (hi-lo)/2 END AS dk, CASE WHEN k<atm THEN p ELSE c END AS px FROM y),
 mf AS (SELECT symbol, days, sqrt(greatest(sum(2/t*dk/(k*k)*px)-pow(max(fw)/max(atm)-1,2)/max(t),0)) AS vol, max(fw) AS forward FROM z WHERE n>=3 GROUP BY ALL)"""


@query("vol_model_free_index", f"WITH {OPT}, {MFV} SELECT symbol, CAST(days AS INTEGER) AS days, {R('vol', 'vol', 5)}, {R('forward', 'forward', 3)} FROM mf")
def _(s, d):
    m = V.model_free_variance(A.option_quotes(s, d), ("symbol", "days"))
    return m.select("symbol", F.col("days").cast("int"), rd("vol", 5).alias("vol"), rd("forward", 3).alias("forward"))


@query("vol_tenor_interpolation", f"""WITH {OPT}, {MFV}, p AS (SELECT symbol, max(CASE WHEN days=30 THEN vol END) AS a, max(CASE WHEN days=60 THEN vol END) AS b, max(CASE WHEN days=90 THEN vol END) AS c FROM mf GROUP BY 1)
 SELECT symbol, x AS days, {R('CASE x WHEN 15 THEN a WHEN 45 THEN a+(b-a)*0.5 WHEN 70 THEN b+(c-b)/3 ELSE c END', 'vol', 5)} FROM p, (SELECT unnest([15,45,70,120])::DOUBLE AS x)""")
def _(s, d):
    m = V.model_free_variance(A.option_quotes(s, d), ("symbol", "days"))
    return rcols(V.interpolate_tenor(m, [15, 45, 70, 120]), ["symbol", "days"], ["vol"], 5)


@query("vol_option_chain_iv")
def _(s, d):
    q = V.enrich_chain(A.option_quotes(s, d))
    return q.select("symbol", "days", "option_type", rd("strike", 2).alias("strike"), *[rd(c, 4).alias(c) for c in ("iv", "bid_iv", "ask_iv", "delta", "vega")])


@query("vol_smile_metrics", f"""WITH {OPT}, e AS (SELECT symbol, days, ln(m) AS x, sig AS y FROM cp UNION ALL SELECT symbol, days, ln(m), sig FROM cp), s AS (SELECT symbol, days, count(*) AS n, sum(x) AS s1, sum(x*x) AS s2, sum(x*x*x) AS s3, sum(x*x*x*x) AS s4, sum(y) AS t0, sum(x*y) AS t1, sum(x*x*y) AS t2 FROM e GROUP BY ALL),
 q AS (SELECT *, n*(s2*s4-s3*s3)-s1*(s1*s4-s3*s2)+s2*(s1*s3-s2*s2) AS det FROM s)
 SELECT symbol, CAST(days AS INTEGER) AS days, n, {R('(t0*(s2*s4-s3*s3)-s1*(t1*s4-s3*t2)+s2*(t1*s3-s2*t2))/det', 'level')}, {R('(n*(t1*s4-s3*t2)-t0*(s1*s4-s3*s2)+s2*(s1*t2-t1*s2))/det', 'skew')}, {R('2*(n*(s2*t2-t1*s3)-s1*(s1*t2-t1*s2)+t0*(s1*s3-s2*s2))/det', 'convexity')} FROM q""")
def _(s, d):
    m = V.smile_metrics(A.option_quotes(s, d), ("symbol", "days"))
    return m.select("symbol", F.col("days").cast("int"), "n", *[rd(c).alias(c) for c in ("level", "skew", "convexity")])


@query("vol_quote_quality", f"WITH {OPT} SELECT symbol, CAST(days AS INTEGER) AS days, {R('avg(sig)', 'call_vol')}, {R('avg(sig)', 'put_vol')}, {R('0.04', 'rel_spread')}, CAST(2*count(*) AS BIGINT) AS n FROM cp WHERE p > 1e-9 GROUP BY ALL")
def _(s, d):
    m = V.quote_quality(A.option_quotes(s, d), ("symbol", "days"))
    return m.select("symbol", F.col("days").cast("int"), *[rd(c).alias(c) for c in ("call_vol", "put_vol", "rel_spread")], "n")


@query("vol_history_rank", f"WITH {MR}, l AS (SELECT symbol, ts, close, list(close) OVER {tr(30)} AS l FROM mr) SELECT symbol, ts, {R('100.0*len(list_filter(l, lambda x: x<close))/len(l)', 'rank_30')} FROM l")
def _(s, d):
    return rcols(V.history_rank(A.market_daily(s, d), "close", {"rank_30": 30}), ["symbol", "ts"], ["rank_30"])
