"""Rolling statistics and feature blocks on daily bars."""
from __future__ import annotations

from pyspark.sql import functions as F

from tapeworks.operators import rolling as RO
from tapeworks.queries import query
from tapeworks.queries.common import BARS, MARKET, R, RS, rcols, rd
from tapeworks.queries.indicators import NB, full, run, win
from tapeworks.sources import adapters as A

MOM = ["mean", "std", "min", "max", "median", "q25", "q75", "skew", "kurt", "zscore", "position"]


def _mom(n):
    w = f"OVER w{n}"
    e = {"mean": f"avg(close) {w}", "std": f"stddev_samp(close) {w}", "min": f"min(close) {w}", "max": f"max(close) {w}", "median": f"median(close) {w}",
         "q25": f"quantile_cont(close,.25) {w}", "q75": f"quantile_cont(close,.75) {w}", "skew": f"skewness(close) {w}", "kurt": f"kurtosis(close) {w}",
         "zscore": f"(close-avg(close) {w})/nullif(stddev_samp(close) {w},0)", "position": f"(close-min(close) {w})/nullif(max(close) {w}-min(close) {w},0)"}
    return ", ".join(R(full(e[m], n), f"close_{n}_{m}") for m in MOM)


@query("roll_moments_block", f"WITH {NB} SELECT symbol, ts, {_mom(10)}, {_mom(20)} FROM nb {win(10, 20)}")
def _(s, d):
    return run(s, d, lambda b: RO.moments_block(b, "close", (10, 20)), [f"close_{n}_{m}" for n in (10, 20) for m in MOM])


@query("roll_lag_block", f"WITH {NB} SELECT symbol, ts, " + ", ".join(f"{R(f'lag(close,{k}) OVER s', f'close_lag_{k}')}, {R(f'close-lag(close,{k}) OVER s', f'close_diff_{k}')}, {R(f'(close-lag(close,{k}) OVER s)/nullif(lag(close,{k}) OVER s,0)', f'close_pct_{k}')}" for k in (1, 2, 3, 5, 10)) + f" FROM nb {win()}")
def _(s, d):
    return run(s, d, lambda b: RO.lag_block(b, ["close"]), [f"close_{t}_{k}" for k in (1, 2, 3, 5, 10) for t in ("lag", "diff", "pct")])


@query("roll_interaction_block", f"SELECT l_orderkey, l_linenumber, l_partkey, {R('l_quantity*l_discount','qd')}, {R('CASE WHEN abs(l_discount)>1e-8 THEN l_quantity/l_discount ELSE 0 END','q_over_d')}, {R('l_quantity*l_tax','qt')}, {R('l_discount*l_tax','dt',6)} FROM lineitem")
def _(s, d):
    li = A.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax")
    b = RO.interaction_block(li, ["l_quantity", "l_discount", "l_tax"])
    return b.select("l_orderkey", "l_linenumber", "l_partkey", rd("l_quantity_x_l_discount").alias("qd"), rd("l_quantity_div_l_discount").alias("q_over_d"), rd("l_quantity_x_l_tax").alias("qt"), rd("l_discount_x_l_tax", 6).alias("dt"))


@query("roll_polynomial_block", f"SELECT l_orderkey, l_linenumber, l_partkey, {R('l_quantity','p0')}, {R('l_quantity*l_quantity','p1')}, {R('l_tax','p2',6)}, {R('l_quantity*l_tax','p3',6)}, {R('l_tax*l_tax','p4',6)} FROM lineitem")
def _(s, d):
    from pyspark.ml.functions import vector_to_array
    li = A.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax")
    v = RO.polynomial_block(li, ["l_quantity", "l_tax"]).withColumn("a", vector_to_array("poly"))
    return v.select("l_orderkey", "l_linenumber", "l_partkey", *[rd(F.col("a")[i], 4 if i < 2 else 6).alias(f"p{i}") for i in range(5)])


@query("roll_series_summary", f"""WITH {NB}, x AS (SELECT symbol, close AS x, lag(close) OVER s AS p, lag(close,2) OVER s AS pp, lead(close) OVER s AS n FROM nb {win()})
 SELECT symbol, count(x) AS length, {R('sum(x*x)/1e6','abs_energy')}, {R('avg(abs(x-p))','mean_abs_change')}, {R('corr(x,p)','autocorr1',6)}, {R('avg(x*p*pp)/1e9','c3')}, CAST(sum(CASE WHEN x>p AND x>n THEN 1 WHEN p IS NOT NULL AND n IS NOT NULL THEN 0 END) AS BIGINT) AS n_peaks FROM x GROUP BY symbol""")
def _(s, d):
    r = RO.series_summary(A.daily_bars(s, d), "close")
    return r.select("symbol", "length", rd(F.col("abs_energy") / 1e6).alias("abs_energy"), rd("mean_abs_change").alias("mean_abs_change"), rd("autocorr1", 6).alias("autocorr1"), rd(F.col("c3") / 1e9).alias("c3"), "n_peaks")


@query("roll_volatility_block", f"""WITH {NB}, r AS (SELECT *, ln(close/lag(close) OVER s) AS r, ln(high/low)*ln(high/low) AS hl FROM nb {win()}), v AS (SELECT *, CASE WHEN rn>10 THEN stddev_samp(r) OVER w10*sqrt(252) END AS v FROM r {win(10)})
 SELECT symbol, ts, {R('v','vol_10',6)}, {R('CASE WHEN rn>=20 THEN stddev_samp(v) OVER w10 END','vol_of_vol_10',6)}, {R(full('sqrt(avg(hl) OVER w10/(4*ln(2))*252)',10),'parkinson_10',6)} FROM v {win(10)}""")
def _(s, d):
    return run(s, d, lambda b: RO.volatility_block(b, (10,)), ["vol_10", "vol_of_vol_10", "parkinson_10"], 6)


@query("roll_price_volatility_features", f"""WITH {NB} SELECT symbol, ts, {R('close/lag(close) OVER s-1','return_1')}, {R('close/lag(close,5) OVER s-1','return_5')}, {R('close/lag(close,10) OVER s-1','return_10')}, {R('high/low','hl_ratio')}, {R('close/open','oc_ratio')}, {R(full('(close-avg(close) OVER w20)/nullif(stddev_samp(close) OVER w20,0)',20),'price_z')} FROM nb {win(20)}""")
def _(s, d):
    return run(s, d, RO.price_volatility_features, ["return_1", "return_5", "return_10", "hl_ratio", "oc_ratio", "price_z"])


@query("roll_supervised_frame", f"""WITH {NB}, r AS (SELECT *, ln(close/lag(close) OVER s) AS r FROM nb {win()})
 SELECT symbol, ts, {R('coalesce(r,0)','close_logret')}, {R('coalesce(lag(close,1) OVER s,0)','close_lag1')}, {R('coalesce(lag(close,3) OVER s,0)','close_lag3')}, {R('avg(close) OVER w5','close_mean5')}, {R('coalesce(stddev_samp(close) OVER w10,0)','close_std10')}, {R('coalesce(sqrt(sum(r*r) OVER w5),0)','close_rv5')} FROM r {win(5, 10)}""")
def _(s, d):
    return run(s, d, lambda b: RO.supervised_frame(b, ["close"]), ["close_logret", "close_lag1", "close_lag3", "close_mean5", "close_std10", "close_rv5"])


@query("roll_percentile_rank", f"""WITH {NB}, l AS (SELECT symbol, ts, rn, close, list(close) OVER w30 AS l FROM nb {win(30)})
 SELECT symbol, ts, {R(full('(len(list_filter(l, lambda x: x < close)) + (len(list_filter(l, lambda x: x = close)) + 1)/2.0)/30.0',30),'pr',6)} FROM l""")
def _(s, d):
    b = A.daily_bars(s, d)
    return b.select("symbol", "ts", rd(RO.percentile_rank("close", 30), 6).alias("pr"))


@query("roll_named_op", f"WITH {NB} SELECT symbol, ts, {R(full('median(close) OVER w15',15),'median')}, {R(full('stddev_samp(volume) OVER w15',15),'std')}, {R(full('sum(volume) OVER w15',15),'sum')} FROM nb {win(15)}")
def _(s, d):
    b = A.daily_bars(s, d)
    return b.select("symbol", "ts", rd(RO.rolling("close", "median", 15)).alias("median"), rd(RO.rolling("volume", "std", 15)).alias("std"), rd(RO.rolling("volume", "sum", 15)).alias("sum"))


@query("robust_mean_std", f"""WITH q AS (SELECT event_type, quantile_cont(value,.1) AS lo, quantile_cont(value,.9) AS hi, quantile_cont(value,.25) AS q1, quantile_cont(value,.75) AS q3, median(value) AS med FROM events GROUP BY 1)
 SELECT event_type, {R('avg(CASE WHEN value BETWEEN lo AND hi THEN value END)','trimmed_mean')}, {R('max((q3-q1)/1.349)','iqr_std')}, {R('median(abs(value-med))*1.4826','mad_std')} FROM events JOIN q USING (event_type) GROUP BY 1""")
def _(s, d):
    return rcols(RO.trimmed_mean(A.table(s, d, "events"), "value", keys=["event_type"]), ["event_type"], ["trimmed_mean", "iqr_std", "mad_std"])


@query("signal_smooth_detrend_normalize", f"""WITH {NB}, f AS (SELECT symbol, regr_slope(close, rn-1) AS b, regr_intercept(close, rn-1) AS a, avg(close) AS m, stddev_pop(close) AS sd FROM nb GROUP BY symbol)
 SELECT symbol, ts, {R('close-a-b*(rn-1)','detrended')}, {R('avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)','smooth')}, {R('(close-m)/sd','normalized')} FROM nb JOIN f USING (symbol)""")
def _(s, d):
    b = RO.normalize_signal(RO.detrend(A.daily_bars(s, d), "close"), "close")
    return b.select("symbol", "ts", rd("detrended").alias("detrended"), rd(RO.smooth("close", 5)).alias("smooth"), rd("normalized").alias("normalized"))


@query("jump_and_stress", f"""WITH {NB}, r AS (SELECT *, close/lag(close) OVER s - 1 AS r FROM nb {win()})
 SELECT symbol, ts, CAST(coalesce(abs(r-avg(r) OVER w20)/nullif(stddev_samp(r) OVER w20,0) > 3 AND rn>20, false) AS INTEGER) AS jump,
 {R('CASE WHEN rn>20 THEN coalesce(avg(CASE WHEN r<0 THEN -r END) OVER w20,0)*avg(CASE WHEN r<0 THEN 1.0 WHEN r IS NOT NULL THEN 0.0 END) OVER w20 END','stress',6)} FROM r {win(20)}""")
def _(s, d):
    b = RO.market_stress(RO.jump_flag(A.daily_bars(s, d)))
    return b.select("symbol", "ts", "jump", rd("stress", 6).alias("stress"))


@query("return_history_array", f"""WITH {NB}, r AS (SELECT *, ln(close/lag(close) OVER s) AS r FROM nb {win()}), l AS (SELECT symbol, ts, rn, list(r) OVER w10 AS l FROM r {win(10)})
 SELECT symbol, ts, CASE WHEN rn>10 THEN {R('l[1]','x').split(' AS ')[0] if False else "floor(CAST(l[1] AS DOUBLE)*1000000.0::DOUBLE+0.5003::DOUBLE)/1000000.0::DOUBLE"} END AS oldest, CASE WHEN rn>10 THEN floor(CAST(l[10] AS DOUBLE)*1000000.0::DOUBLE+0.5003::DOUBLE)/1000000.0::DOUBLE END AS newest FROM l""")
def _(s, d):
    b = RO.return_history(A.daily_bars(s, d))
    return b.select("symbol", "ts", rd(F.col("history")[0], 6).alias("oldest"), rd(F.col("history")[9], 6).alias("newest"))
