"""Technical indicators on daily supplier bars."""
from __future__ import annotations

from pyspark.sql import functions as F

from tapeworks.operators import indicators as I
from tapeworks.plans.panel import Panel
from tapeworks.queries import query
from tapeworks.queries.common import BARS, R, RS, ema_sql, rcols, rd
from tapeworks.sources import adapters as A

NB = BARS + """, nb AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM bars)"""
W = "WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), s AS (PARTITION BY symbol ORDER BY ts)"


def win(*ns):
    return "WINDOW s AS (PARTITION BY symbol ORDER BY ts), w AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)" + "".join(
        f", w{n} AS (PARTITION BY symbol ORDER BY ts ROWS {n - 1} PRECEDING)" for n in ns)


def full(expr, n, rn="rn"):
    return f"CASE WHEN {rn} >= {n} THEN {expr} END"


def run(s, d, fn, cols, dp=4, keep=("symbol", "ts")):
    return rcols(fn(A.daily_bars(s, d)), list(keep), cols, dp)


WMA_SQL = "(" + "+".join(f"lag(close,{10 - k}) OVER s*{k}" if k < 10 else "close*10" for k in range(1, 11)) + ")/55.0"


@query("ind_sma_wma", f"WITH {NB} SELECT symbol, ts, {R(full('avg(close) OVER w5', 5), 'sma_5')}, {R(full('avg(close) OVER w20', 20), 'sma_20')}, {R(WMA_SQL, 'wma_10')} FROM nb {win(5, 20)}")
def _(s, d):
    return run(s, d, lambda b: I.wma(I.sma(I.sma(b, 5), 20), 10), ["sma_5", "sma_20", "wma_10"])


@query("ind_ema", f"WITH {NB} SELECT symbol, ts, {R(ema_sql('close', 12), 'ema_12')}, {R('pow(0.9, rn) * sum(close*pow(0.9,-rn)) OVER w / (pow(0.9, rn) * sum(pow(0.9,-rn)) OVER w)', 'ema_adj')} FROM nb {win()}")
def _(s, d):
    return run(s, d, lambda b: I.ema(I.ema(b, 12), 19, out="ema_adj", adjust=True), ["ema_12", "ema_adj"])


RSI_CTE = "dd AS (SELECT *, close - lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS d FROM nb)"


def rsi_sql(n, g="greatest(d,0)", l="greatest(-d,0)"):
    a, b = f"avg({g}) OVER w{n}", f"avg({l}) OVER w{n}"
    return f"CASE WHEN rn > {n} THEN CASE WHEN {a}=0 AND {b}=0 THEN 50 WHEN {b}=0 THEN 100 ELSE 100-100/(1+{a}/nullif({b},0)) END END"


@query("ind_rsi", f"WITH {NB}, {RSI_CTE} SELECT symbol, ts, {R(rsi_sql(14), 'rsi_14')} FROM dd {win(14)}")
def _(s, d):
    return run(s, d, lambda b: I.rsi(b, 14), ["rsi_14"])


@query("ind_rsi_ewm", f"WITH {NB}, {RSI_CTE}, e AS (SELECT symbol, ts, rn, {ema_sql('greatest(d,0)', 14, 1)} AS g, {ema_sql('greatest(-d,0)', 14, 1)} AS l FROM dd {win()}) SELECT symbol, ts, {R('CASE WHEN rn > 1 THEN CASE WHEN l <= 1e-300 THEN 100 ELSE 100-100/(1+g/nullif(l,0)) END END', 'rsi_ewm_14')} FROM e")
def _(s, d):
    return run(s, d, lambda b: I.rsi_ewm(b, 14), ["rsi_ewm_14"])


@query("ind_macd", f"WITH {NB}, m AS (SELECT symbol, ts, rn, {ema_sql('close', 12)} - {ema_sql('close', 26)} AS macd FROM nb {win()}), g AS (SELECT *, {ema_sql('macd', 9)} AS macd_signal FROM m {win()}) SELECT symbol, ts, {RS(['macd', 'macd_signal'])}, {R('macd-macd_signal', 'macd_hist')} FROM g")
def _(s, d):
    return run(s, d, I.macd, ["macd", "macd_signal", "macd_hist"])


@query("ind_bollinger", f"WITH {NB}, m AS (SELECT symbol, ts, close, {full('avg(close) OVER w20', 20)} AS m, stddev_pop(close) OVER w20 AS sd FROM nb {win(20)}) SELECT symbol, ts, {R('m', 'bb_mid')}, {R('m+2*sd', 'bb_upper')}, {R('m-2*sd', 'bb_lower')}, {R('(m+2*sd-(m-2*sd))/nullif(m,0)', 'bb_width')}, {R('(close-(m-2*sd))/nullif(4*sd,0)', 'bb_pct')} FROM m")
def _(s, d):
    return run(s, d, I.bollinger, ["bb_mid", "bb_upper", "bb_lower", "bb_width", "bb_pct"])


TR_CTE = "pv AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS pc FROM nb), tr AS (SELECT *, greatest(high-low, abs(high-pc), abs(low-pc)) AS tr FROM pv)"


@query("ind_true_range_atr", f"WITH {NB}, {TR_CTE} SELECT symbol, ts, {R('tr')}, {R(full('avg(tr) OVER w14', 14), 'atr_14')} FROM tr {win(14)}")
def _(s, d):
    return run(s, d, lambda b: I.atr(I.true_range(b), 14), ["tr", "atr_14"])


@query("ind_stochastic_williams", f"""WITH {NB}, k AS (SELECT *, {full('CASE WHEN max(high) OVER w14 = min(low) OVER w14 THEN 50 ELSE 100*(close-min(low) OVER w14)/nullif(max(high) OVER w14-min(low) OVER w14,0) END', 14)} AS k,
 {full('CASE WHEN max(high) OVER w14 = min(low) OVER w14 THEN -50 ELSE -100*(max(high) OVER w14-close)/nullif(max(high) OVER w14-min(low) OVER w14,0) END', 14)} AS r FROM nb {win(14)})
 SELECT symbol, ts, {R('k', 'stoch_k')}, {R(full('avg(k) OVER w3', 16), 'stoch_d')}, {R('r', 'williams_r')} FROM k {win(3)}""")
def _(s, d):
    return run(s, d, lambda b: I.williams_r(I.stochastic(b)), ["stoch_k", "stoch_d", "williams_r"])


@query("ind_stochastic_rsi", f"""WITH {NB}, {RSI_CTE}, r AS (SELECT *, {rsi_sql(14)} AS r FROM dd {win(14)})
 SELECT symbol, ts, {R('CASE WHEN rn >= 28 THEN CASE WHEN max(r) OVER w14 = min(r) OVER w14 THEN 0.5 ELSE (r - min(r) OVER w14)/nullif(max(r) OVER w14 - min(r) OVER w14, 0) END END', 'stoch_rsi', 5)} FROM r {win(14)}""")
def _(s, d):
    return run(s, d, I.stochastic_rsi, ["stoch_rsi"], 5)


@query("ind_cci", f"""WITH {NB}, t AS (SELECT symbol, ts, rn, (high+low+close)/3 AS tp FROM nb), m AS (SELECT *, avg(tp) OVER w20 AS m, list(tp) OVER w20 AS l FROM t {win(20)}),
 z AS (SELECT *, list_sum(list_transform(l, lambda x: abs(x - m)))/20 AS md FROM m)
 SELECT symbol, ts, {R(full('CASE WHEN md=0 THEN 0 ELSE (tp-m)/nullif(0.015*md,0) END', 20), 'cci')} FROM z""")
def _(s, d):
    return run(s, d, I.cci, ["cci"])


ADX_CTE = TR_CTE + """, uv AS (SELECT *, high - lag(high) OVER s AS u, lag(low) OVER s - low AS v FROM tr WINDOW s AS (PARTITION BY symbol ORDER BY ts)),
 dm AS (SELECT *, CASE WHEN u>v AND u>0 THEN u WHEN u IS NOT NULL THEN 0 END AS p, CASE WHEN v>u AND v>0 THEN v WHEN u IS NOT NULL THEN 0 END AS q, CASE WHEN pc IS NOT NULL THEN tr END AS t FROM uv),
 di AS (SELECT symbol, ts, rn, CASE WHEN rn>14 THEN coalesce(100*avg(p) OVER w14/nullif(avg(t) OVER w14,0),0) END AS plus_di, CASE WHEN rn>14 THEN coalesce(100*avg(q) OVER w14/nullif(avg(t) OVER w14,0),0) END AS minus_di FROM dm """ + win(14) + """),
 ax AS (SELECT *, CASE WHEN rn>14 THEN coalesce(100*abs(plus_di-minus_di)/nullif(plus_di+minus_di,0),0) END AS dx FROM di)"""


@query("ind_adx", f"WITH {NB}, {ADX_CTE} SELECT symbol, ts, {RS(['plus_di', 'minus_di'])}, {R('CASE WHEN rn>=28 THEN avg(dx) OVER w14 END', 'adx')} FROM ax {win(14)}")
def _(s, d):
    return run(s, d, lambda b: I.adx(b, smooth=True), ["plus_di", "minus_di", "adx"])


@query("ind_roc_momentum_dpo", f"WITH {NB} SELECT symbol, ts, {R('100*(close/lag(close,10) OVER s - 1)', 'roc_10')}, {R('close-lag(close,10) OVER s', 'mom_10')}, {R(full('lag(close,11) OVER s - avg(close) OVER w20', 20), 'dpo')} FROM nb {win(20)}")
def _(s, d):
    return run(s, d, lambda b: I.dpo(I.momentum(I.roc(b))), ["roc_10", "mom_10", "dpo"])


@query("ind_aroon", f"""WITH {NB}, l AS (SELECT symbol, ts, rn, list(high) OVER w25 AS h, list(low) OVER w25 AS l FROM nb {win(25)}),
 a AS (SELECT symbol, ts, {full('100.0*(26 - list_position(list_reverse(h), list_max(h)))/25', 25)} AS u, {full('100.0*(26 - list_position(list_reverse(l), list_min(l)))/25', 25)} AS dn FROM l)
 SELECT symbol, ts, {R('u', 'aroon_up')}, {R('dn', 'aroon_down')}, {R('u-dn', 'aroon_osc')} FROM a""")
def _(s, d):
    return run(s, d, I.aroon, ["aroon_up", "aroon_down", "aroon_osc"])


@query("ind_ultimate_oscillator", f"""WITH {NB}, pv AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS pc FROM nb),
 b AS (SELECT *, CASE WHEN pc IS NOT NULL THEN close-least(low,pc) END AS bp, CASE WHEN pc IS NOT NULL THEN CASE WHEN greatest(high,pc)-least(low,pc) > 0 THEN greatest(high,pc)-least(low,pc) ELSE 0.001 END END AS tr FROM pv)
 SELECT symbol, ts, {R('CASE WHEN rn>28 THEN 100*(4*(sum(bp) OVER w7/greatest(sum(tr) OVER w7,0.001))+2*(sum(bp) OVER w14/greatest(sum(tr) OVER w14,0.001))+sum(bp) OVER w28/greatest(sum(tr) OVER w28,0.001))/7 END', 'uo')} FROM b {win(7, 14, 28)}""")
def _(s, d):
    return run(s, d, I.ultimate_oscillator, ["uo"])


@query("ind_tsi", f"""WITH {NB}, {RSI_CTE}, a AS (SELECT symbol, ts, rn, {ema_sql('d', 25, 1)} AS m1, {ema_sql('abs(d)', 25, 1)} AS a1 FROM dd {win()}), b AS (SELECT *, {ema_sql('m1', 13, 1)} AS m2, {ema_sql('a1', 13, 1)} AS a2 FROM a {win()})
 SELECT symbol, ts, {R('CASE WHEN rn>1 THEN CASE WHEN a2=0 THEN 0 ELSE 100*m2/nullif(a2,0) END END', 'tsi')} FROM b""")
def _(s, d):
    return run(s, d, I.tsi, ["tsi"])


@query("ind_trix", f"""WITH {NB}, a AS (SELECT symbol, ts, rn, {ema_sql('close', 15)} AS e1 FROM nb {win()}), b AS (SELECT *, {ema_sql('e1', 15)} AS e2 FROM a {win()}), c AS (SELECT *, {ema_sql('e2', 15)} AS e3 FROM b {win()})
 SELECT symbol, ts, {R('100*(e3/lag(e3) OVER s - 1)', 'trix')} FROM c {win()}""")
def _(s, d):
    return run(s, d, I.trix, ["trix"])


def _kst():
    cte = "r AS (SELECT symbol, ts, rn, " + ", ".join(f"100*(close/lag(close,{n}) OVER s - 1) AS r{n}" for n in (10, 15, 20, 30)) + f" FROM nb {win()})"
    return f"WITH {NB}, {cte} SELECT symbol, ts, {R('CASE WHEN rn>=45 THEN avg(r10) OVER w10 + 2*avg(r15) OVER w10 + 3*avg(r20) OVER w10 + 4*avg(r30) OVER w15 END', 'kst')} FROM r {win(10, 15)}"


@query("ind_kst", _kst())
def _(s, d):
    return run(s, d, I.kst, ["kst"])


@query("ind_std_donchian_histvol", f"""WITH {NB}, r AS (SELECT *, ln(close/lag(close) OVER s) AS r FROM nb {win()})
 SELECT symbol, ts, {R(full('stddev_pop(close) OVER w20', 20), 'std_20')}, {R(full('max(high) OVER w20', 20), 'dc_upper')}, {R(full('min(low) OVER w20', 20), 'dc_lower')}, {R(full('(max(high) OVER w20+min(low) OVER w20)/2', 20), 'dc_mid')},
 {R('CASE WHEN rn>20 THEN stddev_pop(r) OVER w20 * sqrt(365) END', 'hist_vol', 6)} FROM r {win(20)}""")
def _(s, d):
    b = I.historical_volatility(I.donchian(I.rolling_std(A.daily_bars(s, d), 20)))
    c = ["std_20", "dc_upper", "dc_lower", "dc_mid"]
    return b.select("symbol", "ts", *[rd(x).alias(x) for x in c], rd("hist_vol", 6).alias("hist_vol"))


@query("ind_relative_volatility", f"""WITH {NB}, a AS (SELECT *, CASE WHEN rn>10 THEN stddev_pop(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) END AS sd, lag(close) OVER s AS pc FROM nb {win()}),
 b AS (SELECT *, CASE WHEN close>pc THEN sd WHEN sd IS NOT NULL THEN 0 END AS up FROM a)
 SELECT symbol, ts, {R('CASE WHEN rn>=24 THEN CASE WHEN avg(sd-up) OVER w14=0 THEN 100 ELSE 100-100/(1+avg(up) OVER w14/nullif(avg(sd-up) OVER w14,0)) END END', 'rvi')} FROM b {win(14)}""")
def _(s, d):
    return run(s, d, I.relative_volatility_index, ["rvi"])


@query("ind_keltner", f"""WITH {NB}, {TR_CTE}, k AS (SELECT symbol, ts, {ema_sql('close', 20)} AS m, {full('avg(tr) OVER w20', 20)} AS a FROM tr {win(20)}) SELECT symbol, ts, {R('m', 'kc_mid')}, {R('m+2*a', 'kc_upper')}, {R('m-2*a', 'kc_lower')} FROM k""")
def _(s, d):
    return run(s, d, I.keltner, ["kc_mid", "kc_upper", "kc_lower"])


CUM_CTE = TR_CTE.split(", tr AS")[0] + """, t AS (SELECT *, lag(volume) OVER (PARTITION BY symbol ORDER BY ts) AS pvol, coalesce((close-pc)/nullif(pc,0),0) AS r,
 CASE WHEN high=low THEN 0 ELSE ((close-low)-(high-close))/nullif(high-low,0) END AS clv FROM pv)"""


@query("ind_cumulative_volume", f"""WITH {NB}, {CUM_CTE} SELECT symbol, ts, {R('sum(coalesce(sign(close-pc),0)*volume) OVER w', 'obv')}, {R('sum(clv*volume) OVER w', 'ad_line')}, {R('sum(volume*r) OVER w', 'pvt')},
 {R('sum(CASE WHEN volume<pvol THEN ln(1+r) ELSE 0 END) OVER w', 'log_nvi')}, {R('sum(CASE WHEN volume>pvol THEN ln(1+r) ELSE 0 END) OVER w', 'log_pvi')} FROM t {win()}""")
def _(s, d):
    c = lambda b: I.cumulative_volume(b).withColumn("log_nvi", F.ln(F.col("nvi") / 1000)).withColumn("log_pvi", F.ln(F.col("pvi") / 1000))
    return run(s, d, c, ["obv", "ad_line", "pvt", "log_nvi", "log_pvi"])


@query("ind_vwap_mfi_cmf", f"""WITH {NB}, {CUM_CTE}, x AS (SELECT *, (high+low+close)/3 AS tp FROM t), y AS (SELECT *, lag(tp) OVER s AS ptp FROM x {win()}),
 z AS (SELECT *, CASE WHEN tp>ptp THEN tp*volume WHEN ptp IS NOT NULL THEN 0 END AS pos, CASE WHEN tp<ptp THEN tp*volume WHEN ptp IS NOT NULL THEN 0 END AS neg FROM y)
 SELECT symbol, ts, {R(full('sum(tp*volume) OVER w20/nullif(sum(volume) OVER w20,0)', 20), 'vwap')}, {R('sum(tp*volume) OVER w/nullif(sum(volume) OVER w,0)', 'vwap_session')},
 {R('CASE WHEN rn>14 THEN CASE WHEN sum(pos) OVER w14=0 AND sum(neg) OVER w14=0 THEN 50 WHEN sum(neg) OVER w14=0 THEN 100 ELSE 100-100/(1+sum(pos) OVER w14/nullif(sum(neg) OVER w14,0)) END END', 'mfi')},
 {R(full('sum(clv*volume) OVER w21/nullif(sum(volume) OVER w21,0)', 21), 'cmf')} FROM z {win(14, 20, 21)}""")
def _(s, d):
    return run(s, d, lambda b: I.cmf(I.mfi(I.vwap(I.vwap(b, 20), None, out="vwap_session"))), ["vwap", "vwap_session", "mfi", "cmf"])


@query("ind_volume_oscillators", f"""WITH {NB}, {CUM_CTE}, a AS (SELECT *, sum(clv*volume) OVER w AS ad, coalesce((close-pc)*volume,0) AS force, (high+low+close)/3 AS hlc FROM t {win()}),
 b AS (SELECT *, coalesce(hlc-lag(hlc) OVER s,0) AS cm FROM a {win()}), c AS (SELECT *, volume*CASE WHEN cm>0 THEN 1.0 ELSE -1.0 END*abs(2*cm/(high-low+1e-10)) AS vf FROM b)
 SELECT symbol, ts, {R(ema_sql('ad', 3) + '-' + ema_sql('ad', 10), 'adosc')}, {R(ema_sql('force', 13), 'efi', 2)}, {R(f"({ema_sql('vf', 34)}-{ema_sql('vf', 55)})/1e9", 'kvo', 2)} FROM c {win()}""")
def _(s, d):
    b = I.volume_oscillators(A.daily_bars(s, d))
    return b.select("symbol", "ts", rd("adosc").alias("adosc"), rd("efi", 2).alias("efi"), rd(F.col("kvo") / 1e9, 2).alias("kvo"))


@query("ind_ease_of_movement", f"""WITH {NB}, a AS (SELECT *, (high+low)/2 AS mid FROM nb), b AS (SELECT *, coalesce((mid-lag(mid) OVER s)/((volume/1e6)/(high-low+1e-10)+1e-10),0) AS e FROM a {win()})
 SELECT symbol, ts, {R(full('avg(e) OVER w14/1e6', 14), 'eom', 2)} FROM b {win(14)}""")
def _(s, d):
    return I.ease_of_movement(A.daily_bars(s, d)).select("symbol", "ts", rd(F.col("eom") / 1e6, 2).alias("eom"))


@query("ind_volume_roc_rsi_confirmation", f"""WITH {NB}, dd AS (SELECT *, volume - lag(volume) OVER s AS d, sign(close-lag(close) OVER s) AS ps FROM nb {win()})
 SELECT symbol, ts, {R('100*(volume/lag(volume,10) OVER s - 1)', 'volume_roc')}, {R(rsi_sql(14), 'volume_rsi')},
 {R('CASE WHEN rn>=10 THEN CASE WHEN sum(CASE WHEN ps<>0 AND d<>0 THEN 1 ELSE 0 END) OVER w9=0 THEN 50 ELSE 100.0*sum(CASE WHEN ps<>0 AND d>0 THEN 1 ELSE 0 END) OVER w9/nullif(sum(CASE WHEN ps<>0 AND d<>0 THEN 1 ELSE 0 END) OVER w9,0) END END', 'vp_confirm')} FROM dd {win(9, 14)}""")
def _(s, d):
    return run(s, d, lambda b: I.volume_price_confirmation(I.rsi(I.roc(b, 10, "volume", out="volume_roc"), 14, "volume", out="volume_rsi")), ["volume_roc", "volume_rsi", "vp_confirm"])


@query("ind_parabolic_sar")
def _(s, d):
    return I.parabolic_sar(A.daily_bars(s, d)).select("symbol", "ts", rd("psar").alias("psar"))


FIBS = ", ".join(R(full(f"max(high) OVER w20 - {r}*(max(high) OVER w20 - min(low) OVER w20)", 20), f"fib_{int(round(r * 1000))}") for r in I.FIB_RATIOS)


@query("ind_trend_pivot_fib_levels", f"""WITH {NB}, x AS (SELECT *, lag(high) OVER s AS h, lag(low) OVER s AS l, (lag(high) OVER s+lag(low) OVER s+lag(close) OVER s)/3 AS pvt_,
 CASE WHEN count(*) OVER c=20 THEN min(low) OVER c END AS sp, CASE WHEN count(*) OVER c=20 THEN max(high) OVER c END AS rs FROM nb {win()}, c AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING))
 SELECT symbol, ts, {R(full('regr_slope(close, rn) OVER w20', 20), 'trend_strength')}, {R('pvt_', '"pivot"')}, {R('2*pvt_-l', 'r1')}, {R('2*pvt_-h', 's1')}, {R('pvt_+h-l', 'r2')}, {R('pvt_-h+l', 's2')}, {R('h+2*(pvt_-l)', 'r3')}, {R('l-2*(h-pvt_)', 's3')},
 {FIBS}, {R('last_value(sp IGNORE NULLS) OVER w', 'support')}, {R('last_value(rs IGNORE NULLS) OVER w', 'resistance')} FROM x {win(20)}""")
def _(s, d):
    cols = ["trend_strength", "pivot", "r1", "s1", "r2", "s2", "r3", "s3", *[f"fib_{int(round(r * 1000))}" for r in I.FIB_RATIOS], "support", "resistance"]
    return run(s, d, lambda b: I.rolling_levels(I.pivot_points(b)), cols)


@query("ind_swing_flags", f"""WITH {NB}, x AS (SELECT *, CASE WHEN high > max(high) OVER b AND high > max(high) OVER f THEN high END AS pk, CASE WHEN low < min(low) OVER b AND low < min(low) OVER f THEN low END AS tr,
 CAST(coalesce(lag(high,5) OVER s<high AND lead(high,5) OVER s<high AND high>lag(high,10) OVER s, false) AS INTEGER) AS higher_high, CAST(coalesce(lag(low,5) OVER s>low AND lead(low,5) OVER s>low AND low<lag(low,10) OVER s, false) AS INTEGER) AS lower_low
 FROM nb WINDOW s AS (PARTITION BY symbol ORDER BY ts), b AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)),
 y AS (SELECT *, last_value(pk IGNORE NULLS) OVER p AS ppk, last_value(tr IGNORE NULLS) OVER p AS ptr FROM x WINDOW p AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT symbol, ts, higher_high, lower_low, CAST(coalesce(abs(pk-ppk)/greatest(pk,ppk)<0.02,false) AS INTEGER) AS double_top, CAST(coalesce(abs(tr-ptr)/greatest(tr,ptr)<0.02,false) AS INTEGER) AS double_bottom FROM y""")
def _(s, d):
    return I.swing_flags(A.daily_bars(s, d)).select("symbol", "ts", "higher_high", "lower_low", "double_top", "double_bottom")


@query("ind_signals_divergence", f"""WITH {NB}, {RSI_CTE}, r AS (SELECT *, {rsi_sql(14)} AS r FROM dd {win(14)}),
 x AS (SELECT *, lag(r) OVER s AS pr, lag(r,14) OVER s AS r14, lag(close,14) OVER s AS c14 FROM r {win()})
 SELECT symbol, ts, CAST(coalesce(r>30 AND pr<=30,false) AS INTEGER) AS rsi30_up, CAST(coalesce(r<30 AND pr>=30,false) AS INTEGER) AS rsi30_down,
 CAST(coalesce(close<c14 AND r>r14,false) AS INTEGER) AS rsi_14_bull_div, CAST(coalesce(close>c14 AND r<r14,false) AS INTEGER) AS rsi_14_bear_div FROM x""")
def _(s, d):
    b = I.divergence(I.cross_signals(I.rsi(A.daily_bars(s, d), 14), "rsi_14", 30.0, "rsi30"), "rsi_14")
    return b.select("symbol", "ts", "rsi30_up", "rsi30_down", "rsi_14_bull_div", "rsi_14_bear_div")


@query("ind_feature_set", f"""WITH {NB}, {RSI_CTE}, {ADX_CTE},
 e AS (SELECT symbol, ts, rn, {ema_sql('close', 12)} AS ema_12, {ema_sql('close', 26)} AS ema_26 FROM nb {win()}), g AS (SELECT *, {ema_sql('ema_12-ema_26', 9)} AS macd_signal FROM e {win()}),
 b AS (SELECT *, {rsi_sql(14)} AS rsi_14, {full('avg(close) OVER w50', 50)} AS sma_50, {full('avg(close) OVER w20', 20)} AS bb_mid, stddev_pop(close) OVER w20 AS sd FROM dd {win(14, 20, 50)})
 SELECT symbol, ts, {RS(['ema_12', 'ema_26', 'macd_signal', 'rsi_14', 'sma_50', 'bb_mid'])}, {R('ema_12-ema_26', 'macd')}, {R('bb_mid+2*sd', 'bb_upper')}, {R('dx', 'adx')} FROM b JOIN g USING (symbol, ts) JOIN ax USING (symbol, ts)""")
def _(s, d):
    return run(s, d, I.feature_set, ["ema_12", "ema_26", "macd_signal", "rsi_14", "sma_50", "bb_mid", "macd", "bb_upper", "adx"])


@query("ind_clip_normalized", f"""WITH {NB}, {RSI_CTE}, r AS (SELECT *, {rsi_sql(14)} AS rsi_14 FROM dd {win(14)})
 SELECT symbol, ts, {R('coalesce(greatest(least((rsi_14-avg(rsi_14) OVER w100)/(stddev_samp(rsi_14) OVER w100+1e-8),1.5),-1.5),0)', 'rsi_14')}, {R('coalesce(greatest(least((close-avg(close) OVER w100)/(stddev_samp(close) OVER w100+1e-8),1.5),-1.5),0)', 'close')} FROM r {win(100)}""")
def _(s, d):
    return rcols(I.clip_normalize(I.rsi(A.daily_bars(s, d)), ["rsi_14", "close"], 100, 1.5), ["symbol", "ts"], ["rsi_14", "close"])
