"""Cross-asset measures over the 25 nation series."""
from __future__ import annotations

from pyspark.sql import functions as F

from tapeworks.operators import crossasset as X
from tapeworks.plans.pairs import all_pairs, pair_table
from tapeworks.plans.panel import Panel
from tapeworks.queries import query
from tapeworks.queries.common import MARKET, R, RS, rcols, rd
from tapeworks.sources import adapters as A

# every nation of the nation table
SYMBOLS = [f"NATION_{i}" for i in range(25)]
PAIRS = all_pairs(SYMBOLS)
MR = MARKET + """, mr AS (SELECT *, ln(close/lag(close) OVER s) AS r, row_number() OVER s AS rn FROM market WINDOW s AS (PARTITION BY symbol ORDER BY ts))"""
AL = MR + """, al AS (SELECT x.symbol AS a, y.symbol AS b, x.ts, x.r AS xr, y.r AS yr FROM mr x JOIN mr y ON x.ts = y.ts AND x.symbol < y.symbol WHERE x.r IS NOT NULL AND y.r IS NOT NULL)"""
S = "PARTITION BY a, b ORDER BY ts"


def mr(s, d):
    return X.with_symbol_returns(A.market_daily(s, d))


def pairs(s):
    return pair_table(s, PAIRS)


@query("xasset_pearson", f"WITH {AL} SELECT a, b, count(*) AS n, {R('corr(xr,yr)', 'corr', 6)} FROM al GROUP BY a, b")
def _(s, d):
    return rcols(X.pair_correlation(mr(s, d), pairs(s)), ["a", "b", "n"], ["corr"], 6)


@query("xasset_spearman", f"WITH {AL}, rk AS (SELECT a, b, rank() OVER (PARTITION BY a,b ORDER BY xr) + (count(*) OVER (PARTITION BY a,b,xr)-1)/2.0 AS rx, rank() OVER (PARTITION BY a,b ORDER BY yr) + (count(*) OVER (PARTITION BY a,b,yr)-1)/2.0 AS ry FROM al) SELECT a, b, count(*) AS n, {R('corr(rx,ry)', 'corr', 6)} FROM rk GROUP BY a, b")
def _(s, d):
    return rcols(X.pair_correlation(mr(s, d), pairs(s), method="spearman"), ["a", "b", "n"], ["corr"], 6)


@query("xasset_absdev_correlation", f"WITH {AL}, m AS (SELECT a, b, avg(xr) AS mx, avg(yr) AS my FROM al GROUP BY ALL) SELECT al.a, al.b, count(*) AS n, {R('corr(abs(xr-mx),abs(yr-my))', 'corr', 6)} FROM al JOIN m ON al.a=m.a AND al.b=m.b GROUP BY ALL")
def _(s, d):
    return rcols(X.pair_correlation(mr(s, d), pairs(s), method="absdev"), ["a", "b", "n"], ["corr"], 6)


@query("xasset_rolling_kendall")
def _(s, d):
    return X.rolling_kendall(mr(s, d), pair_table(s, [(x, y) for x, y in zip(SYMBOLS, SYMBOLS[1:])]), n=12).select("a", "b", "ts", rd("tau", 6).alias("tau"))


@query("xasset_mutual_information", f"""WITH {MR}, mm AS (SELECT symbol, min(r) AS lo, max(r) AS hi FROM mr GROUP BY 1), bn AS (SELECT mr.symbol, ts, CAST(least(floor((r-lo)*10/(hi-lo)),9) AS INTEGER) AS bin FROM mr JOIN mm USING (symbol) WHERE r IS NOT NULL),
 al AS (SELECT x.symbol AS a, y.symbol AS b, x.bin AS bx, y.bin AS by_ FROM bn x JOIN bn y ON x.ts=y.ts AND x.symbol<y.symbol), c AS (SELECT a, b, bx, by_, count(*) AS n FROM al GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY a,b) AS t, sum(n) OVER (PARTITION BY a,b,bx) AS px, sum(n) OVER (PARTITION BY a,b,by_) AS py FROM c)
 SELECT a, b, {R('sum(n/t*ln(n::DOUBLE*t/(px*py)))', 'mi', 6)} FROM t GROUP BY a, b""")
def _(s, d):
    return rcols(X.mutual_information(mr(s, d), pairs(s)), ["a", "b"], ["mi"], 6)


@query("xasset_rolling_correlation", f"WITH {AL} SELECT a, b, ts, {R(f'CASE WHEN count(*) OVER (PARTITION BY a,b ORDER BY ts ROWS 23 PRECEDING) >= 24 THEN corr(xr,yr) OVER (PARTITION BY a,b ORDER BY ts ROWS 23 PRECEDING) END', 'corr_24', 5)} FROM al")
def _(s, d):
    return rcols(X.rolling_correlation(mr(s, d), pairs(s), (24,)), ["a", "b", "ts"], ["corr_24"], 5)


@query("xasset_lagged_correlation", " UNION ALL ".join(f"(WITH {AL}, l AS (SELECT a, b, yr, lag(xr,{k}) OVER ({S}) AS lx FROM al) SELECT a, b, {k} AS lag, {R('corr(lx,yr)', 'corr', 6)} FROM l GROUP BY a, b)" for k in (1, 2, 3)))
def _(s, d):
    return rcols(X.lagged_correlation(mr(s, d), pairs(s), (1, 2, 3)), ["a", "b", "lag"], ["corr"], 6)


@query("xasset_correlation_row", f"""WITH {AL}, q AS (SELECT * FROM al WHERE a IN ('NATION_0','NATION_1') AND b IN ('NATION_1','NATION_2')), rl AS (SELECT CASE WHEN count(*) OVER w >= 24 THEN corr(xr,yr) OVER w END AS c FROM al WHERE a='NATION_0' AND b='NATION_1' WINDOW w AS (ORDER BY ts ROWS 23 PRECEDING))
 SELECT {R("(SELECT corr(xr,yr) FROM q WHERE a='NATION_0' AND b='NATION_1')", '"NATION_0_NATION_1"', 6)}, {R("(SELECT corr(xr,yr) FROM q WHERE a='NATION_1' AND b='NATION_2')", '"NATION_1_NATION_2"', 6)}, {R('(SELECT avg(c) FROM rl)', 'roll_mean', 6)}, {R('(SELECT stddev_samp(c) FROM rl)', 'roll_std', 6)}, {R('(SELECT max(c) FROM rl)', 'roll_max', 6)}""")
def _(s, d):
    r = X.correlation_row(mr(s, d), [("NATION_0", "NATION_1"), ("NATION_1", "NATION_2")], ("NATION_0", "NATION_1"))
    return r.select(*[rd(c, 6).alias(c) for c in ("NATION_0_NATION_1", "NATION_1_NATION_2", "roll_mean", "roll_std", "roll_max")])


@query("xasset_regime_correlation", f"""WITH {AL}, v AS (SELECT *, CASE WHEN count(*) OVER w = 20 THEN stddev_samp(xr) OVER w END AS v FROM al WINDOW w AS ({S} ROWS 19 PRECEDING)), f AS (SELECT * FROM v WHERE v IS NOT NULL), m AS (SELECT a, b, median(v) AS m FROM f GROUP BY ALL)
 SELECT f.a, f.b, CASE WHEN v>m THEN 'high' ELSE 'low' END AS regime, count(*) AS n, {R('corr(xr,yr)', 'corr', 5)} FROM f JOIN m ON f.a=m.a AND f.b=m.b GROUP BY ALL""")
def _(s, d):
    return rcols(X.regime_correlation(mr(s, d), pairs(s)), ["a", "b", "regime", "n"], ["corr"], 5)


@query("xasset_partial_correlation")
def _(s, d):
    return rcols(X.partial_correlation(mr(s, d), SYMBOLS), ["a", "b"], ["partial"], 4)


@query("xasset_volatility_adjusted", f"WITH {MR}, z AS (SELECT symbol, ts, CASE WHEN rn>20 THEN r/stddev_samp(r) OVER (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING) END AS z FROM mr) SELECT x.symbol AS a, y.symbol AS b, count(*) AS n, {R('corr(x.z,y.z)', 'corr', 6)} FROM z x JOIN z y ON x.ts=y.ts AND x.symbol<y.symbol WHERE x.z IS NOT NULL AND y.z IS NOT NULL GROUP BY ALL")
def _(s, d):
    return rcols(X.volatility_adjusted_correlation(mr(s, d), pairs(s)), ["a", "b", "n"], ["corr"], 6)


COR = AL + ", co AS (SELECT a, b, corr(xr,yr) AS c FROM al GROUP BY ALL), bo AS (SELECT a AS src, b AS dst, c FROM co UNION ALL SELECT b, a, c FROM co)"


@query("graph_edge_list", f"WITH {COR}, e AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY abs(abs(c)) DESC, dst) AS k FROM bo WHERE abs(c)>=0.01) SELECT src, dst, {R('abs(c)', 'weight', 6)}, {R('c', 'corr', 6)}, CAST(sign(c) AS DOUBLE) AS sign FROM e WHERE k<=5")
def _(s, d):
    e = X.edge_list(X.pair_correlation(mr(s, d), pairs(s)), "abs", 0.01, 5)
    return e.select("src", "dst", rd("weight", 6).alias("weight"), rd("corr", 6).alias("corr"), "sign")


@query("graph_spanning_tree")
def _(s, d):
    c = X.pair_correlation(mr(s, d), pairs(s)).select("a", "b", (1 - F.abs("corr")).alias("w"))
    return rcols(X.spanning_tree(c), ["a", "b"], ["w"], 6)


@query("graph_dynamic_edges", f"WITH {AL}, q AS (SELECT a, b, ts, count(*) OVER w AS n, corr(xr,yr) OVER w AS c FROM al WINDOW w AS ({S} ROWS 23 PRECEDING)) SELECT ts, a AS src, b AS dst, {R('c', 'corr', 5)} FROM q WHERE n>=24 AND abs(c)>=0.5")
def _(s, d):
    return rcols(X.dynamic_edges(mr(s, d), pairs(s), 24, 0.5), ["ts", "src", "dst"], ["corr"], 5)


@query("graph_node_features", f"WITH {MR}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM mr) SELECT symbol, {R('avg(r)', 'mean', 6)}, {R('stddev_samp(r)', 'std', 6)}, {R('sum(CASE WHEN k<=10 THEN r END)', 'momentum', 6)}, {R('avg(volume)', 'volume_mean')}, {R('stddev_samp(volume)', 'volume_std')} FROM k GROUP BY symbol")
def _(s, d):
    n = X.node_features(mr(s, d))
    return n.select("symbol", *[rd(c, 6).alias(c) for c in ("mean", "std", "momentum")], rd("volume_mean").alias("volume_mean"), rd("volume_std").alias("volume_std"))


SPR = MARKET + f""", al AS (SELECT x.symbol AS a, y.symbol AS b, x.ts, ln(x.close/y.close) AS ls, 100*(x.close-y.close)/y.close AS ps FROM market x JOIN market y ON x.ts=y.ts AND x.symbol<y.symbol), p AS (SELECT *, lag(ls) OVER ({S}) AS pl FROM al),
 z AS (SELECT *, count(*) OVER w AS n, stddev_pop(ls) OVER w AS sd, avg(ls) OVER w AS m, corr(ls,pl) OVER w AS ac FROM p WINDOW w AS ({S} ROWS 23 PRECEDING))"""


@query("xasset_spread_measures", f"WITH {SPR} SELECT a, b, ts, {R('ls', 'log_spread', 6)}, {R('ps', 'pct_spread')}, {R('CASE WHEN n=24 THEN sd END', 'volatility', 6)}, {R('CASE WHEN n=24 THEN -ac END', 'convergence', 5)}, {R('CASE WHEN n=24 THEN (ls-m)/sd END', 'momentum', 5)} FROM z")
def _(s, d):
    m = X.spread_measures(A.market_daily(s, d), pairs(s))
    return m.select("a", "b", "ts", rd("log_spread", 6).alias("log_spread"), rd("pct_spread").alias("pct_spread"), rd("volatility", 6).alias("volatility"), rd("convergence", 5).alias("convergence"), rd("momentum", 5).alias("momentum"))


@query("xasset_spread_row", f"WITH {SPR}, l AS (SELECT a, b, arg_max(ls, ts) AS ls, arg_max(CASE WHEN n=24 THEN sd END, CASE WHEN n=24 THEN ts END) AS sd FROM z GROUP BY ALL) SELECT {R(chr(40) + 'SELECT ls FROM l WHERE a=' + chr(39) + 'NATION_0' + chr(39) + ' AND b=' + chr(39) + 'NATION_1' + chr(39) + chr(41), chr(34) + 'NATION_0_NATION_1_log_spread' + chr(34), 6)}, {R(chr(40) + 'SELECT sd FROM l WHERE a=' + chr(39) + 'NATION_0' + chr(39) + ' AND b=' + chr(39) + 'NATION_1' + chr(39) + chr(41), chr(34) + 'NATION_0_NATION_1_volatility' + chr(34), 6)}")
def _(s, d):
    w = X.latest_wide(X.spread_measures(A.market_daily(s, d), pairs(s)), PAIRS, ["log_spread", "volatility"])
    return w.select(*[rd(f"NATION_0_NATION_1_{c}", 6).alias(f"NATION_0_NATION_1_{c}") for c in ("log_spread", "volatility")])


@query("xasset_beta", f"""WITH {MARKET}, d AS (SELECT symbol, ts, ln(close/lag(close) OVER s) AS r, close/lag(close,60) OVER s - 1 AS ra, avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS 4 PRECEDING)/avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)-1 AS mo FROM market WINDOW s AS (PARTITION BY symbol ORDER BY ts)),
 j AS (SELECT d.*, m.r AS mr, m.ra AS mra, m.mo AS mmo FROM d JOIN d m ON d.ts=m.ts AND m.symbol='NATION_0' WHERE d.r IS NOT NULL AND m.r IS NOT NULL)
 SELECT symbol, ts, {R('CASE WHEN count(*) OVER w=60 THEN covar_pop(r,mr) OVER w/var_pop(mr) OVER w END', 'beta', 5)}, {R('(1+ra)/(1+mra)', 'relative_strength', 5)}, {R('mo-mmo', 'divergence', 6)} FROM j WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 59 PRECEDING)""")
def _(s, d):
    b = X.beta_measures(A.market_daily(s, d), "NATION_0")
    return b.select("symbol", "ts", rd("beta", 5).alias("beta"), rd("relative_strength", 5).alias("relative_strength"), rd("divergence", 6).alias("divergence"))


TRD = MARKET + """, t0 AS (SELECT *, row_number() OVER s AS rn, lag(close,23) OVER s AS f FROM market WINDOW s AS (PARTITION BY symbol ORDER BY ts)), t1 AS (SELECT *, close/f-1 AS ret, CASE WHEN rn>=24 THEN regr_slope(close,rn) OVER w*24/f END AS slope, CASE WHEN rn>=24 THEN regr_r2(close,rn) OVER w END AS r2 FROM t0 WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 23 PRECEDING)),
 t2 AS (SELECT *, CASE WHEN ret IS NULL THEN 0 WHEN ret>.05 AND slope>0 THEN 2 WHEN ret>.02 AND slope>0 THEN 1 WHEN ret<-.05 AND slope<0 THEN -2 WHEN ret<-.02 AND slope<0 THEN -1 ELSE 0 END AS trend FROM t1), t3 AS (SELECT *, rn - row_number() OVER (PARTITION BY symbol, trend ORDER BY ts) AS isl FROM t2)"""


@query("xasset_trend_regime", f"WITH {TRD} SELECT symbol, ts, CAST(trend AS INTEGER) AS trend, {R('slope', 'slope', 5)}, {R('r2', 'r2', 5)}, CAST(row_number() OVER (PARTITION BY symbol, trend, isl ORDER BY ts) AS INTEGER) AS duration, {R('slope-lag(slope,12) OVER (PARTITION BY symbol ORDER BY ts)', 'acceleration', 5)} FROM t3")
def _(s, d):
    t = X.trend_regime(A.market_daily(s, d))
    return t.select("symbol", "ts", "trend", rd("slope", 5).alias("slope"), rd("r2", 5).alias("r2"), "duration", rd("acceleration", 5).alias("acceleration"))


@query("xasset_market_phase", f"""WITH {TRD}, v AS (SELECT symbol, ts, trend, ln(close/lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS r, (volume-avg(volume) OVER w)/nullif(stddev_samp(volume) OVER w,0) AS vz, rn FROM t2 WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)),
 g AS (SELECT *, CASE WHEN rn<=24 THEN NULL ELSE sqrt(sum(r*r) OVER (PARTITION BY symbol ORDER BY ts ROWS 23 PRECEDING)) END AS rv FROM v), h AS (SELECT *, CASE WHEN rv IS NULL THEN 1 WHEN rv<1 THEN 0 WHEN rv<1.5 THEN 1 WHEN rv<2 THEN 2 ELSE 3 END AS vr FROM g)
 SELECT symbol, ts, CASE WHEN trend>0 AND vr<=2 THEN 'markup' WHEN trend<0 AND vr>=1 THEN 'markdown' WHEN trend=0 AND vz>0.5 THEN CASE WHEN vr>=2 THEN 'distribution' ELSE 'accumulation' END ELSE 'transition' END AS phase FROM h""")
def _(s, d):
    from tapeworks.operators.volatility import volatility_regime
    p = Panel()
    m = volatility_regime(X.trend_regime(A.market_daily(s, d)).drop("duration"), 24, (1.0, 1.5, 2.0))
    w = p.trailing(20)
    m = m.withColumn("volume_z", (F.col("volume") - F.avg("volume").over(w)) / F.nullif(F.stddev_samp("volume").over(w), F.lit(0.0)))
    return X.market_phase(m).select("symbol", "ts", "phase")


FUT = """fu AS (SELECT n_name AS symbol, l_shipdate AS ts, avg(l_tax)-avg(l_discount) AS fr, sum(l_quantity) AS oi, sum(CASE WHEN l_returnflag='R' THEN l_quantity ELSE 0 END) AS ll, sum(CASE WHEN l_returnflag='R' THEN 0 ELSE l_quantity END) AS ls, sum(l_extendedprice)/sum(l_quantity) AS ip, avg(l_tax) AS tx
 FROM lineitem JOIN supplier ON l_suppkey=s_suppkey JOIN nation ON s_nationkey=n_nationkey GROUP BY ALL)"""


@query("futures_block", f"""WITH {FUT} SELECT symbol, ts, {R('fr', 'funding', 6)}, {R('lag(fr) OVER s', 'funding_lag', 6)}, {R('avg(fr) OVER w', 'funding_mean', 6)}, {R('stddev_samp(fr) OVER w', 'funding_std', 6)}, {R('oi/lag(oi) OVER s-1', 'oi_change', 5)}, {R('coalesce((ll-ls)/nullif(ll+ls,0),0)', 'liq_imbalance', 6)}, {R('tx', 'premium', 6)}, {R('sum(fr*oi) OVER w/sum(oi) OVER w', 'funding_oi_weighted', 6)}
 FROM fu WINDOW s AS (PARTITION BY symbol ORDER BY ts), w AS (PARTITION BY symbol ORDER BY ts ROWS 23 PRECEDING)""")
def _(s, d):
    b = X.futures_block(A.futures_rows(s, d))
    return b.select("symbol", "ts", *[rd(c, 5 if c == "oi_change" else 6).alias(c) for c in b.columns if c not in ("symbol", "ts")])


@query("cross_market_block", f"""WITH {FUT}, b AS (SELECT symbol, ts, ip AS spot, ip*(1+tx) AS future, tx AS basis, count(*) OVER w AS n FROM fu WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 23 PRECEDING))
 SELECT symbol, ts, {R('basis', 'basis', 6)}, {R('CASE WHEN n>=12 THEN coalesce((basis-avg(basis) OVER w)/nullif(stddev_samp(basis) OVER w,0),0) END', 'basis_z', 5)}, {R('CASE WHEN n>=12 THEN corr(spot,future) OVER w END', 'price_corr', 6)} FROM b WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 23 PRECEDING)""")
def _(s, d):
    f = A.futures_rows(s, d)
    x = X.cross_market(f.select("symbol", "ts", F.col("index_price").alias("close"), F.col("open_interest").alias("volume")), f.select("symbol", "ts", F.col("mark_price").alias("close"), F.col("liquidations_long").alias("volume")))
    return x.select("symbol", "ts", rd("basis", 6).alias("basis"), rd("basis_z", 5).alias("basis_z"), rd("price_corr", 6).alias("price_corr"))
