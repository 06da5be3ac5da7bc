"""Return, drawdown, tail, portfolio and backtest measures. Strategies are nations with daily returns."""
from __future__ import annotations

from pyspark.sql import functions as F

from tapeworks.operators import risk as RK
from tapeworks.plans.panel import Panel, join_on
from tapeworks.queries import query
from tapeworks.queries.common import BARS, MARKET, R, RS, rcols, rd
from tapeworks.sources import adapters as A

RET = MARKET + """, ret AS (SELECT * FROM (SELECT symbol AS strategy, ts, close, close/lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS r FROM market) WHERE r IS NOT NULL),
 eq AS (SELECT *, exp(sum(ln(1+r)) OVER w) AS equity, row_number() OVER w AS rn FROM ret WINDOW w AS (PARTITION BY strategy ORDER BY ts ROWS UNBOUNDED PRECEDING)),
 dd AS (SELECT *, 1 - equity/greatest(max(equity) OVER (PARTITION BY strategy ORDER BY ts ROWS UNBOUNDED PRECEDING), 1) AS drawdown FROM eq)"""
W = "PARTITION BY strategy ORDER BY ts"
P = RK.STRATEGY


def returns(s, d):
    m = A.market_daily(s, d).withColumnRenamed("symbol", "strategy")
    return m.withColumn("r", F.col("close") / F.lag("close").over(P.w) - 1).where("r is not null")


@query("risk_cumulative_return_drawdown", f"WITH {RET} SELECT strategy, ts, {R('equity')}, {R('drawdown', 'drawdown', 6)} FROM dd")
def _(s, d):
    return RK.with_drawdown(returns(s, d)).select("strategy", "ts", rd("equity").alias("equity"), rd("drawdown", 6).alias("drawdown"))


@query("risk_cumulative_return_carry", f"WITH {RET} SELECT strategy, ts, {R('equity')}, {R('drawdown', 'drawdown', 6)} FROM dd")
def _(s, d):
    x = RK.with_drawdown(returns(s, d), bucket=F.date_trunc("year", "ts"))
    return x.select("strategy", "ts", rd("equity").alias("equity"), rd("drawdown", 6).alias("drawdown"))


PERF = f"""pf AS (SELECT strategy, count(r) AS n, avg(r) AS mean, stddev_samp(r) AS volatility, (avg(r)-0.02/252)/stddev_samp(r)*sqrt(252) AS sharpe,
 (avg(r)-0.02/252)/sqrt(avg(CASE WHEN r<0.02/252 THEN pow(r-0.02/252,2) END))*sqrt(252) AS sortino, avg(CASE WHEN r>0 THEN 1.0 ELSE 0.0 END) AS win_rate, sum(CASE WHEN r>0 THEN r ELSE 0 END)/sum(CASE WHEN r<0 THEN -r ELSE 0 END) AS profit_factor,
 exp(sum(ln(1+r)))-1 AS total_return, max(drawdown) AS max_drawdown, sqrt(avg(CASE WHEN r<0 THEN r*r END)) AS downside_vol FROM dd GROUP BY 1)"""
PC = ["mean", "volatility", "sharpe", "sortino", "win_rate", "profit_factor", "total_return", "max_drawdown", "downside_vol"]


@query("risk_performance_row", f"WITH {RET}, {PERF} SELECT strategy, n, {RS(PC)}, {R('(pow(1+total_return,252.0/n)-1)/max_drawdown', 'calmar')}, CAST(rank() OVER (ORDER BY sharpe DESC) AS INTEGER) AS rank FROM pf")
def _(s, d):
    return rcols(RK.rank_strategies(RK.performance(returns(s, d))), ["strategy", "n", "rank"], PC + ["calmar"])


@query("risk_var_cvar_tail", f"""WITH {RET}, q AS (SELECT strategy, quantile_cont(r,.05) AS q, quantile_cont(r,.95) AS q95 FROM ret GROUP BY 1)
 SELECT strategy, count(r) AS n, {R('-max(q)', 'var_hist', 6)}, {R('-(avg(r)-1.6448536269514729*stddev_samp(r))', 'var_param', 6)}, {R('-avg(CASE WHEN r<=q THEN r END)', 'cvar', 6)}, {R('abs(max(q95)/max(q))', 'tail_ratio')} FROM ret JOIN q USING (strategy) GROUP BY 1""")
def _(s, d):
    v = RK.value_at_risk(returns(s, d))
    return v.select("strategy", "n", *[rd(c, 6).alias(c) for c in ("var_hist", "var_param", "cvar")], rd("tail_ratio").alias("tail_ratio"))


@query("risk_bootstrap_var", f"""WITH {RET}, n AS (SELECT strategy, count(*) AS n FROM ret GROUP BY 1), dr AS (SELECT strategy, n, sim, step, CAST(floor(('0x'||substr(md5('42|'||strategy||'|'||sim||'|'||step),1,8))::BIGINT/4294967296.0::DOUBLE*n) AS BIGINT)+1 AS rn FROM n, range(1,201) a(sim), range(1,6) b(step)),
 p AS (SELECT dr.strategy, sim, exp(sum(ln(1+r)))-1 AS path FROM dr JOIN eq ON eq.strategy=dr.strategy AND eq.rn=dr.rn GROUP BY ALL) SELECT strategy, {R('-quantile_cont(path,.05)', 'var_boot', 6)}, {R('avg(path)', 'mean_path')} FROM p GROUP BY 1""")
def _(s, d):
    v = RK.bootstrap_var(returns(s, d), 200, 5)
    return v.select("strategy", rd("var_boot", 6).alias("var_boot"), rd("mean_path").alias("mean_path"))


@query("risk_benchmark_measures", f"""WITH {RET}, b AS (SELECT ts, avg(r) AS b FROM ret GROUP BY 1), j AS (SELECT * FROM ret JOIN b USING (ts)), g AS (SELECT strategy, count(*) AS n, covar_samp(r,b)/var_samp(b) AS beta, avg(r) AS mr, avg(b) AS mb, stddev_samp(r-b)*sqrt(252) AS te, avg(r-b) AS ex, corr(r,b) AS c FROM j GROUP BY 1)
 SELECT strategy, n, {R('beta')}, {R('(mr-(0.02/252+beta*(mb-0.02/252)))*252', 'alpha')}, {R('te', 'tracking_error')}, {R('ex*252/te', 'information_ratio')}, {R('(mr-0.02/252)*252/beta', 'treynor')}, {R('c', 'correlation', 6)} FROM g""")
def _(s, d):
    r = returns(s, d)
    j = r.join(r.groupBy("ts").agg(F.avg("r").alias("b")), "ts")
    m = RK.benchmark_measures(j)
    return m.select("strategy", "n", *[rd(c).alias(c) for c in ("beta", "alpha", "tracking_error", "information_ratio", "treynor")], rd("correlation", 6).alias("correlation"))


@query("risk_rolling_metrics", f"""WITH {RET}, l AS (SELECT *, list(equity) OVER w AS es, avg(r) OVER w AS m, stddev_samp(r) OVER w AS sd, avg(CASE WHEN r>0 THEN 1.0 ELSE 0.0 END) OVER w AS wr, equity/(1+r) AS e0, lag(equity, 39) OVER ({W}) AS ef, lag(r, 39) OVER ({W}) AS rf FROM eq WINDOW w AS ({W} ROWS 39 PRECEDING))
 SELECT strategy, ts, {R('CASE WHEN rn>=40 THEN (m-0.02/252)/sd*sqrt(252) END', 'roll_sharpe')}, {R('CASE WHEN rn>=40 THEN sd*sqrt(252) END', 'roll_vol')}, {R('CASE WHEN rn>=40 THEN wr END', 'roll_win', 6)} FROM l""")
def _(s, d):
    x = RK.rolling_metrics(returns(s, d), 40)
    return x.select("strategy", "ts", rd("roll_sharpe").alias("roll_sharpe"), rd("roll_vol").alias("roll_vol"), rd("roll_win", 6).alias("roll_win"))


@query("risk_drawdown_periods", f"""WITH {RET}, u AS (SELECT *, drawdown > 1e-12 AS uw, lead(ts) OVER ({W}) IS NULL AS last FROM dd), c AS (SELECT *, CASE WHEN uw IS DISTINCT FROM lag(uw) OVER ({W}) THEN 1 ELSE 0 END AS ch FROM u), i AS (SELECT *, sum(ch) OVER ({W} ROWS UNBOUNDED PRECEDING) AS isl FROM c)
 SELECT strategy, min(ts) AS start, max(ts) AS "end", arg_min(ts, row(-drawdown, ts)) AS trough, {R('max(drawdown)', 'depth', 6)}, count(*) AS "rows", CAST(NOT bool_or(last) AS INTEGER) AS recovered FROM i WHERE uw GROUP BY strategy, isl""")
def _(s, d):
    x = RK.drawdown_periods(returns(s, d))
    return x.select("strategy", "start", "end", "trough", rd("depth", 6).alias("depth"), "rows", "recovered")


@query("risk_monthly_returns", f"WITH {RET} SELECT strategy, date_trunc('month', ts)::TIMESTAMP AS month, {R('exp(sum(ln(1+r)))-1', 'ret', 5)}, count(r) AS n FROM ret GROUP BY ALL")
def _(s, d):
    return rcols(RK.monthly_returns(returns(s, d)), ["strategy", "month", "n"], ["ret"], 5)


@query("risk_performance_features", f"""WITH {RET} SELECT strategy, ts, {R('equity-lag(equity) OVER s', 'pnl')}, {R('equity/lag(equity,7) OVER s-1', 'ret_7')}, {R('equity/lag(equity,30) OVER s-1', 'ret_30')}, {R(f'1-equity/max(equity) OVER ({W} ROWS 167 PRECEDING)', 'drawdown_n', 6)} FROM eq WINDOW s AS ({W})""")
def _(s, d):
    x = RK.performance_features(RK.cumulative_return(returns(s, d)))
    return x.select("strategy", "ts", rd("pnl").alias("pnl"), rd("ret_7").alias("ret_7"), rd("ret_30").alias("ret_30"), rd("drawdown_n", 6).alias("drawdown_n"))


POSV = "pv AS (SELECT o_custkey AS account, l_suppkey AS symbol, sum(CASE WHEN l_returnflag='R' THEN -l_extendedprice ELSE l_extendedprice END) AS v FROM lineitem JOIN orders ON l_orderkey=o_orderkey GROUP BY ALL)"


@query("portfolio_exposure", f"""WITH {POSV} SELECT account, {R('sum(abs(v))', 'gross', 2)}, {R('sum(v)', 'net', 2)}, count(*) AS n, {R('sum(v*v)/pow(sum(abs(v)),2)', 'herfindahl', 6)}, {R('max(abs(v))/sum(abs(v))', 'top_share', 6)} FROM pv GROUP BY 1""")
def _(s, d):
    l, o = A.table(s, d, "lineitem"), A.table(s, d, "orders")
    p = l.join(o, l.l_orderkey == o.o_orderkey).select(F.col("o_custkey").alias("account"), F.col("l_suppkey").alias("symbol"), F.when(F.col("l_returnflag") == "R", -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice")).alias("value"))
    x = RK.exposure(p)
    return x.select("account", rd("gross", 2).alias("gross"), rd("net", 2).alias("net"), "n", rd("herfindahl", 6).alias("herfindahl"), rd("top_share", 6).alias("top_share"))


LEDGER = """g AS (SELECT l_partkey AS symbol, sum(CASE WHEN l_returnflag<>'R' THEN l_quantity ELSE 0 END) AS b, sum(CASE WHEN l_returnflag<>'R' THEN l_extendedprice*(1+l_tax) ELSE 0 END) AS paid, sum(CASE WHEN l_returnflag='R' THEN l_quantity ELSE 0 END) AS so, sum(CASE WHEN l_returnflag='R' THEN l_extendedprice*(1-l_tax) ELSE 0 END) AS pr FROM lineitem GROUP BY 1),
 v AS (SELECT *, coalesce(paid/nullif(b,0),0) AS ac FROM g LEFT JOIN part ON p_partkey=symbol)"""


@query("portfolio_ledger_valuation", f"WITH {LEDGER} SELECT symbol, {R('b-so', 'quantity')}, {R('ac', 'avg_cost', 3)}, {R('pr-so*ac', 'realized', 2)}, {R('(b-so)*(p_retailprice-ac)', 'unrealized', 2)} FROM v")
def _(s, d):
    l = A.table(s, d, "lineitem")
    led = l.select(F.col("l_partkey").alias("symbol"), F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"), F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), (F.col("l_extendedprice") * F.col("l_tax")).alias("fee"))
    px = A.table(s, d, "part").select(F.col("p_partkey").alias("symbol"), F.col("p_retailprice").alias("price"))
    v = RK.valuation(led, px, Panel(("symbol",), ("symbol",)))
    return v.select("symbol", rd("quantity").alias("quantity"), rd("avg_cost", 3).alias("avg_cost"), rd("realized", 2).alias("realized"), rd("unrealized", 2).alias("unrealized"))


@query("portfolio_risk_limits", f"""WITH {POSV}, e AS (SELECT account, sum(abs(v)) AS gross, sum(v*v)/pow(sum(abs(v)),2) AS h FROM pv GROUP BY 1) SELECT account, CASE WHEN gross>3000000 THEN 1 ELSE 0 END + CASE WHEN h>0.3 THEN 1 ELSE 0 END AS n_breaches FROM e WHERE gross>3000000 OR h>0.3""")
def _(s, d):
    l, o = A.table(s, d, "lineitem"), A.table(s, d, "orders")
    p = l.join(o, l.l_orderkey == o.o_orderkey).select(F.col("o_custkey").alias("account"), F.col("l_suppkey").alias("symbol"), F.when(F.col("l_returnflag") == "R", -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice")).alias("value"))
    return RK.risk_limits(RK.exposure(p), {"gross": 3e6, "herfindahl": .3}).select("account", F.size("breaches").alias("n_breaches"))


@query("portfolio_position_sizes", f"""WITH {RET}, {PERF}, x AS (SELECT strategy, win_rate, profit_factor AS payoff, volatility, CASE WHEN volatility<0.3 THEN 0 WHEN volatility<0.5 THEN 1 ELSE 2 END AS regime FROM pf)
 SELECT strategy, {R('least(greatest(win_rate-(1-win_rate)/payoff,0),0.25)*100000', 'kelly', 2)}, {R('least(2000/(2*volatility),25000)', 'fixed_fraction', 2)}, {R('100000*least(0.15/volatility,1)', 'vol_target', 2)}, {R('least(2000/(1.65*volatility),100000)', 'var_size', 2)}, {R('CASE regime WHEN 0 THEN 1.2 WHEN 1 THEN 1.0 ELSE 0.6 END', 'regime_factor')} FROM x""")
def _(s, d):
    p = RK.performance(returns(s, d)).withColumn("payoff", F.col("profit_factor")).withColumn("stop_distance", 2 * F.col("volatility")).withColumn("var", 1.65 * F.col("volatility"))
    p = p.withColumn("regime", F.when(F.col("volatility") < .3, 0).when(F.col("volatility") < .5, 1).otherwise(2))
    x = RK.position_sizes(p)
    return x.select("strategy", *[rd(c, 2).alias(c) for c in ("kelly", "fixed_fraction", "vol_target", "var_size")], rd("regime_factor").alias("regime_factor"))


@query("portfolio_stop_levels", f"""WITH {BARS}, x AS (SELECT symbol, ts, close, close/lag(close) OVER s - 1 AS r, row_number() OVER s AS rn FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY ts)),
 y AS (SELECT *, CASE WHEN rn>14 THEN close*(1-2*avg(abs(r)) OVER w) END AS a, CASE WHEN rn>14 THEN avg(close) OVER w-2*stddev_pop(close) OVER w END AS b, CASE WHEN rn>14 THEN close*(1-2*stddev_samp(r) OVER w) END AS c FROM x WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 13 PRECEDING))
 SELECT symbol, ts, {R('a', 'stop_mar')}, {R('b', 'stop_band')}, {R('c', 'stop_vol')}, {R('least(a,b,c)', 'stop')}, {R('max(c) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)', 'stop_trailing')} FROM y""")
def _(s, d):
    return rcols(RK.stop_levels(A.daily_bars(s, d)), ["symbol", "ts"], ["stop_mar", "stop_band", "stop_vol", "stop", "stop_trailing"])


@query("risk_var_backtest", f"""WITH {RET}, v AS (SELECT strategy, ts, r, CASE WHEN rn>60 THEN 1.5*stddev_samp(r) OVER ({W} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) END AS var FROM eq), h AS (SELECT *, CASE WHEN r < -var THEN 1 ELSE 0 END AS h FROM v WHERE var IS NOT NULL), p AS (SELECT *, lag(h) OVER ({W}) AS p, row_number() OVER ({W}) - row_number() OVER (PARTITION BY strategy, h ORDER BY ts) AS isl FROM h),
 q AS (SELECT *, CASE WHEN h=1 THEN row_number() OVER (PARTITION BY strategy, h, isl ORDER BY ts) ELSE 0 END AS run FROM p), g AS (SELECT strategy, count(*) AS n, sum(h) AS x, max(run) AS mc, max(CASE WHEN h=1 THEN -r-var END) AS wx FROM q GROUP BY 1)
 SELECT strategy, n, CAST(x AS BIGINT) AS violations, CAST(mc AS BIGINT) AS max_cluster, {R('wx', 'worst_excess', 6)}, {R('x/n', 'rate', 6)}, {R('greatest(-2*((n-x)*ln(0.95)+CASE WHEN x=0 THEN 0 ELSE x*ln(0.05) END-CASE WHEN n=x THEN 0 ELSE (n-x)*ln(1-x/n) END-CASE WHEN x=0 THEN 0 ELSE x*ln(nullif(x,0)/n) END),0)', 'kupiec', 4)},
 CASE WHEN x/n/0.05<=1.2 THEN 'green' WHEN x/n/0.05<=1.8 THEN 'yellow' ELSE 'red' END AS light FROM g""")
def _(s, d):
    r = returns(s, d)
    n = F.count("r").over(P.prior(60))
    r = r.withColumn("var", F.when(n == 60, 1.5 * F.stddev_samp("r").over(P.prior(60))))
    x = RK.var_backtest(r)
    return x.select("strategy", "n", "violations", "max_cluster", rd("worst_excess", 6).alias("worst_excess"), rd("rate", 6).alias("rate"), rd("kupiec").alias("kupiec"), "light")


SIG = f"""sg AS (SELECT strategy, ts, close, avg(close) OVER ({W} ROWS 4 PRECEDING) AS prediction FROM ret), s1 AS (SELECT *, sign(prediction-lag(prediction) OVER ({W})) AS s0 FROM sg), s2 AS (SELECT *, coalesce(last_value(CASE WHEN s0<>0 THEN s0 END IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING),0) AS position FROM s1),
 s3 AS (SELECT *, coalesce(lag(position) OVER ({W}),0)*coalesce(close/lag(close) OVER ({W})-1,0)-0.001*abs(position-coalesce(lag(position) OVER ({W}),0)) AS sr FROM s2)"""


@query("backtest_signal", f"WITH {RET}, {SIG} SELECT strategy, ts, {R('position')}, {R('sr', 'r', 6)} FROM s3")
def _(s, d):
    r = returns(s, d).withColumn("prediction", F.avg("close").over(P.trailing(5))).drop("r")
    x = RK.signal_backtest(r)
    return x.select("strategy", "ts", rd("position").alias("position"), rd("r", 6).alias("r"))


@query("backtest_trade_summary", f"""WITH t AS (SELECT l_suppkey AS symbol, l_extendedprice*(0.05-l_discount)-l_quantity AS pnl FROM lineitem) SELECT symbol, count(*) AS n_trades, {R('avg(CASE WHEN pnl>0 THEN 1.0 ELSE 0.0 END)', 'win_rate', 6)}, {R('sum(CASE WHEN pnl>0 THEN pnl ELSE 0 END)/sum(CASE WHEN pnl<0 THEN -pnl ELSE 0 END)', 'profit_factor')}, {R('avg(pnl)', 'mean_pnl', 2)}, {R('max(pnl)', 'best', 2)} FROM t GROUP BY 1""")
def _(s, d):
    t = A.table(s, d, "lineitem").select(F.col("l_suppkey").alias("symbol"), (F.col("l_extendedprice") * (0.05 - F.col("l_discount")) - F.col("l_quantity")).alias("pnl"))
    x = RK.trade_summary(t, ["symbol"])
    return x.select("symbol", "n_trades", rd("win_rate", 6).alias("win_rate"), rd("profit_factor").alias("profit_factor"), rd("mean_pnl", 2).alias("mean_pnl"), rd("best", 2).alias("best"))


@query("backtest_walk_forward", f"""WITH {RET} SELECT strategy, CAST(floor((rn-252-1)/63) AS BIGINT) AS block, count(r) AS n, {R('avg(r)', 'mean', 6)}, {R('CASE WHEN count(r)<2 THEN 0 ELSE (avg(r)-0.02/252)/stddev_samp(r)*sqrt(252) END', 'sharpe')}, {R('exp(sum(ln(1+r)))-1', 'total_return')} FROM eq WHERE rn>252 GROUP BY ALL""")
def _(s, d):
    x = RK.walk_forward(returns(s, d))
    return x.select("strategy", "block", "n", rd("mean", 6).alias("mean"), rd("sharpe").alias("sharpe"), rd("total_return").alias("total_return"))
