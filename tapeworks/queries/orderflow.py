"""Order flow over event ticks and order messages."""
from __future__ import annotations

from pyspark.sql import functions as F

from tapeworks.operators import orderflow as OF
from tapeworks.operators import orderbook as OB
from tapeworks.plans.panel import Panel, day_bucket
from tapeworks.queries import query
from tapeworks.queries.common import ORDERS_EV, R, RS, TICKS, rcols, rd
from tapeworks.queries.orderbook import BOOK, CHG
from tapeworks.sources import adapters as A

W = "PARTITION BY symbol ORDER BY ts, trade_id"
SV = "CASE WHEN side='buy' THEN volume ELSE -volume END"


def tk(s, d):
    return A.ticks(s, d)


@query("flow_trade_classification", f"""WITH {BOOK}, {TICKS}, m AS (SELECT symbol, ts, (bid+ask)/2 AS mid FROM bb), t AS (SELECT trade_id, symbol%5 AS symbol, ts, price FROM ticks) SELECT trade_id, CASE WHEN mid IS NULL THEN NULL WHEN price>=mid THEN 'buy' ELSE 'sell' END AS side FROM t ASOF LEFT JOIN m ON t.symbol=m.symbol AND t.ts>=m.ts""")
def _(s, d):
    t = tk(s, d).withColumn("symbol", F.col("symbol") % 5).drop("side")
    m = A.book_snapshots(s, d).select("symbol", "ts", OB.mid().alias("mid"))
    return OF.classify_trades(t, m, day_bucket()).select("trade_id", "side")


DM = TICKS + f""", dm AS (SELECT trade_id, symbol, ts, price, sum({SV}) OVER ({W} ROWS UNBOUNDED PRECEDING) AS cum_delta, sum(CASE WHEN side='buy' THEN volume ELSE 0 END) OVER w AS b, sum(CASE WHEN side='buy' THEN 0 ELSE volume END) OVER w AS s, row_number() OVER ({W}) AS rn FROM ticks WINDOW w AS ({W} ROWS 49 PRECEDING)),
 d2 AS (SELECT *, b-s AS nd, b/(b+s) AS ratio, abs(b-s)/(b+s) AS strength FROM dm), d3 AS (SELECT *, (nd - avg(nd) OVER w)/(abs(avg(nd) OVER w)+1e-6) AS momentum FROM d2 WINDOW w AS ({W} ROWS 9 PRECEDING))"""


@query("flow_delta_metrics", f"WITH {DM} SELECT trade_id, {R('cum_delta')}, {R('nd', 'net_delta')}, {R('ratio', 'delta_ratio', 6)}, {R('strength', 'strength', 6)}, {R('CASE WHEN abs(momentum)<1000 THEN momentum END', 'momentum', 4)} FROM d3")
def _(s, d):
    m = OF.delta_metrics(tk(s, d), day_bucket(), rows=500)
    return m.select("trade_id", rd("cum_delta").alias("cum_delta"), rd("net_delta").alias("net_delta"), rd("delta_ratio", 6).alias("delta_ratio"), rd("strength", 6).alias("strength"), rd(F.when(F.abs("momentum") < 1000, F.col("momentum")), 4).alias("momentum"))


@query("flow_delta_patterns", f"""WITH {DM}, p AS (SELECT *, sum(CASE WHEN ratio>0.7::DOUBLE THEN 1 ELSE 0 END) OVER w11 AS nb, sum(CASE WHEN ratio<1::DOUBLE-0.7::DOUBLE THEN 1 ELSE 0 END) OVER w11 AS ns, avg(momentum) OVER w5 - avg(momentum) OVER e AS acc, regr_slope(price, rn) OVER w30 AS pt, regr_slope(cum_delta, rn) OVER w30 AS dt
 FROM d3 WINDOW w11 AS ({W} ROWS 10 PRECEDING), w5 AS ({W} ROWS 4 PRECEDING), e AS ({W} ROWS BETWEEN 14 PRECEDING AND 10 PRECEDING), w30 AS ({W} ROWS 29 PRECEDING))
 SELECT trade_id, CAST(nb>=7 AND rn>10 AS INTEGER) AS buy_imbalance, CAST(ns>=7 AND rn>10 AND nb<7 AS INTEGER) AS sell_imbalance, CAST(coalesce(rn>=30 AND pt>0 AND dt < -0.1,false) AS INTEGER) AS bear_divergence, CAST(coalesce(rn>=30 AND pt<0 AND dt>0.1,false) AS INTEGER) AS bull_divergence FROM p""")
def _(s, d):
    m = OF.delta_patterns(OF.delta_metrics(tk(s, d), day_bucket(), position="place"), day_bucket(), position="place")
    return m.select("trade_id", "buy_imbalance", "sell_imbalance", "bear_divergence", "bull_divergence")


@query("flow_vpin", f"WITH {DM} SELECT trade_id, {R('strength', 'vpin', 6)} FROM d3")
def _(s, d):
    return OF.delta_metrics(tk(s, d), day_bucket()).select("trade_id", rd("strength", 6).alias("vpin"))


DB = TICKS + f""", cd AS (SELECT *, sum({SV}) OVER ({W} ROWS UNBOUNDED PRECEDING) AS c FROM ticks), db AS (SELECT symbol, date_trunc('day', ts)::TIMESTAMP AS ts, arg_min(c, row(ts, trade_id)) AS d_open, max(c) AS d_high, min(c) AS d_low, arg_max(c, row(ts, trade_id)) AS d_close, sum(CASE WHEN side='buy' THEN volume ELSE 0 END) AS buy_volume, max(price) AS high, min(price) AS low FROM cd GROUP BY symbol, date_trunc('day', ts))"""


@query("flow_delta_bars", f"WITH {DB} SELECT symbol, ts, {RS(['d_open', 'd_high', 'd_low', 'd_close', 'buy_volume'])} FROM db")
def _(s, d):
    return rcols(OF.delta_bars(tk(s, d), "1 day", day_bucket()), ["symbol", "ts"], ["d_open", "d_high", "d_low", "d_close", "buy_volume"])


@query("flow_delta_profile_top", f"WITH {TICKS}, p AS (SELECT symbol, round(price/10)*10 AS level, sum({SV}) AS delta, sum(volume) AS volume, count(*) AS n, avg(volume) AS ms FROM ticks GROUP BY symbol, round(price/10)*10) SELECT symbol, {R('level')}, {R('delta')}, {R('volume')}, n, {R('ms', 'mean_size')}, CAST(row_number() OVER (PARTITION BY symbol ORDER BY volume DESC, level) AS INTEGER) AS rank FROM p QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY volume DESC, level) <= 5")
def _(s, d):
    return rcols(OF.top_levels(OF.delta_profile(tk(s, d), 10.0), 5), ["symbol", "n", "rank"], ["level", "delta", "volume", "mean_size"])


def _div_sql():
    def side(px, dx, pc, a, b):
        cmp = ">" if px == "high" else "<"
        f = "max" if px == "high" else "min"
        return f"""p AS (SELECT symbol, ts, {px} AS price FROM (SELECT *, {f}({px}) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS b, {f}({px}) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS a FROM db) WHERE {px} {cmp} a AND {px} {cmp} b),
 q AS (SELECT symbol, ts, d_close AS delta FROM (SELECT *, {f}(d_close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS b, {f}(d_close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS a FROM db) WHERE d_close {cmp} a AND d_close {cmp} b),
 j AS (SELECT p.symbol, p.ts, p.price, q.delta FROM p JOIN q ON p.symbol=q.symbol QUALIFY row_number() OVER (PARTITION BY p.symbol, p.ts ORDER BY abs(epoch(p.ts)-epoch(q.ts)), q.ts)=1),
 k AS (SELECT *, lag(price) OVER (PARTITION BY symbol ORDER BY ts) AS pp, lag(delta) OVER (PARTITION BY symbol ORDER BY ts) AS pd FROM j)
 SELECT symbol, ts, price, delta, CASE WHEN price>pp AND delta<pd THEN '{a}' ELSE '{b}' END AS kind FROM k WHERE (price>pp AND delta<pd) OR (price<pp AND delta>pd)"""
    return f"(WITH {DB}, {side('high', 0, 0, 'bearish_regular', 'bearish_hidden')}) UNION ALL (WITH {DB}, {side('low', 0, 0, 'bullish_hidden', 'bullish_regular')})"


@query("flow_divergences", _div_sql())
def _(s, d):
    return OF.divergences(OF.delta_bars(tk(s, d), "1 day", day_bucket())).select("symbol", "ts", "price", "delta", "kind")


@query("flow_delta_rsi", f"WITH {DB}, x AS (SELECT symbol, ts, d_close - lag(d_close) OVER s AS c, row_number() OVER s AS rn FROM db WINDOW s AS (PARTITION BY symbol ORDER BY ts)) SELECT symbol, ts, {R('CASE WHEN rn>7 THEN CASE WHEN avg(greatest(c,0)) OVER w=0 AND avg(greatest(-c,0)) OVER w=0 THEN 50 WHEN avg(greatest(-c,0)) OVER w=0 THEN 100 ELSE 100-100/(1+avg(greatest(c,0)) OVER w/nullif(avg(greatest(-c,0)) OVER w,0)) END END', 'delta_rsi')} FROM x WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 6 PRECEDING)")
def _(s, d):
    from tapeworks.operators.indicators import rsi
    return rsi(OF.delta_bars(tk(s, d), "1 day", day_bucket()), 7, "d_close", out="delta_rsi").select("symbol", "ts", rd("delta_rsi").alias("delta_rsi"))


FP = TICKS + """, fp AS (SELECT event_type AS symbol, date_trunc('day', ts)::TIMESTAMP AS ts, CAST(round(price/20) AS BIGINT) AS level, sum(CASE WHEN side='buy' THEN volume ELSE 0 END) AS buy, sum(CASE WHEN side='buy' THEN 0 ELSE volume END) AS sell, count(*) AS n FROM (SELECT *, symbol%4 AS g FROM ticks) GROUP BY event_type, date_trunc('day', ts), round(price/20)),
 fc AS (SELECT *, buy+sell AS volume, buy-sell AS delta, CASE WHEN buy/(buy+sell)>=.8 THEN 'strong_buy' WHEN buy/(buy+sell)>=.65 THEN 'buy' WHEN buy/(buy+sell)<=.2 THEN 'strong_sell' WHEN buy/(buy+sell)<=.35 THEN 'sell' ELSE 'neutral' END AS imbalance FROM fp)"""
FP = FP.replace("event_type AS symbol", "g AS symbol").replace("GROUP BY event_type,", "GROUP BY g,")


def fpt(s, d):
    return OF.footprint(tk(s, d).withColumn("symbol", F.col("symbol") % 4), "1 day", 20.0)


@query("flow_footprint", f"WITH {FP} SELECT symbol, ts, level, {R('buy')}, {R('sell')}, n, imbalance FROM fc")
def _(s, d):
    return fpt(s, d).select("symbol", "ts", "level", rd("buy").alias("buy"), rd("sell").alias("sell"), "n", "imbalance")


@query("flow_footprint_patterns", f"""WITH {FP}, b AS (SELECT symbol, ts, sum(delta) AS bd, max(level) AS hi, min(level) AS lo, count(*) AS nl, quantile_cont(volume,.3) AS p30 FROM fc GROUP BY ALL), b2 AS (SELECT *, lag(bd) OVER s AS pd, lag(ts) OVER s AS pts, lead(ts) OVER s AS nts FROM b WINDOW s AS (PARTITION BY symbol ORDER BY ts)),
 j AS (SELECT fc.*, hi, lo, nl, p30, pd, pts, nts, CASE WHEN imbalance IN ('buy','strong_buy') THEN 1 WHEN imbalance IN ('sell','strong_sell') THEN -1 ELSE 0 END AS sd FROM fc JOIN b2 USING (symbol, ts)), i AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY level) - row_number() OVER (PARTITION BY symbol, ts, sd ORDER BY level) AS isl,
 lag(ts) OVER (PARTITION BY symbol, level ORDER BY ts) AS lp, lead(ts) OVER (PARTITION BY symbol, level ORDER BY ts) AS ln FROM j), c AS (SELECT *, count(*) OVER (PARTITION BY symbol, ts, sd, isl) AS cl FROM i)
 SELECT symbol, ts, level, CAST(coalesce(buy>2*sell AND pd<0,false) AS INTEGER) AS buy_absorption, CAST(coalesce(sell>2*buy AND buy>0 AND pd>0,false) AS INTEGER) AS sell_absorption, CASE WHEN sd<>0 AND cl>=3 THEN cl ELSE 0 END AS cluster,
 CAST(pts IS NOT NULL AND nts IS NOT NULL AND lp IS DISTINCT FROM pts AND ln IS DISTINCT FROM nts AS INTEGER) AS single_print, CAST(nl>=5 AND level=hi AND volume<=p30 AS INTEGER) AS poor_high, CAST(nl>=5 AND level=lo AND volume<=p30 AS INTEGER) AS poor_low FROM c""")
def _(s, d):
    return OF.footprint_patterns(fpt(s, d))


@query("flow_volume_nodes", f"WITH {FP}, g AS (SELECT symbol, level, sum(volume) AS volume, sum(delta) AS delta, count(*) AS bars FROM fc GROUP BY ALL) SELECT symbol, level, {R('volume')}, {R('delta')}, bars, CASE WHEN delta>0 THEN 'bullish' WHEN delta<0 THEN 'bearish' ELSE 'neutral' END AS kind FROM g QUALIFY volume > 2*avg(volume) OVER (PARTITION BY symbol) AND bars>=3")
def _(s, d):
    return rcols(OF.volume_nodes(fpt(s, d)), ["symbol", "level", "bars", "kind"], ["volume", "delta"])


@query("flow_structure_levels", f"""WITH {FP}, g AS (SELECT symbol, level, sum(volume) AS volume FROM fc GROUP BY ALL), k AS (SELECT *, coalesce(sum(volume) OVER (PARTITION BY symbol ORDER BY volume DESC, level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS bf, sum(volume) OVER (PARTITION BY symbol) AS tot FROM g), t AS (SELECT * FROM k WHERE bf<0.5*tot),
 n AS (SELECT *, coalesce(CAST(level-lag(level) OVER (PARTITION BY symbol ORDER BY level)>1 AS INTEGER),1) AS nw FROM t), z AS (SELECT *, sum(nw) OVER (PARTITION BY symbol ORDER BY level ROWS UNBOUNDED PRECEDING) AS zn FROM n) SELECT symbol, min(level) AS low, max(level) AS high, {R('sum(volume)', 'volume')}, count(*) AS levels FROM z GROUP BY symbol, zn""")
def _(s, d):
    return rcols(OF.structure_levels(fpt(s, d), share=0.5, merge=1), ["symbol", "low", "high", "levels"], ["volume"])


PLC = ORDERS_EV + """, pl AS (SELECT *, last_value(CASE WHEN event_type='place' THEN ts END IGNORE NULLS) OVER w AS pts, last_value(CASE WHEN event_type='place' THEN size END IGNORE NULLS) OVER w AS psize FROM oev WINDOW w AS (PARTITION BY order_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)), mz AS (SELECT avg(size) AS m FROM oev)"""


@query("flow_quick_cancel", f"""WITH {PLC}, q AS (SELECT *, (epoch_us(ts)-epoch_us(pts))/1e6 AS hold FROM pl, mz WHERE event_type='cancel' AND pts IS NOT NULL), c AS (SELECT *, 0.6*(1-hold/50000)+0.4*least(psize/(m+1e-6),5)/5 AS cf FROM q WHERE hold<=50000)
 SELECT event_id, {R('hold', 'hold', 3)}, {R('cf', 'confidence', 6)}, {R('cf*CASE WHEN psize>5*m THEN 1.0 ELSE 0.7 END', 'severity', 6)} FROM c WHERE cf>=0.5""")
def _(s, d):
    q = OF.quick_cancels(A.order_events(s, d), day_bucket(), 50000.0, 0.5)
    return q.select("event_id", rd("hold", 3).alias("hold"), rd("confidence", 6).alias("confidence"), rd("severity", 6).alias("severity"))


@query("flow_layering", f"""WITH {PLC}, w AS (SELECT event_id, account_id, len(list_distinct(list(price) OVER w)) AS prices, count(*) OVER w AS orders, sum(size) OVER w AS total, (epoch_us(max(ts) OVER w)-epoch_us(min(ts) OVER w))/1e6 AS span FROM oev WHERE event_type='place' WINDOW w AS (PARTITION BY account_id, side ORDER BY ts RANGE BETWEEN INTERVAL 86399999999 MICROSECOND PRECEDING AND CURRENT ROW)),
 c AS (SELECT w.*, least(prices/5.0*0.3+total/(m*10)*0.4+(1-span/86400.0)*0.3,1) AS cf FROM w, mz WHERE prices>=3 AND total>3*m AND span<86400) SELECT event_id, account_id, CAST(prices AS INTEGER) AS prices, orders, {R('total')}, {R('span', 'span', 3)}, {R('cf', 'confidence', 6)} FROM c WHERE cf>=0.3""")
def _(s, d):
    l = OF.layering(A.order_events(s, d), 0.3, 86400.0, 86400.0)
    return l.select("event_id", "account_id", "prices", "orders", rd("total").alias("total"), rd("span", 3).alias("span"), rd("confidence", 6).alias("confidence"))


@query("flow_quote_stuffing", f"""WITH {PLC}, w AS (SELECT event_id, symbol, count(*) OVER w AS events, sum(CASE WHEN event_type='place' THEN 1 ELSE 0 END) OVER w AS places, sum(CASE WHEN event_type='cancel' THEN 1 ELSE 0 END) OVER w AS cancels FROM oev WINDOW w AS (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL 7199999999 MICROSECOND PRECEDING AND CURRENT ROW))
 SELECT event_id, symbol, events, CAST(places AS BIGINT) AS places, CAST(cancels AS BIGINT) AS cancels, {R('least(events/50.0,1)', 'confidence', 6)} FROM w WHERE events>5 AND cancels>0.7*places""")
def _(s, d):
    q = OF.quote_stuffing(A.order_events(s, d), ["symbol"], 5, 7200.0)
    return q.select("event_id", "symbol", "events", "places", "cancels", rd("confidence", 6).alias("confidence"))


@query("flow_momentum_ignition", f"""WITH {PLC}, w AS (SELECT event_id, symbol, side, size, event_type, count(CASE WHEN event_type='fill' THEN 1 END) OVER w AS fills, arg_max(CASE WHEN event_type='fill' THEN price END, CASE WHEN event_type='fill' THEN ts END) OVER w - arg_min(CASE WHEN event_type='fill' THEN price END, CASE WHEN event_type='fill' THEN ts END) OVER w AS trend, max(CASE WHEN event_type='fill' THEN price END) OVER w - min(CASE WHEN event_type='fill' THEN price END) OVER w AS move FROM oev WINDOW w AS (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL 43199999999 MICROSECOND PRECEDING AND CURRENT ROW)),
 c AS (SELECT *, least(size/(m*10)*0.5+coalesce(abs(trend)/nullif(move,0),0)*0.5,0.9) AS cf FROM w, mz WHERE event_type='place' AND size>=1.5*m AND fills>=3 AND trend<>0 AND (side='buy')=(trend>0)) SELECT event_id, symbol, {R('trend')}, {R('move')}, {R('cf', 'confidence', 6)} FROM c WHERE cf>=0.2""")
def _(s, d):
    q = OF.momentum_ignition(A.order_events(s, d), 0.2, 43200.0, 1.5)
    return q.select("event_id", "symbol", rd("trend").alias("trend"), rd("move").alias("move"), rd("confidence", 6).alias("confidence"))


@query("flow_ping_pong", f"""WITH {ORDERS_EV}, l AS (SELECT *, lead(event_type) OVER w AS ne, lead(order_id) OVER w AS no, lead(ts) OVER w AS nt, lead(event_id) OVER w AS ni FROM oev WINDOW w AS (PARTITION BY account_id ORDER BY ts, event_id)), c AS (SELECT account_id, nt AS ts, ni AS event_id, (epoch_us(nt)-epoch_us(ts))/1e6 AS gap FROM l WHERE event_type='place' AND ne='cancel' AND no=order_id),
 w AS (SELECT *, count(*) OVER w AS n, avg(gap) OVER w AS mg FROM c WINDOW w AS (PARTITION BY account_id ORDER BY ts RANGE BETWEEN INTERVAL 863999999999 MICROSECOND PRECEDING AND CURRENT ROW)) SELECT account_id, event_id, n, {R('mg', 'mean_gap', 3)} FROM w WHERE n>=2""")
def _(s, d):
    o = A.order_events(s, d)
    # slow tape: scan ten-day windows and keep every account with two cycles
    q = OF.ping_pong_windows(o, day_bucket(), 864000.0)
    return q.where("n >= 2").select("account_id", "event_id", "n", rd("mean_gap", 3).alias("mean_gap"))


@query("flow_account_profiles", f"""WITH {PLC}, g AS (SELECT account_id, count(*) AS events, avg(CASE WHEN event_type='cancel' THEN 1.0 ELSE 0.0 END) AS cr, avg(size) AS ms, count(DISTINCT price) AS levels, avg(CASE WHEN event_type='cancel' AND pts IS NOT NULL THEN (epoch_us(ts)-epoch_us(pts))/1e6 END) AS mh FROM pl GROUP BY 1)
 SELECT account_id, events, {R('cr', 'cancel_rate', 6)}, {R('ms', 'mean_size')}, levels, {R('mh', 'mean_hold', 2)}, {R('least(CASE WHEN cr>.8 THEN .4 ELSE cr*.4 END + CASE WHEN mh<5 THEN .3 ELSE 0 END + least(events/100.0,1)*.3,1)', 'suspicion', 6)} FROM g""")
def _(s, d):
    a = OF.account_profiles(A.order_events(s, d), day_bucket())
    return a.select("account_id", "events", rd("cancel_rate", 6).alias("cancel_rate"), rd("mean_size").alias("mean_size"), "levels", rd("mean_hold", 2).alias("mean_hold"), rd("suspicion", 6).alias("suspicion"))


@query("flow_signal_report", f"""WITH {ORDERS_EV}, x AS (SELECT event_type AS kind, CASE WHEN price/100>.8 THEN 'high' WHEN price/100>.5 THEN 'medium' ELSE 'low' END AS level, date_trunc('hour', ts)::TIMESTAMP AS hour, price/100 AS s FROM oev) SELECT kind, level, hour, count(*) AS n, {R('avg(s)', 'mean_severity', 6)} FROM x GROUP BY ROLLUP (kind, level, hour)""")
def _(s, d):
    x = A.order_events(s, d).select("ts", F.col("event_type").alias("kind"), (F.col("price") / 100).alias("severity"))
    return rcols(OF.signal_report(x), ["kind", "level", "hour", "n"], ["mean_severity"], 6)


@query("flow_iceberg_levels", f"""WITH {CHG}, r AS (SELECT *, (epoch_us(ts)-epoch_us(lag(ts) OVER (PARTITION BY symbol, side, price ORDER BY ts)))/1e6 AS iv FROM ch WHERE prev_qty>0 AND qty<>prev_qty AND qty>0), st AS (SELECT avg(qty) AS m, stddev_pop(qty) AS sd FROM ch WHERE qty>0),
 g AS (SELECT symbol, side, price, count(*) AS refreshes, avg(iv) AS mi, stddev_pop(iv) AS si, avg(qty) AS ms, stddev_pop(qty) AS sq, sum(qty) AS tv, max(qty) AS mx FROM r GROUP BY ALL), h AS (SELECT *, greatest(1-coalesce(si/(mi+1e-6),0),0) AS reg FROM g, st)
 SELECT symbol, side, price, refreshes, {R('mi', 'mean_interval', 2)}, {R('CASE WHEN mi IS NULL THEN 1 ELSE reg END', 'regularity', 5)}, {R('ms', 'mean_size')}, {R('tv', 'turnover')}, {R('least(refreshes/10.0*0.4+CASE WHEN mi IS NULL THEN 1 ELSE reg END*0.3+least(ms/(m+1e-6),3)/3*0.3,1)', 'confidence', 5)}, CAST((mx-m)/sd>2 AS INTEGER) AS size_anomaly, CAST(tv/mx>2 AS INTEGER) AS absorbing FROM h""")
def _(s, d):
    l = OF.iceberg_levels(OB.level_changes(A.book_snapshots(s, d)))
    return l.select("symbol", "side", "price", "refreshes", rd("mean_interval", 2).alias("mean_interval"), rd("regularity", 5).alias("regularity"), rd("mean_size").alias("mean_size"), rd("turnover").alias("turnover"), rd("confidence", 5).alias("confidence"), "size_anomaly", "absorbing")


@query("flow_iceberg_calibration", f"WITH {CHG} SELECT symbol, {R('greatest(2, 2+stddev_pop(qty)/avg(qty))', 'multiplier', 6)} FROM ch WHERE qty>0 GROUP BY 1")
def _(s, d):
    return rcols(OF.calibrate_multiplier(OB.level_changes(A.book_snapshots(s, d))), ["symbol"], ["multiplier"], 6)
