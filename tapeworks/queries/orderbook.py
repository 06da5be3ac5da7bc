"""Order-book snapshots built from events."""
from __future__ import annotations

from pyspark.sql import functions as F

from tapeworks.operators import orderbook as OB
from tapeworks.plans.panel import Panel, day_bucket
from tapeworks.queries import query
from tapeworks.queries.common import R, RS, TICKS, rcols, rd
from tapeworks.sources import adapters as A

BOOK = """bk0 AS (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k FROM events), bl AS (SELECT k%5 AS symbol, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS ts, CASE WHEN k%2=0 THEN 'bid' ELSE 'ask' END AS side, ceil(value/5) AS j, sum(CAST(k+1 AS DOUBLE)) AS qty FROM bk0 GROUP BY ALL),
 ok AS (SELECT symbol, ts FROM bl GROUP BY ALL HAVING count(DISTINCT side)=2), lv AS (SELECT bl.symbol, bl.ts, side, CASE side WHEN 'bid' THEN 100-0.5*j ELSE 100+0.5*j END::DOUBLE AS price, qty, row_number() OVER (PARTITION BY bl.symbol, bl.ts, side ORDER BY j) AS lvl FROM bl JOIN ok USING (symbol, ts)),
 bb AS (SELECT symbol, ts, max(CASE WHEN side='bid' THEN price END) AS bid, min(CASE WHEN side='ask' THEN price END) AS ask FROM lv GROUP BY ALL), l AS (SELECT lv.*, bid, ask, (bid+ask)/2 AS mid FROM lv JOIN bb USING (symbol, ts))"""
K = ["symbol", "ts"]


@query("book_spread", f"WITH {BOOK}, s AS (SELECT symbol, ts, ask-bid AS spread, 100*(ask-bid)/((bid+ask)/2) AS sp, (bid+ask)/2 AS mid FROM bb) SELECT symbol, ts, {R('spread')}, {R('sp', 'spread_pct', 6)}, {R('mid')}, {R('CASE WHEN count(*) OVER w=20 THEN stddev_pop(sp) OVER w END', 'spread_vol', 6)} FROM s WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)")
def _(s, d):
    b = OB.spread_volatility(A.book_snapshots(s, d).select("symbol", "ts", *OB.spread_columns()))
    return b.select(*K, rd("spread").alias("spread"), rd("spread_pct", 6).alias("spread_pct"), rd("mid").alias("mid"), rd("spread_vol", 6).alias("spread_vol"))


@query("book_effective_spread", f"""WITH {BOOK}, c AS (SELECT *, coalesce(sum(qty) OVER (PARTITION BY symbol, ts, side ORDER BY lvl ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS before FROM l WHERE side='ask'), f AS (SELECT symbol, ts, max(mid) AS mid, sum(qty) AS tot, sum(greatest(least(qty, 150-before),0)*price) AS cost FROM c GROUP BY ALL)
 SELECT symbol, ts, {R('CASE WHEN tot<150 THEN 100 ELSE 200*abs(cost/150-mid)/mid END', 'effective_spread', 5)} FROM f""")
def _(s, d):
    return A.book_snapshots(s, d).select(*K, rd(OB.effective_spread(F.lit(150.0), "buy"), 5).alias("effective_spread"))


@query("book_realized_spread", f"""WITH {BOOK}, {TICKS}, m AS (SELECT symbol, ts, (bid+ask)/2 AS mid FROM bb), t AS (SELECT trade_id, symbol%5 AS symbol, ts + INTERVAL 3600 SECOND AS ts2, price, side FROM ticks) SELECT trade_id, {R("200*CASE WHEN side='buy' THEN 1 ELSE -1 END*(m.mid-t.price)/t.price", 'realized_spread', 3)} FROM t ASOF LEFT JOIN m ON t.symbol=m.symbol AND t.ts2<=m.ts""")
def _(s, d):
    t = A.ticks(s, d).withColumn("symbol", F.col("symbol") % 5)
    m = A.book_snapshots(s, d).select("symbol", "ts", OB.mid().alias("mid"))
    return OB.realized_spread(t, m, 3600, day_bucket()).select("trade_id", rd("realized_spread", 3, infinite=True).alias("realized_spread"))


@query("book_depth_imbalance", f"""WITH {BOOK}, a AS (SELECT symbol, ts, sum(CASE WHEN side='bid' AND lvl<=10 THEN qty ELSE 0 END) AS bd, sum(CASE WHEN side='ask' AND lvl<=10 THEN qty ELSE 0 END) AS ad, sum(CASE WHEN side='bid' AND lvl<=5 THEN qty ELSE 0 END) AS b5, sum(CASE WHEN side='ask' AND lvl<=5 THEN qty ELSE 0 END) AS a5,
 sum(CASE WHEN side='bid' AND lvl<=10 THEN qty*greatest(1-abs(price-mid)/mid,0) ELSE 0 END) AS wb, sum(CASE WHEN side='ask' AND lvl<=10 THEN qty*greatest(1-abs(price-mid)/mid,0) ELSE 0 END) AS wa, sum(CASE WHEN lvl<=10 THEN price*qty ELSE 0 END)/sum(CASE WHEN lvl<=10 THEN qty ELSE 0 END) AS wm FROM l GROUP BY ALL)
 SELECT symbol, ts, {R('bd', 'bid_depth')}, {R('ad', 'ask_depth')}, {R('(bd-ad)/(bd+ad)', 'depth_imbalance', 6)}, {R('(b5-a5)/(b5+a5)', 'imbalance_5', 6)}, {R('(wb-wa)/(wb+wa)', 'weighted_imbalance', 6)}, {R('wm', 'weighted_mid', 5)} FROM a""")
def _(s, d):
    b = OB.feature_row(A.book_snapshots(s, d))
    return b.select(*K, rd("bid_depth").alias("bid_depth"), rd("ask_depth").alias("ask_depth"), *[rd(c, 6).alias(c) for c in ("depth_imbalance", "imbalance_5", "weighted_imbalance")], rd("weighted_mid", 5).alias("weighted_mid"))


@query("book_depth_levels", f"WITH {BOOK} SELECT symbol, ts, side, CAST(lvl-1 AS INTEGER) AS level, price, qty FROM lv WHERE lvl<=10")
def _(s, d):
    return OB.depth_per_level(A.book_snapshots(s, d), K)


@query("book_depth_slope", f"WITH {BOOK} SELECT symbol, ts, {R('CASE WHEN sum(CASE WHEN side=' + chr(39) + 'bid' + chr(39) + ' THEN 1 ELSE 0 END)<2 THEN 0 ELSE coalesce(regr_slope(CASE WHEN side=' + chr(39) + 'bid' + chr(39) + ' THEN ln(greatest(qty,1e-10)) END, CASE WHEN side=' + chr(39) + 'bid' + chr(39) + ' THEN abs(price-mid)/mid END),0) END', 'bid_slope', 3)} FROM l WHERE lvl<=10 GROUP BY ALL")
def _(s, d):
    return A.book_snapshots(s, d).select(*K, rd(OB.depth_slope("bids"), 3).alias("bid_slope"))


@query("book_toxicity", f"""WITH {BOOK}, {TICKS}, t AS (SELECT symbol%5 AS symbol, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS ts, sum(CASE WHEN side='buy' THEN volume ELSE 0 END) AS b, sum(CASE WHEN side='buy' THEN 0 ELSE volume END) AS s FROM ticks GROUP BY ALL), p AS (SELECT symbol, ts, sum(qty) AS p FROM lv GROUP BY ALL)
 SELECT symbol, ts, {R('CASE WHEN coalesce(b,0)+coalesce(s,0)=0 THEN 0.5 ELSE least((b+s)/(p+b+s)*(1+abs((b-s)/(b+s))),1) END', 'toxicity', 6)} FROM p LEFT JOIN t USING (symbol, ts)""")
def _(s, d):
    t = A.ticks(s, d)
    g = t.groupBy((F.col("symbol") % 5).alias("symbol"), F.window("ts", "6 hours")["start"].alias("ts")).agg(F.sum(F.when(F.col("side") == "buy", F.col("volume")).otherwise(0.0)).alias("b"), F.sum(F.when(F.col("side") == "buy", 0.0).otherwise(F.col("volume"))).alias("s"))
    p = A.book_snapshots(s, d).select(*K, (OB.volume("bids") + OB.volume("asks")).alias("p"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return p.join(g, K, "left").select(*K, rd(OB.toxicity(z("b"), z("s"), F.col("p")), 6).alias("toxicity"))


@query("book_microstructure_noise", f"WITH {BOOK}, m AS (SELECT symbol, ts, (bid+ask)/2 AS mid FROM bb), r AS (SELECT symbol, ts, ln(mid/lag(mid) OVER (PARTITION BY symbol ORDER BY ts)) AS r FROM m) SELECT symbol, ts, {R('CASE WHEN count(r) OVER w=20 THEN var_pop(r)OVER w*1e6 END', 'noise', 4)} FROM r WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)")
def _(s, d):
    n = OB.microstructure_noise(A.book_snapshots(s, d).select(*K, OB.mid().alias("mid")))
    return n.select(*K, rd(F.col("noise") * 1e6, 4).alias("noise"))


@query("book_walls", f"""WITH {BOOK}, a AS (SELECT symbol, ts, avg(qty) AS m FROM l WHERE side='ask' GROUP BY ALL), w AS (SELECT l.*, m FROM l JOIN a USING (symbol, ts) WHERE side='ask' AND qty>2*m QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY lvl)=1)
 SELECT a.symbol, a.ts, CAST(w.qty IS NOT NULL AS INTEGER) AS present, {R('w.price', 'price')}, {R('100*(w.price-mid)/mid', 'distance', 5)}, {R('w.qty/w.m', 'strength', 6)}, CAST(lvl-1 AS INTEGER) AS level FROM a LEFT JOIN w ON a.symbol=w.symbol AND a.ts=w.ts""")
def _(s, d):
    w = A.book_snapshots(s, d).withColumn("w", OB.wall("asks", 2.0))
    return w.select(*K, "w.present", rd(F.col("w.price")).alias("price"), rd(F.col("w.distance"), 5).alias("distance"), rd(F.col("w.strength"), 6).alias("strength"), "w.level")


CHG = BOOK + """, sq AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM ok), lq AS (SELECT lv.*, n FROM lv JOIN sq USING (symbol, ts)), cu AS (SELECT symbol, n, side, price, qty FROM lq WHERE n>1), pr AS (SELECT symbol, n+1 AS n, side, price, qty FROM lq WHERE n < (SELECT max(n) FROM sq WHERE sq.symbol=lq.symbol)),
 ch0 AS (SELECT coalesce(cu.symbol,pr.symbol) AS symbol, coalesce(cu.n,pr.n) AS n, coalesce(cu.side,pr.side) AS side, coalesce(cu.price,pr.price) AS price, coalesce(pr.qty,0) AS prev_qty, coalesce(cu.qty,0) AS qty FROM cu FULL JOIN pr ON cu.symbol=pr.symbol AND cu.n=pr.n AND cu.side=pr.side AND cu.price=pr.price),
 ch AS (SELECT ch0.*, a.ts, epoch(a.ts)-epoch(b.ts) AS seconds FROM ch0 JOIN sq a ON a.symbol=ch0.symbol AND a.n=ch0.n JOIN sq b ON b.symbol=ch0.symbol AND b.n=ch0.n-1)"""


@query("book_level_changes", f"WITH {CHG} SELECT symbol, ts, side, price, prev_qty, qty, CAST(seconds AS DOUBLE) AS seconds FROM ch")
def _(s, d):
    return OB.level_changes(A.book_snapshots(s, d))


@query("book_absorption_rate", f"WITH {CHG} SELECT symbol, ts, side, {R('sum(greatest(prev_qty-qty,0))/max(seconds)*1000', 'absorption', 4)} FROM ch GROUP BY ALL")
def _(s, d):
    return OB.absorption_rate(A.book_snapshots(s, d)).select(*K, "side", rd(F.col("absorption") * 1000, 4).alias("absorption"))


@query("book_trade_features", f"""WITH {TICKS}, w AS (SELECT trade_id, volume, sum(CASE WHEN side='buy' THEN volume ELSE 0 END) OVER w AS b, sum(volume) OVER w AS v, count(*) OVER w AS n, sum(price*volume) OVER w AS pv, list(volume) OVER w AS l FROM ticks WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 7200 SECOND PRECEDING AND CURRENT ROW))
 SELECT trade_id, {R('b/v', 'buy_share', 6)}, CAST(len(list_filter(l, lambda x: x>10*v/n)) AS INTEGER) AS large_trades, {R('v', 'win_volume')}, n AS win_count, {R('pv/v', 'win_vwap')} FROM w""")
def _(s, d):
    t = OB.trade_features(A.ticks(s, d), 7200, Panel(("event_type",), ("ts", "trade_id")))
    return t.select("trade_id", rd("buy_share", 6).alias("buy_share"), "large_trades", rd("win_volume").alias("win_volume"), "win_count", rd("win_vwap").alias("win_vwap"))


@query("book_liquidity_score", f"""WITH {BOOK}, g AS (SELECT symbol, ts, sum(qty) AS v, least(sum(CASE WHEN side='bid' THEN 1 ELSE 0 END), sum(CASE WHEN side='ask' THEN 1 ELSE 0 END)) AS dp, 10000*(max(ask)-max(bid))/max(mid) AS bps, sum(CASE WHEN side='bid' AND lvl<=10 THEN qty ELSE 0 END) AS b, sum(CASE WHEN side='ask' AND lvl<=10 THEN qty ELSE 0 END) AS a FROM l GROUP BY ALL)
 SELECT symbol, ts, {R("(CASE WHEN v>1e6 THEN 40 WHEN v>1e5 THEN 30 WHEN v>1e4 THEN 20 WHEN v>1e3 THEN 10 ELSE 0 END + CASE WHEN bps<5 THEN 30 WHEN bps<10 THEN 20 WHEN bps<25 THEN 10 ELSE 0 END + CASE WHEN dp>=20 THEN 20 WHEN dp>=15 THEN 15 WHEN dp>=10 THEN 10 WHEN dp>=5 THEN 5 ELSE 0 END + CASE WHEN abs((b-a)/(b+a))<.1 THEN 10 WHEN abs((b-a)/(b+a))<.2 THEN 7 WHEN abs((b-a)/(b+a))<.3 THEN 5 ELSE 0 END)/100.0", 'liquidity')} FROM g""")
def _(s, d):
    return A.book_snapshots(s, d).select(*K, rd(OB.liquidity_score()).alias("liquidity"))


@query("book_state_block", f"""WITH {BOOK}, g AS (SELECT symbol, ts, 100*(max(ask)-max(bid))/max(mid) AS sp, sum(CASE WHEN lvl<=10 THEN qty ELSE 0 END) AS dp, sign(sum(CASE WHEN lvl<=10 THEN CASE WHEN side='bid' THEN qty ELSE -qty END ELSE 0 END)) AS sg FROM l GROUP BY ALL),
 i AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - row_number() OVER (PARTITION BY symbol, sg ORDER BY ts) AS isl FROM g)
 SELECT symbol, ts, {R('coalesce((sp-avg(sp) OVER w)/nullif(stddev_samp(sp) OVER w,0),0)', 'spread_z', 4)}, {R('coalesce((dp-avg(dp) OVER w)/nullif(stddev_samp(dp) OVER w,0),0)', 'depth_z', 5)}, CAST(row_number() OVER (PARTITION BY symbol, sg, isl ORDER BY ts) AS INTEGER) AS imbalance_run FROM i WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 23 PRECEDING)""")
def _(s, d):
    b = OB.state_block(OB.feature_row(A.book_snapshots(s, d)))
    return b.select(*K, rd("spread_z", 4).alias("spread_z"), rd("depth_z", 5).alias("depth_z"), "imbalance_run")
