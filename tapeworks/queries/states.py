"""State-vector blocks over the five regions."""
from __future__ import annotations

import os

from pyspark.sql import functions as F

from tapeworks.operators import indicators as I
from tapeworks.operators import statevector as SV
from tapeworks.operators.bars import trade_bars
from tapeworks.plans.panel import Panel
from tapeworks.queries import query
from tapeworks.queries.common import BARS, R, RS, rcols, rd
from tapeworks.queries.indicators import win
from tapeworks.session import ensure_checkpoint_dir
from tapeworks.sources import adapters as A

REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
RB = """rt AS (SELECT r_name AS symbol, l_shipdate AS ts, l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS item_id, l_suppkey AS sk, l_extendedprice/l_quantity AS price, l_quantity AS volume FROM lineitem JOIN supplier ON l_suppkey=s_suppkey JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey),
 bars AS (SELECT symbol, ts, arg_min(price, row(order_id, line_no, item_id, sk)) AS open, max(price) AS high, min(price) AS low, arg_max(price, row(order_id, line_no, item_id, sk)) AS close, sum(volume) AS volume FROM rt GROUP BY symbol, ts), nb AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM bars)"""


def region_bars(s, d):
    t = A.trades(s, d)
    sp, n, r = A.table(s, d, "supplier"), A.table(s, d, "nation"), A.table(s, d, "region")
    nr = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select("n_nationkey", "r_name")
    sr = sp.join(F.broadcast(nr), sp.s_nationkey == nr.n_nationkey).select("s_suppkey", "r_name")
    x = t.join(sr, t.symbol == sr.s_suppkey).withColumn("sk", F.col("symbol")).withColumn("symbol", F.col("r_name"))
    return trade_bars(x, "1 day", tie=(*A.TRADE_TIE, "sk"))


def zsql(c):
    return f"coalesce(({c}-avg({c}) OVER w24)/(stddev_samp({c}) OVER w24+1e-8),0)"


@query("state_ohlcv_block", f"WITH {RB}, z AS (SELECT symbol, ts, {zsql('close')} AS c, {zsql('volume')} AS v FROM nb {win(24)}) SELECT ts, {R('max(CASE WHEN symbol=' + chr(39) + 'ASIA' + chr(39) + ' THEN c END)', 'asia_close', 5)}, {R('max(CASE WHEN symbol=' + chr(39) + 'EUROPE' + chr(39) + ' THEN v END)', 'europe_volume', 5)} FROM z GROUP BY ts")
def _(s, d):
    b, cols = SV.ohlcv_block(region_bars(s, d))
    w = SV.pivot_block(b, REGIONS, cols)
    return w.select("ts", rd("ASIA_close", 5).alias("asia_close"), rd("EUROPE_volume", 5).alias("europe_volume"))


@query("state_technical_block")
def _(s, d):
    b, cols = SV.technical_block(region_bars(s, d))
    return rcols(b, ["symbol", "ts"], cols, 4)


@query("state_risk_block", f"WITH {RB}, r AS (SELECT *, close/lag(close) OVER s-1 AS r FROM nb {win()}), l AS (SELECT symbol, ts, rn, list_sort(list(r) OVER w30) AS l, 1-close/max(close) OVER w30 AS dd FROM (SELECT * FROM r) {win(30)}) SELECT symbol, ts, {R('CASE WHEN rn>30 THEN -l[1] ELSE 0 END', 'var', 5)}, {R('CASE WHEN rn>30 THEN -l[1] ELSE 0 END', 'cvar', 5)}, {R('dd', 'drawdown', 6)} FROM l".replace("list_sort(list(r) OVER w30)", "list_sort(list_filter(list(r) OVER w30, lambda x: x IS NOT NULL))"))
def _(s, d):
    b, _c = SV.risk_block(region_bars(s, d))
    return b.select("symbol", "ts", rd("var", 5).alias("var"), rd("cvar", 5).alias("cvar"), rd("drawdown", 6).alias("drawdown"))


@query("state_dominance_block", f"WITH {RB}, t AS (SELECT ts, sum(volume) AS tv FROM bars GROUP BY 1), x AS (SELECT symbol, bars.ts, volume/tv AS x FROM bars JOIN t USING (ts)), z AS (SELECT symbol, ts, x, x-lag(x) OVER s AS ch, coalesce((x-avg(x) OVER w20)/(stddev_samp(x) OVER w20+1e-8),0) AS z FROM x {win(20)}) SELECT symbol, ts, {R('x', 'level', 6)}, {R('coalesce(ch,0)', 'change', 6)}, {R('z', 'z', 4)}, CASE WHEN z>1 THEN 1.0::DOUBLE WHEN z<-1 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS regime FROM z")
def _(s, d):
    b = region_bars(s, d)
    t = b.groupBy("ts").agg(F.sum("volume").alias("tv"))
    x, _c = SV.level_block(b.join(t, "ts").withColumn("x", F.col("volume") / F.col("tv")).select("symbol", "ts", "x"), "x")
    return x.select("symbol", "ts", rd("level", 6).alias("level"), rd("change", 6).alias("change"), rd("z", 4).alias("z"), "regime")


@query("state_portfolio_block", f"WITH {RB}, po AS (SELECT symbol, arg_min(close, ts) AS entry, min(ts) AS opened, avg(volume) AS q FROM bars GROUP BY 1), v AS (SELECT symbol, ts, q*close AS v, close/entry-1 AS u, date_diff('day', opened, ts) AS h FROM bars JOIN po USING (symbol)) SELECT symbol, ts, {R('v/sum(abs(v)) OVER (PARTITION BY ts)', 'weight', 6)}, {R('u', 'unrealized', 5)}, {R('h', 'held_days')} FROM v")
def _(s, d):
    b = region_bars(s, d)
    po = b.groupBy("symbol").agg(F.min_by("close", "ts").alias("entry"), F.min("ts").alias("opened"), F.avg("volume").alias("quantity"))
    x = SV.portfolio_block(po, b)
    return x.select("symbol", "ts", rd("weight", 6).alias("weight"), rd("unrealized", 5).alias("unrealized"), rd("held_days").alias("held_days"))


def _assembled(s, d):
    b = region_bars(s, d)
    o, oc = SV.ohlcv_block(b)
    r, rc = SV.risk_block(b)
    return SV.assemble({"ohlcv": SV.pivot_block(o, REGIONS, oc), "risk": SV.pivot_block(r, REGIONS, rc)}, SV.SIZES["v1"])


@query("state_vector_assembly", f"WITH {RB}, z AS (SELECT symbol, ts, {zsql('close')} AS c FROM nb {win(24)}) SELECT ts, CAST(768 AS INTEGER) AS n, {R('coalesce(max(CASE WHEN symbol=' + chr(39) + 'AFRICA' + chr(39) + ' THEN c END),0)', 'africa_close', 3)} FROM z GROUP BY ts")
def _(s, d):
    st, imap = _assembled(s, d)
    at = {(b, c): i for b, c, i in imap}[("ohlcv", "AFRICA_close")]
    return st.select("ts", F.size("state").alias("n"), rd(F.col("state")[at], 3).alias("africa_close"))


@query("state_window_slice", f"WITH {RB} SELECT ts, row_number() OVER (ORDER BY ts)-1 AS pos FROM (SELECT DISTINCT ts FROM bars) QUALIFY pos >= 500 AND pos < 668")
def _(s, d):
    st, _m = _assembled(s, d)
    return SV.slice_windows(st, 500, 668).select("ts", F.col("pos").cast("bigint"))


@query("state_indicator_table", f"WITH {RB} SELECT symbol, ts, {R('close')}, {R('CASE WHEN rn>=20 THEN avg(close) OVER w20 END', 'sma_20')} FROM nb {win(20)}")
def _(s, d):
    ensure_checkpoint_dir(s)
    path = os.path.join(s.sparkContext.getCheckpointDir(), f"indicator-table-{s.sparkContext.applicationId}-{abs(hash(d))}")
    bars = region_bars(s, d)
    I.write_indicator_table(bars, path)
    t = I.lookup_indicators(s, path, bars.select("symbol", "ts"))
    return rcols(t, ["symbol", "ts"], ["close", "sma_20"])


FOUR = REGIONS[:4]


def _history_sql():
    """SQL lists of the volume and history features over the windows below, in the order of the blocks."""
    P = SV.PERIODS
    clip = lambda e, lo, hi: f"greatest(least({e}, {hi}), {lo})"
    v = [f"coalesce({clip(f'volume / (CASE WHEN rn >= {n} THEN avg(volume) OVER w{n} END + 1e-8)', '0.0', '5.0')} / 5, 0.2)" for n in (20, 50)]
    v = [x.replace("greatest(least(", f"CASE WHEN rn >= {n} THEN greatest(least(", 1).replace(") / 5, 0.2)", ") / 5 END, 0.2)") for x, n in zip(v, (20, 50))]
    v += [f"CASE WHEN rn > {n} THEN {clip(f'(volume - lag(volume, {n}) OVER s) / (lag(volume, {n}) OVER s + 1e-8)', '-5.0', '5.0')} / 5 ELSE 0 END" for n in (1, 4, 24)]
    v += ["len(list_filter(list(volume) OVER w169, lambda x: x <= volume)) / len(list(volume) OVER w169)", "CASE WHEN rn >= 20 AND volume > 2 * avg(volume) OVER w20 THEN 1 ELSE 0 END",
          "CASE WHEN rn > 1 THEN coalesce(CASE WHEN isnan(corr(volume, close) OVER w25) THEN 0 ELSE corr(volume, close) OVER w25 END, 0) ELSE 0 END"]
    h = [f"CASE WHEN rn > {q} THEN {clip(f'(close - lag(close, {q}) OVER s) / (lag(close, {q}) OVER s + 1e-8)', '-1.0', '1.0')} ELSE 0 END" for q in P]
    h += [f"CASE WHEN rn > {q} THEN {clip(f'stddev_pop(r) OVER w{q}', '0.0', '1.0')} ELSE 0 END" for q in P]
    h += [f"CASE WHEN rn > {q} THEN {clip(f'(max(high) OVER w{q + 1} - min(low) OVER w{q + 1}) / (close + 1e-8)', '0.0', '1.0')} ELSE 0 END" for q in P]
    h += [f"CASE WHEN rn > {q + 1} THEN {clip('r - lag(r) OVER s', '-1.0', '1.0')} ELSE 0 END" for q in P]
    h += [f"CASE WHEN rn > {q} THEN {clip(f'(volume - lag(volume, {q}) OVER s) / (lag(volume, {q}) OVER s + 1e-8)', '-5.0', '5.0')} / 5 ELSE 0 END" for q in P]
    listed = lambda xs: "[" + ", ".join(f"CAST({x} AS DOUBLE)" for x in xs) + "]"
    wins = sorted({20, 24, 25, 50, 169, *P, *[q + 1 for q in P]})
    ohlcv = [zsql(c) for c in ("open", "high", "low", "close", "volume")]
    return listed(ohlcv), listed(v), listed(h), win(*wins)


def _positions_sql():
    o, v, h, w = _history_sql()
    turn = {"hour": "hour(t)/24.0", "weekday": "(isodow(t)-1)/7.0", "day": "(day(t)-1)/31.0", "month": "(month(t)-1)/12.0"}
    times = ", ".join(f"{f}(2*pi()*CAST({e} AS DOUBLE))" for e in turn.values() for f in ("sin", "cos"))
    times += ", CASE WHEN isodow(t) >= 6 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, 1.0::DOUBLE"
    one = ", ".join("'" + r + "'" for r in FOUR)
    starts, at = {}, 0
    for g, width in SV.LAYOUT.items():
        starts[g], at = at, at + width
    per = lambda g, n: f"SELECT ts, CAST({starts[g]} + (sn-1)*{n} + i - 1 AS INTEGER) AS position, {g}[i] AS x FROM f, range(1, {n + 1}) AS q(i)"
    return f"""WITH {RB}, nr AS (SELECT *, (close - lag(close) OVER (PARTITION BY symbol ORDER BY ts)) / (lag(close) OVER (PARTITION BY symbol ORDER BY ts) + 1e-8) AS r FROM nb WHERE symbol IN ({one})),
 al AS (SELECT symbol, ts, {o} AS ohlcv, {v} AS volume, {h} AS history FROM nr {w}),
 f AS (SELECT *, list_position([{one}], symbol) AS sn FROM al WHERE ts IN (SELECT ts FROM al GROUP BY ts HAVING count(*) = {len(FOUR)})),
 tm AS (SELECT DISTINCT ts, CAST(ts AS TIMESTAMP) AS t FROM f), tl AS (SELECT ts, [{times}] AS x FROM tm),
 held AS ({per('ohlcv', 5)} UNION ALL {per('volume', 8)} UNION ALL {per('history', 45)} UNION ALL SELECT ts, CAST({starts['temporal']} + i - 1 AS INTEGER), x[i] FROM tl, range(1, 11) AS q(i)),
 g AS (SELECT position, count(*) AS n, sum(x) AS total, sum(x * (1 + date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) % 97)) AS dated FROM held GROUP BY 1)
 SELECT CAST(p AS INTEGER) AS position, CASE WHEN g.n IS NULL THEN 1 ELSE 0 END AS padding, (SELECT count(*) FROM tm) AS n, {R('coalesce(total, 0)', 'total', 3)}, {R('coalesce(dated, 0)', 'dated', 2)}
 FROM range(768) AS a(p) LEFT JOIN g ON g.position = p"""


@query("state_vector_positions", _positions_sql())
def _(s, d):
    """Every position of the fixed layout over all times: rows, sum, and a sum weighted by date."""
    b = region_bars(s, d).where(F.col("symbol").isin(FOUR))
    t = b.select("ts").distinct()
    st, imap = SV.laid_out(FOUR, {"ohlcv": SV.ohlcv_block(b), "volume": SV.volume_block(b), "history": SV.history_block(b)}, {"temporal": SV.temporal_block(t)}, kind="double")
    weight = 1 + F.pmod(F.datediff("ts", F.lit("1970-01-01").cast("date")), F.lit(97))
    x = st.select(weight.alias("w"), F.posexplode("state").alias("position", "x")).groupBy("position").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("total"), F.sum(F.col("x") * F.col("w")).alias("dated"))
    m = s.createDataFrame([(i, int(f is None)) for i, _g, _s, f in imap], "position int, padding int")
    return x.join(F.broadcast(m), "position").select("position", "padding", "n", rd("total", 3).alias("total"), rd("dated", 2).alias("dated"))
