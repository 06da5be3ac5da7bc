"""Streaming operators drained over the events table, checked against batch SQL with the same late-data rule."""
from __future__ import annotations

from pyspark.sql import functions as F

from tapeworks.queries import query
from tapeworks.queries.common import ORDERS_EV, R, RS, TICKS, rcols, rd
from tapeworks.queries.sentiment import LEX, LS
from tapeworks.sources import adapters as A
from tapeworks.streaming import flows as FL

EVENT_SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def raw(s, d):
    e = FL.read_files(s, d, EVENT_SCHEMA, "events.parquet")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def ticks(s, d):
    return raw(s, d).select(F.col("user_id").alias("symbol"), "ts", F.col("event_id").alias("trade_id"), F.col("value").alias("price"), (F.get_json_object("props", "$.k").cast("double") + 1).alias("volume"),
                            F.when(F.col("event_type").isin("purchase", "signup"), "buy").otherwise("sell").alias("side"))


def orders(s, d):
    k = F.get_json_object("props", "$.k").cast("bigint")
    kind = F.when(F.col("event_type").isin("purchase", "signup"), "place").when(F.col("event_type") == "click", "fill").otherwise("cancel")
    return raw(s, d).select("ts", "event_id", F.concat_ws("-", F.col("user_id"), k % 3).alias("order_id"), F.col("value").alias("price"), (k + 1).cast("double").alias("size"), kind.alias("event_type"), F.col("user_id").alias("account_id"), (k % 5).alias("symbol"))


WM = lambda hours: f"(SELECT max(ts) - INTERVAL {hours} HOUR FROM events)"
SB = TICKS + f""", sb AS (SELECT symbol, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS ts, arg_min(price, row(ts, trade_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, row(ts, trade_id)) AS close, sum(volume) AS volume, sum(CASE WHEN side='buy' THEN volume ELSE -volume END) AS delta, count(*) AS n FROM ticks GROUP BY symbol, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')), se AS (SELECT * FROM sb WHERE ts + INTERVAL 6 HOUR <= {WM(2)})"""


@query("stream_trade_bars", f"WITH {SB} SELECT symbol, ts, {RS(['open', 'high', 'low', 'close', 'volume', 'delta'])}, n FROM se")
def _(s, d):
    return rcols(FL.drain(FL.trade_bars(ticks(s, d), "6 hours", "2 hours")), ["symbol", "ts", "n"], ["open", "high", "low", "close", "volume", "delta"])


@query("stream_running_delta", f"WITH {SB}, c AS (SELECT symbol, ts, sum(delta) OVER w AS cum_delta FROM se WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)) SELECT symbol, ts, {R('cum_delta')}, {R('max(cum_delta) OVER w', 'session_high')}, {R('min(cum_delta) OVER w', 'session_low')} FROM c WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)")
def _(s, d):
    r = FL.drain(FL.running_delta(FL.next_hop(FL.trade_bars(ticks(s, d), "6 hours", "2 hours").select("symbol", "ts", "delta"))))
    return rcols(r, ["symbol", "ts"], ["cum_delta", "session_high", "session_low"])


@query("stream_sliding_trade_features", f"WITH {TICKS}, x AS (SELECT symbol, unnest([time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 6 HOUR]) AS w, price, volume, side FROM ticks) SELECT symbol, w AS ts, {R('sum(CASE WHEN side=' + chr(39) + 'buy' + chr(39) + ' THEN volume ELSE 0 END)/sum(volume)', 'buy_share', 6)}, {R('sum(volume)', 'volume')}, count(*) AS n, {R('sum(price*volume)/sum(volume)', 'vwap')} FROM x WHERE w + INTERVAL 12 HOUR <= {WM(2)} GROUP BY symbol, w")
def _(s, d):
    x = FL.drain(FL.sliding_trade_features(ticks(s, d), "12 hours", "6 hours", "2 hours"))
    return x.select("symbol", "ts", rd("buy_share", 6).alias("buy_share"), rd("volume").alias("volume"), "n", rd("vwap").alias("vwap"))


@query("stream_quick_cancels", f"WITH {ORDERS_EV} SELECT a.order_id, b.account_id, a.event_id AS p_id, b.event_id AS c_id, a.size AS p_size FROM oev a JOIN oev b ON a.order_id=b.order_id AND a.event_type='place' AND b.event_type='cancel' AND b.ts>=a.ts AND b.ts<=a.ts+INTERVAL 20000 SECOND")
def _(s, d):
    return FL.drain(FL.quick_cancels(orders(s, d), 20000, "1 hour")).select("order_id", "account_id", "p_id", "c_id", "p_size")


@query("stream_event_rates", f"WITH {ORDERS_EV} SELECT symbol, date_trunc('hour', ts)::TIMESTAMP AS ts, count(*) AS events, CAST(sum((event_type='place')::INT) AS BIGINT) AS places, CAST(sum((event_type='cancel')::INT) AS BIGINT) AS cancels FROM oev WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= {WM(2)} GROUP BY symbol, date_trunc('hour', ts)")
def _(s, d):
    return FL.drain(FL.event_rates(orders(s, d), "1 hour", "2 hours"))


@query("stream_burst_sessions", f"WITH {ORDERS_EV}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 8 HOUR THEN 0 ELSE 1 END AS nw FROM oev WINDOW w AS (PARTITION BY account_id ORDER BY ts)), i AS (SELECT *, sum(nw) OVER (PARTITION BY account_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g), a AS (SELECT account_id, min(ts) AS start, max(ts)+INTERVAL 8 HOUR AS e, count(*) AS events, sum(size) AS size FROM i GROUP BY account_id, sid) SELECT account_id, start, e AS \"end\", events, {R('size')} FROM a WHERE e <= {WM(2)}")
def _(s, d):
    b = FL.drain(FL.burst_sessions(orders(s, d), "8 hours", "2 hours"))
    return b.select("account_id", "start", "end", "events", rd("size").alias("size"))


@query("stream_iceberg_refreshes")
def _(s, d):
    o = orders(s, d).select("symbol", F.when(F.col("size") % 2 == 0, "bid").otherwise("ask").alias("side"), F.round("price", -1).alias("price"), "ts", F.col("size").alias("qty"))
    r = FL.drain(FL.iceberg_refreshes(o, "2 hours", 4 * 3600))
    return r.select("symbol", "side", "price", "first_seen", "refreshes", rd("mean_size").alias("mean_size"), rd("turnover").alias("turnover"))


@query("stream_message_scores", f"WITH x AS (SELECT conv_id, turn, role, {LS('text')} AS t FROM conversations) SELECT conv_id, turn, role, {R('t/sqrt(t*t+15)', 'score', 6)} FROM x")
def _(s, d):
    m = FL.read_files(s, d, "conv_id BIGINT, turn BIGINT, role STRING, text STRING", "conversations.parquet")
    return rcols(FL.drain(FL.score_messages(m, "text", LEX).drop("text")), ["conv_id", "turn", "role"], ["score"], 6)


@query("stream_anomaly_flags", f"WITH p AS (SELECT event_type, avg(value) AS m, stddev_samp(value) AS sd FROM events GROUP BY 1) SELECT event_id, {R('abs(value-m)/sd', 'score', 6)}, CAST(abs(value-m)/sd>3 AS INTEGER) AS label FROM events JOIN p USING (event_type)")
def _(s, d):
    p = A.table(s, d, "events").groupBy("event_type").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    return FL.drain(FL.flag_against(raw(s, d), p, "event_type", "value").select("event_id", "score", "label")).select("event_id", rd("score", 6).alias("score"), "label")


MRU = f"mr AS (SELECT event_type AS name, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS w, avg(value) AS a, max(value) AS mx, min(value) AS mn, arg_max(value, ts) AS lt, count(*) AS n FROM events GROUP BY ALL), mo AS (SELECT * FROM mr WHERE w + INTERVAL 6 HOUR <= {WM(2)})"


def rollup(s, d):
    return FL.metric_rollup(raw(s, d).select(F.col("event_type").alias("name"), "ts", "value"), "6 hours", "6 hours", "2 hours")


@query("stream_metric_rollup", f"WITH {MRU} SELECT name, w AS ts, {R('a', 'avg')}, {R('mx', 'max')}, {R('mn', 'min')}, {R('lt', 'latest')}, n FROM mo")
def _(s, d):
    return rcols(FL.drain(rollup(s, d)), ["name", "ts", "n"], ["avg", "max", "min", "latest"])


@query("stream_keyed_alerts", f"WITH {MRU}, b AS (SELECT *, a>50 AS hot, coalesce(lag(a>50) OVER (PARTITION BY name ORDER BY w), false) AS p FROM mo) SELECT name, w AS ts, CASE WHEN hot THEN 'opened' ELSE 'resolved' END AS event, CASE WHEN NOT hot THEN 'none' WHEN a>60 THEN 'critical' ELSE 'warning' END AS severity, {R('a', 'value')} FROM b WHERE hot<>p")
def _(s, d):
    lim = s.createDataFrame([(n, 50.0, 60.0) for n in ("view", "click", "purchase", "signup", "error")], "name string, limit double, critical double")
    return rcols(FL.drain(FL.keyed_alerts(FL.next_hop(rollup(s, d)), lim)), ["name", "ts", "event", "severity"], ["value"])


@query("stream_pattern_watch")
def _(s, d):
    first = A.hourly_bars(s, d).groupBy("symbol").agg(F.min_by("close", "ts").alias("c"), F.min("ts").alias("t0"))
    pat = first.select("symbol", F.col("symbol").alias("pattern_id"), F.lit("bullish").alias("direction"), F.col("c").alias("entry"), (F.col("c") * 1.5).alias("target"), (F.col("c") * 0.5).alias("stop"), (F.col("t0") + F.expr("interval 10 days")).alias("expires"))
    bars = FL.next_hop(FL.trade_bars(ticks(s, d), "6 hours", "2 hours").select("symbol", "ts", "high", "low"))
    return FL.drain(FL.pattern_watch(bars, pat))


@query("stream_retention_dedup", "SELECT event_id, user_id FROM events")
def _(s, d):
    return FL.drain(FL.retain(raw(s, d).select("event_id", "user_id", "ts"), ["event_id"], "1 day").select("event_id", "user_id"))


@query("stream_replay_regime", f"WITH g AS (SELECT user_id, CASE WHEN avg(value)>50 THEN 'high' ELSE 'low' END AS regime FROM events GROUP BY 1) SELECT event_id, regime, {R('value+0.001*event_id', 'value')} FROM events JOIN g USING (user_id)")
def _(s, d):
    g = A.table(s, d, "events").groupBy("user_id").agg(F.when(F.avg("value") > 50, "high").otherwise("low").alias("regime"))
    r = FL.replay_with_regime(raw(s, d).select("event_id", "user_id", "value"), g, ["user_id"], 0.001 * F.col("event_id"))
    return rcols(FL.drain(r.select("event_id", "regime", "value")), ["event_id", "regime"], ["value"])
