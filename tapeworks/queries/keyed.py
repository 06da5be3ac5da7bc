"""Keyed streaming state over the events table in several micro-batches, checked against recursive SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from tapeworks.queries import query
from tapeworks.queries.common import R, rcols
from tapeworks.queries.streams import SB, WM
from tapeworks.sources import adapters as A
from tapeworks.streaming import flows as FL
from tapeworks.streaming import keyed as K

QUIET = 36
K_OF = """CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT)"""


def event_replay(s, d, batches=4):
    e = A.table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    return K.replay(e, "ts", batches)


@query("stream_alert_lifecycle", f"""
WITH RECURSIVE e AS (SELECT user_id AS source, event_type AS metric, ts, event_id, value, {K_OF} % 11 AS k FROM events),
x AS (SELECT source, metric, ts, value AS v, CASE k WHEN 3 THEN 'ack' WHEN 7 THEN 'resolve' END AS cmd,
  CASE WHEN k IN (3, 7) THEN 0 ELSE (value > 70)::INT + (value > 90)::INT END AS b, row_number() OVER (PARTITION BY source, metric ORDER BY ts, event_id) AS rn FROM e),
mark AS (SELECT least(max(ts) FILTER (cmd IS NULL), max(ts) FILTER (cmd IS NOT NULL)) - INTERVAL 2 HOUR AS mark FROM x),
m AS (SELECT source, metric, 0::BIGINT AS rn, 0 AS level, false AS acked, NULL::TIMESTAMP AS last, NULL::DOUBLE AS val, NULL::VARCHAR AS ev, NULL::TIMESTAMP AS ts, 0 AS ev_level, NULL::DOUBLE AS ev_val,
    NULL::TIMESTAMP AS gone, 0 AS gone_level, NULL::DOUBLE AS gone_val FROM x WHERE rn = 1
  UNION ALL
  SELECT source, metric, rn, CASE WHEN cmd IS NULL THEN greatest(b, p) WHEN cmd = 'resolve' THEN 0 ELSE p END, CASE WHEN b > 0 THEN p > 0 AND acked AND b <= p ELSE p > 0 AND (acked OR coalesce(cmd = 'ack', false)) END,
    CASE WHEN b > 0 THEN t ELSE last END, CASE WHEN b > 0 THEN v ELSE val END,
    CASE WHEN b > 0 AND p = 0 THEN 'opened' WHEN b > p AND p > 0 THEN 'escalated' WHEN cmd = 'ack' AND p > 0 AND NOT acked THEN 'acknowledged' WHEN cmd = 'resolve' AND p > 0 THEN 'resolved' END, t,
    CASE WHEN b > 0 THEN b ELSE p END, CASE WHEN b > 0 THEN v ELSE val END, CASE WHEN level > p THEN last + INTERVAL {QUIET} HOUR END, level, val
  FROM (SELECT m.*, x.rn AS nrn, x.ts AS t, x.v, x.cmd, x.b, CASE WHEN m.last + INTERVAL {QUIET} HOUR < x.ts THEN 0 ELSE m.level END AS p
    FROM m JOIN x ON x.source = m.source AND x.metric = m.metric AND x.rn = m.rn + 1) y(source, metric, orn, level, acked, last, val, ev0, ts0, l0, v0, g0, gl0, gv0, rn, t, v, cmd, b, p)),
ended AS (SELECT source, metric, arg_max(level, rn) AS level, arg_max(last, rn) AS last, arg_max(val, rn) AS val FROM m GROUP BY ALL),
out AS (SELECT source, metric, ts, ev AS event, ev_level AS l, ev_val AS v FROM m WHERE ev IS NOT NULL
  UNION ALL SELECT source, metric, gone, 'expired', gone_level, gone_val FROM m WHERE gone IS NOT NULL
  UNION ALL SELECT source, metric, last + INTERVAL {QUIET} HOUR, 'expired', level, val FROM ended, mark WHERE level > 0 AND last + INTERVAL {QUIET} HOUR < mark)
SELECT source, metric, ts, event, ['none', 'warning', 'critical'][l + 1] AS severity, v AS value FROM out""")
def _(s, d):
    """Alerts of metrics by user: opened, escalated, acknowledged and resolved by a command stream, expired by timers."""
    e = event_replay(s, d)
    rows = e.select(F.col("user_id").alias("source"), F.col("event_type").alias("metric"), "ts", F.col("event_id").alias("tie"), "value", (F.col("k") % 11).alias("c"))
    samples = rows.where("c NOT IN (3, 7)").drop("c").withColumn("limit", F.lit(70.0)).withColumn("critical", F.lit(90.0))
    commands = rows.where("c IN (3, 7)").withColumn("command", F.when(F.col("c") == 3, "ack").otherwise("resolve")).drop("c", "value")
    return FL.drain(K.alert_lifecycle(samples, commands, "2 hours", QUIET * 3600))


def tick_replay(s, d):
    e = event_replay(s, d)
    return e.select(F.col("user_id").alias("symbol"), "ts", F.col("event_id").alias("trade_id"), F.col("value").alias("price"), (F.col("k") + 1).cast("double").alias("volume"),
                    F.when(F.col("event_type").isin("purchase", "signup"), "buy").otherwise("sell").alias("side"))


IDLE = 48


@query("stream_session_delta", f"""WITH {SB}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL {IDLE} HOUR THEN 1 ELSE 0 END AS cut FROM se WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
i AS (SELECT *, sum(cut) OVER (PARTITION BY symbol ORDER BY ts) AS sid FROM g), c AS (SELECT symbol, ts, sid, sum(delta) OVER (PARTITION BY symbol, sid ORDER BY ts) AS cum_delta FROM i)
SELECT symbol, ts, {R('cum_delta')}, {R('max(cum_delta) OVER w', 'session_high')}, {R('min(cum_delta) OVER w', 'session_low')} FROM c WINDOW w AS (PARTITION BY symbol, sid ORDER BY ts)""")
def _(s, d):
    """Delta of sessions over bars of the same streaming query; a session ends after two days without a bar."""
    bars = FL.trade_bars(tick_replay(s, d), "6 hours", "2 hours").select("symbol", "ts", "ts_end", "delta")
    return rcols(FL.drain(K.running_delta(bars, IDLE * 3600)), ["symbol", "ts"], ["cum_delta", "session_high", "session_low"])


@query("stream_pattern_expiry", f"""WITH RECURSIVE {SB}, f AS (SELECT user_id AS symbol, min(ts) AS t0, arg_min(value, ts) AS c FROM events GROUP BY 1),
p AS (SELECT symbol, symbol AS pattern_id, c * 1.02 AS entry, c * 1.5 AS target, c * 0.5 AS stop, t0 + INTERVAL 3 DAY AS expires FROM f),
b AS (SELECT se.symbol, pattern_id, ts, high, low, entry, target, stop, expires, row_number() OVER (PARTITION BY se.symbol ORDER BY ts) AS rn FROM se JOIN p USING (symbol)),
m AS (SELECT symbol, pattern_id, 0::BIGINT AS rn, 'waiting' AS status, NULL::TIMESTAMP AS ts, expires FROM p
  UNION ALL SELECT b.symbol, b.pattern_id, b.rn, CASE WHEN status = 'waiting' AND b.ts > b.expires THEN 'stale' WHEN status = 'waiting' AND b.low <= b.entry AND b.entry <= b.high THEN 'entered'
    WHEN status = 'entered' AND b.low <= b.stop THEN 'stop' WHEN status = 'entered' AND b.high >= b.target THEN 'target' ELSE status END, CASE WHEN status = 'waiting' AND b.ts > b.expires THEN b.expires ELSE b.ts END, b.expires
  FROM m JOIN b ON b.symbol = m.symbol AND b.rn = m.rn + 1),
c AS (SELECT *, lag(status) OVER (PARTITION BY symbol ORDER BY rn) AS was FROM m)
SELECT symbol, pattern_id, ts, status AS event FROM c WHERE rn > 0 AND status <> was
UNION ALL SELECT symbol, pattern_id, expires, 'stale' FROM (SELECT symbol, pattern_id, expires, max(rn) AS last, arg_max(status, rn) AS status FROM m GROUP BY ALL) WHERE status = 'waiting' AND last > 0 AND expires < {WM(2)}""")
def _(s, d):
    """Patterns of every symbol watched over bars of the same streaming query; those that were not entered expire by a timer."""
    first = A.table(s, d, "events").groupBy(F.col("user_id").alias("symbol")).agg(F.min_by("value", "ts").alias("c"), F.min("ts").cast("timestamp").alias("t0"))
    pat = first.select("symbol", F.col("symbol").alias("pattern_id"), F.lit("bullish").alias("direction"), (F.col("c") * 1.02).alias("entry"), (F.col("c") * 1.5).alias("target"), (F.col("c") * 0.5).alias("stop"), (F.col("t0") + F.expr("interval 3 days")).alias("expires"))
    bars = FL.trade_bars(tick_replay(s, d), "6 hours", "2 hours").select("symbol", "ts", "ts_end", "high", "low")
    return FL.drain(K.pattern_watch(bars, pat))


@query("stream_uniform_sample")
def _(s, d):
    """Twenty events of each type, uniformly from all, kept while four micro-batches arrive."""
    return K.sample_of(FL.drain(K.sample_changes(event_replay(s, d), "event_type", "event_id", 20)), 20)
