"""Sources, bars, cleaning, alignment."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeworks.functions import calendar as cal
from tapeworks.functions import mathx as mx
from tapeworks.operators import bars as B
from tapeworks.operators import cleaning as C
from tapeworks.plans.asof import asof_join
from tapeworks.plans.panel import Panel, day_bucket, hour_bucket, number_rows
from tapeworks.queries import query
from tapeworks.queries.common import BARS, HBARS, MARKET, ORDERS_EV, R, RS, TICKS, TRADES, rcols, rd
from tapeworks.sources import adapters as A
from tapeworks.sources import readers as RD

P = Panel()
OHLC = ["open", "high", "low", "close", "volume"]


@query("bars_daily_trades", f"WITH {BARS} SELECT symbol, ts, {RS(OHLC)}, n_trades FROM bars")
def _(s, d):
    return rcols(A.daily_bars(s, d), ["symbol", "ts", "n_trades"], OHLC)


@query("bars_hourly_ticks", f"WITH {HBARS} SELECT symbol, ts, {RS(OHLC)}, n_trades FROM bars")
def _(s, d):
    return rcols(A.hourly_bars(s, d), ["symbol", "ts", "n_trades"], OHLC)


@query("resample_last", f"""WITH {TICKS} SELECT symbol, time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '1970-01-01') AS ts,
 arg_max(price, row(ts, trade_id)) AS close FROM ticks GROUP BY ALL""")
def _(s, d):
    return B.resample_last(A.ticks(s, d).withColumn("close", F.col("price")), "4 hours", tie=("trade_id",))


@query("duplicate_timestamp_mean", f"WITH {TRADES} SELECT symbol, ts, {R('avg(price)','price')}, {R('avg(volume)','volume')} FROM trades GROUP BY symbol, ts")
def _(s, d):
    return rcols(B.merge_duplicates(A.trades(s, d), ["price", "volume"]), ["symbol", "ts"], ["price", "volume"])


@query("returns_simple_log", f"""WITH {BARS} SELECT symbol, ts, {R('close / lag(close) OVER w - 1','simple_return',6)},
 {R('ln(close / lag(close) OVER w)','log_return',6)} FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)""")
def _(s, d):
    return rcols(B.with_returns(A.daily_bars(s, d)), ["symbol", "ts"], ["simple_return", "log_return"], 6)


@query("snapshot_latest_n", f"""WITH {TICKS} SELECT symbol, ts, trade_id, price FROM ticks
 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, trade_id DESC) <= 5""")
def _(s, d):
    return RD.latest_n(A.ticks(s, d), 5, tie=("trade_id",)).select("symbol", "ts", "trade_id", "price")


@query("snapshot_range_scan", f"""WITH {TICKS} SELECT symbol, ts, trade_id, price FROM ticks
 WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'""")
def _(s, d):
    return RD.range_scan(A.ticks(s, d), "2024-01-05", "2024-01-20").select("symbol", "ts", "trade_id", "price")


@query("snapshot_hourly_pick", f"""WITH {TICKS} SELECT symbol, date_trunc('hour', ts) AS hour, arg_min(trade_id, row(ts, trade_id)) AS trade_id,
 arg_min(price, row(ts, trade_id)) AS price FROM ticks GROUP BY ALL""")
def _(s, d):
    return RD.hourly_pick(A.ticks(s, d), tie=("trade_id",)).select("symbol", "hour", "trade_id", "price")


@query("snapshot_metadata", f"""WITH {TICKS} SELECT count(*) AS n_rows, count(DISTINCT symbol) AS n_symbols, min(ts) AS min_ts, max(ts) AS max_ts FROM ticks""")
def _(s, d):
    return RD.table_metadata(A.ticks(s, d))


@query("clean_ohlcv", f"""WITH {TRADES} SELECT symbol, ts, {R('arg_min(price, row(order_id, line_no, item_id))','price')}
 FROM trades WHERE price > 0 GROUP BY symbol, ts""")
def _(s, d):
    t = A.trades(s, d)
    return rcols(C.clean_ohlcv(t, "price", tie=A.TRADE_TIE), ["symbol", "ts"], ["price"])


@query("iqr_cap_or_drop", f"""WITH q AS (SELECT event_type, quantile_cont(value, .25) AS q1, quantile_cont(value, .75) AS q3 FROM events GROUP BY 1),
 f AS (SELECT e.*, q1 - 1.5*(q3-q1) AS lo, q3 + 1.5*(q3-q1) AS hi FROM events e JOIN q USING (event_type)),
 s AS (SELECT event_type, avg(CASE WHEN value < lo OR value > hi THEN 1.0 ELSE 0.0 END) AS share FROM f GROUP BY 1)
 SELECT event_id, f.event_type, {R('CASE WHEN share >= 0.05 THEN greatest(least(value, hi), lo) ELSE value END','value')}
 FROM f JOIN s USING (event_type) WHERE share >= 0.05 OR (value >= lo AND value <= hi)""")
def _(s, d):
    e = A.table(s, d, "events").select("event_id", "event_type", "value")
    return rcols(C.cap_or_drop(e, "value", ["event_type"]), ["event_id", "event_type"], ["value"])


@query("outlier_clip_mad", f"""WITH m AS (SELECT median(l_extendedprice) AS med FROM lineitem),
 k AS (SELECT median(abs(l_extendedprice - med)) * 1.4826 AS mad FROM lineitem, m)
 SELECT l_orderkey, l_linenumber, l_partkey, {R('greatest(least(l_extendedprice, med + mad), med - mad)','l_extendedprice',2)} FROM lineitem, m, k""")
def _(s, d):
    li = A.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return rcols(C.handle_outliers(li, "l_extendedprice", "mad", "clip", 1.0), ["l_orderkey", "l_linenumber", "l_partkey"], ["l_extendedprice"], 2)


SPINE = HBARS + """, spine AS (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM bars GROUP BY symbol),
 g AS (SELECT spine.symbol, spine.ts, close FROM spine LEFT JOIN bars ON bars.symbol = spine.symbol AND bars.ts = spine.ts)"""


@query("calendar_spine_ffill", f"""WITH {SPINE} SELECT symbol, ts, {R('last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)','close')} FROM g""")
def _(s, d):
    g = C.calendar_spine(A.hourly_bars(s, d).select("symbol", "ts", "close"), "1 hour")
    return rcols(C.fill_missing(g, ["close"], "ffill"), ["symbol", "ts"], ["close"])


@query("fill_linear_interpolation", f"""WITH {SPINE},
 p AS (SELECT *, last_value(CASE WHEN close IS NOT NULL THEN ts END IGNORE NULLS) OVER a AS pt, last_value(close IGNORE NULLS) OVER a AS pv,
  first_value(CASE WHEN close IS NOT NULL THEN ts END IGNORE NULLS) OVER b AS nt, first_value(close IGNORE NULLS) OVER b AS nv FROM g
  WINDOW a AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 SELECT symbol, ts, {R('coalesce(close, pv + (nv - pv) * (epoch_us(ts) - epoch_us(pt)) / (epoch_us(nt) - epoch_us(pt)))','close')} FROM p""")
def _(s, d):
    g = C.calendar_spine(A.hourly_bars(s, d).select("symbol", "ts", "close"), "1 hour")
    return rcols(C.fill_missing(g, ["close"], "linear"), ["symbol", "ts"], ["close"])


@query("fill_forward_tick_carry", f"""WITH {TICKS}, g AS (SELECT *, CASE WHEN volume > 50 THEN price END AS q FROM ticks)
 SELECT trade_id, coalesce(last_value(q IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, trade_id ROWS UNBOUNDED PRECEDING), 0.0) AS q FROM g""")
def _(s, d):
    t = A.ticks(s, d).withColumn("q", F.when(F.col("volume") > 50, F.col("price")))
    return C.fill_missing(t, ["q"], "ffill", Panel(order=("ts", "trade_id")), bucket=day_bucket()).select("trade_id", "q")


@query("gap_detection", f"""WITH {HBARS} SELECT * FROM (SELECT symbol, ts, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS prev_ts,
 CAST(epoch(ts) - epoch(lag(ts) OVER (PARTITION BY symbol ORDER BY ts)) AS DOUBLE) AS gap_seconds FROM bars) WHERE gap_seconds > 36000""")
def _(s, d):
    return C.gaps(A.hourly_bars(s, d).select("symbol", "ts"), 10 * 3600)


@query("valid_sliding_windows", f"""WITH {MARKET}, s AS (SELECT symbol, ts, epoch(lead(ts) OVER w) - epoch(ts) AS step FROM market WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
 k AS (SELECT *, CASE WHEN abs(step - 86400) <= 300 THEN 1 ELSE 0 END AS ok FROM s)
 SELECT symbol, ts FROM (SELECT symbol, ts, min(ok) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS al,
 count(*) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS n FROM k) WHERE al = 1 AND n = 7""")
def _(s, d):
    return C.valid_windows(A.market_daily(s, d).select("symbol", "ts"), 7, 86400, 300)


@query("aligned_windows", f"""WITH {MARKET}, g AS (SELECT symbol, unnest(generate_series(TIMESTAMP '2000-03-02', TIMESTAMP '2000-06-29', INTERVAL 1 DAY)) AS ts FROM (SELECT DISTINCT symbol FROM market)),
 j AS (SELECT g.symbol, g.ts, close, avg(CASE WHEN close IS NULL THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY g.symbol) AS miss FROM g LEFT JOIN market m ON m.symbol = g.symbol AND m.ts = g.ts)
 SELECT symbol, ts, {R('coalesce(last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), first_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))','close')},
 {R('miss','missing_ratio',6)} FROM j WHERE miss <= 0.3""")
def _(s, d):
    w = C.aligned_windows(A.market_daily(s, d), F.lit("2000-06-29").cast("timestamp"), 120, max_missing=.3, step="1 day")
    return w.select("symbol", "ts", rd("close").alias("close"), rd("missing_ratio", 6).alias("missing_ratio"))


@query("timestamp_rounding_intersection", f"""WITH {TICKS}, r AS (SELECT event_type AS symbol, trade_id, make_timestamp(CAST(round(epoch_us(ts)/1e6/7200)*7200*1000000 AS BIGINT)) AS ts_rounded FROM ticks)
 SELECT symbol, trade_id, ts_rounded FROM r WHERE ts_rounded IN (SELECT ts_rounded FROM r GROUP BY 1 HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM r))""")
def _(s, d):
    t = A.ticks(s, d).select("trade_id", "ts", F.col("event_type").alias("symbol"))
    return C.common_timestamps(t, 7200).select("symbol", "trade_id", "ts_rounded")


@query("numeric_cleaning_safe_math", f"""SELECT l_orderkey, l_linenumber, l_partkey,
 {R('CASE WHEN l_discount = 0 THEN 0 ELSE l_tax / l_discount END','tax_per_discount',6)}, {R('CASE WHEN l_tax > 0 THEN ln(l_tax) ELSE 0 END','log_tax',6)},
 {R('sqrt(l_quantity)','root_qty',6)}, {R('greatest(least(l_quantity, 40), 5)','clipped_qty')},
 {R('CASE WHEN l_tax + l_discount = 0 THEN 0 ELSE (l_quantity*l_tax + l_extendedprice*l_discount)/(l_tax+l_discount) END','wavg',4)} FROM lineitem""")
def _(s, d):
    li = A.table(s, d, "lineitem")
    o = li.select("l_orderkey", "l_linenumber", "l_partkey", mx.safe_div("l_tax", "l_discount").alias("tax_per_discount"),
                  mx.safe_log("l_tax").alias("log_tax"), mx.safe_sqrt("l_quantity").alias("root_qty"), mx.clip("l_quantity", 5.0, 40.0).alias("clipped_qty"),
                  mx.weighted_average(["l_quantity", "l_extendedprice"], ["l_tax", "l_discount"]).alias("wavg"))
    return o.select("l_orderkey", "l_linenumber", "l_partkey", rd("tax_per_discount", 6).alias("tax_per_discount"), rd("log_tax", 6).alias("log_tax"),
                    rd("root_qty", 6).alias("root_qty"), rd("clipped_qty").alias("clipped_qty"), rd("wavg").alias("wavg"))


@query("basic_cleaning_dedup", "SELECT DISTINCT text, lang FROM documents WHERE text IS NOT NULL OR lang IS NOT NULL")
def _(s, d):
    return C.basic_clean(A.table(s, d, "documents").select("text", "lang"))


@query("impute_mean", f"""WITH x AS (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS v FROM events)
 SELECT event_id, {R('coalesce(v, (SELECT avg(v) FROM x))','v')} FROM x""")
def _(s, d):
    e = A.table(s, d, "events").select("event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("v"))
    return rcols(C.impute(e, ["v"], "mean", drop_over=.9), ["event_id"], ["v"])


@query("impute_text_mode", """WITH x AS (SELECT doc_id, CASE WHEN n_chars % 2 = 1 THEN lang END AS lang FROM documents)
 SELECT doc_id, coalesce(lang, (SELECT lang FROM x WHERE lang IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC LIMIT 1)) AS lang FROM x""")
def _(s, d):
    x = A.table(s, d, "documents").select("doc_id", F.when(F.col("n_chars") % 2 == 1, F.col("lang")).alias("lang"))
    return C.fill_text_mode(x, ["lang"])


@query("categorical_index_onehot", """WITH c AS (SELECT o_orderpriority, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) - 1 AS i FROM orders GROUP BY 1)
 SELECT o_orderkey, CAST(i AS DOUBLE) AS o_orderpriority_index, CAST(i AS BIGINT) AS hot_slot FROM orders JOIN c USING (o_orderpriority)""")
def _(s, d):
    from pyspark.ml.functions import vector_to_array
    o = A.table(s, d, "orders").select("o_orderkey", "o_orderpriority")
    e = C.encode_categories(o, ["o_orderpriority"])
    return e.select("o_orderkey", "o_orderpriority_index",
                    (F.array_position(vector_to_array("o_orderpriority_onehot"), 1.0) - 1).cast("bigint").alias("hot_slot"))


@query("scale_standard_vector", f"""SELECT o_orderkey, {R('(o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_samp(o_totalprice) FROM orders)','z',6)} FROM orders""")
def _(s, d):
    from pyspark.ml.functions import vector_to_array
    o = A.table(s, d, "orders").select("o_orderkey", "o_totalprice")
    return C.scale_features(o, ["o_totalprice"]).select("o_orderkey", rd(vector_to_array("scaled")[0], 6).alias("z"))


@query("normalize_robust_params", f"""WITH q AS (SELECT median(l_quantity) AS qm, quantile_cont(l_quantity,.75)-quantile_cont(l_quantity,.25) AS qs,
 median(l_extendedprice) AS pm, quantile_cont(l_extendedprice,.75)-quantile_cont(l_extendedprice,.25) AS ps FROM lineitem)
 SELECT l_orderkey, l_linenumber, l_partkey, {R('(l_quantity-qm)/qs','l_quantity',6)}, {R('(l_extendedprice-pm)/ps','l_extendedprice',6)} FROM lineitem, q""")
def _(s, d):
    li = A.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    p = C.fit_normalizer(li, ["l_quantity", "l_extendedprice"], "robust")
    return rcols(C.apply_normalizer(li, p, ["l_quantity", "l_extendedprice"]), ["l_orderkey", "l_linenumber", "l_partkey"], ["l_quantity", "l_extendedprice"], 6)


@query("normalize_minmax_roundtrip", f"SELECT o_orderkey, {R('o_totalprice','o_totalprice',2)} FROM orders")
def _(s, d):
    o = A.table(s, d, "orders").select("o_orderkey", "o_totalprice")
    p = C.fit_normalizer(o, ["o_totalprice"], "minmax")
    z = C.apply_normalizer(o, p, ["o_totalprice"])
    return rcols(C.apply_normalizer(z, p, ["o_totalprice"], inverse=True), ["o_orderkey"], ["o_totalprice"], 2)


@query("normalizer_fit_train_apply_test", f"""WITH p AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01')
 SELECT o_orderkey, {R('(greatest(least(o_totalprice, m + 1.5*s), m - 1.5*s) - m)/s','o_totalprice',6)} FROM orders, p""")
def _(s, d):
    o = A.table(s, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    p = C.fit_normalizer(o.where("o_orderdate < timestamp_ntz'1999-01-01'"), ["o_totalprice"], outlier=1.5)
    return rcols(C.apply_normalizer(o, p, ["o_totalprice"]), ["o_orderkey"], ["o_totalprice"], 6)


@query("rolling_znormalize", f"""WITH {BARS} SELECT symbol, ts, {R('coalesce((close - avg(close) OVER w) / (stddev_samp(close) OVER w + 1e-8), 0)','z',6)}
 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 23 PRECEDING)""")
def _(s, d):
    b = A.daily_bars(s, d)
    return b.select("symbol", "ts", rd(C.rolling_znorm("close", 24), 6).alias("z"))


@query("binning_quantile_uniform", """WITH e AS (SELECT [quantile_cont(o_totalprice,.25), quantile_cont(o_totalprice,.5), quantile_cont(o_totalprice,.75)] AS q, min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders)
 SELECT o_orderkey, CAST(len(list_filter(q, lambda x: x < o_totalprice)) AS INTEGER) AS qbin,
 CAST(least(floor((o_totalprice - a) / ((b - a)/5)), 4) AS INTEGER) AS ubin FROM orders, e""")
def _(s, d):
    o = A.table(s, d, "orders").select("o_orderkey", "o_totalprice")
    o = C.bin_column(o, "o_totalprice", 4, "quantile", "qbin")
    return C.bin_column(o, "o_totalprice", 5, "uniform", "ubin").select("o_orderkey", "qbin", "ubin")


@query("low_variance_drop", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem")
def _(s, d):
    li = A.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax", F.lit(1.0).alias("const"))
    return C.drop_low_variance(li, ["l_quantity", "l_tax", "const"], 0.01)


@query("target_clip_scale", f"""WITH q AS (SELECT quantile_cont(o_totalprice,.01) AS lo, quantile_cont(o_totalprice,.99) AS hi FROM orders),
 c AS (SELECT o_orderkey, greatest(least(o_totalprice,hi),lo) AS x FROM orders, q), p AS (SELECT avg(x) AS m, stddev_samp(x) AS sd FROM c)
 SELECT o_orderkey, {R('(x-m)/sd','o_totalprice',6)} FROM c, p""")
def _(s, d):
    o = A.table(s, d, "orders").select("o_orderkey", "o_totalprice")
    return rcols(C.apply_target(o, C.fit_target(o, "o_totalprice"), "o_totalprice"), ["o_orderkey"], ["o_totalprice"], 6)


@query("calendar_features", """SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts)-1 AS INTEGER) AS day_of_week, CAST(day(ts) AS INTEGER) AS day_of_month,
 CAST(month(ts) AS INTEGER) AS month, CAST(quarter(ts) AS INTEGER) AS quarter, CAST(year(ts) AS INTEGER) AS year,
 CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend, CAST(day(ts)=1 AS INTEGER) AS is_month_start, CAST(CAST(ts AS DATE)=last_day(ts) AS INTEGER) AS is_month_end,
 CAST(day(ts)=1 AND month(ts)%3=1 AS INTEGER) AS is_quarter_start, CAST(CAST(ts AS DATE)=last_day(ts) AND month(ts)%3=0 AS INTEGER) AS is_quarter_end FROM events""")
def _(s, d):
    return A.table(s, d, "events").select("event_id", *cal.calendar_features())


@query("cyclic_time_encoding", f"""SELECT event_id, {R('sin((hour(ts)+minute(ts)/60.0)*2*pi()/24)','hour_sin',6)}, {R('cos((hour(ts)+minute(ts)/60.0)*2*pi()/24)','hour_cos',6)},
 {R('sin((isodow(ts)-1)*2*pi()/7)','dow_sin',6)}, {R('cos((isodow(ts)-1)*2*pi()/7)','dow_cos',6)}, {R('sin(week(ts)*2*pi()/52)','week_sin',6)}, {R('cos(week(ts)*2*pi()/52)','week_cos',6)},
 {R('(month(ts)-1)/11.0','month_norm',6)} FROM events""")
def _(s, d):
    e = A.table(s, d, "events").select("event_id", *cal.cyclic_features())
    return rcols(e, ["event_id"], [c for c in e.columns if c != "event_id"], 6)


@query("trading_session", f"""SELECT event_id, CAST(CASE WHEN hour(ts)<8 THEN 0 WHEN hour(ts)<16 THEN 1 WHEN hour(ts)<22 THEN 2 ELSE 3 END AS INTEGER) AS session, {R('(isodow(ts)-1)/7.0','weekday_fraction',6)} FROM events""")
def _(s, d):
    return A.table(s, d, "events").select("event_id", cal.trading_session().alias("session"), rd(cal.weekday_fraction(), 6).alias("weekday_fraction"))


@query("symbol_interval_count_parsing", """SELECT p_partkey, CASE WHEN regexp_matches(upper(regexp_replace(p_name,'[-_/ ]','','g')),'^[A-Z0-9]{2,20}$') THEN upper(regexp_replace(p_name,'[-_/ ]','','g')) END AS symbol,
 CAST(p_size * CASE p_size % 4 WHEN 0 THEN 1 WHEN 1 THEN 60 WHEN 2 THEN 1440 ELSE 10080 END AS BIGINT) AS minutes,
 CAST(floor(p_size * CASE p_size % 4 WHEN 0 THEN 1e3 WHEN 1 THEN 1e6 WHEN 2 THEN 1e9 ELSE 1 END) AS BIGINT) AS cnt FROM part""")
def _(s, d):
    p = A.table(s, d, "part")
    unit = lambda u: F.element_at(F.array(*[F.lit(x) for x in u]), (F.col("p_size") % 4 + 1))
    return p.select("p_partkey", cal.normalize_symbol("p_name").alias("symbol"),
                    cal.interval_minutes(F.concat(F.col("p_size").cast("string"), unit("mhdw"))).alias("minutes"),
                    cal.parse_count(F.concat(F.col("p_size").cast("string"), unit(["k", "M", "b", ""]))).alias("cnt"))


@query("asof_backward_quote", f"""WITH {TICKS}, t AS (SELECT * FROM ticks WHERE side='buy'), q AS (SELECT * FROM ticks WHERE side='sell')
 SELECT t.trade_id, q.trade_id AS q_trade_id, q.price AS q_price FROM t ASOF LEFT JOIN q ON t.symbol = q.symbol AND t.ts >= q.ts""")
def _(s, d):
    t = A.ticks(s, d)
    q = t.where("side = 'sell'").select("symbol", "ts", "trade_id", "price")
    j = asof_join(t.where("side = 'buy'").select("symbol", "ts", "trade_id"), q, ["symbol"], "ts", ["trade_id", "price"],
                  bucket=day_bucket(), tie=("trade_id",), prefix="q_")
    return j.select("trade_id", "q_trade_id", "q_price")


@query("asof_nearest", f"""WITH {TICKS}, t AS (SELECT * FROM ticks WHERE side='buy'), q AS (SELECT * FROM ticks WHERE side='sell'),
 b AS (SELECT t.trade_id, t.ts, t.symbol, q.trade_id AS pid, q.ts AS pts FROM t ASOF LEFT JOIN q ON t.symbol = q.symbol AND t.ts >= q.ts),
 f AS (SELECT b.*, q.trade_id AS nid, q.ts AS nts FROM b ASOF LEFT JOIN q ON b.symbol = q.symbol AND b.ts <= q.ts)
 SELECT trade_id, CASE WHEN pid IS NULL OR (nid IS NOT NULL AND epoch_us(nts)-epoch_us(ts) < epoch_us(ts)-epoch_us(pts)) THEN nid ELSE pid END AS q_trade_id FROM f""")
def _(s, d):
    t = A.ticks(s, d)
    q = t.where("side = 'sell'").select("symbol", "ts", "trade_id", "price")
    j = asof_join(t.where("side = 'buy'").select("symbol", "ts", "trade_id"), q, ["symbol"], "ts", ["trade_id", "price"],
                  bucket=day_bucket(), direction="nearest", tie=("trade_id",), prefix="q_")
    return j.select("trade_id", "q_trade_id")


@query("global_row_position", f"WITH {TICKS} SELECT trade_id, row_number() OVER (PARTITION BY symbol ORDER BY ts, trade_id) AS rn FROM ticks")
def _(s, d):
    return number_rows(A.ticks(s, d), Panel(order=("ts", "trade_id")), day_bucket(), "rn").select("trade_id", F.col("rn").cast("bigint"))


@query("source_union", """SELECT doc_id AS id, text, source AS platform, NULL AS role FROM documents UNION ALL SELECT conv_id*1000+turn, text, 'chat', role FROM conversations""")
def _(s, d):
    p = A.post_table(s, d).select("id", "text", "platform")
    c = A.table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", F.lit("chat").alias("platform"), "role")
    return p.unionByName(c, allowMissingColumns=True)


@query("dimension_join_weights", f"""SELECT r_name, {R('sum(c_acctbal * CASE r_name WHEN 1 THEN 1 ELSE 1 END)','w',2)} FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey GROUP BY 1""".replace("CASE r_name WHEN 1 THEN 1 ELSE 1 END", "(1 + r_regionkey * 0.1)"))
def _(s, d):
    n = A.table(s, d, "nation")
    r = A.table(s, d, "region")
    dim = F.broadcast(n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey))  # 25 rows by definition of the table
    c = A.table(s, d, "customer")
    return (c.join(dim, c.c_nationkey == dim.n_nationkey).groupBy("r_name")
             .agg(rd(F.sum(F.col("c_acctbal") * (1 + F.col("r_regionkey") * 0.1)), 2).alias("w")))


@query("semi_anti_intersect_except", """SELECT 'semi' AS op, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag='R')
 UNION ALL SELECT 'anti', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag='R')
 UNION ALL SELECT 'intersect', count(*) FROM (SELECT o_orderkey FROM orders INTERSECT SELECT l_orderkey FROM lineitem)
 UNION ALL SELECT 'except', count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)""")
def _(s, d):
    o = A.table(s, d, "orders").select("o_orderkey")
    l = A.table(s, d, "lineitem")
    rk = l.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    lk = l.select(F.col("l_orderkey").alias("o_orderkey"))
    n = lambda df, op: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(op).alias("op"), "n")
    return (n(o.join(rk, "o_orderkey", "left_semi"), "semi").union(n(o.join(rk, "o_orderkey", "left_anti"), "anti"))
            .union(n(o.intersect(lk), "intersect")).union(n(o.subtract(lk), "except")))
