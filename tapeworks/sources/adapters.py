"""Adapters from the star-schema test tables to market shapes."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.operators.bars import packed, trade_bars
from tapeworks.plans.panel import spread

TRADE_TIE = ("order_id", "line_no", "item_id")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as trades: symbol, ts, trade_id, price, volume, side, event_type."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("trade_id"), F.col("value").alias("price"),
        (F.get_json_object("props", "$.k").cast("double") + 1).alias("volume"),
        F.when(F.col("event_type").isin("purchase", "signup"), "buy").otherwise("sell").alias("side"),
        "event_type")


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as order-book messages: ts, order_id, price, size, side, event_type, account_id, symbol, event_id."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    kind = (F.when(F.col("event_type").isin("purchase", "signup"), "place")
            .when(F.col("event_type") == "click", "fill").otherwise("cancel"))
    return e.select(
        F.col("ts").cast("timestamp").alias("ts"), "event_id",
        F.concat_ws("-", F.col("user_id"), k % 3).alias("order_id"),
        F.col("value").alias("price"), (k + 1).cast("double").alias("size"),
        F.when(k % 2 == 0, "buy").otherwise("sell").alias("side"),
        kind.alias("event_type"), F.col("user_id").alias("account_id"), (k % 5).alias("symbol"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as trades of a supplier: symbol, ts, price, volume, side and tie-break ids."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("symbol"), F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("item_id"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("volume"),
        F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"))


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    within_day = F.unix_micros("ts") % 86_400_000_000
    return spread(trade_bars(trades(spark, sf_dir), "1 day", order=packed((within_day, 11), ("order_id", 13), ("line_no", 3), ("item_id", 11))), ("symbol",))


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trade_bars(ticks(spark, sf_dir), "1 hour", tie=("trade_id",))


def market_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One daily series per nation of the supplier: 25 symbols, dense calendar."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    sn = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).select("s_suppkey", F.col("n_name").alias("symbol"))
    return (li.join(sn, li.l_suppkey == sn.s_suppkey)
              .groupBy("symbol", F.col("l_shipdate").cast("timestamp").alias("ts"))
              .agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"),
                   F.sum("l_quantity").alias("volume")))


def post_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as posts."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), "text", "lang", F.col("source").alias("platform"), "n_chars")


def option_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An option chain derived from lineitem: supplier = underlying, line number = strike step, return flag = expiry.

    The price is intrinsic plus a bell-shaped time value scaled by the chain's mean discount, with put-call parity at rate 0.
    """
    t = trades(spark, sf_dir)
    li = table(spark, sf_dir, "lineitem")
    und = t.groupBy("symbol").agg((F.sum(F.col("price") * F.col("volume")) / F.sum("volume")).alias("underlying_price"))
    g = li.groupBy(F.col("l_suppkey").alias("symbol"), "l_returnflag", "l_linenumber").agg((0.2 + 4 * F.avg("l_discount")).alias("sig"))
    days = F.when(F.col("l_returnflag") == "A", 30).when(F.col("l_returnflag") == "N", 60).otherwise(90)
    g = g.join(und, "symbol").withColumn("days", days).withColumn("tte", F.col("days") / 365.0).withColumn("m", 0.6 + 0.1 * F.col("l_linenumber"))
    g = g.withColumn("strike", F.col("underlying_price") * F.col("m"))
    call = F.greatest(F.col("underlying_price") - F.col("strike"), F.lit(0.0)) + 0.4 * F.col("underlying_price") * F.col("sig") * F.sqrt("tte") * F.exp(-8 * (F.col("m") - 1) ** 2)
    g = g.withColumn("c", call).withColumn("p", F.col("c") - F.col("underlying_price") + F.col("strike"))
    q = g.select("symbol", "days", "tte", "underlying_price", "strike", F.ln("m").alias("log_moneyness"), F.lit(0.0).alias("risk_free_rate"), F.col("sig").alias("iv"),
                 F.explode(F.array(F.struct(F.lit("call").alias("option_type"), F.col("c").alias("price")), F.struct(F.lit("put").alias("option_type"), F.col("p").alias("price")))).alias("o"))
    q = q.select("*", "o.*").drop("o")
    return q.withColumn("bid", F.col("price") * 0.98).withColumn("ask", F.col("price") * 1.02)


def book_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-hour order-book snapshots built from events on a half-point tick grid around 100."""
    e = order_events(spark, sf_dir)
    lv = (e.groupBy("symbol", F.window("ts", "6 hours")["start"].alias("ts"), "side", F.ceil(F.col("price") / 5).alias("j"))
            .agg(F.sum("size").alias("qty")))
    g = lv.groupBy("symbol", "ts").agg(
        F.array_sort(F.collect_list(F.when(F.col("side") == "buy", F.struct("j", "qty")))).alias("b"),
        F.array_sort(F.collect_list(F.when(F.col("side") == "sell", F.struct("j", "qty")))).alias("a"))
    levels = lambda c, sign: F.transform(c, lambda x: F.struct((F.lit(100.0) + sign * 0.5 * x["j"]).alias("price"), x["qty"].alias("qty")))
    return g.where((F.size("a") > 0) & (F.size("b") > 0)).select("symbol", "ts", levels("b", -1).alias("bids"), levels("a", 1).alias("asks"))


def futures_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily futures measures per nation derived from lineitem flows."""
    li = table(spark, sf_dir, "lineitem")
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    sn = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).select("s_suppkey", F.col("n_name").alias("symbol"))
    r = F.col("l_returnflag") == "R"
    px = F.sum("l_extendedprice") / F.sum("l_quantity")
    return (li.join(sn, li.l_suppkey == sn.s_suppkey).groupBy("symbol", F.col("l_shipdate").cast("timestamp").alias("ts"))
              .agg((F.avg("l_tax") - F.avg("l_discount")).alias("funding_rate"), F.sum("l_quantity").alias("open_interest"),
                   F.sum(F.when(r, F.col("l_quantity")).otherwise(0.0)).alias("liquidations_long"), F.sum(F.when(r, 0.0).otherwise(F.col("l_quantity"))).alias("liquidations_short"),
                   px.alias("index_price"), (px * (1 + F.avg("l_tax"))).alias("mark_price")))
