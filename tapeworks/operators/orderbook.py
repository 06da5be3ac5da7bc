"""Order-book features over snapshot rows with ``bids`` / ``asks`` arrays of (price, qty), best first.

Everything per snapshot is a projection over its own arrays (no shuffle); level joins explode once.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType

from tapeworks.functions.mathx import float_div, ratio, safe_div
from tapeworks.plans import frames
from tapeworks.plans.asof import asof_join
from tapeworks.plans.panel import Panel, join_on

PANEL = Panel()


def best(side: str) -> Column:
    return F.get(F.col(side), F.lit(0))["price"]


def mid() -> Column:
    return (best("bids") + best("asks")) / 2


def volume(side: str, n: int | None = None) -> Column:
    a = F.col(side) if n is None else F.slice(side, 1, n)
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x["qty"])


def spread_columns() -> list[Column]:
    sp = best("asks") - best("bids")
    return [sp.alias("spread"), F.coalesce(100 * ratio(sp, mid()), F.lit(0.0)).alias("spread_pct"), (sp / 2).alias("half_spread"), mid().alias("mid")]


def spread_volatility(df: DataFrame, n: int = 20, p: Panel = PANEL) -> DataFrame:
    return df.withColumn("spread_vol", F.when(F.count("spread_pct").over(p.trailing(n)) == n, F.stddev_pop("spread_pct").over(p.trailing(n))))


def effective_spread(size: Column, side: str = "buy") -> Column:
    """Walk the book for ``size``: 2 |average fill - mid| / mid * 100; 100 when depth runs out."""
    levels = F.col("asks") if side == "buy" else F.col("bids")
    start = F.struct(size.cast("double").alias("left"), F.lit(0.0).alias("cost"))
    step = lambda a, x: F.struct((a["left"] - F.least(a["left"], x["qty"])).alias("left"), (a["cost"] + F.least(a["left"], x["qty"]) * x["price"]).alias("cost"))
    w = F.aggregate(levels, start, step)
    return F.when(w["left"] > 1e-12, 100.0).otherwise(200 * F.abs(w["cost"] / size - mid()) / mid())


def realized_spread(trades: DataFrame, mids: DataFrame, seconds: int, bucket: Column, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """2 (mid after - price) / price * 100, signed by side, with the first mid at least ``seconds`` later."""
    t = trades.withColumn("_t0", F.col("ts")).withColumn("ts", F.col("ts") + F.expr(f"interval {seconds} seconds"))
    j = asof_join(t, mids.select(*keys, "ts", "mid"), keys, "ts", ["mid"], bucket=bucket, direction="forward", prefix="after_")
    sign = F.when(F.col("side") == "buy", 1.0).otherwise(-1.0)
    return j.withColumn("ts", F.col("_t0")).drop("_t0", "after_match_ts").withColumn("realized_spread", float_div(200 * sign * (F.col("after_mid") - F.col("price")), "price"))


def depth_columns(n: int = 10) -> list[Column]:
    b, a = volume("bids", n), volume("asks", n)
    return [b.alias("bid_depth"), a.alias("ask_depth"), (b + a).alias("total_depth"), safe_div(b - a, b + a).alias("depth_imbalance")]


def depth_per_level(df: DataFrame, keys: Sequence[str], n: int = 10) -> DataFrame:
    parts = [df.select(*keys, F.lit(s).alias("side"), F.posexplode(F.slice(c, 1, n)).alias("level", "l")) for s, c in (("bid", "bids"), ("ask", "asks"))]
    return parts[0].unionByName(parts[1]).select(*keys, "side", "level", "l.price", "l.qty")


def depth_slope(side: str, n: int = 10) -> Column:
    """Least-squares slope of log volume on relative distance from mid, folded over the first n levels."""
    m = mid()
    z = F.struct(*[F.lit(0.0).alias(k) for k in ("n", "x", "y", "xx", "xy")])

    def step(a, l):
        x, y = F.abs(l["price"] - m) / m, F.ln(F.greatest(l["qty"], F.lit(1e-10)))
        return F.struct((a["n"] + 1).alias("n"), (a["x"] + x).alias("x"), (a["y"] + y).alias("y"), (a["xx"] + x * x).alias("xx"), (a["xy"] + x * y).alias("xy"))

    s = F.aggregate(F.slice(side, 1, n), z, step)
    return safe_div(s["n"] * s["xy"] - s["x"] * s["y"], s["n"] * s["xx"] - s["x"] * s["x"])


def imbalance(n: int = 5) -> Column:
    b, a = volume("bids", n), volume("asks", n)
    return safe_div(b - a, b + a)


def weighted_imbalance(n: int = 10) -> Column:
    """Volumes weighted by 1 - relative distance from mid."""
    m = mid()
    side = lambda c: F.aggregate(F.slice(c, 1, n), F.lit(0.0), lambda s, x: s + x["qty"] * F.greatest(1 - F.abs(x["price"] - m) / m, F.lit(0.0)))
    b, a = side("bids"), side("asks")
    return safe_div(b - a, b + a)


def toxicity(buy: Column, sell: Column, passive: Column) -> Column:
    """Aggressive share of volume scaled by one-sidedness, capped at 1; 0.5 without trades."""
    ag = buy + sell
    t = safe_div(ag, passive + ag) * (1 + F.abs(safe_div(buy - sell, ag)))
    return F.when(ag == 0, 0.5).when(passive == 0, 1.0).otherwise(F.least(t, F.lit(1.0)))


def microstructure_noise(df: DataFrame, c: str = "mid", n: int = 20, p: Panel = PANEL) -> DataFrame:
    d = df.withColumn("_r", F.ln(F.col(c) / F.lag(c).over(p.w)))
    return d.withColumn("noise", F.when(F.count("_r").over(p.trailing(n)) == n, F.var_pop("_r").over(p.trailing(n)))).drop("_r")


def weighted_mid(n: int = 10) -> Column:
    both = F.concat(F.slice("bids", 1, n), F.slice("asks", 1, n))
    pq = F.aggregate(both, F.lit(0.0), lambda s, x: s + x["price"] * x["qty"])
    return safe_div(pq, F.aggregate(both, F.lit(0.0), lambda s, x: s + x["qty"]))


def wall(side: str, factor: float = 3.0) -> Column:
    """Struct (present, price, size, distance, strength, level) of the first level above factor times the mean size."""
    lv = F.transform(F.col(side), lambda x, i: F.struct(x["price"].alias("price"), x["qty"].alias("qty"), i.alias("level")))
    avg = safe_div(volume(side), F.size(side))
    hit = F.get(F.filter(lv, lambda x: x["qty"] > factor * avg), F.lit(0))
    sign = 1.0 if side == "bids" else -1.0
    return F.struct(F.coalesce(hit.isNotNull(), F.lit(False)).cast("int").alias("present"), hit["price"].alias("price"), hit["qty"].alias("size"), (sign * 100 * (mid() - hit["price"]) / mid()).alias("distance"), (hit["qty"] / avg).alias("strength"), hit["level"].alias("level"))


def explode_levels(df: DataFrame, keys: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    e = lambda c, s: df.select(*keys, F.lit(s).alias("side"), F.explode(c).alias("l")).select(*keys, "side", "l.price", "l.qty")
    return e("bids", "bid").unionByName(e("asks", "ask"))


def level_changes(df: DataFrame, p: Panel = PANEL) -> DataFrame:
    """(symbol, ts, side, price, prev_qty, qty, seconds): full outer match of each snapshot with the previous one by price level.

    The previous snapshot's sequence number is shifted by one so the match is an equi join on
    (key, seq, side, price); qty is 0 where the level vanished, prev_qty 0 where it is new.
    """
    k = list(p.keys)
    seq = df.select(*k, "ts", "bids", "asks", F.row_number().over(p.w).alias("_n"), F.lag("ts").over(p.w).alias("_pts"), F.lead("ts").over(p.w).alias("_nts"))
    cur = explode_levels(seq, (*k, "_n", "ts", "_pts", "_nts"))
    a = cur.select(*k, "_n", "side", "price", "ts", "_pts", "qty")
    b = cur.where(F.col("_nts").isNotNull()).select(*k, (F.col("_n") + 1).alias("_n"), "side", "price", F.col("qty").alias("prev_qty"), F.col("_nts").alias("_ts2"), F.col("ts").alias("_pts2"))
    on = [*k, "_n", "side", "price"]
    j = a.where(F.col("_pts").isNotNull()).join(b, on, "full")
    ts, pts = F.coalesce("ts", "_ts2"), F.coalesce("_pts", "_pts2")
    return j.select(*k, ts.alias("ts"), "side", "price", F.coalesce("prev_qty", F.lit(0.0)).alias("prev_qty"), F.coalesce("qty", F.lit(0.0)).alias("qty"), ((F.unix_micros(ts) - F.unix_micros(pts)) / 1e6).alias("seconds"))


def absorption_rate(df: DataFrame, p: Panel = PANEL) -> DataFrame:
    """Quantity taken from the previous book per second and side."""
    ch = level_changes(df, p)
    return ch.groupBy(*p.keys, "ts", "side").agg(safe_div(F.sum(F.greatest(F.col("prev_qty") - F.col("qty"), F.lit(0.0))), F.max("seconds")).alias("absorption"))


def trade_features(df: DataFrame, seconds: int = 300, p: Panel = Panel(order=("ts", "trade_id"))) -> DataFrame:
    """buy share, large-trade count (> 10 x mean), volume, count, mean size, vwap over the trailing seconds per trade."""
    d = df.withColumn("_b", F.when(F.col("side") == "buy", F.col("volume")).otherwise(0.0)).withColumn("_x", F.col("price") * F.col("volume"))

    def calc(t, lo, hi):
        v, known = frames.numbers(t, "volume")
        total, n = frames.sums(t, "volume", lo, hi), hi - lo
        large = frames.count_above(v, known, 10 * (total.fill_null(np.nan).to_numpy(zero_copy_only=False) / n), lo, hi)
        large = np.where(frames.counts(known, lo, hi) == 0, 0, large)
        return {"_bv": frames.sums(t, "_b", lo, hi), "win_volume": total, "win_count": pa.array(n), "_pv": frames.sums(t, "_x", lo, hi), "large_trades": pa.array(large.astype(np.int32))}

    d = frames.trailing(d, p.keys, seconds * 1_000_000, calc, {"_bv": DoubleType(), "win_volume": DoubleType(), "win_count": LongType(), "_pv": DoubleType(), "large_trades": IntegerType()}, ts=p.order[0], timeless=True)
    m = F.col("win_volume") / F.col("win_count")
    return d.select(*df.columns, safe_div("_bv", "win_volume").alias("buy_share"), "large_trades", "win_volume", "win_count", m.alias("mean_size"), safe_div("_pv", "win_volume").alias("win_vwap"))


def liquidity_score() -> Column:
    """Points for volume, spread (basis points), depth and balance, divided by 100."""
    v, bps = volume("bids") + volume("asks"), 10000 * ratio(best("asks") - best("bids"), mid())
    d, im = F.least(F.size("bids"), F.size("asks")), F.abs(imbalance(10))
    pts = (F.when(v > 1e6, 40).when(v > 1e5, 30).when(v > 1e4, 20).when(v > 1e3, 10).otherwise(0) + F.when(bps < 5, 30).when(bps < 10, 20).when(bps < 25, 10).otherwise(0)
           + F.when(d >= 20, 20).when(d >= 15, 15).when(d >= 10, 10).when(d >= 5, 5).otherwise(0) + F.when(im < .1, 10).when(im < .2, 7).when(im < .3, 5).otherwise(0))
    return pts / 100.0


def feature_row(df: DataFrame, n: int = 10) -> DataFrame:
    """The order-book feature columns of a snapshot plus compact vectors; one projection."""
    d = df.select("*", *spread_columns(), *depth_columns(n), imbalance(5).alias("imbalance_5"), imbalance(n).alias("imbalance"), weighted_imbalance(n).alias("weighted_imbalance"), weighted_mid(n).alias("weighted_mid"),
                  depth_slope("bids", n).alias("bid_slope"), depth_slope("asks", n).alias("ask_slope"), wall("bids").alias("bid_wall"), wall("asks").alias("ask_wall"), liquidity_score().alias("liquidity"))
    return (d.withColumn("imbalance_vec", F.array("imbalance_5", "imbalance", "weighted_imbalance", "depth_imbalance"))
             .withColumn("depth_vec", F.array("bid_depth", "ask_depth", "total_depth", "bid_slope", "ask_slope")).withColumn("spread_vec", F.array("spread", "spread_pct", "half_spread")))


def state_block(df: DataFrame, n: int = 24, p: Panel = PANEL) -> DataFrame:
    """z-scores of spread and depth plus the run length of the imbalance sign."""
    from tapeworks.plans.panel import islands
    from pyspark.sql import Window
    w = p.trailing(n)
    z = lambda c: F.coalesce(safe_div(F.col(c) - F.avg(c).over(w), F.stddev_samp(c).over(w)), F.lit(0.0))
    d = df.withColumn("spread_z", z("spread_pct")).withColumn("depth_z", z("total_depth")).withColumn("_s", F.signum("imbalance"))
    d = islands(d, p, F.col("_s"), "_isl")
    return d.withColumn("imbalance_run", F.row_number().over(Window.partitionBy(*p.keys, "_isl").orderBy(*p.order))).drop("_s", "_isl")
