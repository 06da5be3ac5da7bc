"""Order-flow operators over trades and order events.

Trade and event keys are unbounded (one symbol or account may hold a third of the stream), so
row-count frames run through ``on_chunks`` and cumulative delta through ``running``.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from tapeworks.functions.mathx import clip, ratio, safe_div
from tapeworks.plans import frames
from tapeworks.plans.asof import asof_join
from tapeworks.plans.orderstats import attach_stats
from tapeworks.plans.panel import Panel, frame_parts, hour_bucket, islands, join_on, on_chunks, running
from tapeworks.session import ensure_checkpoint_dir

TAPE = Panel(("symbol",), ("ts", "trade_id"))
EVENTS = Panel(("account_id",), ("ts", "event_id"))


def signed_volume() -> Column:
    return F.when(F.col("side") == "buy", F.col("volume")).otherwise(-F.col("volume"))


def classify_trades(trades: DataFrame, quotes: DataFrame, bucket: Column, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """side from the prevailing mid: at or above it is a buy."""
    j = asof_join(trades, quotes.select(*keys, "ts", "mid"), keys, "ts", ["mid"], bucket=bucket, prefix="q_")
    return j.withColumn("side", F.when(F.col("q_mid").isNull(), None).when(F.col("price") >= F.col("q_mid"), "buy").otherwise("sell"))


def cumulative_delta(df: DataFrame, bucket: Column, p: Panel = TAPE, position: str | None = None) -> DataFrame:
    """Running signed volume; ``position`` names a column for the row's place in its key, from the same pass."""
    return running(df, p, {"cum_delta": ("sum", signed_volume())} | ({position: ("sum", F.lit(1))} if position else {}), bucket)


def delta_metrics(df: DataFrame, bucket: Column, n: int = 50, p: Panel = TAPE, rows: int = 50_000, position: str | None = None) -> DataFrame:
    """Last-n-trade buy/sell/net volume, ratio, strength (= VPIN), momentum against the mean of 10 values, cumulative delta.

    ``position`` names a column for the row's place in its key, which ``delta_patterns`` can use.
    """
    place = position or "_place"
    d = cumulative_delta(df, bucket, p, place)

    def fn(x, q):
        buy = F.col("side") == "buy"
        x = frame_parts(x, q, n, {"buy_volume": F.when(buy, F.col("volume")).otherwise(0.0), "sell_volume": F.when(buy, 0.0).otherwise(F.col("volume"))})
        x = x.drop("buy_volume_n", "sell_volume_n").withColumn("net_delta", F.col("buy_volume") - F.col("sell_volume"))
        tot = F.col("buy_volume") + F.col("sell_volume")
        x = x.withColumn("delta_ratio", safe_div("buy_volume", tot, 0.5)).withColumn("strength", safe_div(F.abs("net_delta"), tot))
        x = x.withColumn("_m", F.avg("net_delta").over(q.trailing(10)))
        return x.withColumn("momentum", (F.col("net_delta") - F.col("_m")) / (F.abs("_m") + 1e-6)).drop("_m")

    out = on_chunks(d, p, fn, before=n + 10, rows=rows, position=place)
    return out if position else out.drop(place)


def delta_patterns(metrics: DataFrame, bucket: Column, p: Panel = TAPE, threshold: float = 0.7, rows: int = 50_000, position: str | None = None) -> DataFrame:
    """Flags per row: buy/sell imbalance (>= 7 of 11), exhaustion (20), acceleration (15 rows), price/delta divergence (30)."""
    def fn(x, q):
        w11, w30 = q.trailing(11), q.trailing(30)
        x = x.withColumn("_nb", F.sum((F.col("delta_ratio") > threshold).cast("int")).over(w11)).withColumn("_ns", F.sum((F.col("delta_ratio") < 1 - threshold).cast("int")).over(w11))
        x = x.withColumn("_rec", F.avg("momentum").over(q.trailing(5)))
        x = x.withColumn("_acc", F.when(F.col("_rn") >= 15, F.col("_rec") - F.avg("momentum").over(q.frame(-14, -10))))
        x = x.withColumn("_pt", F.regr_slope("price", "_pos").over(w30)).withColumn("_dt", F.regr_slope("cum_delta", "_pos").over(w30))
        m10, s20 = F.avg("momentum").over(q.frame(-19, -10)), F.avg("strength").over(q.frame(-19, -10))
        x = x.withColumn("_weak", (F.abs("_rec") < F.abs(m10)) & (F.avg("strength").over(q.trailing(5)) < s20))
        z = lambda c: F.coalesce(c, F.lit(False)).cast("int")
        ok30 = F.col("_rn") >= 30
        flags = {
            "buy_imbalance": (F.col("_nb") >= 7) & (F.col("_rn") > 10),
            "sell_imbalance": (F.col("_ns") >= 7) & (F.col("_rn") > 10) & (F.col("_nb") < 7),
            "bull_exhaustion": (F.col("momentum") > 0) & F.col("_weak") & (F.col("_rn") >= 20),
            "bear_exhaustion": (F.col("momentum") < 0) & F.col("_weak") & (F.col("_rn") >= 20),
            "acceleration": F.col("_acc") > 0.1,
            "bear_divergence": ok30 & (F.col("_pt") > 0) & (F.col("_dt") < -0.1),
            "bull_divergence": ok30 & (F.col("_pt") < 0) & (F.col("_dt") > 0.1),
        }
        x = x.select("*", *[z(c).alias(n) for n, c in flags.items()])
        return x.drop("_nb", "_ns", "_acc", "_rec", "_pt", "_dt", "_weak")
    return on_chunks(metrics, p, fn, bucket=bucket, before=30, rows=rows, position=position)


def delta_bars(df: DataFrame, freq: str, bucket: Column, p: Panel = TAPE) -> DataFrame:
    """OHLC of running delta with volumes per bar."""
    d = cumulative_delta(df, bucket, p, "_place")
    o = F.col("_place")  # a number keeps the aggregate hashed, a struct would make it sort
    buy = F.col("side") == "buy"
    g = d.groupBy(*p.keys, F.window("ts", freq).alias("_w")).agg(
        F.min_by("cum_delta", o).alias("d_open"), F.max("cum_delta").alias("d_high"), F.min("cum_delta").alias("d_low"), F.max_by("cum_delta", o).alias("d_close"),
        F.sum(F.when(buy, F.col("volume")).otherwise(0.0)).alias("buy_volume"), F.sum(F.when(buy, 0.0).otherwise(F.col("volume"))).alias("sell_volume"),
        F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", o).alias("close"))
    return g.select(*p.keys, F.col("_w.start").alias("ts"), *[c for c in g.columns if c not in (*p.keys, "_w")])


def delta_profile(df: DataFrame, tick: float, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    lvl = F.round(F.col("price") / tick) * tick
    return df.groupBy(*keys, lvl.alias("level")).agg(F.sum(signed_volume()).alias("delta"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n"), F.avg("volume").alias("mean_size"))


def top_levels(profile: DataFrame, k: int, by: str = "volume", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(by), "level")
    return profile.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def divergences(bars: DataFrame, p: Panel = Panel(), n: int = 2) -> DataFrame:
    """Regular and hidden divergence: successive price extremes against the closest delta extremes in time.

    ``bars`` carries high, low, close delta (d_close); extremes are strict within +-n bars.
    """
    def flag(c, hi):
        f = F.max if hi else F.min
        b, a = f(c).over(p.frame(-n, -1)), f(c).over(p.frame(1, n))
        x = F.col(c)
        return (x > b) & (x > a) if hi else (x < b) & (x < a)

    ensure_checkpoint_dir(bars.sparkSession)
    d = bars.select(*p.keys, "ts", "high", "low", "d_close", *[flag(c, h).alias(m) for c, h, m in (("high", True, "_ph"), ("low", False, "_pl"), ("d_close", True, "_dh"), ("d_close", False, "_dl"))])
    d = d.where("_ph OR _pl OR _dh OR _dl").checkpoint()  # both joins read the extremes several times
    out = None
    for pf, df_, price, up in (("_ph", "_dh", "high", True), ("_pl", "_dl", "low", False)):
        px = d.where(pf).select(*p.keys, "ts", F.col(price).alias("price"))
        dx = d.where(df_).select(*p.keys, "ts", F.col("d_close").alias("delta"))
        j = asof_join(px, dx, p.keys, "ts", ["delta"], bucket=F.date_trunc("month", "ts"), direction="nearest").where(F.col("delta").isNotNull())
        j = j.withColumn("prev_price", F.lag("price").over(p.w)).withColumn("prev_delta", F.lag("delta").over(p.w)).where(F.col("prev_price").isNotNull())
        dp, dd = F.col("price") - F.col("prev_price"), F.col("delta") - F.col("prev_delta")
        kind = F.when((dp > 0) & (dd < 0), "bearish_regular" if up else "bullish_hidden").when((dp < 0) & (dd > 0), "bearish_hidden" if up else "bullish_regular")
        r = j.withColumn("kind", kind).where(F.col("kind").isNotNull()).select(*p.keys, "ts", "price", "prev_price", "delta", "prev_delta", "kind")
        out = r if out is None else out.unionByName(r)
    return out


# -- footprint ----------------------------------------------------------------------------

def footprint(df: DataFrame, freq: str, tick: float, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """bar x price-tick buy/sell volume with an imbalance class (.8 / .65 / .35 / .2 of buy share)."""
    buy = F.col("side") == "buy"
    g = df.groupBy(*keys, F.window("ts", freq).alias("_w"), F.round(F.col("price") / tick).cast("bigint").alias("level")).agg(
        F.sum(F.when(buy, F.col("volume")).otherwise(0.0)).alias("buy"), F.sum(F.when(buy, 0.0).otherwise(F.col("volume"))).alias("sell"), F.count(F.lit(1)).alias("n"))
    share = safe_div("buy", F.col("buy") + F.col("sell"), 0.5)
    cls = F.when(share >= .8, "strong_buy").when(share >= .65, "buy").when(share <= .2, "strong_sell").when(share <= .35, "sell").otherwise("neutral")
    return g.select(*keys, F.col("_w.start").alias("ts"), "level", "buy", "sell", "n", (F.col("buy") + F.col("sell")).alias("volume"), (F.col("buy") - F.col("sell")).alias("delta"), cls.alias("imbalance"))


def footprint_patterns(fp: DataFrame, keys: Sequence[str] = ("symbol",), min_cluster: int = 3) -> DataFrame:
    """Per level: absorption against the previous bar's delta, cluster size of same-side neighbours, single print, poor high / low."""
    k = list(keys)
    bars = fp.groupBy(*k, "ts").agg(F.sum("delta").alias("_bd"), F.max("level").alias("_hi"), F.min("level").alias("_lo"), F.count(F.lit(1)).alias("_nl"), F.percentile("volume", 0.3).alias("_p30"))
    w = Window.partitionBy(*k).orderBy("ts")
    bars = bars.withColumn("_pd", F.lag("_bd").over(w)).withColumn("_pts", F.lag("ts").over(w)).withColumn("_nts", F.lead("ts").over(w))
    d = join_on(fp, bars, k + ["ts"])
    side = F.when(F.col("imbalance").isin("buy", "strong_buy"), 1).when(F.col("imbalance").isin("sell", "strong_sell"), -1).otherwise(0)
    d = islands(d.withColumn("_side", side), Panel((*k, "ts"), ("level",)), F.col("_side"), "_isl")
    d = d.withColumn("cluster", F.when(F.col("_side") != 0, F.count(F.lit(1)).over(Window.partitionBy(*k, "ts", "_isl"))).otherwise(0))
    lv = Window.partitionBy(*k, "level").orderBy("ts")
    seen_prev, seen_next = F.lag("ts").over(lv).eqNullSafe(F.col("_pts")), F.lead("ts").over(lv).eqNullSafe(F.col("_nts"))
    inner = F.col("_pts").isNotNull() & F.col("_nts").isNotNull()
    z = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    d = d.withColumn("_sp", z(inner & ~seen_prev & ~seen_next))
    return d.select(*k, "ts", "level", z((F.col("buy") > 2 * F.col("sell")) & (F.col("_pd") < 0)).alias("buy_absorption"), z((F.col("sell") > 2 * F.col("buy")) & (F.col("buy") > 0) & (F.col("_pd") > 0)).alias("sell_absorption"),
                    F.when(F.col("cluster") >= min_cluster, F.col("cluster")).otherwise(0).cast("bigint").alias("cluster"), F.col("_sp").alias("single_print"),
                    z((F.col("_nl") >= 5) & (F.col("level") == F.col("_hi")) & (F.col("volume") <= F.col("_p30"))).alias("poor_high"), z((F.col("_nl") >= 5) & (F.col("level") == F.col("_lo")) & (F.col("volume") <= F.col("_p30"))).alias("poor_low"))


def volume_nodes(fp: DataFrame, keys: Sequence[str] = ("symbol",), factor: float = 2.0, min_bars: int = 3) -> DataFrame:
    k = list(keys)
    g = fp.groupBy(*k, "level").agg(F.sum("volume").alias("volume"), F.sum("delta").alias("delta"), F.count(F.lit(1)).alias("bars"))
    m = g.groupBy(*k).agg(F.avg("volume").alias("_m"))
    d = join_on(g, m, k).where((F.col("volume") > factor * F.col("_m")) & (F.col("bars") >= min_bars))
    return d.select(*k, "level", "volume", "delta", "bars", F.when(F.col("delta") > 0, "bullish").when(F.col("delta") < 0, "bearish").otherwise("neutral").alias("kind"))


def structure_levels(fp: DataFrame, keys: Sequence[str] = ("symbol",), share: float = 0.2, merge: int = 2) -> DataFrame:
    """Levels that together hold the top ``share`` of volume, merged into zones where neighbours are within ``merge`` ticks."""
    k = list(keys)
    g = fp.groupBy(*k, "level").agg(F.sum("volume").alias("volume"))
    w = Window.partitionBy(*k).orderBy(F.desc("volume"), "level")
    d = g.withColumn("_before", F.sum("volume").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_tot", F.sum("volume").over(Window.partitionBy(*k)))
    d = d.where(F.coalesce(F.col("_before"), F.lit(0.0)) < share * F.col("_tot"))
    lw = Window.partitionBy(*k).orderBy("level")
    d = d.withColumn("_new", F.coalesce((F.col("level") - F.lag("level").over(lw) > merge).cast("int"), F.lit(1)))
    d = d.withColumn("_zone", F.sum("_new").over(lw.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*k, "_zone").agg(F.min("level").alias("low"), F.max("level").alias("high"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("levels")).drop("_zone")


# -- order events -------------------------------------------------------------------------

def with_last_place(df: DataFrame, bucket: Column) -> DataFrame:
    """Attach the latest earlier ``place`` of the same order id (ts, size, price) to every event."""
    item = F.when(F.col("event_type") == "place", F.struct(F.col("ts").alias("ts"), F.col("size").alias("size"), F.col("price").alias("price")))
    return running(df, Panel(("order_id",), ("ts", "event_id")), {"placed": ("last", item)}, bucket)


def quick_cancels(df: DataFrame, bucket: Column, limit: float = 5.0, minimum: float = 0.6) -> DataFrame:
    """Cancels within ``limit`` seconds of their place; confidence .6 time + .4 relative size."""
    d = with_last_place(df, bucket).where((F.col("event_type") == "cancel") & F.col("placed").isNotNull())
    d = d.withColumn("hold", (F.unix_micros("ts") - F.unix_micros("placed.ts")) / 1e6).where(F.col("hold") <= limit)
    d = attach_stats(d, df.agg(F.avg("size").alias("_m")), [], ["_m"])
    conf = 0.6 * (1 - F.col("hold") / limit) + 0.4 * F.least(F.col("placed.size") / (F.col("_m") + 1e-6), F.lit(5.0)) / 5
    large = F.col("placed.size") > 5 * F.col("_m")
    d = d.withColumn("confidence", conf).where(F.col("confidence") >= minimum)
    return d.select("event_id", "account_id", "order_id", "ts", "hold", "confidence", (F.col("confidence") * F.when(large, 1.0).otherwise(0.7)).alias("severity"))


def _range(keys: Sequence[str], us: str, seconds: float) -> "WindowSpec":
    return Window.partitionBy(*keys).orderBy(us).rangeBetween(-int(seconds * 1e6) + 1, 0)


def _sliced(df: DataFrame, seconds: float, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Time-sliced copy for range frames: each row joins its own slice and the next one if that slice's frames reach back to it.

    Slices are 60 windows long, so about one row in sixty is copied and a hot account spreads over all slices.
    """
    width = int(seconds * 60 * 1e6)
    us = F.unix_micros("ts")
    d = df.withColumn("_us", us).withColumn("_home", F.floor(F.col("_us") / width))
    return d.withColumn("_slice", F.explode(F.sequence(F.col("_home"), F.floor((F.col("_us") + int(seconds * 1e6)) / width)))), [*keys, "_slice"]


def layering(df: DataFrame, minimum: float = 0.6, window: float = 60.0, span: float = 30.0) -> DataFrame:
    """Places of one account and side within 60 s: >= 3 prices, size > 3 x mean, placed in < 30 s."""
    pl = df.where(F.col("event_type") == "place")
    d, keys = _sliced(pl, window, ("account_id", "side"))
    w = _range(keys, "_us", window)
    d = d.select("event_id", "account_id", "side", "ts", "_home", "_slice", F.size(F.collect_set("price").over(w)).alias("prices"), F.count(F.lit(1)).over(w).alias("orders"), F.sum("size").over(w).alias("total"), ((F.max("_us").over(w) - F.min("_us").over(w)) / 1e6).alias("span"))
    d = attach_stats(d.where(F.col("_home") == F.col("_slice")).drop("_home", "_slice"), df.agg(F.avg("size").alias("_m")), [], ["_m"])
    conf = F.least(F.col("prices") / 5 * 0.3 + F.col("total") / (F.col("_m") * 10) * 0.4 + (1 - F.col("span") / span) * 0.3, F.lit(1.0))
    ok = (F.col("prices") >= 3) & (F.col("total") > 3 * F.col("_m")) & (F.col("span") < span)
    return d.where(ok).withColumn("confidence", conf).where(F.col("confidence") >= minimum).drop("_m")


def quote_stuffing(df: DataFrame, keys: Sequence[str] = (), threshold: int = 10, window: float = 1.0) -> DataFrame:
    """More than ``threshold`` events in the trailing second with cancels > .7 of places."""
    marks = df.select("event_id", *keys, "ts", (F.col("event_type") == "place").alias("_place"), (F.col("event_type") == "cancel").alias("_cancel"))

    def calc(t, lo, hi):
        known = frames.counts(pc.is_valid(t["_place"].combine_chunks()).to_numpy(zero_copy_only=False), lo, hi)
        of = lambda c: pa.array(frames.counts(t[c].combine_chunks().fill_null(False).to_numpy(zero_copy_only=False), lo, hi), mask=known == 0)
        return {"events": pa.array(hi - lo), "places": of("_place"), "cancels": of("_cancel")}

    d = frames.trailing(marks, keys, int(window * 1e6) - 1, calc, {"events": LongType(), "places": LongType(), "cancels": LongType()})
    d = d.where((F.col("events") > threshold) & (F.col("cancels") > 0.7 * F.col("places")))
    return d.select("event_id", *keys, "ts", "events", "places", "cancels", F.least(F.col("events") / 50, F.lit(1.0)).alias("confidence"))


def momentum_ignition(df: DataFrame, minimum: float = 0.6, window: float = 30.0, multiple: float = 5.0, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Large placements in the direction of the last 30 s of fills."""
    fill = F.col("event_type") == "fill"
    d = attach_stats(df.select("event_id", *keys, "ts", "side", "size", "price", "event_type"), df.agg(F.avg("size").alias("_m")), [], ["_m"])
    large = (F.col("event_type") == "place") & (F.col("size") >= multiple * F.col("_m"))
    d = d.withColumn("_fill", F.coalesce(fill, F.lit(False)))

    def calc(t, lo, hi):
        price, known = frames.numbers(t, "price")
        mark = t["_fill"].combine_chunks().to_numpy(zero_copy_only=False)
        rows = np.arange(len(mark))
        before = np.maximum.accumulate(np.where(mark, rows, -1))[hi - 1]
        after = np.minimum.accumulate(np.where(mark, rows, len(mark))[::-1])[::-1][lo]
        none = before < lo
        before, after = np.where(none, 0, before), np.where(none, 0, after)
        fills = frames.counts(mark & known, lo, hi)
        top = frames.fold(np.where(mark & known, price, -np.inf), lo, hi, np.maximum, -np.inf)
        low = frames.fold(np.where(mark & known, price, np.inf), lo, hi, np.fmin, np.inf)
        with np.errstate(invalid="ignore"):
            return {"fills": pa.array(fills), "trend": pa.array(price[before] - price[after], mask=none | ~known[before] | ~known[after]),
                    "move": pa.array(top - low, mask=fills == 0)}

    d = frames.trailing(d, keys, int(window * 1e6) - 1, calc, {"fills": LongType(), "trend": DoubleType(), "move": DoubleType()}, tie=("event_id",), asks=large, seen=fill)
    d = d.where(F.col("fills") >= 3).drop("_fill", "price")
    conf = F.least(F.col("size") / (F.col("_m") * 10) * 0.5 + safe_div(F.abs("trend"), "move") * 0.5, F.lit(0.9))
    same = F.when(F.col("side") == "buy", 1).otherwise(-1) == F.when(F.col("trend") > 0, 1).otherwise(-1)
    return d.where(same & (F.col("trend") != 0)).withColumn("confidence", conf).where(F.col("confidence") >= minimum).drop("_m", "event_type")


def ping_pong_windows(df: DataFrame, bucket: Column, window: float = 30.0, rows: int = 50_000) -> DataFrame:
    """One row per place -> cancel cycle with count, mean and regularity of the account's cycles in the trailing window."""
    def mark(x, q):
        nxt = lambda c: F.lead(c).over(q.w)
        hit = (F.col("event_type") == "place") & (nxt("event_type") == "cancel") & (nxt("order_id") == F.col("order_id"))
        x = x.withColumn("_cyc", F.coalesce(hit, F.lit(False))).withColumn("_gap", (F.unix_micros(nxt("ts")) - F.unix_micros("ts")) / 1e6)
        return x.withColumn("_end", nxt("ts")).withColumn("_eid", nxt("event_id"))
    d = on_chunks(df, EVENTS, mark, bucket=bucket, before=0, after=1, rows=rows).where("_cyc")
    s, ks = _sliced(d.withColumn("ts", F.col("_end")), window, ("account_id",))
    w = _range(ks, "_us", window)
    s = s.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("mean_gap", F.avg("_gap").over(w)).withColumn("sd_gap", F.stddev_pop("_gap").over(w)).where(F.col("_home") == F.col("_slice"))
    return s.select(F.col("_eid").alias("event_id"), "account_id", "ts", "n", "mean_gap", (1 - F.col("sd_gap") / (F.col("mean_gap") + 1e-6)).alias("regularity"))


def ping_pong(df: DataFrame, bucket: Column, minimum: float = 0.6, window: float = 30.0, cycles: int = 3, rows: int = 50_000) -> DataFrame:
    """Accounts repeating place -> cancel of the same order: >= 3 cycles in 30 s, regular and under 10 s apart."""
    s = ping_pong_windows(df, bucket, window, rows)
    conf = F.least(F.col("n") / 10 * 0.4 + (1 - F.col("mean_gap") / 10) * 0.3 + F.col("regularity") * 0.3, F.lit(0.9))
    ok = (F.col("n") >= cycles) & (F.col("mean_gap") < 10) & (F.col("regularity") > 0.5)
    return s.where(ok).withColumn("confidence", conf).where(F.col("confidence") >= minimum)


def account_profiles(df: DataFrame, bucket: Column) -> DataFrame:
    """Events, cancel rate, mean size, price levels, mean hold time of cancelled orders and a suspicion score per account."""
    d = with_last_place(df, bucket)
    hold = F.when((F.col("event_type") == "cancel") & F.col("placed").isNotNull(), (F.unix_micros("ts") - F.unix_micros("placed.ts")) / 1e6)
    g = d.groupBy("account_id").agg(F.count(F.lit(1)).alias("events"), F.avg((F.col("event_type") == "cancel").cast("double")).alias("cancel_rate"), F.avg("size").alias("mean_size"), F.count_distinct("price").alias("levels"),
                                    F.avg(hold).alias("mean_hold"), ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6).alias("_span"))
    sc = F.when(F.col("cancel_rate") > .8, .4).otherwise(F.col("cancel_rate") * .4) + F.when(F.col("mean_hold") < 5, .3).otherwise(0.0) + clip(F.col("events") / 100, 0.0, 1.0) * .3
    return g.withColumn("frequency", safe_div("events", "_span")).withColumn("suspicion", F.least(sc, F.lit(1.0))).drop("_span")


def signal_report(signals: DataFrame, kind: str = "kind", severity: str = "severity") -> DataFrame:
    """Counts by hour, type and severity class with subtotals."""
    sev = F.when(F.col(severity) > .8, "high").when(F.col(severity) > .5, "medium").otherwise("low")
    d = signals.select(F.date_trunc("hour", "ts").alias("hour"), F.col(kind).alias("kind"), sev.alias("level"), F.col(severity).alias("_s"))
    return d.rollup("kind", "level", "hour").agg(F.count(F.lit(1)).alias("n"), F.avg("_s").alias("mean_severity"))


# -- icebergs -----------------------------------------------------------------------------

def iceberg_levels(changes: DataFrame, keys: Sequence[str] = ("symbol",), min_refresh: int = 3, max_interval: float = 10.0, minimum: float = 0.6) -> DataFrame:
    """Price levels that refresh regularly: >= 3 refreshes, mean interval within the limit, regularity > .5; plus anomaly, turnover and stability measures.

    ``changes`` is the level-change table (symbol, ts, side, price, prev_qty, qty).
    """
    k = [*keys, "side", "price"]
    r = changes.where((F.col("prev_qty") > 0) & (F.col("qty") != F.col("prev_qty")) & (F.col("qty") > 0))
    w = Window.partitionBy(*k).orderBy("ts")
    r = r.withColumn("_iv", (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))) / 1e6)
    g = r.groupBy(*k).agg(F.count(F.lit(1)).alias("refreshes"), F.avg("_iv").alias("mean_interval"), F.stddev_pop("_iv").alias("_sd"), F.avg("qty").alias("mean_size"), F.stddev_pop("qty").alias("_sq"), F.sum("qty").alias("turnover"),
                          F.max("qty").alias("_mx"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    g = attach_stats(g, changes.where(F.col("qty") > 0).agg(F.avg("qty").alias("_m"), F.stddev_pop("qty").alias("_s")), [], ["_m", "_s"])
    reg = F.greatest(1 - safe_div("_sd", F.col("mean_interval") + 1e-6), F.lit(0.0))
    g = g.withColumn("regularity", reg).withColumn("size_z", safe_div(F.col("_mx") - F.col("_m"), F.col("_s"))).withColumn("cv", safe_div("_sq", "mean_size")).withColumn("turnover_ratio", safe_div("turnover", "_mx"))
    conf = F.least(F.col("refreshes") / 10 * 0.4 + F.col("regularity") * 0.3 + F.least(F.col("mean_size") / (F.col("_m") + 1e-6), F.lit(3.0)) / 3 * 0.3, F.lit(1.0))
    g = g.withColumn("confidence", conf).withColumn("hidden_size", F.col("turnover") * 0.7)
    z = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    refresh = (F.col("refreshes") >= min_refresh) & (F.col("mean_interval") <= max_interval) & (F.col("regularity") > 0.5) & (F.col("confidence") >= minimum)
    return g.select(*k, "refreshes", "mean_interval", "regularity", "mean_size", "turnover", "hidden_size", "confidence", "first_seen", "last_seen", z(refresh).alias("refresh_pattern"), z(F.col("size_z") > 2).alias("size_anomaly"),
                    z(F.col("turnover_ratio") > 2).alias("absorbing"), z((F.col("cv") < 0.2) & (F.col("refreshes") >= min_refresh)).alias("stable"))


def active_icebergs(levels: DataFrame, now: Column, seconds: int) -> DataFrame:
    return levels.where((F.col("refresh_pattern") == 1) & (F.unix_micros("last_seen") >= F.unix_micros(now) - seconds * 1_000_000))


def calibrate_multiplier(changes: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """max(2, 2 + deviation / mean of level sizes)."""
    return changes.where(F.col("qty") > 0).groupBy(*keys).agg(F.greatest(F.lit(2.0), 2 + safe_div(F.stddev_pop("qty"), F.avg("qty"))).alias("multiplier"))
