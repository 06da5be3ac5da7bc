"""Findings of the third review on growth: what failed before, on rows built here."""
import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeworks.operators import indicators as I
from tapeworks.operators import orderflow as OF
from tapeworks.operators import patterns as PT
from tapeworks.plans import panel as PN
from tapeworks.plans.panel import Panel, day_bucket, frame_parts
from tapeworks.queries import ranking as RQ


def plan(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def bars(spark, n=240, symbols=3):
    """Bars made by a range, so that a plan shows whether it makes them again."""
    i = F.floor(F.col("id") / symbols)
    close = 100 + 7 * F.sin(F.col("id") * 0.7) + F.col("id") % 11
    return spark.range(n * symbols).select((F.col("id") % symbols).alias("symbol"), F.timestamp_seconds(1_700_000_000 + i * 86400).alias("ts"), close.alias("open"),
                                           (close + 1 + F.col("id") % 5).alias("high"), (close - 1 - F.col("id") % 3).alias("low"), close.alias("close"),
                                           (10.0 + F.col("id") % 17).alias("volume"), F.lit(1).cast("long").alias("n_trades"))


def ticks(spark, n=400):
    rows = [("ab"[i % 2], datetime(2024, 1, 1) + timedelta(minutes=37 * i), i, 50 + 9 * math.sin(i), float(1 + i * i % 7), "buy" if i % 5 < 2 else "sell") for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, trade_id long, price double, volume double, side string")


@pytest.mark.parametrize("n", [1, 2, 14, 20, 21, 50])
def test_f14_frame_parts_against_brute_force(spark, n):
    rng = np.random.default_rng(n)
    rows = [(k, i, None if rng.random() < 0.2 else float(rng.integers(-9, 9))) for k, size in (("a", 60), ("b", 3)) for i in range(size)]
    d = frame_parts(spark.createDataFrame(rows, "symbol string, ts int, x double"), Panel(), n, {"s": F.col("x")}, {"hi": F.col("x")}, {"lo": F.col("x")}, {"back": F.col("x")})
    for r in d.collect():
        f = [x for k, i, x in rows if k == r.symbol and r.ts - n < i <= r.ts]
        have = [x for x in f if x is not None]
        assert (r.s, r.s_n) == (sum(have) if have else None, len(have))
        assert (r.hi, r.lo) == ((max(have), min(have)) if have else (None, None))
        assert r.back == sum(k * (x or 0.0) for k, x in enumerate(reversed(f)))


def test_f14_volume_indicators_add_no_trailing_frame_anew(spark):
    shown = plan(I.cmf(I.mfi(I.vwap(bars(spark), 20))))
    assert not any(f"RowFrame, -{k}, currentrow" in shown for k in (13, 19, 20))


def test_f17_rolling_levels_without_a_regression_for_every_frame(spark):
    p, d = Panel(), bars(spark, 50)
    got = I.rolling_levels(d)
    assert "regr_slope" not in plan(got)
    w, c = p.trailing(20), p.frame(-10, 9)
    want = d.withColumn("i", F.row_number().over(p.w)).select(
        "symbol", "ts", F.when(F.count("close").over(w) == 20, F.regr_slope("close", "i").over(w)).alias("a"), F.when(F.count("close").over(c) == 20, F.min("low").over(c)).alias("b"))
    want = want.withColumn("b", F.last("b", True).over(p.cum))
    x = {(r.symbol, r.ts): (r.trend_strength, r.support) for r in got.collect()}
    for r in want.collect():
        slope, support = x[r.symbol, r.ts]
        assert support == r.b and (slope is None) == (r.a is None) and (slope is None or abs(slope - r.a) < 1e-9)


def test_f13_patterns_take_the_positions_of_the_metrics(spark):
    t, b = ticks(spark), day_bucket()
    once = OF.delta_patterns(OF.delta_metrics(t, b, position="place"), b, position="place")
    assert plan(once).count("Scan ExistingRDD") + plan(once).count("LocalTableScan") <= 4
    again = OF.delta_patterns(OF.delta_metrics(t, b), b)
    cols = ["trade_id", "cum_delta", "buy_imbalance", "sell_imbalance", "bear_divergence", "bull_divergence"]
    assert sorted(once.select(cols).collect()) == sorted(again.select(cols).collect())


def test_f13_running_moves_rows_once_and_meets_no_join(spark):
    t = ticks(spark)
    out = PN.running(t, Panel(order=("ts", "trade_id")), {"s": ("sum", F.col("volume")), "n": ("sum", F.lit(1)), "top": ("max", F.col("price"))}, day_bucket())
    assert "Join" not in plan(out)
    assert set(out.columns) == {*t.columns, "s", "n", "top"}
    rows = {r.trade_id: r for r in out.collect()}
    for k in range(2):
        mine = [rows[i] for i in range(400) if i % 2 == k]
        assert [r.n for r in mine] == list(range(1, 201)) and [r.s for r in mine] == list(np.cumsum([r.volume for r in mine]))
        assert [r.top for r in mine] == list(np.maximum.accumulate([r.price for r in mine]))


def test_f18_f20_parts_of_bars_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(PN, "TARGET", 0)
    monkeypatch.setattr(PN, "SHARE", 10)
    few, many = PN.spread(bars(spark, 40), ("symbol",)), PN.spread(bars(spark, 400), ("symbol",))
    assert many.rdd.getNumPartitions() >= 9 * few.rdd.getNumPartitions()
    assert plan(I.ema(many, 12)).count("Exchange") == 1


def test_f19_divergences_read_the_bars_once(spark):
    d = bars(spark).withColumn("d_close", 5 * F.sin(F.unix_seconds("ts") / 86400 * 0.9) + F.col("symbol"))
    out = OF.divergences(d)
    assert "Range (" not in plan(out) and out.count() > 0


def test_f21_ranker_reads_the_bars_once(spark, monkeypatch):
    monkeypatch.setattr(RQ.A, "daily_bars", lambda s, d: bars(s))
    from tapeworks.queries import load_all
    assert "Range (" not in plan(load_all()[0]["rank_pairwise_boosted"](spark, ""))


def test_f22_combined_levels_read_the_bars_once(spark):
    out = PT.combined_levels(bars(spark, 60))
    assert "Range (" not in plan(out) and {r.source for r in out.select("source").distinct().collect()} >= {"pivot", "peak", "psychological"}
