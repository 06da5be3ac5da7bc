"""Findings of the fourth review: what failed before, on rows built here."""
from datetime import datetime, timedelta

import numpy as np

from tapeworks.operators import patterns as PT


def plan(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def bars(spark, n=90, keys=("a", "b", None)):
    """Daily bars, some over a wide range, some from a price of zero."""
    rng = np.random.default_rng(4)
    rows = []
    for k in keys:
        for i in range(n):
            low = 0.0 if i % 31 == 30 else float(100 + rng.integers(-4, 5))
            high = low + float(rng.integers(0, 3)) if i % 7 or not low else 2 * low
            rows.append((k, datetime(2024, 1, 1) + timedelta(days=i), high, low, float(rng.uniform(low, high))))
    return spark.createDataFrame(rows, "symbol string, ts timestamp, high double, low double, close double")


def validated(levels, bars, tol=0.01):
    """touches, bounces and breaks of each level, pair by pair; bars hold their next close."""
    out = {}
    for symbol, at, price, kind in levels:
        hit = [b for b in bars if b[0] == symbol and b[1] > at and b[3] <= price * (1 + tol) and b[2] >= price * (1 - tol)]
        broke = [b[4] < price * (1 - tol) if kind == "support" else b[4] > price * (1 + tol) for b in hit]
        bounce = [not x and b[5] is not None and (b[5] > b[4] if kind == "support" else b[5] < b[4]) for x, b in zip(broke, hit)]
        if hit:
            out[symbol, at, price, kind] = (len(hit), sum(bounce), sum(broke), hit[0][1], hit[-1][1])
    return out


def test_f3_levels_against_every_bar_with_null_keys_and_zero_prices(spark):
    b = bars(spark)
    lv = PT.smoothed_peaks(b)
    own = [tuple(r) for r in b.orderBy("symbol", "ts").collect()]
    own = [(*x, y[4] if y and y[0] == x[0] else None) for x, y in zip(own, [*own[1:], None])]
    got = {(r.symbol, r.level_ts, r.price, r.kind): (r.touches, r.bounces, r.breaks, r.first_touch, r.last_touch) for r in PT.validate_levels(lv, b).collect()}
    assert got == validated([tuple(r) for r in lv.collect()], own) and {x[0] for x in got} == {"a", "b", None}


def test_f3_bars_move_no_further_than_for_the_window(spark):
    b = bars(spark).repartition(7, "symbol")
    shown = plan(PT.validate_levels(PT.smoothed_peaks(b), b))
    assert "Generate" not in shown and "hashpartitioning(symbol" in shown
    again = [x for x in shown.split("\n") if "hashpartitioning(symbol" in x and "ENSURE_REQUIREMENTS" in x]
    assert len(again) == 1 and "level_ts" in again[0]  # the sums of keys with a null


def test_f2_lifecycle_query_copies_no_bars(spark, tmp_path):
    from tapeworks.queries import load_all

    rng = np.random.default_rng(2)
    rows = [(i, i % 9, i % 2, 1, 2.0, float(rng.uniform(180, 220)), "R", datetime(1998, 1, 1) + timedelta(days=i // 2)) for i in range(300)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_shipdate timestamp"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    out = load_all(["patterns"])[0]["level_lifecycle"](spark, str(tmp_path))
    assert "Generate" not in plan(out)
    assert {r.status for r in out.collect()} <= {"active", "broken", "expired"} and out.count() > 20
