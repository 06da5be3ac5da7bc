"""Distributed plan shapes against plain windows, pandas and numpy."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeworks.operators import indicators as I
from tapeworks.plans import Panel, average_ranks, cumulative_counts, median_mad, number_rows, on_chunks, quantiles, running
from tapeworks.plans.asof import asof_join
from tapeworks.plans.panel import day_bucket, hour_bucket, islands

P = Panel(("symbol",), ("ts", "trade_id"))


def by_id(df, *cols):
    return df.select("trade_id", *cols).toPandas().sort_values("trade_id", ignore_index=True)


def test_number_rows_equals_row_number(tape):
    a = by_id(number_rows(tape, P, hour_bucket(), "rn"), "rn")
    b = by_id(tape.withColumn("rn", F.row_number().over(P.w)), "rn")
    assert (a["rn"] == b["rn"]).all() and len(a) == tape.count()


def test_null_keys_survive(spark):
    d = spark.createDataFrame([(None, 1, 2.0), (None, 2, 3.0), ("a", 1, 5.0)], "k string, t int, v double")
    r = running(d, Panel(("k",), ("t",)), {"s": ("sum", F.col("v"))}, F.col("t"))
    assert sorted((x.k or "", x.s) for x in r.collect()) == [("", 2.0), ("", 5.0), ("a", 5.0)]


@pytest.mark.parametrize("rows", [10, 37, 5000])
def test_chunked_windows_equal_plain(tape, rows):
    fn = lambda d, p: d.withColumn("m", F.avg("price").over(p.trailing(9))).withColumn("nx", F.max("price").over(p.ahead(4)))
    a = by_id(on_chunks(tape, P, fn, bucket=day_bucket(), before=8, after=4, rows=rows), "m", "nx")
    b = by_id(fn(tape, P), "m", "nx")
    pd.testing.assert_frame_equal(a, b)


def test_running_scans(tape):
    specs = {"s": ("sum", F.col("volume")), "mx": ("max", F.col("price")), "l": ("last", F.when(F.col("volume") == 4, F.col("price")))}
    a = by_id(running(tape, P, specs, hour_bucket()), "s", "mx", "l")
    b = by_id(tape.select("trade_id", F.sum("volume").over(P.cum).alias("s"), F.max("price").over(P.cum).alias("mx"), F.last(F.when(F.col("volume") == 4, F.col("price")), True).over(P.cum).alias("l")), "s", "mx", "l")
    pd.testing.assert_frame_equal(a, b)


def test_quantiles_match_numpy_with_heavy_ties(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([np.full(700, 3.25), rng.normal(size=900), [1e9, -1e9]])
    d = spark.createDataFrame(pd.DataFrame({"k": "a", "v": x})).repartition(5)
    r = quantiles(d, F.col("v"), {"a": .01, "b": .33, "c": .5, "d": .999}, ["k"], blocks=8).first()
    assert np.allclose([r.a, r.b, r.c, r.d], np.quantile(x, [.01, .33, .5, .999]))
    g = quantiles(d, F.col("v"), {"c": .5}, blocks=8).first()
    assert g.c == np.median(x) and g.n == len(x)


def test_ranks_and_mad(spark):
    x = [5.0, 1.0, 5.0, 2.0, 2.0, 9.0, None]
    d = spark.createDataFrame(list(enumerate(x)), "i int, v double")
    r = average_ranks(d, "v", "rk").toPandas().sort_values("i")
    assert np.allclose(r["rk"][:-1], pd.Series(x[:-1]).rank()) and pd.isna(r["rk"].iloc[-1])
    m = median_mad(d, F.col("v")).first()
    a = np.array(x[:-1])
    assert np.isclose(m.med, np.median(a)) and np.isclose(m.mad, 1.4826 * np.median(np.abs(a - np.median(a))))
    c = cumulative_counts(d, F.col("v")).orderBy("_v").toPandas()
    assert list(c["cum_n"]) == [1, 3, 5, 6]


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
def test_asof_matches_pandas(tape, direction):
    t = tape.where("side = 'buy'").select("symbol", "ts", "trade_id")
    q = tape.where("side = 'sell'").select("symbol", "ts", F.col("price").alias("q"))
    r = asof_join(t, q, ["symbol"], "ts", ["q"], bucket=hour_bucket(), direction=direction).toPandas().sort_values("trade_id", ignore_index=True)
    e = pd.merge_asof(t.toPandas().sort_values("ts"), q.toPandas().sort_values("ts"), on="ts", by="symbol", direction=direction).sort_values("trade_id", ignore_index=True)
    assert np.allclose(r["q"].fillna(-1), e["q"].fillna(-1))


@pytest.mark.parametrize("span", [1, 2, 9, 60])
def test_ema_matches_pandas(tape, span):
    a = by_id(I.ema(tape, span, "price", P, "e", bucket=day_bucket()), "symbol", "price", "e")
    b = a.groupby("symbol")["price"].transform(lambda s: s.ewm(span=span, adjust=False).mean())
    assert np.allclose(a["e"], b, rtol=1e-9)
    c = by_id(I.ema(tape, span, "price", P, "e", adjust=True), "e")
    d = a.groupby("symbol")["price"].transform(lambda s: s.ewm(span=span, adjust=True).mean())
    assert np.allclose(c["e"], d, rtol=1e-9)


def test_ema_over_many_chunks(spark):
    n = 5000
    d = spark.range(n).select(F.lit("s").alias("symbol"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.col("id").alias("trade_id"), (50 + 20 * F.sin(F.col("id") / 31.0)).alias("price"))
    a = by_id(I.ema(d, 3, "price", P, "e"), "price", "e")
    assert np.allclose(a["e"], a["price"].ewm(span=3, adjust=False).mean(), rtol=1e-9)


def test_islands_count_from_one(spark):
    d = spark.createDataFrame([("a", i, v) for i, v in enumerate("xxyyxz")], "symbol string, ts int, v string")
    assert [r.island for r in islands(d, Panel(), F.col("v")).orderBy("ts").collect()] == [1, 1, 2, 2, 3, 4]


def test_skewed_key_spreads_over_tasks(spark, tape):
    """The hot symbol never sits in one window partition."""
    seen = on_chunks(tape, P, lambda d, p: d.withColumn("c", F.col("_chunk")), bucket=day_bucket(), before=2, rows=100)
    sizes = seen.where("symbol = 'hot'").groupBy("c").count().toPandas()["count"]
    assert sizes.max() <= 100 and len(sizes) > 5


def test_hot_buckets_are_cut_by_count(spark, monkeypatch):
    """One key, one day, most rows: positions and sums stay exact and no bucket holds more than the target."""
    from tapeworks.plans import panel as plans

    monkeypatch.setattr(plans, "TARGET", 50)
    d = spark.range(900).select(F.when(F.col("id") % 10 == 0, "cold").otherwise("hot").alias("symbol"),
                                (F.lit("2024-01-01").cast("timestamp") + F.make_interval(secs=(F.col("id") * F.col("id") / 12.0).cast("decimal(18,6)"))).alias("ts"), "id")
    p = Panel(("symbol",), ("ts", "id"))
    fine = plans.sized(d, p, day_bucket())
    assert d.groupBy("symbol", fine.alias("b")).count().agg(F.max("count")).first()[0] <= 50
    got = running(number_rows(d, p, day_bucket(), "pos"), p, {"total": ("sum", F.col("id"))}, day_bucket()).toPandas().sort_values("id")
    for _, g in got.groupby("symbol"):
        assert (g.pos.to_numpy() == range(1, len(g) + 1)).all() and (g.total == g.id.cumsum()).all()


def test_many_blocks(spark):
    d = spark.range(3000).select((F.col("id") * 7919 % 1009 / 3.0).alias("x"))
    few, many = (cumulative_counts(d, F.col("x"), blocks=b).select("_v", "cum_n", "tot_n").toPandas().sort_values("_v").reset_index(drop=True) for b in (32, 400))
    assert few.equals(many)


def test_blocks_follow_counted_values_not_the_estimate(spark, tape):
    from tapeworks.plans import orderstats, panel
    d = spark.range(6000).selectExpr("id % 7 AS k", "id AS v")
    joined = d.join(d.withColumnRenamed("v", "w"), "k").join(d.withColumnRenamed("v", "x"), "k").where("v = w AND w = x")
    assert orderstats.rounds(joined)[1] == [32]
    assert orderstats.block_rounds(6000) == [32] and orderstats.block_rounds(10**9) == [501]
    many = orderstats.block_rounds(10**13)
    assert len(many) == 3 and max(many) <= 1024 and many[0] * many[1] * many[2] * panel.TARGET >= 10**13
    assert panel.size_estimate(joined) < 100_000


def test_two_rounds_of_edges_count_alike(spark, monkeypatch):
    from tapeworks.plans import orderstats
    d = spark.range(5000).selectExpr("id % 3 AS k", "cast((id * 7919) % 1000 AS double) AS v")
    one = {tuple(r) for r in orderstats.cumulative_counts(d, F.col("v"), ["k"]).select("k", "_v", "n", "cum_n", "tot_n").collect()}
    monkeypatch.setattr(orderstats, "rounds", lambda t: (t, [5, 4]))
    two = {tuple(r) for r in orderstats.cumulative_counts(d, F.col("v"), ["k"]).select("k", "_v", "n", "cum_n", "tot_n").collect()}
    assert one == two and len(one) == 3000
