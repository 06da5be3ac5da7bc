"""Operators without a SQL counterpart, against brute force or known values."""
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeworks.functions import mathx as mx
from tapeworks.functions import text as T
from tapeworks.operators import anomaly as AN
from tapeworks.operators import crossasset as X
from tapeworks.operators import indicators as I
from tapeworks.operators import models as M
from tapeworks.operators import patterns as PT
from tapeworks.operators import quality as Q
from tapeworks.operators import selection as S
from tapeworks.operators import sentiment as SE
from tapeworks.operators import volatility as V
from tapeworks.plans.pairs import all_pairs, align_pairs, pair_table
from tapeworks.sources import readers as RD


def test_normal_and_chi2_tails(spark):
    xs = [-9.0, -3.2, -0.1, 0.0, 0.7, 2.5, 7.5, 12.0]
    d = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in d.select(mx.norm_sf("x")).collect()]
    assert np.allclose(got, [0.5 * math.erfc(x / math.sqrt(2)) for x in xs], rtol=1e-9)
    r = spark.range(1).select(mx.chi2_sf(F.lit(3.84), 1), mx.chi2_sf(F.lit(5.99), 2), mx.chi2_sf(F.lit(11.07), 5)).first()
    assert all(abs(v - .05) < 2e-4 for v in r)
    a = spark.range(1).select(mx.chi2_sf_any(F.lit(11.07), F.lit(5)).alias("p")).first()
    assert abs(a.p - r[2]) < 1e-12
    assert abs(mx.student_t_quantile(.975, 10) - 2.228139) < 1e-5


def test_safe_division(spark):
    r = spark.range(1).select(mx.safe_div(F.lit(1.0), F.lit(0.0)), mx.safe_log(F.lit(-1.0)), mx.safe_sqrt(F.lit(-4.0)), mx.clip(F.lit(9.0), 0.0, 5.0)).first()
    assert list(r) == [0.0, 0.0, 0.0, 5.0]


def test_rsi_bounds_and_flat(spark):
    n = 40
    up = spark.range(n).select(F.lit("u").alias("symbol"), F.timestamp_seconds("id").alias("ts"), (F.col("id") + 1.0).alias("close"))
    flat = spark.range(n).select(F.lit("f").alias("symbol"), F.timestamp_seconds("id").alias("ts"), F.lit(5.0).alias("close"))
    r = I.rsi(up.unionByName(flat), 14).toPandas()
    assert r[r.symbol == "u"].rsi_14.dropna().eq(100).all() and r[r.symbol == "f"].rsi_14.dropna().eq(50).all()
    assert r.groupby("symbol").rsi_14.apply(lambda s: s.isna().sum()).eq(14).all()


def sar_oracle(high, low, step=.02, cap=.2):
    sar, up, af, ep, out = low[0], True, step, high[0], [low[0]]
    for i in range(1, len(high)):
        sar = sar + af * (ep - sar)
        if up and low[i] <= sar or not up and high[i] >= sar:
            up, sar, af = not up, ep, step
            ep = high[i] if up else low[i]
        elif up and high[i] > ep or not up and low[i] < ep:
            ep, af = (high[i] if up else low[i]), min(af + step, cap)
        out.append(sar)
    return out


def test_parabolic_sar(spark):
    b = Q.synthetic_bars(spark, 2, 120)
    r = I.parabolic_sar(b).toPandas().sort_values(["symbol", "ts"])
    for _, g in r.groupby("symbol"):
        assert np.allclose(g["psar"], sar_oracle(g["high"].to_numpy(), g["low"].to_numpy()))


def test_grubbs_brute_force(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=80), [9.0, -8.0, 12.0]])
    got = AN.grubbs(spark.createDataFrame(pd.DataFrame({"k": "a", "v": x})), "v", "k").toPandas()
    rest, removed = list(x), []
    for _ in range(len(x) // 10):
        a, n = np.array(rest), len(rest)
        i = int(np.argmax(np.abs(a - a.mean())))
        g = abs(a[i] - a.mean()) / a.std(ddof=1)
        t = mx.student_t_quantile(1 - .05 / (2 * n), n - 2)
        if g <= (n - 1) / math.sqrt(n) * math.sqrt(t * t / (n - 2 + t * t)):
            break
        removed.append(rest.pop(i))
    assert sorted(got["value"]) == pytest.approx(sorted(removed)) and len(removed) >= 3


def test_isolation_forest_flags_spikes(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 2))
    x[10], x[400] = (12, 12), (-11, 13)
    d = spark.createDataFrame(pd.DataFrame({"i": range(600), "a": x[:, 0], "b": x[:, 1]}))
    r = AN.isolation_forest(d, ["a", "b"], "i", .02, trees=60, sample=128).toPandas().sort_values("score", ascending=False)
    assert {10, 400} <= set(r["i"].head(4)) and r["label"].sum() <= 20
    again = AN.isolation_forest(d.repartition(7), ["a", "b"], "i", .02, trees=60, sample=128).toPandas()
    assert np.allclose(r.sort_values("i")["score"], again.sort_values("i")["score"])


def test_near_duplicates_brute_force(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(120, 3))
    x[50:80] = x[0]
    d = spark.createDataFrame(pd.DataFrame({"i": range(120), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2]}))
    got = Q.near_duplicates(d, "i", ["a", "b", "c"], .95, group_rows=16).toPandas().set_index("i")
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    u = z / np.linalg.norm(z, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {i: s[i].max() for i in range(120) if s[i].max() > .95}
    assert set(got.index) == set(want) and np.allclose(got["cosine"].sort_index(), [want[i] for i in sorted(want)])


def test_spanning_tree_weight(spark):
    rng = np.random.default_rng(9)
    n = 12
    e = [(f"n{i:02d}", f"n{j:02d}", float(rng.random())) for i in range(n) for j in range(i + 1, n)]
    t = X.spanning_tree(spark.createDataFrame(e, "a string, b string, w double")).toPandas()
    parent = {}
    find = lambda v: v if parent.setdefault(v, v) == v else find(parent[v])
    total = 0
    for a, b, w in sorted(e, key=lambda r: r[2]):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            total += w
    assert len(t) == n - 1 and t["w"].sum() == pytest.approx(total)


def test_partial_correlation_and_pair_guard(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3))
    x[:, 1] += x[:, 0]
    x[:, 2] += x[:, 1]
    rows = [(s, i, float(x[i, j])) for j, s in enumerate("abc") for i in range(300)]
    d = spark.createDataFrame(rows, "symbol string, ts int, r double")
    p = {(r.a, r.b): r.partial for r in X.partial_correlation(d, list("abc")).collect()}
    prec = np.linalg.inv(np.cov(x.T))
    assert p[("a", "c")] == pytest.approx(-prec[0, 2] / math.sqrt(prec[0, 0] * prec[2, 2]), abs=1e-4)
    with pytest.raises(ValueError):
        pair_table(spark, [(i, i + 1) for i in range(20_001)], "int")


def test_implied_volatility_round_trip(spark):
    d = spark.createDataFrame([(100.0, k, .5, .02, v, o) for k in (80.0, 100.0, 130.0) for v in (.15, .6) for o in ("call", "put")], "underlying_price double, strike double, tte double, risk_free_rate double, sig double, option_type string")
    d = d.withColumn("price", V.black_scholes("underlying_price", "strike", "tte", "risk_free_rate", "sig", "option_type")["price"])
    r = V.enrich_chain(d).toPandas()
    ok = r["price"] > 1e-4
    assert np.allclose(r.loc[ok, "iv"], r.loc[ok, "sig"], atol=1e-6)


def test_garch_grid_prefers_clustering(spark):
    rng = np.random.default_rng(4)
    v, p, out = 1e-4, 100.0, []
    for i in range(1500):
        r = math.sqrt(v) * rng.normal()
        v = 1e-4 * .05 + .1 * r * r + .85 * v
        p *= math.exp(r)
        out.append(("s", (pd.Timestamp("2020-01-01") + pd.Timedelta(days=i)).to_pydatetime(), p))
    f = V.fit_garch(spark.createDataFrame(out, "symbol string, ts timestamp, close double"), V.garch_grid(("garch",))).first()
    assert f.beta >= .7 and f.alpha + f.beta > .85 and f.n == 1499


def test_article_and_masking(spark):
    h = "<html><head><title>T</title><script>var a='<p>no</p>'</script></head><body><nav>menu</nav><p>Hello &amp; <b>world</b></p><div>Next line</div></body></html>"
    a = SE.article_text(spark.createDataFrame([(1, h), (2, None)], "id int, html string"), "id", "html").orderBy("id").collect()
    assert a[0].article == "Hello & world\nNext line" and a[1].article == ""
    m = spark.createDataFrame([("mail bob@example.com card 4111 1111 1111 1234 call 555-123-9876",)], "t string").select(T.mask_sensitive("t").alias("m")).first().m
    assert "b***@example.com" in m and "****-****-****-1234" in m and "***-***-9876" in m
    s = spark.createDataFrame([("Buy $BTC now, #ETH! xBTCx",)], "t string").select(T.mentions("t", ["BTC", "ETH", "SOL"]).alias("s")).first().s
    assert s == ["BTC", "ETH"]


def test_zone_merge_uses_zone_start(spark):
    lv = spark.createDataFrame([("s", p, .5) for p in (100.0, 100.4, 100.8, 101.2)], "symbol string, price double, strength double")
    z = PT.merge_zones(lv, .005, 2).orderBy("low").collect()
    assert [(r.low, r.high, r.n) for r in z] == [(100.0, 100.4, 2), (100.8, 101.2, 2)]


def test_harmonic_ideal_gartley(spark):
    pts = [(0, -1, 100.0), (10, 1, 200.0), (20, -1, 138.2), (30, 1, 176.4), (40, -1, 121.4)]
    sw = spark.createDataFrame([("s", (pd.Timestamp("2024-01-01") + pd.Timedelta(hours=t)).to_pydatetime(), t, k, p) for t, k, p in pts], "symbol string, ts timestamp, pos int, kind int, price double")
    c = PT.xabcd(sw).withColumn("xd", F.lit(.786))
    m = PT.harmonic_matches(c).collect()
    assert "gartley" in {r.pattern for r in m} and all(r.direction == "bullish" for r in m)


def test_k_centers_greedy(spark):
    v = np.array([[0, 0], [1, 0], [10, 0], [0, 9], [5, 5]], dtype=float)
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "i bigint, v array<double>")
    assert [r.i for r in S.k_centers(d, "i", "v", 3).orderBy("step").collect()] == [0, 2, 3]


def test_seasonal_forecast_recovers_cycle(spark):
    t = np.arange(200)
    y = 10 + .05 * t + 3 * np.sin(2 * np.pi * t / 7)
    d = spark.createDataFrame([("s", (pd.Timestamp("2024-01-01") + pd.Timedelta(days=int(i))).to_pydatetime(), float(v)) for i, v in zip(t, y)], "series string, ts timestamp, y double")
    f = M.seasonal_forecast(d, 7, 86400, {"week": (7 * 86400.0, 1)}, ridge=1e-6).orderBy("ts").toPandas()
    n = np.arange(200, 207)
    assert np.allclose(f["yhat"], 10 + .05 * n + 3 * np.sin(2 * np.pi * n / 7), atol=1e-2)


def test_sources_round_trip(spark, tmp_path):
    b = Q.synthetic_bars(spark, 2, 5).withColumnRenamed("ts", "timestamp").select("timestamp", "symbol", "open", "high", "low", "close", "volume")
    RD.write_report(b, str(tmp_path / "c"), "csv")
    assert RD.read_candles(spark, str(tmp_path / "c")).count() == 10
    st = Q.baseline_stats(b, ["close"])
    RD.save_baseline(st, "d1", str(tmp_path / "base"))
    RD.save_baseline(st, "d2", str(tmp_path / "base"))
    assert RD.load_baseline(spark, "d1", str(tmp_path / "base")).count() == 1
    j = RD.ingest_json(spark.createDataFrame([('{"a": 1}',), ("bad",)], "j string"), "j", "a INT")
    assert [r.a for r in j.collect()] == [1, None]
    assert RD.ingest_records(spark, {"a": [1, 2], "b": ["x", "y"]}, "a INT, b STRING").count() == 2
    assert RD.latest_n(b.withColumnRenamed("timestamp", "ts"), 2).count() == 4
    with pytest.raises(ValueError):
        RD.require_columns(b, ["nope"])
    t = RD.metrics_text(spark.createDataFrame([("m", 1.5, {"k": "v"})], "name string, value double, labels map<string,string>"), labels="labels").first().value
    assert t == 'm{k="v"} 1.5'


def test_pair_alignment_is_listwise(spark):
    d = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0), ("a", 2, 3.0), ("c", 1, 5.0)], "symbol string, ts int, v double")
    r = align_pairs(d, pair_table(spark, all_pairs(["a", "b", "c"])), ["v"]).collect()
    assert sorted((x.a, x.b, x.ts) for x in r) == [("a", "b", 1), ("a", "c", 1), ("b", "c", 1)]


def test_nothing_is_cut_or_dropped(spark):
    """Long texts, many categories and null features keep their rows."""
    from tapeworks.functions import text as T
    from tapeworks.operators import drift, models, rolling

    long = "word " * 5000 + "#end"
    r = spark.createDataFrame([(long,)], "t string").select(T.normalize_social("t").alias("x"), T.is_valid_text("t").alias("ok")).first()
    assert r["x"].endswith("<topic end>") and len(r["x"]) > 25_000 and r["ok"]
    cat = spark.range(600).select((F.col("id") % 60).cast("string").alias("c"))
    chi = drift.chi_square(cat, cat, "c").first()
    assert chi["dof"] == 59 and abs(chi["chi2"]) < 1e-9
    d = spark.range(40).select(F.when(F.col("id") % 5 > 0, F.col("id").cast("double")).alias("x"), (F.col("id") * 2.0).alias("y"))
    assert models.train(d, "linear", ["x"], "y").transform(d).count() == 40
    assert rolling.polynomial_block(d, ["x", "y"]).count() == 40


def test_bar_order_is_exact(spark):
    from tapeworks.operators.bars import packed, trade_bars

    t = spark.createDataFrame([("a", 1, 3, 10.0), ("a", 1, 2, 20.0), ("a", 1, 10, 30.0), ("a", 0, 99, 40.0)], "symbol string, s long, trade_id long, price double")
    t = t.select("symbol", F.timestamp_seconds("s").alias("ts"), "trade_id", "price", F.lit(1.0).alias("volume"))
    bar = trade_bars(t, "1 hour", tie=("trade_id",))
    assert tuple(bar.select("open", "close", "n_trades").first()) == (40.0, 30.0, 4)
    assert "SortAggregate" not in bar._jdf.queryExecution().executedPlan().toString()
    assert [r[0] for r in t.orderBy(packed(("trade_id", 13))).select("trade_id").collect()] == [2, 3, 10, 99]
    with pytest.raises(ValueError):
        packed(("trade_id", 20), ("trade_id", 19))


def test_state_layout_and_history_over_chunks(spark):
    """The fixed layout pads only where its map says so, and history is the same however a symbol is cut into chunks."""
    import numpy as np

    from tapeworks.operators import statevector as SV

    rng = np.random.default_rng(5)
    bars = []
    for s in ("a", "b"):
        c = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 400)))
        bars += [(s, i, float(x), float(x * 1.01), float(x * 0.99), float(x), float(v)) for i, (x, v) in enumerate(zip(c, rng.integers(1, 900, 400)))]
    d = spark.createDataFrame(bars, "symbol string, day int, open double, high double, low double, close double, volume double")
    d = d.select("symbol", F.expr("timestamp_seconds(day * 86400)").alias("ts"), "open", "high", "low", "close", "volume")
    whole, names = SV.history_block(d)
    cut, _ = SV.history_block(d, rows=200, bucket=F.date_trunc("month", "ts"))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, cut.collect()))
    h = whole.where("symbol = 'a'").orderBy("ts").toPandas()
    close, vol = np.array([b[5] for b in bars[:400]]), np.array([b[6] for b in bars[:400]])
    r = np.diff(close) / (close[:-1] + 1e-8)
    for q in SV.PERIODS:
        for t in (0, 1, q - 1, q, q + 1, 399):
            row = h.iloc[t]
            assert abs(row[f"return_{q}"] - (np.clip((close[t] - close[t - q]) / (close[t - q] + 1e-8), -1, 1) if t >= q else 0)) < 1e-9
            assert abs(row[f"volatility_{q}"] - (np.std(r[t - q:t]) if t >= q else 0)) < 1e-9
            assert abs(row[f"range_{q}"] - (min(1, (close[t - q:t + 1].max() * 1.01 - close[t - q:t + 1].min() * 0.99) / close[t]) if t >= q else 0)) < 1e-8
            assert abs(row[f"momentum_{q}"] - (r[t - 1] - r[t - 2] if t >= q + 1 else 0)) < 1e-9
            assert abs(row[f"volume_change_{q}"] - (np.clip((vol[t] - vol[t - q]) / (vol[t - q] + 1e-8), -5, 5) / 5 if t >= q else 0)) < 1e-9
    times = d.select("ts").distinct()
    state, imap = SV.laid_out(["a", "b"], {"volume": SV.volume_block(d), "history": (whole, names)}, {"temporal": SV.temporal_block(times)}, kind="double")
    got = {r.ts: r.state for r in state.collect()}
    assert len(imap) == sum(SV.LAYOUT.values()) == 768 and len(got) == 400 and all(len(x) == 768 for x in got.values())
    assert [m[0] for m in imap] == list(range(768)) and sum(m[3] is not None for m in imap) == 2 * 8 + 2 * 45 + 10
    assert all(x[m[0]] == 0 for x in got.values() for m in imap if m[3] is None)
    at = {m[1:]: m[0] for m in imap}
    last = h.iloc[-1]
    assert all(got[last["ts"].to_pydatetime()][at["history", "a", n]] == last[n] for n in names)
    with pytest.raises(ValueError):
        SV.positions(["a"], {"ohlcv": [str(i) for i in range(21)]}, {})
