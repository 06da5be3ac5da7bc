"""Findings of the third review: what failed before, on rows built here."""
import math
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import Row
from pyspark.sql import functions as F

from tapeworks.functions import text as T
from tapeworks.operators import cleaning as C
from tapeworks.operators import documents as D
from tapeworks.operators import indicators as I
from tapeworks.operators import orderbook as OB
from tapeworks.operators import orderflow as OF
from tapeworks.operators import volatility as V
from tapeworks.plans import frames
from tapeworks.plans.panel import Panel, day_bucket
from tapeworks.queries.common import rcols, rd
from tapeworks.streaming import keyed as K

BARS = "symbol string, ts timestamp, close double"


def at(minutes):
    return datetime(2024, 1, 1) + timedelta(minutes=minutes)


def test_f1_realized_spread_of_a_trade_at_price_zero(spark):
    t = spark.createDataFrame([("a", at(0), 1, 0.0, "buy"), ("a", at(1), 2, 0.0, "sell"), ("a", at(2), 3, 50.0, "buy"), ("a", at(999), 4, 0.0, "buy")], "symbol string, ts timestamp, trade_id long, price double, side string")
    m = spark.createDataFrame([("a", at(90), 100.0)], "symbol string, ts timestamp, mid double")
    r = OB.realized_spread(t, m, 3600, day_bucket()).select("trade_id", rd("realized_spread", 3, infinite=True).alias("x"))
    assert {i: x for i, x in r.collect()} == {1: math.inf, 2: -math.inf, 3: 200.0, 4: None}


def test_f3_f4_returns_to_and_from_a_price_of_zero(spark):
    b = spark.createDataFrame([("a", at(60 * i), p) for i, p in enumerate([2.0, 0.0, 4.0])] + [("b", at(60 * i), p) for i, p in enumerate([0.0, 0.0, 1.0])] + [("c", at(60 * i), p) for i, p in enumerate([1.0, math.e, 1.0])], BARS)
    h = {(r.symbol, r.hour): (r.vol, r.n) for r in rcols(V.intraday_seasonality(b), ["symbol", "hour", "n"], ["vol"], infinite=True).collect()}
    assert h["a", 1] == h["a", 2] == h["b", 2] == (math.inf, 1) and h["c", 1] == (1.0, 1) and h["a", 0] == (None, 0)
    assert math.isnan(h["b", 1][0])
    s = {r.symbol: (r.rv, r.n) for r in rcols(V.signature(b, ["1 hour"]), ["symbol", "n"], ["rv"], infinite=True).collect()}
    assert s["a"] == (math.inf, 2) and math.isnan(s["b"][0]) and s["c"] == (2.0, 2)


def tape(n):
    """(ts in seconds, id, price, volume, side): uneven times with peers, two gaps, a null price."""
    t, rows = 0, []
    for i in range(n):
        t += (0, 1, 3, 0, 200 if i % 50 == 7 else 2)[i % 5]
        rows.append((t, i, None if i % 41 == 5 else float((i * 37) % 11), 500.0 if i % 23 == 0 else float(1 + i % 4), "buy" if i % 3 else "sell"))
    return rows


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_frames_fold_and_count_against_brute_force():
    g = np.random.default_rng(1)
    x, known = g.integers(0, 9, 97).astype(float), g.random(97) > .2
    lo = g.integers(0, 97, 300)
    hi = np.minimum(97, lo + g.integers(0, 60, 300))
    limit = g.integers(-1, 10, 300) + g.choice([0, .5], 300)
    assert frames.fold(x, lo, hi, np.add, 0.0).tolist() == [x[a:b].sum() for a, b in zip(lo, hi)]
    assert frames.fold(x, lo, hi, np.maximum, -np.inf).tolist() == [max(x[a:b], default=-np.inf) for a, b in zip(lo, hi)]
    assert frames.count_above(x, known, limit, lo, hi).tolist() == [int((known[a:b] & (x[a:b] > m)).sum()) for a, b, m in zip(lo, hi, limit)]


def test_f2_momentum_ignition_without_range_frames(spark):
    rows = [(*r, ("fill", "place", "fill", "cancel")[r[1] % 4]) for r in tape(400)]
    d = spark.createDataFrame([("s", at(0) + timedelta(seconds=t), i, p, v, s, e) for t, i, p, v, s, e in rows], "symbol string, ts timestamp, event_id long, price double, size double, side string, event_type string")
    out = OF.momentum_ignition(d, 0.0, 60.0, 1.5)
    assert "rangeframe" not in plan(out)
    m, want = sum(r[3] for r in rows) / len(rows), {}
    for t, i, p, v, s, e in rows:
        fills = [(a, b, c) for a, b, c, _, _, k in rows if k == "fill" and t - 60 < a <= t]
        known = [c for _, _, c in fills if c is not None]
        if e == "place" and v >= 1.5 * m and len(known) >= 3 and None not in (max(fills)[2], min(fills)[2]):
            trend = max(fills)[2] - min(fills)[2]
            if trend and (s == "buy") == (trend > 0):
                want[i] = (len(known), trend, max(known) - min(known))
    assert want and {r.event_id: (r.fills, r.trend, r.move) for r in out.collect()} == want


def test_f2_quote_stuffing_without_range_frames(spark):
    rows = [(*r, ("place", "cancel", "cancel", "fill", None)[r[1] % 5]) for r in tape(300)]
    d = spark.createDataFrame([("s", at(0) + timedelta(seconds=t), i, e) for t, i, *_, e in rows], "symbol string, ts timestamp, event_id long, event_type string")
    out = OF.quote_stuffing(d, ["symbol"], 3, 20.0)
    assert "rangeframe" not in plan(out)
    want = {}
    for t, i, *_ in rows:
        kinds = [k for a, *_, k in rows if t - 20 < a <= t]
        if len(kinds) > 3 and kinds.count("cancel") > .7 * kinds.count("place"):
            want[i] = (len(kinds), kinds.count("place"), kinds.count("cancel"))
    assert want and {r.event_id: (r.events, r.places, r.cancels) for r in out.collect()} == want


def test_f5_trade_features_without_range_frames(spark):
    rows = tape(300)
    d = spark.createDataFrame([("k", at(0) + timedelta(seconds=t), i, p, v, s) for t, i, p, v, s in rows] + [("k", None, 900, 2.0, 4.0, "buy"), ("k", None, 901, 2.0, None, "buy")],
                              "event_type string, ts timestamp, trade_id long, price double, volume double, side string")
    out = OB.trade_features(d, 30, Panel(("event_type",), ("ts", "trade_id")))
    assert "rangeframe" not in plan(out)
    got = {r.trade_id: r for r in out.collect()}
    assert len(got) == 302 and (got[900].win_count, got[901].win_volume, got[901].win_vwap) == (2, 4.0, 2.0)
    for t, i, *_ in rows:
        w = [r for r in rows if t - 30 <= r[0] <= t]
        total = sum(r[3] for r in w)
        assert (got[i].win_count, got[i].win_volume, got[i].large_trades) == (len(w), total, sum(r[3] > 10 * (total / len(w)) for r in w))
        assert abs(got[i].buy_share - sum(r[3] for r in w if r[4] == "buy") / total) < 1e-12
        assert abs(got[i].win_vwap - sum(r[2] * r[3] for r in w if r[2] is not None) / total) < 1e-12
    assert any(got[i].large_trades for _, i, *_ in rows)


def test_f6_linear_fill_reads_no_frame_to_the_end_of_a_key(spark):
    v = [None, 2.0, None, None, 8.0, None]
    d = spark.createDataFrame([("a", at(i), x) for i, x in enumerate(v)], BARS)
    for method, want in (("linear", [0.0, 2.0, 4.0, 6.0, 8.0, 8.0]), ("bfill", [2.0, 2.0, 8.0, 8.0, 8.0, 0.0])):
        out = C.fill_missing(d, ["close"], method)
        assert "unboundedfollowing" not in plan(out) and [r.close for r in out.orderBy("ts").collect()] == want


def test_f6_spine_is_made_in_several_tasks(spark):
    d = spark.createDataFrame([(f"s{k}", at(60 * h), 1.0) for k in range(40) for h in (0, 9)], BARS)
    out = C.calendar_spine(d, "1 hour")
    assert out.count() == 400 and "repartition" in plan(out)


def test_f10_swing_flags_keep_a_running_last_peak(spark):
    high = [10.0 if i in (8, 20) else 5.0 + i % 2 for i in range(32)]
    d = spark.createDataFrame([("a", at(i), h, h) for i, h in enumerate(high)], "symbol string, ts timestamp, high double, low double")
    out = I.swing_flags(d)
    assert "1000000000" not in plan(out)
    assert [i for i, r in enumerate(out.orderBy("ts").collect()) if r.double_top] == [20]


def test_f7_post_index_has_a_bounded_number_of_folders(spark, tmp_path):
    posts = spark.createDataFrame([(i, at(600 * i), "Needle in post" if i % 9 == 0 else f"other text {i}") for i in range(600)] + [(600, None, "needle")], "id long, ts timestamp, text string")
    index = D.PostIndex.build(posts, str(tmp_path / "index"))
    D.PostIndex.build(posts.where("id < 20").withColumn("id", F.col("id") + 1000), str(tmp_path / "index"))
    assert len(list((tmp_path / "index" / "posts").iterdir())) < 300
    got = {r.id for r in index.search("needle", "2024-01-10 00:00:00", 96).collect()}
    assert got == {k + i for k, n in ((0, 600), (1000, 20)) for i in range(n) if i % 9 == 0 and 5 * 1440 < 600 * i <= 9 * 1440} and len(got) > 1


def test_f8_alert_state_is_read_once_a_call(spark):
    class Store:
        def __init__(self):
            self.rows, self.calls = {}, 0

        def iterator(self):
            self.calls += 1
            return iter(list(self.rows.items()))

        def updateValue(self, k, v):
            self.calls += 1
            self.rows[k] = v

        def removeKey(self, k):
            self.calls += 1
            del self.rows[k]

        getValue = containsKey = keys = None

    class Handle:
        def __init__(self):
            self.timers = set()

        listTimers = lambda self: iter(self.timers)
        deleteTimer = lambda self, t: self.timers.remove(t)
        registerTimer = lambda self, t: self.timers.add(t)

    p = K.AlertLifecycle(10_000_000)
    p.open, p.handle = Store(), Handle()
    r = lambda t, v, command=None: Row(metric="m", ts_us=t * 1_000_000, tie=t, value=v, limit=70.0, critical=90.0, command=command)
    rows = [r(t, 80.0) for t in range(50)] + [r(50, 95.0), r(51, None, "ack")]
    assert [e.event for e in p.handleInputRows(("s",), iter(rows), None)] == ["opened", "escalated", "acknowledged"]
    assert p.open.calls == 2 and p.handle.timers == {60_001} and p.open.rows == {("m",): (2, True, 0, 50_000_000, 95.0)}
    assert [e.event for e in p.handleInputRows(("s",), iter([r(70, 10.0)]), None)] == ["expired"]
    assert not p.open.rows and not p.handle.timers


def test_f11_sanitize_equals_its_plain_patterns(spark):
    texts = ["a@b.com_foo@bar.org x", "x" * 60 + " y", "  two  spaces\tand\n tabs ", "a@b a@b.c q@x.yy.zz", "me.you+1@site.co.uk, ok", "@x.com a@@b.com", "<b>t</b>http://x.y/z?q a%b@c.de", "é@b.com Ünï a b", "", None]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace("t", T.HTML_TAG, " "), T.URL, " "), T.EMAIL, " ")
    x = F.trim(F.regexp_replace(F.regexp_replace(x, r"[^\w\s.,!?:;()'\"-]+", " "), r"\s+", " "))
    out = d.select(T.sanitize("t").alias("a"), x.alias("b"))
    assert all(r.a == r.b for r in out.collect()) and "(?<!" in plan(out)


def test_op2_runs_by_anchor_equal_those_window_by_window(monkeypatch):
    import pyarrow as pa

    from tapeworks.llm import op2_suffix as S
    from tapeworks.llm.hashing import RangeHash

    monkeypatch.setattr(S, "SMALL", 64)  # several slices
    g = np.random.default_rng(2)
    texts = ["".join(g.choice(list("ab"), n)) for n in (0, 5, 39, 40, 41, 300, 0, 700)] + ["x" * 500, None, "xy" * 90]
    s = S.Suffixes(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts)}), 40)
    at = np.arange(len(s.buf) - 19)
    h = RangeHash(s.buf)
    assert (h.windows(20) == h(at, at + 20)).all()
    top = (h.windows(20) >> np.uint64(32)).tolist()
    want = []
    for d in range(len(texts)):
        for a in range(s.off[d], s.off[d + 1] - 39):
            anchor = max((p for p in range(a, a + 21)), key=lambda p: (-top[p], p))
            key = (d, anchor, (anchor - a) // 64)
            if want and want[-1][0] == key:
                want[-1][2] = a
            else:
                want.append([key, a, a])
    assert [(d, a, f, z) for d, a, f, z in zip(*(x.tolist() for x in (s.doc, s.anchor, s.first, s.last)))] == [(k[0], k[1], f, z) for k, f, z in want]


def test_f9_candles_travel_as_arrow_batches(spark, tmp_path):
    from pyspark.sql.datasource import DataSourceArrowWriter

    from tapeworks.sources import datasource as S

    S.register(spark)
    assert issubclass(S.CandleWriter, DataSourceArrowWriter)
    rows = [('a,"b', at(0), 0.1, -0.0, math.inf, 1e-300, 123456789.12345679), ("x\ny", None, None, 1e22, -math.inf, 2.0, None), (None, at(1), 1.0, 2.0, 3.0, 4.0, 5.0), ("é", at(2), 1 / 3, 0.0, 5e-324, 1.0, 7.0)]
    d = spark.createDataFrame(rows, S.CANDLE)
    d.coalesce(1).write.format("candles").mode("append").save(str(tmp_path / "c"))
    back = spark.read.format("candles").load(str(tmp_path / "c"))
    assert sorted(map(repr, back.collect())) == sorted(map(repr, d.collect()))
    (about,) = S._manifest(str(tmp_path / "c"))
    assert about["rows"] == 4 and about["symbol"] == ['a,"b', "é"] and about["ts"] == [S._us(at(0)), S._us(at(2))]


def test_f12_moments_block_without_tables_of_counts(spark):
    from tapeworks.operators import rolling as RO

    g = np.random.default_rng(4)
    x = [*np.round(g.normal(5, 2, 30), 3).tolist(), None, *[0.1] * 12, *[1e6 + v for v in (0.1, 0.3, 0.2, 0.1, 0.4, 0.1, 0.2, 0.3, 0.1, 0.9, 0.5)]]
    d = spark.createDataFrame([("a", at(i), v) for i, v in enumerate(x)], BARS)
    out = RO.moments_block(d, "close", (10,))
    assert "percentile" not in plan(out) and "kurtosis(" not in plan(out)
    for i, r in enumerate(out.orderBy("ts").collect()):
        v = x[max(0, i - 9):i + 1]
        if len(v) < 10 or None in v:
            assert r.close_10_median is None and r.close_10_skew is None
            continue
        assert np.allclose([r.close_10_q25, r.close_10_median, r.close_10_q75], np.percentile(v, [25, 50, 75]), rtol=1e-14)
        if max(v) == min(v):
            assert r.close_10_skew is None and r.close_10_kurt is None
            continue
        e = np.array(v) - np.mean(v)
        m2, m3, m4 = (float((e ** k).mean()) for k in (2, 3, 4))
        assert math.isclose(r.close_10_skew, m3 / m2 ** 1.5 * math.sqrt(90) / 8, rel_tol=1e-6, abs_tol=1e-9)
        assert math.isclose(r.close_10_kurt, (11 * (m4 / m2 ** 2 - 3) + 6) * 9 / 56, rel_tol=1e-6, abs_tol=1e-9)


def test_f15_table_function_takes_only_the_columns_it_reads(spark):
    from tapeworks.operators import tablefn

    tablefn.register(spark)
    rows = [(i % 2, at(i), 9.0, float((i * 7) % 11) if i % 13 else None, float((i * 5) % 8), "unread") for i in range(80)]
    spark.createDataFrame(rows, "symbol int, ts timestamp, open double, high double, low double, note string").createOrReplaceTempView("f15_bars")
    out = spark.sql("SELECT * FROM levels_from_bars(TABLE(f15_bars), half => 2)")
    want = []
    for k in (0, 1):
        b = [r for r in rows if r[0] == k]
        for i in range(2, len(b) - 2):
            near = [b[j] for j in range(i - 2, i + 3) if j != i]
            for kind, c, sign in (("resistance", 3, 1), ("support", 4, -1)):
                if b[i][c] is not None and all(r[c] is not None and sign * r[c] < sign * b[i][c] for r in near):
                    want.append((k, b[i][1], kind, b[i][c], i + 1))
    assert sorted(map(tuple, out.collect())) == sorted(want) and want
    assert "unread" not in plan(out) and "note" not in plan(out).split("levels_from_bars")[1].split("project")[0]


def test_f16_only_texts_that_may_change_leave_spark(spark):
    import re
    from unicodedata import combining, decomposition, is_normalized
    from unicodedata import normalize as nf

    plain = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", T.NFC_PLAIN).replace(r"\z", r"\Z"))
    second = {chr(int(p[1], 16)) for i in range(0x110000) if len(p := decomposition(chr(i)).split()) == 2 and not p[0].startswith("<")}
    second |= {chr(i) for i in range(0x1100, 0x1200)}
    for i in range(0x110000):
        c = chr(i)
        assert not plain.match(c) or (is_normalized("NFC", c) and not combining(c) and c not in second), hex(i)
    assert plain.match("Grüße, naïve “façade” – Привет 東京 한국 🚀") and not plain.match("e\u0301") and not plain.match("ᄒ")
    texts = ["Grüße “x” – y", "e\u0301te\u0301 \u200bz", "\u1112\u1161\u11ab", "\u212b \u2126", "か\u3099", "", None, "plain", *["o\u0308" * 9] * 150]
    out = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.normalize_unicode("t").alias("x")).orderBy("i").collect()
    fold = str.maketrans("‘’“”–—", "''\"\"--", "\u200b\u200c\u200d\ufeff")
    assert [r.x for r in out] == [t if t is None else nf("NFC", t).translate(fold) for t in texts]
