"""Ranking, metric functions, generators, JSON, terms, sources, table functions and keyed streaming state."""
import json
import math
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F


# -- ranking ------------------------------------------------------------------------------

def graded(spark, n=900, hot=450):
    rng = np.random.default_rng(2)
    rows = [("hot" if i < hot else f"q{i % 9}", float(x := rng.normal()), float(rng.normal()), int(np.clip(round(2 + x + rng.normal() / 4), 0, 4)), i) for i in range(n)]
    return spark.createDataFrame(rows, "q string, a double, b double, grade int, id long")


def test_pair_gradients_equal_all_pairs(spark):
    from tapeworks.operators import ranking as K
    d = graded(spark, 60, 30).withColumn("score", F.round(F.col("b") * 16) / 16)
    rows = [r for r in d.collect() if abs(r.score) <= K.REACH]
    by = {}
    for q in {r.q for r in rows}:
        g = [r for r in rows if r.q == q]
        met = [r for r in g if any(o.grade != r.grade for o in g)]
        for r in met:
            p = [(1 / (1 + math.exp((r.score - o.score) * (1 if r.grade > o.grade else -1))), 1 if r.grade > o.grade else -1) for o in g if o.grade != r.grade]
            by[q, r.grade, round(r.score * 16)] = (sum(-s * x for x, s in p) / len(met), sum(x * (1 - x) for x, _ in p) / len(met))
    got = {(r.q, r.grade, r.cell): (r.g, r.h) for r in K.pair_gradients(d.where(F.abs("score") <= K.REACH), ["q"]).collect()}
    assert got.keys() == by.keys()
    for k in by:
        assert got[k] == pytest.approx(by[k], rel=1e-9)


def test_ranker_learns_with_a_group_of_half_the_rows_and_reloads(spark):
    from tapeworks.operators import ranking as K
    d = graded(spark)
    model = K.PairwiseRanker(["a", "b"], ["q"], rounds=4, depth=3).fit(d)
    scored = K.PairwiseRanker.from_json(model.to_json()).transform(d)
    assert scored.count() == d.count()
    mean = lambda df: df.agg(F.avg("ndcg")).first()[0]
    assert mean(K.ndcg(scored, ["q"], tie=["id"])) > mean(K.ndcg(d.withColumn("score", F.col("b")), ["q"], tie=["id"])) + 0.2
    assert [r.ndcg for r in K.ndcg(d.withColumn("score", F.col("grade")), ["q"]).collect()] == pytest.approx([1.0] * 10)


def test_ndcg_brute_force(spark):
    from tapeworks.operators import ranking as K
    d = graded(spark, 200, 100)
    got = {r.q: r.ndcg for r in K.ndcg(d.withColumn("score", F.col("b")), ["q"], k=5, tie=["id"]).collect()}
    rows = d.collect()
    for q in got:
        g = [r for r in rows if r.q == q]
        gain = lambda some: sum((2 ** r.grade - 1) / math.log2(i + 2) for i, r in enumerate(some[:5]))
        assert got[q] == pytest.approx(gain(sorted(g, key=lambda r: -r.b)) / gain(sorted(g, key=lambda r: -r.grade)))


# -- functions and generators -------------------------------------------------------------

def test_metric_forms_agree_on_a_hot_key(spark):
    from tapeworks.operators import metricfn as M
    from tapeworks.queries.extensions import EXPLAINED
    d = spark.range(3000).select(F.when(F.col("id") % 10 < 9, "hot").otherwise(F.lit(None)).alias("k"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") * 7 % 13).cast("double").alias("y"), (F.col("id") % 11).cast("double").alias("p"))
    whole = M.window_metric(d, lambda y, p: 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum(), ["y", "p"], ["k"], "ts", "6 hours")
    parts = M.merged_metric(d.repartition(7), EXPLAINED, ["y", "p"], ["k"], "ts", "6 hours", salts=3)
    a, b = ({(r.k, r.window): (r.n, round(r.metric, 9)) for r in x.collect()} for x in (whole, parts))
    assert a == b and len(a) == 18


def test_generators_refuse_a_clash_and_products_match_numpy(spark):
    from tapeworks.operators import generators as G
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 4))
    y = x[:, 0] * x[:, 2] * 3 + rng.normal(size=500)
    d = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)] + [(None, 1.0, 1.0, 1.0, 1.0)], "a double, b double, c double, d double, y double")
    with pytest.raises(ValueError):
        G.RatioGenerator(columns=["a", "b"], prefix="").transform(d.withColumn("b_a", F.lit(1)))
    got = {(r.a, r.b): r.f for r in G.product_scores(d, ["a", "b", "c", "d"], "y").collect()}
    for (i, p), (j, q) in combinations(enumerate("abcd"), 2):
        r = np.corrcoef(x[:, i] * x[:, j], y)[0, 1]
        assert got[p, q] == pytest.approx(r * r / (1 - r * r) * 498, rel=1e-6)
    assert G.top_products(d, ["a", "b", "c", "d"], "y", 1) == [("a", "c")]


# -- documents ----------------------------------------------------------------------------

def test_json_walk_malformed_deep_and_wide(spark):
    from tapeworks.operators import documents as D
    deep = "[" * 30 + '"x"' + "]" * 30
    docs = [(1, '{"a": {"b": [1, "two", null, true]}}'), (2, '{"a": '), (3, None), (4, "3"), (5, deep), (6, json.dumps({f"k{i}": i for i in range(300)})), (7, "{}")]
    d = spark.createDataFrame(docs, "id long, t string")

    def walk(v, depth=0):
        yield depth, v
        for x in v.values() if isinstance(v, dict) else v if isinstance(v, list) else ():
            yield from walk(x, depth + 1)
    got = {r.id: r for r in D.json_threats(d, "id", "t", required=["a"]).collect()}
    for i, t in docs:
        try:
            nodes = list(walk(json.loads(t))) if t is not None else []
        except ValueError:
            nodes = []
        assert (got[i].n_values, got[i].depth) == (len(nodes), max((n for n, _ in nodes), default=0))
        assert got[i].malformed == (t is not None and not nodes) and got[i].n_strings == sum(isinstance(v, str) for _, v in nodes)
    assert got[1].n_missing == 0 and got[7].n_missing == 1 and got[2].n_missing is None


def test_terms_equal_contains_in_any_blocks(spark):
    from tapeworks.operators import documents as D
    texts = [(1, "ababab cab"), (2, None), (3, ""), (4, "xyz ünï ab")]
    terms = ["ab", "aba", "cab", "ünï", "nothing", "b c", "z"]
    t = spark.createDataFrame([(x,) for x in [*terms, "ab", "", None]], "t string")
    for most in (3, 10_000):
        got = sorted(tuple(r) for r in D.find_terms(spark.createDataFrame(texts, "i long, t string"), "i", "t", t, most).collect())
        assert got == sorted((i, w, sum(s.startswith(w, k) for k in range(len(s))), s.index(w) + 1) for i, s in texts if s for w in terms if w in s)


def test_check_digits_and_listed_runs(spark):
    from tapeworks.operators import documents as D
    d = spark.createDataFrame([("pay 4539 1488 0343 6467 or 4539-1488-0343-6468, GB82WEST12345698765432 GB83WEST12345698765432",), ("abandon ability able, about above x abandon",), (None,)], "t string")
    cards, accounts = D.checked_numbers("t")
    rows = d.select(cards, accounts, D.longest_listed_run("t", ["abandon", "ability", "able", "about", "above"]).alias("n")).collect()
    assert rows[0].cards == ["4539 1488 0343 6467"] and rows[0].accounts == ["GB82WEST12345698765432"]
    assert [r.n for r in rows] == [0, 5, 0] and rows[2].cards == []


def test_post_index_reads_only_asked_hours(spark, tmp_path):
    from tapeworks.operators import documents as D
    posts = spark.range(400).select("id", (F.lit("2024-01-01").cast("timestamp") + F.make_interval(mins=F.col("id").cast("int") * 15)).alias("ts"), F.concat(F.lit("Post Nr-"), F.col("id"), F.lit(" ïß #tag"), F.col("id") % 3).alias("text"))
    index = D.PostIndex.build(posts, str(tmp_path / "index"))
    for needle, back in (("nr-7", 24), ("7", 12), ("ïß #TAG1", 6), ("absent", 48)):
        got = index.search(needle, "2024-01-02 03:20:00", back)
        want = posts.where(f"ts > timestamp'2024-01-02 03:20:00' - interval {back} hours AND ts <= timestamp'2024-01-02 03:20:00' AND contains(lower(text), lower('{needle}'))")
        assert {r.id for r in got.collect()} == {r.id for r in want.collect()}
    plan = index.search("nr-7", "2024-01-02 03:20:00", 24)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(hour") == plan.count("FileScan parquet") >= 2
    trend = D.tag_trend(posts, "1 day", k=2).collect()
    assert Counter(r.window for r in trend) == Counter({w: 2 for w in {r.window for r in trend}}) and all(r.n >= 5 for r in trend)


# -- sources and table functions ----------------------------------------------------------

def candles(spark, n=40):
    return spark.range(n).select(F.concat(F.lit("s"), F.col("id") % 4).alias("symbol"), F.timestamp_seconds(F.col("id") * 86400).alias("ts"), *[(F.col("id") + i).cast("double").alias(c) for i, c in enumerate(("open", "high", "low", "close"))], F.when(F.col("id") % 5 > 0, F.lit(1.5)).alias("volume"))


def test_candles_round_trip_pruning_and_failed_write(spark, tmp_path):
    from tapeworks.sources import datasource as S
    S.register(spark)
    path, d = str(tmp_path / "c"), candles(spark)
    d.repartitionByRange(4, "symbol").write.format("candles").mode("append").save(path)
    back = spark.read.format("candles").load(path)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, d.collect()), key=repr)
    reader = S.CandleReader(path)
    from pyspark.sql.datasource import EqualTo
    assert list(reader.pushFilters([EqualTo(("symbol",), "s2")])) and len(reader.partitions()) == 1
    assert back.where("symbol = 's2' AND ts < timestamp'1970-01-20'").count() == d.where("symbol = 's2' AND ts < timestamp'1970-01-20'").count()
    bad = d.withColumn("open", F.when(F.col("symbol") == "s3", F.raise_error(F.lit("no"))).otherwise(F.col("open")).cast("double"))
    with pytest.raises(Exception):
        bad.repartitionByRange(4, "symbol").write.format("candles").mode("append").save(path)
    assert spark.read.format("candles").load(path).count() == 40
    d.limit(3).write.format("candles").mode("overwrite").save(path)
    assert spark.read.format("candles").load(path).count() == 3


def test_metrics_text_lines(spark, tmp_path):
    from tapeworks.sources import datasource as S
    S.register(spark)
    d = spark.createDataFrame([("rows", 'a"b', 3.0), ("late", None, 0.5)], "name string, source string, value double")
    d.write.format("metrics_text").mode("append").save(str(tmp_path / "m"))
    lines = sorted(x for f in json.loads((tmp_path / "m" / S.MANIFEST).read_text()) for x in (tmp_path / "m" / f["file"]).read_text().splitlines())
    assert lines == ["late 0.5", 'rows{source="a\\"b"} 3.0']


def test_levels_table_function_takes_any_key(spark):
    from tapeworks.operators import tablefn
    tablefn.register(spark)
    candles(spark).selectExpr("cast(substring(symbol, 2, 1) AS int) AS k", "ts", "CASE WHEN day(ts) % 3 = 0 THEN high + 90 ELSE high END AS high", "low").createOrReplaceTempView("b")
    out = spark.sql("SELECT * FROM levels_from_bars(TABLE(b), half => 1, key => 'k')")
    assert dict(out.dtypes)["k"] == "int"
    by = {}
    for r in spark.table("b").orderBy("k", "ts").collect():
        by.setdefault(r.k, []).append(r)
    want = {(k, x[i].ts, "resistance", x[i].high, i + 1) for k, x in by.items() for i in range(1, len(x) - 1) if x[i].high > max(x[i - 1].high, x[i + 1].high)}
    assert {tuple(r) for r in out.where("kind = 'resistance'").collect()} == want and want
    with pytest.raises(Exception, match="lacks"):
        spark.sql("SELECT * FROM levels_from_bars(TABLE(b), half => 1)").collect()


# -- keyed state --------------------------------------------------------------------------

@pytest.mark.parametrize("batches", [1, 5])
def test_uniform_sample_is_the_batch_bottom_k(spark, batches):
    from tapeworks.streaming import flows as FL
    from tapeworks.streaming import keyed as K
    d = spark.range(600).select(F.when(F.col("id") % 10 < 8, "hot").otherwise("b").alias("s"), "id", F.timestamp_seconds("id").alias("ts"))
    got = K.sample_of(FL.drain(K.sample_changes(K.replay(d, "ts", batches), "s", "id", 15, lanes=4)), 15)
    want = d.select("s", "id", F.xxhash64(F.lit(11), "id").alias("draw")).collect()
    for s in ("hot", "b"):
        assert sorted(r.id for r in got.where(F.col("stratum") == s).collect()) == sorted(i for _, i in sorted((r.draw, r.id) for r in want if r.s == s)[:15])


@pytest.mark.parametrize("batches", [1, 4])
def test_alerts_do_not_depend_on_batches_and_leave_no_state(spark, batches):
    from tapeworks.streaming import flows as FL
    from tapeworks.streaming import keyed as K
    rows = [(0, 95.0, None), (10, None, "ack"), (20, 120.0, None), (25, None, "resolve"), (30, None, "ack"), (40, 99.0, None), (200, 50.0, None), (210, 130.0, None), (400, 1.0, None)]
    d = spark.createDataFrame([("src", "m", t, i, v, c) for i, (t, v, c) in enumerate(rows)], "source string, metric string, t long, tie long, value double, command string").withColumn("ts", F.timestamp_seconds(F.col("t") * 60 + 86400)).drop("t")
    s = K.replay(d, "ts", batches)
    samples = s.where("command IS NULL").drop("command").withColumn("limit", F.lit(90.0)).withColumn("critical", F.lit(110.0))
    commands = s.where("command IS NOT NULL").drop("value")
    got = [(int(r.ts.timestamp() - 86400) // 60, r.event, r.severity) for r in FL.drain(K.alert_lifecycle(samples, commands, "0 seconds", 3600)).orderBy("ts").collect()]
    want = [(0, "opened", "warning"), (10, "acknowledged", "warning"), (20, "escalated", "critical"), (25, "resolved", "critical"), (40, "opened", "warning"), (100, "expired", "warning"), (210, "opened", "critical"), (270, "expired", "critical")]
    assert got == want


def test_models_score_every_row(spark):
    """Missing features are filled with the means of the rows fitted on; rows without a label are counted."""
    from tapeworks.operators import models as M
    from tapeworks.operators import selection as S
    d = spark.range(120).select("id", F.when(F.col("id") % 6 > 0, F.col("id").cast("double")).alias("a"), (F.col("id") % 7).cast("double").alias("b"), F.when(F.col("id") % 10 > 0, F.col("id") * 2.0).alias("y"), (F.col("id") % 3).cast("int").alias("fold"))
    r = M.select_model(d, ["linear"], ["a", "b"], "y", "fold").first()
    assert (r.n_rows, r.n_imputed, r.n_unlabelled) == (108, 16, 12)
    best, table = M.grid_search(d, "linear", ["a", "b"], "y", {"regParam": [0.0, 0.1]})
    assert best.transform(d).count() == 120 and table.count() == 2
    assert M.train(d, "linear", ["a", "b"], "y").transform(d).count() == 120
    assert S.model_importances(d, ["a", "b"], "y", trees=3).count() == 2
