"""Feature selection, model training and panel forecasts on lineitem and the nation series."""
from __future__ import annotations

from pyspark.sql import functions as F

from tapeworks.operators import models as M
from tapeworks.operators import selection as S
from tapeworks.plans.panel import Panel
from tapeworks.queries import query
from tapeworks.queries.common import MARKET, R, RS, rcols, rd
from tapeworks.queries.quality import U
from tapeworks.sources import adapters as A

COLS = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
T = "l_extendedprice"


def li(s, d):
    return A.table(s, d, "lineitem").withColumn("l_linenumber", F.col("l_linenumber").cast("double"))


FS = "fs AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, corr({c}, {T}) AS r, count(*) AS n FROM lineitem" for c in COLS) + "), fr AS (SELECT feature, r, r*r/(1-r*r)*(n-2) AS score FROM fs)"


@query("select_univariate_f", f"WITH {FS} SELECT feature, {R('r', 'r', 6)}, {R('score', 'score', 3)}, CAST(row_number() OVER (ORDER BY score DESC, feature) AS INTEGER) AS rank FROM fr QUALIFY rank<=3")
def _(s, d):
    t = S.top_features(S.f_scores(li(s, d), COLS, T), 3)
    return t.select("feature", rd("r", 6).alias("r"), rd("score", 3).alias("score"), "rank")


@query("select_anova", f"""WITH l AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, l_returnflag AS k, {c}::DOUBLE AS v FROM lineitem" for c in COLS)}), c AS (SELECT feature, k, count(*) AS n, avg(v) AS m, var_pop(v) AS v FROM l GROUP BY ALL), g AS (SELECT feature, sum(n) AS nn, count(*) AS k, sum(n*m)/sum(n) AS gm, sum(n*v) AS ssw, sum(n*m*m) AS q FROM c GROUP BY 1)
 SELECT feature, {R('(q-nn*gm*gm)/(k-1)/(ssw/(nn-k))', 'score', 4)} FROM g""")
def _(s, d):
    return rcols(S.anova_scores(li(s, d), COLS, "l_returnflag"), ["feature"], ["score"], 4)


@query("select_mutual_information", f"""WITH l AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, l_returnflag AS y, {c}::DOUBLE AS v FROM lineitem" for c in COLS)}), e AS (SELECT feature, list_distinct([{", ".join(f"quantile_cont(v,{i / 10})" for i in range(1, 10))}]) AS e FROM l GROUP BY 1), b AS (SELECT feature, y, len(list_filter(e, lambda x: x<v)) AS bin, count(*) AS n FROM l JOIN e USING (feature) GROUP BY ALL),
 t AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, bin) AS px, sum(n) OVER (PARTITION BY feature, y) AS py FROM b) SELECT feature, {R('sum(n/t*ln(n::DOUBLE*t/(px*py)))*1000', 'score', 4)} FROM t GROUP BY 1""")
def _(s, d):
    x = S.information_scores(li(s, d), COLS, "l_returnflag")
    return x.select("feature", rd(F.col("score") * 1000, 4).alias("score"))


@query("select_model_based")
def _(s, d):
    m = S.model_importances(li(s, d), COLS, T, trees=10, depth=5)
    return m.select("feature", (F.col("score") > .05).alias("kept"))


@query("select_correlation", f"WITH {FS} SELECT feature, {R('abs(r)', 'score', 6)} FROM fr WHERE abs(r)>=0.0005 AND feature<>'twin'")
def _(s, d):
    x = li(s, d).withColumn("twin", F.col("l_quantity") * 2 + F.col("l_tax"))
    return rcols(S.correlation_selection(x, [*COLS, "twin"], T, 0.0005, .95), ["feature"], ["score"], 6)


def _votes(s, d):
    f = S.f_scores(li(s, d), COLS, T).select(F.lit("f").alias("method"), "feature", "score")
    a = S.anova_scores(li(s, d), COLS, "l_returnflag").select(F.lit("anova").alias("method"), "feature", "score")
    c = S.f_scores(li(s, d), COLS, T).select(F.lit("corr").alias("method"), "feature", F.abs("r").alias("score"))
    return f.unionByName(a).unionByName(c)


VT = FS + f""", al AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, l_returnflag AS k, {c}::DOUBLE AS v FROM lineitem" for c in COLS)}), ac AS (SELECT feature, k, count(*) AS n, avg(v) AS m, var_pop(v) AS v FROM al GROUP BY ALL), ag AS (SELECT feature, sum(n) AS nn, count(*) AS k, sum(n*m)/sum(n) AS gm, sum(n*v) AS ssw, sum(n*m*m) AS q FROM ac GROUP BY 1),
 vt AS (SELECT 'f' AS method, feature, score FROM fr UNION ALL SELECT 'anova', feature, (q-nn*gm*gm)/(k-1)/(ssw/(nn-k)) FROM ag UNION ALL SELECT 'corr', feature, abs(r) FROM fr), rk AS (SELECT *, rank() OVER (PARTITION BY method ORDER BY score DESC) AS rk FROM vt)"""


@query("select_vote_ensemble", f"WITH {VT} SELECT feature, CAST(sum((rk<=2)::INT) AS BIGINT) AS votes, CAST(sum((rk<=2)::INT)>=2 AS INTEGER) AS kept FROM rk GROUP BY 1")
def _(s, d):
    from pyspark.sql import Window
    v = _votes(s, d).withColumn("selected", F.rank().over(Window.partitionBy("method").orderBy(F.desc("score"))) <= 2)
    return S.vote_selection(v, 3, top_up=0).select("feature", "votes", "kept")


@query("select_consensus_rank", f"WITH {VT} SELECT feature, {R('avg(rk)', 'mean_rank')}, {R('stddev_pop(rk)', 'rank_std')} FROM rk GROUP BY 1")
def _(s, d):
    return rcols(S.consensus_rank(_votes(s, d)), ["feature"], ["mean_rank", "rank_std"])


@query("select_method_agreement", f"WITH {VT}, r AS (SELECT *, rank() OVER (PARTITION BY method ORDER BY score)+(count(*) OVER (PARTITION BY method, score)-1)/2.0 AS r FROM vt) SELECT a.method AS m1, b.method AS m2, {R('corr(a.r,b.r)', 'spearman', 5)} FROM r a JOIN r b USING (feature) WHERE a.method<b.method GROUP BY ALL")
def _(s, d):
    return rcols(S.method_agreement(_votes(s, d)), ["m1", "m2"], ["spearman"], 5)


@query("select_importance_merge", f"""WITH a AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, abs(corr({c},{T})) AS s FROM lineitem WHERE l_shipdate<TIMESTAMP '1998-06-01'" for c in COLS)}), b AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, abs(corr({c},{T})) AS s FROM lineitem WHERE l_shipdate>=TIMESTAMP '1998-06-01'" for c in COLS)}) SELECT feature, {R('a.s', 'score_first', 6)}, {R('b.s', 'score_last', 6)}, {R('b.s-a.s', 'change', 6)} FROM a JOIN b USING (feature)""")
def _(s, d):
    x = li(s, d)
    sc = lambda f: S.f_scores(f, COLS, T).select("feature", F.abs("r").alias("score"))
    m = S.merge_importances(sc(x.where("l_shipdate < timestamp_ntz'1998-06-01'")), sc(x.where("l_shipdate >= timestamp_ntz'1998-06-01'")))
    return rcols(m, ["feature"], ["score_first", "score_last", "change"], 6)


@query("select_permutation_importance")
def _(s, d):
    o = A.table(s, d, "orders").select("o_orderkey", "o_totalprice", (F.col("o_custkey") % 7).cast("double").alias("grp"), (F.col("o_totalprice") / 1000 + F.col("o_custkey") % 7).alias("y"))
    m = M.train(o, "linear", ["o_totalprice", "grp"], "y")
    x = S.permutation_importance(o, -F.avg((F.col("y") - F.col("prediction")) ** 2), m, ["o_totalprice", "grp"], "o_orderkey", F.floor(F.col("o_orderkey") / 1000))
    return x.select("feature", (F.col("importance") > 0).alias("useful"))


@query("sample_balanced", f"SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY {U(42, 'event_id')}, event_id) <= 50")
def _(s, d):
    return S.balanced_sample(A.table(s, d, "events").select("event_id", "event_type"), "event_type", 50, "event_id")


@query("sample_stratified", f"SELECT event_id, event_type FROM events WHERE {U(42, 'event_id')} < CASE event_type WHEN 'click' THEN 0.1 WHEN 'error' THEN 0.5 ELSE 0 END")
def _(s, d):
    return S.stratified_sample(A.table(s, d, "events").select("event_id", "event_type"), "event_type", {"click": .1, "error": .5}, "event_id")


@query("sample_reservoir", f"SELECT event_id, value FROM events ORDER BY {U(42, 'event_id')}, event_id LIMIT 100")
def _(s, d):
    return S.reservoir(A.table(s, d, "events").select("event_id", "value"), 100, "event_id")


@query("sample_drop_stale", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 7 DAY")
def _(s, d):
    return S.drop_stale(A.table(s, d, "events"), "ts", F.lit("2024-01-30").cast("timestamp"), 7 * 86400).select("event_id")


@query("sample_k_centers")
def _(s, d):
    return S.k_centers(A.table(s, d, "embeddings"), "vec_id", "embedding", 8).select("vec_id", "step", rd("distance").alias("distance"))


def _xy(s, d):
    from tapeworks.operators.volatility import har_features, with_log_returns
    r = with_log_returns(A.market_daily(s, d)).where("r is not null").withColumn("rv", F.abs("r"))
    return har_features(r).dropna(subset=["har_1", "har_5", "har_22", "rv"]).select("symbol", "ts", "rv", "har_1", "har_5", "har_22")


@query("model_training_boosted")
def _(s, d):
    x = _xy(s, d)
    m = M.train(x, "boosted", ["har_1", "har_5", "har_22"], "rv", {"maxIter": 5, "maxDepth": 3})
    return m.transform(x).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), rd(F.avg("prediction"), 3).alias("mean_prediction"))


@query("model_selection_cv")
def _(s, d):
    from tapeworks.operators.evaluation import time_folds
    x = _xy(s, d).withColumn("fold", (F.year("ts") % 3).cast("int"))
    return rcols(M.select_model(x, ["linear", "forest"], ["har_1", "har_5", "har_22"], "rv", "fold", params={"forest": {"numTrees": 5, "maxDepth": 3}}), ["model"], ["score"], 3)


@query("model_grid_search")
def _(s, d):
    _, t = M.grid_search(_xy(s, d), "linear", ["har_1", "har_5", "har_22"], "rv", {"regParam": [0.0, 0.1], "elasticNetParam": [0.0, 0.5]})
    return rcols(t, ["params"], ["score"], 3)


@query("model_end_to_end")
def _(s, d):
    p = M.feature_pipeline(_xy(s, d), "rv", ["har_1", "har_5", "har_22"], "ts", keep=2, kind="linear")
    return rcols(p, ["n", "features"], ["mae", "rmse", "r2"], 3)


@query("model_batch_scoring", f"WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS q, l_extendedprice AS p FROM lineitem), f AS (SELECT regr_slope(p,q) AS b, regr_intercept(p,q) AS a FROM x) SELECT l_orderkey, l_linenumber, l_partkey, {R('a+b*q', 'prediction', 2)} FROM x, f")
def _(s, d):
    x = A.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", T)
    m = M.train(x, "linear", ["l_quantity"], T, {"solver": "normal"})
    return rcols(m.transform(x), ["l_orderkey", "l_linenumber", "l_partkey"], ["prediction"], 2)


def _series(s, d):
    return A.market_daily(s, d).select(F.col("symbol").alias("series"), "ts", F.col("close").alias("y"))


PER = {"week": (7 * 86400.0, 2), "year": (365.25 * 86400.0, 3)}


@query("forecast_panel_seasonal")
def _(s, d):
    return rcols(M.seasonal_forecast(_series(s, d), 14, 86400, PER), ["series", "ts"], ["yhat", "lower", "upper"], 2)


@query("forecast_cross_validation")
def _(s, d):
    f = M.forecast_cross_validation(_series(s, d), 400, 200, 10, 86400, PER)
    return f.groupBy("series", "cutoff").agg(F.count(F.lit(1)).alias("n"), rd(F.avg(F.abs(F.col("actual") - F.col("yhat"))), 2).alias("mae"))
