"""Evaluation metrics over predictions of the nation series and document labels."""
from __future__ import annotations

from pyspark.sql import functions as F

from tapeworks.operators import evaluation as EV
from tapeworks.plans.panel import Panel
from tapeworks.queries import query
from tapeworks.queries.common import MARKET, R, RS, rcols, rd
from tapeworks.queries.quality import U
from tapeworks.sources import adapters as A

SP = Panel(("series",), ("ts",))
W = "PARTITION BY series ORDER BY ts"
PR = MARKET + """, pr AS (SELECT * FROM (SELECT symbol AS series, ts, close AS y, lag(close) OVER s AS naive, avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS prediction, 300.0 AS hw FROM market WINDOW s AS (PARTITION BY symbol ORDER BY ts)) WHERE naive IS NOT NULL)"""


def pr(s, d):
    m = A.market_daily(s, d).select(F.col("symbol").alias("series"), "ts", F.col("close").alias("y"))
    m = m.withColumn("naive", F.lag("y").over(SP.w)).withColumn("prediction", F.avg("y").over(SP.prior(5))).where("naive is not null")
    return m.withColumn("lower", F.col("prediction") - 300).withColumn("upper", F.col("prediction") + 300)


REG = ["mae", "rmse", "mape", "smape", "r2", "bias", "mase"]
REGSQL = f"{R('avg(abs(y-prediction))', 'mae')}, {R('sqrt(avg(pow(y-prediction,2)))', 'rmse')}, {R('100*avg(abs(y-prediction)/abs(y))', 'mape')}, {R('100*avg(2*abs(y-prediction)/(abs(y)+abs(prediction)))', 'smape')}, {R('1-avg(pow(y-prediction,2))/var_pop(y)', 'r2', 5)}, {R('avg(y-prediction)', 'bias')}, {R('avg(abs(y-prediction))/avg(abs(y-naive))', 'mase', 5)}"


@query("eval_forecast_metrics", f"WITH {PR} SELECT series, count(*) AS n, {REGSQL} FROM pr GROUP BY 1")
def _(s, d):
    m = EV.regression_metrics(pr(s, d), ["series"], previous="naive")
    return m.select("series", "n", *[rd(c, 5 if c in ("r2", "mase") else 4).alias(c) for c in REG])


@query("eval_directional_interval", f"WITH {PR}, x AS (SELECT *, lag(y) OVER ({W}) AS p FROM pr) SELECT series, {R('avg((sign(y-p)=sign(prediction-p))::INT)', 'direction', 6)}, {R('avg((y BETWEEN prediction-300 AND prediction+300)::INT)', 'coverage', 6)}, {R('600', 'width')} FROM x GROUP BY 1")
def _(s, d):
    m = EV.directional_interval(pr(s, d), SP)
    return m.select("series", rd("direction", 6).alias("direction"), rd("coverage", 6).alias("coverage"), rd("width").alias("width"))


@query("eval_residual_autocorrelation", f"WITH {PR}, e AS (SELECT series, ts, y-prediction AS e FROM pr), l AS (SELECT series, e, lag(e,1) OVER ({W}) AS l1, lag(e,2) OVER ({W}) AS l2, lag(e,10) OVER ({W}) AS l10 FROM e) SELECT series, count(*) AS n, {R('corr(e,l1)', 'acf_1', 6)}, {R('corr(e,l2)', 'acf_2', 6)}, {R('corr(e,l10)', 'acf_10', 6)} FROM l GROUP BY 1")
def _(s, d):
    return rcols(EV.residual_diagnostics(pr(s, d), SP), ["series", "n"], ["acf_1", "acf_2", "acf_10"], 6)


@query("eval_error_analysis", f"WITH {PR}, e AS (SELECT series, y-prediction AS e, row_number() OVER ({W}) AS i, count(*) OVER (PARTITION BY series) AS n FROM pr) SELECT series, {R('regr_slope(e,i)', 'trend', 5)}, {R('sqrt(avg(CASE WHEN i<=n/2 THEN e*e END))', 'rmse_first', 3)}, {R('sqrt(avg(CASE WHEN i>n/2 THEN e*e END))', 'rmse_second', 3)} FROM e GROUP BY 1")
def _(s, d):
    m = EV.error_analysis(pr(s, d), SP)
    return m.select("series", rd("trend", 5).alias("trend"), rd("rmse_first", 3).alias("rmse_first"), rd("rmse_second", 3).alias("rmse_second"))


@query("eval_trading_metrics", f"WITH {PR}, r AS (SELECT series, sign(prediction-lag(y) OVER ({W}))*(y/lag(y) OVER ({W})-1) AS r FROM pr), f AS (SELECT * FROM r WHERE r>-1) SELECT series, count(*) AS n, {R('avg((r>0)::INT)', 'win_rate', 6)}, {R('(avg(r)-0.02/252)/stddev_samp(r)*sqrt(252)', 'sharpe')}, {R('sum(CASE WHEN r>0 THEN r ELSE 0 END)/sum(CASE WHEN r<0 THEN -r ELSE 0 END)', 'profit_factor', 5)} FROM f GROUP BY 1")
def _(s, d):
    m = EV.strategy_metrics(pr(s, d), SP)
    return m.select("series", "n", rd("win_rate", 6).alias("win_rate"), rd("sharpe").alias("sharpe"), rd("profit_factor", 5).alias("profit_factor"))


LB = "lb AS (SELECT l.doc_id, quality AS label, CASE WHEN n_chars>1000 THEN 1 ELSE 0 END AS prediction, least(n_chars/20000.0,1) AS score FROM labels l JOIN documents d ON d.doc_id=l.doc_id)"


def lb(s, d):
    l, x = A.table(s, d, "labels"), A.table(s, d, "documents").select("doc_id", "n_chars")
    return l.join(x, "doc_id").select("doc_id", F.col("quality").alias("label"), F.when(F.col("n_chars") > 1000, 1).otherwise(0).alias("prediction"), F.least(F.col("n_chars") / 20000.0, F.lit(1.0)).alias("score"))


@query("eval_classification", f"""WITH {LB}, k AS (SELECT k, sum((label=k AND prediction=k)::INT) AS tp, sum((label=k)::INT) AS a, sum((prediction=k)::INT) AS p FROM lb, (SELECT unnest([0,1]) AS k) GROUP BY k), m AS (SELECT *, coalesce(tp/nullif(p,0),0) AS pr, coalesce(tp/nullif(a,0),0) AS rc FROM k) SELECT {R('sum(tp)/sum(a)', 'accuracy', 6)}, {R('avg(pr)', '"precision"', 6)}, {R('avg(rc)', 'recall', 6)}, {R('avg(coalesce(2*pr*rc/nullif(pr+rc,0),0))', 'f1', 6)}, CAST(sum(a) AS BIGINT) AS n FROM m""")
def _(s, d):
    return rcols(EV.classification_metrics(lb(s, d)), ["n"], ["accuracy", "precision", "recall", "f1"], 6)


@query("eval_auc_logloss", f"WITH {LB}, r AS (SELECT *, rank() OVER (ORDER BY score)+(count(*) OVER (PARTITION BY score)-1)/2.0 AS r, greatest(least(score,1-1e-15),1e-15) AS q FROM lb) SELECT {R('(sum(label*r)-sum(label)*(sum(label)+1)/2.0)/(sum(label)*sum(1-label))', 'auc', 6)}, {R('-avg(label*ln(q)+(1-label)*ln(1-q))', 'logloss', 5)} FROM r")
def _(s, d):
    m = EV.auc_logloss(lb(s, d))
    return m.select(rd("auc", 6).alias("auc"), rd("logloss", 5).alias("logloss"))


_pw = "CASE " + " ".join(f"WHEN u<{v!r}::DOUBLE THEN {k}" for k, v in enumerate(EV._POISSON)) + f" ELSE {len(EV._POISSON)} END"


@query("eval_bootstrap_interval", f"WITH d AS (SELECT event_type, value, rep, {U(42, 'event_id||' + chr(39) + '|' + chr(39) + '||rep')} AS u FROM events, range(1,51) t(rep)), r AS (SELECT event_type, rep, sum(value*({_pw}))/sum({_pw}) AS m FROM d GROUP BY ALL) SELECT event_type, {R('avg(m)', 'mean')}, {R('quantile_cont(m,0.025)', 'lower')}, {R('quantile_cont(m,0.975)', 'upper')} FROM r GROUP BY 1")
def _(s, d):
    b = EV.bootstrap_interval(A.table(s, d, "events"), F.col("value"), "event_id", 50, keys=["event_type"])
    return rcols(b, ["event_type"], ["mean", "lower", "upper"])


def _mt(s, d, p):
    m = EV.regression_metrics(pr(s, d), p=p)
    return m.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in ("mae", "rmse", "r2")])).alias("x")).select("x.*")


MT = PR + """, ma AS (SELECT unnest([{'m':'mae','v':avg(abs(y-naive))},{'m':'rmse','v':sqrt(avg(pow(y-naive,2)))},{'m':'r2','v':1-avg(pow(y-naive,2))/var_pop(y)}]) AS u FROM pr), mb AS (SELECT unnest([{'m':'mae','v':avg(abs(y-prediction))},{'m':'rmse','v':sqrt(avg(pow(y-prediction,2)))},{'m':'r2','v':1-avg(pow(y-prediction,2))/var_pop(y)}]) AS u FROM pr), mm AS (SELECT ma.u.m AS metric, ma.u.v AS a, mb.u.v AS b FROM ma JOIN mb ON ma.u.m=mb.u.m)"""


@query("eval_compare_metrics", f"WITH {MT} SELECT metric, {R('b-a', 'difference')}, {R('(b-a)/abs(a)', 'relative', 5)}, CAST(abs((b-a)/abs(a))>0.05 AS INTEGER) AS significant FROM mm")
def _(s, d):
    c = EV.compare_metrics(_mt(s, d, "naive"), _mt(s, d, "prediction"))
    return c.select("metric", rd("difference").alias("difference"), rd("relative", 5).alias("relative"), "significant")


@query("eval_regression_test", f"WITH {MT}, d AS (SELECT *, CASE WHEN metric='r2' THEN b-a ELSE a-b END/abs(b) AS g FROM mm) SELECT metric, {R('g', 'degradation', 5)}, CASE WHEN g>0.2 THEN 'critical' WHEN g>0.1 THEN 'high' WHEN g>0.05 THEN 'medium' ELSE 'none' END AS severity FROM d")
def _(s, d):
    r = EV.regression_test(_mt(s, d, "naive"), _mt(s, d, "prediction"), {}, ["r2"])
    return r.select("metric", rd("degradation", 5).alias("degradation"), "severity")


@query("eval_latency_stats", f"SELECT event_type, count(*) AS n, {R('avg(value)', 'mean')}, {R('max(value)', 'max')}, {R('quantile_disc(value,0.5)', 'p50')}, {R('quantile_disc(value,0.95)', 'p95')} FROM events GROUP BY 1")
def _(s, d):
    l = EV.latency_stats(A.table(s, d, "events"), "value", "ts", ["event_type"])
    return rcols(l, ["event_type", "n"], ["mean", "max", "p50", "p95"])


@query("eval_prediction_stability", f"WITH {PR} SELECT 'mean5' AS v1, 'naive' AS v2, {R('corr(prediction,naive)', 'corr', 6)}, {R('avg(abs(prediction-naive))', 'mad')}, {R('stddev_samp(prediction-naive)', 'diff_std')} FROM pr")
def _(s, d):
    p = pr(s, d).withColumn("key", F.struct("series", "ts"))
    l = p.select("key", F.explode(F.array(F.struct(F.lit("mean5").alias("version"), F.col("prediction").alias("prediction")), F.struct(F.lit("naive").alias("version"), F.col("naive").alias("prediction")))).alias("x")).select("key", "x.*")
    r = EV.prediction_stability(l, "key")
    return r.select("v1", "v2", rd("corr", 6).alias("corr"), rd("mad").alias("mad"), rd("diff_std").alias("diff_std"))


@query("eval_volatility_losses", f"WITH {PR} SELECT series, {R('avg(ln(prediction)+y/prediction)', 'qlike', 5)}, {R('pow(corr(ln(y),ln(prediction)),2)', 'r2_log', 6)}, {R('avg((abs(y-prediction)<=0.2*y)::INT)', 'hit_rate', 6)} FROM pr GROUP BY 1")
def _(s, d):
    l = EV.volatility_losses(pr(s, d), ["series"])
    return l.select("series", rd("qlike", 5).alias("qlike"), rd("r2_log", 6).alias("r2_log"), rd("hit_rate", 6).alias("hit_rate"))


@query("eval_diebold_mariano", f"WITH {PR}, l AS (SELECT series, pow(y-prediction,2)-pow(y-naive,2) AS l FROM pr) SELECT series, count(*) AS n, {R('avg(l)/sqrt(var_samp(l)/count(l))', 'dm', 5)} FROM l GROUP BY 1")
def _(s, d):
    return rcols(EV.diebold_mariano(pr(s, d), "prediction", "naive", keys=["series"]), ["series", "n"], ["dm"], 5)


@query("eval_confidence_set", f"WITH {PR}, s AS (SELECT series AS model, sqrt(avg(pow(y-prediction,2))) AS score FROM pr GROUP BY 1), t AS (SELECT min(score) AS b, stddev_samp(score) AS sd, sum(1/(score+1e-12)) AS w FROM s) SELECT model, CAST(rank() OVER (ORDER BY score) AS INTEGER) AS rank, CAST(score<=b+0.5*sd AS INTEGER) AS in_set, {R('1/(score+1e-12)/w', 'weight', 6)} FROM s, t")
def _(s, d):
    sc = EV.regression_metrics(pr(s, d), ["series"]).select(F.col("series").alias("model"), F.col("rmse").alias("score"))
    return EV.confidence_set(sc, 0.5).select("model", "rank", "in_set", rd("weight", 6).alias("weight"))


@query("eval_rolling_performance", f"WITH {PR}, e AS (SELECT series, ts, row_number() OVER ({W}) AS rn, pow(y-prediction,2) AS e FROM pr), r AS (SELECT series, ts, rn, CASE WHEN rn>=30 THEN sqrt(avg(e) OVER ({W} ROWS 29 PRECEDING)) END AS r FROM e) SELECT series, {R('stddev_samp(r)/avg(r)', 'cv', 5)}, {R('1/(1+stddev_samp(r)/avg(r))', 'stability', 5)}, {R('avg(CASE WHEN year(ts)>=1999 THEN r END)/avg(CASE WHEN year(ts)<1999 THEN r END)-1', 'overfit_gap', 5)} FROM r GROUP BY 1")
def _(s, d):
    r = EV.rolling_performance(pr(s, d), SP)
    return rcols(EV.stability_gap(r, ["series"], F.year("ts") < 1999), ["series"], ["cv", "stability", "overfit_gap"], 5)


HI = """hi AS (SELECT user_id%10 AS task, CAST(day(ts) AS INTEGER) AS step, 'score' AS metric, avg(value)/100 AS value FROM events GROUP BY ALL)"""


def hist(s, d):
    e = A.table(s, d, "events")
    return e.groupBy((F.col("user_id") % 10).alias("task"), F.dayofmonth("ts").alias("step"), F.lit("score").alias("metric")).agg((F.avg("value") / 100).alias("value"))


@query("eval_forgetting", f"WITH {HI}, b AS (SELECT *, max(value) OVER (PARTITION BY task ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best, first_value(value) OVER (PARTITION BY task ORDER BY step) AS f FROM hi) SELECT task, step, {R('greatest(best-value,0)', 'forgetting', 5)}, {R('value/best', 'retention', 5)}, {R('value-f', 'backward_transfer', 5)}, CAST(coalesce(greatest(best-value,0)>.05,false) AND best IS NOT NULL AS INTEGER) AS event FROM b")
def _(s, d):
    f = EV.forgetting(hist(s, d))
    fg = F.when(F.col("best").isNotNull(), F.col("forgetting")).otherwise(0.0)
    return f.select("task", "step", rd(fg, 5).alias("forgetting"), rd("retention", 5).alias("retention"), rd("backward_transfer", 5).alias("backward_transfer"), F.when(F.col("best").isNull(), 0).otherwise(F.col("event")).alias("event"))


@query("eval_plasticity", f"WITH {HI}, g AS (SELECT task, min(CASE WHEN value>=0.55 THEN step END) AS fs, avg(value) AS ef, regr_slope(value, step) AS ad FROM hi GROUP BY 1) SELECT task, fs AS first_step, {R('ef', 'efficiency', 5)}, {R('ad', 'adaptation', 6)}, {R('first_value(fs) OVER (ORDER BY task)/fs', 'speed_up', 5)} FROM g")
def _(s, d):
    p = EV.plasticity(hist(s, d), .55)
    return p.select("task", "first_step", rd("efficiency", 5).alias("efficiency"), rd("adaptation", 6).alias("adaptation"), rd("speed_up", 5).alias("speed_up"))


@query("eval_prediction_validation", f"WITH {PR} SELECT count(*) AS n, CAST(0 AS BIGINT) AS nulls, CAST(0 AS BIGINT) AS nans, CAST(0 AS BIGINT) AS infinite, CAST(sum((prediction<800 OR prediction>2000)::INT) AS BIGINT) AS out_of_range, CAST(0 AS BIGINT) AS different FROM pr")
def _(s, d):
    p = pr(s, d)
    v = EV.validate_predictions(p, lo=800.0, hi=2000.0)
    return v.withColumn("different", EV.determinism(p, p, ["series", "ts"]).select("different").scalar())


@query("split_time_folds", f"WITH {PR}, n AS (SELECT series, ts, row_number() OVER ({W}) AS rn, count(*) OVER (PARTITION BY series) AS n FROM pr), k AS (SELECT *, least(floor((rn-1)*4/n),3) AS k FROM n), f AS (SELECT series, f.f AS fold, CASE WHEN k<=f.f THEN 'train' WHEN k=f.f+1 THEN 'test' END AS role FROM k, (SELECT unnest([0,1,2]) AS f) f) SELECT series, CAST(fold AS INTEGER) AS fold, role, count(*) AS n FROM f WHERE role IS NOT NULL GROUP BY ALL")
def _(s, d):
    return EV.time_folds(pr(s, d), SP, 3).groupBy("series", "fold", "role").agg(F.count(F.lit(1)).alias("n"))


@query("split_walk_forward", f"WITH {PR}, n AS (SELECT series, ts, row_number() OVER ({W}) AS rn FROM pr), f AS (SELECT series, f.f AS fold, CASE WHEN rn>f.f*63 AND rn<=f.f*63+252 THEN 'train' WHEN rn>f.f*63+252 AND rn<=f.f*63+315 THEN 'test' END AS role FROM n, (SELECT unnest([0,1,2]) AS f) f) SELECT series, CAST(fold AS INTEGER) AS fold, role, count(*) AS n FROM f WHERE role IS NOT NULL GROUP BY ALL")
def _(s, d):
    return EV.time_folds(pr(s, d), SP, 3, "walk_forward").groupBy("series", "fold", "role").agg(F.count(F.lit(1)).alias("n"))


def _long(s, d):
    return pr(s, d).select("series", "ts", "y", F.explode(F.array(F.struct(F.lit("a").alias("model"), F.col("naive").alias("prediction")), F.struct(F.lit("b").alias("model"), F.col("prediction").alias("prediction")))).alias("x")).select("series", "ts", "y", "x.*")


@query("ensemble_blend", f"WITH {PR} SELECT series, ts, {R('(naive*0.3+prediction*0.7)', 'prediction')} FROM pr")
def _(s, d):
    w = s.createDataFrame([("a", .3), ("b", .7)], "model string, weight double")
    return rcols(EV.blend(_long(s, d), ["series", "ts"], w), ["series", "ts"], ["prediction"])


@query("ensemble_recent_error_weights", f"WITH {PR}, e AS (SELECT *, avg(abs(y-naive)) OVER w AS ea, avg(abs(y-prediction)) OVER w AS eb FROM pr WINDOW w AS ({W} ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)), v AS (SELECT *, coalesce(1/(ea+1e-8),1) AS wa, coalesce(1/(eb+1e-8),1) AS wb FROM e) SELECT series, ts, {R('(naive*wa+prediction*wb)/(wa+wb)', 'prediction')} FROM v")
def _(s, d):
    return rcols(EV.recent_error_weights(_long(s, d), ["series"]), ["series", "ts"], ["prediction"])


@query("ensemble_multi_horizon", f"WITH {PR}, h AS (SELECT series, ts, naive AS yhat, naive-200 AS lo, naive+200 AS hi FROM pr UNION ALL SELECT series, ts, prediction, prediction-300, prediction+300 FROM pr), g AS (SELECT series, ts, sum(yhat/(hi-lo+1e-8))/sum(1/(hi-lo+1e-8)) AS yhat, sum(lo/(hi-lo+1e-8))/sum(1/(hi-lo+1e-8)) AS lo, sum(hi/(hi-lo+1e-8))/sum(1/(hi-lo+1e-8)) AS hi FROM h GROUP BY ALL) SELECT series, ts, {R('yhat')}, {R('lo', 'lower')}, {R('hi', 'upper')}, {R('greatest(1-(hi-lo)/(2*abs(yhat)),0)', 'confidence', 5)} FROM g")
def _(s, d):
    p = pr(s, d)
    h = p.select("series", "ts", F.col("naive").alias("yhat"), (F.col("naive") - 200).alias("lower"), (F.col("naive") + 200).alias("upper")).unionByName(p.select("series", "ts", F.col("prediction").alias("yhat"), "lower", "upper"))
    b = EV.blend_horizons(h)
    return b.select("series", "ts", *[rd(c).alias(c) for c in ("yhat", "lower", "upper")], rd("confidence", 5).alias("confidence"))
