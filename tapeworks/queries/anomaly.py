"""Outlier detection."""
from __future__ import annotations

from pyspark.sql import functions as F

from tapeworks.operators import anomaly as AN
from tapeworks.plans.panel import Panel, day_bucket, on_chunks
from tapeworks.queries import query
from tapeworks.queries.common import R, RS, TICKS, rcols, rd
from tapeworks.sources import adapters as A

LK = ["l_orderkey", "l_linenumber", "l_partkey"]
LKS = "l_orderkey, l_linenumber, l_partkey"


def li(s, d, *c):
    return A.table(s, d, "lineitem").select(*LK, *c)


@query("anom_zscore", f"SELECT {LKS}, {R('abs(l_extendedprice-m)/sd','score',6)}, CAST(abs(l_extendedprice-m)/sd > 2 AS INTEGER) AS label FROM lineitem, (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS sd FROM lineitem)")
def _(s, d):
    return AN.zscore(li(s, d, "l_extendedprice"), "l_extendedprice", 2.0).select(*LK, rd("score", 6).alias("score"), "label")


@query("anom_robust_zscore", f"""WITH m AS (SELECT event_type, median(value) AS med FROM events GROUP BY 1), k AS (SELECT event_type, median(abs(value-med))*1.4826 AS mad FROM events JOIN m USING (event_type) GROUP BY 1)
 SELECT event_id, {R('abs(value-med)/mad','score',6)}, CAST(abs(value-med)/mad > 3 AS INTEGER) AS label FROM events JOIN m USING (event_type) JOIN k USING (event_type)""")
def _(s, d):
    e = A.table(s, d, "events").select("event_id", "event_type", "value")
    return AN.zscore(e, "value", 3.0, ["event_type"], robust=True).select("event_id", rd("score", 6).alias("score"), "label")


@query("anom_rolling_zscore_chunked", f"""WITH {TICKS}, z AS (SELECT trade_id, CASE WHEN count(*) OVER w = 20 THEN abs(price - avg(price) OVER w)/stddev_samp(price) OVER w END AS score FROM ticks
 WINDOW w AS (PARTITION BY event_type ORDER BY ts, trade_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) SELECT trade_id, {R('score','score',6)}, CAST(coalesce(score > 3, false) AS INTEGER) AS label FROM z""")
def _(s, d):
    t = A.ticks(s, d)
    fn = lambda x, p: AN.rolling_zscore(x, "price", 20, 3.0, p)
    return on_chunks(t, Panel(("event_type",), ("ts", "trade_id")), fn, bucket=day_bucket(), before=20, rows=500).select("trade_id", rd("score", 6).alias("score"), "label")


@query("anom_mad", f"""WITH m AS (SELECT median(o_totalprice) AS med FROM orders), k AS (SELECT median(abs(o_totalprice-med)) AS mad FROM orders, m)
 SELECT o_orderkey, {R('abs(0.6745*(o_totalprice-med)/mad)','score',6)}, CAST(abs(0.6745*(o_totalprice-med)/mad) > 1 AS INTEGER) AS label, {R('abs(0.6745*(o_totalprice-med)/(1.4826*mad))','legacy',6)} FROM orders, m, k""")
def _(s, d):
    o = A.table(s, d, "orders").select("o_orderkey", "o_totalprice")
    a = AN.mad_score(o, "o_totalprice", 1.0)
    return a.select("o_orderkey", rd("score", 6).alias("score"), "label", rd(F.col("score") / 1.4826, 6).alias("legacy"))


@query("anom_rolling_mad", f"""WITH {TICKS}, l AS (SELECT trade_id, price, list(price) OVER w AS l FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts, trade_id ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING)),
 m AS (SELECT *, list_median(l) AS med FROM l), k AS (SELECT *, list_median(list_transform(l, lambda x: abs(x-med))) AS mad FROM m), z AS (SELECT trade_id, CASE WHEN len(l)=21 THEN CASE WHEN mad=0 THEN 0 ELSE abs(0.6745*(price-med)/mad) END END AS score FROM k)
 SELECT trade_id, {R('score','score',6)}, CAST(coalesce(score>3.5,false) AS INTEGER) AS label FROM z""")
def _(s, d):
    t = A.ticks(s, d)
    fn = lambda x, p: AN.rolling_mad(x, "price", 21, 3.5, p)
    return on_chunks(t, Panel(order=("ts", "trade_id")), fn, bucket=day_bucket(), before=21).select("trade_id", rd("score", 6).alias("score"), "label")


FEN = "q AS (SELECT event_type, quantile_cont(value,.25) AS q1, quantile_cont(value,.75) AS q3 FROM events GROUP BY 1)"


@query("anom_iqr_tukey", f"""WITH {FEN} SELECT event_id, {R('greatest(q1-1.5*(q3-q1)-value, value-q3-1.5*(q3-q1), 0)/(q3-q1)','score',6)}, CAST(value < q1-1.5*(q3-q1) OR value > q3+1.5*(q3-q1) AS INTEGER) AS label,
 CASE WHEN value < q1-3*(q3-q1) OR value > q3+3*(q3-q1) THEN 'extreme' WHEN value < q1-1.5*(q3-q1) OR value > q3+1.5*(q3-q1) THEN 'mild' ELSE 'normal' END AS severity FROM events JOIN q USING (event_type)""")
def _(s, d):
    e = A.table(s, d, "events").select("event_id", "event_type", "value")
    r = AN.tukey(AN.iqr_score(e, "value", keys=["event_type"]), "value", ["event_type"])
    return r.select("event_id", rd("score", 6).alias("score"), "label", "severity")


@query("anom_rolling_iqr", f"""WITH {TICKS}, q AS (SELECT trade_id, price, count(*) OVER w AS n, quantile_cont(price,.25) OVER w AS q1, quantile_cont(price,.75) OVER w AS q3 FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts, trade_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
 SELECT trade_id, CAST(coalesce(n=20 AND (price<q1-1.5*(q3-q1) OR price>q3+1.5*(q3-q1)), false) AS INTEGER) AS label FROM q""")
def _(s, d):
    fn = lambda x, p: AN.rolling_iqr(x, "price", 20, 1.5, p)
    return on_chunks(A.ticks(s, d), Panel(order=("ts", "trade_id")), fn, bucket=day_bucket(), before=20).select("trade_id", "label")


@query("anom_boxplot", f"""WITH l AS (SELECT 'l_quantity' AS feature, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem UNION ALL SELECT 'l_tax', l_tax FROM lineitem),
 q AS (SELECT feature, quantile_cont(v,.25) AS q1, median(v) AS med, quantile_cont(v,.75) AS q3, count(*) AS n FROM l GROUP BY 1)
 SELECT feature, n, {RS(['q1','med','q3'])}, {R('min(CASE WHEN v BETWEEN q1-1.5*(q3-q1) AND q3+1.5*(q3-q1) THEN v END)','whisker_low')}, {R('max(CASE WHEN v BETWEEN q1-1.5*(q3-q1) AND q3+1.5*(q3-q1) THEN v END)','whisker_high')},
 CAST(sum(CASE WHEN v BETWEEN q1-1.5*(q3-q1) AND q3+1.5*(q3-q1) THEN 0 ELSE 1 END) AS BIGINT) AS n_outliers FROM l JOIN q USING (feature) GROUP BY feature, n, q1, med, q3""")
def _(s, d):
    return rcols(AN.boxplot(li(s, d, "l_quantity", "l_extendedprice", "l_tax"), ["l_quantity", "l_extendedprice", "l_tax"]), ["feature", "n", "n_outliers"], ["q1", "med", "q3", "whisker_low", "whisker_high"])


@query("anom_grubbs")
def _(s, d):
    e = A.table(s, d, "events").select("event_type", "value")
    r = AN.grubbs(e, "value", "event_type")
    return r.select("event_type", rd("value").alias("value"), "step", rd("g").alias("g"))


DIX = ", ".join(str(v) for v in AN.DIXON_95)


@query("anom_dixon", f"""WITH g AS (SELECT o_custkey, list_sort(list(o_totalprice)) AS l, count(*) AS n FROM orders GROUP BY 1), x AS (SELECT *, l[1] AS a1, l[2] AS a2, l[n] AS b1, l[n-1] AS b2, [{DIX}][n-2] AS c FROM g WHERE n BETWEEN 3 AND 30),
 y AS (SELECT *, coalesce((a2-a1)/nullif(CASE WHEN n>10 THEN b2-a1 ELSE b1-a1 END,0),0) AS ql, coalesce((b1-b2)/nullif(CASE WHEN n>10 THEN b1-a2 ELSE b1-a1 END,0),0) AS qh FROM x)
 SELECT o_custkey, n, {R('ql','q_low',6)}, {R('qh','q_high',6)}, {R('c','critical',6)}, {R('a1','low',2)}, {R('b1','high',2)}, CAST(ql>c AS INTEGER) AS low_outlier, CAST(qh>c AS INTEGER) AS high_outlier FROM y""")
def _(s, d):
    r = AN.dixon(A.table(s, d, "orders"), "o_totalprice", ["o_custkey"])
    return r.select("o_custkey", "n", *[rd(c, 6).alias(c) for c in ("q_low", "q_high", "critical")], rd("low", 2).alias("low"), rd("high", 2).alias("high"), "low_outlier", "high_outlier")


@query("anom_auto_threshold", f"""WITH z AS (SELECT abs(value-(SELECT avg(value) FROM events))/(SELECT stddev_samp(value) FROM events) AS s FROM events),
 q AS (SELECT quantile_cont(value,.25) AS q1, quantile_cont(value,.75) AS q3 FROM events), r AS (SELECT k, avg(CASE WHEN value<q1-k*(q3-q1) OR value>q3+k*(q3-q1) THEN 1.0 ELSE 0.0 END) AS rate FROM events, q, (SELECT unnest([1,1.5,2,2.5,3])::DOUBLE AS k) GROUP BY k)
 SELECT {R('greatest((SELECT quantile_cont(s,.95) FROM z), 1.5)','threshold',6)}, k, {R('rate','rate',6)} FROM r ORDER BY abs(rate-0.05), k LIMIT 1""")
def _(s, d):
    e = A.table(s, d, "events").select("value")
    t = AN.auto_threshold(AN.zscore(e, "value"), 0.05, 1.5)
    k = AN.auto_iqr_multiplier(e, "value", 0.05)
    return k.withColumn("threshold", t.select("threshold").scalar()).select(rd("threshold", 6).alias("threshold"), "k", rd("rate", 6).alias("rate"))


@query("anom_detector_report", f"""WITH m AS (SELECT event_type, avg(value) AS m, stddev_samp(value) AS sd FROM events GROUP BY 1), z AS (SELECT event_type, abs(value-m)/sd AS s FROM events JOIN m USING (event_type))
 SELECT event_type, count(*) AS n, CAST(sum(CASE WHEN s>3 THEN 1 ELSE 0 END) AS BIGINT) AS n_anomalies, {R('avg(CASE WHEN s>3 THEN 1.0 ELSE 0.0 END)','rate',6)}, {R('max(s)','max_score',6)}, {R('avg(s)','mean_score',6)} FROM z GROUP BY 1""")
def _(s, d):
    e = A.table(s, d, "events").select("event_type", "value")
    return rcols(AN.detector_report(AN.detect(e, "value", "zscore", ["event_type"]), ["event_type"]), ["event_type", "n", "n_anomalies"], ["rate", "max_score", "mean_score"], 6)


@query("anom_multi_feature", f"""WITH m AS (SELECT avg(l_quantity) AS qm, stddev_samp(l_quantity) AS qs, avg(l_extendedprice) AS pm, stddev_samp(l_extendedprice) AS ps FROM lineitem)
 SELECT {LKS}, {R('greatest(abs(l_quantity-qm)/qs, abs(l_extendedprice-pm)/ps)','score',6)}, CAST(greatest(abs(l_quantity-qm)/qs, abs(l_extendedprice-pm)/ps) > 2 AS INTEGER) AS label FROM lineitem, m""")
def _(s, d):
    return AN.multi_feature_zscore(li(s, d, "l_quantity", "l_extendedprice"), ["l_quantity", "l_extendedprice"], 2.0).select(*LK, rd("score", 6).alias("score"), "label")


@query("anom_isolation_forest")
def _(s, d):
    e = A.table(s, d, "events").select("event_id", "value", F.hour("ts").cast("double").alias("hour"))
    return AN.isolation_forest(e, ["value", "hour"], "event_id").select("event_id", rd("score").alias("score"), "label")


LOFK = 10


@query("anom_local_outlier_factor", f"""WITH p AS (SELECT a.vec_id AS id, b.vec_id AS nb, sqrt(list_sum(list_transform(range(1, len(a.embedding)+1), lambda i: (a.embedding[i]::DOUBLE-b.embedding[i]::DOUBLE)*(a.embedding[i]::DOUBLE-b.embedding[i]::DOUBLE)))) AS dist FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
 n AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, nb) <= {LOFK}), kd AS (SELECT id, max(dist) AS kd FROM n GROUP BY 1), r AS (SELECT n.id, n.nb, greatest(dist, kd.kd) AS reach FROM n JOIN kd ON kd.id = n.nb),
 l AS (SELECT id, 1/avg(reach) AS lrd FROM r GROUP BY 1) SELECT r.id AS vec_id, {R('avg(b.lrd)/max(a.lrd)','lof')} FROM r JOIN l a ON a.id = r.id JOIN l b ON b.id = r.nb GROUP BY r.id""")
def _(s, d):
    return AN.local_outlier_factor(A.table(s, d, "embeddings"), "vec_id", "embedding", LOFK, 4).select("vec_id", rd("lof").alias("lof"))
