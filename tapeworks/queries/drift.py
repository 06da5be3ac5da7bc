"""Drift between the earlier and the later half of lineitem."""
from __future__ import annotations

from pyspark.sql import functions as F

from tapeworks.operators import drift as D
from tapeworks.operators import quality as Q
from tapeworks.queries import query
from tapeworks.queries.common import R, RS, rcols, rd
from tapeworks.queries.quality import BS, NUM, halves
from tapeworks.sources import adapters as A

TB = "tb AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS v, (l_shipdate>=TIMESTAMP '1998-06-01')::INT AS w FROM lineitem" for c in NUM) + ")"
EC = TB + """, dv AS (SELECT feature, v, sum(1-w) AS b, sum(w) AS c FROM tb GROUP BY ALL), cu AS (SELECT *, sum(b) OVER o/sum(b) OVER p AS fb, sum(c) OVER o/sum(c) OVER p AS fc, sum(b+c) OVER o-(b+c-1)/2.0 AS rk, sum(b) OVER p AS nb, sum(c) OVER p AS nc, lead(v) OVER (PARTITION BY feature ORDER BY v) AS nx FROM dv WINDOW o AS (PARTITION BY feature ORDER BY v ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY feature)),
 es AS (SELECT feature, max(nb) AS nb, max(nc) AS nc, max(abs(fb-fc)) AS ks, sum(abs(fb-fc)*(nx-v)) AS ws, max(CASE WHEN b>0 THEN v END)-min(CASE WHEN b>0 THEN v END) AS rg, sum(c*rk) AS rs, sum(pow(b+c,3)-(b+c)) AS ti FROM cu GROUP BY 1)"""


@query("drift_ks_wasserstein_ranksum", f"WITH {EC}, u AS (SELECT *, rs-nc*(nc+1)/2 AS u, sqrt(nc*nb/12.0*(nb+nc+1-ti/((nb+nc)*(nb+nc-1)))) AS sd FROM es) SELECT feature, CAST(nb AS BIGINT) AS n_base, CAST(nc AS BIGINT) AS n_cur, {R('ks', 'ks', 6)}, {R('ws', 'wasserstein', 5)}, {R('ws/rg', 'wasserstein_scaled', 6)}, {R('(u-nc*nb/2.0)/sd', 'u_z', 5)} FROM u")
def _(s, d):
    x = D.ecdf_drift(*halves(s, d), NUM)
    return x.select("feature", "n_base", "n_cur", rd("ks", 6).alias("ks"), rd("wasserstein", 5).alias("wasserstein"), rd("wasserstein_scaled", 6).alias("wasserstein_scaled"), rd("u_z", 5).alias("u_z"))


@query("drift_psi", f"""WITH {TB}, q AS (SELECT feature, list_distinct([""" + ", ".join(f"quantile_cont(v,{i / 10})" for i in range(1, 10)) + f"""]) AS e FROM tb WHERE w=0 GROUP BY 1), bn AS (SELECT feature, len(list_filter(e, lambda x: x<v)) AS bin, sum(1-w) AS b, sum(w) AS c FROM tb JOIN q USING (feature) GROUP BY ALL), p AS (SELECT feature, greatest(b/sum(b) OVER (PARTITION BY feature),1e-10) AS p, greatest(c/sum(c) OVER (PARTITION BY feature),1e-10) AS q FROM bn)
 SELECT feature, {R('sum((q-p)*ln(q/p))', 'psi', 6)}, CASE WHEN sum((q-p)*ln(q/p))>=.1 THEN 'some' ELSE 'none' END AS level FROM p GROUP BY 1""")
def _(s, d):
    return rcols(D.psi(*halves(s, d), NUM), ["feature", "level"], ["psi"], 6)


@query("drift_jensen_shannon", f"""WITH {TB}, m AS (SELECT feature, min(v) AS lo, max(v) AS hi FROM tb GROUP BY 1), bn AS (SELECT feature, least(floor((v-lo)*49/(hi-lo)),48) AS bin, sum(1-w) AS b, sum(w) AS c FROM tb JOIN m USING (feature) GROUP BY ALL), p AS (SELECT feature, b/sum(b) OVER (PARTITION BY feature) AS p, c/sum(c) OVER (PARTITION BY feature) AS q FROM bn)
 SELECT feature, {R('sqrt(greatest(sum(0.5*(CASE WHEN p>0 THEN p*ln(2*p/(p+q)) ELSE 0 END+CASE WHEN q>0 THEN q*ln(2*q/(p+q)) ELSE 0 END)),0))', 'js', 6)} FROM p GROUP BY 1""")
def _(s, d):
    return rcols(D.jensen_shannon(*halves(s, d), NUM), ["feature"], ["js"], 6)


@query("drift_chi_square", f"WITH b AS (SELECT l_returnflag AS k, count(*) AS b FROM lineitem WHERE l_shipdate<TIMESTAMP '1998-06-01' GROUP BY 1), c AS (SELECT l_returnflag AS k, count(*) AS c FROM lineitem WHERE l_shipdate>=TIMESTAMP '1998-06-01' GROUP BY 1), j AS (SELECT coalesce(b,0) AS b, coalesce(c,0) AS c FROM b FULL JOIN c USING (k)), e AS (SELECT c, greatest(b,0.5)/(SELECT sum(b) FROM j)*(SELECT sum(c) FROM j) AS e FROM j) SELECT {R('sum(pow(c-e,2)/e)', 'chi2', 5)}, CAST(count(*)-1 AS INTEGER) AS dof, {R('exp(-sum(pow(c-e,2)/e)/2)', 'p', 6)} FROM e")
def _(s, d):
    b, c = halves(s, d)
    x = D.chi_square(b, c, "l_returnflag")
    return x.select(rd("chi2", 5).alias("chi2"), "dof", rd("p", 6).alias("p"))


@query("drift_statistic_distance", f"WITH {BS('b', '<')}, {BS('c', '>=')}, x AS (SELECT c.feature, (abs(c.mean-b.mean)/greatest(abs(b.mean),1e-10)+abs(c.std-b.std)/greatest(abs(b.std),1e-10)+abs(c.q25-b.q25)/greatest(abs(b.q25),1e-10)+abs(c.q50-b.q50)/greatest(abs(b.q50),1e-10)+abs(c.q75-b.q75)/greatest(abs(b.q75),1e-10))/5 AS d FROM c JOIN b USING (feature)) SELECT feature, {R('d', 'distance', 5)}, CAST(d>.1 AS INTEGER) AS drifted FROM x")
def _(s, d):
    b, c = halves(s, d)
    return rcols(D.statistic_distance(Q.baseline_stats(c, NUM), Q.baseline_stats(b, NUM)), ["feature", "drifted"], ["distance"], 5)


@query("drift_adversarial")
def _(s, d):
    return rcols(D.adversarial(*halves(s, d), NUM), ["drifted"], ["auc"], 3)


@query("drift_concept", f"WITH m AS (SELECT l_returnflag AS k, CAST(year(l_shipdate) AS INTEGER) AS w, avg(l_discount) AS v FROM lineitem GROUP BY ALL), p AS (SELECT *, avg(v) OVER (PARTITION BY k ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pv FROM m) SELECT k, w AS \"window\", {R('v', 'value', 6)}, {R('(pv-v)/abs(pv)', '\"drop\"', 5)}, CAST(coalesce((pv-v)/abs(pv)>0.01,false) AS INTEGER) AS drifted FROM p")
def _(s, d):
    m = A.table(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("k"), F.year("l_shipdate").alias("window")).agg(F.avg("l_discount").alias("value"))
    x = D.concept_drift(m, ["k"], 0.01)
    return x.select("k", "window", rd("value", 6).alias("value"), rd("drop", 5).alias("drop"), "drifted")


@query("drift_verdict", f"WITH {EC} SELECT count(*) AS features, CAST(sum((ks>0.01)::INT) AS BIGINT) AS drifted, {R('avg((ks>0.01)::INT)', 'share')} FROM es")
def _(s, d):
    e = D.ecdf_drift(*halves(s, d), NUM).select("feature", (F.col("ks") > .01).cast("int").alias("drifted"))
    return D.verdict(e).select("features", "drifted", rd("share").alias("share"))
