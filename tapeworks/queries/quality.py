"""Data quality."""
from __future__ import annotations

from pyspark.sql import functions as F

from tapeworks.operators import quality as Q
from tapeworks.operators.bars import with_returns
from tapeworks.queries import query
from tapeworks.queries.common import BARS, R, RS, rcols, rd
from tapeworks.sources import adapters as A

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def li(s, d):
    return A.table(s, d, "lineitem")


def halves(s, d):
    l = li(s, d)
    return l.where("l_shipdate < timestamp_ntz'1998-06-01'"), l.where("l_shipdate >= timestamp_ntz'1998-06-01'")


@query("quality_missing", f"""WITH x AS (SELECT CASE WHEN l_discount=0 THEN NULL ELSE l_discount END AS l_discount, l_tax, CASE WHEN l_quantity>40 THEN NULL ELSE l_quantity END AS l_quantity FROM lineitem), m AS (SELECT 'l_discount' AS c, count(*) AS n, count(*)-count(l_discount) AS m FROM x UNION ALL SELECT 'l_tax', count(*), count(*)-count(l_tax) FROM x UNION ALL SELECT 'l_quantity', count(*), count(*)-count(l_quantity) FROM x)
 SELECT c AS "column", n, m AS missing, {R('m/n', 'share', 6)}, CASE WHEN m/n>.2 THEN 'high' WHEN m/n>.05 THEN 'medium' WHEN m>0 THEN 'low' ELSE 'none' END AS severity FROM m""")
def _(s, d):
    x = li(s, d).select(F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("l_discount"), "l_tax", F.when(F.col("l_quantity") <= 40, F.col("l_quantity")).alias("l_quantity"))
    return rcols(Q.missing_profile(x), ["column", "n", "missing", "severity"], ["share"], 6)


@query("quality_duplicates", f"WITH g AS (SELECT count(*) AS k FROM documents GROUP BY text) SELECT CAST(sum(k) AS BIGINT) AS n, CAST(sum(k-1) AS BIGINT) AS duplicates, {R('sum(k-1)/sum(k)', 'share', 6)} FROM g")
def _(s, d):
    return rcols(Q.duplicate_rows(A.table(s, d, "documents"), ["text"]), ["n", "duplicates"], ["share"], 6)


@query("quality_near_duplicates", f"""WITH st AS (SELECT avg(s_acctbal) AS m1, stddev_samp(s_acctbal) AS s1, avg(s_nationkey) AS m2, stddev_samp(s_nationkey) AS s2, avg(s_suppkey) AS m3, stddev_samp(s_suppkey) AS s3 FROM supplier), z AS (SELECT s_suppkey AS id, (s_acctbal-m1)/s1 AS a, (s_nationkey-m2)/s2 AS b, (s_suppkey-m3)/s3 AS c FROM supplier, st), u AS (SELECT id, a/sqrt(a*a+b*b+c*c) AS a, b/sqrt(a*a+b*b+c*c) AS b, c/sqrt(a*a+b*b+c*c) AS c FROM z),
 p AS (SELECT x.id, y.id AS nb, x.a*y.a+x.b*y.b+x.c*y.c AS cosine FROM u x JOIN u y ON x.id<>y.id) SELECT id AS s_suppkey, nb, {R('cosine', 'cosine', 6)} FROM p WHERE cosine>0.95 QUALIFY row_number() OVER (PARTITION BY id ORDER BY cosine DESC, nb)=1""")
def _(s, d):
    x = A.table(s, d, "supplier").select("s_suppkey", "s_acctbal", F.col("s_nationkey").cast("double").alias("nk"), F.col("s_suppkey").cast("double").alias("sk"))
    return rcols(Q.near_duplicates(x, "s_suppkey", ["s_acctbal", "nk", "sk"]), ["s_suppkey", "nb"], ["cosine"], 6)


@query("quality_type_checks", f"""WITH x AS (SELECT 'props' AS c, count(props) AS n, sum((try_cast(props AS DOUBLE) IS NOT NULL)::INT) AS k FROM events UNION ALL SELECT 'value', count(*), count(*) FROM events UNION ALL SELECT 'mixed', count(*), sum((event_id%3=0)::INT) FROM events) SELECT c AS "column", n, CAST(k AS BIGINT) AS "numeric", {R('k/n', 'share', 6)}, CASE WHEN k/n>=.95 THEN 'numeric' WHEN k/n>.05 THEN 'mixed' ELSE 'text' END AS kind FROM x""")
def _(s, d):
    e = A.table(s, d, "events").select("props", F.col("value").cast("string").alias("value"), F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string")).otherwise(F.col("event_type")).alias("mixed"))
    return rcols(Q.type_checks(e, ["props", "value", "mixed"]), ["column", "n", "numeric", "kind"], ["share"], 6)


UNP = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS v FROM lineitem" for c in NUM)


@query("quality_outlier_share", f"WITH l AS ({UNP}), q AS (SELECT feature, quantile_cont(v,.25) AS q1, quantile_cont(v,.75) AS q3 FROM l GROUP BY 1) SELECT feature, count(*) AS n, CAST(sum((v NOT BETWEEN q1-0.5*(q3-q1) AND q3+0.5*(q3-q1))::INT) AS BIGINT) AS outliers, {R('avg((v NOT BETWEEN q1-0.5*(q3-q1) AND q3+0.5*(q3-q1))::INT)', 'share', 6)} FROM l JOIN q USING (feature) GROUP BY 1")
def _(s, d):
    return rcols(Q.outlier_share(li(s, d), NUM, k=0.5), ["feature", "n", "outliers"], ["share"], 6)


@query("quality_range_rules", """WITH r AS (SELECT 'range_l_quantity' AS rule, count(*) AS n, sum((l_quantity<5 OR l_quantity>45)::INT) AS v FROM lineitem UNION ALL SELECT 'range_l_tax', count(*), sum((l_tax>0.07::DOUBLE)::INT) FROM lineitem UNION ALL SELECT 'zero_discount', count(*), sum((l_discount=0)::INT) FROM lineitem) SELECT rule, n, CAST(v AS BIGINT) AS violations, CASE WHEN v/n>.05 THEN 'high' WHEN v/n>.01 THEN 'medium' WHEN v>0 THEN 'low' ELSE 'none' END AS severity FROM r""")
def _(s, d):
    rules = {**Q.range_rules({"l_quantity": (5, 45), "l_tax": (None, 0.07)}), "zero_discount": F.col("l_discount") == 0}
    return Q.rule_report(li(s, d), rules).select("rule", "n", "violations", "severity")


OH = BARS + """, oh AS (SELECT count(*) AS n, sum((high<greatest(open,close))::INT) AS a, sum((low>least(open,close))::INT) AS b, sum((least(open,high,low,close)<=0)::INT) AS c, sum((volume<0)::INT) AS d, sum((volume=0)::INT) AS e, sum((abs(close/open-1)>0.5)::INT) AS f FROM bars), rp AS (SELECT unnest([{'r':'high_low','v':a},{'r':'low_high','v':b},{'r':'positive_price','v':c},{'r':'negative_volume','v':d},{'r':'zero_volume','v':e},{'r':'suspicious_move','v':f}]) AS u, n FROM oh)"""


@query("quality_ohlc_rules", f"WITH {OH} SELECT u.r AS rule, n, CAST(u.v AS BIGINT) AS violations FROM rp")
def _(s, d):
    return Q.rule_report(A.daily_bars(s, d), Q.ohlc_rules()).select("rule", "n", "violations")


@query("quality_score", f"WITH {OH}, p AS (SELECT u.v AS v, u.v/n AS sh FROM rp) SELECT count(*) AS checks, CAST(sum((v=0)::INT) AS BIGINT) AS passed, {R('100-avg(least(sh*CASE WHEN sh>.05 THEN 100 WHEN sh>.01 THEN 60 ELSE 30 END,100))', 'score')}, CASE WHEN 100-avg(least(sh*CASE WHEN sh>.05 THEN 100 WHEN sh>.01 THEN 60 ELSE 30 END,100))>=95 THEN 'excellent' ELSE 'good' END AS level FROM p")
def _(s, d):
    return rcols(Q.quality_score(Q.rule_report(A.daily_bars(s, d), Q.ohlc_rules())), ["checks", "passed", "level"], ["score"])


@query("quality_severity_rollup", f"WITH {OH}, p AS (SELECT u.v AS v, CASE WHEN u.v/n>.05 THEN 'high' WHEN u.v/n>.01 THEN 'medium' WHEN u.v>0 THEN 'low' ELSE 'none' END AS severity FROM rp) SELECT severity, count(*) AS checks, CAST(sum(v) AS BIGINT) AS violations FROM p GROUP BY ROLLUP (severity)")
def _(s, d):
    return Q.severity_rollup(Q.rule_report(A.daily_bars(s, d), Q.ohlc_rules()))


@query("quality_temporal", f"WITH x AS (SELECT o_orderdate AS t, lag(o_orderdate) OVER (ORDER BY o_orderkey) AS p FROM orders) SELECT count(*) AS n, CAST(sum((t<p)::INT) AS BIGINT) AS back_steps, CAST(sum((epoch(t)-epoch(p)>86400)::INT) AS BIGINT) AS gaps, {R('max((epoch(t)-epoch(p))/3600)', 'max_gap_hours')} FROM x")
def _(s, d):
    o = A.table(s, d, "orders").select("o_orderkey", "o_orderdate")
    t = Q.temporal_report(o, "o_orderdate", ["o_orderkey"], F.floor(F.col("o_orderkey") / 1000))
    return rcols(t, ["n", "back_steps", "gaps"], ["max_gap_hours"])


@query("quality_constant_features", f"""WITH l AS (SELECT 'l_linestatus' AS c, l_linestatus AS v FROM lineitem UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR) FROM lineitem UNION ALL SELECT 'one', '1' FROM lineitem), g AS (SELECT c, v, count(*) AS k FROM l GROUP BY ALL)
 SELECT c AS "column", CAST(sum(k) AS BIGINT) AS n, count(v) AS "distinct", arg_max(v, row(k, v)) AS mode, {R('max(k)/sum(k)', 'share', 6)}, CASE WHEN max(k)=sum(k) THEN 'constant' WHEN max(k)/sum(k)>.95 THEN 'quasi_constant' ELSE 'varying' END AS kind FROM g GROUP BY c""")
def _(s, d):
    x = li(s, d).select("l_linestatus", "l_linenumber", F.lit(1).alias("one"))
    return rcols(Q.constant_features(x, ["l_linestatus", "l_linenumber", "one"]), ["column", "n", "distinct", "mode", "kind"], ["share"], 6)


BS = lambda n, w: f"{n} AS (SELECT feature, avg(v) AS mean, stddev_samp(v) AS std, quantile_cont(v,.25) AS q25, median(v) AS q50, quantile_cont(v,.75) AS q75, min(v) AS mn, max(v) AS mx FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS v FROM lineitem WHERE l_shipdate {w} TIMESTAMP '1998-06-01'" for c in NUM) + ") GROUP BY 1)"


@query("quality_baseline_stats", f"WITH {BS('b', '<')} SELECT feature, {R('mean')}, {R('std')}, {R('q25')}, {R('q50')}, {R('q75')}, {R('mn', 'min')}, {R('mx', 'max')} FROM b")
def _(s, d):
    return rcols(Q.baseline_stats(halves(s, d)[0], NUM), ["feature"], ["mean", "std", "q25", "q50", "q75", "min", "max"])


@query("quality_stability", f"WITH {BS('b', '<')}, {BS('c', '>=')} SELECT c.feature, {R('abs(c.mean-b.mean)/abs(b.mean)', 'change', 6)}, CAST(abs(c.mean-b.mean)/abs(b.mean)>0.01 AS INTEGER) AS unstable FROM c JOIN b USING (feature)")
def _(s, d):
    b, c = halves(s, d)
    return rcols(Q.stability(Q.baseline_stats(c, NUM), Q.baseline_stats(b, NUM), 0.01), ["feature", "unstable"], ["change"], 6)


@query("quality_class_balance", f"SELECT toxic, count(*) AS n, {R('count(*)/(SELECT count(*) FROM labels)', 'share', 6)}, CAST(count(*)/(SELECT count(*) FROM labels)<0.05 AS INTEGER) AS rare FROM labels GROUP BY 1")
def _(s, d):
    return rcols(Q.class_balance(A.table(s, d, "labels"), "toxic"), ["toxic", "n", "rare"], ["share"], 6)


from itertools import combinations
CL = lambda w: " UNION ALL ".join(f"SELECT '{a}' AS f1, '{b}' AS f2, corr({a},{b}) AS c FROM lineitem WHERE l_shipdate {w} TIMESTAMP '1998-06-01'" for a, b in combinations(NUM, 2))


@query("quality_correlation_shift", f"WITH b AS ({CL('<')}), c AS ({CL('>=')}) SELECT f1, f2, {R('c.c', 'corr', 6)}, {R('abs(c.c-b.c)', 'change', 6)}, CAST(abs(c.c-b.c)>0.3 AS INTEGER) AS unstable FROM c JOIN b USING (f1, f2)")
def _(s, d):
    b, c = halves(s, d)
    return rcols(Q.correlation_shift(Q.correlation_long(c, NUM), Q.correlation_long(b, NUM)), ["f1", "f2", "unstable"], ["corr", "change"], 6)


@query("quality_collinearity", f"WITH c AS ({CL('<')}), u AS (SELECT f1 AS feature, f2 AS o, c FROM c UNION ALL SELECT f2, f1, c FROM c) SELECT feature, {R('max(abs(c))', 'max_abs_corr', 6)}, arg_max(o, row(abs(c), o)) AS partner, CAST(sum((abs(c)>.5)::INT) AS BIGINT) AS n_high FROM u GROUP BY 1")
def _(s, d):
    return rcols(Q.collinearity(Q.correlation_long(halves(s, d)[0], NUM), .5), ["feature", "partner", "n_high"], ["max_abs_corr"], 6)


@query("quality_scaling_spread", f"WITH l AS ({UNP}), g AS (SELECT feature, stddev_samp(v) AS sd FROM l GROUP BY 1) SELECT feature AS \"column\", {R('sd', 'std', 5)}, {R('sd/(SELECT min(sd) FROM g)', 'spread', 2)} FROM g")
def _(s, d):
    x = Q.scaling_spread(li(s, d), NUM)
    return x.select("column", rd("std", 5).alias("std"), rd("spread", 2).alias("spread"))


@query("quality_encoding", "SELECT count(text) AS n, CAST(sum(contains(text, '�')::INT) AS BIGINT) AS replacement, CAST(sum((length(trim(text, ' '))<>length(text))::INT) AS BIGINT) AS edge_space FROM documents")
def _(s, d):
    return Q.encoding_issues(A.table(s, d, "documents"), "text").select("n", "replacement", "edge_space")


@query("quality_feature_profile", f"WITH l AS ({UNP}), q AS (SELECT feature, quantile_cont(v,.25) AS q1, quantile_cont(v,.75) AS q3 FROM l GROUP BY 1) SELECT feature, count(*) AS n, {R('0', 'missing')}, {R('var_samp(v)', 'variance', 3)}, {R('avg((v NOT BETWEEN q1-1.5*(q3-q1) AND q3+1.5*(q3-q1))::INT)', 'outlier_share', 6)}, CAST(0 AS INTEGER) AS \"constant\" FROM l JOIN q USING (feature) GROUP BY 1")
def _(s, d):
    p = Q.feature_profile(li(s, d), NUM)
    return p.select("feature", "n", rd("missing").alias("missing"), rd("variance", 3).alias("variance"), rd("outlier_share", 6).alias("outlier_share"), "constant")


@query("quality_target_relationship", "WITH c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, corr({c}, l_extendedprice) AS c FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")) + f") SELECT feature, {R('c', 'corr', 6)}, CAST(abs(c)<.01 AS INTEGER) AS weak FROM c")
def _(s, d):
    return rcols(Q.target_relationship(li(s, d), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"), ["feature", "weak"], ["corr"], 6)


@query("quality_trading_feature_rules", f"WITH {BARS} SELECT 'range_price' AS rule, count(*) AS n, CAST(0 AS BIGINT) AS violations FROM bars UNION ALL SELECT 'range_volume', count(*), CAST(0 AS BIGINT) FROM bars")
def _(s, d):
    b = A.daily_bars(s, d).select(F.col("close").alias("price"), "volume")
    return Q.rule_report(b, Q.trading_feature_rules(b.columns)).select("rule", "n", "violations")


U = lambda seed, idc: f"('0x'||substr(md5('{seed}|'||{idc}),1,8))::BIGINT/4294967296.0::DOUBLE"


@query("quality_augmentation", f"SELECT o_orderkey, {R('o_totalprice*(1+0.01*(2*' + U(42, 'o_orderkey') + '-1))*CASE WHEN ' + U(43, 'o_orderkey') + '<0.001 THEN 0.7 WHEN ' + U(43, 'o_orderkey') + '>0.999 THEN 1.3 ELSE 1 END', 'o_totalprice', 3)} FROM orders")
def _(s, d):
    return rcols(Q.augment(A.table(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey"), ["o_orderkey"], ["o_totalprice"], 3)


@query("quality_defect_injection", f"SELECT count(*) AS n, count(v) AS filled, {R('sum(v)/1e6', 'total', 3)} FROM (SELECT CASE WHEN {U(42, 'o_orderkey')}<0.05 THEN NULL WHEN {U(42, 'o_orderkey')}<0.1 THEN o_totalprice*10 ELSE o_totalprice END AS v FROM orders UNION ALL SELECT o_totalprice FROM orders WHERE {U(43, 'o_orderkey')}<0.05)")
def _(s, d):
    x = Q.inject_defects(A.table(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")
    return x.agg(F.count(F.lit(1)).alias("n"), F.count("o_totalprice").alias("filled"), rd(F.sum("o_totalprice") / 1e6, 3).alias("total"))


@query("quality_synthetic_comparison", f"WITH {BARS}, r AS (SELECT *, close/lag(close) OVER (PARTITION BY symbol ORDER BY ts)-1 AS r FROM bars), g AS (SELECT avg(close) AS m, stddev_samp(close) AS s FROM bars), h AS (SELECT avg(close*1.1) AS m, stddev_samp(close*1.1) AS s FROM bars) SELECT CAST(0 AS BIGINT) AS nulls, CAST(0 AS BIGINT) AS bad_prices, {R('(SELECT m FROM h)/(SELECT m FROM g)-1', 'mean_gap', 5)}, {R('(SELECT s FROM h)/(SELECT s FROM g)-1', 'std_gap', 5)}")
def _(s, d):
    b = A.daily_bars(s, d)
    x = b.select("symbol", "ts", *[(F.col(c) * 1.1).alias(c) for c in ("open", "high", "low", "close")], "volume")
    return Q.synthetic_quality(x, b).select("nulls", "bad_prices", rd("mean_gap", 5).alias("mean_gap"), rd("std_gap", 5).alias("std_gap"))
