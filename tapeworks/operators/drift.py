"""Distribution drift between a baseline and a current table, all features at once in long form.

The two samples are tagged and collapsed to distinct values; one cumulative-count table per
feature (see ``plans.orderstats``) then yields KS, Wasserstein and rank-sum together.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.mathx import chi2_sf_any, ks_p, safe_div, two_sided_p
from tapeworks.operators.cleaning import unpivot
from tapeworks.operators.models import assembled
from tapeworks.plans.orderstats import attach_stats, cumulative_counts, quantiles
from tapeworks.plans.panel import join_on


def _both(base: DataFrame, cur: DataFrame, cols: Sequence[str]) -> DataFrame:
    t = unpivot(base, cols).withColumn("_w", F.lit(0)).unionByName(unpivot(cur, cols).withColumn("_w", F.lit(1)))
    return t.where(F.col("value").isNotNull() & ~F.isnan("value"))


def ecdf_drift(base: DataFrame, cur: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per feature: n_base, n_cur, ks and its p, wasserstein (also over baseline range), Mann-Whitney u, z and p (tie-corrected)."""
    c = cumulative_counts(_both(base, cur, cols), F.col("value"), ["feature"],
                          {"b": (F.col("_w") == 0).cast("bigint"), "c": (F.col("_w") == 1).cast("bigint")})
    fb, fc = F.col("cum_b") / F.col("tot_b"), F.col("cum_c") / F.col("tot_c")
    c = c.withColumn("_f", F.abs(fb - fc))
    # gap to the next distinct value: inside a block by lead, across blocks by the next block's first value
    inside = Window.partitionBy("feature", "_blk").orderBy("_v")
    heads = c.groupBy("feature", "_blk").agg(F.min("_v").alias("_first"))
    nxt = heads.select("feature", "_blk", F.lead("_first").over(Window.partitionBy("feature").orderBy("_blk")).alias("_nf"))
    c = join_on(c, nxt, ["feature", "_blk"]).withColumn("_next", F.coalesce(F.lead("_v").over(inside), F.col("_nf")))
    k = F.col("b") + F.col("c")
    upto = F.col("cum_b") + F.col("cum_c")
    rank = upto - (k - 1) / 2
    g = c.groupBy("feature").agg(F.max("tot_b").alias("n_base"), F.max("tot_c").alias("n_cur"), F.max("_f").alias("ks"), F.sum(F.col("_f") * (F.col("_next") - F.col("_v"))).alias("wasserstein"),
                                 (F.max(F.when(F.col("b") > 0, F.col("_v"))) - F.min(F.when(F.col("b") > 0, F.col("_v")))).alias("_rg"), F.sum(F.col("c") * rank).alias("_rs"), F.sum(k.cast("double") ** 3 - k).alias("_ties"))
    n1, n2 = F.col("n_cur").cast("double"), F.col("n_base").cast("double")
    n = n1 + n2
    u = F.col("_rs") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("_ties") / (n * (n - 1))))
    return g.select("feature", "n_base", "n_cur", "ks", ks_p("ks", "n_base", "n_cur").alias("ks_p"), "wasserstein", safe_div("wasserstein", "_rg").alias("wasserstein_scaled"), u.alias("u"), safe_div(u - n1 * n2 / 2, sd).alias("u_z"),
                    two_sided_p(safe_div(u - n1 * n2 / 2, sd)).alias("u_p"))


def psi(base: DataFrame, cur: DataFrame, cols: Sequence[str], bins: int = 10, floor: float = 1e-10) -> DataFrame:
    """Population stability index over baseline quantile bins; level at .1 / .2 / .25."""
    long = _both(base, cur, cols)
    q = quantiles(long.where("_w = 0"), F.col("value"), {f"e{i}": i / bins for i in range(1, bins)}, ["feature"]).select("feature", F.array_distinct(F.array(*[f"e{i}" for i in range(1, bins)])).alias("_e"))
    d = join_on(long, q, ["feature"]).withColumn("bin", F.size(F.filter("_e", lambda e: e < F.col("value"))))
    return _divergence(d, lambda p, q_: (q_ - p) * F.ln(q_ / p), floor, "psi").withColumn("level", F.when(F.col("psi") >= .25, "high").when(F.col("psi") >= .2, "medium").when(F.col("psi") >= .1, "low").otherwise("none"))


def _divergence(d: DataFrame, term, floor: float, name: str) -> DataFrame:
    g = d.groupBy("feature", "bin").agg(F.sum((F.col("_w") == 0).cast("bigint")).alias("_b"), F.sum((F.col("_w") == 1).cast("bigint")).alias("_c"))
    w = Window.partitionBy("feature")
    p = F.greatest(F.col("_b") / F.sum("_b").over(w), F.lit(floor))
    q = F.greatest(F.col("_c") / F.sum("_c").over(w), F.lit(floor))
    g = g.withColumn("_p", p).withColumn("_q", q)
    return g.groupBy("feature").agg(F.sum(term(F.col("_p"), F.col("_q"))).alias(name))


def jensen_shannon(base: DataFrame, cur: DataFrame, cols: Sequence[str], bins: int = 49) -> DataFrame:
    """Square root of the Jensen-Shannon divergence over equal bins of the pooled range."""
    long = _both(base, cur, cols)
    mm = long.groupBy("feature").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    d = join_on(long, mm, ["feature"]).withColumn("bin", F.least(F.floor(safe_div((F.col("value") - F.col("_lo")) * bins, F.col("_hi") - F.col("_lo"))), F.lit(bins - 1)))
    half = lambda p, q: 0.5 * (F.when(p > 0, p * F.ln(F.when(p > 0, 2 * p / (p + q)))).otherwise(0.0) + F.when(q > 0, q * F.ln(F.when(q > 0, 2 * q / (p + q)))).otherwise(0.0))
    return _divergence(d, half, 0.0, "_js").select("feature", F.sqrt(F.greatest("_js", F.lit(0.0))).alias("js")).withColumn("drifted", (F.col("js") > .1).cast("int"))


def chi_square(base: DataFrame, cur: DataFrame, col: str) -> DataFrame:
    """Current counts against baseline shares. Categories absent from the baseline get half a count."""
    b = base.groupBy(col).agg(F.count(F.lit(1)).alias("_b"))
    c = cur.groupBy(col).agg(F.count(F.lit(1)).alias("_c"))
    j = join_full(b, c, col).fillna(0, ["_b", "_c"])
    tot = j.agg(F.struct(F.sum("_b").alias("b"), F.sum("_c").alias("c")).alias("t")).scalar()
    j = j.withColumn("_t", tot).withColumn("_e", F.greatest(F.col("_b"), F.lit(0.5)) / F.col("_t.b") * F.col("_t.c"))
    g = j.agg(F.sum((F.col("_c") - F.col("_e")) ** 2 / F.col("_e")).alias("chi2"), (F.count(F.lit(1)) - 1).cast("int").alias("dof"))
    return g.withColumn("p", chi2_sf_any("chi2", "dof"))


def join_full(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    r = b.withColumnRenamed(col, "_k2")
    return a.join(r, a[col].eqNullSafe(r["_k2"]), "full").select(F.coalesce(F.col(col), F.col("_k2")).alias(col), *[c for c in a.columns + b.columns if c != col])


def statistic_distance(cur: DataFrame, base: DataFrame) -> DataFrame:
    """Mean relative change of mean, std and quartiles between two statistics tables (see ``quality.baseline_stats``)."""
    f = ("mean", "std", "q25", "q50", "q75")
    j = cur.select("feature", *f).join(base.select("feature", *[F.col(c).alias(f"_{c}") for c in f]), "feature")
    ch = [F.abs(F.col(c) - F.col(f"_{c}")) / F.greatest(F.abs(F.col(f"_{c}")), F.lit(1e-10)) for c in f]
    return j.select("feature", (sum(ch[1:], ch[0]) / len(f)).alias("distance")).withColumn("drifted", (F.col("distance") > .1).cast("int"))


def adversarial(base: DataFrame, cur: DataFrame, cols: Sequence[str], seed: int = 42) -> DataFrame:
    """AUC of a logistic model telling old rows from new ones; about .5 without drift."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import StandardScaler
    d = base.select(*cols, F.lit(0.0).alias("label")).unionByName(cur.select(*cols, F.lit(1.0).alias("label")))
    st = [*assembled(cols, "_v"), StandardScaler(inputCol="_v", outputCol="features"), LogisticRegression(maxIter=20, regParam=1e-4)]
    m = Pipeline(stages=st).fit(d)
    auc = BinaryClassificationEvaluator().evaluate(m.transform(d))
    return base.sparkSession.createDataFrame([(float(auc), int(auc > .6))], "auc double, drifted int")


def concept_drift(metrics: DataFrame, keys: Sequence[str] = (), limit: float = 0.05) -> DataFrame:
    """Relative drop of a window metric against the mean of earlier windows; (keys, window, value) is a short table."""
    w = Window.partitionBy(*keys, F.lit(0)).orderBy("window")
    d = metrics.withColumn("previous", F.avg("value").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return d.withColumn("drop", safe_div(F.col("previous") - F.col("value"), F.abs("previous"), None)).withColumn("drifted", F.coalesce(F.col("drop") > limit, F.lit(False)).cast("int"))


def verdict(results: DataFrame) -> DataFrame:
    """Overall share of drifted features from (feature, drifted) rows and a severity."""
    g = results.groupBy("feature").agg(F.max("drifted").alias("_d"))
    a = g.agg(F.count(F.lit(1)).alias("features"), F.sum("_d").cast("bigint").alias("drifted"), F.avg(F.col("_d").cast("double")).alias("share"))
    return a.withColumn("severity", F.when(F.col("share") > .5, "high").when(F.col("share") > .2, "medium").when(F.col("share") > 0, "low").otherwise("none"))
