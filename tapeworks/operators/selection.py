"""Feature selection, importance and sampling."""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.mathx import safe_div
from tapeworks.functions.sampling import hash_uniform
from tapeworks.operators.cleaning import unpivot
from tapeworks.operators.crossasset import contingency_information
from tapeworks.operators.models import assembled
from tapeworks.operators.quality import correlation_long
from tapeworks.plans.orderstats import quantiles
from tapeworks.plans.panel import Panel, join_on, number_rows
from tapeworks.session import ensure_checkpoint_dir


def f_scores(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """Univariate regression F = r^2 / (1 - r^2) (n - 2), all features in one pass."""
    g = df.agg(F.count(target).alias("n"), *[F.corr(c, target).alias(f"r_{c}") for c in cols])
    arr = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"r_{c}").alias("r"), F.col("n").alias("n")) for c in cols])
    d = g.select(F.explode(arr).alias("x")).select("x.*")
    return d.select("feature", "r", (F.col("r") ** 2 / F.nullif(1 - F.col("r") ** 2, F.lit(0.0)) * (F.col("n") - 2)).alias("score"))


def anova_scores(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """One-way ANOVA F per feature over label classes from class sums."""
    long = unpivot(df, cols, [label]).where(F.col("value").isNotNull())
    c = long.groupBy("feature", label).agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    g = c.groupBy("feature").agg(F.sum("n").alias("N"), F.count(F.lit(1)).alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("gm"), F.sum(F.col("n") * F.col("v")).alias("ssw"), F.sum(F.col("n") * F.col("m") ** 2).alias("q"))
    ssb = F.col("q") - F.col("N") * F.col("gm") ** 2
    return g.select("feature", safe_div(ssb / (F.col("k") - 1), F.col("ssw") / (F.col("N") - F.col("k"))).alias("score"))


def top_features(scores: DataFrame, k: int | None = None, percentile: float | None = None, score: str = "score") -> DataFrame:
    """k best, or the best percentile, of a one-row-per-feature table."""
    w = Window.orderBy(F.desc(score), "feature")
    d = scores.withColumn("rank", F.row_number().over(w))
    if percentile is not None:
        n = scores.select(F.count(F.lit(1))).scalar()
        return d.withColumn("_n", n).where(F.col("rank") <= F.ceil(F.col("_n") * percentile / 100)).drop("_n")
    return d.where(F.col("rank") <= (k or 10))


def information_scores(df: DataFrame, cols: Sequence[str], target: str, bins: int = 10) -> DataFrame:
    """Mutual information of quantile-binned features with a discrete target."""
    long = unpivot(df, cols, [target]).where(F.col("value").isNotNull())
    q = quantiles(long, F.col("value"), {f"e{i}": i / bins for i in range(1, bins)}, ["feature"]).select("feature", F.array_distinct(F.array(*[f"e{i}" for i in range(1, bins)])).alias("_e"))
    d = join_on(long, q, ["feature"]).withColumn("bin", F.size(F.filter("_e", lambda e: e < F.col("value"))))
    return contingency_information(d, ["feature"], "bin", target).withColumnRenamed("mi", "score")


def model_importances(df: DataFrame, cols: Sequence[str], target: str, classify: bool = False, trees: int = 50, depth: int = 6, seed: int = 42) -> DataFrame:
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.regression import RandomForestRegressor
    rf = (RandomForestClassifier if classify else RandomForestRegressor)(featuresCol="_x", labelCol=target, numTrees=trees, maxDepth=depth, seed=seed)
    m = Pipeline(stages=[*assembled(cols, "_x"), rf]).fit(df.where(F.col(target).isNotNull()))
    imp = m.stages[-1].featureImportances.toArray()
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(cols, imp)], "feature string, score double")


def correlation_selection(df: DataFrame, cols: Sequence[str], target: str, minimum: float = 0.0, maximum: float = 0.95) -> DataFrame:
    """Keep features correlated with the target; of each pair above ``maximum`` the weaker one goes (anti join)."""
    t = f_scores(df, cols, target).select("feature", F.abs("r").alias("score")).where(F.coalesce(F.col("score"), F.lit(0.0)) >= minimum)
    pr = correlation_long(df, cols).where(F.abs("corr") >= maximum)
    a = pr.join(t.select(F.col("feature").alias("f1"), F.col("score").alias("s1")), "f1").join(t.select(F.col("feature").alias("f2"), F.col("score").alias("s2")), "f2")
    gone = a.select(F.when((F.col("s1") < F.col("s2")) | ((F.col("s1") == F.col("s2")) & (F.col("f1") > F.col("f2"))), F.col("f1")).otherwise(F.col("f2")).alias("feature")).distinct()
    return t.join(gone, "feature", "left_anti")


def vote_selection(scores: DataFrame, methods: int, top_up: int = 10) -> DataFrame:
    """(method, feature, score, selected) votes: keep >= max(2, methods/2), topped up to ``top_up`` by mean score."""
    g = scores.groupBy("feature").agg(F.sum(F.col("selected").cast("bigint")).alias("votes"), F.avg("score").alias("mean_score"))
    need = max(2, methods // 2)
    w = Window.orderBy((F.col("votes") < need).cast("int"), F.desc("mean_score"), "feature")
    d = g.withColumn("rank", F.row_number().over(w))
    return d.withColumn("kept", ((F.col("votes") >= need) | (F.col("rank") <= top_up)).cast("int"))


def permutation_importance(df: DataFrame, score: Column, model, cols: Sequence[str], row_id: str, bucket: Column, seed: int = 42) -> DataFrame:
    """Score change after shuffling one column at a time.

    The shuffle pairs row positions in id order with positions in hashed order: two exact
    distributed numberings joined on position.
    """
    base = model.transform(df).agg(score.alias("s")).scalar()
    out = None
    d = df.withColumn("_one", F.lit(0))
    p = number_rows(d, Panel(("_one",), (row_id,)), bucket, "_pos")
    for i, c in enumerate(cols):
        h = df.select(F.lit(0).alias("_one"), hash_uniform(seed + i, row_id).alias("_h"), row_id, F.col(c).alias("_v"))
        sh = number_rows(h, Panel(("_one",), ("_h", row_id)), F.floor(F.col("_h") * 64), "_pos").select("_pos", "_v")
        x = p.join(sh, "_pos").withColumn(c, F.col("_v")).drop("_v", "_pos", "_one")
        r = model.transform(x).agg(score.alias("permuted")).withColumn("base", base).select(F.lit(c).alias("feature"), (F.col("base") - F.col("permuted")).alias("importance"))
        out = r if out is None else out.unionByName(r)
    return out


def consensus_rank(scores: DataFrame) -> DataFrame:
    """Mean rank, its deviation, coefficient of variation of scores per feature over methods."""
    w = Window.partitionBy("method").orderBy(F.desc("score"))
    r = scores.withColumn("rank", F.rank().over(w))
    return r.groupBy("feature").agg(F.avg("rank").alias("mean_rank"), F.stddev_pop("rank").alias("rank_std"), safe_div(F.stddev_pop("score"), F.abs(F.avg("score"))).alias("cv"))


def method_agreement(scores: DataFrame) -> DataFrame:
    """Spearman correlation between methods' feature scores."""
    w = Window.partitionBy("method").orderBy("score")
    n = Window.partitionBy("method", "score")
    r = scores.withColumn("rk", F.rank().over(w) + (F.count(F.lit(1)).over(n) - 1) / 2)
    a, b = r.select("feature", F.col("method").alias("m1"), F.col("rk").alias("r1")), r.select("feature", F.col("method").alias("m2"), F.col("rk").alias("r2"))
    return a.join(b, "feature").where("m1 < m2").groupBy("m1", "m2").agg(F.corr("r1", "r2").alias("spearman"))


def merge_importances(first: DataFrame, last: DataFrame) -> DataFrame:
    j = first.withColumnRenamed("score", "score_first").join(last.withColumnRenamed("score", "score_last"), "feature")
    return j.withColumn("change", F.col("score_last") - F.col("score_first"))


# -- samples ------------------------------------------------------------------------------

def balanced_sample(df: DataFrame, by: str, per_group: int, row_id: str, seed: int = 42) -> DataFrame:
    """Exactly min(n, per_group) rows per group: smallest hashes. The rank limit is applied before the shuffle."""
    d = df.withColumn("_h", hash_uniform(seed, row_id))
    w = Window.partitionBy(by).orderBy("_h", row_id)
    return d.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= per_group).drop("_h", "_k")


def stratified_sample(df: DataFrame, by: str, fractions: dict, row_id: str, seed: int = 42) -> DataFrame:
    f = F.lit(0.0)
    for k, v in fractions.items():
        f = F.when(F.col(by) == k, v).otherwise(f)
    return df.where(hash_uniform(seed, row_id) < f)


def reservoir(df: DataFrame, k: int, row_id: str, seed: int = 42) -> DataFrame:
    """Uniform fixed-size sample: the k smallest hashes, kept per task before merging."""
    return df.withColumn("_h", hash_uniform(seed, row_id)).orderBy("_h", row_id).limit(k).drop("_h")


def drop_stale(df: DataFrame, ts: str, now: Column, max_age_seconds: int) -> DataFrame:
    return df.where(F.unix_micros(F.col(ts).cast("timestamp")) >= F.unix_micros(now) - max_age_seconds * 1_000_000)


def k_centers(df: DataFrame, row_id: str, vec: str, k: int) -> DataFrame:
    """Greedy coverage: start at the smallest id, then repeatedly add the row farthest from the chosen ones.

    Each round is one pass with a single literal centre; the distance column is checkpointed so lineage stays flat.
    """
    ensure_checkpoint_dir(df.sparkSession)
    d = df.select(row_id, F.col(vec).cast("array<double>").alias("_v")).withColumn("_d", F.lit(float("inf"))).checkpoint()
    chosen = []
    for i in range(k):
        best = d.agg(F.max(F.struct("_d", (-F.col(row_id)).alias("o"), "_v")).alias("m")).select("m.*").first()
        if best is None or best["_d"] is None or best["_d"] == 0:
            break
        chosen.append((-best["o"], i, float(best["_d"]) if math.isfinite(best["_d"]) else None))
        c = F.array(*[F.lit(float(x)) for x in best["_v"]])
        dist = F.sqrt(F.aggregate(F.zip_with("_v", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
        d = d.withColumn("_d", F.least("_d", dist))
        if i % 4 == 3:
            d = d.checkpoint()
    return df.sparkSession.createDataFrame(chosen, f"{row_id} bigint, step int, distance double")
