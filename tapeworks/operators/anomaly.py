"""Outlier detectors: fit statistics with aggregates, score rows with a projection.

Global statistics enter as scalar subqueries, keyed ones by an equi join; medians and
quartiles come from the distributed cumulative counts, so no detector sorts a key in one task.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.mathx import ratio, safe_div, student_t_quantile
from tapeworks.functions.sampling import hash_uniform
from tapeworks.operators.cleaning import unpivot
from tapeworks.plans.orderstats import attach_stats, median_mad, quantiles
from tapeworks.plans.panel import Panel, join_on

PANEL = Panel()


def _flag(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False)).cast("int")


def zscore(df: DataFrame, c: str, threshold: float = 3.0, keys: Sequence[str] = (), robust: bool = False, side: str = "both") -> DataFrame:
    """Adds score and label; robust uses median and scaled MAD."""
    if robust:
        s = median_mad(df, F.col(c), keys).select(*keys, F.col("med").alias("_m"), F.col("mad").alias("_s"))
    else:
        s = df.groupBy(*keys).agg(F.avg(c).alias("_m"), F.stddev_samp(c).alias("_s"))
    d = attach_stats(df, s, keys, ["_m", "_s"])
    z = safe_div(F.col(c) - F.col("_m"), F.col("_s"))
    score = F.abs(z) if side == "both" else z if side == "upper" else -z
    return d.withColumn("score", score).withColumn("label", _flag(F.col("score") > threshold)).drop("_m", "_s")


def rolling_zscore(df: DataFrame, c: str, n: int = 50, threshold: float = 3.0, p: Panel = PANEL) -> DataFrame:
    """Statistics of the previous n rows, current row excluded."""
    w = p.prior(n)
    z = safe_div(F.abs(F.col(c) - F.avg(c).over(w)), F.stddev_samp(c).over(w))
    return df.withColumn("score", F.when(F.count(c).over(w) == n, z)).withColumn("label", _flag(F.col("score") > threshold))


def mad_score(df: DataFrame, c: str, threshold: float = 3.5, keys: Sequence[str] = (), legacy_scale: bool = False) -> DataFrame:
    """Modified z-score 0.6745 (x - median) / MAD; ``legacy_scale`` divides by 1.4826 MAD as well."""
    s = median_mad(df, F.col(c), keys, 1.4826 if legacy_scale else 1.0)
    d = attach_stats(df, s, keys, ["med", "mad"])
    z = F.abs(safe_div(0.6745 * (F.col(c) - F.col("med")), F.col("mad")))
    return d.withColumn("score", z).withColumn("label", _flag(F.col("score") > threshold)).drop("med", "mad")


def _array_median(a: Column, n: int) -> Column:
    s = F.array_sort(a)
    return (F.element_at(s, (n + 1) // 2) + F.element_at(s, n // 2 + 1)) / 2


def rolling_mad(df: DataFrame, c: str, n: int = 21, threshold: float = 3.5, p: Panel = PANEL) -> DataFrame:
    d = df.withColumn("_l", F.collect_list(c).over(p.prior(n)))
    d = d.withColumn("_m", F.when(F.size("_l") == n, _array_median(F.col("_l"), n)))
    d = d.withColumn("_mad", F.when(F.size("_l") == n, _array_median(F.transform("_l", lambda x: F.abs(x - F.col("_m"))), n)))
    z = F.when(F.col("_mad").isNotNull(), F.abs(safe_div(0.6745 * (F.col(c) - F.col("_m")), F.col("_mad"))))
    return d.withColumn("score", z).withColumn("label", _flag(F.col("score") > threshold)).drop("_l", "_m", "_mad")


def fences(df: DataFrame, c: str, keys: Sequence[str] = (), k: float = 1.5) -> DataFrame:
    q = quantiles(df, F.col(c), {"q1": .25, "med": .5, "q3": .75}, keys)
    iqr = F.col("q3") - F.col("q1")
    return q.withColumn("iqr", iqr).withColumn("lower", F.col("q1") - k * iqr).withColumn("upper", F.col("q3") + k * iqr)


def iqr_score(df: DataFrame, c: str, k: float = 1.5, keys: Sequence[str] = ()) -> DataFrame:
    """Distance beyond the fence in IQR units."""
    d = attach_stats(df, fences(df, c, keys, k), keys, ["lower", "upper", "iqr"])
    dist = F.greatest(F.col("lower") - F.col(c), F.col(c) - F.col("upper"), F.lit(0.0))
    return d.withColumn("score", safe_div(dist, F.col("iqr"))).withColumn("label", _flag(dist > 0)).drop("lower", "upper", "iqr")


def rolling_iqr(df: DataFrame, c: str, n: int = 20, k: float = 1.5, p: Panel = PANEL) -> DataFrame:
    q = F.when(F.count(c).over(p.prior(n)) == n, F.percentile(c, F.array(F.lit(.25), F.lit(.75))).over(p.prior(n)))
    d = df.withColumn("_q", q)
    iqr = F.col("_q")[1] - F.col("_q")[0]
    out = (F.col(c) < F.col("_q")[0] - k * iqr) | (F.col(c) > F.col("_q")[1] + k * iqr)
    return d.withColumn("label", _flag(out)).drop("_q")


def tukey(df: DataFrame, c: str, keys: Sequence[str] = (), inner: float = 1.5, outer: float = 3.0) -> DataFrame:
    """severity: normal, mild (past inner fence), extreme (past outer fence)."""
    d = attach_stats(df, fences(df, c, keys), keys, ["q1", "q3", "iqr"])
    past = lambda m: (F.col(c) < F.col("q1") - m * F.col("iqr")) | (F.col(c) > F.col("q3") + m * F.col("iqr"))
    return d.withColumn("severity", F.when(past(outer), "extreme").when(past(inner), "mild").otherwise("normal")).drop("q1", "q3", "iqr")


def boxplot(df: DataFrame, cols: Sequence[str], k: float = 1.5) -> DataFrame:
    """Quartiles, fences, whiskers (extreme values inside the fences) and outlier counts per feature."""
    long = unpivot(df, cols).where(F.col("value").isNotNull())
    f = fences(long, "value", ["feature"], k)
    d = attach_stats(long, f, ["feature"], ["lower", "upper"])
    inside = F.col("value").between(F.col("lower"), F.col("upper"))
    w = d.groupBy("feature").agg(F.min(F.when(inside, F.col("value"))).alias("whisker_low"), F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
                                 F.sum((~inside).cast("bigint")).alias("n_outliers"))
    return join_on(f, w, ["feature"])


def grubbs(df: DataFrame, c: str, key: str, alpha: float = 0.05) -> DataFrame:
    """Iterated two-sided Grubbs test per key; returns removed rows (key, value, step, g).

    At most n/10 removals are allowed, and every removal is an extreme of what is left, so the
    walk only needs n, sum, sum of squares and the extremes. Extremes come off in waves: each
    wave ranks ``wave`` candidates per tail (rank limit pushed below the shuffle) and the walk
    continues only for keys that used them all.
    """
    stats = df.where(F.col(c).isNotNull()).groupBy(key).agg(F.count(c).alias("_n"), F.avg(c).alias("_mu"), F.var_samp(c).alias("_v"))
    wave = 64
    base = df.where(F.col(c).isNotNull()).select(key, F.col(c).cast("double").alias("value"))
    schema = f"{key} {df.schema[key].dataType.simpleString()}, value double, step int, g double, more boolean"

    def walk_factory(limit):
        def walk(pdf: pd.DataFrame) -> pd.DataFrame:
            n, mu, var = float(pdf["_n"].iloc[0]), pdf["_mu"].iloc[0], pdf["_v"].iloc[0]
            total, left = int(n), int(n // 10)
            low = np.sort(pdf.loc[pdf["_side"] == 0, "value"].to_numpy())
            high = np.sort(pdf.loc[pdf["_side"] == 1, "value"].to_numpy())[::-1]
            i = j = step = 0
            ss = var * (n - 1)
            removed, more = [], False
            while left > 0 and n > 2:
                if i >= len(low) or j >= len(high):
                    more = limit < total
                    break
                if i + j >= total:
                    break
                sd = math.sqrt(max(ss / (n - 1), 0.0))
                if sd == 0:
                    break
                take_low = mu - low[i] > high[j] - mu
                v = low[i] if take_low else high[j]
                g = abs(v - mu) / sd
                t = student_t_quantile(1 - alpha / (2 * n), n - 2)
                if g <= (n - 1) / math.sqrt(n) * math.sqrt(t * t / (n - 2 + t * t)):
                    break
                step += 1
                removed.append((v, step, g))
                new_mu = (n * mu - v) / (n - 1)
                ss -= (v - mu) * (v - new_mu)
                mu, n, left = new_mu, n - 1, left - 1
                i, j = (i + 1, j) if take_low else (i, j + 1)
            rows = pd.DataFrame(removed, columns=["value", "step", "g"])
            if more:
                rows = pd.DataFrame([(None, 0, None)], columns=["value", "step", "g"])
            rows[key], rows["more"] = pdf[key].iloc[0], more
            return rows[[key, "value", "step", "g", "more"]]
        return walk

    done, todo = None, base
    while True:
        lo = todo.withColumn("_rk", F.row_number().over(Window.partitionBy(key).orderBy("value"))).where(F.col("_rk") <= wave).withColumn("_side", F.lit(0))
        hi = todo.withColumn("_rk", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("value")))).where(F.col("_rk") <= wave).withColumn("_side", F.lit(1))
        cand = join_on(lo.unionByName(hi), stats, [key])
        res = cand.groupBy(key).applyInPandas(walk_factory(wave), schema).persist()
        part = res.where(~F.col("more")).drop("more")
        done = part if done is None else done.unionByName(part)
        again = res.where("more").select(key)
        if again.isEmpty():
            return done.where(F.col("step") > 0)
        todo, wave = base.join(again, key, "left_semi"), wave * 16


# Dixon critical values at 95 % for n = 3..30 (fixed values)
DIXON_95 = (0.970, 0.829, 0.710, 0.625, 0.568, 0.526, 0.493, 0.466, 0.444, 0.426, 0.410, 0.396, 0.384, 0.374,
            0.365, 0.356, 0.349, 0.342, 0.337, 0.331, 0.326, 0.321, 0.317, 0.312, 0.308, 0.305, 0.301, 0.290)


def dixon(df: DataFrame, c: str, keys: Sequence[str]) -> DataFrame:
    """Dixon ratio of the lowest and highest value of each small group (3..30 rows); r10 up to 10 rows, then r11.

    Only four order statistics per tail are needed: they merge as bounded sorted arrays.
    """
    k = list(keys)
    x = F.col(c)
    up, dn = Window.partitionBy(*k).orderBy(x), Window.partitionBy(*k).orderBy(x.desc())
    base = df.where(x.isNotNull())
    pick = lambda w, m: base.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 3).groupBy(*k).agg(F.array_sort(F.collect_list(x)).alias(m))
    n = base.groupBy(*k).agg(F.count(x).alias("n"))
    d = join_on(join_on(n, pick(up, "_a"), k), pick(dn, "_b"), k).where(F.col("n").between(3, 30))
    a1, a2 = F.get("_a", F.lit(0)), F.get("_a", F.lit(1))
    b1, b2 = F.element_at("_b", -1), F.element_at("_b", -2)
    r11 = F.col("n") > 10
    ql = safe_div(a2 - a1, F.when(r11, b2 - a1).otherwise(b1 - a1))
    qh = safe_div(b1 - b2, F.when(r11, b1 - a2).otherwise(b1 - a1))
    crit = F.element_at(F.array(*[F.lit(v) for v in DIXON_95]), (F.col("n") - 2).cast("int"))
    return (d.withColumn("q_low", ql).withColumn("q_high", qh).withColumn("critical", crit)
             .select(*k, "n", "q_low", "q_high", "critical", a1.alias("low"), b1.alias("high"),
                     _flag(F.col("q_low") > F.col("critical")).alias("low_outlier"), _flag(F.col("q_high") > F.col("critical")).alias("high_outlier")))


def auto_threshold(scored: DataFrame, contamination: float = 0.05, floor: float = 2.0, score: str = "score") -> DataFrame:
    """One row: the (1-contamination) quantile of absolute scores, not below the floor."""
    q = quantiles(scored, F.abs(F.col(score)), {"threshold": 1 - contamination})
    return q.select(F.greatest(F.col("threshold"), F.lit(floor)).alias("threshold"))


def auto_iqr_multiplier(df: DataFrame, c: str, contamination: float = 0.05, candidates: Sequence[float] = (1, 1.5, 2, 2.5, 3)) -> DataFrame:
    """The fence multiplier whose outlier rate is closest to the target; one pass counts all candidates."""
    d = attach_stats(df.select(c), fences(df, c), [], ["q1", "q3", "iqr"])
    x = F.col(c)
    rates = [F.avg(((x < F.col("q1") - k * F.col("iqr")) | (x > F.col("q3") + k * F.col("iqr"))).cast("double")).alias(f"r{i}") for i, k in enumerate(candidates)]
    a = d.agg(*rates)
    s = F.array_min(F.array(*[F.struct(F.abs(F.col(f"r{i}") - contamination).alias("gap"), F.lit(float(k)).alias("k"), F.col(f"r{i}").alias("rate")) for i, k in enumerate(candidates)]))
    return a.select(s["k"].alias("k"), s["rate"].alias("rate"))


def detector_report(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("bigint").alias("n_anomalies"), F.avg(F.col("label").cast("double")).alias("rate"),
                                     F.max("score").alias("max_score"), F.avg("score").alias("mean_score"))


def detect(df: DataFrame, c: str, method: str = "zscore", keys: Sequence[str] = (), threshold: float | None = None) -> DataFrame:
    t = {} if threshold is None else {"k" if method == "iqr" else "threshold": threshold}
    return {"zscore": zscore, "iqr": iqr_score, "mad": mad_score}[method](df, c, keys=keys, **t)


def multi_feature_zscore(df: DataFrame, cols: Sequence[str], threshold: float = 3.0) -> DataFrame:
    """Score is the largest absolute z-score over the features."""
    st = df.agg(F.struct(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_samp(c).alias(f"s_{c}") for c in cols]).alias("s")).scalar()
    d = df.withColumn("_s", st)
    zs = [F.abs(safe_div(F.col(c) - F.col("_s")[f"m_{c}"], F.col("_s")[f"s_{c}"])) for c in cols]
    score = F.greatest(*zs) if len(zs) > 1 else zs[0]
    return d.withColumn("score", score).withColumn("label", _flag(F.col("score") > threshold)).drop("_s")


# -- isolation forest ---------------------------------------------------------------------

TREE_SCHEMA = "tree int, node int, feature int, cut double, below int, above int, depth_add double"


def _c_factor(n: float) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def fit_isolation_forest(df: DataFrame, cols: Sequence[str], row_id: str, trees: int = 200, sample: int = 256, seed: int = 42) -> DataFrame:
    """Node table of ``trees`` isolation trees.

    Rows are drawn by a hash of their id (repeatable under retries) at a rate that gives each tree
    about ``sample`` rows; each tree is then grown in its own group. The node table has at most
    2 * sample * trees rows, whatever the input size.
    """
    n = df.count()
    rate = min(1.0, 1.5 * sample * trees / max(n, 1))
    d = df.select(row_id, *cols).where(hash_uniform(seed, row_id) < rate)
    reps = max(1, math.ceil(sample * trees / max(n, 1)))
    picks = F.transform(F.sequence(F.lit(0), F.lit(reps - 1)), lambda r: F.pmod(F.xxhash64(F.col(row_id), r, F.lit(seed)), F.lit(trees)).cast("int"))
    d = d.withColumn("tree", F.explode(picks)).withColumn("_o", hash_uniform(seed + 1, row_id, "tree"))
    cols = list(cols)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_o", row_id]).head(sample)
        x, t = pdf[cols].to_numpy(dtype=float), int(pdf["tree"].iloc[0])
        rng = np.random.default_rng(seed * 1_000_003 + t)
        limit = math.ceil(math.log2(max(len(x), 2)))
        nodes, stack = [], [(0, np.arange(len(x)), 0)]
        next_id = 1
        while stack:
            node, idx, depth = stack.pop()
            spread = x[idx].max(0) - x[idx].min(0) if len(idx) else np.zeros(len(cols))
            usable = np.flatnonzero(spread > 0)
            if depth >= limit or len(idx) <= 1 or len(usable) == 0:
                nodes.append((t, node, -1, 0.0, -1, -1, depth + _c_factor(len(idx))))
                continue
            f = int(rng.choice(usable))
            lo, hi = x[idx, f].min(), x[idx, f].max()
            cut = float(rng.uniform(lo, hi))
            mask = x[idx, f] < cut
            nodes.append((t, node, f, cut, next_id, next_id + 1, 0.0))
            stack += [(next_id, idx[mask], depth + 1), (next_id + 1, idx[~mask], depth + 1)]
            next_id += 2
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "cut", "below", "above", "depth_add"])

    return d.groupBy("tree").applyInPandas(grow, TREE_SCHEMA)


def score_isolation_forest(df: DataFrame, nodes: DataFrame, cols: Sequence[str], sample: int = 256) -> DataFrame:
    """Adds score in (0,1): 2^(-mean path / c(sample)). The node table is size-checked before it is shipped."""
    pdf = nodes.orderBy("tree", "node").limit(2_000_001).toPandas()
    if len(pdf) > 2_000_000:
        raise ValueError("node table too large to ship; fit fewer trees or a smaller sample")
    forest = [(g["feature"].to_numpy(), g["cut"].to_numpy(), g["below"].to_numpy(), g["above"].to_numpy(), g["depth_add"].to_numpy())
              for _, g in pdf.groupby("tree")]
    shared = df.sparkSession.sparkContext.broadcast(forest)
    norm = _c_factor(sample)

    @F.pandas_udf("double")
    def path_score(*series: pd.Series) -> pd.Series:
        x = np.column_stack([s.to_numpy(dtype=float) for s in series])
        rows, total = np.arange(len(x)), np.zeros(len(x))
        for feature, cut, below, above, add in shared.value:
            at = np.zeros(len(x), dtype=int)
            while True:
                f = feature[at]
                live = f >= 0
                if not live.any():
                    break
                v = x[rows[live], f[live]]
                at[live] = np.where(v < cut[at[live]], below[at[live]], above[at[live]])
            total += add[at]
        return pd.Series(np.power(2.0, -(total / len(shared.value)) / norm))

    return df.withColumn("score", path_score(*[F.col(c) for c in cols]))


def isolation_forest(df: DataFrame, cols: Sequence[str], row_id: str, contamination: float = 0.05, trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    clean = df.dropna(subset=list(cols))
    nodes = fit_isolation_forest(clean, cols, row_id, trees, sample, seed)
    scored = score_isolation_forest(clean, nodes, cols, sample)
    cut = scored.select(F.percentile_approx("score", 1 - contamination, 10000)).scalar()
    return scored.withColumn("label", _flag(F.col("score") > cut))


# -- local outlier factor -----------------------------------------------------------------

def nearest_neighbours(df: DataFrame, row_id: str, vec: str, k: int, blocks: int = 8) -> DataFrame:
    """Exact k nearest neighbours (row_id, nb, dist, rank) by blocks.

    Rows are hashed into ``blocks``; each (query block, reference block) meets in one cogrouped
    task of about 2 n / blocks rows which returns only k rows per query. Raise ``blocks`` with n.
    """
    d = df.select(F.col(row_id).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("v")).withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    q = d.select("id", "v", F.col("b").alias("qb"), every.alias("rb"))
    r = d.select("id", "v", every.alias("qb"), F.col("b").alias("rb"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"id": pd.Series(dtype="int64"), "nb": pd.Series(dtype="int64"), "dist": pd.Series(dtype="float64")})
        a, b = np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy())
        ida, idb = left["id"].to_numpy(), right["id"].to_numpy()
        parts = []
        for s in range(0, len(a), 512):
            block = a[s:s + 512]
            d2 = np.zeros((len(block), len(b)))
            for j in range(a.shape[1]):
                d2 += (block[:, j:j + 1] - b[:, j]) ** 2
            d2[ida[s:s + 512, None] == idb[None, :]] = np.inf
            m = min(k, d2.shape[1])
            top = np.argpartition(d2, m - 1, axis=1)[:, :m]
            # keep every tie of the m-th distance so the merge can break ties by id
            kth = np.take_along_axis(d2, top, 1).max(1)
            qi, ri = np.nonzero((d2 <= kth[:, None]) & np.isfinite(d2))
            parts.append(pd.DataFrame({"id": ida[s:s + 512][qi], "nb": idb[ri], "dist": np.sqrt(d2[qi, ri])}))
        return pd.concat(parts, ignore_index=True)

    near = q.groupBy("qb", "rb").cogroup(r.groupBy("qb", "rb")).applyInPandas(meet, "id bigint, nb bigint, dist double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("dist", "nb"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def local_outlier_factor(df: DataFrame, row_id: str, vec: str, k: int = 20, blocks: int = 8) -> DataFrame:
    """(row_id, lof): neighbours, k-distance, reachability density, then the density ratio."""
    nn = nearest_neighbours(df, row_id, vec, k, blocks)
    kd = nn.groupBy("id").agg(F.max("dist").alias("kd"))
    reach = nn.join(kd.select(F.col("id").alias("nb"), "kd"), "nb").select("id", "nb", F.greatest("dist", "kd").alias("reach"))
    lrd = reach.groupBy("id").agg((1 / F.greatest(F.avg("reach"), F.lit(1e-10))).alias("lrd"))
    out = (reach.join(lrd.select(F.col("id").alias("nb"), F.col("lrd").alias("nlrd")), "nb").groupBy("id").agg(F.avg("nlrd").alias("m"))
                .join(lrd, "id").select(F.col("id").alias(row_id), (F.col("m") / F.col("lrd")).alias("lof")))
    return out
