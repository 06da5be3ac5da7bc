"""Data-quality checks: rule tables and profiles evaluated as single aggregation passes."""
from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.mathx import ratio, safe_div
from tapeworks.operators.cleaning import unpivot
from tapeworks.plans.orderstats import attach_stats, quantiles
from tapeworks.plans.panel import Panel, join_on, running


def _severity(x: Column, mid: float, high: float) -> Column:
    return F.when(x > high, "high").when(x > mid, "medium").when(x > 0, "low").otherwise("none")


def _melt_row(df: DataFrame, cols: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One wide row <field>__<col> to (column, fields...)."""
    arr = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{f}__{c}").alias(f) for f in fields]) for c in cols])
    return df.select(F.explode(arr).alias("x")).select("x.*")


def missing_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Missing share per column (null or NaN) in one pass, with 5 % / 20 % severity."""
    cols = list(cols or df.columns)
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    miss = lambda c: (F.col(c).isNull() | F.isnan(c)) if kinds[c] in ("double", "float") else F.col(c).isNull()
    g = df.agg(*[F.count(F.lit(1)).alias(f"n__{c}") for c in cols], *[F.sum(miss(c).cast("bigint")).alias(f"missing__{c}") for c in cols])
    out = _melt_row(g, cols, ["n", "missing"]).withColumn("share", safe_div(F.col("missing").cast("double"), F.col("n")))
    return out.withColumn("severity", _severity(F.col("share"), .05, .2))


def duplicate_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """n, duplicates beyond the first, share. Rows are grouped on their values; copies combine map-side."""
    cols = list(cols or df.columns)
    g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_k"))
    a = g.agg(F.sum("_k").alias("n"), F.sum(F.col("_k") - 1).alias("duplicates"))
    return a.withColumn("share", safe_div(F.col("duplicates").cast("double"), F.col("n")))


def near_duplicates(df: DataFrame, row_id: str, cols: Sequence[str], threshold: float = 0.95, group_rows: int = 4000) -> DataFrame:
    """Closest other row with cosine similarity of standardized features above the threshold: (row_id, nb, cosine).

    On the unit sphere cosine > t means distance < sqrt(2 - 2t), so rows can only match inside one grid cell of
    that width or a neighbouring cell along the first two coordinates. Identical vectors are collapsed first; a
    crowded cell is split into sub-blocks by its counted size, every sub-block pair meets in one task of bounded
    size, and each task returns only the best partner per row, never the pairs.
    """
    cell = math.sqrt(2 - 2 * threshold)
    st = df.agg(F.struct(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_samp(c).alias(f"s_{c}") for c in cols]).alias("s")).scalar()
    d = df.select(row_id, *cols).withColumn("_s", st)
    z = [safe_div(F.col(c) - F.col("_s")[f"m_{c}"], F.col("_s")[f"s_{c}"]) for c in cols]
    d = d.select(row_id, F.array(*z).alias("_z"))
    norm = F.sqrt(F.aggregate("_z", F.lit(0.0), lambda a, x: a + x * x))
    d = d.withColumn("_n", norm).where(F.col("_n") > 0).select(row_id, F.transform("_z", lambda x: x / F.col("_n")).alias("u"))
    g = d.groupBy("u").agg(F.min(F.col(row_id).cast("bigint")).alias("id1"), F.max(F.col(row_id).cast("bigint")).alias("id2"), F.count(F.lit(1)).alias("k"))
    dims = min(2, len(cols))
    at = [F.floor(F.get("u", F.lit(i)) / cell) for i in (0, dims - 1)]
    steps = [(i, j) for i in (-1, 0, 1) for j in ((-1, 0, 1) if dims == 2 else (0,))]
    left = g.select("u", "id1", at[0].alias("ca"), at[1].alias("cb"))
    right = g.select("u", "id1", F.explode(F.array(*[F.struct((at[0] + i).alias("ca"), (at[1] + j).alias("cb")) for i, j in steps])).alias("c")).select("u", "id1", "c.*")
    size = right.groupBy("ca", "cb").agg(F.ceil(F.count(F.lit(1)) / group_rows).cast("int").alias("parts"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    salt = F.pmod(F.xxhash64("id1"), F.col("parts")).cast("int")
    left = left.join(size, ["ca", "cb"]).withColumn("l", salt).withColumn("r", every)
    size2 = size.select(F.col("ca").alias("na"), F.col("cb").alias("nb_"), F.col("parts").alias("np"))
    right = right.select(F.col("u").alias("v"), F.col("id1").alias("nid"), F.col("ca").alias("na"), F.col("cb").alias("nb_")).join(size2, ["na", "nb_"])
    right = right.withColumn("nr", F.pmod(F.xxhash64("nid"), F.col("np")).cast("int")).withColumn("nl", F.explode(F.sequence(F.lit(0), F.col("np") - 1)))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"id1": pd.Series(dtype="int64"), "other": pd.Series(dtype="int64"), "cos": pd.Series(dtype="float64")})
        x, y, ib = np.stack(a["u"].to_numpy()), np.stack(b["v"].to_numpy()), b["nid"].to_numpy()
        out = []
        for s in range(0, len(x), 512):
            dot = np.zeros((len(x[s:s + 512]), len(y)))
            for j in range(x.shape[1]):
                dot += x[s:s + 512, j:j + 1] * y[:, j]
            ids = a["id1"].to_numpy()[s:s + 512]
            dot[ids[:, None] == ib[None, :]] = -2
            top = dot.max(1)
            first = np.where(dot == top[:, None], ib[None, :], np.iinfo(np.int64).max).min(1)
            ok = top > threshold
            out.append(pd.DataFrame({"id1": ids[ok], "other": first[ok], "cos": top[ok]}))
        return pd.concat(out, ignore_index=True)

    near = left.groupBy("ca", "cb", "l", "r").cogroup(right.groupBy("na", "nb_", "nl", "nr")).applyInPandas(meet, "id1 bigint, other bigint, cos double")
    best = near.groupBy("id1").agg(F.max(F.struct("cos", (-F.col("other")).alias("o"))).alias("m"))
    j = d.join(g, "u").join(best, "id1", "left")
    own = F.col(row_id).cast("bigint")
    twin = F.when(F.col("k") > 1, F.when(own == F.col("id1"), F.col("id2")).otherwise(F.col("id1")))
    return (j.withColumn("nb", F.coalesce(twin, -F.col("m.o"))).where(F.col("nb").isNotNull())
             .select(row_id, "nb", F.when(twin.isNotNull(), 1.0).otherwise(F.col("m.cos")).alias("cosine")))


def type_checks(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Share of text values that read as numbers, and the verdict (numeric, mixed, text)."""
    num = lambda c: F.col(c).try_cast("double").isNotNull().cast("bigint")
    g = df.agg(*[F.count(c).alias(f"n__{c}") for c in cols], *[F.sum(F.when(F.col(c).isNotNull(), num(c))).alias(f"numeric__{c}") for c in cols])
    d = _melt_row(g, cols, ["n", "numeric"]).withColumn("share", safe_div(F.col("numeric").cast("double"), F.col("n")))
    return d.withColumn("kind", F.when(F.col("share") >= .95, "numeric").when(F.col("share") > .05, "mixed").otherwise("text"))


def outlier_share(df: DataFrame, cols: Sequence[str], method: str = "iqr", k: float = 1.5) -> DataFrame:
    long = unpivot(df, cols).where(F.col("value").isNotNull())
    if method == "iqr":
        q = quantiles(long, F.col("value"), {"q1": .25, "q3": .75}, ["feature"])
        b = q.select("feature", (F.col("q1") - k * (F.col("q3") - F.col("q1"))).alias("lo"), (F.col("q3") + k * (F.col("q3") - F.col("q1"))).alias("hi"))
    else:
        b = long.groupBy("feature").agg((F.avg("value") - k * F.stddev_samp("value")).alias("lo"), (F.avg("value") + k * F.stddev_samp("value")).alias("hi"))
    j = join_on(long, b, ["feature"])
    out = ~F.col("value").between(F.col("lo"), F.col("hi"))
    return j.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.sum(out.cast("bigint")).alias("outliers")).withColumn("share", F.col("outliers") / F.col("n"))


def rule_report(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """rule -> violations for boolean Columns (true = violation), one pass. A null condition is no violation."""
    names = list(rules)
    i = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    g = df.agg(*[F.count(F.lit(1)).alias(f"n__{r}") for r in names], *[i(rules[r]).alias(f"violations__{r}") for r in names])
    d = _melt_row(g, names, ["n", "violations"]).withColumnRenamed("column", "rule")
    return d.withColumn("share", safe_div(F.col("violations").cast("double"), F.col("n"))).withColumn("severity", _severity(F.col("share"), .01, .05))


def range_rules(ranges: Mapping[str, tuple]) -> dict[str, Column]:
    out = {}
    for c, (lo, hi) in ranges.items():
        x = F.col(c)
        bad = F.lit(False)
        bad = bad | (x < lo) if lo is not None else bad
        bad = bad | (x > hi) if hi is not None else bad
        out[f"range_{c}"] = bad
    return out


def ohlc_rules(move: float = 0.5) -> dict[str, Column]:
    """High/low ordering, positivity and suspicious moves inside a bar."""
    o, h, l, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    return {"high_low": h < F.greatest(o, c), "low_high": l > F.least(o, c), "positive_price": (F.least(o, h, l, c) <= 0), "negative_volume": v < 0, "zero_volume": v == 0, "suspicious_move": F.abs(c / o - 1) > move}


# Bounds by indicator name
FEATURE_BOUNDS = {"rsi": (0, 100), "stoch": (0, 100), "williams": (-100, 0), "mfi": (0, 100), "bb_pct": (-1, 2), "aroon": (-100, 100), "price": (0, None), "volume": (0, None)}


def trading_feature_rules(cols: Sequence[str]) -> dict[str, Column]:
    """Range rules by column-name prefix."""
    return {k: v for c in cols for n, b in FEATURE_BOUNDS.items() if c.startswith(n) for k, v in range_rules({c: b}).items()}


def temporal_report(df: DataFrame, ts: str, ingest: Sequence[str], bucket: Column, gap_hours: float = 24, keys: Sequence[str] = ()) -> DataFrame:
    """Back-steps and long gaps in ingest order.

    The previous timestamp in ingest order comes from bucket partials plus a carry, so no task orders the whole table.
    """
    from tapeworks.plans.panel import on_chunks
    d = df.withColumn("_g", F.lit(0)) if not keys else df
    p = Panel(tuple(keys) or ("_g",), tuple(ingest))
    fn = lambda x, q: x.withColumn("_prev", F.lag(ts).over(q.w))
    x = on_chunks(d, p, fn, bucket=bucket, before=1)
    gap = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_prev").cast("timestamp"))) / 3.6e9
    return x.withColumn("_d", gap).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("_d") < 0).cast("bigint")).alias("back_steps"), F.sum((F.col("_d") > gap_hours).cast("bigint")).alias("gaps"), F.max("_d").alias("max_gap_hours"))


def constant_features(df: DataFrame, cols: Sequence[str], quasi: float = 0.95) -> DataFrame:
    """Most frequent value and its share per column; counts of (column, value) combine map-side."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in cols])).alias("x")).select("x.*")
    g = long.groupBy("column", "v").agg(F.count(F.lit(1)).alias("k"))
    a = g.groupBy("column").agg(F.sum("k").alias("n"), F.count("v").alias("distinct"), F.max(F.struct("k", "v")).alias("m"))
    d = a.select("column", "n", "distinct", F.col("m.v").alias("mode"), (F.col("m.k") / F.col("n")).alias("share"))
    return d.withColumn("kind", F.when(F.col("share") == 1, "constant").when(F.col("share") > quasi, "quasi_constant").otherwise("varying"))


def baseline_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, n, mean, std, min, max, q25, q50, q75, skew, kurt): what is stored with ``save_baseline``."""
    long = unpivot(df, cols).where(F.col("value").isNotNull() & ~F.isnan("value"))
    m = long.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.skewness("value").alias("skew"), F.kurtosis("value").alias("kurt"))
    return join_on(m, quantiles(long, F.col("value"), {"q25": .25, "q50": .5, "q75": .75}, ["feature"]), ["feature"])


def stability(current: DataFrame, baseline: DataFrame, limit: float = 0.1) -> DataFrame:
    """Relative mean change per feature against stored statistics."""
    j = current.select("feature", "mean").join(baseline.select("feature", F.col("mean").alias("base_mean")), "feature")
    ch = safe_div(F.abs(F.col("mean") - F.col("base_mean")), F.abs("base_mean"))
    return j.withColumn("change", ch).withColumn("unstable", (F.col("change") > limit).cast("int"))


def class_balance(df: DataFrame, label: str, minimum: float = 0.05) -> DataFrame:
    g = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    t = g.agg(F.sum("n")).scalar()
    return g.withColumn("_t", t).select(label, "n", (F.col("n") / F.col("_t")).alias("share"), (F.col("n") / F.col("_t") < minimum).cast("int").alias("rare"))


def correlation_long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(f1, f2, corr) for all column pairs in one pass."""
    from itertools import combinations
    pr = list(combinations(cols, 2))
    g = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pr)])
    arr = F.array(*[F.struct(F.lit(a).alias("f1"), F.lit(b).alias("f2"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pr)])
    return g.select(F.explode(arr).alias("x")).select("x.*")


def correlation_shift(current: DataFrame, baseline: DataFrame, limit: float = 0.3) -> DataFrame:
    j = current.join(baseline.withColumnRenamed("corr", "base_corr"), ["f1", "f2"])
    return j.withColumn("change", F.abs(F.col("corr") - F.col("base_corr"))).withColumn("unstable", (F.col("change") > limit).cast("int"))


def collinearity(corr: DataFrame, high: float = 0.9) -> DataFrame:
    """Largest absolute correlation per feature and how many partners exceed the limit."""
    both = corr.select(F.col("f1").alias("feature"), F.col("f2").alias("other"), "corr").unionByName(corr.select(F.col("f2").alias("feature"), F.col("f1").alias("other"), "corr"))
    return both.groupBy("feature").agg(F.max(F.abs("corr")).alias("max_abs_corr"), F.max_by("other", F.struct(F.abs("corr"), "other")).alias("partner"), F.sum((F.abs("corr") > high).cast("bigint")).alias("n_high"))


def scaling_spread(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Ratio of the largest to the smallest column deviation, per column and overall."""
    s = df.agg(*[F.stddev_samp(c).alias(f"std__{c}") for c in cols])
    d = _melt_row(s, cols, ["std"])
    t = d.agg(F.min(F.when(F.col("std") > 0, F.col("std")))).scalar()
    return d.withColumn("_t", t).select("column", "std", ratio("std", "_t").alias("spread"))


def encoding_issues(df: DataFrame, text: str) -> DataFrame:
    """Replacement characters, control characters, mojibake marks and edge whitespace counts."""
    c = F.col(text)
    i = lambda e: F.sum(e.cast("bigint"))
    return df.agg(F.count(c).alias("n"), i(c.contains("�")).alias("replacement"), i(c.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")).alias("control"), i(c.rlike("Ã[\u0080-¿]|â€")).alias("mojibake"), i((F.length(F.trim(c)) != F.length(c))).alias("edge_space"))


def feature_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """missing share, distinct count, variance, outlier share, constant flag per feature."""
    long = unpivot(df, cols)
    g = long.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("value").isNull().cast("double")).alias("missing"), F.countDistinct("value").alias("distinct"), F.var_samp("value").alias("variance"), F.skewness("value").alias("skew"))
    o = outlier_share(df, cols).select("feature", F.col("share").alias("outlier_share"))
    return join_on(g, o, ["feature"]).withColumn("constant", (F.coalesce(F.col("variance"), F.lit(0.0)) == 0).cast("int"))


def target_relationship(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """Correlation with the target per feature and a weak flag."""
    g = df.agg(*[F.corr(c, target).alias(f"corr__{c}") for c in cols])
    d = _melt_row(g, cols, ["corr"]).withColumnRenamed("column", "feature")
    return d.withColumn("importance", F.abs("corr")).withColumn("weak", (F.coalesce(F.abs("corr"), F.lit(0.0)) < .01).cast("int"))


def quality_score(report: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """100 minus weighted penalties of a (rule, share, severity) report, with a level."""
    w = F.lit(1.0)
    for k, v in (weights or {}).items():
        w = F.when(F.col("rule") == k, v).otherwise(w)
    pen = F.least(F.col("share") * F.when(F.col("severity") == "high", 100.0).when(F.col("severity") == "medium", 60.0).otherwise(30.0), F.lit(100.0))
    g = report.agg(F.count(F.lit(1)).alias("checks"), F.sum((F.col("violations") == 0).cast("bigint")).alias("passed"), safe_div(F.sum(pen * w), F.sum(w)).alias("_p"))
    d = g.select("checks", "passed", (100 - F.col("_p")).alias("score"))
    return d.withColumn("level", F.when(F.col("score") >= 95, "excellent").when(F.col("score") >= 85, "good").when(F.col("score") >= 70, "fair").otherwise("poor"))


def severity_rollup(report: DataFrame) -> DataFrame:
    return report.rollup("severity").agg(F.count(F.lit(1)).alias("checks"), F.sum("violations").alias("violations"))


def augment(df: DataFrame, c: str, row_id: str, noise: float = 0.01, crash_share: float = 0.001, seed: int = 42) -> DataFrame:
    """Multiplicative noise and rare crash / pump rows, drawn by hash of the row id so retries agree."""
    from tapeworks.functions.sampling import hash_uniform
    u, v = hash_uniform(seed, row_id), hash_uniform(seed + 1, row_id)
    shock = F.when(v < crash_share, 0.7).when(v > 1 - crash_share, 1.3).otherwise(1.0)
    return df.withColumn(c, F.col(c) * (1 + noise * (2 * u - 1)) * shock)


def inject_defects(df: DataFrame, c: str, row_id: str, severity: float = 0.05, seed: int = 42) -> DataFrame:
    """Nulls, outliers (x10) and duplicated rows, each at ``severity``."""
    from tapeworks.functions.sampling import hash_uniform
    u = hash_uniform(seed, row_id)
    d = df.withColumn(c, F.when(u < severity, None).when(u < 2 * severity, F.col(c) * 10).otherwise(F.col(c)))
    return d.unionByName(df.where(hash_uniform(seed + 1, row_id) < severity))


def synthetic_bars(spark, symbols: int, steps: int, start: str = "2024-01-01", drift: float = 0.0, vol: float = 0.01, seed: int = 42) -> DataFrame:
    """Geometric-walk OHLCV fixtures: normal steps from hashed uniforms, price by running sum per symbol."""
    from tapeworks.functions.sampling import hash_uniform
    d = spark.range(symbols * steps).select((F.col("id") % symbols).alias("s"), F.floor(F.col("id") / symbols).alias("k"))
    z = F.sqrt(-2 * F.ln(hash_uniform(seed, "s", "k") * 0.999999 + 5e-7)) * F.cos(2 * math.pi * hash_uniform(seed + 1, "s", "k"))
    d = d.select(F.concat(F.lit("S"), F.col("s")).alias("symbol"), (F.lit(start).cast("timestamp") + F.make_interval(hours=F.col("k"))).alias("ts"), (drift + vol * z).alias("_r"), hash_uniform(seed + 2, "s", "k").alias("_u"))
    p = Panel()
    d = d.withColumn("close", 100 * F.exp(F.sum("_r").over(p.cum)))
    d = d.withColumn("open", F.coalesce(F.lag("close").over(p.w), F.lit(100.0)))
    top, bot = F.greatest("open", "close"), F.least("open", "close")
    return d.select("symbol", "ts", "open", (top * (1 + vol * F.col("_u"))).alias("high"), (bot * (1 - vol * (1 - F.col("_u")))).alias("low"), "close", (1000 * (0.5 + F.col("_u"))).alias("volume"))


def synthetic_quality(synth: DataFrame, ref: DataFrame, c: str = "close", p: Panel = Panel()) -> DataFrame:
    """Nulls, bad prices and OHLC violations of generated bars plus mean / deviation / return gaps to a reference."""
    stat = lambda d: d.withColumn("_r", ratio(F.col(c), F.lag(c).over(p.w)) - 1).agg(F.avg(c).alias("m"), F.stddev_samp(c).alias("s"), F.avg("_r").alias("rm"), F.stddev_samp("_r").alias("rs"))
    bad = synth.agg(F.sum(F.col(c).isNull().cast("bigint")).alias("nulls"), F.sum((F.col(c) <= 0).cast("bigint")).alias("bad_prices"), F.sum(((F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close"))).cast("bigint")).alias("bad_ohlc"))
    a, b = stat(synth).select(F.struct("*").alias("x")).scalar(), stat(ref).select(F.struct("*").alias("x")).scalar()
    d = bad.withColumn("_a", a).withColumn("_b", b)
    g = lambda k: safe_div(F.abs(F.col(f"_a.{k}") - F.col(f"_b.{k}")), F.abs(F.col(f"_b.{k}")))
    return d.select("nulls", "bad_prices", "bad_ohlc", g("m").alias("mean_gap"), g("s").alias("std_gap"), F.abs(F.col("_a.rm") - F.col("_b.rm")).alias("return_gap"), g("rs").alias("return_std_gap"))
