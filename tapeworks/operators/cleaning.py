"""Cleaning, filling, alignment, scaling and encoding of series and feature tables."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.calendar import round_ts
from tapeworks.functions.mathx import finite, ratio
from tapeworks.plans.orderstats import attach_stats, average_ranks, median_mad, quantiles
from tapeworks.plans.panel import Panel, join_on, running

PANEL = Panel()


def unpivot(df: DataFrame, cols: Sequence[str], ids: Sequence[str] = (), name: str = "feature", value: str = "value") -> DataFrame:
    """Wide to long over numeric columns in one pass."""
    parts = ", ".join(f"'{c}', cast(`{c}` as double)" for c in cols)
    return df.select(*ids, F.expr(f"stack({len(cols)}, {parts}) as ({name}, {value})"))


# -- rows ---------------------------------------------------------------------------------

def clean_ohlcv(df: DataFrame, target: str = "close", keys: Sequence[str] = ("symbol",), ts: str = "ts",
                tie: Sequence[str] = ()) -> DataFrame:
    """Drop null or non-positive targets; keep the first row per (key, ts)."""
    ok = df.where(F.col(target).isNotNull() & (F.col(target) > 0))
    rest = [c for c in df.columns if c not in (*keys, ts)]
    first = F.min_by(F.struct(*rest), F.struct(*tie) if tie else F.struct(*rest))
    return ok.groupBy(*keys, ts).agg(first.alias("_r")).select(*keys, ts, "_r.*")


def clean_numeric(df: DataFrame, cols: Sequence[str], fill: float | None = 0.0) -> DataFrame:
    """Infinities and NaN to null, then an optional constant."""
    out = df.select(*[finite(c).alias(c) if c in cols else F.col(c) for c in df.columns])
    return out if fill is None else out.fillna(fill, list(cols))


def basic_clean(df: DataFrame) -> DataFrame:
    """Drop all-null rows, duplicate rows and all-null columns (one counting pass)."""
    d = df.dropna("all").dropDuplicates()
    seen = df.agg(*[F.count(c).alias(c) for c in df.columns]).first()
    return d.select(*[c for c in df.columns if seen[c] > 0])


def cap_or_drop(df: DataFrame, col: str, keys: Sequence[str] = (), k: float = 1.5, drop_below: float = 0.05) -> DataFrame:
    """IQR fences: drop outliers while they are under ``drop_below`` of the key's rows, else clip."""
    q = quantiles(df, F.col(col), {"q1": .25, "q3": .75}, keys)
    d = attach_stats(df, q.select(*keys, (F.col("q1") - k * (F.col("q3") - F.col("q1"))).alias("_lo"),
                                  (F.col("q3") + k * (F.col("q3") - F.col("q1"))).alias("_hi")), keys, ["_lo", "_hi"])
    out = (F.col(col) < F.col("_lo")) | (F.col(col) > F.col("_hi"))
    share = attach_stats(d, d.groupBy(*keys).agg(F.avg(out.cast("double")).alias("_share")), keys, ["_share"])
    clipped = F.greatest(F.least(F.col(col), F.col("_hi")), F.col("_lo"))
    keep = share.where((F.col("_share") >= drop_below) | ~F.coalesce(out, F.lit(False)))
    return keep.withColumn(col, F.when(F.col("_share") >= drop_below, clipped).otherwise(F.col(col))).select(*df.columns)


def handle_outliers(df: DataFrame, col: str, method: str = "iqr", action: str = "clip", k: float | None = None,
                    keys: Sequence[str] = ()) -> DataFrame:
    """iqr / zscore / mad fences; remove, clip or log1p-compress."""
    if method == "iqr":
        k = 1.5 if k is None else k
        s = quantiles(df, F.col(col), {"q1": .25, "q3": .75}, keys)
        iqr = F.col("q3") - F.col("q1")
        s = s.select(*keys, (F.col("q1") - k * iqr).alias("_lo"), (F.col("q3") + k * iqr).alias("_hi"))
    elif method == "zscore":
        k = 3.0 if k is None else k
        s = df.groupBy(*keys).agg((F.avg(col) - k * F.stddev_samp(col)).alias("_lo"), (F.avg(col) + k * F.stddev_samp(col)).alias("_hi"))
    else:
        k = 3.0 if k is None else k
        s = median_mad(df, F.col(col), keys).select(*keys, (F.col("med") - k * F.col("mad")).alias("_lo"), (F.col("med") + k * F.col("mad")).alias("_hi"))
    d = attach_stats(df, s, keys, ["_lo", "_hi"])
    c = F.col(col)
    if action == "remove":
        d = d.where(c.isNull() | c.between(F.col("_lo"), F.col("_hi")))
    elif action == "clip":
        d = d.withColumn(col, F.when(c.isNotNull(), F.greatest(F.least(c, F.col("_hi")), F.col("_lo"))))
    else:
        d = d.withColumn(col, F.signum(c) * F.log1p(F.abs(c)))
    return d.select(*df.columns)


# -- gaps and windows ---------------------------------------------------------------------

def fill_missing(df: DataFrame, cols: Sequence[str], method: str = "ffill", panel: Panel = PANEL, then_zero: bool = True,
                 bucket: Column | None = None) -> DataFrame:
    """ffill / bfill / zero / linear (in time). ``bucket`` switches to the carry plan for unbounded keys."""
    ts = panel.order[0]
    out = df
    if method in ("ffill", "bfill"):
        if bucket is None:
            for c in cols:
                e = F.last(c, True).over(panel.cum if method == "ffill" else panel.back)
                out = out.withColumn(c, e)
        else:
            out = running(out, panel, {f"_f_{c}": ("last", F.col(c)) for c in cols}, bucket, reverse=method == "bfill")
            out = out.select(*[F.col(f"_f_{c}").alias(c) if c in cols else F.col(c) for c in df.columns])
    elif method == "linear":
        us = F.unix_micros(F.col(ts))
        for c in cols:
            have = F.when(F.col(c).isNotNull(), F.struct(us.alias("t"), F.col(c).alias("v")))
            # a frame to the end of the key is read anew for each row; going back, the next known value is the last one met
            p, n = F.last(have, True).over(panel.cum), F.last(have, True).over(panel.back)
            w = (us - p["t"]) / F.nullif(n["t"] - p["t"], F.lit(0))
            out = out.withColumn(c, F.coalesce(F.col(c), p["v"] + (n["v"] - p["v"]) * w, p["v"]))
    return out.fillna(0.0, list(cols)) if then_zero or method == "zero" else out


def calendar_spine(df: DataFrame, step: str, keys: Sequence[str] = ("symbol",), ts: str = "ts") -> DataFrame:
    """Complete per-key grid left-joined to the data. The grid is sized by time, not by rows."""
    # the ranges are few bytes that become many rows: a number of partitions keeps Spark from putting them into one task
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spine = (df.groupBy(*keys).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b")).repartition(tasks, *keys)
               .select(*keys, F.explode(F.sequence("_a", "_b", F.expr(f"interval {step}"))).alias(ts)))
    return join_on(spine, df, [*keys, ts], "left").select(*df.columns)


def gaps(df: DataFrame, max_seconds: float, panel: Panel = PANEL) -> DataFrame:
    """Rows whose distance to the previous row of the key exceeds the limit."""
    ts = panel.order[0]
    prev = F.lag(ts).over(panel.w)
    return (df.withColumn("prev_ts", prev)
              .withColumn("gap_seconds", (F.unix_micros(ts) - F.unix_micros("prev_ts")) / 1e6)
              .where(F.col("gap_seconds") > max_seconds))


def valid_windows(df: DataFrame, size: int, step_seconds: float, tolerance: float, panel: Panel = PANEL) -> DataFrame:
    """Rows that start a run of ``size`` consecutive rows whose inner steps are all within tolerance."""
    ts = panel.order[0]
    step = (F.unix_micros(F.lead(ts).over(panel.w)) - F.unix_micros(ts)) / 1e6
    d = df.withColumn("_ok", F.coalesce((F.abs(step - step_seconds) <= tolerance).cast("int"), F.lit(0)))
    d = (d.withColumn("_all", F.min("_ok").over(panel.frame(0, max(size - 2, 0))))
          .withColumn("_n", F.count(F.lit(1)).over(panel.frame(0, size - 1))))
    ok = (F.col("_n") == size) & ((F.col("_all") == 1) if size > 1 else F.lit(True))
    return d.where(ok).drop("_ok", "_all", "_n")


def aligned_windows(df: DataFrame, at: Column, size: int, value: str = "close", max_missing: float = 0.1,
                    step: str = "1 hour", keys: Sequence[str] = ("symbol",), ts: str = "ts") -> DataFrame:
    """Per key the grid of ``size`` steps ending at ``at``, forward then back filled, if few enough are missing."""
    iv = F.expr(f"interval {step}")
    grid = df.select(*keys).distinct().select(
        *keys, F.explode(F.sequence(at - iv * (size - 1), at, iv)).alias(ts))
    j = join_on(grid, df.select(*keys, ts, value), [*keys, ts], "left")
    miss = F.avg(F.col(value).isNull().cast("double")).over(Window.partitionBy(*keys))
    p = Panel(tuple(keys), (ts,))
    j = j.withColumn("missing_ratio", miss).where(F.col("missing_ratio") <= max_missing)
    filled = F.coalesce(F.last(value, True).over(p.cum), F.last(value, True).over(p.back))
    return j.withColumn(value, filled)


def common_timestamps(df: DataFrame, seconds: int, n_symbols: int | None = None, symbol: str = "symbol", ts: str = "ts") -> DataFrame:
    """Keep rows whose rounded time occurs for every symbol (semi join on counts)."""
    d = df.withColumn("ts_rounded", round_ts(ts, seconds))
    per = d.select("ts_rounded", symbol).distinct().groupBy("ts_rounded").agg(F.count(F.lit(1)).alias("_k"))
    total = F.lit(n_symbols) if n_symbols else d.select(F.count_distinct(symbol)).scalar()
    return d.join(per.where(F.col("_k") == total), "ts_rounded", "left_semi")


# -- fitted scaling -----------------------------------------------------------------------

def fit_normalizer(df: DataFrame, cols: Sequence[str], method: str = "standardize", outlier: float | None = None) -> DataFrame:
    """Parameter table (feature, center, scale, lo, hi): the thing to store next to a model.

    standardize, robust (25-75), minmax, or quantile (a 101-point grid in ``grid``).
    """
    long = unpivot(df, cols).where(F.col("value").isNotNull() & ~F.isnan("value"))
    if method == "standardize":
        p = long.groupBy("feature").agg(F.avg("value").alias("center"), F.stddev_pop("value").alias("scale"))
    elif method == "minmax":
        p = long.groupBy("feature").agg(F.min("value").alias("center"), (F.max("value") - F.min("value")).alias("scale"))
    elif method == "robust":
        p = quantiles(long, F.col("value"), {"q1": .25, "center": .5, "q3": .75}, ["feature"]).select(
            "feature", "center", (F.col("q3") - F.col("q1")).alias("scale"))
    elif method == "quantile":
        q = quantiles(long, F.col("value"), {f"p{i}": i / 100 for i in range(101)}, ["feature"])
        p = q.select("feature", F.lit(0.0).alias("center"), F.lit(1.0).alias("scale"), F.array(*[f"p{i}" for i in range(101)]).alias("grid"))
    else:
        raise ValueError(method)
    p = p.withColumn("scale", F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0)).withColumn("method", F.lit(method))
    if outlier is not None:
        p = p.withColumn("lo", F.col("center") - outlier * F.col("scale")).withColumn("hi", F.col("center") + outlier * F.col("scale"))
    return p


def apply_normalizer(df: DataFrame, params: DataFrame, cols: Sequence[str], inverse: bool = False, fill: float | None = None) -> DataFrame:
    """Project with stored parameters; they enter the plan as one scalar map (one entry per feature)."""
    fields = [f for f in ("center", "scale", "lo", "hi", "grid") if f in params.columns]
    m = params.agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct(*fields)))).alias("m")).scalar()
    out = df.withColumn("_m", m)
    proj = []
    for c in df.columns:
        if c not in cols:
            proj.append(F.col(c))
            continue
        p, x = F.col("_m")[c], F.col(c).cast("double")
        if "lo" in fields and not inverse:
            x = F.greatest(F.least(x, p["hi"]), p["lo"])
        if "grid" in fields:
            g = p["grid"]
            if inverse:
                i = F.least(F.floor(x * 100), F.lit(99)).cast("int")
                a, b = F.get(g, i), F.get(g, i + 1)
                y = a + (b - a) * (x * 100 - i)
            else:
                i = F.greatest(F.least(F.size(F.filter(g, lambda e: e <= x)), F.lit(100)), F.lit(1)) - 1
                a, b = F.get(g, i), F.get(g, i + 1)
                y = F.when(x <= F.get(g, F.lit(0)), 0.0).when(x >= F.get(g, F.lit(100)), 1.0).otherwise((i + ratio(x - a, b - a)) / 100)
        else:
            y = x * p["scale"] + p["center"] if inverse else (x - p["center"]) / p["scale"]
        proj.append((y if fill is None else F.coalesce(y, F.lit(fill))).alias(c))
    return out.select(*proj)


def rolling_znorm(c: str, n: int, panel: Panel = PANEL, eps: float = 1e-8) -> Column:
    w = panel.trailing(n)
    return F.coalesce((F.col(c) - F.avg(c).over(w)) / (F.stddev_samp(c).over(w) + eps), F.lit(0.0))


# -- ml.feature wrappers ------------------------------------------------------------------

def impute(df: DataFrame, cols: Sequence[str], strategy: str = "mean", drop_over: float | None = None) -> DataFrame:
    """Drop columns missing more than ``drop_over``, then fill numeric ones by mean / median / mode."""
    from pyspark.ml.feature import Imputer
    cols = list(cols)
    if drop_over is not None:
        miss = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols]).first()
        gone = [c for c in cols if miss[c] is not None and miss[c] > drop_over]
        df, cols = df.drop(*gone), [c for c in cols if c not in gone]
    if not cols:
        return df
    return Imputer(strategy=strategy, inputCols=cols, outputCols=cols).fit(df).transform(df)


def fill_text_mode(df: DataFrame, cols: Sequence[str], unknown: str = "unknown") -> DataFrame:
    """Nulls in text columns to the most frequent value (ties to the smallest)."""
    out = df
    for c in cols:
        mode = (df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("k"))
                  .agg(F.max_by(c, F.struct("k")).alias("m")).select("m").scalar())
        out = out.withColumn(c, F.coalesce(F.col(c), mode, F.lit(unknown)))
    return out


def encode_categories(df: DataFrame, cols: Sequence[str], max_onehot: int = 10) -> DataFrame:
    """One-hot under ``max_onehot`` categories, else label index; unseen values keep their own slot."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer
    card = df.agg(*[F.countDistinct(c).alias(c) for c in cols]).first()
    idx = StringIndexer(inputCols=list(cols), outputCols=[f"{c}_index" for c in cols], handleInvalid="keep",
                        stringOrderType="frequencyDesc")
    hot = [c for c in cols if card[c] <= max_onehot]
    stages = [idx]
    if hot:
        stages.append(OneHotEncoder(inputCols=[f"{c}_index" for c in hot], outputCols=[f"{c}_onehot" for c in hot],
                                    dropLast=False, handleInvalid="keep"))
    return Pipeline(stages=stages).fit(df).transform(df)


def scale_features(df: DataFrame, cols: Sequence[str], method: str = "standard", out: str = "scaled") -> DataFrame:
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import MinMaxScaler, RobustScaler, StandardScaler, VectorAssembler
    scaler = {"standard": lambda: StandardScaler(inputCol="_vec", outputCol=out, withMean=True, withStd=True),
              "robust": lambda: RobustScaler(inputCol="_vec", outputCol=out, withCentering=True),
              "minmax": lambda: MinMaxScaler(inputCol="_vec", outputCol=out)}[method]()
    va = VectorAssembler(inputCols=list(cols), outputCol="_vec", handleInvalid="keep")
    return Pipeline(stages=[va, scaler]).fit(df).transform(df).drop("_vec")


def bin_column(df: DataFrame, col: str, n: int = 10, method: str = "quantile", out: str | None = None) -> DataFrame:
    """Quantile (exact edges) or uniform bins, 0-based."""
    out = out or f"{col}_bin"
    if method == "uniform":
        s = df.agg(F.struct(F.min(col).alias("a"), F.max(col).alias("b")).alias("s")).scalar()
        d = df.withColumn("_s", s)
        pos = F.floor(ratio(F.col(col) - F.col("_s.a"), (F.col("_s.b") - F.col("_s.a")) / n))
        return d.withColumn(out, F.greatest(F.least(pos, F.lit(n - 1)), F.lit(0)).cast("int")).drop("_s")
    q = quantiles(df, F.col(col), {f"e{i}": i / n for i in range(1, n)})
    edges = q.select(F.array(*[f"e{i}" for i in range(1, n)]).alias("e")).scalar()
    return (df.withColumn("_e", edges)
              .withColumn(out, F.when(F.col(col).isNotNull(), F.size(F.filter("_e", lambda e: e < F.col(col)))).cast("int")).drop("_e"))


def drop_low_variance(df: DataFrame, cols: Sequence[str], threshold: float = 0.0) -> DataFrame:
    v = df.agg(*[F.var_samp(c).alias(c) for c in cols]).first()
    return df.drop(*[c for c in cols if v[c] is None or v[c] <= threshold])


def fit_target(df: DataFrame, target: str, method: str = "standardize", lo: float = .01, hi: float = .99) -> DataFrame:
    """Clip bounds and scale of a target, stored for inversion."""
    q = quantiles(df, F.col(target), {"lo": lo, "hi": hi})
    d = attach_stats(df.select(target), q, [], ["lo", "hi"])
    c = F.greatest(F.least(F.col(target), F.col("hi")), F.col("lo"))
    a, b = (F.avg(c), F.stddev_samp(c)) if method == "standardize" else (F.min(c), F.max(c) - F.min(c))
    return d.agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"), a.alias("center"), b.alias("scale"))


def apply_target(df: DataFrame, params: DataFrame, target: str, inverse: bool = False) -> DataFrame:
    p = params.select(F.struct("lo", "hi", "center", "scale").alias("p")).scalar()
    d = df.withColumn("_p", p)
    x = F.col(target)
    y = x * F.col("_p.scale") + F.col("_p.center") if inverse else \
        (F.greatest(F.least(x, F.col("_p.hi")), F.col("_p.lo")) - F.col("_p.center")) / F.col("_p.scale")
    return d.withColumn(target, y).drop("_p")
