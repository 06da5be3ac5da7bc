"""Spark ML training, search, and panel forecasts."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _estimator(kind: str, label: str, params: Mapping | None = None, seed: int = 42):
    from pyspark.ml import classification as C
    from pyspark.ml import regression as R
    made = {"linear": lambda: R.LinearRegression(), "forest": lambda: R.RandomForestRegressor(seed=seed, numTrees=20), "boosted": lambda: R.GBTRegressor(seed=seed, maxIter=20),
            "logistic": lambda: C.LogisticRegression(), "forest_classifier": lambda: C.RandomForestClassifier(seed=seed, numTrees=20), "boosted_classifier": lambda: C.GBTClassifier(seed=seed, maxIter=20)}[kind]()
    made = made.setFeaturesCol("features").setLabelCol(label)
    return made.copy({made.getParam(k): v for k, v in (params or {}).items()})


def assembled(cols: Sequence[str], out: str, impute: bool = True) -> list:
    """Stages that gather columns into a vector without losing a row: missing values become the mean of the rows fitted on, or stay NaN."""
    from pyspark.ml.feature import Imputer, VectorAssembler
    if not impute:
        return [VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep")]
    full = [f"_full_{c}" for c in cols]
    return [Imputer(strategy="mean", inputCols=list(cols), outputCols=full), VectorAssembler(inputCols=full, outputCol=out)]


def labelled(df: DataFrame, cols: Sequence[str], label: str) -> tuple[DataFrame, tuple[int, int, int]]:
    """The rows that have a label; and how many those are, how many of them miss a feature, and how many rows have no label."""
    gap = F.col(cols[0]).isNull() | F.isnan(F.col(cols[0]).cast("double"))
    for c in cols[1:]:
        gap = gap | F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    has = F.col(label).isNotNull()
    n = df.agg(F.count_if(has), F.count_if(has & gap), F.count_if(~has)).first()
    return df.where(has), tuple(n)


COUNTS = "n_rows long, n_imputed long, n_unlabelled long"


def pipeline(kind: str, cols: Sequence[str], label: str, params: Mapping | None = None, scale: bool = True, impute: bool = True):
    """assemble -> scale -> model; means and scaling are fitted on whatever the pipeline is fitted on, so folds do not leak."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    st = assembled(cols, "_raw", impute)
    st.append(StandardScaler(inputCol="_raw", outputCol="features", withMean=True) if scale else VectorAssembler(inputCols=["_raw"], outputCol="features"))
    return Pipeline(stages=st + [_estimator(kind, label, params)])


def train(df: DataFrame, kind: str, cols: Sequence[str], label: str, params: Mapping | None = None):
    """Fitted on the rows that have all features and the label; scoring keeps every row it is given, features missing as NaN."""
    return pipeline(kind, cols, label, params, impute=False).fit(df.dropna(subset=[*cols, label]))


def select_model(df: DataFrame, kinds: Sequence[str], cols: Sequence[str], label: str, fold: str, metric: str = "rmse", params: Mapping | None = None) -> DataFrame:
    """Cross-validated score per model over an integer fold column, on every labelled row; with the rows' counts."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
    df = df.persist()  # every model and fold rereads it
    every, (df, counts) = df, labelled(df, cols, label)
    k = df.agg(F.max(fold)).first()[0] + 1
    ev = RegressionEvaluator(labelCol=label, metricName=metric)
    rows = []
    for kind in kinds:
        cv = CrossValidator(estimator=pipeline(kind, cols, label, (params or {}).get(kind)), estimatorParamMaps=ParamGridBuilder().build(), evaluator=ev, numFolds=int(k), foldCol=fold, parallelism=2)
        m = cv.fit(df)
        rows.append((kind, float(m.avgMetrics[0]), float(m.stdMetrics[0]), *counts))
    every.unpersist()
    return df.sparkSession.createDataFrame(rows, f"model string, score double, std double, {COUNTS}").orderBy("score")


def grid_search(df: DataFrame, kind: str, cols: Sequence[str], label: str, grid: Mapping[str, Sequence], metric: str = "rmse", samples: int | None = None, seed: int = 42, parallelism: int = 2):
    """Exhaustive or (``samples``) random search with a train/validation split; returns (best model, score table)."""
    import random
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
    df = df.persist()
    every, (df, counts) = df, labelled(df, cols, label)
    pl = pipeline(kind, cols, label)
    est = pl.getStages()[-1]
    b = ParamGridBuilder()
    for k, v in grid.items():
        b = b.addGrid(est.getParam(k), list(v))
    maps = b.build()
    if samples is not None and samples < len(maps):
        maps = random.Random(seed).sample(maps, samples)
    m = TrainValidationSplit(estimator=pl, estimatorParamMaps=maps, evaluator=RegressionEvaluator(labelCol=label, metricName=metric), trainRatio=.8, seed=seed, parallelism=parallelism).fit(df)
    rows = [(", ".join(f"{p.name}={v}" for p, v in pm.items()), float(s), *counts) for pm, s in zip(maps, m.validationMetrics)]
    every.unpersist()
    return m.bestModel, df.sparkSession.createDataFrame(rows, f"params string, score double, {COUNTS}")


def seasonal_forecast(df: DataFrame, horizon: int, step_seconds: int, periods: Mapping[str, tuple[float, int]], ridge: float = 1.0, series: str = "series", y: str = "y", level_z: float = 1.96,
                      cutoffs: str | None = None) -> DataFrame:
    """Trend + Fourier seasonality per series with normal intervals (ridge least squares).

    ``periods`` maps a name to (period in seconds, order). Series are bars, so a group is bounded by the grid.
    With ``cutoffs`` (a column) one fit per (series, cutoff) uses the rows at or before it.
    """
    keys = [series] + ([cutoffs] if cutoffs else [])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)

    def design(t, t0, span):
        cols = [np.ones(len(t)), (t - t0) / span]
        for per, order in periods.values():
            for k in range(1, order + 1):
                a = 2 * np.pi * k * t / per
                cols += [np.sin(a), np.cos(a)]
        return np.column_stack(cols)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[y]).sort_values("t")
        if len(pdf) < 2:
            return pd.DataFrame(columns=[*keys, "t", "yhat", "lower", "upper"]).astype({"t": "float64", "yhat": "float64", "lower": "float64", "upper": "float64"})
        t, v = pdf["t"].to_numpy(float), pdf[y].to_numpy(float)
        span = max(t[-1] - t[0], 1.0)
        x = design(t, t[0], span)
        pen = ridge * np.eye(x.shape[1])
        pen[0, 0] = pen[1, 1] = 1e-9
        beta = np.linalg.solve(x.T @ x + pen, x.T @ v)
        sd = float(np.std(v - x @ beta))
        f = t[-1] + step_seconds * np.arange(1, horizon + 1)
        yh = design(f, t[0], span) @ beta
        out = pd.DataFrame({"t": f, "yhat": yh, "lower": yh - level_z * sd, "upper": yh + level_z * sd})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "t", "yhat", "lower", "upper"]]

    d = df.select(*keys, F.unix_timestamp("ts").cast("double").alias("t"), F.col(y).cast("double").alias(y))
    r = d.groupBy(*keys).applyInPandas(fit, f"{fields}, t double, yhat double, lower double, upper double")
    return r.withColumn("ts", F.timestamp_seconds("t")).drop("t")


def forecast_cross_validation(df: DataFrame, initial: int, period: int, horizon: int, step_seconds: int, periods: Mapping, series: str = "series", y: str = "y") -> DataFrame:
    """Rolling cut-offs: a row feeds every cut-off at or after it; forecasts are joined back to what happened."""
    from tapeworks.plans.panel import Panel
    p = Panel((series,), ("ts",))
    d = df.withColumn("_rn", F.row_number().over(p.w)).withColumn("_n", F.count(F.lit(1)).over(p.whole))
    first = F.greatest(F.lit(initial), F.ceil((F.col("_rn") - initial) / period) * period + initial).cast("int")
    last = F.col("_n") - horizon
    feeds = d.withColumn("_f", first).withColumn("_l", last.cast("int")).where("_f <= _l").withColumn("cutoff", F.explode(F.sequence("_f", "_l", F.lit(period))))
    fc = seasonal_forecast(feeds.select(series, "cutoff", "ts", y), horizon, step_seconds, periods, series=series, y=y, cutoffs="cutoff")
    return fc.join(df.select(series, "ts", F.col(y).alias("actual")), [series, "ts"])


def feature_pipeline(df: DataFrame, target: str, cols: Sequence[str], ts: str, split: float = 0.8, keep: int = 10, kind: str = "forest") -> DataFrame:
    """Clean -> time split -> select on the training part -> fit -> evaluate on the rest; one metrics row."""
    from tapeworks.operators.cleaning import clean_numeric
    from tapeworks.operators.evaluation import regression_metrics
    from tapeworks.operators.selection import f_scores, top_features
    d = clean_numeric(df, list(cols), 0.0).where(F.col(target).isNotNull())
    cut = d.select(F.percentile_approx(F.unix_timestamp(ts), split, 10000)).scalar()
    d = d.withColumn("_train", F.unix_timestamp(ts) <= cut)
    chosen = [r.feature for r in top_features(f_scores(d.where("_train"), cols, target), k=min(keep, len(cols))).collect()]
    m = train(d.where("_train"), kind, chosen, target)
    scored = m.transform(d.where("not _train")).withColumn("y", F.col(target))
    return regression_metrics(scored).withColumn("features", F.lit(",".join(sorted(chosen))))
