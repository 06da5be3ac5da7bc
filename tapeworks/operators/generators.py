"""Feature generators as ``pyspark.ml`` transformers: parameters, persistence, and use inside a stored ``Pipeline``.

A generator subclasses ``FeatureGenerator`` and gives its columns as expressions; everything else (schema check, copying, saving,
loading) comes with it. Products of two features are chosen by score before any is built (``top_products``).
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class FeatureGenerator(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the columns that ``features`` names; a subclass declares its own params next to ``prefix``."""

    prefix = Param(Params._dummy(), "prefix", "put before the name of each new column", TypeConverters.toString)

    def features(self, df: DataFrame) -> Mapping[str, Column]:
        raise TypeError(f"{type(self).__name__} has no features")

    def feature_names(self, df: DataFrame) -> list[str]:
        return [self.getOrDefault("prefix") + n for n in self.features(df)]

    def _transform(self, df: DataFrame) -> DataFrame:
        new = {self.getOrDefault("prefix") + n: c for n, c in self.features(df).items()}
        clash = sorted(set(new) & set(df.columns))
        if clash:
            raise ValueError(f"columns exist already: {', '.join(clash)}; set another prefix")
        return df.withColumns(new)


class RatioGenerator(FeatureGenerator):
    """Each column over the first one, null where that is 0."""

    columns = Param(Params._dummy(), "columns", "numerators after one denominator", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, columns=None, prefix="ratio_"):
        super().__init__()
        self._setDefault(prefix="ratio_")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def features(self, df: DataFrame) -> Mapping[str, Column]:
        base, *rest = self.getOrDefault("columns")
        return {f"{c}_{base}": F.col(c) / F.nullif(F.col(base).cast("double"), F.lit(0.0)) for c in rest}


class LagGenerator(FeatureGenerator):
    """Values of earlier rows of a series of bars, by key and order."""

    columns = Param(Params._dummy(), "columns", "columns to look back on", TypeConverters.toListString)
    lags = Param(Params._dummy(), "lags", "rows back", TypeConverters.toListInt)
    key = Param(Params._dummy(), "key", "series key", TypeConverters.toString)
    order = Param(Params._dummy(), "order", "series order", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, columns=None, lags=None, key="symbol", order="ts", prefix="lag_"):
        super().__init__()
        self._setDefault(lags=[1], key="symbol", order="ts", prefix="lag_")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def features(self, df: DataFrame) -> Mapping[str, Column]:
        w = Window.partitionBy(self.getOrDefault("key")).orderBy(self.getOrDefault("order"))
        return {f"{c}_{k}": F.lag(c, k).over(w) for c in self.getOrDefault("columns") for k in self.getOrDefault("lags")}


# -- products by score --------------------------------------------------------------------

def product_scores(df: DataFrame, features: Sequence[str], target: str, interaction_only: bool = True) -> DataFrame:
    """(a, b, n, f): the regression F score of each product a * b against the target, over rows that have all values.

    One pass: a task's rows give three matrices of features by features (sums of products, of their squares, and of products times
    the target), sent row by row and added up. Products themselves are never a column, so wide inputs stay narrow.
    """
    p = len(features)
    d = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)], F.col(target).cast("double").alias("y")).dropna()

    def moments(batches):
        z = np.zeros((3, p, p))
        y1 = y2 = n = 0.0
        for b in batches:
            x = np.column_stack([b[f"x{i}"].to_numpy(zero_copy_only=False) for i in range(p)])
            y = b["y"].to_numpy(zero_copy_only=False)
            q = x * x
            z += np.stack([x.T @ x, q.T @ q, (x * y[:, None]).T @ x])
            y1, y2, n = y1 + y.sum(), y2 + y @ y, n + len(y)
        rows = [(i, [n, y1, y2], *[z[k, i].tolist() for k in range(3)]) for i in range(p)] if n else []
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[k] for r in rows], pa.list_(pa.float64())) for k in range(1, 5)]], names=["i", "m", "s", "q", "t"])

    parts = d.mapInArrow(moments, "i int, m array<double>, s array<double>, q array<double>, t array<double>")
    flat = parts.select("i", "m", F.posexplode(F.arrays_zip("s", "q", "t")).alias("j", "v"))
    total = flat.groupBy("i", "j").agg(*[F.sum(F.col("m")[k]).alias(c) for k, c in enumerate(("n", "y1", "y2"))], *[F.sum(f"v.{c}").alias(c) for c in ("s", "q", "t")])
    total = total.where(F.col("i") < F.col("j") if interaction_only else F.col("i") <= F.col("j"))
    sxy, sxx, syy = F.col("t") - F.col("s") * F.col("y1") / F.col("n"), F.col("q") - F.col("s") * F.col("s") / F.col("n"), F.col("y2") - F.col("y1") * F.col("y1") / F.col("n")
    r2 = sxy * sxy / F.nullif(sxx * syy, F.lit(0.0))
    names = F.array(*[F.lit(c) for c in features])
    return total.select(F.element_at(names, F.col("i") + 1).alias("a"), F.element_at(names, F.col("j") + 1).alias("b"), F.col("n").cast("long").alias("n"), F.coalesce(r2 / F.nullif(1 - r2, F.lit(0.0)) * (F.col("n") - 2), F.lit(0.0)).alias("f"))


def top_products(df: DataFrame, features: Sequence[str], target: str, most: int, interaction_only: bool = True) -> list[tuple[str, str]]:
    """The pairs whose products score highest, ties by name; ``most`` is the number of columns that will be built."""
    s = product_scores(df, features, target, interaction_only).orderBy(F.col("f").desc(), "a", "b").limit(most)
    return [(r["a"], r["b"]) for r in s.select("a", "b").collect()]


def with_products(df: DataFrame, pairs: Sequence[tuple[str, str]], prefix: str = "poly_") -> DataFrame:
    return df.withColumns({f"{prefix}{a}_{b}": F.col(a) * F.col(b) for a, b in pairs})
