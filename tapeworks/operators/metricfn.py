"""A user's metric function over groups and time windows, whole or mergeable, and drift of a metric from window to window.

``window_metric`` hands each window's rows to the function as Arrow-backed arrays (a grouped-aggregate UDF), for metrics that need
all rows at once; a window must fit in a task. ``MergeableMetric`` splits a metric into partial states of fixed width that tasks
make where the rows lie, that merge in any order, and that are finished once per window, so no window is gathered anywhere.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.mathx import ratio


def window_start(ts: str, size: str) -> Column:
    return F.window(ts, size)["start"]


def window_metric(df: DataFrame, fn: Callable[..., float], columns: Sequence[str], keys: Sequence[str], ts: str, size: str, name: str = "metric") -> DataFrame:
    """(keys, window, n, metric): fn over numpy arrays of the columns, one call for each group and window."""

    @F.pandas_udf("double")
    def metric(*cols: pd.Series) -> float:
        return float(fn(*[c.to_numpy() for c in cols]))

    @F.pandas_udf("long")
    def rows(one: pd.Series) -> int:  # Spark takes no other kind of aggregate beside these
        return len(one)

    g = df.withColumn("window", window_start(ts, size)).groupBy(*keys, "window")
    return g.agg(rows(F.lit(1)).alias("n"), metric(*[F.col(c).cast("double") for c in columns]).alias(name))


@dataclass(frozen=True)
class MergeableMetric:
    """partial(columns as arrays) -> state of ``width`` doubles; merge(states, one a row) -> state; finish(states) -> a value for each row."""

    width: int
    partial: Callable[..., np.ndarray]
    merge: Callable[[np.ndarray], np.ndarray]
    finish: Callable[[np.ndarray], np.ndarray]


def merged_metric(df: DataFrame, metric: MergeableMetric, columns: Sequence[str], keys: Sequence[str], ts: str, size: str, name: str = "metric", salts: int = 16) -> DataFrame:
    """(keys, window, n, metric) by partial states: one for each group, window and Arrow batch, merged in two salted steps."""
    keys = [*keys, "window"]
    d = df.withColumn("window", window_start(ts, size)).select(*keys, *[F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(columns)])
    types = {f.name: f.dataType.simpleString() for f in d.schema}
    kept = ", ".join(f"`{k}` {types[k]}" for k in keys)
    states = f"{kept}, salt int, n long, state array<double>"

    def start(batches):
        for b, batch in enumerate(batches):
            t = batch.to_pandas()
            rows = []
            for key, part in t.groupby(keys, dropna=False, sort=False):
                rows.append((*key, b % salts, len(part), [float(x) for x in metric.partial(*[part[f"_c{i}"].to_numpy() for i in range(len(columns))])]))
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=[*keys, "salt", "n", "state"]), schema=pa.schema([*[batch.schema.field(k) for k in keys], ("salt", pa.int32()), ("n", pa.int64()), ("state", pa.list_(pa.float64()))]), preserve_index=False)

    def joined(table: pa.Table) -> tuple[pa.Table, int, np.ndarray]:
        state = np.array(table["state"].to_pylist(), float).reshape(-1, metric.width)
        return table.slice(0, 1), sum(table["n"].to_pylist()), metric.merge(state)

    def some(table: pa.Table) -> pa.Table:
        first, n, state = joined(table)
        return first.set_column(first.schema.get_field_index("n"), "n", pa.array([n], pa.int64())).set_column(first.schema.get_field_index("state"), "state", pa.array([state.tolist()], pa.list_(pa.float64())))

    def last(table: pa.Table) -> pa.Table:
        first, n, state = joined(table)
        return first.select(keys).append_column("n", pa.array([n], pa.int64())).append_column(name, pa.array([float(metric.finish(state[None])[0])], pa.float64()))

    parts = d.mapInArrow(start, states).groupBy(*keys, "salt").applyInArrow(some, states)
    return parts.groupBy(*keys).applyInArrow(last, f"{kept}, n long, `{name}` double")


def metric_drift(scores: DataFrame, keys: Sequence[str], threshold: float = 0.1, lower_is_better: bool = True, name: str = "metric") -> DataFrame:
    """Each window's metric against the previous window and the first: relative change and a flag where it got worse by more than threshold."""
    w = Window.partitionBy(*keys).orderBy("window")
    sign = 1.0 if lower_is_better else -1.0
    before, first = F.lag(name).over(w), F.first(name).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = scores.withColumn("change", ratio(F.col(name) - before, F.abs(before))).withColumn("since_start", ratio(F.col(name) - first, F.abs(first)))
    return out.withColumn("drifted", F.coalesce(sign * F.col("change") > threshold, F.lit(False)))
