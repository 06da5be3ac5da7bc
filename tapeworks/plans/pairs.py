"""Aligned pairs of series for an explicit pair list.

The pair list is part of the request (as in "BTC against ETH") and is checked to stay
small, so its broadcast is bounded; rows fan out only to the pairs they belong to.
"""
from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PAIRS = 20_000


def all_pairs(symbols: Sequence) -> list[tuple]:
    return list(combinations(sorted(symbols), 2))


def pair_table(spark, pairs: Sequence[tuple], symbol_type: str = "string") -> DataFrame:
    if len(pairs) > MAX_PAIRS:
        raise ValueError(f"{len(pairs)} pairs requested; split the request into lists of at most {MAX_PAIRS}")
    if not pairs:
        return spark.createDataFrame([], f"a {symbol_type}, b {symbol_type}")
    columns = {name: [p[i] for p in pairs] for i, name in enumerate(("a", "b"))}
    return spark.createDataFrame(pa.table(columns)).select(*[F.col(c).cast(symbol_type).alias(c) for c in columns])  # its size is known to the planner


def align_pairs(df: DataFrame, pairs: DataFrame, value_cols: Sequence[str], symbol: str = "symbol",
                ts: str = "ts") -> DataFrame:
    """(a, b, ts, x_<col>, y_<col>) for timestamps present on both legs."""
    legs = (pairs.select("a", "b", F.col("a").alias("_s"), F.lit(0).alias("_leg"))
            .unionByName(pairs.select("a", "b", F.col("b").alias("_s"), F.lit(1).alias("_leg"))))
    j = df.join(F.broadcast(legs), df[symbol] == legs["_s"])
    aggs = [F.max("_leg").alias("_mx"), F.min("_leg").alias("_mn")]
    for c in value_cols:
        aggs += [F.max(F.when(F.col("_leg") == 0, F.col(c))).alias(f"x_{c}"),
                 F.max(F.when(F.col("_leg") == 1, F.col(c))).alias(f"y_{c}")]
    g = j.groupBy("a", "b", ts).agg(*aggs)
    return g.where((F.col("_mn") == 0) & (F.col("_mx") == 1)).drop("_mn", "_mx")
