"""Table functions for SQL: support and resistance levels from a table of bars.

    SELECT * FROM levels_from_bars(TABLE(bars), half => 3)

The function is polymorphic: its first column is the table's key with the key's own type, and ``analyze`` asks Spark to hand it the
rows by key in time order. It keeps 2 * half + 1 bars of a key and emits a level as soon as the bars after it are in.
"""
from __future__ import annotations

from collections import deque

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, LongType, StringType, StructType, TimestampType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SelectedColumn


class LevelsFromBars:
    """(key, ts, kind, price, bar): bars whose high (low) is above (below) those of ``half`` bars on both sides, numbered from 1."""

    @staticmethod
    def analyze(bars: AnalyzeArgument, half: AnalyzeArgument, key: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not bars.isTable:
            raise ValueError("levels_from_bars: the first argument is a table of bars")
        if half.value is None or half.value < 1:
            raise ValueError("levels_from_bars: half is a number of bars, 1 or more")
        name = key.value if key is not None and key.value else "symbol"
        fields = {f.name: f.dataType for f in bars.dataType.fields}
        missing = [c for c in (name, "ts", "high", "low") if c not in fields]
        if missing:
            raise ValueError(f"levels_from_bars: the table lacks {missing}")
        schema = StructType().add(name, fields[name]).add("ts", TimestampType()).add("kind", StringType()).add("price", DoubleType()).add("bar", LongType())
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn(name)], orderBy=[OrderingColumn("ts")],
                             select=[SelectedColumn(c) for c in dict.fromkeys((name, "ts", "high", "low"))])

    def __init__(self):
        self.bars, self.n = None, 0

    def eval(self, bar, half: int, key: str | None = None):
        self.n += 1
        if self.bars is None:
            self.bars = deque(maxlen=2 * half + 1)
        bars = self.bars
        bars.append((bar["high"], bar["low"], bar["ts"], bar[key or "symbol"]))
        if len(bars) < 2 * half + 1:
            return
        high, low, ts, name = bars[half]
        if high is not None and _below(bars, half, high):
            yield name, ts, "resistance", float(high), self.n - half
        if low is not None and _above(bars, half, low):
            yield name, ts, "support", float(low), self.n - half


def _below(bars, half: int, high) -> bool:
    """Whether all highs but the middle one are known and below it."""
    for i, b in enumerate(bars):
        if i != half and (b[0] is None or not b[0] < high):
            return False
    return True


def _above(bars, half: int, low) -> bool:
    """Whether all lows but the middle one are known and above it."""
    for i, b in enumerate(bars):
        if i != half and (b[1] is None or not b[1] > low):
            return False
    return True


def register(spark: SparkSession) -> SparkSession:
    spark.udtf.register("levels_from_bars", udtf(LevelsFromBars))
    return spark
