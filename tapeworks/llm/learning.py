"""Split of labelled rows and bounded training samples, shared by the learned operators."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out() -> Column:
    """Rows that nothing is learned from: crc32 of the id as text leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def sample(rows: DataFrame, label: str, most: int) -> DataFrame:
    """About ``most`` rows of each label at most, drawn by a hash of the id: a rate for each label, from exact counts."""
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    rate = F.lit(0.0)
    for value, n in counts.items():
        rate = F.when(F.col(label) == F.lit(value), F.lit(most / n)).otherwise(rate)
    return rows.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (draw < rate))
