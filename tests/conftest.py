import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tapeworks.session import local_session
    s = local_session(4, "tests", "6g")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s


@pytest.fixture(scope="session")
def tape(spark):
    """Three symbols, one holding most rows; unique times; a null and ties in value."""
    from pyspark.sql import functions as F
    d = spark.range(1200).select(
        F.when(F.col("id") % 6 == 0, "b").when(F.col("id") % 97 == 1, "c").otherwise("hot").alias("symbol"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_interval(mins=F.col("id") * 7)).alias("ts"),
        F.col("id").alias("trade_id"), (100 + 10 * F.sin(F.col("id") / 9.0) + F.col("id") % 5).alias("price"),
        (1 + F.col("id") % 4).cast("double").alias("volume"), F.when(F.col("id") % 3 == 0, "buy").otherwise("sell").alias("side"))
    return d.cache()
