"""Connected components of an edge table, as joins and aggregates; nothing of it passes through the driver."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.session import ensure_checkpoint_dir

ROWS = 500_000


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b. Returns node and label, the smallest node reachable, for every node that is not its own label.

    Large-star and small-star rounds alternate until every node points at its component's least node; a round costs two
    shuffles of the edges, and the number of rounds grows with the logarithm of a component's diameter. Aggregates give
    each node's least neighbour, so a node with very many neighbours is a skewed join, which Spark splits, never a list.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    parts = e.count() // ROWS + 1

    def few(df: DataFrame) -> DataFrame:
        """As many tasks as the edges fill, where the session has more."""
        return df.coalesce(parts)

    before = None
    while True:
        both = few(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        least = few(both.groupBy("u").agg(F.min("v").alias("m"))).select("u", F.least("u", "m").alias("m"))
        large = few(few(both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
        least = few(large.groupBy("u").agg(F.min("v").alias("m")))
        hooks = few(large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        e = few(few(hooks.unionByName(least.withColumnRenamed("m", "v"))).distinct()).checkpoint()
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("label"))
        before = now
