"""Exact order statistics without sorting a key in one task.

Rows are first collapsed to (key, distinct value, count) with map-side combining, so
a value shared by a third of the rows costs one row. The distinct values are cut into
blocks by sketched quantile edges (balanced for any distribution; as many as the counted
values ask for), block totals are prefix-summed on a table of one row per block, and a running count inside each block completes the global cumulative count. Quantiles, medians, average ranks and
two-sample distribution distances all read from that one table.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.plans.panel import TARGET, join_on, size_estimate
from tapeworks.session import ensure_checkpoint_dir


#: blocks that one round of edges cuts a table or a block into, and blocks of a table that needs no counting
FANOUT, FEW = 1024, 32


def rounds(distinct: DataFrame) -> tuple[DataFrame, list[int]]:
    """The table of distinct values to go on with, and into how many blocks each round of edges cuts it.

    Where the tables below hold no more rows than ``FEW`` blocks of ``TARGET``, that is one round of ``FEW``. Anything larger is
    written to the shared checkpoint folder once and counted there; a block gets about ``TARGET`` values, in two rounds where one
    would need more than ``FANOUT`` edges.
    """
    if size_estimate(distinct) <= FEW * TARGET:
        return distinct, [FEW]
    ensure_checkpoint_dir(distinct.sparkSession)
    distinct = distinct.checkpoint()
    return distinct, block_rounds(distinct.count())


def block_rounds(n: int) -> list[int]:
    """Fan-out of each round for n distinct values."""
    out, blocks = [], max(FEW, n // TARGET + 1)
    while blocks > FANOUT:
        out.append(FANOUT)
        blocks = -(-blocks // FANOUT)
    return out + [max(blocks, 2)]


def _edges_below(edges: Column, value: Column, blocks: int) -> Column:
    """How many of the sorted edges lie below a value; many edges are searched in two steps."""
    if blocks <= 64:
        return F.size(F.filter(edges, lambda e: e < value))
    step = int(blocks ** 0.5)
    coarse = F.size(F.filter(edges, lambda e, i: (i % step == step - 1) & (e < value))) * step
    return coarse + F.size(F.filter(F.slice(edges, coarse + 1, F.lit(step)), lambda e: e < value))


def _cut(d: DataFrame, keys: list[str], blocks: int, first: bool = False) -> DataFrame:
    """Each block ``_blk`` cut into ``blocks`` finer ones at sketched quantiles of the distinct values ``_v``."""
    probs = F.split(F.lit(",".join(repr(i / blocks) for i in range(1, blocks))), ",").cast("array<double>")
    edges_of = F.percentile_approx("_v", probs, F.lit(max(1000, 10 * blocks))).alias("_edges")
    by = keys if first else keys + ["_blk"]
    d = join_on(d, d.groupBy(*by).agg(edges_of), by) if by else d.withColumn("_edges", d.agg(edges_of).scalar())
    return d.withColumn("_blk", F.col("_blk") * blocks + _edges_below(F.col("_edges"), F.col("_v"), blocks)).drop("_edges")


def cumulative_counts(df: DataFrame, value: Column, keys: Sequence[str] = (),
                      weights: Mapping[str, Column] | None = None, blocks: int | None = None) -> DataFrame:
    """(keys, _v, <w>, cum_<w>, tot_<w>) per distinct non-null, non-NaN value.

    ``weights`` maps a name to the per-row weight to total (default ``n`` = 1 per row).
    """
    keys = list(keys)
    weights = dict(weights or {"n": F.lit(1)})
    names = list(weights)
    d = (df.select(*keys, value.cast("double").alias("_v"), *[w.alias(n) for n, w in weights.items()])
           .where(F.col("_v").isNotNull() & ~F.isnan("_v"))
           .groupBy(*keys, "_v").agg(*[F.sum(n).alias(n) for n in names]))
    d, cuts = (d, [blocks]) if blocks else rounds(d)
    d = _cut(d.withColumn("_blk", F.lit(0).cast("long")), keys, cuts[0], first=True)
    for n in cuts[1:]:
        d = _cut(d, keys, n)
    totals = d.groupBy(*keys, "_blk").agg(*[F.sum(n).alias(f"_b_{n}") for n in names])
    # one row per key and block from here on
    up_to = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offs = totals.select(*keys, "_blk",
                         *[F.coalesce(F.sum(f"_b_{n}").over(up_to), F.lit(0)).alias(f"_o_{n}") for n in names],
                         *[F.sum(f"_b_{n}").over(whole).alias(f"tot_{n}") for n in names])
    inside = Window.partitionBy(*keys, "_blk").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    out = join_on(d, offs, keys + ["_blk"])
    return out.select(*keys, "_v", "_blk", *names,
                      *[(F.col(f"_o_{n}") + F.sum(n).over(inside)).alias(f"cum_{n}") for n in names],
                      *[F.col(f"tot_{n}") for n in names])


def quantiles(df: DataFrame, value: Column, probs: Mapping[str, float], keys: Sequence[str] = (),
              blocks: int | None = None) -> DataFrame:
    """Linear-interpolated exact quantiles, one row per key; also ``n``."""
    c = cumulative_counts(df, value, keys, blocks=blocks)
    start, cum, tot = F.col("cum_n") - F.col("n"), F.col("cum_n"), F.col("tot_n")

    def at(pos):
        return F.max(F.when((start <= pos) & (pos < cum), F.col("_v")))

    aggs = [F.max(tot).alias("n")]
    for name, p in probs.items():
        k = F.lit(float(p)) * (tot - 1)
        aggs += [at(F.floor(k)).alias(f"_lo_{name}"), at(F.ceil(k)).alias(f"_hi_{name}"),
                 F.max(k - F.floor(k)).alias(f"_f_{name}")]
    g = c.groupBy(*keys).agg(*aggs)
    cols = [(F.col(f"_lo_{m}") + (F.col(f"_hi_{m}") - F.col(f"_lo_{m}")) * F.col(f"_f_{m}")).alias(m) for m in probs]
    return g.select(*keys, "n", *cols)


def attach_stats(df: DataFrame, stats: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Add per-key statistics to rows; a one-row table is read as a scalar subquery."""
    if keys:
        return join_on(df, stats.select(*keys, *cols), keys, "left")
    s = stats.select(F.struct(*cols).alias("s")).scalar()
    return df.withColumn("_s", s).select(*df.columns, *[F.col("_s")[c].alias(c) for c in cols])


def median_mad(df: DataFrame, value: Column, keys: Sequence[str] = (), scale: float = 1.4826) -> DataFrame:
    """(keys, med, mad): median and scaled median absolute deviation, two passes by definition."""
    keys = list(keys)
    d = df.select(*keys, value.cast("double").alias("_x"))
    med = quantiles(d, F.col("_x"), {"med": 0.5}, keys)
    dev = attach_stats(d, med, keys, ["med"]).withColumn("_d", F.abs(F.col("_x") - F.col("med")))
    mad = quantiles(dev, F.col("_d"), {"mad": 0.5}, keys).select(*keys, (F.col("mad") * scale).alias("mad"))
    return join_on(med.select(*keys, "med"), mad, keys) if keys else attach_stats(med.select("med"), mad, [], ["mad"])


def average_ranks(df: DataFrame, value: str, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """Attach average-tie ranks (1-based) of ``value`` within keys; null values stay null."""
    keys = list(keys)
    c = cumulative_counts(df, F.col(value), keys)
    r = c.select(*keys, F.col("_v").alias("_rv"), (F.col("cum_n") - (F.col("n") - 1) / 2).alias(name))
    d = df.withColumn("_rv", F.col(value).cast("double"))
    return join_on(d, r, keys + ["_rv"], "left").drop("_rv")
