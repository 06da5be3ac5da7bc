"""Ordered panels: many keyed series in one long DataFrame.

``Panel`` names the key and order columns and hands out window specs.

Two regimes:

* **Bars and other grid-bounded series** (rows per key <= time span / bar width,
  however many ticks a hot key has): a plain ``Window.partitionBy(key)`` is fine.
* **Ticks, orders, snapshots, returns of arbitrary tables** (rows per key grow
  with the data, one key may hold a third of it): ``number_rows`` /
  ``on_chunks`` cut each key into chunks with halo rows so trailing and leading
  frames stay exact, and ``running`` computes cumulative aggregates from
  per-bucket partials plus a carry. No stage sees a whole hot key.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Panel:
    keys: tuple[str, ...] = ("symbol",)
    order: tuple[str, ...] = ("ts",)

    @property
    def w(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def trailing(self, n: int) -> WindowSpec:
        return self.w.rowsBetween(-(n - 1), 0)

    def prior(self, n: int) -> WindowSpec:
        return self.w.rowsBetween(-n, -1)

    def ahead(self, n: int) -> WindowSpec:
        return self.w.rowsBetween(1, n)

    def frame(self, lo: int, hi: int) -> WindowSpec:
        return self.w.rowsBetween(lo, hi)

    @property
    def cum(self) -> WindowSpec:
        return self.w.rowsBetween(Window.unboundedPreceding, 0)

    @property
    def rest(self) -> WindowSpec:
        return self.w.rowsBetween(0, Window.unboundedFollowing)

    @property
    def back(self) -> WindowSpec:
        """The rows of ``rest``, met from the end of the key."""
        return Window.partitionBy(*self.keys).orderBy(*[F.desc(c) for c in self.order]).rowsBetween(Window.unboundedPreceding, 0)

    @property
    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.keys)

    def by(self, *extra: str) -> "Panel":
        return replace(self, keys=self.keys + tuple(extra))


def join_on(left: DataFrame, right: DataFrame, cols, how: str = "inner") -> DataFrame:
    """Equi join that also matches null keys, keeping the left key columns."""
    cols = list(cols)
    r = right.select(*[F.col(c).alias(f"__r_{c}") if c in cols else F.col(c) for c in right.columns])
    cond = reduce(lambda a, b: a & b, [left[c].eqNullSafe(r[f"__r_{c}"]) for c in cols])
    return left.join(r, cond, how).drop(*[f"__r_{c}" for c in cols])


#: estimated rows (``size_estimate``) of one part of ``spread``
SHARE = 100_000


def spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows dealt by key over parts that grow in number with the table, so that a task's sorts stay of one size.

    It stands in for the shuffle that a window over the key makes; plans over small tables are left to that.
    """
    n = size_estimate(df)
    return df.repartition(n // SHARE, *keys) if n > TARGET else df


def frame_parts(df: DataFrame, p: Panel, n: int, sums: Mapping[str, Column] | None = None, tops: Mapping[str, Column] | None = None,
                lows: Mapping[str, Column] | None = None, ramps: Mapping[str, Column] | None = None) -> DataFrame:
    """Sums, maxima and minima of the trailing ``n`` rows, put together from those of shorter frames.

    Spark goes through a trailing frame anew for every row. Here each row first takes the parts of about the square root of n
    rows by ``lag``, and then the frame from such parts, so that a row costs twice that root; nothing is ever subtracted.

    A name of ``sums`` becomes the sum of the values, null without any, and ``<name>_n`` their number. ``ramps`` are sums in
    which the row k rows back counts k times, 0 without values. ``tops`` and ``lows`` are null without values.
    """
    sums, tops, lows, ramps = sums or {}, tops or {}, lows or {}, ramps or {}
    block = max(1, round(math.sqrt(n)))
    starts, rest = range(0, n - block + 1, block), range(n - n % block, n)
    zero = {c: F.coalesce(e.cast("double"), F.lit(0.0)) for c, e in {**sums, **ramps}.items()}
    some = {f"{c}_n": e.isNotNull().cast("int") for c, e in sums.items()}
    ends = {c: (F.greatest, e) for c, e in tops.items()} | {c: (F.least, e) for c, e in lows.items()}
    one = {c: e for c, e in (zero | some | {c: e for c, (_, e) in ends.items()}).items()}
    d = df.withColumns({f"_one_{c}": e for c, e in one.items()})

    def back(c: str, k: int) -> Column:
        name = c[5:]
        default = None if name in ends else 0 if name in some else 0.0
        return F.lag(c, k, default).over(p.w) if k else F.col(c)

    add = lambda xs: reduce(lambda a, b: a + b, xs)
    pick = lambda f, xs: f(*xs) if len(xs) > 1 else xs[0]
    parts = {f"_sum_{c}": add([back(f"_one_{c}", k) for k in range(block)]) for c in zero | some}
    parts |= {f"_rmp_{c}": add([back(f"_one_{c}", k) * float(k) for k in range(block)]) for c in ramps}
    parts |= {f"_end_{c}": pick(f, [back(f"_one_{c}", k) for k in range(block)]) for c, (f, _) in ends.items()}
    d = d.withColumns(parts)
    whole = {c: add([back(f"_sum_{c}", k) for k in starts] + [back(f"_one_{c}", k) for k in rest]) for c in {**{c: None for c in sums}, **some}}
    whole |= {c: add([back(f"_rmp_{c}", k) + back(f"_sum_{c}", k) * float(k) for k in starts] + [back(f"_one_{c}", k) * float(k) for k in rest]) for c in ramps}
    whole |= {c: pick(f, [back(f"_end_{c}", k) for k in starts] + [back(f"_one_{c}", k) for k in rest]) for c, (f, _) in ends.items()}
    d = d.withColumns(whole).withColumns({c: F.when(F.col(f"{c}_n") > 0, F.col(c)) for c in sums}) if sums else d.withColumns(whole)
    return d.drop(*[f"_one_{c}" for c in one], *parts)


def day_bucket(ts: str = "ts") -> Column:
    return F.date_trunc("day", F.col(ts))


def hour_bucket(ts: str = "ts") -> Column:
    return F.date_trunc("hour", F.col(ts))


#: rows that one window partition should hold at most
TARGET = 2_000_000


def size_estimate(df: DataFrame) -> int:
    """Rows that the tables below a plan hold, by their sizes; no job.

    The optimizer's own figure for a plan multiplies through joins and soon means nothing. What the tables hold is right for
    scans, filters and joins on keys, and low by the factor by which a generator or a many-to-many join adds rows.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = 0
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        total += int(leaf.stats().sizeInBytes()) // (8 * max(1, leaf.output().size()))
    return total


def sized(df: DataFrame, panel: Panel, bucket: Column) -> Column:
    """The bucket, cut finer by the leading order column until no (key, bucket) holds more than ``TARGET`` rows.

    Plans over small tables keep the bucket. Larger ones are counted: a bucket with too many rows is
    cut into steps of time (or of a number), each round a quarter of the last, down to single values of the column.
    """
    kind = dict(df.dtypes)[panel.order[0]]
    if size_estimate(df) <= TARGET or not (kind.startswith("timestamp") or kind in ("int", "bigint")):
        return bucket
    x = F.unix_micros(F.col(panel.order[0]).cast("timestamp")) if kind.startswith("timestamp") else F.col(panel.order[0]).cast("bigint")
    fine, step = bucket, None
    while True:
        most = df.groupBy(*panel.keys, fine.alias("_bkt")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= TARGET or step == 1:
            return fine
        if step is None:
            low, high = df.agg(F.min(x), F.max(x)).first()
            step = max(4, int(high - low) // 4096)
        step = max(1, step // 4)
        fine = F.struct(bucket.alias("b"), F.floor(x / step).alias("f"))


def number_rows(df: DataFrame, panel: Panel, bucket: Column, name: str = "_rn") -> DataFrame:
    """Exact 1-based position of each row within its key, without one task per key.

    ``bucket`` is any non-decreasing function of the leading order column. A position is a running
    count (``running``); a bucket that holds too many rows is cut (``sized``).
    """
    return running(df, panel, {name: ("sum", F.lit(1))}, bucket)


def on_chunks(df: DataFrame, panel: Panel, fn: Callable[[DataFrame, Panel], DataFrame], *,
              before: int, bucket: Column | None = None, after: int = 0, rows: int = 50_000, position: str | None = None) -> DataFrame:
    """Run a bounded-frame window operator on chunks of at most ``rows`` + halo rows.

    ``fn(df, panel)`` may look ``before`` rows back and ``after`` rows ahead; rows are
    copied into the neighbouring chunks that need them and the copies dropped afterwards,
    so the result equals running ``fn`` on whole keys. Inside ``fn`` the columns ``_rn``
    (1-based position in the key) and ``_pos`` (0-based position in the chunk) are available.

    ``bucket`` gives the skew-safe row numbering; leave it out only for grid-bounded bars. ``position`` names a
    column that holds the 1-based position already, so that rows needn't be counted again.
    """
    rows = max(rows, before + after, 1)
    if position is not None:
        d = df.withColumn("_rn", F.col(position))
    elif bucket is None:
        d = df.withColumn("_rn", F.row_number().over(panel.w).cast("bigint"))
    else:
        d = number_rows(df, panel, bucket, "_rn")
    pos = F.col("_rn") - 1
    first = F.greatest(F.floor((pos - after) / rows), F.lit(0).cast("bigint"))
    d = (d.withColumn("_home", F.floor(pos / rows))
          .withColumn("_chunk", F.explode(F.sequence(first, F.floor((pos + before) / rows))))
          .withColumn("_pos", (F.col("_rn") - 1 - F.col("_chunk") * rows + before).cast("double")))
    out = fn(d, Panel(panel.keys + ("_chunk",), ("_rn",)))
    return out.where(F.col("_chunk") == F.col("_home")).drop("_chunk", "_home", "_rn", "_pos")


def running(df: DataFrame, panel: Panel, specs: Mapping[str, tuple[str, Column]], bucket: Column,
            reverse: bool = False) -> DataFrame:
    """Cumulative sum / max / min / last-non-null per key from bucket partials plus a carry.

    ``specs`` maps an output name to ``(op, expression)``; the expression must not use
    windows. ``reverse`` scans from the end (``last`` then means "next non-null").

    The carry enters each bucket as a row of its own before all others, so the rows move once and meet no join.
    """
    k = list(panel.keys)
    d = df.withColumn("_bkt", sized(df, panel, bucket))
    names = list(specs)
    for n in names:
        d = d.withColumn(f"_x_{n}", specs[n][1])
    where = F.struct(*panel.order)
    pick = F.min_by if reverse else F.max_by

    def partial(op, c):
        if op == "last":
            return pick(c, F.when(c.isNotNull(), where))
        return {"sum": F.sum, "max": F.max, "min": F.min}[op](c)

    def over(op, c, w):
        if op == "last":
            return F.last(c, ignorenulls=True).over(w)
        return {"sum": F.sum, "max": F.max, "min": F.min}[op](c).over(w)

    parts = d.groupBy(*k, "_bkt").agg(*[partial(specs[n][0], F.col(f"_x_{n}")).alias(f"_p_{n}") for n in names])
    b_ord = F.col("_bkt").desc() if reverse else F.col("_bkt").asc()
    prev = Window.partitionBy(*k).orderBy(b_ord).rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select(*k, "_bkt", *[over(specs[n][0], F.col(f"_p_{n}"), prev).alias(f"_c_{n}") for n in names])
    o = [F.col(c).desc() if reverse else F.col(c).asc() for c in panel.order]
    inside = Window.partitionBy(*k, "_bkt").orderBy("_own", *o).rowsBetween(Window.unboundedPreceding, 0)
    kinds = carry.schema
    d = d.select("*", F.lit(1).alias("_own"), *[F.lit(None).cast(kinds[f"_c_{n}"].dataType).alias(f"_c_{n}") for n in names])
    heads = carry.withColumn("_own", F.lit(0))
    kinds = d.schema
    out = d.unionByName(heads.select(*[F.col(c) if c in heads.columns else F.lit(None).cast(kinds[c].dataType).alias(c) for c in d.columns]))
    out = out.select("*", *[over(specs[n][0], F.col(f"_x_{n}"), inside).alias(f"_l_{n}") for n in names], *[F.first(f"_c_{n}").over(inside).alias(f"_h_{n}") for n in names]).where("_own = 1")
    for n in names:
        op = specs[n][0]
        local, c = F.col(f"_l_{n}"), F.col(f"_h_{n}")
        if op == "sum":
            v = F.coalesce(local, F.lit(0)) + F.coalesce(c, F.lit(0))
        elif op == "last":
            v = F.coalesce(local, c)
        else:
            v = (F.greatest if op == "max" else F.least)(local, c)
        out = out.withColumn(n, v)
    return out.drop("_bkt", "_own", *[f"_{a}_{n}" for n in names for a in "xclh"])


def islands(df: DataFrame, panel: Panel, label: Column, name: str = "island") -> DataFrame:
    """Number runs of equal ``label`` within each key from 1: running count of starts."""
    lag = F.lag(label).over(panel.w)
    change = F.when(lag.isNull() & F.lag(F.lit(1)).over(panel.w).isNull(), 1).when(~label.eqNullSafe(lag), 1).otherwise(0)
    return (df.withColumn("_chg", change)
              .withColumn(name, F.sum("_chg").over(panel.cum)).drop("_chg"))
