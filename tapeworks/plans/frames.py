"""Trailing time frames on keys of any size.

A range frame of Spark reads its rows anew for each row, so its work grows with the square of the rows in a frame. Here each
key is cut into slices of time, rows are copied into the later slices whose frames reach back to them, and inside a slice
frames are index ranges of the sorted rows: sums, minima and maxima come from a tree of partial results and counts above a
limit from ranks by bit, so a row costs the logarithm of its slice.
"""
from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

#: length of a slice in frames
WINDOWS = 4


def fold(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, op: np.ufunc, start: float) -> np.ndarray:
    """``op`` over values[lo:hi] per frame, ``start`` where empty; partial results are of whole frames' parts only, never differences."""
    out, lo, hi = np.full(len(lo), start, values.dtype), lo.copy(), hi.copy()
    while len(values):
        live = lo < hi
        if not live.any():
            break
        m = np.flatnonzero(live & (lo & 1 == 1))
        out[m] = op(out[m], values[lo[m]])
        lo[m] += 1
        m = np.flatnonzero((lo < hi) & (hi & 1 == 1))
        hi[m] -= 1
        out[m] = op(out[m], values[hi[m]])
        lo, hi = lo >> 1, hi >> 1
        if len(values) & 1:
            values = np.append(values, values.dtype.type(start))
        values = op(values[::2], values[1::2])
    return out


def counts(marks: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Marked rows per frame."""
    c = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
    return c[hi] - c[lo]


def count_above(values: np.ndarray, known: np.ndarray, limit: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Known values above the frame's own limit; NaN is above every number and not above NaN."""
    have = np.unique(values[known])
    ranks = np.where(known, np.searchsorted(have, values) + 1, 0)
    cut = np.searchsorted(have, limit, "right") + 1
    below, lo, hi = np.zeros(len(lo), np.int64), lo.copy(), hi.copy()
    size = hi - lo
    for bit in reversed(range(int(len(have) + 1).bit_length())):
        one = (ranks >> bit) & 1 == 1
        zeros = np.concatenate([[0], np.cumsum(~one)])
        up = (cut >> bit) & 1 == 1
        zl, zh = zeros[lo], zeros[hi]
        below += np.where(up, zh - zl, 0)
        lo, hi = np.where(up, zeros[-1] + lo - zl, zl), np.where(up, zeros[-1] + hi - zh, zh)
        ranks = np.concatenate([ranks[~one], ranks[one]])
    return size - below


def numbers(t: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """A column as doubles with zero for null, and which rows are not null."""
    c = t[name].combine_chunks()
    known = pc.is_valid(c).to_numpy(zero_copy_only=False)
    return c.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False), known


def sums(t: pa.Table, name: str, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    """Sum of the known values per frame, null where there are none."""
    x, known = numbers(t, name)
    return pa.array(fold(x, lo, hi, np.add, 0.0), mask=counts(known, lo, hi) == 0)


def trailing(df: DataFrame, keys: Sequence[str], reach: int, calc: Callable[[pa.Table, np.ndarray, np.ndarray], Mapping[str, pa.Array]],
             out: Mapping[str, DataType], *, ts: str = "ts", tie: Sequence[str] = (), asks: Column | None = None,
             seen: Column | None = None, timeless: bool = False) -> DataFrame:
    """Rows with columns ``out`` (name to type) of the rows of their key at most ``reach`` microseconds before, peers included.

    ``calc`` gets a slice's rows in order of ``ts`` and ``tie`` and the frames as index ranges. Only rows of ``asks`` are
    returned and only rows of ``seen`` lie in frames of later slices (all, if not given; a row of neither is dropped).
    Rows without a time are dropped, or with ``timeless`` are each other's frame.
    """
    width = WINDOWS * max(reach, 1)
    always = F.lit(True)
    d = df.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("_asks", F.coalesce(always if asks is None else asks, F.lit(False)))
    d = d.withColumn("_seen", F.coalesce(always if seen is None else seen, F.lit(False))).where("_asks OR _seen")
    home = F.floor(F.col("_us") / width)
    last = F.when(F.col("_seen"), F.floor((F.col("_us") + reach) / width)).otherwise(home)
    slices = F.sequence(home, last)
    if timeless:
        slices = F.coalesce(slices, F.array(F.lit(None).cast("bigint")))
    d = d.withColumn("_slice", F.explode(slices)).withColumn("_asks", F.col("_asks") & home.eqNullSafe(F.col("_slice"))).drop("_seen")
    names, types = df.columns, StructType(df.schema.fields + [StructField(n, kind) for n, kind in out.items()])
    order = [("_us", "ascending"), *[(c, "ascending") for c in tie]]

    def frames(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, sort_keys=order, null_placement="at_start"))
        us = t["_us"].combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(t["_asks"].combine_chunks().to_numpy(zero_copy_only=False))
        got = calc(t, np.searchsorted(us, us[at] - reach, "left"), np.searchsorted(us, us[at], "right"))
        rows = t.select(names).take(pa.array(at))
        return pa.table([*rows.columns, *[got[n] for n in out]], names=[*names, *out])

    return d.groupBy(*keys, "_slice").applyInArrow(frames, types)
