"""As-of and nearest joins as union + carried last value: one shuffle, no range explosion."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.plans.panel import Panel, running


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], ts: str, payload: Sequence[str], *,
              bucket: Column, direction: str = "backward", tie: Sequence[str] = (),
              tolerance_seconds: float | None = None, prefix: str = "") -> DataFrame:
    """For each left row the right row of the same key that is last at or before it
    (``backward``), first at or after it (``forward``) or closest (``nearest``, earlier wins ties).

    ``tie`` orders right rows sharing a time. Unmatched left rows keep null payload.
    """
    keys, payload, tie = list(keys), list(payload), list(tie)
    item = F.struct(F.col(ts).alias("_t"), *[F.col(c) for c in payload])
    lt = left.withColumn("_row", F.struct(*left.columns)).select(*keys, ts, "_row")
    types = dict((f.name, f.dataType) for f in right.schema.fields)
    lt = lt.select("*", *[F.lit(None).cast(types[c]).alias(c) for c in tie if c not in keys + [ts]])
    rt = right.select(*keys, ts, F.lit(None).cast(lt.schema["_row"].dataType).alias("_row"), item.alias("_item"),
                      *[c for c in tie if c not in keys + [ts]])
    tie_cols = [c for c in tie if c not in keys + [ts]]

    def scan(d, side, out, reverse):
        both = lt.select(*keys, ts, "_row", F.lit(None).cast(rt.schema["_item"].dataType).alias("_item"),
                         F.lit(side).alias("_side"), *tie_cols) if d is None else d
        both = both.unionByName(rt.select(*keys, ts, "_row", "_item", F.lit(0).alias("_side"), *tie_cols))
        return running(both, Panel(tuple(keys), (ts, "_side", *tie_cols)), {out: ("last", F.col("_item"))},
                       bucket, reverse=reverse).where(F.col("_row").isNotNull())

    # left rows sort after equal-time right rows going back, before them going forward
    if direction == "backward":
        d = scan(None, 1, "_m", False)
    elif direction == "forward":
        d = scan(None, -1, "_m", True)
    else:
        b = scan(None, 1, "_prev", False)
        both = b.withColumn("_side", F.lit(-1)).withColumn("_item", F.lit(None).cast(rt.schema["_item"].dataType))
        r2 = rt.select(*keys, ts, "_row", "_item", F.lit(0).alias("_side"), *tie_cols)
        both = both.unionByName(r2, allowMissingColumns=True)
        d = running(both, Panel(tuple(keys), (ts, "_side", *tie_cols)), {"_next": ("last", F.col("_item"))},
                    bucket, reverse=True).where(F.col("_row").isNotNull())
        gap = lambda c: F.abs(F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col(c)["_t"].cast("timestamp")))
        use_next = F.col("_prev").isNull() | (F.col("_next").isNotNull() & (gap("_next") < gap("_prev")))
        d = d.withColumn("_m", F.when(use_next, F.col("_next")).otherwise(F.col("_prev")))
    if tolerance_seconds is not None:
        far = F.abs(F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_m")["_t"].cast("timestamp")))
        d = d.withColumn("_m", F.when(far <= int(tolerance_seconds * 1e6), F.col("_m")))
    return d.select("_row.*", F.col("_m")["_t"].alias(f"{prefix}match_ts"),
                    *[F.col("_m")[c].alias(f"{prefix}{c}") for c in payload])
