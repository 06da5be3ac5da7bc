"""Repeatable pseudo-random columns: a hash of stable ids, so a lost and recomputed task draws the same rows."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_uniform(seed: int, *cols) -> Column:
    """Uniform [0, 1) from 32 bits of md5(seed|ids)."""
    parts = [F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("double") / float(2 ** 32)


def hash_index(n, seed: int, *cols) -> Column:
    """Integer in [0, n)."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.floor(hash_uniform(seed, *cols) * n)
