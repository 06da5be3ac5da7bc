"""Calendar, session and interval-name expressions."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def calendar_features(ts: str = "ts") -> list[Column]:
    t = F.col(ts)
    dow = F.weekday(t)
    b = lambda c: c.cast("int")
    return [
        F.hour(t).alias("hour"), dow.alias("day_of_week"), F.dayofmonth(t).alias("day_of_month"),
        F.month(t).alias("month"), F.quarter(t).alias("quarter"), F.year(t).alias("year"),
        b(dow >= 5).alias("is_weekend"), b(F.dayofmonth(t) == 1).alias("is_month_start"),
        b(F.to_date(t) == F.last_day(t)).alias("is_month_end"),
        b((F.dayofmonth(t) == 1) & (F.month(t) % 3 == 1)).alias("is_quarter_start"),
        b((F.to_date(t) == F.last_day(t)) & (F.month(t) % 3 == 0)).alias("is_quarter_end"),
    ]


def cyclic_features(ts: str = "ts") -> list[Column]:
    t = F.col(ts)
    h = (F.hour(t) + F.minute(t) / 60.0) * (2 * math.pi / 24)
    d = F.weekday(t) * (2 * math.pi / 7)
    w = F.weekofyear(t) * (2 * math.pi / 52)
    return [F.sin(h).alias("hour_sin"), F.cos(h).alias("hour_cos"), F.sin(d).alias("dow_sin"), F.cos(d).alias("dow_cos"),
            F.sin(w).alias("week_sin"), F.cos(w).alias("week_cos"), ((F.month(t) - 1) / 11.0).alias("month_norm")]


def trading_session(ts: str = "ts") -> Column:
    """0 Asia (<8 UTC), 1 Europe (<16), 2 US (<22), 3 overnight."""
    h = F.hour(F.col(ts))
    return F.when(h < 8, 0).when(h < 16, 1).when(h < 22, 2).otherwise(3)


def weekday_fraction(ts: str = "ts") -> Column:
    return F.weekday(F.col(ts)) / 7.0


def round_ts(ts: str, seconds: int) -> Column:
    s = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    return F.timestamp_seconds(F.round(s / seconds) * seconds)


# minutes per interval unit
UNIT_MINUTES = {"m": 1, "h": 60, "d": 1440, "w": 10080}


def interval_minutes(c: str | Column) -> Column:
    """'15m', '4h', '1d', '1w' to minutes; null when malformed."""
    c = F.lower(F.trim(F.col(c) if isinstance(c, str) else c))
    n = F.regexp_extract(c, r"^(\d+)([mhdw])$", 1)
    u = F.regexp_extract(c, r"^(\d+)([mhdw])$", 2)
    factor = F.lit(None)
    for k, v in UNIT_MINUTES.items():
        factor = F.when(u == k, v).otherwise(factor)
    return F.when(n != "", n.try_cast("bigint") * factor)


def normalize_symbol(c: str | Column) -> Column:
    """Upper-case, separators removed; null unless 2-20 letters and digits."""
    c = F.col(c) if isinstance(c, str) else c
    s = F.upper(F.regexp_replace(F.trim(c), r"[-_/ ]", ""))
    return F.when(s.rlike(r"^[A-Z0-9]{2,20}$"), s)


def parse_count(c: str | Column) -> Column:
    """'1.2M', '500K', '3b' to integer; malformed to 0."""
    c = F.upper(F.trim(F.col(c) if isinstance(c, str) else c))
    n = F.regexp_extract(c, r"^([0-9]+(?:\.[0-9]+)?)([KMB]?)$", 1).try_cast("double")
    u = F.regexp_extract(c, r"^([0-9]+(?:\.[0-9]+)?)([KMB]?)$", 2)
    f = F.when(u == "K", 1e3).when(u == "M", 1e6).when(u == "B", 1e9).otherwise(1.0)
    return F.coalesce(F.floor(n * f).cast("bigint"), F.lit(0).cast("bigint"))
