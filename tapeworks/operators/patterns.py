"""Swing pivots, harmonic and wave patterns, support/resistance levels and volume profiles over bars.

Pivots thin the bars to a few rows per key; patterns are ``lead`` windows over pivots and rule
tables are fixed arrays exploded in place. Bars bound every window (see ``plans.panel``).
"""
from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.mathx import ratio, safe_div
from tapeworks.plans.panel import Panel, join_on
from tapeworks.session import ensure_checkpoint_dir

PANEL = Panel()

# pattern: (AB low, AB high, BC low, BC high, CD low, CD high, XD low, XD high) — fixed values
HARMONIC_RULES = {
    "gartley": (0.618, 0.618, 0.382, 0.886, 1.272, 1.618, 0.786, 0.786),
    "bat": (0.382, 0.50, 0.382, 0.886, 1.618, 2.618, 0.886, 0.886),
    "butterfly": (0.786, 0.786, 0.382, 0.886, 1.618, 2.618, 1.272, 1.618),
    "crab": (0.382, 0.618, 0.382, 0.886, 2.24, 3.618, 1.618, 1.618),
    "shark": (1.13, 1.618, 1.618, 2.24, 0.886, 1.13, 0.886, 1.13),
    "cypher": (0.382, 0.618, 1.272, 1.414, 1.272, 2.00, 0.786, 0.786),
}
RETRACEMENTS = (0.236, 0.382, 0.5, 0.618, 0.786)


def swings(df: DataFrame, w: int = 3, p: Panel = PANEL) -> DataFrame:
    """Strict extremes of high / low within +-w bars: kind 1 = high, -1 = low."""
    h = (F.col("high") > F.max("high").over(p.frame(-w, -1))) & (F.col("high") > F.max("high").over(p.frame(1, w)))
    l = (F.col("low") < F.min("low").over(p.frame(-w, -1))) & (F.col("low") < F.min("low").over(p.frame(1, w)))
    pos = F.row_number().over(p.w).alias("pos")
    d = df.select(*p.keys, *p.order, "high", "low", pos, h.alias("_h"), l.alias("_l"))
    pts = F.array_compact(F.array(F.when(F.col("_h"), F.struct(F.lit(1).alias("kind"), F.col("high").alias("price"))),
                                  F.when(F.col("_l"), F.struct(F.lit(-1).alias("kind"), F.col("low").alias("price")))))
    return d.select(*p.keys, *p.order, "pos", F.explode(pts).alias("s")).select(*p.keys, *p.order, "pos", "s.kind", "s.price")


def _lead_points(sw: DataFrame, names: Sequence[str], p: Panel) -> DataFrame:
    w = Window.partitionBy(*p.keys).orderBy(*p.order, "kind")
    item = F.struct(*p.order, "pos", "kind", "price")
    d = sw.select(*p.keys, *p.order, "kind", *[(F.lead(item, i).over(w) if i else item).alias(n) for i, n in enumerate(names)])
    return d.where(F.col(names[-1]).isNotNull()).drop(*p.order, "kind")


def xabcd(sw: DataFrame, p: Panel = PANEL) -> DataFrame:
    """Five consecutive swings with leg ratios AB/XA, BC/AB, CD/BC, XD/XA."""
    d = _lead_points(sw, ["X", "A", "B", "C", "D"], p)
    leg = lambda a, b: F.abs(F.col(f"{b}.price") - F.col(f"{a}.price"))
    return (d.withColumn("ab", safe_div(leg("A", "B"), leg("X", "A"))).withColumn("bc", safe_div(leg("B", "C"), leg("A", "B")))
             .withColumn("cd", safe_div(leg("C", "D"), leg("B", "C"))).withColumn("xd", safe_div(leg("X", "D"), leg("X", "A"))))


def harmonic_matches(cand: DataFrame, tolerance: float = 0.05, rules: dict | None = None) -> DataFrame:
    """Candidates inside a rule's ratio ranges, with confidence, reversal zone, stop, targets and risk/reward."""
    rules = rules or HARMONIC_RULES
    table = F.array(*[F.struct(F.lit(n).alias("pattern"), F.array(*[F.lit(float(x)) for x in v]).alias("b")) for n, v in rules.items()])
    d = cand.withColumn("_r", F.explode(table)).withColumn("pattern", F.col("_r.pattern"))
    b = lambda i: F.col("_r.b")[i]
    ok, dev = F.lit(True), F.lit(0.0)
    for i, c in enumerate(("ab", "bc", "cd", "xd")):
        ok = ok & (F.col(c) >= b(2 * i) * (1 - tolerance)) & (F.col(c) <= b(2 * i + 1) * (1 + tolerance))
        m = (b(2 * i) + b(2 * i + 1)) / 2
        dev = dev + F.abs(F.col(c) - m) / m
    d = d.where(ok).withColumn("confidence", F.greatest(F.least(1 - dev / 4, F.lit(1.0)), F.lit(0.0))).drop("_r")
    px, pd_, pa = F.col("X.price"), F.col("D.price"), F.col("A.price")
    bull = F.col("D.kind") == -1
    buf, sgn = 0.1 * F.abs(px - pd_), F.when(bull, 1.0).otherwise(-1.0)
    d = d.withColumn("direction", F.when(bull, "bullish").otherwise("bearish")).withColumn("zone_low", pd_ * 0.95).withColumn("zone_high", pd_ * 1.05).withColumn("entry", pd_)
    d = d.withColumn("stop", px - sgn * buf)
    for n, k in (("target_1", 0.382), ("target_2", 0.618), ("target_3", 1.0)):
        d = d.withColumn(n, pd_ + sgn * k * F.abs(pa - pd_))
    return d.withColumn("risk_reward", safe_div(F.abs(F.col("target_1") - F.col("entry")), F.abs(F.col("entry") - F.col("stop"))))


def score_patterns(matches: DataFrame, bars: DataFrame, n: int = 20, weights: tuple = (0.5, 0.2, 0.15, 0.15), p: Panel = PANEL) -> DataFrame:
    """Overall strength: ratio confidence, time symmetry of legs, volume confirmation at D and risk/reward, weighted."""
    v = bars.select(*p.keys, F.col("ts").alias("_ts"), ratio("volume", F.avg("volume").over(p.trailing(n))).alias("volume_ratio"))
    j = join_on(matches.withColumn("_ts", F.col("D.ts")), v, [*p.keys, "_ts"], "left").drop("_ts")
    t1, t2 = (F.col("B.pos") - F.col("X.pos")).cast("double"), (F.col("D.pos") - F.col("B.pos")).cast("double")
    j = j.withColumn("symmetry", F.least(t1, t2) / F.greatest(t1, t2))
    a, b, c, d = weights
    return j.withColumn("strength", a * F.col("confidence") + b * F.col("symmetry") + c * F.least(F.col("volume_ratio") / 2, F.lit(1.0)) + d * F.least(F.col("risk_reward") / 3, F.lit(1.0)))


def pattern_outcomes(matches: DataFrame, bars: DataFrame, look: int = 50, p: Panel = PANEL) -> DataFrame:
    """hit_1..3 and stopped within ``look`` bars after D, from forward max / min joined at D."""
    f = p.frame(1, look)
    ext = bars.select(*p.keys, F.col("ts").alias("_ts"), F.max("high").over(f).alias("_mx"), F.min("low").over(f).alias("_mn"))
    j = join_on(matches.withColumn("_ts", F.col("D.ts")), ext, [*p.keys, "_ts"], "left")
    bull = F.col("direction") == "bullish"
    z = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    for i in (1, 2, 3):
        j = j.withColumn(f"hit_{i}", z(F.when(bull, F.col("_mx") >= F.col(f"target_{i}")).otherwise(F.col("_mn") <= F.col(f"target_{i}"))))
    return j.withColumn("stopped", z(F.when(bull, F.col("_mn") <= F.col("stop")).otherwise(F.col("_mx") >= F.col("stop")))).drop("_ts", "_mx", "_mn")


def filter_patterns(matches: DataFrame, confidence: float = 0.7, risk_reward: float = 1.0) -> DataFrame:
    return matches.where((F.col("confidence") >= confidence) & (F.col("risk_reward") >= risk_reward))


# -- waves --------------------------------------------------------------------------------

def _leg(i: int, j: int) -> Column:
    return F.abs(F.col(f"p{j}.price") - F.col(f"p{i}.price"))


def _alternates(n: int) -> Column:
    c = F.lit(True)
    for i in range(n - 1):
        c = c & (F.col(f"p{i}.kind") != F.col(f"p{i + 1}.kind"))
    return c


def nearest_fib(x: Column) -> Column:
    """(closest Fibonacci ratio, accuracy)."""
    levels = F.array(*[F.lit(v) for v in (0.382, 0.618, 1.0, 1.272, 1.618, 2.618)])
    best = F.array_min(F.transform(levels, lambda l: F.struct(F.abs(l - x).alias("g"), l.alias("l"))))["l"]
    return F.struct(best.alias("ratio"), (1 - F.abs(x - best) / best).alias("accuracy"))


def impulse_waves(sw: DataFrame, p: Panel = PANEL) -> DataFrame:
    """Six alternating pivots obeying: wave 2 keeps the start, wave 3 not shortest, wave 4 clear of wave 1, wave 3 beyond wave 1."""
    d = _lead_points(sw, [f"p{i}" for i in range(6)], p).where(_alternates(6))
    up = F.col("p0.kind") == -1
    s = F.when(up, 1.0).otherwise(-1.0)
    px = lambda i: s * F.col(f"p{i}.price")
    w1, w2, w3, w4, w5 = (_leg(i, i + 1) for i in range(5))
    ok = (px(2) > px(0)) & (px(3) > px(1)) & (px(4) > px(1)) & (px(5) > px(4)) & (w3 > F.least(w1, w5))
    d = d.where(ok).withColumn("direction", F.when(up, "bullish").otherwise("bearish")).withColumn("retrace_2", ratio(w2, w1)).withColumn("retrace_4", ratio(w4, w3))
    d = d.withColumn("ratio_3_1", ratio(w3, w1)).withColumn("ratio_5_1", ratio(w5, w1)).withColumn("fib_3_1", nearest_fib(F.col("ratio_3_1"))).withColumn("alternation", (F.abs(F.col("retrace_2") - F.col("retrace_4")) > .1).cast("int"))
    conf = 0.4 + 0.2 * F.greatest(F.col("fib_3_1.accuracy"), F.lit(0.0)) + 0.2 * F.col("alternation") + 0.1 * F.col("retrace_2").between(.382, .786).cast("int") + 0.1 * F.col("retrace_4").between(.236, .5).cast("int")
    end = F.col("p5.price")
    move = F.abs(F.col("p5.price") - F.col("p0.price"))
    return d.withColumn("confidence", conf).withColumn("target_382", end - s * 0.382 * move).withColumn("target_618", end - s * 0.618 * move)


def corrective_waves(sw: DataFrame, p: Panel = PANEL) -> DataFrame:
    """Four alternating pivots A-B-C: zigzag (B retraces 38.2-78.6 %, C beyond A) or flat (B 90-110 %)."""
    d = _lead_points(sw, [f"p{i}" for i in range(4)], p).where(_alternates(4))
    a, b, c = _leg(0, 1), _leg(1, 2), _leg(2, 3)
    d = d.withColumn("b_ratio", safe_div(b, a)).withColumn("c_ratio", safe_div(c, a))
    s = F.when(F.col("p1.price") > F.col("p0.price"), 1.0).otherwise(-1.0)
    zig = F.col("b_ratio").between(.382, .786) & (s * F.col("p3.price") > s * F.col("p1.price"))
    flat = F.col("b_ratio").between(.9, 1.1) & F.col("c_ratio").between(.9, 1.382)
    return d.withColumn("kind", F.when(zig, "zigzag").when(flat, "flat")).where("kind is not null").withColumn("direction", F.when(s > 0, "bullish").otherwise("bearish"))


def five_leg_patterns(sw: DataFrame, p: Panel = PANEL) -> DataFrame:
    """Six pivots: contracting / expanding triangles and ending diagonals (overlapping, shrinking legs)."""
    d = _lead_points(sw, [f"p{i}" for i in range(6)], p).where(_alternates(6))
    w = [_leg(i, i + 1) for i in range(5)]
    contract = (w[0] > w[1]) & (w[1] > w[2]) & (w[2] > w[3]) & (w[3] > w[4])
    expand = (w[0] < w[1]) & (w[1] < w[2]) & (w[2] < w[3]) & (w[3] < w[4])
    s = F.when(F.col("p0.kind") == -1, 1.0).otherwise(-1.0)
    px = lambda i: s * F.col(f"p{i}.price")
    diagonal = (px(3) > px(1)) & (px(5) > px(3)) & (px(4) < px(1)) & (px(4) > px(2)) & (w[2] < w[0]) & (w[4] < w[2])
    return d.withColumn("kind", F.when(contract, "triangle_contracting").when(expand, "triangle_expanding").when(diagonal, "diagonal")).where("kind is not null")


def rank_wave_counts(counts: DataFrame, p: Panel = PANEL, k: int = 5) -> DataFrame:
    """Best and alternative counts per key by confidence, later completion first on ties."""
    w = Window.partitionBy(*p.keys).orderBy(F.desc("confidence"), F.desc("end_ts"), "start_ts")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# -- levels -------------------------------------------------------------------------------

def pivot_levels(df: DataFrame, p: Panel = PANEL) -> DataFrame:
    """Long table (ts, method, level_name, price) of classical, Fibonacci, Camarilla and Woodie levels from the prior bar."""
    h, l, c = (F.lag(x).over(p.w) for x in ("high", "low", "close"))
    d = df.select(*p.keys, *p.order, h.alias("h"), l.alias("l"), c.alias("c")).where(F.col("h").isNotNull())
    H, L, C = F.col("h"), F.col("l"), F.col("c")
    rg, pv, wd = H - L, (H + L + C) / 3, (H + L + 2 * C) / 4
    items = [("classical", "pivot", pv), ("classical", "r1", 2 * pv - L), ("classical", "s1", 2 * pv - H), ("classical", "r2", pv + rg), ("classical", "s2", pv - rg), ("classical", "r3", H + 2 * (pv - L)), ("classical", "s3", L - 2 * (H - pv)),
             ("woodie", "pivot", wd), ("woodie", "r1", 2 * wd - L), ("woodie", "s1", 2 * wd - H), ("woodie", "r2", wd + rg), ("woodie", "s2", wd - rg)]
    for i, k in enumerate((0.382, 0.618, 1.0), 1):
        items += [("fibonacci", f"r{i}", pv + k * rg), ("fibonacci", f"s{i}", pv - k * rg)]
    for i, k in enumerate((12, 6, 4, 2), 1):
        items += [("camarilla", f"r{i}", C + rg * 1.1 / k), ("camarilla", f"s{i}", C - rg * 1.1 / k)]
    arr = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(n).alias("level_name"), e.alias("price")) for m, n, e in items])
    return d.select(*p.keys, *p.order, F.explode(arr).alias("x")).select(*p.keys, *p.order, "x.*")


def volume_profile(df: DataFrame, bins: int = 24, keys: Sequence[str] = ("symbol",), share: float = 0.7) -> DataFrame:
    """Bar volume spread over equal price bins by overlap; flags poc, value_area (largest bins up to ``share``), hvn (> 1.5 x mean)."""
    k = list(keys)
    g = df.groupBy(*k).agg(F.min("low").alias("_lo"), F.max("high").alias("_hi"))
    d = join_on(df.select(*k, "high", "low", "volume"), g, k).withColumn("_w", F.when(F.col("_hi") > F.col("_lo"), (F.col("_hi") - F.col("_lo")) / bins).otherwise(1.0))
    at = lambda c: F.least(F.floor((F.col(c) - F.col("_lo")) / F.col("_w")), F.lit(bins - 1))
    d = d.withColumn("bin", F.explode(F.sequence(at("low"), at("high"))))
    b0, b1 = F.col("_lo") + F.col("bin") * F.col("_w"), F.col("_lo") + (F.col("bin") + 1) * F.col("_w")
    frac = F.when(F.col("high") > F.col("low"), F.greatest(F.least(F.col("high"), b1) - F.greatest(F.col("low"), b0), F.lit(0.0)) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0))).otherwise(1.0)
    prof = d.groupBy(*k, "bin").agg(F.sum(F.col("volume") * frac).alias("volume"), F.first(b0).alias("low"), F.first(b1).alias("high"))
    w = Window.partitionBy(*k).orderBy(F.desc("volume"), "bin")
    whole = Window.partitionBy(*k)
    before = F.coalesce(F.sum("volume").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return prof.select(*k, "bin", "low", "high", "volume", (F.row_number().over(w) == 1).cast("int").alias("poc"), (before < share * F.sum("volume").over(whole)).cast("int").alias("value_area"), (F.col("volume") > 1.5 * F.avg("volume").over(whole)).cast("int").alias("hvn"))


def smoothed_peaks(df: DataFrame, w: int = 3, c: str = "close", p: Panel = PANEL) -> DataFrame:
    """Peaks and troughs of the Gaussian(1)-smoothed series (weights renormalized at the ends)."""
    num, den = F.lit(0.0), F.lit(0.0)
    for k in range(-4, 5):
        g = math.exp(-k * k / 2)
        x = F.col(c) if k == 0 else F.lag(c, -k).over(p.w) if k < 0 else F.lead(c, k).over(p.w)
        num, den = num + F.coalesce(x, F.lit(0.0)) * g, den + F.when(x.isNotNull(), g).otherwise(0.0)
    d = df.select(*p.keys, *p.order, c, (num / den).alias("_s"))
    edge = (F.count("_s").over(p.frame(-w, -1)) == w) & (F.count("_s").over(p.frame(1, w)) == w)
    hi = (F.col("_s") > F.max("_s").over(p.frame(-w, -1))) & (F.col("_s") > F.max("_s").over(p.frame(1, w)))
    lo = (F.col("_s") < F.min("_s").over(p.frame(-w, -1))) & (F.col("_s") < F.min("_s").over(p.frame(1, w)))
    kind = F.when(edge & hi, "resistance").when(edge & lo, "support")
    return d.select(*p.keys, *p.order, F.col(c).alias("price"), kind.alias("kind")).where("kind is not null")


def level_touches(levels: DataFrame, bars: DataFrame, tolerance: float = 0.001, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Count of bars whose high or low lies within tolerance of a level: equi join on log-price buckets and their neighbours."""
    k, step = list(keys), math.log1p(tolerance)
    bk = lambda c: F.floor(F.ln(c) / step)
    lv = levels.withColumn("_b", F.explode(F.array(*[bk(F.col("price")) + i for i in (-2, -1, 0, 1, 2)])))
    pts = bars.select(*k, F.col("ts").alias("_ts"), F.explode(F.array_distinct(F.array("high", "low"))).alias("_p")).withColumn("_b", bk(F.col("_p")))
    j = join_on(lv, pts, [*k, "_b"]).where(F.abs(F.col("_p") - F.col("price")) <= tolerance * F.col("price"))
    t = j.groupBy(*levels.columns).agg(F.count_distinct("_ts").alias("touches"))
    return join_on(levels, t, levels.columns, "left").fillna(0, ["touches"])


def psychological_levels(df: DataFrame, c: str = "close", span: float = 0.1, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Round numbers within +-span of the latest price; the step is a tenth of its power of ten."""
    last = df.groupBy(*keys).agg(F.max_by(c, "ts").alias("last"))
    d = last.withColumn("_st", F.pow(F.lit(10.0), F.floor(F.log10("last")) - 1))
    n = F.sequence(F.ceil(F.col("last") * (1 - span) / F.col("_st")), F.floor(F.col("last") * (1 + span) / F.col("_st")))
    d = d.withColumn("_n", F.explode(n)).withColumn("price", F.col("_n") * F.col("_st"))
    st = F.when(F.col("_n") % 10 == 0, 1.0).when(F.col("_n") % 5 == 0, 0.7).otherwise(0.4)
    return d.select(*keys, "last", "price", st.alias("strength"))


def merge_zones(levels: DataFrame, threshold: float = 0.005, minimum: int = 2, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Confluence zones: levels sorted by price join while within threshold of the zone's first level.

    The distance is to the zone start, so a key's levels (a few per bar method) are walked in order.
    """
    k = list(keys)
    kf = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in levels.select(*k).schema.fields)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("price")
        zones, start = [], None
        for price, strength in zip(pdf["price"], pdf["strength"]):
            if start is None or price > start * (1 + threshold):
                start = price
                zones.append([price, price, 0.0, 0])
            z = zones[-1]
            z[1], z[2], z[3] = price, z[2] + strength, z[3] + 1
        out = pd.DataFrame(zones, columns=["low", "high", "strength", "n"])
        out = out[out["n"] >= minimum]
        for c in k:
            out[c] = pdf[c].iloc[0]
        out["strength"] = (out["strength"] / out["n"] * (1 + 0.1 * (out["n"] - 1))).clip(upper=1.0)
        return out[[*k, "low", "high", "strength", "n"]]

    return levels.select(*k, "price", F.col("strength").cast("double").alias("strength")).groupBy(*k).applyInPandas(walk, f"{kf}, low double, high double, strength double, n int")


def nearest_levels(levels: DataFrame, n: int = 5, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Closest n supports (below) and resistances (above) of the ``last`` price."""
    d = levels.withColumn("side", F.when(F.col("price") < F.col("last"), "support").otherwise("resistance")).withColumn("distance", F.abs(F.col("price") - F.col("last")))
    w = Window.partitionBy(*keys, "side").orderBy("distance", "price")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def validate_levels(levels: DataFrame, bars: DataFrame, tolerance: float = 0.01, min_touches: int = 2, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Touches, bounces and breaks after a level's time; valid when touched enough, accuracy >= .5 and holding score >= 60.

    Levels meet all bars of their key where ``p.w`` has put them, so bars move no further than for the window; pairs are
    only tested, never kept. Keys with a null, which an equi join can't match that way, are joined apart.
    """
    k = list(keys)
    p = Panel(tuple(k), ("ts",))
    b = bars.select(*k, "ts", "high", "low", "close", F.lead("close").over(p.w).alias("_nc"))
    lv = levels.select(*k, F.col("ts").alias("level_ts"), "price", "kind")
    some = reduce(lambda x, y: x | y, [F.col(c).isNull() for c in k])
    return _validated(lv.where(~some).join(b.where(~some), k), tolerance, min_touches, k).unionByName(
        _validated(join_on(lv.where(some), b.where(some), k), tolerance, min_touches, k))


def _validated(j: DataFrame, tolerance: float, min_touches: int, k: list[str]) -> DataFrame:
    """What ``validate_levels`` returns, from pairs of a level and a bar of its key."""
    L, up = F.col("price"), F.col("kind") == "support"
    j = j.where((F.col("ts") > F.col("level_ts")) & (F.col("low") <= L * (1 + tolerance)) & (F.col("high") >= L * (1 - tolerance)))
    broke = F.when(up, F.col("close") < L * (1 - tolerance)).otherwise(F.col("close") > L * (1 + tolerance))
    bounce = ~broke & F.when(up, F.col("_nc") > F.col("close")).otherwise(F.col("_nc") < F.col("close"))
    i = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    g = j.groupBy(*k, "level_ts", "price", "kind").agg(F.count(F.lit(1)).alias("touches"), i(bounce).alias("bounces"), i(broke).alias("breaks"), F.min("ts").alias("first_touch"), F.max("ts").alias("last_touch"))
    acc = F.col("bounces") / F.col("touches")
    hold = 100 * (1 - F.col("breaks") / F.col("touches"))
    return g.withColumn("accuracy", acc).withColumn("holding", hold).withColumn("valid", ((F.col("touches") >= min_touches) & (acc >= .5) & (hold >= 60)).cast("int"))


def level_lifecycle(validated: DataFrame, now: Column, decay_days: int = 30) -> DataFrame:
    """status (active, broken, expired) and age-decayed strength max(.3, 1 - age/D); levels expire past 2 D."""
    age = (F.unix_micros(now) - F.unix_micros(F.coalesce("last_touch", "level_ts"))) / 86400e6
    d = validated.withColumn("age_days", age).withColumn("decayed", F.greatest(F.lit(.3), 1 - F.col("age_days") / decay_days) * F.least(F.col("touches") / 5.0, F.lit(1.0)))
    return d.withColumn("status", F.when(F.col("age_days") > 2 * decay_days, "expired").when(F.col("breaks") > F.col("bounces"), "broken").otherwise("active"))


def fibonacci_retracements(df: DataFrame, n: int = 50, p: Panel = PANEL, vol_n: int = 20) -> DataFrame:
    """Retracement prices between the trailing swing high and low, with a volatility-scaled band."""
    w = p.trailing(n)
    d = df.select(*p.keys, *p.order, F.max("high").over(w).alias("hi"), F.min("low").over(w).alias("lo"), F.stddev_pop("close").over(p.trailing(vol_n)).alias("_sd"), F.count(F.lit(1)).over(w).alias("_n")).where(F.col("_n") == n)
    arr = F.array(*[F.struct(F.lit(r).alias("ratio"), (F.col("hi") - r * (F.col("hi") - F.col("lo"))).alias("price"), (0.1 * F.col("_sd")).alias("band")) for r in RETRACEMENTS])
    return d.select(*p.keys, *p.order, F.explode(arr).alias("x")).select(*p.keys, *p.order, "x.*")


def combined_levels(df: DataFrame, methods: Sequence[str] = ("pivot", "peak", "volume", "psychological"), keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """One level table from the chosen methods with strength and rank per key."""
    k = list(keys)
    p = Panel(tuple(k), ("ts",))
    ensure_checkpoint_dir(df.sparkSession)
    df = df.select(*k, "ts", "high", "low", "close", "volume").checkpoint()  # the methods read the bars eight times
    last = df.groupBy(*k).agg(F.max("ts").alias("_mx"))
    parts = []
    if "pivot" in methods:
        lv = join_on(pivot_levels(df, p), last, k).where(F.col("ts") == F.col("_mx")).where(F.col("method") == "classical")
        parts.append(lv.select(*k, "price", F.lit(.6).alias("strength"), F.lit("pivot").alias("source")))
    if "peak" in methods:
        t = level_touches(smoothed_peaks(df, p=p), df, keys=keys)
        parts.append(t.select(*k, "price", F.least(F.col("touches") / 5.0, F.lit(1.0)).alias("strength"), F.lit("peak").alias("source")))
    if "volume" in methods:
        v = volume_profile(df, keys=keys).where("hvn = 1")
        parts.append(v.select(*k, ((F.col("low") + F.col("high")) / 2).alias("price"), F.when(F.col("poc") == 1, 1.0).otherwise(.7).alias("strength"), F.lit("volume").alias("source")))
    if "psychological" in methods:
        parts.append(psychological_levels(df, keys=keys).select(*k, "price", "strength", F.lit("psychological").alias("source")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    w = Window.partitionBy(*k).orderBy(F.desc("strength"), "price", "source")
    return out.withColumn("rank", F.rank().over(w))
