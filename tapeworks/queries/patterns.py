"""Patterns, levels and profiles on daily supplier bars."""
from __future__ import annotations

from pyspark.sql import functions as F

from tapeworks.operators import patterns as PT
from tapeworks.queries import query
from tapeworks.queries.common import BARS, MARKET, R, RS, rcols, rd
from tapeworks.queries.indicators import NB
from tapeworks.sources import adapters as A

W = "PARTITION BY symbol ORDER BY ts"
SW = NB + f""", sw0 AS (SELECT *, max(high) OVER b AS hb, max(high) OVER f AS hf, min(low) OVER b AS lb, min(low) OVER f AS lf FROM nb WINDOW b AS ({W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), f AS ({W} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)),
 sw AS (SELECT symbol, ts, rn AS pos, 1 AS kind, high AS price FROM sw0 WHERE high>hb AND high>hf UNION ALL SELECT symbol, ts, rn, -1, low FROM sw0 WHERE low<lb AND low<lf)"""
LW = "WINDOW w AS (PARTITION BY symbol ORDER BY ts, kind)"


def leads(n):
    return ", ".join(f"lead(price,{i}) OVER w AS q{i}, lead(kind,{i}) OVER w AS k{i}, lead(ts,{i}) OVER w AS t{i}, lead(pos,{i}) OVER w AS o{i}" for i in range(1, n))


def sw(s, d):
    return PT.swings(A.daily_bars(s, d))


@query("pattern_swings", f"WITH {SW} SELECT symbol, ts, CAST(pos AS INTEGER) AS pos, kind, {R('price')} FROM sw")
def _(s, d):
    return sw(s, d).select("symbol", "ts", "pos", "kind", rd("price").alias("price"))


XC = SW + f""", x AS (SELECT *, {leads(5)} FROM sw {LW}), xc AS (SELECT *, coalesce(abs(q2-q1)/nullif(abs(q1-price),0),0) AS ab, coalesce(abs(q3-q2)/nullif(abs(q2-q1),0),0) AS bc, coalesce(abs(q4-q3)/nullif(abs(q3-q2),0),0) AS cd, coalesce(abs(q4-price)/nullif(abs(q1-price),0),0) AS xd FROM x WHERE q4 IS NOT NULL)"""


@query("pattern_xabcd_candidates", f"WITH {XC} SELECT symbol, ts, t4 AS d_ts, {RS(['ab', 'bc', 'cd', 'xd'])} FROM xc")
def _(s, d):
    c = PT.xabcd(sw(s, d))
    return c.select("symbol", F.col("X.ts").alias("ts"), F.col("D.ts").alias("d_ts"), *[rd(x).alias(x) for x in ("ab", "bc", "cd", "xd")])


_rules = ", ".join(f"('{n}', {', '.join(str(x) + '::DOUBLE' for x in v)})" for n, v in PT.HARMONIC_RULES.items())
HM = XC + f""", ru(pattern, a0, a1, b0, b1, c0, c1, d0, d1) AS (VALUES {_rules}), hm AS (SELECT *, greatest(least(1-(abs(ab-(a0+a1)/2)/((a0+a1)/2)+abs(bc-(b0+b1)/2)/((b0+b1)/2)+abs(cd-(c0+c1)/2)/((c0+c1)/2)+abs(xd-(d0+d1)/2)/((d0+d1)/2))/4,1),0) AS confidence,
 CASE WHEN k4=-1 THEN 1 ELSE -1 END AS sg FROM xc, ru WHERE ab BETWEEN a0*0.7::DOUBLE AND a1*1.3::DOUBLE AND bc BETWEEN b0*0.7::DOUBLE AND b1*1.3::DOUBLE AND cd BETWEEN c0*0.7::DOUBLE AND c1*1.3::DOUBLE AND xd BETWEEN d0*0.7::DOUBLE AND d1*1.3::DOUBLE),
 hs AS (SELECT *, price-sg*0.1*abs(price-q4) AS stop, q4+sg*0.382*abs(q1-q4) AS target_1, q4+sg*0.618*abs(q1-q4) AS target_2, q4+sg*1.0*abs(q1-q4) AS target_3 FROM hm)"""


def hm(s, d):
    return PT.harmonic_matches(PT.xabcd(sw(s, d)), 0.3)


@query("pattern_harmonic_matches", f"WITH {HM} SELECT symbol, t4 AS d_ts, pattern, CASE WHEN sg=1 THEN 'bullish' ELSE 'bearish' END AS direction, {R('confidence', 'confidence', 5)}, {RS(['stop', 'target_1', 'target_2', 'target_3'], 3)}, {R('coalesce(abs(target_1-q4)/nullif(abs(q4-stop),0),0)', 'risk_reward')} FROM hs")
def _(s, d):
    m = hm(s, d)
    return m.select("symbol", F.col("D.ts").alias("d_ts"), "pattern", "direction", rd("confidence", 5).alias("confidence"), *[rd(c, 3).alias(c) for c in ("stop", "target_1", "target_2", "target_3")], rd("risk_reward").alias("risk_reward"))


@query("pattern_harmonic_strength", f"""WITH {HM}, v AS (SELECT symbol, ts, volume/avg(volume) OVER ({W} ROWS 19 PRECEDING) AS vr FROM nb), j AS (SELECT hs.*, vr, least(o2-pos, o4-o2)/greatest(o2-pos, o4-o2)::DOUBLE AS sy, coalesce(abs(target_1-q4)/nullif(abs(q4-stop),0),0) AS rr FROM hs JOIN v ON v.symbol=hs.symbol AND v.ts=hs.t4)
 SELECT symbol, t4 AS d_ts, pattern, {R('sy', 'symmetry', 5)}, {R('vr', 'volume_ratio')}, {R('0.5*confidence+0.2*sy+0.15*least(vr/2,1)+0.15*least(rr/3,1)', 'strength', 5)} FROM j""")
def _(s, d):
    m = PT.score_patterns(hm(s, d), A.daily_bars(s, d))
    return m.select("symbol", F.col("D.ts").alias("d_ts"), "pattern", rd("symmetry", 5).alias("symmetry"), rd("volume_ratio").alias("volume_ratio"), rd("strength", 5).alias("strength"))


@query("pattern_outcomes", f"""WITH {HM}, e AS (SELECT symbol, ts, max(high) OVER f AS mx, min(low) OVER f AS mn FROM nb WINDOW f AS ({W} ROWS BETWEEN 1 FOLLOWING AND 50 FOLLOWING)), j AS (SELECT hs.*, mx, mn FROM hs JOIN e ON e.symbol=hs.symbol AND e.ts=hs.t4)
 SELECT symbol, t4 AS d_ts, pattern, CAST(coalesce(CASE WHEN sg=1 THEN mx>=target_1 ELSE mn<=target_1 END,false) AS INTEGER) AS hit_1, CAST(coalesce(CASE WHEN sg=1 THEN mx>=target_3 ELSE mn<=target_3 END,false) AS INTEGER) AS hit_3, CAST(coalesce(CASE WHEN sg=1 THEN mn<=stop ELSE mx>=stop END,false) AS INTEGER) AS stopped FROM j WHERE confidence>=0.5""")
def _(s, d):
    m = PT.pattern_outcomes(PT.filter_patterns(hm(s, d), 0.5, 0.0), A.daily_bars(s, d))
    return m.select("symbol", F.col("D.ts").alias("d_ts"), "pattern", "hit_1", "hit_3", "stopped")


IM = SW + f""", x AS (SELECT *, {leads(6)}, CASE WHEN kind=-1 THEN 1 ELSE -1 END AS s FROM sw {LW}), im AS (SELECT *, abs(q2-q1)/abs(q1-price) AS r2, abs(q4-q3)/abs(q3-q2) AS r4, abs(q3-q2)/abs(q1-price) AS r31, abs(q5-q4)/abs(q1-price) AS r51 FROM x WHERE q5 IS NOT NULL AND kind<>k1 AND k1<>k2 AND k2<>k3 AND k3<>k4 AND k4<>k5
 AND s*q2>s*price AND s*q3>s*q1 AND s*q4>s*q1 AND s*q5>s*q4 AND abs(q3-q2)>least(abs(q1-price),abs(q5-q4)))"""


@query("pattern_impulse_waves", f"WITH {IM} SELECT symbol, ts AS start_ts, t5 AS end_ts, CASE WHEN s=1 THEN 'bullish' ELSE 'bearish' END AS direction, {R('r2', 'retrace_2')}, {R('r4', 'retrace_4')}, {R('r31', 'ratio_3_1')}, {R('r51', 'ratio_5_1')}, {R('q5-s*0.382*abs(q5-price)', 'target_382', 3)} FROM im")
def _(s, d):
    m = PT.impulse_waves(sw(s, d))
    return m.select("symbol", F.col("p0.ts").alias("start_ts"), F.col("p5.ts").alias("end_ts"), "direction", *[rd(c).alias(c) for c in ("retrace_2", "retrace_4", "ratio_3_1", "ratio_5_1")], rd("target_382", 3).alias("target_382"))


@query("pattern_wave_count_rank", f"""WITH {IM}, c AS (SELECT symbol, ts AS start_ts, t5 AS end_ts, 0.4+0.2*greatest((SELECT 1-abs(r31-l)/l FROM (SELECT unnest([0.382,0.618,1.0,1.272,1.618,2.618])::DOUBLE AS l) ORDER BY abs(l-r31), l LIMIT 1),0)+0.2*(abs(r2-r4)>.1)::INT+0.1*(r2 BETWEEN .382 AND .786)::INT+0.1*(r4 BETWEEN .236 AND .5)::INT AS cf FROM im)
 SELECT symbol, start_ts, end_ts, {R('cf', 'confidence', 5)}, CAST(row_number() OVER (PARTITION BY symbol ORDER BY cf DESC, end_ts DESC, start_ts) AS INTEGER) AS rank FROM c QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY cf DESC, end_ts DESC, start_ts)<=5""")
def _(s, d):
    m = PT.impulse_waves(sw(s, d)).select("symbol", F.col("p0.ts").alias("start_ts"), F.col("p5.ts").alias("end_ts"), "confidence")
    return PT.rank_wave_counts(m).select("symbol", "start_ts", "end_ts", rd("confidence", 5).alias("confidence"), "rank")


@query("pattern_corrective_waves", f"""WITH {SW}, x AS (SELECT *, {leads(4)} FROM sw {LW}), c AS (SELECT *, abs(q2-q1)/abs(q1-price) AS b, abs(q3-q2)/abs(q1-price) AS c, CASE WHEN q1>price THEN 1 ELSE -1 END AS s FROM x WHERE q3 IS NOT NULL AND kind<>k1 AND k1<>k2 AND k2<>k3),
 k AS (SELECT *, CASE WHEN b BETWEEN .382 AND .786 AND s*q3>s*q1 THEN 'zigzag' WHEN b BETWEEN .9 AND 1.1 AND c BETWEEN .9 AND 1.382 THEN 'flat' END AS kd FROM c) SELECT symbol, ts AS start_ts, kd AS kind, {R('b', 'b_ratio', 5)}, {R('c', 'c_ratio', 5)} FROM k WHERE kd IS NOT NULL""")
def _(s, d):
    m = PT.corrective_waves(sw(s, d))
    return m.select("symbol", F.col("p0.ts").alias("start_ts"), "kind", rd("b_ratio", 5).alias("b_ratio"), rd("c_ratio", 5).alias("c_ratio"))


@query("pattern_triangles_diagonals", f"""WITH {SW}, x AS (SELECT *, {leads(6)}, CASE WHEN kind=-1 THEN 1 ELSE -1 END AS s FROM sw {LW}), y AS (SELECT *, abs(q1-price) AS w0, abs(q2-q1) AS w1, abs(q3-q2) AS w2, abs(q4-q3) AS w3, abs(q5-q4) AS w4 FROM x WHERE q5 IS NOT NULL AND kind<>k1 AND k1<>k2 AND k2<>k3 AND k3<>k4 AND k4<>k5),
 k AS (SELECT *, CASE WHEN w0>w1 AND w1>w2 AND w2>w3 AND w3>w4 THEN 'triangle_contracting' WHEN w0<w1 AND w1<w2 AND w2<w3 AND w3<w4 THEN 'triangle_expanding' WHEN s*q3>s*q1 AND s*q5>s*q3 AND s*q4<s*q1 AND s*q4>s*q2 AND w2<w0 AND w4<w2 THEN 'diagonal' END AS kd FROM y) SELECT symbol, ts AS start_ts, kd AS kind FROM k WHERE kd IS NOT NULL""")
def _(s, d):
    return PT.five_leg_patterns(sw(s, d)).select("symbol", F.col("p0.ts").alias("start_ts"), "kind")


def _pl():
    items = [("classical", "pivot", "pv"), ("classical", "r1", "2*pv-l"), ("classical", "s1", "2*pv-h"), ("classical", "r2", "pv+rg"), ("classical", "s2", "pv-rg"), ("classical", "r3", "h+2*(pv-l)"), ("classical", "s3", "l-2*(h-pv)"),
             ("woodie", "pivot", "wd"), ("woodie", "r1", "2*wd-l"), ("woodie", "s1", "2*wd-h"), ("woodie", "r2", "wd+rg"), ("woodie", "s2", "wd-rg")]
    for i, k in enumerate((0.382, 0.618, 1.0), 1):
        items += [("fibonacci", f"r{i}", f"pv+{k}*rg"), ("fibonacci", f"s{i}", f"pv-{k}*rg")]
    for i, k in enumerate((12, 6, 4, 2), 1):
        items += [("camarilla", f"r{i}", f"c+rg*1.1/{k}"), ("camarilla", f"s{i}", f"c-rg*1.1/{k}")]
    return " UNION ALL ".join(f"SELECT symbol, ts, '{m}' AS method, '{n}' AS level_name, {R(e, 'price', 3)} FROM z" for m, n, e in items)


@query("level_pivots", f"WITH {BARS}, y AS (SELECT symbol, ts, lag(high) OVER s AS h, lag(low) OVER s AS l, lag(close) OVER s AS c FROM bars WINDOW s AS ({W})), z AS (SELECT *, h-l AS rg, (h+l+c)/3 AS pv, (h+l+2*c)/4 AS wd FROM y WHERE h IS NOT NULL) {_pl()}")
def _(s, d):
    return PT.pivot_levels(A.daily_bars(s, d)).select("symbol", "ts", "method", "level_name", rd("price", 3).alias("price"))


VP = BARS + """, g AS (SELECT symbol, min(low) AS lo, max(high) AS hi FROM bars GROUP BY 1), e AS (SELECT b.symbol, high, low, volume, lo, (hi-lo)/24 AS w FROM bars b JOIN g USING (symbol)), x AS (SELECT *, unnest(generate_series(CAST(least(floor((low-lo)/w),23) AS BIGINT), CAST(least(floor((high-lo)/w),23) AS BIGINT))) AS bin FROM e),
 pf AS (SELECT symbol, bin, sum(volume*CASE WHEN high>low THEN greatest(least(high, lo+(bin+1)*w)-greatest(low, lo+bin*w),0)/(high-low) ELSE 1 END) AS volume FROM x GROUP BY ALL)"""


@query("level_volume_profile", f"WITH {VP} SELECT symbol, bin, {R('volume', 'volume', 3)}, CAST(row_number() OVER (PARTITION BY symbol ORDER BY volume DESC, bin)=1 AS INTEGER) AS poc, CAST(coalesce(sum(volume) OVER (PARTITION BY symbol ORDER BY volume DESC, bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)<0.7*sum(volume) OVER (PARTITION BY symbol) AS INTEGER) AS value_area, CAST(volume>1.5*avg(volume) OVER (PARTITION BY symbol) AS INTEGER) AS hvn FROM pf")
def _(s, d):
    return PT.volume_profile(A.daily_bars(s, d)).select("symbol", "bin", rd("volume", 3).alias("volume"), "poc", "value_area", "hvn")


def _gs():
    import math
    num = "+".join(f"coalesce({'lag' if k < 0 else 'lead'}(close,{abs(k)}) OVER s,0)*{math.exp(-k * k / 2)!r}" if k else "close" for k in range(-4, 5))
    den = "+".join(f"CASE WHEN {'lag' if k < 0 else 'lead'}(close,{abs(k)}) OVER s IS NOT NULL THEN {math.exp(-k * k / 2)!r} ELSE 0 END" if k else "1" for k in range(-4, 5))
    return f"({num})/({den})"


PK = BARS + f""", sm AS (SELECT symbol, ts, close, {_gs()} AS s FROM bars WINDOW s AS ({W})), pk0 AS (SELECT *, max(s) OVER b AS hb, max(s) OVER f AS hf, min(s) OVER b AS lb, min(s) OVER f AS lf, count(s) OVER b AS nb_, count(s) OVER f AS nf FROM sm WINDOW b AS ({W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), f AS ({W} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)),
 pk AS (SELECT symbol, ts, close AS price, CASE WHEN s>hb AND s>hf THEN 'resistance' ELSE 'support' END AS kind FROM pk0 WHERE nb_=3 AND nf=3 AND ((s>hb AND s>hf) OR (s<lb AND s<lf)))"""


@query("level_peaks_touches", f"WITH {PK}, t AS (SELECT pk.symbol, pk.ts, pk.price, pk.kind, count(DISTINCT b.ts) AS touches FROM pk JOIN bars b ON b.symbol=pk.symbol AND (abs(b.high-pk.price)<=0.001*pk.price OR abs(b.low-pk.price)<=0.001*pk.price) GROUP BY ALL) SELECT symbol, ts, {R('price')}, kind, coalesce(touches,0) AS touches FROM pk LEFT JOIN t USING (symbol, ts, price, kind)")
def _(s, d):
    b = A.daily_bars(s, d)
    return PT.level_touches(PT.smoothed_peaks(b), b).select("symbol", "ts", rd("price").alias("price"), "kind", "touches")


@query("level_psychological", f"WITH {BARS}, l AS (SELECT symbol, arg_max(close, ts) AS last FROM bars GROUP BY 1), g AS (SELECT *, pow(10.0, floor(log10(last))-1) AS st FROM l), n AS (SELECT *, unnest(generate_series(CAST(ceil(last*0.9/st) AS BIGINT), CAST(floor(last*1.1/st) AS BIGINT))) AS n FROM g) SELECT symbol, {R('n*st', 'price')}, CASE WHEN n%10=0 THEN 1.0::DOUBLE WHEN n%5=0 THEN 0.7::DOUBLE ELSE 0.4::DOUBLE END AS strength FROM n")
def _(s, d):
    return PT.psychological_levels(A.daily_bars(s, d)).select("symbol", rd("price").alias("price"), "strength")


@query("level_nearest", f"WITH {BARS}, l AS (SELECT symbol, arg_max(close, ts) AS last FROM bars GROUP BY 1), g AS (SELECT *, pow(10.0, floor(log10(last))-1) AS st FROM l), n AS (SELECT *, unnest(generate_series(CAST(ceil(last*0.9/st) AS BIGINT), CAST(floor(last*1.1/st) AS BIGINT)))*st AS price FROM g), k AS (SELECT symbol, price, CASE WHEN price<last THEN 'support' ELSE 'resistance' END AS side, abs(price-last) AS dist FROM n) SELECT symbol, {R('price')}, side, CAST(row_number() OVER (PARTITION BY symbol, side ORDER BY dist, price) AS INTEGER) AS rank FROM k QUALIFY row_number() OVER (PARTITION BY symbol, side ORDER BY dist, price)<=3")
def _(s, d):
    return PT.nearest_levels(PT.psychological_levels(A.daily_bars(s, d)), 3).select("symbol", rd("price").alias("price"), "side", "rank")


VL = PK + f""", nx AS (SELECT *, lead(close) OVER ({W}) AS nc FROM bars), vj AS (SELECT pk.symbol, pk.ts AS level_ts, pk.price, pk.kind, b.ts, CASE WHEN pk.kind='support' THEN b.close<pk.price*(1-0.01::DOUBLE) ELSE b.close>pk.price*(1+0.01::DOUBLE) END AS broke, CASE WHEN pk.kind='support' THEN nc>b.close ELSE nc<b.close END AS bn FROM pk JOIN nx b ON b.symbol=pk.symbol AND b.ts>pk.ts AND b.low<=pk.price*(1+0.01::DOUBLE) AND b.high>=pk.price*(1-0.01::DOUBLE)),
 vl AS (SELECT symbol, level_ts, price, kind, count(*) AS touches, sum(CASE WHEN NOT broke AND bn THEN 1 ELSE 0 END) AS bounces, sum(CASE WHEN broke THEN 1 ELSE 0 END) AS breaks, max(ts) AS last_touch FROM vj GROUP BY ALL)"""


@query("level_validation", f"WITH {VL} SELECT symbol, level_ts, {R('price')}, touches, CAST(bounces AS BIGINT) AS bounces, CAST(breaks AS BIGINT) AS breaks, {R('bounces/touches', 'accuracy', 5)}, CAST(touches>=2 AND bounces/touches>=.5 AND 100*(1-breaks/touches)>=60 AS INTEGER) AS valid FROM vl")
def _(s, d):
    b = A.daily_bars(s, d)
    v = PT.validate_levels(PT.smoothed_peaks(b), b)
    return v.select("symbol", "level_ts", rd("price").alias("price"), "touches", "bounces", "breaks", rd("accuracy", 5).alias("accuracy"), "valid")


@query("level_lifecycle", f"WITH {VL}, a AS (SELECT *, (epoch_us(TIMESTAMP '2001-12-31')-epoch_us(last_touch))/86400e6 AS age FROM vl) SELECT symbol, level_ts, {R('age', 'age_days', 2)}, {R('greatest(.3,1-age/365)*least(touches/5.0,1)', 'decayed', 5)}, CASE WHEN age>730 THEN 'expired' WHEN breaks>bounces THEN 'broken' ELSE 'active' END AS status FROM a")
def _(s, d):
    b = A.daily_bars(s, d)
    v = PT.level_lifecycle(PT.validate_levels(PT.smoothed_peaks(b), b), F.lit("2001-12-31").cast("timestamp"), 365)
    return v.select("symbol", "level_ts", rd("age_days", 2).alias("age_days"), rd("decayed", 5).alias("decayed"), "status")


@query("level_confluence_zones")
def _(s, d):
    z = PT.merge_zones(PT.combined_levels(A.daily_bars(s, d)))
    return z.select("symbol", rd("low").alias("low"), rd("high").alias("high"), rd("strength").alias("strength"), "n")


@query("level_combined", f"""WITH {PK}, {VP.split('FROM trades GROUP BY symbol, ts), ')[1]}, tc AS (SELECT pk.symbol, pk.ts, pk.price, pk.kind, count(DISTINCT b.ts) AS t FROM pk LEFT JOIN bars b ON b.symbol=pk.symbol AND (abs(b.high-pk.price)<=0.001*pk.price OR abs(b.low-pk.price)<=0.001*pk.price) GROUP BY ALL)
 SELECT symbol, 'peak' AS source, count(*) AS n, {R('sum(least(t/5.0,1))', 'strength', 3)} FROM tc GROUP BY symbol UNION ALL SELECT symbol, 'volume', count(*), {R('sum(CASE WHEN k=1 THEN 1.0 ELSE 0.7 END)', 'strength', 3)} FROM (SELECT symbol, volume, row_number() OVER (PARTITION BY symbol ORDER BY volume DESC, bin) AS k, avg(volume) OVER (PARTITION BY symbol) AS m FROM pf) WHERE volume>1.5*m GROUP BY symbol""")
def _(s, d):
    c = PT.combined_levels(A.daily_bars(s, d), ("peak", "volume"))
    return c.groupBy("symbol", "source").agg(F.count(F.lit(1)).alias("n"), rd(F.sum("strength"), 3).alias("strength"))


@query("level_fibonacci_retracements", f"WITH {NB}, w AS (SELECT symbol, ts, rn, max(high) OVER w AS hi, min(low) OVER w AS lo, stddev_pop(close) OVER ({W} ROWS 19 PRECEDING) AS sd FROM nb WINDOW w AS ({W} ROWS 49 PRECEDING)) SELECT symbol, ts, r AS ratio, {R('hi-r*(hi-lo)', 'price')}, {R('0.1*sd', 'band')} FROM w, (SELECT unnest([0.236,0.382,0.5,0.618,0.786])::DOUBLE AS r) WHERE rn>=50")
def _(s, d):
    return PT.fibonacci_retracements(A.daily_bars(s, d)).select("symbol", "ts", "ratio", rd("price").alias("price"), rd("band").alias("band"))
