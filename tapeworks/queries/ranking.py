"""Ranking queries over daily bars."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeworks.operators import ranking as K
from tapeworks.queries import query
from tapeworks.queries.common import BARS, R, rd
from tapeworks.session import ensure_checkpoint_dir
from tapeworks.sources import adapters as A


def graded(s, d):
    """Daily bars with lagged features and a grade of 0 to 4 by the next day's return."""
    w = Window.partitionBy("symbol").orderBy("ts")
    b = A.daily_bars(s, d)
    r = F.col("close") / F.lag("close").over(w) - 1
    b = b.withColumn("r", r).withColumn("span", (F.col("high") - F.col("low")) / F.col("close")).withColumn("vol", F.col("volume") / F.lag("volume").over(w))
    b = b.withColumn("next", F.lead("r").over(w)).where("next IS NOT NULL AND r IS NOT NULL")
    return b.withColumn("grade", F.when(F.col("next") > 0.2, 4).when(F.col("next") > 0.05, 3).when(F.col("next") > -0.05, 2).when(F.col("next") > -0.2, 1).otherwise(0))


SQL_GRADED = f"""{BARS}, b1 AS (SELECT *, close / lag(close) OVER w - 1 AS r, (high - low) / close AS span FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
b2 AS (SELECT *, lead(r) OVER (PARTITION BY symbol ORDER BY ts) AS nxt FROM b1),
g AS (SELECT *, CASE WHEN nxt > 0.2 THEN 4 WHEN nxt > 0.05 THEN 3 WHEN nxt > -0.05 THEN 2 WHEN nxt > -0.2 THEN 1 ELSE 0 END AS grade FROM b2 WHERE nxt IS NOT NULL AND r IS NOT NULL)"""


@query("rank_ndcg", f"""WITH {SQL_GRADED}, x AS (SELECT symbol, grade, row_number() OVER (PARTITION BY symbol ORDER BY r, ts) AS a, row_number() OVER (PARTITION BY symbol ORDER BY grade DESC) AS i FROM g),
t AS (SELECT symbol, count(*) AS n, sum(CASE WHEN a <= 10 THEN (pow(2, grade) - 1) / log2(a + 1.0) END) AS got, sum(CASE WHEN i <= 10 THEN (pow(2, grade) - 1) / log2(i + 1.0) END) AS ideal FROM x GROUP BY symbol)
SELECT symbol, n, {R('CASE WHEN ideal > 0 THEN got / ideal ELSE 0 END', 'ndcg', 6)} FROM t""")
def _(s, d):
    """Gain of ranking each symbol's days by the lowest return first."""
    out = K.ndcg(graded(s, d).withColumn("score", -F.col("r")), ["symbol"], tie=["ts"])
    return out.select("symbol", "n", rd("ndcg", 6).alias("ndcg"))


@query("rank_pair_gradients", f"""WITH {SQL_GRADED}, c AS (SELECT symbol, grade, CAST(round(greatest(least(r, 4.0), -4.0) * 16) AS INTEGER) AS cell, count(*)::DOUBLE AS n FROM g GROUP BY ALL),
p AS (SELECT a.symbol, a.grade, a.cell, sign(a.grade - b.grade) AS sg, 1 / (1 + exp((a.cell - b.cell) / 16.0::DOUBLE * sign(a.grade - b.grade))) AS p, b.n AS m FROM c a JOIN c b ON a.symbol = b.symbol AND a.grade <> b.grade),
e AS (SELECT symbol, grade, cell, sum(-sg * p * m) AS g, sum(p * (1 - p) * m) AS h FROM p GROUP BY ALL),
u AS (SELECT symbol, sum(n) AS t FROM c JOIN e USING (symbol, grade, cell) GROUP BY symbol)
SELECT symbol, grade, cell, {R('g / u.t', 'g', 6)}, {R('h / u.t', 'h', 6)} FROM e JOIN u USING (symbol)""")
def _(s, d):
    """Pairwise gradients of each symbol's days when the return is the score."""
    out = K.pair_gradients(graded(s, d).withColumn("score", F.col("r")), ["symbol"])
    return out.select("symbol", "grade", "cell", rd("g", 6).alias("g"), rd("h", 6).alias("h"))


@query("rank_pairwise_boosted")
def _(s, d):
    """Ranker of the days' symbols by the next return, fit on the earlier days and judged by gain on the later ones."""
    b = graded(s, d).withColumn("later", F.dayofmonth("ts") > 20)
    model = K.PairwiseRanker(["r", "span", "vol", "n_trades"], ["month"], rounds=3, depth=2)
    ensure_checkpoint_dir(s)
    b = b.select("symbol", "ts", F.date_trunc("month", "ts").alias("month"), *model.features, "grade", "later").checkpoint()  # fit and judging read it five times
    model.fit(b.where("NOT later"))
    return K.ndcg(model.transform(b.where("later")), ["month"], tie=["ts", "symbol"])
