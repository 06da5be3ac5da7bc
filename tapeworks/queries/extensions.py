"""User functions: metrics, feature generators, chosen products."""
from __future__ import annotations

from uuid import uuid4

import numpy as np
from pyspark.sql import functions as F

from tapeworks.operators import generators as G
from tapeworks.operators import metricfn as M
from tapeworks.plans.panel import size_estimate
from tapeworks.queries import query
from tapeworks.queries.common import BARS, R, rd
from tapeworks.session import ensure_checkpoint_dir
from tapeworks.sources import adapters as A


def errors(s, d):
    """Event values against a plain forecast of 50 plus a share of the event number."""
    e = A.table(s, d, "events")
    return e.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.col("value").alias("y"), (50 + F.col("event_id") % 10).cast("double").alias("p"))


SQL_ERRORS = "e AS (SELECT date_trunc('day', ts) AS win, event_type, value AS y, (50 + event_id % 10)::DOUBLE AS p FROM events)"


def trimmed_error(y, p):
    """Mean absolute error without the largest tenth of the errors: needs all rows at once."""
    e = np.sort(np.abs(y - p))
    return e[: max(1, int(np.ceil(0.9 * len(e))))].mean()


@query("metric_function_windows", f"""WITH {SQL_ERRORS}, r AS (SELECT win, event_type, abs(y - p) AS a, row_number() OVER (PARTITION BY win, event_type ORDER BY abs(y - p)) AS k, count(*) OVER (PARTITION BY win, event_type) AS n FROM e)
SELECT event_type, win::TIMESTAMP AS "window", max(n) AS n, {R('avg(a) FILTER (k <= greatest(1, ceil(0.9::DOUBLE * n)))', 'metric', 6)} FROM r GROUP BY ALL""")
def _(s, d):
    """A user's trimmed error by event type and day."""
    m = M.window_metric(errors(s, d), trimmed_error, ["y", "p"], ["event_type"], "ts", "1 day")
    return m.select("event_type", "window", "n", rd("metric", 6).alias("metric"))


#: share of explained variance from five sums
EXPLAINED = M.MergeableMetric(5, lambda y, p: np.array([len(y), y.sum(), (y * y).sum(), ((y - p) ** 2).sum(), np.abs(y - p).max()]),
                              lambda s: np.append(s[:, :4].sum(0), s[:, 4].max()), lambda s: 1 - s[:, 3] / (s[:, 2] - s[:, 1] ** 2 / s[:, 0]))


@query("metric_function_merged", f"""WITH {SQL_ERRORS}, g AS (SELECT win, event_type, count(*) AS n, 1 - sum((y - p) * (y - p)) / (sum(y * y) - sum(y) * sum(y) / count(*)) AS metric FROM e GROUP BY ALL),
d AS (SELECT *, (metric - lag(metric) OVER w) / abs(lag(metric) OVER w) AS change FROM g WINDOW w AS (PARTITION BY event_type ORDER BY win))
SELECT event_type, win::TIMESTAMP AS "window", n, {R('metric', 'metric', 6)}, {R('change', 'change', 4)}, coalesce(-change > 0.5, false) AS drifted FROM d""")
def _(s, d):
    """Explained variance by event type and day from merged partial states, and where it fell by half or more."""
    m = M.merged_metric(errors(s, d), EXPLAINED, ["y", "p"], ["event_type"], "ts", "1 day")
    out = M.metric_drift(m, ["event_type"], 0.5, lower_is_better=False)
    return out.select("event_type", "window", "n", rd("metric", 6).alias("metric"), rd("change", 4).alias("change"), "drifted")


@query("feature_generator_pipeline", f"""WITH {BARS}, l AS (SELECT symbol, ts, high / close AS a, volume / close AS b, lag(close, 1) OVER w AS c1, lag(close, 3) OVER w AS c3 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, ts, {R('a', 'ratio_high_close', 6)}, {R('b', 'ratio_volume_close', 6)}, {R('c1', 'past_close_1')}, {R('c3', 'past_close_3')} FROM l""")
def _(s, d):
    """Ratios and lags from a pipeline of generators that was saved and loaded."""
    from pyspark.ml import Pipeline, PipelineModel

    ensure_checkpoint_dir(s)
    bars = A.daily_bars(s, d)
    stages = [G.RatioGenerator(columns=["close", "high", "volume"]), G.LagGenerator(columns=["close"], lags=[1, 3], prefix="past_")]
    path = f"{s.sparkContext.getCheckpointDir()}/generators-{uuid4().hex}"
    Pipeline(stages=stages).fit(bars).write().save(path)
    out = PipelineModel.load(path).transform(bars)
    return out.select("symbol", "ts", rd("ratio_high_close", 6).alias("ratio_high_close"), rd("ratio_volume_close", 6).alias("ratio_volume_close"), rd("past_close_1").alias("past_close_1"), rd("past_close_3").alias("past_close_3"))


WIDE = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_suppkey", "l_partkey"]


@query("polynomial_scores", f"""WITH y AS (SELECT *, l_extendedprice AS y FROM lineitem), z AS ({' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, {a}::DOUBLE * {b} AS z, y FROM y" for i, a in enumerate(WIDE) for b in WIDE[i:])}),
c AS (SELECT a, b, count(*) AS n, corr(z, y) AS r FROM z GROUP BY ALL) SELECT a, b, n, {R('r * r / (1 - r * r) * (n - 2)', 'f', 2)} FROM c""")
def _(s, d):
    """F scores of all products of two lineitem columns against the price, from one pass of co-moments."""
    out = G.product_scores(A.table(s, d, "lineitem"), WIDE, "l_extendedprice", interaction_only=False)
    return out.select("a", "b", "n", rd("f", 2).alias("f"))


@query("polynomial_chosen", f"""WITH y AS (SELECT *, l_extendedprice AS y FROM lineitem), z AS ({' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, {a}::DOUBLE * {b} AS z, l_orderkey, l_linenumber, y FROM y" for i, a in enumerate(WIDE) for b in WIDE[i + 1:])}),
c AS (SELECT a, b, corr(z, y) AS r FROM z GROUP BY ALL), k AS (SELECT a, b FROM c ORDER BY r * r DESC, a, b LIMIT 3)
SELECT l_orderkey, l_linenumber, {R('sum(z)', 'total', 4)} FROM z JOIN k USING (a, b) GROUP BY ALL""")
def _(s, d):
    """The three best products of two lineitem columns, built and added up for each line."""
    li = A.table(s, d, "lineitem")
    pairs = G.top_products(li, WIDE, "l_extendedprice", 3)
    out = G.with_products(li, pairs)
    return out.groupBy("l_orderkey", "l_linenumber").agg(F.sum(sum((F.col(f"poly_{a}_{b}") for a, b in pairs), F.lit(0.0))).alias("total")).select("l_orderkey", "l_linenumber", rd("total", 4).alias("total"))


@query("levels_table_function", f"""WITH {BARS}, l AS (SELECT symbol, ts, high, low, row_number() OVER w AS bar, greatest(max(high) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), max(high) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)) AS h,
  least(min(low) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), min(low) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)) AS lo, count(*) OVER (w ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS n FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, ts, 'resistance' AS kind, {R('high', 'price')}, bar FROM l WHERE n = 7 AND high > h UNION ALL SELECT symbol, ts, 'support', {R('low', 'price')}, bar FROM l WHERE n = 7 AND low < lo""")
def _(s, d):
    """Levels of the daily bars by the table function, called from SQL."""
    from tapeworks.operators import tablefn

    tablefn.register(s)
    A.daily_bars(s, d).createOrReplaceTempView("bars_for_levels")
    return s.sql("SELECT symbol, ts, kind, price, bar FROM levels_from_bars(TABLE(bars_for_levels), half => 3)").select("symbol", "ts", "kind", rd("price").alias("price"), "bar")


@query("candle_source_round_trip", f"""WITH {BARS} SELECT symbol::VARCHAR AS symbol, ts, {R('open')}, {R('high')}, {R('low')}, {R('close')}, {R('volume')} FROM bars WHERE symbol IN (3, 17) AND ts >= TIMESTAMP '1995-01-01'""")
def _(s, d):
    """Daily bars written to the candle source by ranges of symbol and read back for two symbols and a time range."""
    from tapeworks.sources import datasource

    datasource.register(s)
    ensure_checkpoint_dir(s)
    folder = f"{s.sparkContext.getCheckpointDir().removeprefix('file:')}/candles-{uuid4().hex}"
    bars = A.daily_bars(s, d).select(F.col("symbol").cast("string").alias("symbol"), "ts", "open", "high", "low", "close", "volume")
    bars.repartitionByRange(max(16, size_estimate(bars) // 250_000), "symbol").write.format("candles").mode("append").save(folder)
    out = s.read.format("candles").load(folder).where("symbol IN ('3', '17') AND ts >= timestamp'1995-01-01'")
    return out.select("symbol", "ts", *[rd(c).alias(c) for c in ("open", "high", "low", "close", "volume")])
