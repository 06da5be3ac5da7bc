"""Posts, sentiment aggregation and the composite fear-and-greed index."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions import text as T
from tapeworks.functions.mathx import clip, ratio, safe_div
from tapeworks.operators.indicators import ema
from tapeworks.plans.panel import Panel, join_on

# Component weights, label bounds, engagement weights
COMPONENT_WEIGHTS = {"volatility": 0.25, "momentum": 0.25, "volume": 0.15, "social_sentiment": 0.15, "dominance": 0.10, "search_trends": 0.05, "surveys": 0.05}
INDEX_LABELS = ((25, "Extreme Fear"), (45, "Fear"), (55, "Neutral"), (75, "Greed"))
ENGAGEMENT = {"likes": 1.0, "retweets": 2.0, "replies": 1.5, "quotes": 2.0}


# -- posts --------------------------------------------------------------------------------

def normalize_posts(df: DataFrame, raw: str, platform: str, id_col: str, text: str | None = None) -> DataFrame:
    """Raw platform JSON to the common post shape with weighted engagement."""
    j = F.from_json(raw, "likes BIGINT, retweets BIGINT, replies BIGINT, quotes BIGINT, text STRING", {"mode": "PERMISSIVE"})
    z = lambda k: F.coalesce(F.col(f"_j.{k}"), F.lit(0))
    eng = sum((z(k) * w for k, w in ENGAGEMENT.items()), F.lit(0.0))
    d = df.withColumn("_j", j)
    return d.select(F.col(id_col).cast("string").alias("id"), (F.col(text) if text else F.col("_j.text")).alias("text"), F.lit(platform).alias("platform"), F.struct(*[z(k).alias(k) for k in ENGAGEMENT]).alias("metrics"), eng.alias("engagement"))


def relevance(df: DataFrame, text: str, domain: str, keywords: Sequence[str], domains: Sequence[str], title: Column | None = None) -> DataFrame:
    """Score in [0, 1]: domain .3, mentions up to .3, title keywords up to .4, text keywords up to .2, length bonus."""
    words = F.size(F.split(F.trim(text), r"\s+"))
    hits = T.term_hits(text, keywords)
    dom = F.coalesce(sum((F.col(domain).contains(x).cast("int") for x in domains), F.lit(0)) > 0, F.lit(False))
    s = F.when(dom, .3).otherwise(0.0) + F.least(hits * .1, F.lit(.3)) + F.least(hits * .02, F.lit(.2)) + F.when(words > 500, .2).when(words > 200, .1).otherwise(0.0)
    if title is not None:
        s = s + F.least(T.term_hits(title, keywords) * .15, F.lit(.4))
    return df.withColumn("relevance", F.least(s, F.lit(1.0))).withColumn("relevant", (hits > 0) | dom)


class _Article(HTMLParser):
    SKIP = {"script", "style", "nav", "header", "footer", "aside", "noscript", "title"}
    BLOCK = {"p", "div", "br", "li", "h1", "h2", "h3", "h4", "article", "section", "tr"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.depth += 1
        elif tag in self.BLOCK:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in self.SKIP and self.depth:
            self.depth -= 1

    def handle_data(self, data):
        if not self.depth:
            self.parts.append(data)


def article_text(df: DataFrame, id_col: str, html: str) -> DataFrame:
    """Readable text of pages, one row in, one row out; streams Arrow batches."""
    typ = df.schema[id_col].dataType.simpleString()

    def extract(batches):
        for pdf in batches:
            out = []
            for h in pdf[html]:
                p = _Article()
                p.feed(h or "")
                p.close()
                out.append("\n".join(" ".join(line.split()) for line in "".join(p.parts).split("\n") if line.strip()))
            yield pd.DataFrame({id_col: pdf[id_col], "article": out})

    return df.select(id_col, html).mapInPandas(extract, f"{id_col} {typ}, article string")


def trending(df: DataFrame, text: str, pattern: str = r"#(\w+)", k: int = 20) -> DataFrame:
    """Most frequent tags; counts combine map-side and only k rows are kept per task."""
    tags = F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1)))
    return df.select(tags.alias("tag")).groupBy(F.lower("tag").alias("tag")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag").limit(k)


def search_posts(df: DataFrame, text: str, needle: str) -> DataFrame:
    return df.where(F.lower(text).contains(needle.lower()))


def channel_stats(df: DataFrame, channel: str, author: str, approximate: bool = True) -> DataFrame:
    people = F.approx_count_distinct(author) if approximate else F.count_distinct(author)
    return df.groupBy(channel).agg(F.count(F.lit(1)).alias("messages"), people.alias("authors"), F.avg(F.length("text")).alias("mean_length"))


def json_report(df: DataFrame, col: str, schema: str) -> DataFrame:
    """Counts of valid, malformed and null JSON and texts by threat."""
    j = F.from_json(col, schema + ", _corrupt_record STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    d = df.select(F.col(col), j["_corrupt_record"].isNotNull().alias("_bad"))
    i = lambda c: F.sum(c.cast("bigint"))
    return d.agg(F.count(F.lit(1)).alias("n"), i(F.col(col).isNull()).alias("n_null"), i(F.col("_bad")).alias("n_malformed"), i(F.col(col).isNotNull() & ~F.col("_bad")).alias("n_valid"))


# -- scoring ------------------------------------------------------------------------------

def lexicon_sentiment(df: DataFrame, text: str, lexicon: Mapping[str, float] | None = None) -> DataFrame:
    lex = lexicon or {**T.GENERAL_VALENCE, **T.CRYPTO_VALENCE}
    d = df.withColumn("_t", T.lexicon_sum(text, lex)).withColumn("score", T.compound(F.col("_t"))).drop("_t")
    return d.withColumn("confidence", F.abs("score"))


def crypto_adjust(df: DataFrame, text: str, n_symbols: Column, terms: Mapping[str, float] | None = None) -> DataFrame:
    """Shift positive / negative / neutral by term weights and symbol bonus, renormalize; below .4 is neutral."""
    low = F.lower(text)
    adj = sum((F.when(low.contains(t), w * 0.1).otherwise(0.0) for t, w in (terms or T.TERM_WEIGHTS).items()), F.lit(0.0))
    bonus = F.least(n_symbols * 0.05, F.lit(0.2))
    d = df.withColumn("_a", adj + F.when(n_symbols > 0, F.when(F.col("positive") > F.col("negative"), bonus).otherwise(-bonus)).otherwise(0.0))
    a, p, n, z = F.col("_a"), F.col("positive"), F.col("negative"), F.col("neutral")
    p2 = F.when(a > 0, F.least(p + a, F.lit(1.0))).when(a < 0, F.greatest(p + a * .5, F.lit(0.0))).otherwise(p)
    n2 = F.when(a > 0, F.greatest(n - a * .5, F.lit(0.0))).when(a < 0, F.least(n - a, F.lit(1.0))).otherwise(n)
    d = d.withColumn("_p", p2).withColumn("_n", n2)
    t = F.col("_p") + F.col("_n") + z
    d = d.select(*[c for c in df.columns if c not in ("positive", "negative", "neutral")], safe_div("_p", t).alias("positive"), safe_div("_n", t).alias("negative"), safe_div(z, t).alias("neutral"))
    m = F.greatest("positive", "negative", "neutral")
    return d.withColumn("label", F.when(m < .4, "neutral").when(F.col("positive") == m, "positive").when(F.col("negative") == m, "negative").otherwise("neutral"))


def ensemble(long: DataFrame, key: str = "id", weights: DataFrame | None = None) -> DataFrame:
    """Weighted score per post from (id, model, score, confidence[, performance]); equal weights when all vanish."""
    d = long if weights is None else long.join(F.broadcast(weights), "model", "left")
    base = F.coalesce(F.col("weight"), F.lit(1.0)) if weights is not None else F.lit(1.0)
    perf = F.coalesce(F.col("performance"), F.lit(1.0)) if "performance" in long.columns else F.lit(1.0)
    d = d.withColumn("_w", base * F.col("confidence") * perf)
    g = d.groupBy(key).agg(F.sum(F.col("score") * F.col("_w")).alias("_n"), F.sum("_w").alias("_d"), F.avg("score").alias("_m"), F.avg("confidence").alias("confidence"), F.stddev_pop("score").alias("_sd"))
    return g.select(key, F.when(F.col("_d") > 0, F.col("_n") / F.nullif(F.col("_d"), F.lit(0.0))).otherwise(F.col("_m")).alias("score"), "confidence", (1 - F.least("_sd", F.lit(1.0))).alias("agreement"))


def vote(long: DataFrame, key: str = "id", label: str = "label") -> DataFrame:
    """Majority label (ties by confidence sum, then name), its share, and the confidence-weighted label."""
    g = long.groupBy(key, label).agg(F.count(F.lit(1)).alias("_n"), F.sum("confidence").alias("_c"))
    a = g.groupBy(key).agg(F.max(F.struct("_n", "_c", label)).alias("_m"), F.max(F.struct("_c", "_n", label)).alias("_k"), F.sum("_n").alias("_t"))
    return a.select(key, F.col("_m")[label].alias("majority"), (F.col("_m")["_n"] / F.col("_t")).alias("agreement"), F.col("_k")[label].alias("by_confidence"))


def by_source(df: DataFrame, keys: Sequence[str] = ("symbol", "source"), score: str = "score") -> DataFrame:
    s = F.col(score)
    i = lambda c: F.sum(c.cast("bigint"))
    return df.groupBy(*keys).agg(F.count(s).alias("n"), i(s > .1).alias("positive"), i(s < -.1).alias("negative"), i(s.between(-.1, .1)).alias("neutral"), F.avg(s).alias("mean"), F.avg("engagement").alias("engagement"),
                                 F.least(F.count(s) / 50.0, F.lit(1.0)).alias("confidence"))


def weighted_aggregate(df: DataFrame, weights: Mapping[str, float], keys: Sequence[str], span: float | None = None) -> DataFrame:
    """Sum s c w / sum c w per key and time; ``span`` adds an EMA over the result."""
    w = F.lit(1.0)
    for k, v in weights.items():
        w = F.when(F.col("source") == k, v).otherwise(w)
    g = df.groupBy(*keys, "ts").agg(safe_div(F.sum(F.col("score") * F.col("confidence") * w), F.sum(F.col("confidence") * w)).alias("score"))
    return g if span is None else ema(g, span, "score", Panel(tuple(keys), ("ts",)), "smoothed")


def momentum(df: DataFrame, keys: Sequence[str], score: str = "score", history: int = 20) -> DataFrame:
    """Change from the previous row, signal label and confidence 1 - trailing deviation."""
    p = Panel(tuple(keys), ("ts",))
    d = df.withColumn("momentum", F.col(score) - F.lag(score).over(p.w))
    s = F.col(score)
    sig = F.when(s > .5, "strong_buy").when(s > .2, "buy").when(s < -.5, "strong_sell").when(s < -.2, "sell").otherwise("hold")
    return d.withColumn("signal", sig).withColumn("signal_confidence", clip(1 - F.coalesce(F.stddev_samp(score).over(p.trailing(history)), F.lit(0.0)), 0.0, 1.0))


# -- index components ---------------------------------------------------------------------

def search_indices(df: DataFrame, value: str, p: Panel) -> DataFrame:
    """fomo (recent 7 mean over history, growth > 20 %), panic (7-row deviation > 20 or recent over history), adoption (trend slope) per keyword and day."""
    w7, prev7 = p.trailing(7), p.frame(-13, -7)
    d = df.withColumn("_i", F.row_number().over(p.w).cast("double"))
    rec, hist, pre = F.avg(value).over(w7), F.avg(value).over(p.cum), F.avg(value).over(prev7)
    d = d.select(*p.keys, *p.order, safe_div(rec, hist).alias("recent_ratio"), F.coalesce(ratio(rec - pre, pre), F.lit(0.0)).alias("growth"), F.stddev_samp(value).over(w7).alias("deviation"), F.regr_slope(value, "_i").over(p.trailing(30)).alias("adoption"))
    return d.withColumn("fomo", F.when(F.col("growth") > .2, F.least(F.col("recent_ratio") - 1 + F.col("growth"), F.lit(1.0))).otherwise(0.0)).withColumn("panic", F.when(F.col("deviation") > 20, 1.0).otherwise(clip(F.col("recent_ratio") - 1, 0.0, 1.0)))


def survey_signal(df: DataFrame, value: str, keys: Sequence[str], kind: str) -> DataFrame:
    """Contrarian scale of survey means (0..100), deviation between survey types, per key: two-level aggregation."""
    g = df.groupBy(*keys, kind).agg(F.avg(value).alias("_m"), F.count(F.lit(1)).alias("_n"))
    a = g.groupBy(*keys).agg(F.avg("_m").alias("mean"), F.stddev_pop("_m").alias("between"), F.sum("_n").alias("n"))
    return a.withColumn("contrarian", F.when(F.col("mean") > 80, 100 - F.col("mean")).when(F.col("mean") < 20, 100 - F.col("mean")).otherwise(F.col("mean")))


def dominance_metrics(df: DataFrame, c: str, p: Panel, n: int = 30) -> DataFrame:
    """Altcoin-season index from the slope and change of a dominance series, and its deviation over n rows."""
    d = df.withColumn("_i", F.row_number().over(p.w).cast("double"))
    w = p.trailing(n)
    ok = F.count(c).over(w) == n
    trend, change = F.regr_slope(c, "_i").over(w), F.col(c) - F.lag(c, n - 1).over(p.w)
    idx = F.least((F.greatest(-trend * 20, F.lit(0.0)) + F.greatest(-change * 2, F.lit(0.0))) / 2, F.lit(100.0))
    return d.withColumn("season_index", F.when(ok, idx).otherwise(50.0)).withColumn("dominance_vol", F.when(ok, F.stddev_samp(c).over(w))).drop("_i")


def herfindahl(df: DataFrame, value: str, item: str, keys: Sequence[str]) -> DataFrame:
    g = df.groupBy(*keys, item).agg(F.sum(value).alias("_v"))
    return g.groupBy(*keys).agg(safe_div(F.sum(F.col("_v") ** 2), F.sum("_v") ** 2).alias("hhi"), safe_div(F.max("_v"), F.sum("_v")).alias("top_share"), F.max_by(item, F.struct("_v", item)).alias("leader"))


def volatility_score(v: Column) -> Column:
    """Percent volatility to 0..100: high volatility is fear."""
    return (F.when(v >= 150, 5.0).when(v >= 100, 5 + 20 * (150 - v) / 50).when(v >= 50, 25 + 50 * (100 - v) / 50).when(v >= 30, 75 + 20 * (50 - v) / 20).otherwise(95.0))


def component_scores(df: DataFrame, p: Panel = Panel(), periods: float = 365) -> DataFrame:
    """Long (symbol, ts, component, score, confidence) for volatility, momentum and volume from bars."""
    from tapeworks.operators.indicators import historical_volatility, rsi
    d = historical_volatility(rsi(df, 14, p=p), 30, periods, p=p)
    mom = clip(50 + 500 * ratio(F.col("close") - F.lag("close", 10).over(p.w), F.lag("close", 10).over(p.w)) / 10, 0.0, 100.0)
    vr = ratio("volume", F.avg("volume").over(p.trailing(20)))
    up = F.col("close") >= F.lag("close").over(p.w)
    conf = F.least(F.row_number().over(p.w) / 30.0, F.lit(1.0))
    d = d.select(*p.keys, *p.order, volatility_score(F.col("hist_vol") * 100).alias("_v"), (0.6 * F.col("rsi_14") + 0.4 * mom).alias("_m"), clip(50 + F.when(up, 1.0).otherwise(-1.0) * 25 * (vr - 1), 0.0, 100.0).alias("_q"), conf.alias("confidence"))
    st = "stack(3, 'volatility', _v, 'momentum', _m, 'volume', _q) as (component, score)"
    return d.select(*p.keys, *p.order, "confidence", F.expr(st)).where(F.col("score").isNotNull())


def fear_greed(components: DataFrame, weights: Mapping[str, float] | None = None, keys: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """Weighted, confidence-scaled mean of component scores; 50 without evidence; five labels."""
    w = F.lit(0.0)
    for k, v in (weights or COMPONENT_WEIGHTS).items():
        w = F.when(F.col("component") == k, v).otherwise(w)
    g = components.groupBy(*keys).agg(safe_div(F.sum(F.col("score") * w * F.col("confidence")), F.sum(w * F.col("confidence")), 50.0).alias("index"), F.avg("confidence").alias("confidence"), F.count(F.lit(1)).alias("n_components"))
    lab = F.lit("Extreme Greed")
    for b, name in reversed(INDEX_LABELS):
        lab = F.when(F.col("index") < b, name).otherwise(lab)
    return g.withColumn("label", lab)
