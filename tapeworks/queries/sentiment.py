"""Text, posts, sentiment aggregation and the composite index."""
from __future__ import annotations

from pyspark.sql import functions as F

from tapeworks.functions import text as T
from tapeworks.operators import sentiment as SE
from tapeworks.plans.panel import Panel
from tapeworks.queries import query
from tapeworks.queries.common import BARS, MARKET, R, RS, TICKS, ema_sql, rcols, rd
from tapeworks.queries.indicators import NB, RSI_CTE, rsi_sql, win
from tapeworks.sources import adapters as A

q = lambda p: p.replace("'", "''")
SAN = lambda c: f"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '{q(T.HTML_TAG)}', ' ', 'g'), '{q(T.URL)}', ' ', 'g'), '{q(T.EMAIL)}', ' ', 'g'), '[^\\w\\s.,!?:;()''"-]+', ' ', 'g'), '\\s+', ' ', 'g'))"""
# function words of the four test languages, used as a stand-in lexicon beside the built-in one
LEX = {"the": 0.5, "of": -0.3, "worthless": -1.9, "la": 0.4, "der": -0.2, "and": 0.1}
LEXSQL = "MAP {" + ", ".join(f"'{k}': {v}::DOUBLE" for k, v in LEX.items()) + "}"
LS = lambda c: f"coalesce(list_sum(list_transform(list_filter(regexp_split_to_array(lower({c}), '[^a-z_]+'), lambda w: map_contains({LEXSQL}, w)), lambda w: ({LEXSQL})[w])), 0)"


def docs(s, d):
    return A.table(s, d, "documents")


@query("text_sanitize", f"SELECT doc_id, md5({SAN('text')}) AS digest, CAST(length({SAN('text')}) AS INTEGER) AS n FROM documents")
def _(s, d):
    x = docs(s, d).select("doc_id", T.sanitize("text").alias("c"))
    return x.select("doc_id", F.md5("c").alias("digest"), F.length("c").alias("n"))


@query("text_validity_filter", "SELECT doc_id, lang FROM documents WHERE length(trim(text)) BETWEEN 50 AND 10000 AND lang IN ('en','de') AND source <> 'src0'")
def _(s, d):
    return docs(s, d).where(T.is_valid_text("text", 50, 10000) & F.col("lang").isin("en", "de") & (F.col("source") != "src0")).select("doc_id", "lang")


@query("text_unicode_normalize", "SELECT doc_id, md5(translate(regexp_replace(nfc_normalize(text), '[​‌‍﻿]', '', 'g'), '‘’“”–—', '''''\"\"--')) AS digest FROM documents")
def _(s, d):
    return docs(s, d).select("doc_id", F.md5(T.normalize_unicode("text")).alias("digest"))


@query("text_threat_flags", "SELECT page_id, " + ", ".join(f"CAST(regexp_matches(html, '{q(p)}') AS INTEGER) AS threat_{n}" for n, p in T.THREATS.items()) + ", CAST(" + "+".join(f"contains(lower(html), '{t}')::INT" for t in T.PRESSURE_TERMS) + " >= 3 AS INTEGER) AS threat_pressure FROM pages")
def _(s, d):
    return A.table(s, d, "pages").select("page_id", *T.threat_flags("html"))


@query("text_sensitive_counts", "SELECT doc_id, " + ", ".join(f"CAST(len(regexp_extract_all(text, '{q(p)}')) AS INTEGER) AS n_{n}" for n, p in T.SENSITIVE.items() if n != "jwt") + " FROM documents")
def _(s, d):
    x = docs(s, d).select("doc_id", *T.sensitive_counts("text"))
    return x.drop("n_jwt")


_MASK = "regexp_replace(text, '" + T.SENSITIVE["jwt"] + "', '[REDACTED]', 'g')"
for _p, _r in ((r"\b([A-Za-z0-9])[A-Za-z0-9._%+-]*@([A-Za-z0-9.-]+\.[A-Za-z]{2,})\b", r"\1***@\2"), (T.SENSITIVE["key"], "[REDACTED]"), (r"\b(?:\d{4}[- ]?){3}(\d{4})\b", r"****-****-****-\1"),
               (r"\b\d{3}-?\d{2}-?(\d{4})\b", r"***-**-\1"), (r"\b(?:\+?1[-. ]?)?\(?[0-9]{3}\)?[-. ]?[0-9]{3}[-. ]?([0-9]{4})\b", r"***-***-\1")):
    _MASK = f"regexp_replace({_MASK}, '{_p}', '{_r}', 'g')"


@query("text_mask_sensitive", f"SELECT doc_id, md5({_MASK}) AS digest FROM documents")
def _(s, d):
    return docs(s, d).select("doc_id", F.md5(T.mask_sensitive("text")).alias("digest"))


@query("text_json_report", """SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_null, CAST(0 AS BIGINT) AS n_malformed, count(*) AS n_valid FROM events""")
def _(s, d):
    return SE.json_report(A.table(s, d, "events"), "props", "k BIGINT")


@query("text_symbol_mentions", r"SELECT doc_id, list_aggregate(list_sort(list_distinct(regexp_extract_all(upper(text), '(?:^|[^A-Z0-9])[$#]?(DER|LA|OF|THE)\b', 1))), 'string_agg', ',') AS symbols FROM documents")
def _(s, d):
    m = docs(s, d).select("doc_id", T.mentions("text", ["THE", "LA", "DER", "OF"]).alias("m"))
    return m.select("doc_id", F.when(F.size("m") > 0, F.array_join("m", ",")).alias("symbols"))


@query("text_relevance", f"""WITH x AS (SELECT doc_id, (contains(lower(text),'the')::INT+contains(lower(text),'der')::INT+contains(lower(text),'profit')::INT) AS h, len(regexp_split_to_array(trim(text), '\\s+')) AS w, source IN ('src1','src10','src11','src12','src13','src14','src15','src16','src17','src18','src19') AS dm FROM documents)
 SELECT doc_id, {R('least(CASE WHEN dm THEN .3 ELSE 0 END+least(h*.1,.3)+least(h*.02,.2)+CASE WHEN w>500 THEN .2 WHEN w>200 THEN .1 ELSE 0 END,1)', 'relevance')} FROM x WHERE h>0 OR dm""")
def _(s, d):
    r = SE.relevance(docs(s, d), "text", "source", ["the", "der", "profit"], ["src1"])
    return r.where("relevant").select("doc_id", rd("relevance").alias("relevance"))


_ind = lambda ts: "+".join(f"contains(lower(text), '{t}')::INT" for t in ts)


@query("text_sentiment_indicators", f"SELECT doc_id, CAST({_ind(T.BULLISH)} AS INTEGER) AS bullish, CAST({_ind(T.BEARISH)} AS INTEGER) AS bearish FROM documents")
def _(s, d):
    return docs(s, d).select("doc_id", T.term_hits("text", T.BULLISH).alias("bullish"), T.term_hits("text", T.BEARISH).alias("bearish"))


@query("post_normalization", """WITH x AS (SELECT event_id, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k FROM events) SELECT CAST(event_id AS VARCHAR) AS id, 'feed' AS platform, CAST(k + 2.0*(k%7) + 1.5*(k%5) + 2.0*(k%3) AS DOUBLE) AS engagement FROM x""")
def _(s, d):
    k = F.get_json_object("props", "$.k").cast("bigint")
    raw = A.table(s, d, "events").select("event_id", F.to_json(F.struct(k.alias("likes"), (k % 7).alias("retweets"), (k % 5).alias("replies"), (k % 3).alias("quotes"))).alias("raw"))
    return SE.normalize_posts(raw, "raw", "feed", "event_id").select("id", "platform", "engagement")


@query("page_article_text")
def _(s, d):
    a = SE.article_text(A.table(s, d, "pages"), "page_id", "html")
    return a.select("page_id", F.length("article").alias("n"), F.md5("article").alias("digest"))


@query("post_trending_tags", r"""SELECT lower(t) AS tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '(\w{6,})', 1)) AS t FROM documents) GROUP BY 1 ORDER BY n DESC, tag LIMIT 20""")
def _(s, d):
    return SE.trending(docs(s, d), "text", r"(\w{6,})", 20)


@query("post_search", "SELECT doc_id FROM documents WHERE contains(lower(text), 'tion')")
def _(s, d):
    return SE.search_posts(docs(s, d), "text", "TION").select("doc_id")


@query("post_channel_stats", f"SELECT source, count(*) AS messages, count(DISTINCT lang) AS authors, {R('avg(length(text))', 'mean_length')} FROM documents GROUP BY 1")
def _(s, d):
    return rcols(SE.channel_stats(docs(s, d), "source", "lang", approximate=False), ["source", "messages", "authors"], ["mean_length"])


@query("sentiment_lexicon", f"WITH x AS (SELECT doc_id, {LS('text')} AS t FROM documents) SELECT doc_id, {R('t/sqrt(t*t+15)', 'score', 6)}, {R('abs(t/sqrt(t*t+15))', 'confidence', 6)} FROM x")
def _(s, d):
    return rcols(SE.lexicon_sentiment(docs(s, d), "text", LEX), ["doc_id"], ["score", "confidence"], 6)


PNN = f"""x AS (SELECT doc_id, text, lang, {LS('text')} AS t FROM documents), pn AS (SELECT *, t/sqrt(t*t+15) AS c FROM x), p3 AS (SELECT *, greatest(c,0) AS p, greatest(-c,0) AS n, 1-abs(c) AS z FROM pn)"""


@query("sentiment_crypto_adjust", f"""WITH {PNN}, a AS (SELECT *, CASE WHEN contains(lower(text),'the') THEN 0.08 ELSE 0 END + CASE WHEN contains(lower(text),'worth') THEN -0.05 ELSE 0 END + CASE WHEN lang='en' THEN CASE WHEN p>n THEN 0.05 ELSE -0.05 END ELSE 0 END AS a FROM p3),
 b AS (SELECT doc_id, CASE WHEN a>0 THEN least(p+a,1) WHEN a<0 THEN greatest(p+a*.5,0) ELSE p END AS p, CASE WHEN a>0 THEN greatest(n-a*.5,0) WHEN a<0 THEN least(n-a,1) ELSE n END AS n, z FROM a)
 SELECT doc_id, {R('p/(p+n+z)', 'positive', 6)}, {R('n/(p+n+z)', 'negative', 6)}, CASE WHEN greatest(p,n,z)/(p+n+z)<.4 THEN 'neutral' WHEN p=greatest(p,n,z) THEN 'positive' WHEN n=greatest(p,n,z) THEN 'negative' ELSE 'neutral' END AS label FROM b""")
def _(s, d):
    x = SE.lexicon_sentiment(docs(s, d), "text", LEX)
    x = x.withColumn("positive", F.greatest("score", F.lit(0.0))).withColumn("negative", F.greatest(-F.col("score"), F.lit(0.0))).withColumn("neutral", 1 - F.abs("score"))
    a = SE.crypto_adjust(x, "text", F.when(F.col("lang") == "en", 1).otherwise(0), {"the": 0.8, "worth": -0.5})
    return a.select("doc_id", rd("positive", 6).alias("positive"), rd("negative", 6).alias("negative"), "label")


def _models(s, d):
    x = SE.lexicon_sentiment(docs(s, d), "text", LEX)
    hits = T.term_hits("text", ["tion", "the", "der"]) / 3.0
    m = F.array(F.struct(F.lit("lexicon").alias("model"), F.col("score").alias("score"), F.col("confidence").alias("confidence")),
                F.struct(F.lit("terms").alias("model"), hits.alias("score"), F.lit(0.5).alias("confidence")),
                F.struct(F.lit("length").alias("model"), F.when(F.col("n_chars") > 2000, -0.4).otherwise(0.4).alias("score"), F.lit(0.3).alias("confidence")))
    return x.select(F.col("doc_id").alias("id"), F.explode(m).alias("m")).select("id", "m.*")


MOD = f"""{PNN}, ml AS (SELECT doc_id AS id, 'lexicon' AS model, c AS score, abs(c) AS confidence FROM pn UNION ALL SELECT doc_id, 'terms', (contains(lower(text),'tion')::INT+contains(lower(text),'the')::INT+contains(lower(text),'der')::INT)/3.0, 0.5 FROM documents UNION ALL SELECT doc_id, 'length', CASE WHEN n_chars>2000 THEN -0.4 ELSE 0.4 END, 0.3 FROM documents)"""


@query("sentiment_model_ensemble", f"WITH {MOD}, w AS (SELECT *, confidence*CASE model WHEN 'lexicon' THEN 0.5 WHEN 'terms' THEN 0.3 ELSE 0.2 END AS w FROM ml) SELECT id, {R('sum(score*w)/sum(w)', 'score', 6)}, {R('avg(confidence)', 'confidence', 6)}, {R('1-least(stddev_pop(score),1)', 'agreement', 6)} FROM w GROUP BY id")
def _(s, d):
    w = s.createDataFrame([("lexicon", .5), ("terms", .3), ("length", .2)], "model string, weight double")
    return rcols(SE.ensemble(_models(s, d), "id", w), ["id"], ["score", "confidence", "agreement"], 6)


@query("sentiment_vote", f"""WITH {MOD}, l AS (SELECT id, CASE WHEN score>.1 THEN 'positive' WHEN score<-.1 THEN 'negative' ELSE 'neutral' END AS label, confidence FROM ml), g AS (SELECT id, label, count(*) AS n, sum(confidence) AS c FROM l GROUP BY ALL)
 SELECT id, arg_max(label, row(n, c, label)) AS majority, {R('max(n)/sum(n)', 'agreement', 6)}, arg_max(label, row(c, n, label)) AS by_confidence FROM g GROUP BY id""")
def _(s, d):
    l = _models(s, d).withColumn("label", F.when(F.col("score") > .1, "positive").when(F.col("score") < -.1, "negative").otherwise("neutral"))
    return SE.vote(l).select("id", "majority", rd("agreement", 6).alias("agreement"), "by_confidence")


SP = """sp AS (SELECT user_id%20 AS symbol, event_type AS source, date_trunc('day', ts)::TIMESTAMP AS ts, greatest(least((value-50)/100,1),-1) AS score, (CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE)+1)/100 AS confidence, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE) AS engagement FROM events)"""


def sp(s, d):
    k = F.get_json_object("props", "$.k").cast("double")
    return A.table(s, d, "events").select((F.col("user_id") % 20).alias("symbol"), F.col("event_type").alias("source"), F.date_trunc("day", F.col("ts").cast("timestamp")).alias("ts"), F.greatest(F.least((F.col("value") - 50) / 100, F.lit(1.0)), F.lit(-1.0)).alias("score"), ((k + 1) / 100).alias("confidence"), k.alias("engagement"))


@query("sentiment_by_source", f"WITH {SP} SELECT symbol, source, count(score) AS n, CAST(sum(CASE WHEN score>0.1::DOUBLE THEN 1 ELSE 0 END) AS BIGINT) AS positive, CAST(sum(CASE WHEN score<-0.1::DOUBLE THEN 1 ELSE 0 END) AS BIGINT) AS negative, {R('avg(score)', 'mean', 6)}, {R('avg(engagement)', 'engagement')}, {R('least(count(score)/50.0,1)', 'confidence', 6)} FROM sp GROUP BY ALL")
def _(s, d):
    b = SE.by_source(sp(s, d))
    return b.select("symbol", "source", "n", "positive", "negative", rd("mean", 6).alias("mean"), rd("engagement").alias("engagement"), rd("confidence", 6).alias("confidence"))


SW = f"""{SP}, ag AS (SELECT symbol, ts, sum(score*confidence*CASE source WHEN 'view' THEN 0.5 WHEN 'click' THEN 2.0 ELSE 1.0 END)/sum(confidence*CASE source WHEN 'view' THEN 0.5 WHEN 'click' THEN 2.0 ELSE 1.0 END) AS score FROM sp GROUP BY ALL), an AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM ag)"""


@query("sentiment_weighted_smoothed", f"WITH {SW} SELECT symbol, ts, {R('score', 'score', 6)}, {R(ema_sql('score', 5), 'smoothed', 6)} FROM an {win()}")
def _(s, d):
    return rcols(SE.weighted_aggregate(sp(s, d), {"view": .5, "click": 2.0}, ["symbol"], 5), ["symbol", "ts"], ["score", "smoothed"], 6)


@query("sentiment_momentum_signals", f"WITH {SW} SELECT symbol, ts, {R('score-lag(score) OVER s', 'momentum', 6)}, CASE WHEN score>.5 THEN 'strong_buy' WHEN score>.2 THEN 'buy' WHEN score<-.5 THEN 'strong_sell' WHEN score<-.2 THEN 'sell' ELSE 'hold' END AS signal, {R('greatest(least(1-coalesce(stddev_samp(score) OVER w20,0),1),0)', 'signal_confidence', 6)} FROM an {win(20)}")
def _(s, d):
    m = SE.momentum(SE.weighted_aggregate(sp(s, d), {"view": .5, "click": 2.0}, ["symbol"]), ["symbol"])
    return m.select("symbol", "ts", rd("momentum", 6).alias("momentum"), "signal", rd("signal_confidence", 6).alias("signal_confidence"))


KW = """kw AS (SELECT event_type AS keyword, date_trunc('day', ts)::TIMESTAMP AS ts, sum(value) AS v FROM events GROUP BY ALL), kn AS (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY ts) AS rn FROM kw)"""


@query("index_search_trends", f"""WITH {KW}, x AS (SELECT keyword, ts, avg(v) OVER w7/avg(v) OVER wc AS rr, coalesce((avg(v) OVER w7-avg(v) OVER p7)/nullif(avg(v) OVER p7,0),0) AS g, stddev_samp(v) OVER w7 AS sd, regr_slope(v, rn) OVER w30 AS ad FROM kn WINDOW w7 AS (PARTITION BY keyword ORDER BY ts ROWS 6 PRECEDING), wc AS (PARTITION BY keyword ORDER BY ts ROWS UNBOUNDED PRECEDING), p7 AS (PARTITION BY keyword ORDER BY ts ROWS BETWEEN 13 PRECEDING AND 7 PRECEDING), w30 AS (PARTITION BY keyword ORDER BY ts ROWS 29 PRECEDING))
 SELECT keyword, ts, {R('rr', 'recent_ratio', 6)}, {R('g', 'growth', 6)}, {R('CASE WHEN g>.2 THEN least(rr-1+g,1) ELSE 0 END', 'fomo', 6)}, {R('CASE WHEN sd>20 THEN 1.0 ELSE greatest(least(rr-1,1),0) END', 'panic', 6)}, {R('CASE WHEN NOT isnan(ad) THEN ad END', 'adoption', 3)} FROM x""")
def _(s, d):
    k = A.table(s, d, "events").groupBy(F.col("event_type").alias("keyword"), F.date_trunc("day", F.col("ts").cast("timestamp")).alias("ts")).agg(F.sum("value").alias("v"))
    r = SE.search_indices(k, "v", Panel(("keyword",), ("ts",)))
    return r.select("keyword", "ts", *[rd(c, 6).alias(c) for c in ("recent_ratio", "growth", "fomo", "panic")], rd("adoption", 3).alias("adoption"))


@query("index_survey_signals", f"WITH g AS (SELECT c_nationkey, c_mktsegment, avg(c_acctbal/100) AS m, count(*) AS n FROM customer GROUP BY ALL), a AS (SELECT c_nationkey, avg(m) AS mean, stddev_pop(m) AS bt, sum(n) AS n FROM g GROUP BY 1) SELECT c_nationkey, {R('mean')}, {R('bt', 'between')}, CAST(n AS BIGINT) AS n, {R('CASE WHEN mean>80 OR mean<20 THEN 100-mean ELSE mean END', 'contrarian')} FROM a")
def _(s, d):
    c = A.table(s, d, "customer").withColumn("v", F.col("c_acctbal") / 100)
    return rcols(SE.survey_signal(c, "v", ["c_nationkey"], "c_mktsegment"), ["c_nationkey", "n"], ["mean", "between", "contrarian"])


@query("index_dominance", f"""WITH {MARKET}, t AS (SELECT ts, sum(volume) AS tv FROM market GROUP BY 1), dm AS (SELECT symbol, m.ts, 100*volume/tv AS x, row_number() OVER (PARTITION BY symbol ORDER BY m.ts) AS rn FROM market m JOIN t ON m.ts=t.ts)
 SELECT symbol, ts, {R('CASE WHEN rn>=30 THEN least((greatest(-regr_slope(x,rn) OVER w*20,0)+greatest(-(x-lag(x,29) OVER s)*2,0))/2,100) ELSE 50 END', 'season_index')}, {R('CASE WHEN rn>=30 THEN stddev_samp(x) OVER w END', 'dominance_vol', 5)} FROM dm WINDOW s AS (PARTITION BY symbol ORDER BY ts), w AS (PARTITION BY symbol ORDER BY ts ROWS 29 PRECEDING)""")
def _(s, d):
    m = A.market_daily(s, d)
    t = m.groupBy("ts").agg(F.sum("volume").alias("tv"))
    x = SE.dominance_metrics(m.join(t, "ts").withColumn("x", 100 * F.col("volume") / F.col("tv")), "x", Panel())
    return x.select("symbol", "ts", rd("season_index").alias("season_index"), rd("dominance_vol", 5).alias("dominance_vol"))


@query("index_concentration", f"WITH {MARKET} SELECT ts, {R('sum(volume*volume)/pow(sum(volume),2)', 'hhi', 6)}, {R('max(volume)/sum(volume)', 'top_share', 6)}, arg_max(symbol, row(volume, symbol)) AS leader FROM market GROUP BY ts")
def _(s, d):
    return rcols(SE.herfindahl(A.market_daily(s, d), "volume", "symbol", ["ts"]), ["ts", "leader"], ["hhi", "top_share"], 6)


CS = f"""{RSI_CTE}, hv AS (SELECT *, {rsi_sql(14)} AS rsi, ln(close/lag(close) OVER s) AS r, lag(close) OVER s AS pc, lag(close,10) OVER s AS p10 FROM dd {win(14)}), h2 AS (SELECT *, CASE WHEN rn>30 THEN stddev_pop(r) OVER w30*sqrt(365)*100 END AS v, volume/nullif(avg(volume) OVER w20,0) AS vr, least(rn/30.0,1) AS cf FROM hv {win(20, 30)}),
 cs AS (SELECT symbol, ts, cf, 'volatility' AS component, CASE WHEN v IS NULL THEN 95 WHEN v>=150 THEN 5 WHEN v>=100 THEN 5+20*(150-v)/50 WHEN v>=50 THEN 25+50*(100-v)/50 WHEN v>=30 THEN 75+20*(50-v)/20 ELSE 95 END AS score FROM h2
 UNION ALL SELECT symbol, ts, cf, 'momentum', 0.6*rsi+0.4*greatest(least(50+500*(close-p10)/p10/10,100),0) FROM h2 WHERE rsi IS NOT NULL AND p10 IS NOT NULL
 UNION ALL SELECT symbol, ts, cf, 'volume', greatest(least(50+CASE WHEN close>=pc THEN 1 ELSE -1 END*25*(vr-1),100),0) FROM h2)"""


@query("index_component_scores", f"WITH {NB}, {CS} SELECT symbol, ts, component, {R('score')}, {R('cf', 'confidence', 6)} FROM cs")
def _(s, d):
    c = SE.component_scores(A.daily_bars(s, d))
    return c.select("symbol", "ts", "component", rd("score").alias("score"), rd("confidence", 6).alias("confidence"))


@query("index_fear_greed", f"""WITH {NB}, {CS}, g AS (SELECT symbol, ts, sum(score*cf*w)/sum(cf*w) AS i, avg(cf) AS c, count(*) AS n FROM (SELECT *, CASE component WHEN 'volume' THEN 0.15 ELSE 0.25 END AS w FROM cs) GROUP BY ALL)
 SELECT symbol, ts, {R('i', '"index"')}, {R('c', 'confidence', 6)}, n AS n_components, CASE WHEN i<25 THEN 'Extreme Fear' WHEN i<45 THEN 'Fear' WHEN i<55 THEN 'Neutral' WHEN i<75 THEN 'Greed' ELSE 'Extreme Greed' END AS label FROM g""")
def _(s, d):
    f = SE.fear_greed(SE.component_scores(A.daily_bars(s, d)))
    return f.select("symbol", "ts", rd("index").alias("index"), rd("confidence", 6).alias("confidence"), "n_components", "label")


_NS = "text"
for _p, _r in (*T.SOCIAL_TAGS, *((rf"(?i)\b{k}\b", v) for k, v in T.SHORT_FORMS.items())):
    _NS = f"regexp_replace({_NS}, '{_p}', '{_r.replace('$1', chr(92) + '1')}', 'g')"


@query("text_social_normalize", f"SELECT doc_id, md5(trim(regexp_replace({_NS}, '\\s+', ' ', 'g'))) AS digest FROM documents")
def _(s, d):
    return docs(s, d).select("doc_id", F.md5(T.normalize_social("text")).alias("digest"))
