"""Registered queries of the training-data operators, with SQL where SQL can express them."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: words of a text in DuckDB
SQL_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@query("op4_substring_dedup", f"""
WITH w AS (SELECT doc_id, {SQL_WORDS} AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM w),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM p),
r AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM r WHERE least < doc_id),
lost AS (SELECT doc_id, list(j) AS js FROM gone GROUP BY doc_id),
kept AS (SELECT doc_id, ws, list_filter(range(1, len(ws) + 1), lambda j: js IS NULL OR NOT list_contains(js, j)) AS ks FROM w LEFT JOIN lost USING (doc_id))
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - len(ks) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_transform(ks, lambda j: ws[j]), ' ')) AS kept_sha256 FROM kept""")
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left after removing 13-word windows that start in a document with a smaller id."""
    from tapeworks.llm.op4_substring import remove_repeats

    out = remove_repeats(documents(spark, sf_dir), window=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op2_suffix_dedup")
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes left after removing every 400-byte string that also starts elsewhere, and what is left as text."""
    from tapeworks.llm.op2_suffix import remove_repeats

    out = remove_repeats(documents(spark, sf_dir), depth=400)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
                      F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


SQL_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op9_jaccard_join", rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({SQL_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a), many AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(least.b, w.doc_id)) AS component_id, coalesce(n_links, 0) AS n_links
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least ON least.a = w.doc_id LEFT JOIN many ON many.a = w.doc_id""")
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 3-word shingles have a Jaccard similarity of 0.9 or more."""
    from tapeworks.llm.op9_jaccard import jaccard_join

    return jaccard_join(documents(spark, sf_dir), k=3, num=90, den=100)


@query("op1_mcd_quality")
def op1_mcd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text statistics, base rules and the verdict of robust distances per language and source."""
    from tapeworks.llm.op1_outliers import quality

    return quality(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op8_benchmark_containment", rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({SQL_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({SQL_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM benchmark),
dg AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d)),
bg AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM b)),
n AS (SELECT item_id, count(*) AS n FROM bg GROUP BY item_id)
SELECT doc_id, item_id, count(*) / any_value(n) AS containment FROM dg JOIN bg USING (g) JOIN n USING (item_id) GROUP BY ALL HAVING count(*) >= 0.8 * any_value(n)""".replace("GROUP BY ALL HAVING", "GROUP BY doc_id, item_id HAVING"))
def op8_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold 80 % or more of a benchmark item's 5-word shingles."""
    from tapeworks.llm.op8_contain import contained

    return contained(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query("op3_language_id")
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    from tapeworks.llm.op3_language import language

    return language(documents(spark, sf_dir))


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    from tapeworks.llm.op7_toxicity import toxicity

    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op10_pseudo_likelihood")
def op10_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked pseudo-likelihood of every document."""
    from tapeworks.llm.op10_pll import pseudo_likelihood

    return pseudo_likelihood(documents(spark, sf_dir))


@query("op5_preference_format", """
WITH t AS (SELECT conv_id, turn, min(row(coalesce(role, 'unknown'), coalesce(text, ''))) AS s FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
turns AS (SELECT conv_id, turn, s[1] AS role, s[2] AS text FROM t),
ends AS (SELECT conv_id, min(turn) FILTER (role = 'assistant') AS early, max(turn) FILTER (role = 'assistant') AS late, min(turn) AS first,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS said FROM turns GROUP BY conv_id),
opening AS (SELECT conv_id, said, role || chr(10) || text AS o FROM turns JOIN ends USING (conv_id) WHERE turn = first),
heads AS (SELECT o, min(conv_id) AS head, arg_min(said, conv_id) AS head_said FROM opening GROUP BY o HAVING count(*) > 1),
pairs AS (SELECT 'opening-' || conv_id AS pair_id, CASE WHEN head_said >= said THEN head ELSE conv_id END AS good, CASE WHEN head_said >= said THEN conv_id ELSE head END AS bad
  FROM opening JOIN heads USING (o) WHERE conv_id <> head),
sides AS (
  SELECT 'stale-' || conv_id AS pair_id, 'chosen' AS side, turn, role, text FROM turns JOIN ends USING (conv_id) WHERE early < late AND turn <= late
  UNION ALL SELECT 'stale-' || conv_id, 'rejected', turn, role, text FROM turns JOIN ends USING (conv_id) WHERE early < late AND turn < late
  UNION ALL SELECT 'stale-' || conv_id, 'rejected', late, role, text FROM turns JOIN ends USING (conv_id) WHERE early < late AND turn = early
  UNION ALL SELECT pair_id, 'chosen', turn, role, text FROM pairs JOIN turns ON conv_id = good
  UNION ALL SELECT pair_id, 'rejected', turn, role, text FROM pairs JOIN turns ON conv_id = bad),
m AS (SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.turn, r.turn) AS turn FROM (SELECT * FROM sides WHERE side = 'chosen') c
  FULL JOIN (SELECT * FROM sides WHERE side = 'rejected') r ON c.pair_id = r.pair_id AND c.turn = r.turn WHERE row(c.role, c.text) IS DISTINCT FROM row(r.role, r.text)),
cut AS (SELECT pair_id, min(turn) AS cut FROM m GROUP BY pair_id)
SELECT pair_id, CASE WHEN cut IS NULL OR turn < cut THEN 'prompt' ELSE side END AS part, turn, role, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS rendered,
  CASE WHEN turn >= cut AND role = 'assistant' THEN length(role) + 5 END AS loss_from
FROM sides LEFT JOIN cut USING (pair_id) WHERE side = 'chosen' OR turn >= cut""")
def op5_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts and masked completions of stale replies and of conversations that open alike."""
    from tapeworks.llm.op5_preference import preferences, same_openings, stale_replies

    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return preferences(stale_replies(talks).unionByName(same_openings(talks)))


@query("op6_soft_mixing")
def op6_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of documents that bring expected words of each domain to the targets."""
    from tapeworks.llm.op6_mixing import mix

    return mix(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op12_cuckoo_dedup", r"""
WITH d AS (SELECT row_number() OVER () AS tag, doc_id, coalesce(text, '') AS t FROM documents),
h AS (SELECT tag, doc_id, length(t) AS c, sha256(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS s FROM d),
r AS (SELECT doc_id, s, count(*) OVER (PARTITION BY s) AS n, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS k FROM h
  WINDOW w AS (PARTITION BY s ORDER BY c DESC, doc_id NULLS LAST, tag))
SELECT doc_id, keep_id, CAST(n AS BIGINT) AS group_size, k = 1 AS kept, s AS text_sha256 FROM r""")
def op12_cuckoo_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space, the row that stays, from an index behind cuckoo filters."""
    from tapeworks.llm.op12_cuckoo import exact_dedup

    return exact_dedup(documents(spark, sf_dir))


@query("op13_pair_maxscore", rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({SQL_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({SQL_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
total AS (SELECT count(*) FILTER (len(ws) > 0) AS n_docs, sum(len(ws))::BIGINT AS n_terms FROM d),
p AS (SELECT doc_id, any_value(n) AS n, t, count(*) AS tf FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS t FROM d) WHERE t IN (SELECT t FROM i) GROUP BY doc_id, t),
w AS (SELECT t, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, total GROUP BY t),
s AS (SELECT doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))) AS s FROM p JOIN w USING (t), total),
r AS (SELECT item_id, doc_id, sum(s)::BIGINT AS score FROM i JOIN s USING (t) GROUP BY item_id, doc_id HAVING sum(s) > 0),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM r)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 10""")
def op13_pair_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that rank highest for each benchmark item."""
    from tapeworks.llm.op13_maxscore import ranked

    return ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query("op11_spelling_variants", rf"""
WITH RECURSIVE crc AS (SELECT list(list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) ORDER BY i) AS tab FROM range(256) t(i)),
r AS (SELECT doc_id, unnest(regexp_extract_all({SQL_LOWER}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS r FROM documents),
d AS (SELECT doc_id, r, count(*) AS c FROM r WHERE length(r) >= 5 GROUP BY ALL),
b AS (SELECT r, c, list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || r, ''), lambda x: unicode(x)::BIGINT) AS u FROM d),
h AS (SELECT r, c, xor(list_reduce(flatten(list_transform(u, lambda x: CASE WHEN x < 128 THEN [x] ELSE [192 + x // 64, 128 + x % 64] END)),
  lambda a, x: xor(a >> 8, tab[xor(a & 255, x) + 1]), 4294967295), 4294967295) AS h FROM b, crc),
f AS (SELECT CASE WHEN h % 97 = 0 THEN r[:h % length(r)] || r[h % length(r) + 2:] ELSE r END AS word, c FROM h),
w AS (SELECT word, sum(c)::BIGINT AS n FROM f WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
x AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
e AS (SELECT a.word AS a, b.word AS b, b.n FROM x a JOIN x b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM x a JOIN w b ON a.cut = b.word UNION SELECT b.word, a.word, a.n FROM x a JOIN w b ON a.cut = b.word),
g AS (SELECT a, count(*) AS n_near, max(n) AS best_n FROM e GROUP BY a),
k AS (SELECT g.a, min(b) AS best FROM g JOIN e ON e.a = g.a AND e.n = best_n GROUP BY g.a),
o AS (SELECT word, CASE WHEN best_n >= 2 * n THEN best END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * n THEN best_n END AS form_n
  FROM w LEFT JOIN g ON g.a = word LEFT JOIN k ON k.a = word),
way(word, z) AS (SELECT word, word FROM o UNION ALL SELECT way.word, o.form FROM way JOIN o ON o.word = way.z WHERE o.form IS NOT NULL)
SELECT o.word, o.form, way.z AS root, o.n, o.n_near, o.form_n FROM o JOIN way ON way.word = o.word JOIN o last ON last.word = way.z AND last.form IS NULL""")
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with their near words, their most frequent form and the end of its chain."""
    from tapeworks.llm.op11_spelling import variants

    return variants(documents(spark, sf_dir))
