"""Quality rules from robust multivariate outliers, in DataFrame operations only.

Counts of words, characters, symbols, repeated lines and repeated word windows become a vector of transformed rates. For each
language and source the minimum covariance determinant is estimated by concentration steps: distances under the current mean
and covariance are binned, one combined aggregate per (group, bin) carries counts, sums and sums of products, and the bins
that hold the nearest ``SHARE`` of the group's documents give the next estimate. Vectors are whole multiples of 1 / SCALE,
so the sums are exact and do not depend on the order of rows. A last step reweights: all documents within CORE of the
robust estimate. Documents beyond ``cutoff`` (squared Mahalanobis distance) are rejected.

Rates are shrunk towards the group's mean (word length) or zero (the others), so a short text is no outlier by chance, and
variances have a floor, so a group whose documents all have no symbols is no point mass. Groups under ``least`` documents are
pooled, first by language, then all together; a pool still smaller gives no verdict. A null language or source is a value of
its own. Null, empty and short texts fail the base rules; an empty table gives an empty result.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.session import ensure_checkpoint_dir

FEATURES = ("length", "symbols", "lines", "repeats")
D = len(FEATURES)
SCALE, SHARE, STEPS, CORE, CONSISTENCY = 1024, 0.75, 4, 11.14, 1.485
FLOOR = (0.08, 0.2, 0.6, 0.6)
CUTOFF, LEAST, SMALL = 50.0, 50, 20_000
PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]
WINDOW = 8


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _covered(windows: Column) -> Column:
    """Words in windows whose hash occurs twice or more: gaps between the starts of such windows, a window's length at most."""
    def starts(s: Column) -> Column:
        twice = F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    ordered = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return let(let(ordered, starts), lambda p: F.aggregate(
        F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b))


def statistics(docs: DataFrame) -> DataFrame:
    """The table with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))

    def from_words(w: Column) -> Column:
        hashes = F.transform(w, lambda x: F.xxhash64(x))
        windows = let(hashes, lambda h: F.when(F.size(h) >= WINDOW, F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW)))))
        repeated = let(windows, lambda s: F.when(F.size(s) > F.size(F.array_distinct(s)), _covered(s)).otherwise(0))
        return F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated.cast("long").alias("n_repeat_words"))

    return docs.select(
        *[c for c in docs.columns if c != "text"], let(words, from_words).alias("by_word"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ).select("*", "by_word.*").drop("by_word")


#: SQL of the base rules and of the transformed vector; ``mean_length`` is the group's
BASE_FAILED = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"
VECTOR = {
    "length": "(word_chars + 100 * mean_length) / (n_words + 100)",
    "symbols": "ln(1 + 100.0 * n_symbols / (word_chars + 100))",
    "lines": "ln(1 + 800.0 * n_dup_lines / (n_words + 100))",
    "repeats": "ln(1 + 100.0 * n_repeat_words / (n_words + 100))",
}


def _bounded(df: DataFrame) -> DataFrame:
    """A small table as a broadcast, a large one as it is; counted, not guessed."""
    return F.broadcast(df) if df.count() <= SMALL else df


def _solved(moments: DataFrame, factor: float) -> DataFrame:
    """Mean and the lower triangle of the covariance's root for each group, from n, s<i> and p<i><j>."""
    out = moments.select("grp", *[(F.col(f"s{i}") / F.col("n") / SCALE).alias(f"m{i}") for i in range(D)], *[
        (factor * (F.col(f"p{i}{j}") / F.col("n") / SCALE ** 2 - F.col(f"s{i}") / F.col("n") / SCALE * (F.col(f"s{j}") / F.col("n") / SCALE))
         + (FLOOR[i] ** 2 if i == j else 0)).alias(f"c{i}{j}") for i, j in PAIRS])
    for j in range(D):
        below = [F.col(f"l{j}{k}") * F.col(f"l{j}{k}") for k in range(j)]
        out = out.withColumn(f"l{j}{j}", F.sqrt(F.greatest(reduce(lambda a, b: a - b, below, F.col(f"c{j}{j}")), F.lit(FLOOR[j] ** 2 / 4))))
        out = out.withColumns({f"l{i}{j}": reduce(lambda a, b: a - b, [F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)], F.col(f"c{i}{j}")) / F.col(f"l{j}{j}") for i in range(j + 1, D)})
    return out.drop(*[f"c{i}{j}" for i, j in PAIRS])


def _distance(df: DataFrame) -> DataFrame:
    for i in range(D):
        inner = reduce(lambda a, b: a - b, [F.col(f"l{i}{k}") * F.col(f"z{k}") for k in range(i)], F.col(f"q{i}") / SCALE - F.col(f"m{i}"))
        df = df.withColumn(f"z{i}", inner / F.col(f"l{i}{i}"))
    d2 = reduce(lambda a, b: a + b, [F.col(f"z{i}") * F.col(f"z{i}") for i in range(D)])
    return df.withColumn("d2", d2).drop(*[f"z{i}" for i in range(D)], *[f"m{i}" for i in range(D)], *[f"l{i}{j}" for i, j in PAIRS])


def _moments(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(f"q{i}").alias(f"s{i}") for i in range(D)], *[F.sum(F.col(f"q{i}") * F.col(f"q{j}")).alias(f"p{i}{j}") for i, j in PAIRS])


def _summed(df: DataFrame) -> DataFrame:
    return df.groupBy("grp").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in [f"s{i}" for i in range(D)] + [f"p{i}{j}" for i, j in PAIRS]])


def vectors(stats: DataFrame, least: int) -> DataFrame:
    """grp (the row's group or pool; null where even the last pool is too small) and q0.. of every row."""
    good = stats.where(f"NOT ({BASE_FAILED})")
    by = good.groupBy("lang", "source").agg(F.count("*").alias("n_ls"), F.sum("word_chars").alias("chars"), F.sum("n_words").alias("words"))
    small = F.col("n_ls") < least
    rest = by.where(small)
    langs = rest.groupBy("lang").agg(F.sum("n_ls").alias("n_l"), F.sum("chars").alias("l_chars"), F.sum("words").alias("l_words"))
    pool = langs.where(F.col("n_l") < least).agg(F.sum("n_l").alias("n_all"), F.sum("l_chars").alias("a_chars"), F.sum("l_words").alias("a_words"))
    langs = langs.withColumnRenamed("lang", "lang_")
    named = by.join(langs, small & F.col("lang").eqNullSafe(F.col("lang_")), "left").join(F.broadcast(pool), F.col("n_l") < least, "left")
    level = F.when(~small, 0).when(F.col("n_l") >= least, 1).when(F.col("n_all") >= least, 2)
    name = F.xxhash64(level, F.when(level < 2, F.col("lang")), F.when(level < 1, F.col("source")), F.when(level < 2, F.col("lang").isNull()), F.when(level < 1, F.col("source").isNull()))
    mean = F.when(level == 0, F.col("chars") / F.col("words")).when(level == 1, F.col("l_chars") / F.col("l_words")).otherwise(F.col("a_chars") / F.col("a_words"))
    groups = named.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), F.when(level.isNotNull(), name).alias("grp"), mean.alias("mean_length")).checkpoint()
    out = stats.join(_bounded(groups), F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left").drop("g_lang", "g_source")
    return out.withColumns({f"q{i}": F.floor(F.expr(VECTOR[f]) * SCALE + 0.5).cast("long") for i, f in enumerate(FEATURES)}).drop("mean_length")


def estimate(rows: DataFrame) -> DataFrame:
    """Robust mean and covariance root of each group: quartiles to start, concentration steps, one reweighting."""
    start = rows.groupBy("grp").agg(*[F.percentile(f"q{i}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"t{i}") for i in range(D)])
    now = start.select("grp", *[(F.col(f"t{i}")[1] / SCALE).alias(f"m{i}") for i in range(D)], *[
        (F.greatest((F.col(f"t{i}")[2] - F.col(f"t{i}")[0]) / 1.349 / SCALE, F.lit(FLOOR[i])) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i, j in PAIRS]).checkpoint()
    for step in range(STEPS + 1):
        near = _distance(rows.join(_bounded(now), "grp"))
        if step < STEPS:
            binned = _moments(near.withColumn("bin", F.floor(8 * F.log2(F.col("d2") + 1e-6))), "grp", "bin")
            held, all_ = F.sum("n").over(_order()), F.sum("n").over(_whole())
            kept = binned.withColumns({"held": held, "all": all_}).where(F.col("held") - F.col("n") < SHARE * F.col("all"))
            now = _solved(_summed(kept), CONSISTENCY).checkpoint()
        else:
            now = _solved(_moments(near.where(F.col("d2") <= CORE), "grp"), 1.0).checkpoint()
    return now


def _whole():
    from pyspark.sql import Window

    return Window.partitionBy("grp")


def _order():
    return _whole().orderBy("bin")


def quality(docs: DataFrame, cutoff: float = CUTOFF, least: int = LEAST) -> DataFrame:
    """doc_id, lang, source, the statistics, base_failed, distance (squared; null without a verdict or where base_failed) and kept."""
    ensure_checkpoint_dir(docs.sparkSession)
    rows = vectors(statistics(docs.select("doc_id", "lang", "source", "text")).checkpoint(), least)
    good = rows.where(f"NOT ({BASE_FAILED}) AND grp IS NOT NULL").select("grp", *[f"q{i}" for i in range(D)])
    out = _distance(rows.join(_bounded(estimate(good)), "grp", "left"))
    failed = F.expr(BASE_FAILED)
    return out.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        F.when(~failed, F.col("d2")).alias("distance"), (~failed & (F.coalesce("d2", F.lit(0.0)) <= cutoff)).alias("kept"))
