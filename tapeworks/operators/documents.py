"""Nested documents, term tables over texts, numbers with check digits, and a stored search index."""
from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.functions import text as T
from tapeworks.session import ensure_checkpoint_dir

# -- JSON ---------------------------------------------------------------------------------


def walk_json(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, depth, path, name, kind, value): every value of each well-formed document, level by level.

    ``value`` is the text of a string, number or boolean. The text is parsed once to a variant; a level's objects and arrays are
    exploded into the next one until none is left, so neither depth nor width is bounded. Malformed and null documents have no rows.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    level = df.select(F.col(key), F.lit("$").alias("path"), F.lit(None).cast("string").alias("name"), F.try_parse_json(text).alias("v")).where("v IS NOT NULL")
    out, depth = None, 0
    while True:
        level = level.withColumn("kind", F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0)).checkpoint()
        leaf = F.when(~F.col("kind").isin("OBJECT", "ARRAY", "VOID"), F.expr("try_variant_get(v, '$', 'string')"))
        part = level.select(key, F.lit(depth).alias("depth"), "path", "name", "kind", leaf.alias("value"))
        out = part if out is None else out.unionByName(part)
        inner = level.where(F.col("kind").isin("OBJECT", "ARRAY"))
        if not inner.limit(1).count():
            return out
        below = inner.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select(
            key, F.concat("path", F.when(F.col("key").isNull(), F.format_string("[%d]", F.col("pos"))).otherwise(F.concat(F.lit("."), F.col("key")))).alias("path"), F.col("key").alias("name"), "value")
        level = below.withColumnRenamed("value", "v")
        depth += 1


def json_threats(df: DataFrame, key: str, text: str, rules: Mapping[str, str] = T.THREATS, required: Sequence[str] = ()) -> DataFrame:
    """A row for each document: well-formed or not, depth, values, strings, names and strings that meet each threat rule, missing required fields."""
    nodes = walk_json(df, key, text)
    meets = {n: (F.coalesce(F.col("name").rlike(p), F.lit(False)).cast("long") + F.coalesce((F.col("kind") == "STRING") & F.col("value").rlike(p), F.lit(False)).cast("long")) for n, p in rules.items()}
    per = nodes.groupBy(key).agg(
        F.max("depth").alias("depth"), F.count(F.lit(1)).alias("n_values"), F.sum((F.col("kind") == "STRING").cast("long")).alias("n_strings"),
        *[F.sum(c).alias(f"threat_{n}") for n, c in meets.items()], F.count_distinct(F.when((F.col("depth") == 1) & F.col("name").isin(list(required) or [""]), F.col("name"))).alias("_have"))
    all_docs = df.select(F.col(key), F.col(text).isNull().alias("is_null"))
    j = all_docs.join(per, key, "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("depth", "n_values", "n_strings", *[f"threat_{n}" for n in rules])]
    return j.select(key, (~F.col("is_null") & F.col("n_values").isNull()).alias("malformed"), *zero, F.when(F.col("n_values").isNotNull(), F.lit(len(required)) - F.col("_have")).alias("n_missing"))


def json_schema(df: DataFrame, text: str) -> DataFrame:
    """One row: the schema that holds for all well-formed documents."""
    return df.select(F.schema_of_variant_agg(F.try_parse_json(text)).alias("schema"))


# -- term tables --------------------------------------------------------------------------

FOUND = "id long, term string, n long, first long"
_FOUND = pa.schema([("id", pa.int64()), ("term", pa.string()), ("n", pa.int64()), ("first", pa.int64())])


def term_blocks(terms: DataFrame, most_chars: int) -> Iterator[list[str]]:
    """Distinct terms in blocks of at most ``most_chars`` characters (a longer term is a block of its own)."""
    block, size = [], 0
    for (t,) in terms.toDF("t").where("length(t) > 0").distinct().orderBy("t").toLocalIterator():
        if block and size + len(t) > most_chars:
            yield block
            block, size = [], 0
        block.append(t)
        size += len(t)
    if block:
        yield block


def find_terms(df: DataFrame, key: str, text: str, terms: DataFrame, most_chars: int = 4_000_000) -> DataFrame:
    """(id, term, n, first): each term (one string column) that a text holds, how often (overlaps count) and where first, from 1.

    One pass over the texts with an Aho-Corasick automaton for each block of terms; a block's size bounds the broadcast.
    """
    import ahocorasick

    spark, out = df.sparkSession, None
    for block in term_blocks(terms, most_chars):
        known = spark.sparkContext.broadcast(block)

        def search(batches, known=known):
            machine = ahocorasick.Automaton()
            for t in known.value:
                machine.add_word(t, t)
            machine.make_automaton()
            for b in batches:
                ids, names, counts, firsts = [], [], [], []
                for i, s in zip(b["k"].to_pylist(), b["t"].to_pylist()):
                    hits: dict[str, list[int]] = {}
                    for end, t in machine.iter(s or ""):
                        got = hits.setdefault(t, [0, end - len(t) + 2])
                        got[0] += 1
                    ids += [i] * len(hits)
                    names += hits
                    counts += [v[0] for v in hits.values()]
                    firsts += [v[1] for v in hits.values()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((ids, names, counts, firsts), _FOUND.types)], schema=_FOUND)

        part = df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(search, FOUND)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], FOUND)


# -- numbers with check digits --------------------------------------------------------------

#: digit groups of card numbers and account numbers as they are written
CARD_RUN = r"\b[0-9](?:[ -]?[0-9]){12,18}\b"
IBAN_RUN = r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b"


def luhn(number: Column) -> Column:
    """Whether the digits of a string, from the right, every second doubled and cast out of nines, add up to a multiple of ten."""
    digits = F.transform(F.split(F.reverse(F.regexp_replace(number, "[^0-9]", "")), ""), lambda d: d.cast("int"))
    digits = F.filter(digits, lambda d: d.isNotNull())
    total = F.aggregate(F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))), F.lit(0), lambda s, x: s + x)
    return (F.size(digits) > 0) & (total % 10 == 0)


def mod97(account: Column) -> Column:
    """Whether an account number with its first four places moved behind, letters as 10 to 35, leaves 1 when divided by 97."""
    moved = F.concat(F.substring(account, 5, 64), F.substring(account, 1, 4))
    step = lambda s, c: F.when(c.between("0", "9"), (s * 10 + F.ascii(c) - 48) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step) == 1


def checked_numbers(text: str) -> list[Column]:
    """cards and accounts: the numbers of a text whose check digits hold."""
    cards = F.filter(F.regexp_extract_all(text, F.lit(CARD_RUN), F.lit(0)), luhn)
    accounts = F.filter(F.regexp_extract_all(text, F.lit(IBAN_RUN), F.lit(0)), mod97)
    return [F.coalesce(cards, F.array().cast("array<string>")).alias("cards"), F.coalesce(accounts, F.array().cast("array<string>")).alias("accounts")]


def longest_listed_run(text: str, words: Sequence[str]) -> Column:
    """The longest run of consecutive words of a text that are all in a word list: seed phrases have 12 to 24 of their list."""
    known = F.array(*[F.lit(w) for w in sorted(set(words))])
    parts = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^a-z]+"), lambda w: w != "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))
    step = lambda s, w: F.struct(F.when(F.array_contains(known, w), s["now"] + 1).otherwise(0).alias("now"), F.greatest(s["best"], F.when(F.array_contains(known, w), s["now"] + 1).otherwise(0)).alias("best"))
    return F.aggregate(parts, start, step, lambda s: s["best"])


# -- stored search ------------------------------------------------------------------------


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters: those that start at each place, in three passes of runs side by side."""
    low = F.lower(text)
    each = [F.regexp_extract_all(F.substring(low, F.lit(1 + i), F.length(low)), F.lit("(?s)..."), F.lit(0)) for i in range(3)]
    return F.array_distinct(F.concat(*each))


class PostIndex:
    """Posts (id, ts, text) and the trigrams that each holds, as Parquet folders partitioned by hours.

    A build makes about ``FOLDERS`` folders at most, each of a whole number of hours, one hour each where the posts span no more.

    A search reads only folders with hours asked for, intersects the postings of the needle's trigrams, and verifies the needle on the whole
    texts of what is left; a needle under three characters is looked for in all texts of those hours. Postings are rows, so a
    trigram that most posts hold is spread over files and no list is ever gathered.
    """

    FOLDERS = 256

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @classmethod
    def build(cls, posts: DataFrame, folder: str) -> "PostIndex":
        d = posts.select("id", "ts", "text", F.date_format(F.date_trunc("hour", "ts"), "yyyyMMddHH").cast("long").alias("hour"))
        # a folder for each hour of a long time would be as many small files, listed by every search
        nth = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)
        first, last = posts.agg(F.min(nth), F.max(nth)).first()
        width = 1 if first is None else -(-(last - first + 1) // cls.FOLDERS)
        of = lambda h: F.date_format(F.timestamp_seconds(h * 3600), "yyyyMMddHH").cast("long")
        start = F.floor(nth / width) * width
        d = d.withColumn("hour_from", of(start)).withColumn("hour_to", of(start + width - 1)).repartitionByRange("hour_from", "hour", "id")
        by = ["hour_from", "hour_to"]
        d.sortWithinPartitions(*by, "hour").write.mode("append").partitionBy(*by).parquet(f"{folder}/posts")
        d.select(*by, "hour", "id", F.explode(trigrams(F.col("text"))).alias("gram")).sortWithinPartitions(*by, "hour", "gram").write.mode("append").partitionBy(*by).parquet(f"{folder}/grams")
        return cls(posts.sparkSession, folder)

    def search(self, needle: str, now: str, hours_back: int) -> DataFrame:
        """id, ts and text of posts of the hours (now - hours_back, now] that hold the needle, letter case aside."""
        end = F.lit(now).cast("timestamp")
        begin = end - F.make_interval(hours=F.lit(hours_back))
        hour = lambda t: F.date_format(F.date_trunc("hour", t), "yyyyMMddHH").cast("long")
        low, high = self.spark.range(1).select(hour(begin), hour(end)).first()
        within = (F.col("hour_from") <= int(high)) & (F.col("hour_to") >= int(low)) & F.col("hour").between(int(low), int(high))
        posts = self.spark.read.parquet(f"{self.folder}/posts").where(within & (F.col("ts") > begin) & (F.col("ts") <= end))
        grams = sorted({needle.lower()[i:i + 3] for i in range(len(needle) - 2)})
        if grams:
            held = self.spark.read.parquet(f"{self.folder}/grams").where(within & F.col("gram").isin(grams))
            posts = posts.join(held.groupBy("hour", "id").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams)).select("hour", "id"), ["hour", "id"], "left_semi")
        return posts.where(F.contains(F.lower("text"), F.lit(needle.lower()))).select("id", "ts", "text")


def tag_trend(posts: DataFrame, size: str, pattern: str = r"#(\w+)", k: int = 10) -> DataFrame:
    """(window, tag, n, change): the k most used tags of each time window and their change against the window before."""
    from pyspark.sql import Window

    tags = posts.select("ts", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(1)))).alias("tag"))
    n = tags.groupBy(F.window("ts", size)["start"].alias("window"), "tag").agg(F.count(F.lit(1)).alias("n"))
    before = n.select((F.col("window") + F.expr(f"interval {size}")).alias("window"), "tag", F.col("n").alias("_b"))
    w = Window.partitionBy("window").orderBy(F.col("n").desc(), "tag")
    return n.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).join(before, ["window", "tag"], "left").select("window", "tag", "n", (F.col("n") - F.coalesce("_b", F.lit(0))).alias("change"))
