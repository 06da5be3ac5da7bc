"""From raw documents to a weighted training corpus, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns of ``documents``; the last adds rates.

Quality rules and benchmark decontamination decide by row: rows that share a doc_id, or have none, and differ otherwise have
verdicts of their own. Rows that share a doc_id are one document to the near-duplicate stage and stay or go together there;
rows with a null doc_id are never near duplicates. Columns beyond those of documents are dropped by the first stage.
"""
from __future__ import annotations

from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm.op1_outliers import quality
from tapeworks.llm.op4_substring import remove_repeats
from tapeworks.llm.op6_mixing import DOMAINS, mix
from tapeworks.llm.op8_contain import contained
from tapeworks.llm.op9_jaccard import jaccard_join
from tapeworks.session import ensure_checkpoint_dir

FEW = 500_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def row_key() -> Column:
    """Tells rows of one doc_id apart by all that a verdict depends on."""
    return F.xxhash64("text", "lang", "source", F.col("text").isNull(), F.col("lang").isNull())


def without(docs: DataFrame, keys: list[Column], gone: DataFrame) -> DataFrame:
    """The documents whose keys are not a row of gone; a null is equal to a null.

    Up to ``FEW`` rows, as counted, are broadcast so that texts needn't move; more are joined by shuffle.
    """
    names = [f"_gone{i}" for i in range(len(keys))]
    gone = gone.toDF(*names).distinct().checkpoint()
    gone = F.broadcast(gone) if gone.count() <= FEW else gone.hint("merge")
    return docs.join(gone, reduce(lambda a, b: a & b, [k.eqNullSafe(F.col(n)) for k, n in zip(keys, names)]), "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the robust distances reject."""
    rows = docs.select(F.struct("doc_id", row_key().alias("row")).alias("doc_id"), "lang", "source", "text")
    return without(docs.select(*COLUMNS), [F.col("doc_id"), row_key()], quality(rows).where("NOT kept").select("doc_id.*"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group linked by 5-word shingles at a similarity of 0.8 or more."""
    return without(docs, [F.col("doc_id")], jaccard_join(docs, k=5, num=80, den=100).where("component_id <> doc_id").select("doc_id"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without 13-word windows that a document with a smaller id has; documents of which nothing is left go."""
    out = remove_repeats(docs, window=13, carry=("lang", "source", "n_chars"), spacing=True)
    changed = F.col("n_removed") > 0
    return out.where(~changed | (F.col("n_words") > F.col("n_removed"))).select(
        "doc_id", F.col("kept_text").alias("text"), "lang", "source", F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    rows = docs.select("doc_id", "text", row_key().alias("row"))
    return without(docs, [F.col("doc_id"), row_key()], contained(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=("row",)).select("doc_id", "row"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus with posteriors over the domains and the rate at which to draw each document."""
    out = mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=("lang", "source"))
    return out.select("doc_id", "lang", "source", "n_words", *[f"p_{d}" for d in DOMAINS], "rate")


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_items),
    ("mixing", mixture),
]

#: the robust estimates, the classifier and the fitted rates have no counterpart in SQL; tests/llm compares with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what stands between them lies in the shared folder for checkpoints."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
