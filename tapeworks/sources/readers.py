"""Scans, sinks and stored baselines."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CANDLE_SCHEMA = "timestamp TIMESTAMP, symbol STRING, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE"
CANDLE_COLUMNS = ("open", "high", "low", "close", "volume")


def read_candles(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Candle file(s) with a declared schema; malformed rows fail the read instead of becoming nulls."""
    r = spark.read.schema(CANDLE_SCHEMA)
    df = r.option("header", True).option("mode", "FAILFAST").csv(path) if fmt == "csv" else r.format(fmt).load(path)
    return require_columns(df.withColumnRenamed("timestamp", "ts"), ("ts", "symbol", *CANDLE_COLUMNS))


def require_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def ingest_records(spark: SparkSession, records, schema: str) -> DataFrame:
    """Local dict-of-lists or list-of-dicts (small, interactive input) to a typed DataFrame."""
    if isinstance(records, dict):
        keys = list(records)
        records = [dict(zip(keys, vals)) for vals in zip(*records.values())]
    return spark.createDataFrame(records, schema)


def ingest_json(df: DataFrame, col: str, schema: str) -> DataFrame:
    """JSON text column to typed columns; unparsable rows give nulls and keep the text."""
    return df.select("*", F.from_json(col, schema, {"mode": "PERMISSIVE"}).alias("_j")).select(*df.columns, "_j.*")


def latest_n(df: DataFrame, n: int, symbols: Sequence | None = None, per_symbol: bool = True, key: str = "symbol",
             ts: str = "ts", tie: Sequence[str] = ()) -> DataFrame:
    """Newest n rows per symbol. row_number <= n lets Spark keep only n rows per task before the
    shuffle (WindowGroupLimit), so a hot symbol never reaches one task whole."""
    d = df if symbols is None else df.where(F.col(key).isin(list(symbols)))
    order = [F.col(c).desc() for c in (ts, *tie)]
    if not per_symbol:
        return d.orderBy(*order).limit(n * (len(symbols) if symbols else 1))
    rn = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return d.withColumn("_rn", rn).where(F.col("_rn") <= n).drop("_rn")


def range_scan(df: DataFrame, start, end, symbol=None, key: str = "symbol", ts: str = "ts") -> DataFrame:
    """Closed time range; the bounds reach the scan as pushed filters."""
    d = df.where(F.col(ts).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    return d if symbol is None else d.where(F.col(key) == symbol)


def hourly_pick(df: DataFrame, key: str = "symbol", ts: str = "ts", tie: Sequence[str] = ()) -> DataFrame:
    """The row closest after each full hour; min_by combines map-side."""
    rest = [c for c in df.columns if c != key]
    return (df.groupBy(key, F.date_trunc("hour", ts).alias("hour"))
              .agg(F.min_by(F.struct(*rest), F.struct(ts, *tie)).alias("_r")).select(key, "hour", "_r.*"))


def table_metadata(df: DataFrame, key: str = "symbol", ts: str = "ts") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_symbols"),
                  F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts"))


def distinct_symbols(df: DataFrame, key: str = "symbol") -> DataFrame:
    return df.select(key).distinct()


def score_file(spark: SparkSession, model, src: str, schema: str, out: str, fmt: str = "csv") -> None:
    """File in, fitted model, file out; partitioned end to end."""
    df = spark.read.schema(schema).option("header", True).format(fmt).load(src)
    scored = model.transform(df)
    keep = [f.name for f in scored.schema.fields if f.dataType.typeName() not in ("vectorudt", "array", "struct", "map")]
    scored.select(*keep).write.mode("errorifexists").option("header", True).format(fmt).save(out)


def write_report(df: DataFrame, path: str, fmt: str = "json", by: Sequence[str] = ()) -> None:
    w = df.write.mode("overwrite")
    if by:
        w = w.partitionBy(*by)
    (w.option("header", True).csv(path) if fmt == "csv" else w.format(fmt).save(path))


def metrics_text(df: DataFrame, name: str = "name", value: str = "value", labels: str | None = None) -> DataFrame:
    """One exposition line per metric row: name{labels} value."""
    lab = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(labels), lambda e: F.format_string('%s="%s"', e["key"], e["value"])), ","), F.lit("}")) if labels else F.lit("")
    return df.select(F.concat(F.col(name), lab, F.lit(" "), F.col(value).cast("string")).alias("value"))


def save_baseline(stats: DataFrame, dataset: str, path: str) -> None:
    """Per-feature statistics keyed by dataset; one folder per dataset is replaced."""
    (stats.withColumn("dataset", F.lit(dataset)).write.mode("overwrite")
          .option("partitionOverwriteMode", "dynamic").partitionBy("dataset").parquet(path))


def load_baseline(spark: SparkSession, dataset: str, path: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("dataset") == dataset).drop("dataset")
