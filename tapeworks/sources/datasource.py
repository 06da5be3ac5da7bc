"""``candles``: a data source of bars in CSV files under a manifest; ``metrics_text``: a sink of metric lines.

A write makes one file for each task under names of its own, and its commit adds them to the folder's manifest with row counts and
ranges of symbol and time; a reader opens only files of the manifest, so what failed or speculative tasks leave is never seen. A
read is one partition for each file, and filters on symbol and time leave out files by their ranges before any is opened. Paths are
those of a file system that all executors see.

    df.write.format("candles").mode("append").save(folder)
    spark.read.format("candles").load(folder).where("symbol = 'BTC'")
"""
from __future__ import annotations

import datetime as dt
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from uuid import uuid4

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

MANIFEST = "_manifest.json"
NUMBERS = ("open", "high", "low", "close", "volume")
CANDLE = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"
_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)


def _us(ts) -> int | None:
    """Microseconds of a timestamp; one without a zone is UTC."""
    if ts is None:
        return None
    if ts.tzinfo is None:
        ts = ts.replace(tzinfo=dt.timezone.utc)
    return (ts - _EPOCH) // dt.timedelta(microseconds=1)


def _manifest(path: str) -> list[dict]:
    file = os.path.join(path, MANIFEST)
    if not os.path.exists(file):
        return []
    with open(file, encoding="utf-8") as f:
        return json.load(f)


def _publish(path: str, files: list[dict]) -> None:
    """The manifest is replaced in one step."""
    new = os.path.join(path, f".{uuid4().hex}")
    with open(new, "w", encoding="utf-8") as f:
        json.dump(files, f)
    os.replace(new, os.path.join(path, MANIFEST))


@dataclass
class Written(WriterCommitMessage):
    files: list[dict] = field(default_factory=list)


class FolderWriter(DataSourceWriter):
    """A file for each task; ``_write`` fills it and returns what the manifest holds of it."""

    suffix = ".csv"

    def __init__(self, path: str, columns: list[str], overwrite: bool):
        self.path, self.columns, self.overwrite = path, columns, overwrite

    def write(self, iterator) -> Written:
        os.makedirs(self.path, exist_ok=True)
        name = f"part-{uuid4().hex}{self.suffix}"
        with open(os.path.join(self.path, name), "w", encoding="utf-8", newline="") as f:
            about = self._write(f, iterator)
        if not about["rows"]:
            os.remove(os.path.join(self.path, name))
            return Written()
        return Written([{"file": name, **about}])

    def _write(self, f, rows) -> dict:
        raise TypeError

    def commit(self, messages: list[Written | None]) -> None:
        os.makedirs(self.path, exist_ok=True)
        _publish(self.path, ([] if self.overwrite else _manifest(self.path)) + [x for m in messages if m for x in m.files])

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            for x in m.files if m else []:
                os.remove(os.path.join(self.path, x["file"]))


#: what a line of a file holds: symbol, microseconds, numbers
LINE = pa.schema([("symbol", pa.string()), ("ts", pa.int64()), *[(c, pa.float64()) for c in NUMBERS]])
ROW = LINE.set(1, pa.field("ts", pa.timestamp("us", "UTC")))


class CandleWriter(FolderWriter, DataSourceArrowWriter):
    """Whole Arrow batches become lines; a null is an empty field."""

    def _write(self, f, rows) -> dict:
        n, symbols, times = 0, [], []
        with csv.CSVWriter(f.buffer, LINE, write_options=csv.WriteOptions(include_header=False, quoting_style="needed")) as out:
            for batch in rows:
                cols = {c: batch.column(i) for i, c in enumerate(self.columns)}
                cols["ts"] = cols["ts"].cast(pa.timestamp("us", getattr(cols["ts"].type, "tz", None)))
                lines = pa.record_batch([cols[x.name].cast(x.type) for x in LINE], schema=LINE)
                out.write_batch(lines)
                n += len(lines)
                for seen, c in ((symbols, "symbol"), (times, "ts")):
                    low, high = pc.min_max(lines[c]).as_py().values()
                    if low is not None:
                        seen[:] = [min([low, *seen[:1]]), max([high, *seen[1:]])]
        return {"rows": n, "symbol": symbols, "ts": times}


class MetricsWriter(FolderWriter):
    """Lines of the form name{label="value"} number; the columns name and value, all others are labels."""

    suffix = ".prom"

    def _write(self, f, rows) -> dict:
        n = 0
        for r in rows:
            labels = ",".join(f"{c}={json.dumps(str(r[c]), ensure_ascii=False)}" for c in self.columns if c not in ("name", "value") and r[c] is not None)
            f.write(f"{r['name']}{{{labels}}} {float(r['value'])!r}\n" if labels else f"{r['name']} {float(r['value'])!r}\n")
            n += 1
        return {"rows": n}


@dataclass
class FilePart(InputPartition):
    file: str = ""


class CandleReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.symbols, self.low, self.high = path, None, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Symbols and time ranges narrow the files; every filter is handed back, for rows within files."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("symbol",):
                self.symbols = {f.value}
            elif isinstance(f, In) and f.attribute == ("symbol",):
                self.symbols = set(f.value)
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("ts",):
                self.low = max(_us(f.value), self.low if self.low is not None else _us(f.value))
            elif isinstance(f, (LessThan, LessThanOrEqual)) and f.attribute == ("ts",):
                self.high = min(_us(f.value), self.high if self.high is not None else _us(f.value))
            yield f

    def _may(self, x: dict) -> bool:
        if self.symbols is not None and (not x["symbol"] or not any(x["symbol"][0] <= s <= x["symbol"][1] for s in self.symbols if s is not None)):
            return False
        if self.low is not None and (not x["ts"] or x["ts"][1] < self.low):
            return False
        return self.high is None or (bool(x["ts"]) and x["ts"][0] <= self.high)

    def partitions(self) -> list[FilePart]:
        return [FilePart(x["file"]) for x in _manifest(self.path) if self._may(x)] or [FilePart("")]

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        convert = csv.ConvertOptions(column_types=LINE, null_values=[""], strings_can_be_null=True)
        with csv.open_csv(os.path.join(self.path, partition.file), csv.ReadOptions(use_threads=False, column_names=LINE.names),
                          csv.ParseOptions(newlines_in_values=True), convert) as lines:
            for batch in lines:
                yield pa.record_batch([batch[x.name].cast(x.type) for x in ROW], schema=ROW)


class Candles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "candles"

    def schema(self) -> str:
        return CANDLE

    def reader(self, schema: StructType) -> CandleReader:
        return CandleReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> CandleWriter:
        missing = {"symbol", "ts", "open", "high", "low", "close", "volume"} - set(schema.names)
        if missing:
            raise ValueError(f"candles need the columns {sorted(missing)}")
        return CandleWriter(self.options["path"], schema.names, overwrite)


class MetricsText(DataSource):
    @classmethod
    def name(cls) -> str:
        return "metrics_text"

    def writer(self, schema: StructType, overwrite: bool) -> MetricsWriter:
        return MetricsWriter(self.options["path"], schema.names, overwrite)


def register(spark: SparkSession) -> SparkSession:
    for source in (Candles, MetricsText):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark
