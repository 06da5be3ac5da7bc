"""Questions that groups of documents ask about keys of the whole corpus, in blobs instead of a row per key.

Documents lie in homes, hash ranges of doc_id of even size. A home sends its distinct keys, sorted, to buckets of the
key space; a bucket sees a key from every home that holds it and answers each home with one bit per key, in the order
sent. The home derives the same keys again and reads the bits. A key held by a third of the corpus is one entry per
home, so no bucket grows with it; homes and buckets grow in number with ``spark.sql.shuffle.partitions``, not in size. A
partition may hold several homes, taken one after the other: a worker and its executor hold the texts of one at a time.

Questions: ``narrow`` (does the key occur twice or more, and somewhere as an anchor? 30 bits of the key and two
flags are sent, so a yes may be false and a no never is), ``wide`` (does it occur twice or more, by all 64 bits) and
``smaller`` (has the key an owner with a smaller id in another home?). ``count`` (how often does the key occur, on a scale
of a quarter of a power of two? 32 bits are sent, so it may be too often, alike for all who ask). The last, ``pair``, sends keys of two parts, 30 bits
of an outer and all of an inner one that may be unknown: does the inner part occur twice or more (first answer), and does
the outer part while some holder of it got a no (second answer)?
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.hashing import U

LAST = np.iinfo(np.int64).max
#: homes for each partition; more of them are smaller and lie in the partitions more evenly, but each sends a blob to each bucket
HOMES = 2
ASK = "bucket int, home int, kind int, keys binary, owners binary"
REPLY = "home int, bucket int, kind int, n int, bits binary"
_ASK = pa.schema([("bucket", pa.int32()), ("home", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("owners", pa.binary())])
_REPLY = pa.schema([("home", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int32()), ("n", pa.int32()), ("bits", pa.binary())])


def width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def home(n: int) -> Column:
    """Which of n homes a row lies in."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int").alias("home")


def homed(docs: DataFrame, columns: list[str], homes: int = 1) -> DataFrame:
    """The named columns with the home of each row, one shuffle that all passes share; homes: how many for each partition."""
    n = width(docs)
    return docs.select(home(homes * n), *columns).repartition(n, "home")


def by_id(table: pa.Table) -> pa.Table:
    """Rows by doc_id; a row without one counts as the largest."""
    return table.sort_by([("doc_id", "ascending")])


def ids(table: pa.Table) -> np.ndarray:
    return table["doc_id"].cast(pa.int64()).fill_null(LAST).to_numpy()


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and whether each occurs more than once."""
    h = np.sort(h)
    if not len(h):
        return h, np.zeros(0, bool)
    new = np.concatenate(([True], h[1:] != h[:-1]))
    return h[new], ~np.append(new[1:], True)[new]


def _cuts(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of n buckets, equal ranges of the keys' upper 32 bits, starts among the sorted keys, and their end."""
    return np.append(np.searchsorted(keys, np.array([(-(-(b << 32) // n)) << 32 for b in range(n)], U)), len(keys))


def ask(home: int, questions: list[tuple], n: int) -> pa.Table:
    """questions: ("narrow", sorted distinct keys, twice here, anchor here), ("wide", keys, twice here), ("smaller", keys,
    smallest owner here), ("count", keys, times here) or ("pair", outer keys, inner keys, twice here, inner known); the place in the list is the kind."""
    rows: list[tuple] = []
    for kind, (what, keys, *more) in enumerate(questions):
        cut = _cuts(keys, n)
        for b in np.flatnonzero(np.diff(cut)):
            part = slice(cut[b], cut[b + 1])
            owners = np.packbits(more[0][part]).tobytes() if what == "wide" else _thin(more[0][part]) if what == "smaller" else more[0][part].tobytes() if what == "pair" else more[0][part].astype(np.uint32).tobytes() if what == "count" else b""
            sent = keys[part]
            if what == "count":
                sent = (sent & U(0xFFFFFFFF)).astype(np.uint32)
            elif what in ("narrow", "pair"):
                sent = (((sent & U(0x3FFFFFFF)) << U(2)) | (more[-2][part].astype(U) << U(1)) | more[-1][part].astype(U)).astype(np.uint32)
            rows.append((int(b), home, kind, sent.tobytes(), owners))
    return table_of(rows, _ASK)


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(columns, schema.types)], schema=schema)


def _thin(owners: np.ndarray) -> bytes:
    if len(owners) and 0 <= owners.min() and owners.max() < 2**32:
        return b"4" + owners.astype(np.uint32).tobytes()
    return b"8" + owners.tobytes()


def _wide(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.uint32 if blob[:1] == b"4" else np.int64, offset=1).astype(np.int64)


def _repeated(sent: np.ndarray) -> np.ndarray:
    """Of keys as ``narrow`` sends them, with the flags in the last two bits, those to answer yes to, sorted."""
    sent.sort()
    keys = sent >> np.uint32(2)
    new = np.concatenate(([True], keys[1:] != keys[:-1]))
    flags = np.bitwise_or.reduceat((sent & np.uint32(3)).astype(np.uint8), np.flatnonzero(new))
    many = ~np.append(new[1:], True)[new] | (flags & 2).astype(bool)
    return keys[new][many & (flags & 1).astype(bool)]


def _among(keys: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which keys are among some, which are sorted."""
    if not len(some):
        return np.zeros(len(keys), bool)
    return some[np.minimum(np.searchsorted(some, keys), len(some) - 1)] == keys


def replies(asked: DataFrame, kinds: list[str]) -> DataFrame:
    """One bit for each key that was sent (two for a pair), dealt out by home so that every later pass reads the same shuffle."""

    def answer(table):
        out = []
        bucket = table["bucket"][0].as_py()
        for kind in sorted(set(table["kind"].to_pylist())):
            rows = table.filter(pc.equal(table["kind"], kind))
            what = kinds[kind]
            blobs = rows["keys"].to_pylist()
            parts = [np.frombuffer(b, np.uint32 if what in ("narrow", "pair", "count") else U) for b in blobs]
            sizes = [len(p) for p in parts]
            if what == "narrow":
                yes = _repeated(np.concatenate(parts))
                for home, part in zip(rows["home"].to_pylist(), parts):
                    out.append((home, bucket, kind, len(part), np.packbits(_among(part >> np.uint32(2), yes)).tobytes()))
                continue
            keys = np.concatenate(parts)
            if what == "pair":
                anchors, flags, keys = (keys & np.uint32(1)).astype(bool), (keys & np.uint32(2)).astype(bool), keys >> np.uint32(2)
            elif what == "wide":
                flags = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=s) for b, s in zip(rows["owners"].to_pylist(), sizes)]).astype(bool)
            inner = np.concatenate([np.frombuffer(b, U) for b in rows["owners"].to_pylist()]) if what == "pair" else None
            order = np.argsort(keys, kind="stable") if inner is None else np.lexsort((inner, keys))
            k = keys[order]
            first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            if what == "count":
                times = np.concatenate([np.frombuffer(b, np.uint32) for b in rows["owners"].to_pylist()]).astype(np.float64)[order]
                level = np.empty(len(k), np.uint8)
                level[order] = np.repeat(4 * np.log2(np.add.reduceat(times, first)), np.diff(np.append(first, len(k)))).astype(np.uint8)
                at = 0
                for home, s in zip(rows["home"].to_pylist(), sizes):
                    out.append((home, bucket, kind, s, level[at:at + s].tobytes()))
                    at += s
                continue
            if what == "smaller":
                own = np.concatenate([_wide(b) for b in rows["owners"].to_pylist()])[order]
                least = np.repeat(np.minimum.reduceat(own, first), np.diff(np.append(first, len(k))))
                yes = least < own
            else:
                size = np.diff(np.append(first, len(k)))
                many = (size > 1) | np.logical_or.reduceat(flags[order], first)
                yes = np.repeat(many, size)
            said = [yes]
            if what == "pair":
                i = inner[order]
                part = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (i[1:] != i[:-1]))))
                held = np.diff(np.append(part, len(k)))
                twice = np.repeat(((held > 1) | np.logical_or.reduceat(flags[order], part)) & np.logical_and.reduceat(anchors[order], part), held)
                said = [twice, np.repeat(many & ~np.logical_and.reduceat(twice, first), size)]
            bits = np.empty((len(said), len(k)), bool)
            bits[:, order] = said
            at = 0
            for home, s in zip(rows["home"].to_pylist(), sizes):
                out.append((home, bucket, kind, s, np.packbits(bits[:, at:at + s]).tobytes()))
                at += s
        return table_of(out, _REPLY)

    return asked.groupBy("bucket").applyInArrow(answer, REPLY).repartition(width(asked), "home")


def read(table: pa.Table, kinds: list[str]) -> list[np.ndarray]:
    """The answers to each question, in the order of the keys sent; two arrays for a pair, small numbers for a count."""
    out = []
    table = table.sort_by([("kind", "ascending"), ("bucket", "ascending")])
    kind = table["kind"].to_numpy()
    size, blob = table["n"].to_pylist(), table["bits"].to_pylist()
    for k, what in enumerate(kinds):
        if what == "count":
            out.append(np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(blob[i], np.uint8) for i in np.flatnonzero(kind == k))]))
            continue
        rows = 2 if what == "pair" else 1
        got = [np.unpackbits(np.frombuffer(blob[i], np.uint8), count=rows * size[i]).reshape(rows, size[i]) for i in np.flatnonzero(kind == k)]
        out += list(np.concatenate(got, 1).astype(bool)) if got else [np.zeros(0, bool)] * rows
    return out


def lookup(sent: np.ndarray, bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The bit of each of ``h``, all of which were sent."""
    if not len(sent):
        return np.zeros(len(h), bool)
    return bits[np.searchsorted(sent, h)]


def counted(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each occurs."""
    return np.unique(h, return_counts=True)
