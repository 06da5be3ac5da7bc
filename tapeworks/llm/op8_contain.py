"""Size-partitioned MinHash containment search: short test items inside long documents.

Items are partitioned by their number of distinct k-word shingles into classes whose sizes differ by a factor of about
sqrt(2). For a class, a document is cut into windows of 1.5 times the class's largest size that start every half of it, so
wherever an item stands, some window holds it whole and is not much longer than it: the similarity to be found is that of
item and window, never that of item and document. Window and item are compared by ``hashes`` MinHash values of one hash
each; a single equal value makes the document a candidate of the item. With containment of 0.8 and 32 values a window misses
an item with probability below 1e-5, and neighbouring windows mostly hold it again. Items of at most ``SHORT`` shingles, of which
a window would be too small a part to say so, are looked up by each of their shingles: a document with any of them is a candidate.
Candidates are verified exactly: the share of the item's distinct shingles that the whole document has.

Items travel to the tasks as a broadcast of at most ``most_shingles`` shingles; more items are searched in several blocks of
that bound, one pass over the documents each. Items or documents with fewer than k words have no shingle and match
nothing; null texts count as empty; repeated items and documents each give their own rows; either table may be empty. A doc_id is
an integer or null. ``carry`` names columns of the documents that follow containment in the result.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.hashing import U, grams, mix, slices, texts, word_hashes

SCHEMA = "doc_id long, item_id long, containment double"
SHORT = 3
_OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("containment", pa.float64())])


def size_class(n: int) -> int:
    """Classes end at 4, 6, 8, 12, 16, 24 ...: powers of two and their halfway marks."""
    top = 4
    while top < n:
        top = top * 3 // 2 if top & (top - 1) == 0 else top * 4 // 3
    return top


class Items:
    """Shingle sets of a block of items and, for each size class, their MinHash values."""

    def __init__(self, item_ids: list[int], sets: list[np.ndarray], hashes: int):
        self.ids, self.sets, self.hashes = item_ids, sets, hashes
        self.classes: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        by: dict[int, list[int]] = {}
        short = [i for i, s in enumerate(sets) if len(s) <= SHORT]
        keys = np.concatenate([np.zeros(0, U), *[sets[i] for i in short]])
        order = np.argsort(keys, kind="stable")
        self.short = keys[order], np.repeat(short, [len(sets[i]) for i in short]).astype(np.int64)[order]
        for i, s in enumerate(sets):
            if len(s) > SHORT:
                by.setdefault(size_class(len(s)), []).append(i)
        for top, members in by.items():
            values = []
            for seed in range(hashes):
                v = np.array([mix(sets[i], seed + 1).min() for i in members], U)
                order = np.argsort(v, kind="stable")
                values.append((v[order], np.array(members)[order]))
            self.classes[top] = values

    def candidates(self, h: np.ndarray, cut: np.ndarray) -> list[tuple[int, int]]:
        """Distinct (document number, item number) pairs, from the shingles of documents that lie one after the other."""
        found = []
        v, item = self.short
        if len(v):
            lo, hi = np.searchsorted(v, h), np.searchsorted(v, h, "right")
            for w in np.flatnonzero(hi > lo):
                d = int(np.searchsorted(cut, w, "right")) - 1
                found += [(d, int(i)) for i in item[lo[w]:hi[w]]]
        starts, doc = {}, {}
        for top in self.classes:
            half = (top + 1) // 2
            n = np.diff(cut)
            many = -(-n // half)
            doc[top] = np.repeat(np.arange(len(n)), many)
            starts[top] = cut[doc[top]] + (np.arange(len(doc[top])) - np.repeat(np.cumsum(many) - many, many)) * half
        for seed in range(self.hashes):
            ranked = mix(h, seed + 1)
            for top, values in self.classes.items():
                at, owner = starts[top], doc[top]
                if not len(at):
                    continue
                least = np.minimum.reduceat(ranked, at)
                wide = least.copy()
                for shift in (1, 2):  # a window is three halves of one document
                    wide[:-shift] = np.where(owner[shift:] == owner[:-shift], np.minimum(wide[:-shift], least[shift:]), wide[:-shift])
                v, item = values[seed]
                lo, hi = np.searchsorted(v, wide), np.searchsorted(v, wide, "right")
                hit = np.flatnonzero(hi > lo)
                for w, a, b in zip(owner[hit], lo[hit], hi[hit]):
                    found += [(int(w), int(i)) for i in item[a:b]]
        return sorted(set(found))

    def verified(self, shingles: np.ndarray, items: list[int]) -> list[float]:
        own = np.unique(shingles)
        out = []
        for i in items:
            s = self.sets[i]
            at = np.minimum(np.searchsorted(own, s), len(own) - 1)
            out.append(float((own[at] == s).sum()) / len(s))
        return out


def blocks(items: DataFrame, k: int, most_shingles: int):
    """Items with their shingle sets, in blocks of at most ``most_shingles`` shingles (a longer item is a block of its own)."""
    ids, sets, total = [], [], 0
    for row in items.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        words, first = word_hashes(*texts(pa.array([row["text"]], pa.string())), fold=True)
        s = np.unique(grams(words, first, k)[0])
        if not len(s):
            continue
        if ids and total + len(s) > most_shingles:
            yield ids, sets
            ids, sets, total = [], [], 0
        ids.append(row["item_id"])
        sets.append(s)
        total += len(s)
    if ids:
        yield ids, sets


def contained(docs: DataFrame, items: DataFrame, k: int = 5, least: float = 0.8, hashes: int = 32, most_shingles: int = 1_000_000, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, item_id, containment and the carried columns of every pair with at least ``least`` of the item's shingles in the document."""
    spark = docs.sparkSession
    read = docs.select("doc_id", "text", *carry)
    schema = ", ".join([SCHEMA, *[f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema.fields[2:]]])
    out = None
    for ids, sets in blocks(items, k, most_shingles):
        known = spark.sparkContext.broadcast((ids, sets))

        def search(batches, known=known):
            index = Items(*known.value, hashes)
            for batch in batches:
                rows, at = [], []
                buf, off = texts(batch["text"])
                doc_ids = batch["doc_id"].cast(pa.int64()).to_pylist()
                for i, j in slices(off):
                    words, first = word_hashes(buf[off[i]:off[j]], off[i:j + 1] - off[i], fold=True)
                    h, _, doc = grams(words, first, k)
                    if not len(h):
                        continue
                    cut = np.searchsorted(doc, np.arange(j - i + 1))
                    by: dict[int, list[int]] = {}
                    for d, item in index.candidates(h, cut):
                        by.setdefault(d, []).append(item)
                    for d, some in by.items():
                        for item, share in zip(some, index.verified(h[cut[d]:cut[d + 1]], some)):
                            if share >= least:
                                rows.append((doc_ids[i + d], index.ids[item], share))
                                at.append(i + d)
                found = [pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[], [], []], _OUT.types)]
                more = [batch[c].take(pa.array(at, pa.int64())) for c in carry]
                yield pa.RecordBatch.from_arrays(found + more, names=[*_OUT.names, *carry])

        part = read.mapInArrow(search, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)
