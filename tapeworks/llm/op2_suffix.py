"""Repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are ordered only through ``depth`` bytes, most significant digit first; a pass splits each group by its next
digit and drops suffixes that are alone, and the groups left at full depth are exactly the repeated windows. Only equality
of digits matters here, so a digit is the hash of a byte range and groups meet by hash. Three things keep a pass small:

* Suffixes travel in runs. The first digit of a suffix is the least ``depth // 2``-byte gram of its window (the rightmost
  of equals) together with its distance from the window's start; neighbours share the gram, and equal windows have equal
  gram and distance. A run holds the suffixes with one gram whose distances lie in one aligned block.
* The bytes common to all windows of a block are the run's next digit: if they occur once, every suffix of it is alone.
* The bytes of all windows of a block together are the rest of the depth: if they occur twice, every window of it repeats.

A group in which neither settles every run is split, in blocks of 64, 8 and finally one suffix, whose last digit is the
whole window.

Null texts are empty; texts shorter than ``depth`` lose nothing; matches never cross documents, overlaps and repeats within
a document count; copies of a row repeat each other. An empty table gives an empty result.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeworks.llm import exchange as X
from tapeworks.llm.hashing import SMALL, U, RangeHash, slices, sliding_min, texts

BLOCKS = (64, 8, 1)
SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


class Suffixes:
    """The suffixes of one home's texts, in runs; a pass takes the answers to the one before."""

    def __init__(self, table: pa.Table, depth: int):
        self.table = X.by_id(table)
        self.buf, self.off = texts(self.table["text"])
        self.depth, self.gram = depth, depth // 2
        self.reach = depth - self.gram
        self.repeated: list[tuple[np.ndarray, np.ndarray]] = []
        self.doc, self.anchor, self.first, self.last = self._runs()

    def _runs(self):
        """Runs of windows with one anchor and distances in one block of BLOCKS[0]: text, anchor, first and last window start."""
        parts = []
        for i, j in slices(self.off, SMALL):
            base, off = self.off[i], self.off[i:j + 1] - self.off[i]
            n = int(off[-1])
            if n < self.depth:
                continue
            h = RangeHash(self.buf[base:base + n]).windows(self.gram)
            h &= U(0xFFFFFFFF00000000)
            h |= U(0xFFFFFFFF) - np.arange(len(h), dtype=U)
            best = sliding_min(h, self.reach + 1)
            # neighbours with one anchor first, then the part of them in its text, then their blocks
            new = np.flatnonzero(np.concatenate(([True], best[1:] != best[:-1])))
            anchor = (U(0xFFFFFFFF) - (best[new] & U(0xFFFFFFFF))).astype(np.int64)
            doc = np.searchsorted(off, anchor, "right") - 1
            first, last = np.maximum(new, off[doc]), np.minimum(np.append(new[1:], len(best)) - 1, off[doc + 1] - self.depth)
            ok = first <= last
            doc, anchor, first, last = self._split(doc[ok], anchor[ok], first[ok], last[ok], BLOCKS[0])
            parts.append((doc + i, anchor + base, first + base, last + base))
        return [np.concatenate(p) for p in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 4

    def _hash(self, start: np.ndarray, end: np.ndarray, doc: np.ndarray) -> np.ndarray:
        out = np.empty(len(start), U)
        for i, j in slices(self.off, SMALL):
            a, b = np.searchsorted(doc, (i, j))
            if a < b:
                base = self.off[i]
                out[a:b] = RangeHash(self.buf[base:self.off[j]])(start[a:b] - base, end[a:b] - base)
        return out

    def digits(self, level: int):
        """For each run, hashes of what the windows of its block have in common and of all they cover, and whether its text holds all that."""
        size = BLOCKS[level]
        near = (self.anchor - self.first) // size * size
        far = np.minimum(near + size - 1, self.reach)
        common = self._hash(self.anchor - near, self.anchor - far + self.depth, self.doc)
        if size == 1:
            return common, common, np.ones(len(common), bool), None
        start, end = self.anchor - far, self.anchor - near + self.depth
        whole = (start >= self.off[self.doc]) & (end <= self.off[self.doc + 1])
        cover = np.zeros(len(start), U)
        cover[whole] = self._hash(start[whole], end[whole], self.doc[whole])
        return common, cover, whole, start

    def _grouped(self, level: int):
        """Order of the runs by their digits, where a new pair of digits starts, and the sorted digits and places."""
        common, cover, whole, start = self.digits(level)
        order = np.lexsort((start, whole, cover, common))
        c, v, w = common[order], cover[order], whole[order]
        new = np.concatenate(([True], (c[1:] != c[:-1]) | (v[1:] != v[:-1]) | (w[1:] != w[:-1]))) if len(c) else np.zeros(0, bool)
        return order, new, c, v, w, start[order]

    def question(self, level: int) -> tuple:
        if BLOCKS[level] == 1:
            return "wide", *X.distinct(self.digits(level)[1])
        order, new, c, v, w, at = self._grouped(level)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(c)) - 1
        # the blocks of two anchors may cover the same place, which counts once
        return "pair", c[first], v[first], at[first] != at[last], w[first]

    def settle(self, level: int, bits: list[np.ndarray]) -> None:
        """Note the runs that repeat, and split those of whose block some holder is open."""
        if BLOCKS[level] == 1:
            _, cover, *_ = self.digits(level)
            yes = X.lookup(np.unique(cover), bits[0], cover)
            self.repeated.append((self.first[yes], self.last[yes]))
            return
        order, new, *_ = self._grouped(level)
        spot = np.empty(len(order), np.int64)
        spot[order] = np.cumsum(new) - 1
        yes, left = (b[spot] if len(spot) else np.zeros(0, bool) for b in bits)
        self.repeated.append((self.first[yes], self.last[yes]))
        size = BLOCKS[level + 1]
        doc, anchor, first, last = (a[left] for a in (self.doc, self.anchor, self.first, self.last))
        self.doc, self.anchor, self.first, self.last = self._split(doc, anchor, first, last, size)

    @staticmethod
    def _split(doc, anchor, first, last, size: int):
        """The runs cut so that the distances of each lie in one aligned block of ``size``."""
        high, low = (anchor - first) // size, (anchor - last) // size
        n = high - low + 1
        run = np.repeat(np.arange(len(n)), n)
        block = high[run] - (np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n))
        anchor = anchor[run]
        return doc[run], anchor, np.maximum(first[run], anchor - (block * size + size - 1)), np.minimum(last[run], anchor - block * size)

    def covered(self) -> np.ndarray:
        edge = np.zeros(len(self.buf) + 1, np.int64)
        for first, last in self.repeated:
            np.add.at(edge, first, 1)
            np.add.at(edge, last + self.depth, -1)
        return np.cumsum(edge[:-1]) > 0


#: the question of each level, and where its answers start
KINDS = ["pair", "pair", "wide"]
START = (0, 2, 4, 5)


def remove_repeats(docs: DataFrame, depth: int = 400, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the carried columns, n_bytes, n_removed, kept (the bytes left, as binary) and spans (start and end of each removed run)."""
    n = X.width(docs)
    base = X.homed(docs, ["doc_id", "text", *carry])

    def passed(table: pa.Table, reply, level: int) -> Suffixes:
        s = Suffixes(table, depth)
        bits = X.read(reply, KINDS) if reply is not None else []
        for k in range(level):
            s.settle(k, bits[START[k]:START[k + 1]])
        return s

    def asker(level: int):
        def first(key, table):
            return X.ask(key[0].as_py(), [passed(table, None, 0).question(0)], n)

        def later(key, table, reply):
            return X.ask(key[0].as_py(), [passed(table, reply, level).question(level)], n)
        return later if level else first

    def finish(key, table, reply):
        s = passed(table, reply, len(BLOCKS))
        gone = s.covered()
        edge = np.diff(np.concatenate(([0], gone, [0])).astype(np.int8))
        cut = s.off[1:-1][(s.off[1:-1] > 0) & (s.off[1:-1] < len(gone))]
        split = cut[gone[cut] & gone[cut - 1]]
        starts, ends = np.sort(np.append(np.flatnonzero(edge == 1), np.unique(split))), np.sort(np.append(np.flatnonzero(edge == -1), np.unique(split)))
        mark = np.searchsorted(starts, s.off)
        before = np.concatenate(([0], np.cumsum(gone)))
        removed = np.diff(before[s.off])
        kept, spans = [], []
        data = s.buf.tobytes()
        for i in range(len(s.off) - 1):
            a, b = int(s.off[i]), int(s.off[i + 1])
            x, y = starts[mark[i]:mark[i + 1]].tolist(), ends[mark[i]:mark[i + 1]].tolist()
            spans.append([{"start": p - a, "end": q - a} for p, q in zip(x, y)])
            kept.append(b"".join(data[p:q] for p, q in zip([a, *y], [*x, b])))
        more = {"n_bytes": pa.array(np.diff(s.off), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.binary()), "spans": pa.array(spans, SPAN)}
        return pa.table({c: s.table[c] for c in ("doc_id", *carry)} | more)

    schema = T.StructType([*docs.select("doc_id", *carry).schema, *T._parse_datatype_string("n_bytes long, n_removed long, kept binary, spans array<struct<start:long,end:long>>")])
    known = None
    for level in range(len(BLOCKS)):
        left = base.groupBy("home")
        asked = left.applyInArrow(asker(0), X.ASK) if known is None else left.cogroup(known.groupBy("home")).applyInArrow(asker(level), X.ASK)
        reply = X.replies(asked, [KINDS[level]]).withColumn("kind", F.lit(level))
        known = reply if known is None else known.unionByName(reply)
    return base.groupBy("home").cogroup(known.groupBy("home")).applyInArrow(finish, schema)
