"""Ranked lexical search with MaxScore whose bounds come from single terms and from precomputed pairs of terms.

The index lies in segments of up to ``SEGMENT`` documents, made where the documents are read: for every term that some query holds,
the documents with it and their counts, delta-free and sorted. Document and term counts are summed over all segments first; then each
segment turns counts into integer impacts and keeps, for each term, its greatest impact and, for pairs of a query's strongest terms,
the intersection of their lists with the greatest joint impact. A document's share of a set of terms is at most the sum of their
maxima, and at most the joint maxima of disjoint pairs plus the maxima of the rest; greedy pairing takes the pairs that lower the sum
most. Terms whose combined bound is under the tenth best score so far can't lift a document on their own: only documents in the other
terms' lists are scored, and each is dropped once what it has and the bound of the terms to come fall short. Nothing is skipped at
equal scores, so results are exact.

Each task passes on the ten best documents of each query, and a window over queries picks ten of them, so a query's rows grow with
tasks, not with documents. Queries travel to the tasks in blocks of at most ``most_terms`` term occurrences; more queries are searched in
several blocks, one pass each. Null or empty texts and items have no term and give no row; long texts are split whole, at any length;
repeated items and documents each rank on their own, equal scores by ascending doc_id (null last); either table may be empty.
"""
from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.llm.hashing import slices, texts
from tapeworks.session import ensure_checkpoint_dir

LAST = np.iinfo(np.int64).max
SEGMENT, BEST, STRONG = 8192, 10, 8
SPLIT = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
SEGMENTS = "docs long, terms long, ids binary, sizes binary, held binary, ends binary, doc binary, tf binary"
_SEGMENTS = pa.schema([("docs", pa.int64()), ("terms", pa.int64()), *[(c, pa.binary()) for c in ("ids", "sizes", "held", "ends", "doc", "tf")]])
FOUND = "item_id long, item long, doc_id long, score long"
_FOUND = pa.schema([(c, pa.int64()) for c in ("item_id", "item", "doc_id", "score")])


def split(buf: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of texts that lie one after the other, and the number of each term's text."""
    data = pa.py_buffer(buf.tobytes().translate(SPLIT))
    column = pa.Array.from_buffers(pa.large_string(), len(off) - 1, [None, pa.py_buffer(np.ascontiguousarray(off, np.int64)), data])
    parts = pc.split_pattern(column, " ")
    flat, text = parts.flatten(), pc.list_parent_indices(parts)
    some = pc.not_equal(flat, "")
    return flat.filter(some), text.filter(some).to_numpy(zero_copy_only=False).astype(np.int64)


def blocks(items: DataFrame, most_terms: int):
    """Queries as (item_id, distinct terms), in blocks of at most ``most_terms`` (a longer query is a block of its own)."""
    out, total = [], 0
    for row in items.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        terms = sorted(set(split(*texts(pa.array([row["text"]], pa.string())))[0].to_pylist()))
        if not terms:
            continue
        if out and total + len(terms) > most_terms:
            yield out
            out, total = [], 0
        out.append((row["item_id"], terms))
        total += len(terms)
    if out:
        yield out


def segments(docs: DataFrame, terms: list[str]) -> DataFrame:
    """The index: a row for each segment, with sizes of its documents and lists of the given terms."""
    known = docs.sparkSession.sparkContext.broadcast(terms)

    def build(batches):
        value_set = pa.array(known.value, pa.large_string())
        waiting: list[tuple] = []

        def pack():
            ids, sizes = (np.concatenate([w[i] for w in waiting]) for i in (0, 1))
            shift = np.cumsum([0] + [len(w[0]) for w in waiting[:-1]])
            term, doc, tf = np.concatenate([w[2] for w in waiting]), np.concatenate([w[3] + s for w, s in zip(waiting, shift)]), np.concatenate([w[4] for w in waiting])
            order = np.lexsort((doc, term))
            held, start = np.unique(term[order], return_index=True)
            columns = [ids, sizes, held.astype(np.int32), np.append(start[1:], len(term)).astype(np.int32)[:len(held)], doc[order].astype(np.int32), tf[order].astype(np.int32)]
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array([int((sizes > 0).sum())]), pa.array([int(sizes.sum())]), *[pa.array([c.tobytes()], pa.binary()) for c in columns]], schema=_SEGMENTS)

        for batch in batches:
            buf, off = texts(batch["text"])
            ids = batch["doc_id"].cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False)
            for i, j in slices(off, 8 << 20):
                flat, text = split(buf[off[i]:off[j]], off[i:j + 1] - off[i])
                term = pc.index_in(flat, value_set=value_set)
                mine = term.is_valid().to_numpy(zero_copy_only=False)
                key = text[mine] * len(value_set) + term.drop_null().to_numpy()
                key, tf = np.unique(key, return_counts=True)
                waiting.append((ids[i:j], np.bincount(text, minlength=j - i).astype(np.int64), key % len(value_set), key // len(value_set), tf))
                if sum(len(w[0]) for w in waiting) >= SEGMENT:
                    yield pack()
        if waiting:
            yield pack()

    return docs.select("doc_id", "text").mapInArrow(build, SEGMENTS)


def frequencies(index: DataFrame) -> DataFrame:
    """term (its number), df: how many documents hold each term."""

    def counts(batches):
        total: dict[int, int] = {}
        for b in batches:
            for held, ends in zip(b["held"].to_pylist(), b["ends"].to_pylist()):
                ends = np.frombuffer(ends, np.int32)
                for t, n in zip(np.frombuffer(held, np.int32).tolist(), np.diff(ends, prepend=0).tolist()):
                    total[t] = total.get(t, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["term", "df"])

    return index.select("held", "ends").mapInArrow(counts, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


class Segment:
    """Impact lists of a segment with the greatest impact of each term and the joint lists of pairs."""

    def __init__(self, row: dict, weights: np.ndarray, n_docs: int, n_terms: int):
        self.ids, size = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["sizes"], np.int64)
        m = 10 + (90 * size * n_docs) // max(1, n_terms)
        held, ends = np.frombuffer(row["held"], np.int32), np.frombuffer(row["ends"], np.int32)
        doc, tf = np.frombuffer(row["doc"], np.int32), np.frombuffer(row["tf"], np.int32).astype(np.int64)
        impact = np.repeat(weights[held], np.diff(ends, prepend=0)) * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        self.lists = {int(t): (doc[a:b], impact[a:b]) for t, a, b in zip(held, ends - np.diff(ends, prepend=0), ends)}
        self.most = {t: int(v.max()) for t, (_, v) in self.lists.items()}
        self.pairs: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, int]] = {}

    def strong(self, terms: list[int]) -> list[int]:
        """A query's terms that are here, the greatest impact first."""
        return sorted((t for t in terms if self.most.get(t)), key=lambda t: (-self.most[t], t))

    def pair(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents with both terms, their joint impacts, and the most that any document gets from the two."""
        key = (min(a, b), max(a, b))
        if key not in self.pairs:
            (da, va), (db, vb) = self.lists[key[0]], self.lists[key[1]]
            both, i, j = np.intersect1d(da, db, assume_unique=True, return_indices=True)
            joint = va[i] + vb[j]
            self.pairs[key] = both, joint, max(int(joint.max()) if len(joint) else 0, self.most[a], self.most[b])
        return self.pairs[key]

    def index_pairs(self, queries: list[list[int]]) -> None:
        for terms in queries:
            for a, b in combinations(self.strong(terms)[:STRONG], 2):
                self.pair(a, b)

    def bounds(self, terms: list[int]) -> list[int]:
        """For each k, the most that a document gets from terms[k:]: maxima of single terms, lowered by disjoint pairs."""
        out = []
        for k in range(len(terms) + 1):
            rest = terms[k:]
            saved = sorted(((self.most[a] + self.most[b] - p[2], a, b) for a, b in combinations(rest, 2) if (p := self.pairs.get((min(a, b), max(a, b))))), reverse=True)
            bound, used = sum(self.most[t] for t in rest), set()
            for less, a, b in saved:
                if less > 0 and a not in used and b not in used:
                    bound -= less
                    used |= {a, b}
            out.append(bound)
        return out

    def _score(self, docs: np.ndarray, terms: list[int]) -> np.ndarray:
        out = np.zeros(len(docs), np.int64)
        for t in terms:
            out += self._of(docs, t)
        return out

    def _of(self, docs: np.ndarray, term: int) -> np.ndarray:
        d, v = self.lists[term]
        at = np.minimum(np.searchsorted(d, docs), len(d) - 1)
        return np.where(d[at] == docs, v[at], 0)

    def search(self, terms: list[int], best: int) -> tuple[np.ndarray, np.ndarray]:
        """The best documents with scores above 0, at most ``best``, and their scores."""
        terms = self.strong(terms)
        if not terms:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        bound = self.bounds(terms)
        # a first threshold from the documents that lead the joint lists and the strongest list
        seeds = [self.lists[terms[0]]] + [self.pairs[p][:2] for a, b in combinations(terms[:STRONG], 2) if (p := (min(a, b), max(a, b))) in self.pairs and len(self.pairs[p][0])]
        first = np.unique(np.concatenate([d[np.argpartition(-v, min(best, len(v)) - 1)[:best]] for d, v in seeds]))
        scores = self._score(first, terms)
        least = int(np.sort(scores)[-best]) if len(scores) >= best else 0
        need = next(k for k in range(len(terms), -1, -1) if k == 0 or bound[k - 1] >= max(least, 1))  # terms[need:] can't do it alone
        lists = [self.lists[t] for t in terms[:need]]
        docs, place = np.unique(np.concatenate([d for d, _ in lists]), return_inverse=True)
        have = np.zeros(len(docs), np.int64)
        np.add.at(have, place, np.concatenate([v for _, v in lists]))
        for k in range(need, len(terms)):
            stay = have + bound[k] >= max(least, 1)
            docs, have = docs[stay], have[stay]
            have = have + self._of(docs, terms[k])
            if len(have) > best:
                least = max(least, int(np.partition(have, len(have) - best)[len(have) - best]))
        stay = have >= max(least, 1)
        docs, have = docs[stay], have[stay]
        order = np.lexsort((self.ids[docs], -have))[:best]
        return self.ids[docs[order]], have[order]


def ranked(docs: DataFrame, items: DataFrame, best: int = BEST, most_terms: int = 1_000_000) -> DataFrame:
    """item_id, rank, doc_id and score of each item's best documents."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    found, base = None, 0
    for queries in blocks(items, most_terms):
        terms = sorted({t for _, ts in queries for t in ts})
        number = {t: i for i, t in enumerate(terms)}
        index = segments(docs, terms).checkpoint()
        total = index.agg(F.sum("docs"), F.sum("terms")).first()
        n_docs, n_terms = int(total[0] or 0), int(total[1] or 0)
        weights = np.zeros(len(terms), np.int64)
        for r in frequencies(index).toLocalIterator():  # a row for each term of the block at most
            weights[r["term"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))
        known = spark.sparkContext.broadcast((weights, [(i, [number[t] for t in ts]) for i, ts in queries]))

        def search(batches, known=known, n_docs=n_docs, n_terms=n_terms, base=base):
            weights, queries = known.value
            top: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries]
            for b in batches:
                for i in range(len(b)):
                    row = b.slice(i, 1).to_pylist()[0]
                    part = Segment(row, weights, n_docs, n_terms)
                    part.index_pairs([ts for _, ts in queries])
                    for q, (_, ts) in enumerate(queries):
                        ids, scores = (np.concatenate([x, y]) for x, y in zip(top[q], part.search(ts, best)))
                        order = np.lexsort((ids, -scores))[:best]
                        top[q] = ids[order], scores[order]
            ids, scores = (np.concatenate([t[k] for t in top]) for k in (0, 1))
            which = np.repeat(np.arange(len(queries)), [len(t[0]) for t in top])
            item_ids = pa.array([i for i, _ in queries], pa.int64()).take(pa.array(which))
            yield pa.RecordBatch.from_arrays([item_ids, pa.array(which + base), pa.array(ids, mask=ids == LAST), pa.array(scores)], schema=_FOUND)

        part = index.mapInArrow(search, FOUND)
        found = part if found is None else found.unionByName(part)
        base += len(queries)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best).select("item_id", "rank", "doc_id", "score")
