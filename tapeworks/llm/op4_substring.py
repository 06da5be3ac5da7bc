"""Fixed-block anchors: exact repeats of word windows across documents.

Every document is cut into non-overlapping reference blocks of (window + 1) // 2 words, so each of its windows holds a
whole block. All rolling windows of a block's length probe the blocks. Where a probed block occurs at more than one place,
the hit is extended over the full windows around it, and these decide: a window goes if its words also start in a document
with a smaller doc_id. Runs of such windows are the maximal repeats.

Null, empty and shorter texts lose no word. Rows with the same doc_id don't count against each other; a null doc_id counts
as the largest. Columns to be carried along are named by the caller, others are left out. An empty table gives an empty
result.
"""
from __future__ import annotations

import re
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeworks.llm import exchange as X
from tapeworks.llm.hashing import U, covered, gram_parts, texts, word_hashes

SPAN = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _cut(text: bytes, edge: np.ndarray) -> bytes:
    """The text without the runs of words between pairs of edges."""
    if not len(edge):
        return text
    start = [m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)] + [len(text)]
    at = [0, *(start[e] for e in edge), len(text)]
    return b"".join(text[a:b] for a, b in zip(at[::2], at[1::2]))


def remove_repeats(docs: DataFrame, window: int = 13, carry: tuple[str, ...] = (), spacing: bool = False) -> DataFrame:
    """doc_id, the carried columns, n_words, n_removed, kept_text and spans (first and last word of each removed run).

    kept_text joins the words by one space; with ``spacing`` it is the text as it was, without each removed word and the white
    space after it."""
    block, n = (window + 1) // 2, X.width(docs)
    base = X.homed(docs, ["doc_id", "text", *carry], X.HOMES)

    def probes(table: pa.Table):
        """Words and first words, the distinct rolling blocks and whether each occurs twice, and the reference blocks."""
        words, first = word_hashes(*texts(table["text"]))
        every, fixed = [np.zeros(0, U)], [np.zeros(0, U)]
        for h, pos, doc in gram_parts(words, first, block):
            every.append(h)
            fixed.append(h[(pos - first[doc]) % block == 0])
        return words, first, *X.distinct(np.concatenate(every)), np.concatenate(fixed)

    def ask_blocks(key, table):
        *_, keys, twice, fixed = probes(X.by_id(table))
        reference = np.zeros(len(keys), bool)
        reference[np.searchsorted(keys, fixed)] = True
        return X.ask(key[0].as_py(), [("narrow", keys, twice, reference)], n)

    def extended(table: pa.Table, hits: np.ndarray):
        """The full windows around hits, their distinct hashes and the smallest doc_id here of each."""
        words, first, keys, *_ = probes(table)
        hit = np.zeros(int(first[-1]), bool)
        for h, pos, _ in gram_parts(words, first, block):
            hit[pos] = X.lookup(keys, hits, h)
        before = np.concatenate(([0], np.cumsum(hit)))
        found = [(np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for g, at, doc in gram_parts(words, first, window):
            near = before[at + window - block + 1] > before[at]
            found.append((g[near], at[near], doc[near]))
        g, at, doc = (np.concatenate(c) for c in zip(*found))
        keys, where = np.unique(g, return_index=True)
        return first, g, at, doc, keys, X.ids(table)[doc[where]]

    def ask_windows(key, table, reply):
        *_, keys, least = extended(X.by_id(table), X.read(reply, ["narrow"])[0])
        return X.ask(key[0].as_py(), [("smaller", keys, least)], n)

    def finish(key, table, reply):
        table = X.by_id(table)
        hits, older = X.read(reply, ["narrow", "smaller"])
        first, g, at, doc, keys, least = extended(table, hits)
        spot = np.searchsorted(keys, g)
        gone = (older[spot] | (least[spot] < X.ids(table)[doc])) if len(g) else np.zeros(0, bool)
        cover = covered(int(first[-1]), at[gone], window)
        kept, spans, removed = [], [], []
        for i, text in enumerate(table["text"].cast(pa.binary()).to_pylist()):
            own, words = cover[first[i]:first[i + 1]], (text or b"").split()
            edge = np.flatnonzero(np.diff(np.concatenate(([0], own, [0])))) if own.any() else np.zeros(0, int)
            spans.append([{"first": a, "last": b - 1} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())])
            removed.append(int(own.sum()))
            if spacing:
                kept.append(_cut(text or b"", edge).decode("utf-8", "replace") if len(edge) or text is not None else None)
            else:
                kept.append(b" ".join(compress(words, (~own).tolist()) if len(edge) else words).decode("utf-8", "replace"))
        more = {"n_words": pa.array(np.diff(first), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(kept, pa.string()), "spans": pa.array(spans, SPAN)}
        return pa.table({c: table[c] for c in ("doc_id", *carry)} | more)

    schema = T.StructType([*docs.select("doc_id", *carry).schema, *T._parse_datatype_string("n_words long, n_removed long, kept_text string, spans array<struct<first:long,last:long>>")])
    hits = X.replies(base.groupBy("home").applyInArrow(ask_blocks, X.ASK), ["narrow"])
    asked = base.groupBy("home").cogroup(hits.groupBy("home")).applyInArrow(ask_windows, X.ASK)
    older = X.replies(asked, ["smaller"]).withColumn("kind", F.lit(1))
    return base.groupBy("home").cogroup(hits.unionByName(older).groupBy("home")).applyInArrow(finish, schema)
