"""What a worker holds while it hashes, asks and answers."""
import tracemalloc

import numpy as np
import pyarrow as pa

from tapeworks.llm import exchange as X
from tapeworks.llm import op4_substring
from tapeworks.llm.hashing import U, _powers
from tapeworks.llm.op9_jaccard import shingle_sets


class Recorder:
    """Takes the place of a frame and keeps the functions that are applied to it."""

    def __init__(self):
        self.schema, self.applied = [], {}

    def __getattr__(self, name):
        return lambda *args, **more: self

    def applyInArrow(self, fn, schema):
        self.applied.setdefault(fn.__name__, fn)
        return self


def peak_mb(fn):
    tracemalloc.start()
    try:
        out = fn()
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def home(texts: int = 2000) -> pa.Table:
    """4 MB of texts with few words in common."""
    rng = np.random.default_rng(1)
    text = [" ".join(rng.integers(0, 1 << 30, 200).astype(str).tolist()) for _ in range(texts)]
    return pa.table({"doc_id": pa.array(range(texts), pa.int64()), "text": text})


def test_op4_blocks_of_a_home_take_little_memory(spark, monkeypatch):
    monkeypatch.setattr(X, "width", lambda df: 8)
    monkeypatch.setattr(X, "homed", lambda docs, *more: docs)
    monkeypatch.setattr(X, "replies", lambda asked, kinds: asked)
    frame, table = Recorder(), home()
    op4_substring.remove_repeats(frame)
    _powers.clear()
    asked, mb = peak_mb(lambda: frame.applied["ask_blocks"]((pa.scalar(0),), table))
    assert sum(len(b) // 4 for b in asked["keys"].to_pylist()) == 2000 * 194
    assert mb < 40


def test_op9_shingles_take_little_memory():
    table = home()
    _powers.clear()
    sets, mb = peak_mb(lambda: shingle_sets(table["text"], 5))
    assert [len(s) for s in sets] == [196] * 2000
    assert mb < 40


def test_cuts_are_those_of_the_upper_bits():
    rng = np.random.default_rng(2)
    for n in (1, 3, 51, 211):
        edge = [(-(-(b << 32) // n) << 32) + d for b in range(1, n) for d in (-1, 0, 1)]
        keys = np.unique(np.concatenate((rng.integers(0, 1 << 64, 500, U), np.array([0, 2**64 - 1, *edge], U))))
        bucket = np.array([((int(k) >> 32) * n) >> 32 for k in keys])
        assert X._cuts(keys, n).tolist() == np.searchsorted(bucket, np.arange(n + 1)).tolist()
    assert X._cuts(np.zeros(0, U), 3).tolist() == [0, 0, 0, 0]


def test_narrow_answers_match_brute_force():
    rng = np.random.default_rng(3)
    for most in (1, 5, 200):
        parts = [np.unique(rng.integers(0, most, 60).astype(np.uint32)) << np.uint32(2) for _ in range(3)]
        parts = [p | rng.choice(4, len(p), p=[0.7, 0.1, 0.1, 0.1]).astype(np.uint32) for p in parts]
        every = np.concatenate(parts).tolist()
        want = sorted({s >> 2 for s in every if (sum(x >> 2 == s >> 2 for x in every) > 1 or any(x >> 2 == s >> 2 and x & 2 for x in every))
                       and any(x >> 2 == s >> 2 and x & 1 for x in every)})
        yes = X._repeated(np.concatenate(parts))
        assert yes.tolist() == want
        for p in parts:
            assert X._among(p >> np.uint32(2), yes).tolist() == [s >> 2 in want for s in p.tolist()]


def test_homes_of_a_partition_lie_together(spark):
    from pyspark.sql import functions as F

    got = X.homed(spark.range(500).select(F.col("id").alias("doc_id")), ["doc_id"], X.HOMES)
    rows = got.select("home", F.spark_partition_id()).distinct().collect()
    assert len(rows) == X.HOMES * X.width(got) == len({r["home"] for r in rows})
