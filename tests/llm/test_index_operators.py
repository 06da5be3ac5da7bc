"""Spelling variants, exact dedup and ranked search against brute force over whole texts."""
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest_llm import FIXTURE

LAST = 1 << 62


def documents(spark):
    return spark.read.parquet(f"{FIXTURE}/documents.parquet")


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def brute_op12(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), LAST if i is None else i, i))
    out = []
    for text, g in groups.items():
        keep = min(g)[2]
        g.sort(key=lambda x: x[:2])
        for k, (_, _, i) in enumerate(g):
            out.append((i, keep, len(g), k == 0, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("table", ["odd", "given", "none"])
def test_op12_whole_texts(spark, odd, none, table):
    from tapeworks.llm.op12_cuckoo import exact_dedup

    docs = {"odd": odd, "none": none, "given": documents(spark)}[table]
    assert sorted((tuple(r) for r in exact_dedup(docs).collect()), key=repr) == brute_op12(rows_of(docs))


def test_op12_insert_delete_and_lookup(spark, odd, monkeypatch):
    """Three batches in, some ids out, and shards dealt anew on the way; the index equals one made of what is left."""
    from tapeworks.llm import op12_cuckoo as o

    monkeypatch.setattr(o, "SHARD", 20)
    docs = documents(spark).select("doc_id", "text")
    copies = docs.where("doc_id % 5 = 0").selectExpr("doc_id + 1000 AS doc_id", "concat(' ', text, ' ') AS text")
    index = o.ExactIndex(spark, shards=2)
    for part in (docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1").unionByName(odd.select("doc_id", "text")), copies):
        index.insert(part)
    assert index.shards > 2
    everything = docs.unionByName(odd.select("doc_id", "text")).unionByName(copies)
    assert sorted((tuple(r) for r in index.verdicts().collect()), key=repr) == brute_op12(rows_of(everything))
    gone = [1000, 1005, 11, 3, None] + list(range(40, 60))
    index.delete(spark.createDataFrame([(i,) for i in gone], "i long"))
    left = [(i, t) for i, t in rows_of(everything) if i not in gone]
    want = brute_op12(left)
    assert sorted((tuple(r) for r in index.verdicts().collect()), key=repr) == want
    keeper = {sha: keep for _, keep, _, _, sha in want}
    sha = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest()
    asked = [(7000 + n, t) for n, (_, t) in enumerate(rows_of(everything)[::3])] + [(1, "a text that no document has"), (2, None)]
    got = sorted((tuple(r) for r in index.lookup(spark.createDataFrame(asked, "doc_id long, text string")).collect()))
    assert got == sorted((i, keeper[sha(t)]) for i, t in asked if sha(t) in keeper)


def test_op12_filter_fills_overflows_and_frees():
    from tapeworks.llm.op12_cuckoo import FIELDS, CuckooFilter, Shard

    keys = np.array([list(hashlib.sha256(str(i).encode()).digest()) for i in range(5000)], np.uint8)
    small = CuckooFilter(64)
    assert small.insert(keys[:230], np.arange(230)) and not small.insert(keys[230:300], np.arange(230, 300))  # 256 slots
    shard = Shard(np.zeros((0, 32), np.uint8), {k: np.zeros(0, np.int64) for k in FIELDS}, None)
    one = {k: np.ones(5000, np.int64) for k in FIELDS}
    shard.add(keys, one)
    assert len(shard.filter.fp) >= 2048 and (shard.filter.find(keys, shard.keys)[1] == np.arange(5000)).all()
    shard.put(keys[::2], {k: np.zeros(2500, np.int64) for k in FIELDS})
    back = CuckooFilter.load(shard.filter.dump())
    hit, place = back.find(keys, shard.keys)
    assert (place[1::2] >= 0).all() and (place[::2] < 0).all() and hit[::2].mean() < 0.01
    assert (np.unique(back.at[back.at >= 0]) == np.arange(1, 5000, 2)).all()


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute_op13(docs, items, best=10):
    own = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in own]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        ts = set(terms(text))
        rows = []
        for (i, c), size in zip(own, sizes):
            m = 10 + 90 * size * n // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if c[t])
            if score > 0:
                rows.append((-score, LAST if i is None else i, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(rows, key=lambda r: r[:2])[:best])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("table,most_terms", [("odd", 10**6), ("given", 10**6), ("given", 60), ("none", 10**6)])
def test_op13_whole_texts(spark, odd, none, table, most_terms):
    from tapeworks.llm.op13_maxscore import ranked

    docs = {"odd": odd, "none": none, "given": documents(spark)}[table]
    more = [(900, None), (901, " .,"), (902, "Alpha alpha beta w3x3 w9x9 same line"), (902, "same again"), (903, "é" * 500), (904, "no-document-holds zzzzq")]
    items = spark.createDataFrame(more, "item_id long, text string").unionByName(spark.read.parquet(f"{FIXTURE}/benchmark.parquet").select("item_id", "text"))
    got = sorted((tuple(r) for r in ranked(docs, items, most_terms=most_terms).collect()), key=repr)
    assert got == brute_op13(rows_of(docs), [(r["item_id"], r["text"]) for r in items.collect()])
    assert ranked(docs, items.where("false")).count() == 0


def test_op13_bounds_hold_and_pairs_tighten():
    from tapeworks.llm.op13_maxscore import Segment

    rng = np.random.default_rng(3)
    lists = [np.sort(rng.choice(400, k, replace=False)).astype(np.int32) for k in (5, 40, 90, 200, 300)]
    row = {"ids": np.arange(400)[::-1].astype(np.int64).tobytes(), "sizes": rng.integers(1, 500, 400).astype(np.int64).tobytes(), "held": np.arange(5, dtype=np.int32).tobytes(),
           "ends": np.cumsum([len(x) for x in lists]).astype(np.int32).tobytes(), "doc": np.concatenate(lists).tobytes(), "tf": rng.integers(1, 30, sum(map(len, lists))).astype(np.int32).tobytes()}
    s = Segment(row, np.array([5000, 4000, 3000, 2000, 1000]), 400, 100_000)
    plain = [s.bounds(s.strong(list(range(5))))[k] for k in range(6)]
    s.index_pairs([list(range(5))])
    paired = s.bounds(s.strong(list(range(5))))
    order = s.strong(list(range(5)))
    for k in range(6):
        true = max((int(s._score(np.array([d]), order[k:])[0]) for d in range(400)), default=0)
        assert true <= paired[k] <= plain[k]
    assert sum(paired) < sum(plain)
    ids, scores = s.search(list(range(5)), 10)
    every = s._score(np.arange(400), order)
    want = sorted(((-int(v), int(399 - d)) for d, v in enumerate(every)))[:10]
    assert [(-int(v), int(i)) for i, v in zip(ids, scores)] == want


def brute_op11(rows, least=3):
    n = Counter()
    for i, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = r.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            n[r[:h % len(r)] + r[h % len(r) + 1:] if h % 97 == 0 else r] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= least}
    near = defaultdict(set)
    cuts, whole = defaultdict(set), defaultdict(set)
    for w in n:
        for k in range(len(w)):
            cuts[k, w[:k] + w[k + 1:]].add(w)
            whole[w[:k] + w[k + 1:]].add(w)
    for same in cuts.values():
        for a in same:
            near[a] |= same - {a}
    for a in n:
        for b in whole.get(a, ()):
            near[a].add(b)
            near[b].add(a)
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda x: (-n[x], x))
            if n[best] >= 2 * n[w]:
                form[w] = best
    def root(w):
        while w in form:
            w = form[w]
        return w
    return sorted(((w, form.get(w), root(w), c, len(near[w]), n[form[w]] if w in form else None) for w, c in n.items()), key=repr)


@pytest.mark.parametrize("table,leaf", [("odd", 16384), ("given", 16384), ("given", 40), ("none", 16384)])
def test_op11_whole_texts(spark, odd, none, monkeypatch, table, leaf):
    """With small leaves, words are routed to many coarse leaves, some of them cut into parts."""
    from tapeworks.llm import op11_spelling

    monkeypatch.setattr(op11_spelling, "LEAF", leaf)
    docs = {"odd": odd, "none": none, "given": documents(spark)}[table]
    got = sorted((tuple(r) for r in op11_spelling.variants(docs).collect()), key=repr)
    assert got == brute_op11(rows_of(docs)) and (table != "given" or any(r[1] != r[2] and r[1] for r in got))


def test_op11_equal_counts_long_runs_and_chains(spark, monkeypatch):
    """Words of equal letter counts that no cut separates, a run of 3,000 letters, accents, and a chain of forms."""
    from itertools import permutations

    from tapeworks.llm import op11_spelling

    monkeypatch.setattr(op11_spelling, "LEAF", 20)
    words = ["".join(p) for p in permutations("abcde")] + ["".join(p) for p in permutations("abcdf")] + ["abcdée", "abcdee", "ÀbcdE", "long" * 750, "long" * 749 + "lang", "long" * 750 + "é"]
    chain = ["steady"] * 50 + ["steadi"] * 20 + ["staadi"] * 9 + ["staaadi"] * 4
    docs = spark.createDataFrame([(1, " ".join(words * 3 + ["long" * 750] * 9)), (2, " ".join(chain)), (2, "ÀBCDE àbcde×abcde"), (None, "abcde-fghij " * 4)], "doc_id long, text string")
    got = sorted((tuple(r) for r in op11_spelling.variants(docs).collect()), key=repr)
    assert got == brute_op11(rows_of(docs))
    by = {r[0]: r for r in got}
    assert by["staaadi"][1:3] == ("staadi", "steady") and by["long" * 749 + "lang"][1] == "long" * 750
