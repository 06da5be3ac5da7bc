"""N-gram Jaccard join: links between documents whose shingle sets are similar, with prefixes under several token orders.

A document is the set of its distinct k-word shingles (the whole sequence where it has fewer words; none without words).
Two link when den * |intersection| >= num * |union|. Then a document misses at most e = floor((1 - num / den) * size) of
its own shingles in a partner, and under *any* order of the tokens the first 2 e + 1 of the two share at least e' + 1, e' of
the smaller. So:

1. Equal sets are one class, and only its smallest doc_id goes on.
2. Under each of several independent orders (seeded hashes) every shingle of a prefix is asked for in the corpus; a document
   with too few repeated ones under any order has no partner and is done.
3. Of the rest, each order's prefix is put rarest first and cut to where it must still share one token with a partner.
   Documents that share such tokens, directly or through others, are a candidate group; each further order splits the groups
   of those before it, since partners must be together under all of them. What is still larger than a block is split once
   more under each order by tokens that documents of like size share: the sizes of partners lie in one band or in two
   that adjoin.
4. Within candidate groups, in blocks of bounded size that meet pairwise in tasks of their own, pairs must share enough
   prefix tokens under every order; exact intersections decide those. Larger groups have blocks by band, which meet those of
   their own and the adjoining bands only, and blocks grow with a band, so that a document is sent to a bounded number of tasks
   until a block takes ``TOKENS``. A task returns a spanning forest of its links and the number of links of each document,
   never its pairs.

Texts without words link with nothing and are their own component; rows with one doc_id are one document; a null doc_id
gets a null component_id and takes no part. An empty table gives an empty result; other columns are not looked at.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.llm import exchange as X
from tapeworks.llm.components import components
from tapeworks.llm.hashing import GRAM_BASE, HASHED, U, RangeHash, grams, mix, slices, texts, word_hashes
from tapeworks.session import ensure_checkpoint_dir

#: documents whose pairs are looked at together
BLOCK = 512
#: blocks that a band of a group has, where these hold at least BLOCK documents and at most about TOKENS shingles
PARTS = 16
TOKENS = 2 << 20
_SETS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64())])
_LEFT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("copies", pa.int64()), ("tokens", pa.binary()), ("keys", pa.list_(pa.list_(pa.int64())))])


def _shingles(column, k: int):
    """The sets of ``shingle_sets`` one after the other; only a slice of the texts is hashed at once."""
    buf, off = texts(column)
    for a, b in slices(off, HASHED):
        words, first = word_hashes(buf[off[a]:off[b]], off[a:b + 1] - off[a], fold=True)
        h, _, doc = grams(words, first, k)
        cut = np.searchsorted(doc, np.arange(len(first)))
        for i in range(len(first) - 1):
            n = first[i + 1] - first[i]
            if n >= k:
                yield np.unique(h[cut[i]:cut[i + 1]])
            else:
                yield RangeHash(words[first[i]:first[i + 1]], GRAM_BASE)(np.array([0]), np.array([n])) if n else np.zeros(0, U)


def shingle_sets(column, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, A-Z lower-cased."""
    return list(_shingles(column, k))


class Threshold:
    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def misses(self, n):
        """How many of n shingles a partner may lack."""
        return n * (self.den - self.num) // self.den

    def prefix(self, n):
        return 2 * self.misses(n) + 1

    def shared(self, n):
        """How many prefix tokens any partner shares at least: that of the smallest possible one."""
        return self.misses(-(-n * self.num // self.den)) + 1

    def band(self, n: Column) -> Column:
        """A band of sizes; the sizes of partners lie in the same or in adjoining ones."""
        if self.num >= self.den:
            return n.cast("long")
        return F.floor(F.ln(n) / (math.log(self.den / self.num) * (1 + 1e-9)))


def prefix(tokens: np.ndarray, order: int, n: int) -> np.ndarray:
    """The first n tokens under an order, as their sorted ranks."""
    rank = mix(tokens, order)
    return np.sort(np.partition(rank, n - 1)[:n] if n < len(rank) else rank)


def _overlap(tokens: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a block's sets: sums of products of 0/1 columns, a bounded number of columns at a time."""
    m = len(tokens)
    row = np.repeat(np.arange(m), [len(t) for t in tokens])
    order = np.argsort(flat := np.concatenate(tokens), kind="stable")
    flat, row = flat[order], row[order]
    new = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1]))) if len(flat) else np.zeros(0, np.int64)
    size = np.diff(np.append(new, len(flat)))
    column = np.repeat(np.arange(len(new)), size)
    many = np.repeat(size > 1, size)
    row, column = row[many], column[many]
    out = np.zeros((m, m), np.float64)
    np.fill_diagonal(out, [len(t) for t in tokens])
    if not len(row):
        return out
    column = np.cumsum(np.concatenate(([0], column[1:] != column[:-1])))
    step = 4096
    starts = np.searchsorted(column, np.arange(0, column[-1] + 1, step))
    for a, b in zip(starts, np.append(starts[1:], len(column))):
        part = np.zeros((m, step), np.float32)
        part[row[a:b], column[a:b] % step] = 1
        got = part @ part.T
        np.fill_diagonal(got, 0)
        out += got
    return out


def _links(tokens: list[np.ndarray], across: np.ndarray, t: Threshold, orders: int) -> np.ndarray:
    """Which pairs link. across: the pairs that this task is asked about."""
    n = np.array([len(x) for x in tokens])
    small = np.minimum.outer(n, n)
    ok = across & (t.den * small >= t.num * np.maximum.outer(n, n))
    least = np.minimum.outer(t.misses(n), t.misses(n)) + 1
    for order in range(1, orders + 1):
        if not ok.any():
            return ok
        ok &= _overlap([prefix(x, order, t.prefix(len(x))) for x in tokens]) >= least
    some = np.flatnonzero(ok.any(0) | ok.any(1))
    out = np.zeros_like(ok)
    if len(some):
        both = _overlap([tokens[i] for i in some])
        size = n[some]
        sub = t.den * both >= t.num * (size[:, None] + size[None, :] - both)
        out[np.ix_(some, some)] = sub & ok[np.ix_(some, some)]
    return out


def _forest(links: np.ndarray) -> list[tuple[int, int]]:
    links = links | links.T
    left = links.any(0)
    out = []
    for start in range(len(links)):
        if not left[start]:
            continue
        left[start] = False
        front = [start]
        while front:
            x = front.pop()
            found = np.flatnonzero(links[x] & left)
            left[found] = False
            out += [(x, int(y)) for y in found]
            front += found.tolist()
    return out


def _merged(edges: list[tuple[int, int]], root: np.ndarray) -> list[tuple[int, int]]:
    """The edges that join parts which those before, kept in root, left apart."""

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for x, y in edges:
        if (a := find(x)) != (b := find(y)):
            root[a] = b
            out.append((x, y))
    return out


def _pairs_of(side: np.ndarray, same: bool):
    """Which rows meet which: pieces of at most BLOCK rows, each pair of pieces once. side: True for rows of the second block."""
    first, second = [[rows[i:i + BLOCK] for i in range(0, len(rows), BLOCK)] for rows in (np.flatnonzero(~side), np.flatnonzero(side))]
    for x, a in enumerate(first):
        for b in first[x:] if same else second:
            yield (a, a) if a is b else (a, b)


def _split(group: DataFrame, keys: DataFrame) -> DataFrame:
    """Groups of documents that share keys with another document of their group, directly or through others."""
    held = keys.join(group, "doc_id").select("doc_id", F.xxhash64("group", "key").alias("key"))
    least = held.groupBy("key").agg(F.min("doc_id").alias("b"), F.max("doc_id").alias("most")).where("b < most").drop("most")
    found = components(held.join(least, "key").select(F.col("doc_id").alias("a"), "b"))
    found = found.select(F.col("node").alias("doc_id"), F.col("label").alias("group"))
    return found.unionByName(found.select(F.col("group").alias("doc_id"), "group").distinct())


def _split_large(group: DataFrame, left: DataFrame, t: Threshold, orders: int) -> DataFrame:
    """Groups of more than BLOCK documents, split by keys that hold for one band of sizes and the next."""
    for order in range(orders):
        group = group.checkpoint()
        sizes = group.groupBy("group").agg(F.count("*").alias("of")).where(F.col("of") > BLOCK).drop("of")
        large = group.join(sizes, "group", "left_semi").checkpoint()
        if large.isEmpty():
            break
        band = t.band(F.col("n"))
        keys = left.join(large, "doc_id", "left_semi").select("doc_id", band.alias("band"), F.explode(F.col("keys")[order]).alias("key"))
        keys = keys.select("doc_id", F.explode(F.array("band", F.col("band") + 1)).alias("band"), "key")
        group = group.join(sizes, "group", "left_anti").unionByName(_split(large, keys.select("doc_id", F.xxhash64("band", "key").alias("key"))))
    return group


def _placed(group: DataFrame, left: DataFrame, t: Threshold) -> DataFrame:
    """Each doc_id and size once for every pair of blocks, lo and hi, that it is to be looked at in, with its own, i."""
    sizes = group.groupBy("group").agg(F.count("*").alias("of")).where(F.col("of") > BLOCK).withColumn("large", F.lit(True)).drop("of")
    d = group.join(left.select("doc_id", "n").distinct(), "doc_id").join(sizes, "group", "left")
    d = d.select("doc_id", "group", "n", F.when(F.col("large"), t.band(F.col("n"))).otherwise(F.lit(0)).cast("long").alias("band"))
    cells = d.groupBy("group", "band").agg(F.count("*").alias("of"), F.sum("n").alias("all"))
    block = F.greatest(F.lit(BLOCK), F.least(F.col("of") / PARTS, TOKENS * F.col("of") / F.col("all")))
    cells = cells.select("group", "band", F.ceil(F.col("of") / block).alias("g")).checkpoint()
    near = cells.select("group", (F.col("band") - 1).alias("band"), F.col("g").alias("above")).join(
        cells.select("group", (F.col("band") + 1).alias("band"), F.col("g").alias("below")), ["group", "band"], "full")
    d = d.join(cells.join(near, ["group", "band"], "left"), ["group", "band"])
    number = lambda band, i: F.shiftleft(band, 32) + i
    d = d.withColumn("i", number(F.col("band"), F.pmod(F.xxhash64("doc_id"), F.col("g"))))

    def blocks(band: Column, g: Column) -> Column:
        none = F.array().cast("array<long>")
        return F.when(g > 0, F.transform(F.sequence(F.lit(0).cast("long"), g - 1), lambda j: number(band, j))).otherwise(none)

    band, out = F.col("band"), F.lit(0).cast("long")
    others = F.concat(blocks(band - 1, F.coalesce("below", out)), blocks(band, F.col("g")), blocks(band + 1, F.coalesce("above", out)))
    d = d.withColumn("j", F.explode(others))
    return d.select("doc_id", "n", "group", "i", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"))


def jaccard_join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, orders: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) and n_links (documents linked, equal ones included)."""
    ensure_checkpoint_dir(docs.sparkSession)
    t, n = Threshold(num, den), X.width(docs)

    def sets(batches):
        for batch in batches:
            rows = []
            for s in _shingles(batch["text"], k):
                a, b = (mix(s, 11).sum(dtype=U), np.bitwise_xor.reduce(mix(s, 12))) if len(s) else (U(0), U(0))
                rows.append((len(s), int(a.astype(np.int64)), int(b.astype(np.int64))))
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), *(pa.array(c, pa.int64()) for c in cols)], schema=_SETS)

    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sets, "doc_id long, n_shingles long, fp1 long, fp2 long").checkpoint()
    classes = found.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("n_shingles", "fp1", "fp2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    empty = [F.lit(None).cast(c).alias(a) for a, c in (("bucket", "int"), ("n", "int"), ("bits", "binary"))]
    reps = classes.select(F.col("rep").alias("doc_id"), "copies").select(X.home(X.HOMES * n), F.lit(-1).alias("kind"), F.col("doc_id").alias("id"), "copies", *empty)
    base = X.homed(docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text"), ["doc_id", "text"], X.HOMES)

    def chosen(table, right):
        """The classes' representatives here, their sets, and for each order the prefixes."""
        mine = right.filter(pc.equal(right["kind"], -1))
        copies = dict(zip(mine["id"].to_pylist(), mine["copies"].to_pylist()))
        table = X.by_id(table.filter(pc.is_in(table["doc_id"], value_set=mine["id"].combine_chunks())))
        ids, every = table["doc_id"].to_pylist(), _shingles(table["text"], k)
        some = [(i, copies[i], s) for i, s in zip(ids, every) if len(s)]
        heads = [[prefix(s, o, t.prefix(len(s))) for _, _, s in some] for o in range(1, orders + 1)]
        return some, heads

    kinds = ["count"] * orders

    def ask(key, table, right):
        _, heads = chosen(table, right)
        questions = []
        for h in heads:
            questions.append(("count", *X.counted(np.concatenate(h or [np.zeros(0, U)]))))
        return X.ask(key[0].as_py(), questions, n)

    def survivors(key, table, right):
        some, heads = chosen(table, right)
        levels = X.read(right.filter(pc.greater_equal(right["kind"], 0)), kinds)
        sent = [np.unique(np.concatenate(h or [np.zeros(0, U)])) for h in heads]
        rows = []
        for at, (i, copies, s) in enumerate(some):
            size = len(s)
            often = [X.lookup(sent[o], levels[o], heads[o][at]) for o in range(orders)]
            if all(int((x > 0).sum()) >= t.shared(size) for x in often):
                take = t.prefix(size) - t.shared(size) + 1
                keys = []
                for o in range(orders):
                    rare = np.lexsort((heads[o][at], often[o]))[:take]
                    keys.append(heads[o][at][rare[often[o][rare] > 0]].astype(np.int64).tolist())
                rows.append((i, size, copies, s.tobytes(), keys))
        return X.table_of(rows, _LEFT)

    pad = [F.lit(None).cast("long").alias(c) for c in ("id", "copies")]
    asked = base.groupBy("home").cogroup(reps.groupBy("home")).applyInArrow(ask, X.ASK)
    told = reps.unionByName(X.replies(asked, kinds).select("*", *pad))
    left = base.groupBy("home").cogroup(told.groupBy("home")).applyInArrow(survivors, "doc_id long, n long, copies long, tokens binary, keys array<array<long>>").checkpoint()

    group = left.select("doc_id", F.lit(0).cast("long").alias("group"))
    for order in range(orders):
        group = _split(group, left.select("doc_id", F.explode(F.col("keys")[order]).alias("key")))
    placed = _placed(_split_large(group, left, t, orders), left, t)
    packs = placed.join(left.drop("keys"), ["doc_id", "n"]).withColumn("pack", F.pmod(F.xxhash64("group", "lo", "hi"), F.lit(4 * n)).cast("int"))

    def verify(key, table):
        out = []
        table = table.sort_by([("group", "ascending"), ("lo", "ascending"), ("hi", "ascending"), ("doc_id", "ascending")])
        g, lo, hi, i, ids, copies = (table[c].to_numpy() for c in ("group", "lo", "hi", "i", "doc_id", "copies"))
        blobs = table["tokens"]
        new = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))))
        for a, b in zip(new, np.append(new[1:], len(g))):
            if b - a < 2:
                continue
            tokens = [np.frombuffer(x, U) for x in blobs.slice(a, b - a).to_pylist()]
            root, count = np.arange(b - a), np.zeros(b - a, np.int64)
            for x, y in _pairs_of(i[a:b] != lo[a], lo[a] == hi[a]):
                at = x if x is y else np.concatenate([x, y])
                across = np.triu(np.ones((len(at), len(at)), bool), 1)
                if x is not y:
                    across[:len(x), :len(x)] = across[len(x):] = False
                links = _links([tokens[z] for z in at], across, t, orders)
                if not links.any():
                    continue
                own = copies[a:b][at]
                count[at] += links @ own + links.T @ own
                out += [(int(ids[a + v]), int(ids[a + w]), 0) for v, w in _merged([(at[v], at[w]) for v, w in _forest(links)], root)]
            out += [(int(ids[a + v]), None, int(count[v])) for v in np.flatnonzero(count)]
        return X.table_of(out, pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())]))

    done = packs.groupBy("pack").applyInArrow(verify, "a long, b long, links long").checkpoint()
    label = components(done.where("b IS NOT NULL").select("a", "b"))
    links = done.where("b IS NULL").groupBy("a").agg(F.sum("links").alias("links"))
    named = classes.join(label.withColumnRenamed("node", "rep"), "rep", "left").join(links.withColumnRenamed("a", "rep"), "rep", "left")
    named = named.select("n_shingles", "fp1", "fp2", F.coalesce("label", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    joined = found.join(named, ["n_shingles", "fp1", "fp2"], "left")
    known = F.col("doc_id").isNotNull()
    return joined.select("doc_id", "n_shingles", F.when(known, F.coalesce("component", "doc_id")).alias("component_id"), F.when(known, F.coalesce("links", F.lit(0))).alias("n_links"))
