"""Spelling variants: words one edit apart, found with k-d trees over letter counts, and the most frequent form of each.

A word is a point of letter counts. One replaced letter moves it by one up and one down, one inserted letter by one up, so its near
words of equal length lie within L1 distance two and those a letter longer within one. Words of each length have a k-d tree: a
coarse one, cut at medians of a sample of words, whose leaves of about ``LEAF`` words are the tasks, and inside a task an exact one
over all its words. A word searches the trees of its own length, of the next longer and of the next shorter words. A search carries
how many steps up and down its path has used, leaves out subtrees that would need more, tests the bounding box of each small leaf,
and verifies the order of letters of what remains. A word is routed to every coarse leaf within its reach, as fixed-width Latin-1
bytes packed by leaf, so pairs never travel: a task returns each searching word's number of near words there and the most frequent.

The sample (about one word of ``SAMPLE``, at least 20,000) only places the cuts. A coarse leaf that still holds more than four times
``LEAF`` words, because their counts are alike, is cut by a hash of the word into parts that each search visits. Chains of forms
end after few steps, as a form has twice the count of its word; they are followed by pointer doubling.

Null texts have no words, a null doc_id counts as an empty one, repeated rows count each, long texts and runs of any length are
whole, ties go to the smallest word in code-point order, extra columns are ignored, and an empty table gives an empty result.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.session import ensure_checkpoint_dir

LEAF, SAMPLE, SMALL, PAIRS = 16384, 1024, 24, 1 << 18
POINT, SAME, SHORTER, LONGER = 0, 1, 2, 3
#: steps up and down that a search may use: letters that a near word has more, and fewer, than the searching word
REACH = {SAME: (1, 1), SHORTER: (1, 0), LONGER: (0, 1)}
ROUTED = "length int, leaf int, part int, kind int, words binary, counts binary"
_ROUTED = pa.schema([*[(c, pa.int32()) for c in ("length", "leaf", "part", "kind")], ("words", pa.binary()), ("counts", pa.binary())])
NEAR = "word string, n_near long, best_n long, best string"
_NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def runs(docs: DataFrame) -> DataFrame:
    """word, once for each run of letters: A-Z lower-cased, one letter left out where the checksum asks for it."""
    text = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    run = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(text, F.lit("[a-zÀ-ÿ]+"), F.lit(0))).alias("r"))
    run = run.where(F.length("r") >= 5).select("r", F.crc32(F.concat("d", F.lit(":"), "r")).alias("h"))
    at = (F.col("h") % F.length("r")).cast("int")
    return run.select(F.when(F.col("h") % 97 == 0, F.concat(F.substring("r", F.lit(1), at), F.substring("r", at + 2, F.length("r")))).otherwise(F.col("r")).alias("word"))


def vocabulary(docs: DataFrame, least_length: int = 5, least: int = 3) -> DataFrame:
    """word, n of words with enough letters and occurrences."""
    return runs(docs).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def letters(words: np.ndarray) -> np.ndarray:
    """Counts of each Latin-1 letter in words of one length, a row of bytes each."""
    n = len(words)
    kind = np.int16 if words.shape[1] < 2**15 else np.int32
    at = (np.arange(n)[:, None] * 91 + np.where(words >= 0xC0, words.astype(np.int64) - 0xC0 + 27, words.astype(np.int64) - 96)).ravel()
    return np.bincount(at, minlength=91 * n).reshape(n, 91)[:, 1:].astype(kind)


class Tree:
    """Cuts of a k-d tree: node i sends counts up to ``cut`` of letter ``dim`` left; leaves are numbered."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.nodes: list[list[int]] = []
        self.members: list[np.ndarray] = []
        todo = [(np.arange(len(points)), None, 0)]
        while todo:
            idx, above, side = todo.pop()
            if above is not None:
                self.nodes[above][side] = len(self.nodes)
            cut = self._cut(points[idx]) if len(idx) > leaf else None
            if cut is None:
                self.nodes.append([-1, len(self.members), 0, 0])
                self.members.append(idx)
                continue
            here = len(self.nodes)
            self.nodes.append([*cut, 0, 0])
            low = points[idx, cut[0]] <= cut[1]
            todo += [(idx[low], here, 2), (idx[~low], here, 3)]

    @staticmethod
    def _cut(points: np.ndarray) -> tuple[int, int] | None:
        """The letter whose counts spread most, cut at their median."""
        spread = points.var(0)
        dim = int(spread.argmax())
        if spread[dim] == 0:
            return None
        x = points[:, dim]
        return dim, min(int(np.median(x)), int(x.max()) - 1)

    def home(self, points: np.ndarray) -> np.ndarray:
        """Each point's leaf."""
        return self.reach(points, 0, 0)[1] if len(self.nodes) > 1 else np.zeros(len(points), np.int64)

    def reach(self, points: np.ndarray, up: int, down: int) -> tuple[np.ndarray, np.ndarray]:
        """(point, leaf) of all leaves that some point with at most ``up`` counts more and ``down`` fewer may lie in."""
        who, leaf = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        todo = [(0, np.arange(len(points)), np.full(len(points), up), np.full(len(points), down))]
        while todo:
            node, idx, u, d = todo.pop()
            dim, cut, low, high = self.nodes[node]
            if dim < 0:
                who.append(idx)
                leaf.append(np.full(len(idx), cut))
                continue
            x = points[idx, dim].astype(np.int64)
            less, more = d - np.maximum(x - cut, 0), u - np.maximum(cut + 1 - x, 0)
            for to, ok, nu, nd in ((low, less >= 0, u, less), (high, more >= 0, more, d)):
                if ok.any():
                    todo.append((to, idx[ok], nu[ok], nd[ok]))
        who, leaf = np.concatenate(who), np.concatenate(leaf)
        if (up, down) == (0, 0):
            leaf = leaf[np.argsort(who, kind="stable")]
        return who, leaf


def near(kind: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows a and b, paired, are one edit apart; a is as long as b, a letter shorter or a letter longer."""
    if kind == SAME:
        return (a != b).sum(1) == 1
    short, long = (a, b) if kind == SHORTER else (b, a)
    front, back = short == long[:, :-1], short == long[:, 1:]
    out = front.sum(1) + back.sum(1) >= short.shape[1]
    some = np.flatnonzero(out)
    first = np.cumprod(front[some], 1).sum(1)
    last = np.cumprod(back[some][:, ::-1], 1).sum(1)
    out[some] = first + last >= short.shape[1]
    return out


def matches(kind: int, probes: np.ndarray, points: np.ndarray, tree: Tree, boxes: list[tuple[np.ndarray, np.ndarray]], counts: np.ndarray):
    """(probe, point) numbers of near words."""
    up, down = REACH[kind]
    vectors = letters(probes)
    who, leaf = tree.reach(vectors, up, down)
    order = np.argsort(leaf, kind="stable")
    who, leaf = who[order], leaf[order]
    edge = np.searchsorted(leaf, np.arange(len(tree.members) + 1))
    for k, members in enumerate(tree.members):
        mine = who[edge[k]:edge[k + 1]]
        if not len(mine):
            continue
        low, high = boxes[k]
        v = vectors[mine]
        mine = mine[(np.maximum(low - v, 0).sum(1) <= up) & (np.maximum(v - high, 0).sum(1) <= down)]
        step = max(1, PAIRS // len(members))
        for s in range(0, len(mine), step):
            some = mine[s:s + step]
            i, j = np.repeat(some, len(members)), np.tile(members, len(some))
            yes = near(kind, probes[i], points[j])
            yield i[yes], j[yes]


def found(table: pa.Table) -> pa.Table:
    """The near words that a coarse leaf's points are to the words that search there."""
    length = table["length"][0].as_py()
    blobs = {k: table.filter(pc.equal(table["kind"], k)) for k in (POINT, *REACH)}
    rows = lambda k, width: np.frombuffer(b"".join(blobs[k]["words"].to_pylist()), np.uint8).reshape(-1, width)
    points = rows(POINT, length)
    n = np.frombuffer(b"".join(blobs[POINT]["counts"].to_pylist()), np.int64)
    out = []
    if len(points):
        text = np.ascontiguousarray(points).view(f"S{length}")[:, 0]
        order = np.lexsort((text, -n))  # the best form first
        points, n, text = points[order], n[order], text[order]
        counts = letters(points)
        tree = Tree(counts, SMALL)
        boxes = [(counts[m].min(0), counts[m].max(0)) for m in tree.members]
        for kind, width in ((SAME, length), (SHORTER, length - 1), (LONGER, length + 1)):
            if not len(blobs[kind]):
                continue
            probes = rows(kind, width)
            many, best = np.zeros(len(probes), np.int64), np.full(len(probes), len(points))
            for s in range(0, len(probes), 65536):
                for i, j in matches(kind, probes[s:s + 65536], points, tree, boxes, counts):
                    many += np.bincount(i + s, minlength=len(probes)) if len(i) > len(probes) // 8 else 0
                    if len(i) <= len(probes) // 8:
                        np.add.at(many, i + s, 1)
                    np.minimum.at(best, i + s, j)
            some = np.flatnonzero(many)
            out.append(pa.table([strings(probes[some]), pa.array(many[some]), pa.array(n[best[some]]), strings(points[best[some]])], schema=_NEAR))
    return pa.concat_tables(out) if out else _NEAR.empty_table()


def strings(words: np.ndarray) -> pa.Array:
    return pa.array([w.tobytes().decode("latin-1") for w in words], pa.string())


def widths(batch) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Length, words as rows of Latin-1 bytes, and counts, for each length in a batch."""
    lengths = pc.utf8_length(batch["word"]).to_numpy(zero_copy_only=False)
    out = []
    for length in np.unique(lengths):
        mine = batch.filter(pa.array(lengths == length))
        words = np.frombuffer("".join(mine["word"].to_pylist()).encode("latin-1"), np.uint8).reshape(-1, length)
        out.append((int(length), words, mine["n"].to_numpy(zero_copy_only=False).astype(np.int64)))
    return out


def coarse_trees(words: DataFrame) -> dict[int, Tree | None]:
    """A tree for each length that has words; None stands for one leaf. Its size follows the number of leaves."""
    counts = {r["l"]: r["n"] for r in words.groupBy(F.length("word").alias("l")).agg(F.count("*").alias("n")).collect()}
    large = [k for k, n in counts.items() if n > LEAF]
    trees: dict[int, Tree | None] = dict.fromkeys(counts)
    if large:
        total = sum(counts[k] for k in large)
        rate = min(1.0, max(20_000 / total, 1 / SAMPLE))
        drawn = words.where(F.length("word").isin(large) & (F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(rate * (1 << 30)))).select("word").toPandas()["word"]
        for k in large:
            own = [w for w in drawn if len(w) == k]
            if own:
                tree = Tree(letters(np.frombuffer("".join(own).encode("latin-1"), np.uint8).reshape(-1, k)), max(2, int(rate * LEAF)))
                tree.members = [np.zeros(0, np.int64)] * len(tree.members)
                trees[k] = tree
    return trees


def routed(words: DataFrame, trees: dict, parts: dict, points_only: bool = False) -> DataFrame:
    """Each word as a point of its own leaf, and as a search in every leaf within reach, packed by leaf."""
    known = words.sparkSession.sparkContext.broadcast((trees, parts))

    def route(batches):
        trees, parts = known.value
        for batch in batches:
            out: list[tuple] = []
            for length, w, n in widths(batch):
                v = letters(w)
                home = trees[length].home(v) if trees.get(length) else np.zeros(len(w), np.int64)
                part = np.zeros(len(w), np.int64)
                if any(k[0] == length for k in parts):
                    mix = (w.astype(np.uint64) * (np.arange(1, length + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))).sum(1) >> np.uint64(33)
                    part = (mix % np.array([parts.get((length, h), 1) for h in home.tolist()], np.uint64)).astype(np.int64)
                pack(out, length, POINT, home, part, w, n)
                for kind, other in () if points_only else ((SAME, length), (SHORTER, length + 1), (LONGER, length - 1)):
                    if other not in trees:
                        continue
                    who, leaf = trees[other].reach(v, *REACH[kind]) if trees[other] else (np.arange(len(w)), np.zeros(len(w), np.int64))
                    many = np.array([parts.get((other, x), 1) for x in leaf.tolist()], np.int64)
                    who, leaf = np.repeat(who, many), np.repeat(leaf, many)
                    pack(out, other, kind, leaf, np.arange(len(leaf)) - np.repeat(np.cumsum(many) - many, many), w[who], None)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [[] for _ in _ROUTED], _ROUTED.types)], schema=_ROUTED)

    return words.mapInArrow(route, ROUTED)


def pack(out: list[tuple], length: int, kind: int, leaf: np.ndarray, part: np.ndarray, words: np.ndarray, n: np.ndarray | None) -> None:
    order = np.lexsort((part, leaf))
    leaf, part = leaf[order], part[order]
    start = np.flatnonzero(np.concatenate(([True], (leaf[1:] != leaf[:-1]) | (part[1:] != part[:-1])))) if len(leaf) else np.zeros(0, np.int64)
    for a, b in zip(start, np.append(start[1:], len(leaf))):
        out.append((length, int(leaf[a]), int(part[a]), kind, words[order[a:b]].tobytes(), n[order[a:b]].tobytes() if n is not None else b""))


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best_n and best of every word (word, n) that has near words."""
    trees = coarse_trees(words)
    full = (routed(words, trees, {}, points_only=True).groupBy("length", "leaf").agg((F.sum(F.length("counts")) / 8).alias("n")).where(F.col("n") > 4 * LEAF).collect()
            if any(trees.values()) else [])
    parts = {(r["length"], r["leaf"]): int(-(-r["n"] // LEAF)) for r in full}
    each = routed(words, trees, parts).groupBy("length", "leaf", "part").applyInArrow(found, NEAR)
    first = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))
    return each.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("f")).select("word", "n_near", (-F.col("f.m")).alias("best_n"), F.col("f.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root for words with a form (word, form): the last of its chain of forms."""
    at = forms.select("word", F.col("form").alias("root")).checkpoint()
    while True:
        to = at.select(F.col("word").alias("via"), F.col("root").alias("on"))
        at = at.join(to, F.col("root") == F.col("via"), "left").select("word", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved")).checkpoint()
        if not at.where("moved").limit(1).count():
            return at.select("word", "root")
        at = at.select("word", "root")


def variants(docs: DataFrame, least_length: int = 5, least: int = 3, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word."""
    ensure_checkpoint_dir(docs.sparkSession)
    words = vocabulary(docs, least_length, least).checkpoint()
    known = words.join(near_words(words), "word", "left")
    good = F.col("best_n") >= ratio * F.col("n")
    known = known.select("word", F.when(good, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("best_n")).alias("form_n")).checkpoint()
    root = roots(known.where("form IS NOT NULL"))
    return known.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
