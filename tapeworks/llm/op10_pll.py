"""Masked pseudo-likelihood of documents under a bidirectional window network.

Every word is predicted from the words around it, ``SIDE`` on each side, itself masked; the log-probabilities of all words of a
document are summed. Words become tokens by counts over the whole corpus: those that make up at least 1 / (``RARE`` sqrt(N)) of its
N words, and never fewer than the ``KEEP`` most frequent, have a token of their own, so the vocabulary grows with the corpus; the
rest share hashed tokens, and each of them is charged its exact share of its token's words in the whole corpus besides, so that
the probabilities of all words of the corpus, not of tokens, add up to one. The network embeds the window's tokens for each place,
adds them, applies tanh and gives the token by a two-step softmax, its block first and then the token in the block; there are as
many blocks as tokens in a block. It starts from the tokens' counts.

Shares are counted where they meet: texts send the hashes of their rare words to buckets of hashed tokens, a bucket counts words
and tokens and returns one sum for each text, in blobs by ranges of texts. Texts go by their 64-bit hash; what is sent is 8
bytes for each rare word.

Texts are turned into tokens once, which are checkpointed (two bytes a word, four beyond 65,535 tokens) and read by every later
pass. The network is trained in numpy on all of them where they lie: every partition takes the shared parameters, runs mini-batch
gradient descent over its own words and sends its parameters back, cut into ranges; the average of each range over the
partitions, weighted by words, is the next round's. A round takes every ``ROUNDS``-th word of each text, the next one the
words after those, so each word is learned from once. What is gathered grows with the corpus (its word counts and a parameter
set for each partition), what the driver holds is the vocabulary and one parameter set, which grow about as sqrt(N).

Null, empty and white-space texts have no word and score 0. Texts are read whole. Repeated rows score alike; an empty corpus
gives an empty result; other columns are not looked at.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm import exchange as X
from tapeworks.llm.hashing import U, mix, slices, texts, word_hashes
from tapeworks.session import ensure_checkpoint_dir

KEEP, BLOCK, BLOCKS, SIDE, SIZE = 512, 32, 32, 2, 16
TOKENS = BLOCK * BLOCKS  # of the smallest network
EDGE = TOKENS  # stands beyond the ends of a text
RARE = 10
ROUNDS, BATCH, RATE = 2, 4096, 1.0
RANGES = 16
PIECE = 1 << 18  # words, of whole texts, taken at a time
_SENT = pa.schema([("bucket", pa.int32()), ("words", pa.binary()), ("texts", pa.binary()), ("sizes", pa.binary())])
_FOUND = pa.schema([("range", pa.int32()), ("bucket", pa.int32()), ("texts", pa.binary()), ("shares", pa.binary())])
_SHARES = pa.schema([("fp", pa.int64()), ("share", pa.float64())])


def shapes(side: int) -> dict[str, tuple]:
    """Of a network of side blocks of side tokens; the last row of a block's tokens is their bias."""
    return {"emb": (2 * SIDE, side * side + 1, SIZE), "mid": (SIZE,), "block": (SIZE, side), "block_bias": (side,), "token": (side, SIZE + 1, side)}


def side_of(n_known: int) -> int:
    """Blocks, and tokens in a block, for a vocabulary; at least a fifth of the tokens, and KEEP of them, are left for hashes."""
    return max(BLOCK, int(np.ceil(np.sqrt(n_known + max(TOKENS - KEEP, n_known // 4)))))


def frequent(docs: DataFrame, keep: int = KEEP) -> np.ndarray:
    """Hashes of the words with a token of their own, most frequent first, counted over the whole corpus."""
    return vocabulary(docs, keep)[0]


def vocabulary(docs: DataFrame, keep: int = KEEP) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes and counts of the words with a token of their own, most frequent first, and the number of words of the corpus."""
    ensure_checkpoint_dir(docs.sparkSession)

    def counts(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            held.append(np.unique(word_hashes(*texts(batch["text"]))[0], return_counts=True))
        if not held:
            return
        words, n = np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held])
        order = np.argsort(words)
        words, n = words[order], n[order]
        if len(words):
            first = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1])))
            yield pa.RecordBatch.from_arrays([pa.array(words[first].view(np.int64)), pa.array(np.add.reduceat(n, first).astype(np.int64))], names=["word", "n"])

    every = docs.select("text").mapInArrow(counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).checkpoint()
    total = every.agg(F.sum("n").alias("n")).first()["n"] or 0
    top = every.where(F.col("n") >= float(np.sqrt(total) / RARE)).orderBy(F.desc("n"), "word").collect()
    if len(top) < keep:
        top = every.orderBy(F.desc("n"), "word").limit(keep).collect()
    return np.array([r["word"] for r in top], np.int64).view(U), np.array([r["n"] for r in top], np.int64), total


def tokens(words: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The token of each word: its rank where it is frequent, a hashed one after those else."""
    out = (len(known) + (mix(words, 3) % U(side_of(len(known)) ** 2 - len(known))).astype(np.int64)).astype(np.int32)
    if len(known):
        order = np.argsort(known)
        spot = np.minimum(np.searchsorted(known[order], words), len(known) - 1)
        same = known[order][spot] == words
        out[same] = order[spot[same]]
    return out


def windows(tok: np.ndarray, first: np.ndarray, edge: int = EDGE) -> np.ndarray:
    """The tokens around each word, one row for each place; edge beyond a text's ends."""
    out = np.full((2 * SIDE, len(tok)), edge, np.int32)
    for i, d in enumerate([d for d in range(-SIDE, SIDE + 1) if d]):
        n = len(tok) - abs(d)
        if n <= 0:
            continue
        to, of = (slice(0, n), slice(d, None)) if d > 0 else (slice(-d, None), slice(0, n))
        out[i, to] = tok[of]
        for k in range(abs(d)):  # the places near a text's start or end look beyond it
            at = first[:-1] + k if d < 0 else first[1:] - 1 - k
            out[i, at[(at >= first[:-1]) & (at < first[1:])]] = edge
    return out


class Network:
    def __init__(self, p: dict[str, np.ndarray]):
        self.p, self.side = p, len(p["block_bias"])

    @classmethod
    def start(cls, side: int = BLOCK, share: np.ndarray | None = None) -> Network:
        """share: of the corpus, for each token."""
        rng = np.random.default_rng(5)
        net = cls({k: (np.zeros(s, np.float32) if "bias" in k or k == "mid" else rng.normal(0, 0.1, s).astype(np.float32)) for k, s in shapes(side).items()})
        net.p["token"][:, -1] = 0
        if share is not None:
            share = share.reshape(side, side)
            net.p["block_bias"] += np.log(share.sum(1)).astype(np.float32)
            net.p["token"][:, -1] = np.log(share / share.sum(1, keepdims=True))
        return net

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in shapes(self.side)])

    @classmethod
    def of(cls, flat: np.ndarray) -> Network:
        out, at = {}, 0
        for k, s in shapes(int(np.sqrt(len(flat) / (2 * SIDE * SIZE + SIZE + 1)))).items():
            n = int(np.prod(s))
            out[k] = flat[at:at + n].reshape(s).astype(np.float32).copy()
            at += n
        return cls(out)

    def hidden(self, around: np.ndarray) -> np.ndarray:
        z = np.take(self.p["emb"][0], around[0], axis=0)
        z += self.p["mid"]
        more = np.empty_like(z)
        for i in range(1, len(around)):
            z += np.take(self.p["emb"][i], around[i], axis=0, out=more, mode="clip")
        return np.tanh(z, out=z)

    def _in_block(self, h: np.ndarray, block: np.ndarray):
        """The ranges of each block, by which rows are sorted, and the scores of the tokens of each row's own block."""
        cut = np.searchsorted(block, np.arange(self.side + 1))
        z = np.empty((len(h), self.side), np.float32)
        ranges = [(b, slice(cut[b], cut[b + 1])) for b in np.flatnonzero(np.diff(cut))]
        h = np.column_stack((h, np.ones(len(h), np.float32)))
        for b, rows in ranges:
            np.matmul(h[rows], self.p["token"][b], out=z[rows])
        return ranges, z, h

    def log_probability(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        order = np.argsort(_short(target // self.side), kind="stable")
        block, at = np.divmod(target[order], self.side)
        h = self.hidden(around[:, order])
        out = np.empty(len(target), np.float32)
        out[order] = _log_of(h @ self.p["block"] + self.p["block_bias"], block) + _log_of(self._in_block(h, block)[1], at)
        return out

    def learn(self, around: np.ndarray, target: np.ndarray, rate: float) -> None:
        """One step of gradient descent."""
        n, p = len(target), self.p
        order = np.argsort(_short(target // self.side), kind="stable")
        around, (block, at), row = around[:, order], np.divmod(target[order], self.side), np.arange(n)
        h = self.hidden(around)
        ranges, d, moved = self._in_block(h, block)
        _softmax(d)[row, at] -= 1
        e = _softmax(h @ p["block"] + p["block_bias"])
        e[row, block] -= 1
        back = e @ p["block"].T
        step = np.float32(rate / n)
        # blocks of few words would hardly move with the mean over the batch
        many = np.bincount(block, minlength=self.side)
        moved *= (rate / np.maximum(many, n // BLOCKS)).astype(np.float32)[block][:, None]
        own = np.empty_like(back)
        for b, rows in ranges:
            w, y = p["token"][b], d[rows]
            np.matmul(y, w[:-1].T, out=own[rows])
            w -= moved[rows].T @ y
        back += own
        p["block"] -= step * (h.T @ e)
        p["block_bias"] -= step * e.sum(0)
        back *= 1 - h * h
        p["mid"] -= step * back.sum(0)
        for i in range(len(around)):
            # the mean over a token's own places: frequent and rare tokens move alike
            t = around[i]
            moves = back * (-rate / np.maximum(np.bincount(t)[t], n / TOKENS)).astype(np.float32)[:, None]
            # numbers are added two at a time, as complex ones
            np.add.at(p["emb"][i].view(np.complex64).reshape(-1), (t[:, None] * (SIZE // 2) + np.arange(SIZE // 2)).ravel(), moves.view(np.complex64).ravel())


def _short(a: np.ndarray) -> np.ndarray:
    """In 16 bits where they do, which sort faster."""
    return a.astype(np.uint16) if len(a) and a.max() < 1 << 16 else a


def _shifted(z: np.ndarray) -> np.ndarray:
    """Scores that leave the range of exp, less their row's greatest, in place; others as they are."""
    if len(z) and max(z.max(), -z.min()) > 60:
        z -= z.max(1, keepdims=True)
    return z


def _summed(z: np.ndarray) -> np.ndarray:
    return z @ np.ones(z.shape[1], np.float32)


def _softmax(z: np.ndarray) -> np.ndarray:
    """In place."""
    np.exp(_shifted(z), out=z)
    z *= (1 / _summed(z))[:, None]
    return z


def _log_of(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The logarithm of the softmax at one place of each row; z is used up."""
    got = _shifted(z)[np.arange(len(z)), at]
    return got - np.log(_summed(np.exp(z, out=z)))


def as_tokens(docs: DataFrame, known: np.ndarray) -> DataFrame:
    """doc_id, fp (hash of the text) and tok (the tokens of all its words, two or four bytes each), written once for all passes."""
    ensure_checkpoint_dir(docs.sparkSession)
    held, width = docs.sparkSession.sparkContext.broadcast(known), _width(side_of(len(known)))

    def encode(batches):
        for batch in batches:
            buf, off = texts(batch["text"])
            for i, j in slices(off):
                words, first = word_hashes(buf[off[i]:off[j]], off[i:j + 1] - off[i])
                ends = pa.array(first * np.dtype(width).itemsize, pa.int64()).buffers()[1]
                tok = pa.Array.from_buffers(pa.large_binary(), j - i, [None, ends, pa.py_buffer(tokens(words, held.value).astype(width))])
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, j - i).cast(pa.int64()), batch["fp"].slice(i, j - i), tok.cast(pa.binary())], names=["doc_id", "fp", "tok"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("fp")).mapInArrow(encode, "doc_id long, fp long, tok binary").checkpoint()


def _width(side: int) -> type:
    return np.uint16 if side * side < 1 << 16 else np.int32


def encoded(column, side: int):
    """Pieces of a column of tokens of bounded size: tokens, each text's first token, and the texts' range in the column."""
    buf, off = texts(column)
    width = _width(side)
    tok, off = buf.view(width).astype(np.int32, copy=False), off // np.dtype(width).itemsize
    for i, j in slices(off, PIECE):
        yield tok[off[i]:off[j]], off[i:j + 1] - off[i], i, j


def train(docs: DataFrame, known: np.ndarray, rounds: int = ROUNDS, share: np.ndarray | None = None, coded: DataFrame | None = None) -> Network:
    """Rounds of local descent in every partition and averages of all partitions' parameters; coded: the texts as tokens, if at hand."""
    net = Network.start(side_of(len(known)), share)
    spark = docs.sparkSession
    coded = as_tokens(docs, known) if coded is None else coded
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(net.flat())

        def descend(batches, shared=shared, turn=turn):
            net, seen = Network.of(shared.value), 0
            rng = np.random.default_rng(turn)
            for batch in batches:
                for tok, first, _, _ in encoded(batch["tok"], net.side):
                    around = windows(tok, first, net.side ** 2)
                    order = rng.permutation(np.arange(turn, len(tok), rounds))
                    for a in range(0, len(order), BATCH):
                        rows = order[a:a + BATCH]
                        net.learn(around[:, rows], tok[rows], RATE / (turn + 1))
                    seen += len(order)
            parts = np.array_split(net.flat(), RANGES) if seen else []
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([seen] * len(parts), pa.int64()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["part", "weight", "values"])

        def mean(key, batches):
            total, weight = 0.0, 0
            for batch in batches:
                for w, v in zip(batch["weight"].to_pylist(), batch["values"]):
                    total = total + w * np.frombuffer(v.as_py(), np.float32).astype(np.float64)
                    weight += w
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary())], names=["part", "values"])

        sent = coded.select("tok").mapInArrow(descend, "part int, weight long, values binary")
        got = {r["part"]: np.frombuffer(r["values"], np.float32) for r in sent.groupBy("part").applyInArrow(_each(mean), "part int, values binary").collect()}
        if got:
            net = Network.of(np.concatenate([got[i] for i in sorted(got)]))
    return net


def _each(fn):
    """A grouped function that reads its group batch by batch."""
    def grouped(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(key, batches)
    grouped.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return grouped


def rare_shares(docs: DataFrame, known: np.ndarray) -> DataFrame:
    """fp (hash of a text) and share: the sum over a text's words without a token of their own, each as often as it occurs, of
    the logarithm of its part of all such words of its token. Texts without such words are left out."""
    n, held = X.width(docs), docs.sparkSession.sparkContext.broadcast(known)

    def send(batches):
        known = held.value
        for batch in batches:
            buf, off = texts(batch["text"])
            fps = batch["fp"].to_numpy()
            rows = []
            for i, j in slices(off):
                words, first = word_hashes(buf[off[i]:off[j]], off[i:j + 1] - off[i])
                tok = tokens(words, known)
                rare = np.flatnonzero(tok >= len(known))
                bucket = tok[rare] % n
                order = np.argsort(_short(bucket), kind="stable")
                text = np.repeat(np.arange(i, j), np.diff(first))[rare][order]
                words, cut = words[rare][order], np.searchsorted(bucket[order], np.arange(n + 1))
                for b in np.flatnonzero(np.diff(cut)):
                    part = text[cut[b]:cut[b + 1]]
                    new = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
                    rows.append((int(b), words[cut[b]:cut[b + 1]].tobytes(), fps[part[new]].tobytes(), np.diff(np.append(new, len(part))).astype(np.uint32).tobytes()))
            yield from X.table_of(rows, _SENT).to_batches()

    def count(table):
        words, fps, sizes = (np.frombuffer(b"".join(table[c].to_pylist()), t) for c, t in (("words", U), ("texts", np.int64), ("sizes", np.uint32)))
        order = np.argsort(words)
        w = words[order]
        first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
        times = np.diff(np.append(first, len(w)))
        tok = tokens(w[first], held.value)
        share = np.empty(len(w))
        share[order] = np.repeat(np.log(times / np.bincount(tok, times)[tok]), times)
        summed = np.add.reduceat(share, np.cumsum(sizes, dtype=np.int64) - sizes)
        # rows with one text all have the same sum
        fps, once = np.unique(fps.view(U), return_index=True)
        summed, cut = summed[once], X._cuts(fps, n)
        parts = [(int(r), slice(cut[r], cut[r + 1])) for r in np.flatnonzero(np.diff(cut))]
        return X.table_of([(r, table["bucket"][0].as_py(), fps[p].tobytes(), summed[p].tobytes()) for r, p in parts], _FOUND)

    def add(table):
        table = table.sort_by("bucket")
        fps, shares = (np.frombuffer(b"".join(table[c].to_pylist()), t) for c, t in (("texts", np.int64), ("shares", np.float64)))
        order = np.argsort(fps, kind="stable")
        fps = fps[order]
        first = np.flatnonzero(np.concatenate(([True], fps[1:] != fps[:-1])))
        return pa.Table.from_arrays([pa.array(fps[first]), pa.array(np.add.reduceat(shares[order], first))], schema=_SHARES)

    sent = docs.select("text", F.xxhash64("text").alias("fp")).mapInArrow(send, "bucket int, words binary, texts binary, sizes binary")
    found = sent.groupBy("bucket").applyInArrow(count, "range int, bucket int, texts binary, shares binary")
    return found.groupBy("range").applyInArrow(add, "fp long, share double")


def pseudo_likelihood(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_words, log_likelihood (summed over words) and mean_log_likelihood (null without words)."""
    known, times, total = vocabulary(docs)
    hashed = side_of(len(known)) ** 2 - len(known)
    share = np.concatenate((times, np.full(hashed, max(total - times.sum(), 1) / hashed))) / max(total, 1)
    coded = as_tokens(docs, known)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, known, rounds, share, coded).flat())

    def score(batches):
        net = Network.of(shared.value)
        for batch in batches:
            n, summed = np.zeros(len(batch), np.int64), np.zeros(len(batch))
            for tok, first, i, j in encoded(batch["tok"], net.side):
                around = windows(tok, first, net.side ** 2)
                total, many = np.zeros(len(tok) + 1), BATCH
                for a in range(0, len(tok), many):
                    total[a + 1:a + 1 + many] = net.log_probability(around[:, a:a + many], tok[a:a + many])
                total = np.cumsum(total)
                n[i:j], summed[i:j] = np.diff(first), total[first[1:]] - total[first[:-1]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["fp"], pa.array(n, pa.int64()), pa.array(summed)], names=["doc_id", "fp", "n_words", "likely"])

    scored = coded.mapInArrow(score, "doc_id long, fp long, n_words long, likely double")
    both = scored.join(rare_shares(docs, known), "fp", "left").withColumn("log_likelihood", F.col("likely") + F.coalesce("share", F.lit(0.0)))
    return both.select("doc_id", "n_words", "log_likelihood", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")).alias("mean_log_likelihood"))
