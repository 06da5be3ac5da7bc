"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the average of the embeddings of its hashed byte 3- and 4-grams (letters folded to lower case, everything that is
no letter a blank), and a linear softmax over the average gives the language. Both layers are trained together by stochastic
gradient descent in numpy on a bounded sample of labelled rows, at most about ``most`` for each language. A quarter of the
sample is kept apart for calibration: a temperature that minimizes its log loss, and the lowest score above which its
predictions reach ``precision``; predictions below are marked as rejected.

Null texts and texts without a letter are ``und`` with score 0; so is everything where nothing can be learned. Very long texts
are read whole. Repeated rows get equal answers. Columns other than doc_id, text and lang are not looked at.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.hashing import slices, texts
from tapeworks.llm.learning import held_out, sample

BITS = 13
FOLD = np.full(256, 32, np.uint32)
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)
ROWS = 256


def subwords(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of the 3-gram and of the 4-gram that start at each byte (fewer at the end)."""
    c = FOLD[buf]
    if len(c) < 3:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    three = (c[:-2] << 16) | (c[1:-1] << 8) | c[2:]
    four = (c[:-3] << 24) | three[1:] if len(c) > 3 else np.zeros(0, np.uint32)
    return (three * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS), (four * np.uint32(0x85EBCA6B) + np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS)


def features(buf: np.ndarray, off: np.ndarray):
    """Blocks of (first text, matrix): the share of each bucket in each text's subwords."""
    for i, j in slices(off):
        base = off[i]
        three, four = subwords(buf[base:off[j]])
        for a in range(i, j, ROWS):
            b = min(j, a + ROWS)
            x = np.zeros((b - a, 1 << BITS), np.float32)
            for r in range(a, b):
                s, e = off[r] - base, off[r + 1] - base
                if e - s > 2:
                    x[r - a] = np.bincount(three[s:e - 2], minlength=1 << BITS)
                if e - s > 3:
                    x[r - a] += np.bincount(four[s:e - 3], minlength=1 << BITS)
            yield a, x / np.maximum(x.sum(1, keepdims=True), 1)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # bucket -> logits, the product of both layers
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = (x @ self.table + self.bias) / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, langs: list[str], size: int = 16, epochs: int = 12, rate: float = 0.5, batch: int = 32, precision: float = 0.995) -> Model:
    rng = np.random.default_rng(17)
    order = rng.permutation(len(x))
    cut = len(x) - len(x) // 4
    fit, rest = order[:cut], order[cut:]
    emb = rng.normal(0, 0.1, (x.shape[1], size)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (size, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    gain = np.float32(20)  # averages of many embeddings are short
    for epoch in range(epochs):
        step = np.float32(rate * (1 - epoch / epochs))
        for at in range(0, len(fit), batch):
            rows = fit[at:at + batch]
            mean = gain * (x[rows] @ emb)
            z = mean @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            back = gain * (p @ out.T)
            out -= step * (mean.T @ p)
            bias -= step * p.sum(0)
            emb -= step * gain * (x[rows].T @ back)
        fit = rng.permutation(fit)
    model = Model(langs, gain * (emb @ out), bias, 1.0, 0.0)
    if len(rest):
        z = x[rest] @ model.table + bias
        loss = []
        for t in (grid := np.geomspace(0.1, 10, 41)):
            s = z / t
            s -= s.max(1, keepdims=True)
            loss.append(float((np.log(np.exp(s).sum(1)) - s[np.arange(len(rest)), y[rest]]).mean()))
        model.temperature = float(grid[int(np.argmin(loss))])
        p = model.probabilities(x[rest])
        best = np.argsort(-p.max(1), kind="stable")
        right = np.cumsum(p.argmax(1)[best] == y[rest][best]) / np.arange(1, len(best) + 1)
        good = np.flatnonzero(right >= precision)
        model.threshold = float(p.max(1)[best[good[-1]]]) if len(good) else 1.0
    return model


def learn(rows: DataFrame, most: int = 1500) -> Model | None:
    """rows: doc_id, text and lang, all of which may be learned from."""

    def vectors(batches):
        for batch in batches:
            out = []
            langs = batch["lang"].to_pylist()
            for a, x in features(*texts(batch["text"])):
                for r in range(len(x)):
                    at = np.flatnonzero(x[r])
                    out.append((langs[a + r], at.astype(np.int32).tobytes(), x[r][at].tobytes()))
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], names=["lang", "at", "share"])

    drawn = sample(rows.select("doc_id", "text", "lang").where("text IS NOT NULL AND lang IS NOT NULL"), "lang", most)
    got = sorted(drawn.mapInArrow(vectors, "lang string, at binary, share binary").collect())
    if not got:
        return None
    langs = sorted({r["lang"] for r in got})
    x = np.zeros((len(got), 1 << BITS), np.float32)
    for i, r in enumerate(got):
        x[i, np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["share"], np.float32)
    return train(x, np.array([langs.index(r["lang"]) for r in got]), langs)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score and rejected."""

    def predict(batches):
        for batch in batches:
            pred, score = ["und"] * len(batch), np.zeros(len(batch))
            letters = batch["letters"].to_pylist()
            if model is not None:
                for a, x in features(*texts(batch["text"])):
                    p = model.probabilities(x)
                    for r, k in enumerate(p.argmax(1)):
                        if letters[a + r]:
                            pred[a + r], score[a + r] = model.langs[k], float(p[r, k])
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(pred, pa.string()), pa.array(score, pa.float64()),
                                              pa.array(score < (model.threshold if model else 1.0), pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    return docs.select("doc_id", "text", letters).mapInArrow(predict, "doc_id long, lang_pred string, score double, rejected boolean")


def language(docs: DataFrame, most: int = 1500) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected; learned from the rows that are not held out."""
    model = learn(docs.where(~held_out()), most)
    out = identify(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
