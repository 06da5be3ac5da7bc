"""Toxicity: Levenshtein automata intersected with a lexicon trie, and scores of the context around each hit.

The lexicon is learned from a bounded sample of labelled rows: words, and stems of four bytes or more, that toxic documents bear
much oftener than clean ones, each with a weight by how much. All entries stand in one trie. Its walk with at most one edit is the product of the trie with the
Levenshtein automata of all its words at once; it is determinized into a table of transitions over bytes, and a block of texts
is run through the table a byte of every word at a time. Stems match exactly at the start of a word, words match whole with one
edit, unless clean documents of the sample bear their misspellings.

A hit counts by its context: words within ``CONTEXT`` words are looked at for further hits and for quotation marks around it; a
single quoted hit weighs little, hits close together weigh more. The sum of weights gives the score by a logistic curve
fitted to the sample.

Every text is read whole. Null and empty texts, and all texts where nothing can be learned, get the score of no hits. Repeated
rows get equal scores; other columns are not looked at.
"""
from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.hashing import lower, slices, texts
from tapeworks.llm.learning import held_out, sample

STEM, LONGEST, CONTEXT, PREDICT = 4, 24, 6, 0.7
WORDY = np.zeros(256, bool)
WORDY[48:58] = WORDY[65:91] = WORDY[97:123] = WORDY[128:] = True
WORDY[[36, 64]] = True  # $ and @ stand for letters
QUOTES = np.zeros(256, bool)
QUOTES[34] = True


def spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of word bytes, and the first run of each text."""
    inside = WORDY[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = off[:-1][off[:-1] < len(buf)]
    first[cut] = inside[cut]
    cut = cut[cut > 0] - 1
    last[cut] = inside[cut]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, off)


class Automaton:
    """Trie of stems and words with up to one edit, as a table: state x byte -> state; state 0 is dead."""

    def __init__(self, stems: list[bytes], words: list[bytes], fuzzy: list[bytes]):
        self.stems, self.words = stems, words
        child: list[dict[int, int]] = [{}]
        stem_end, word_end, bends = {}, {}, {0}

        def add(term: bytes, ends: dict, number: int, bend: bool) -> None:
            node = 0
            for b in term:
                if b not in child[node]:
                    child[node][b] = len(child)
                    child.append({})
                node = child[node][b]
                if bend:
                    bends.add(node)
            ends[node] = number

        for i, term in enumerate(stems):
            add(term, stem_end, i, False)
        may = set(fuzzy)
        for i, term in enumerate(words):
            add(term, word_end, i, term in may)
        fuzzy_end = {n: i for n, i in word_end.items() if words[i] in may}
        letters = sorted({b for c in child for b in c})

        def closed(states: set) -> frozenset:
            out = set(states)
            for node, edits in states:
                if edits == 0:  # a byte of the term left out
                    out |= {(n, 1) for n in child[node].values() if n in bends}
            return frozenset(s for s in out if not (s[1] == 1 and (s[0], 0) in out))

        def step(states: frozenset, b: int) -> frozenset:
            out = set()
            for node, edits in states:
                n = child[node].get(b)
                if n is not None and (edits == 0 or n in bends):
                    out.add((n, edits))
                if edits == 0:
                    if node:  # a byte too many; the first byte must stand
                        out.add((node, 1))
                        out |= {(n, 1) for n in child[node].values() if n in bends}
            return closed(out) if out else frozenset()

        start = frozenset({(0, 0)})
        number = {frozenset(): 0, start: 1}
        queue, rows = [start], [None, None]
        while queue:
            states = queue.pop()
            other = step(states, -1)
            row = {}
            for b in [-1, *letters]:
                to = other if b < 0 else step(states, b)
                if to not in number:
                    number[to] = len(rows)
                    rows.append(None)
                    queue.append(to)
                row[b] = number[to]
            rows[number[states]] = row
        self.table = np.zeros((len(rows), 256), np.int32)
        self.stem, self.exact, self.near = (np.full(len(rows), -1, np.int32) for _ in range(3))
        for states, i in number.items():
            if rows[i]:
                self.table[i] = rows[i][-1]
                for b, to in rows[i].items():
                    if b >= 0:
                        self.table[i, b] = to
            for node, edits in states:
                if edits == 0:
                    self.stem[i] = stem_end.get(node, self.stem[i])
                    self.exact[i] = word_end.get(node, self.exact[i])
                else:
                    self.near[i] = fuzzy_end.get(node, self.near[i])

    def run(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word: 2 for a whole or stem match, 1 for a misspelling, 0 else; and the entry (words after stems)."""
        kind, entry = np.zeros(len(start), np.int8), np.full(len(start), -1, np.int32)
        live, state, at = np.arange(len(start)), np.ones(len(start), np.int32), start.copy()
        while len(live):
            state = self.table[state, buf[at]]
            at = at + 1
            keep = state > 0
            live, state, at = live[keep], state[keep], at[keep]
            hit = self.stem[state] >= 0
            kind[live[hit]], entry[live[hit]] = 2, self.stem[state[hit]]
            over = ~hit & (at == end[live])
            done, s = live[over], state[over]
            whole, near = self.exact[s] >= 0, (self.exact[s] < 0) & (self.near[s] >= 0)
            kind[done[whole]], entry[done[whole]] = 2, len(self.stems) + self.exact[s[whole]]
            kind[done[near]], entry[done[near]] = 1, len(self.stems) + self.near[s[near]]
            rest = ~(hit | over)
            live, state, at = live[rest], state[rest], at[rest]
        return kind, entry


@dataclass
class Model:
    automaton: Automaton | None
    weights: np.ndarray  # of stems, then words
    slope: float
    base: float

    def score(self, mass: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * mass + self.base)))


def masses(automaton: Automaton | None, weights: np.ndarray, buf: np.ndarray, off: np.ndarray, seen=None) -> np.ndarray:
    """The weight of each text's hits in their contexts. seen: called with the misspelled words of texts, for learning."""
    out = np.zeros(len(off) - 1)
    if automaton is None:
        return out
    for i, j in slices(off):
        part, o = buf[off[i]:off[j]], off[i:j + 1] - off[i]
        start, end, first = spans(part, o)
        kind, entry = automaton.run(lower(part), start, end)
        hits = np.flatnonzero(kind)
        if not len(hits):
            continue
        text = np.searchsorted(first, hits, "right") - 1
        quotes = np.concatenate(([0], np.cumsum(QUOTES[part])))
        lines = np.flatnonzero(part == 10)
        line = np.maximum(o[text], np.concatenate(([0], lines + 1))[np.searchsorted(lines, start[hits])])
        stop = np.minimum(o[text + 1], np.append(lines, len(part))[np.searchsorted(lines, end[hits])])
        quoted = ((quotes[start[hits]] - quotes[line]) % 2 == 1) & (quotes[stop] > quotes[end[hits]])
        near = np.zeros(len(hits), bool)
        close = (np.diff(hits) <= CONTEXT) & (np.diff(text) == 0)
        near[1:] |= close
        near[:-1] |= close
        weight = weights[entry[hits]] * np.where(kind[hits] == 2, 1.0, 0.8) * np.where(quoted & ~near, 0.2, 1.0) * np.where(near & ~quoted, 1.25, 1.0)
        out[i:j] += np.bincount(text, weight, minlength=j - i)
        if seen is not None:
            for h, t in zip(hits[kind[hits] == 1], text[kind[hits] == 1]):
                seen(i + int(t), int(entry[h]) - len(automaton.stems))
    return out


def lexicon(docs: list[tuple[int, bytes]], least: int = 4, low: float = 8.0, high: float = 24.0) -> tuple[list[bytes], list[bytes], np.ndarray]:
    """Stems and words that toxic texts (label 1) bear at least ``low`` times as often as clean ones, and their weights: 0 there, 1 from ``high`` on."""
    toxic, clean = Counter(), Counter()
    for label, text in docs:
        buf = lower(np.frombuffer(text, np.uint8))
        start, end, _ = spans(buf, np.array([0, len(buf)]))
        data = buf.tobytes()
        forms = set()
        for w in {data[a:b] for a, b in zip(start.tolist(), end.tolist()) if b - a <= LONGEST}:
            forms.add((w, True))
            forms.update((w[:k], False) for k in range(STEM, len(w)))
        (toxic if label else clean).update(forms)
    n1, n0 = sum(x for x, _ in docs), sum(1 - x for x, _ in docs)

    def weight(form) -> float:
        rate = (toxic[form] / (n1 + 1)) / ((clean[form] + 1) / (n0 + 1))
        return min(1.0, float(np.log(max(rate, 1e-9) / low) / np.log(high / low)))

    least = max(least, round(0.015 * n1))
    sure = [f for f, t in toxic.items() if t >= least and weight(f) > 0]
    stems, short = [], set()
    for w in sorted((w for w, whole in sure if not whole and toxic[(w, False)] >= 2 * least), key=lambda w: (len(w), w)):
        if not any(w[:k] in short for k in range(STEM, len(w))) and _branches(w, toxic) and _utf8(w):
            short.add(w)
            stems.append(w)
    words = sorted(w for w, whole in sure if whole and len(w) >= 3 and not any(w[:k] in short for k in range(STEM, len(w) + 1)))
    return stems, words, np.array([weight((w, False)) for w in stems] + [weight((w, True)) for w in words])


def _branches(stem: bytes, toxic: Counter) -> bool:
    """Whether words go on from the stem in more than one way, so that it is no mere part of one word."""
    whole = toxic[(stem, True)]
    longest = max((toxic[(stem + bytes([b]), kind)] for b in range(256) for kind in (True, False)), default=0)
    return longest < 0.8 * toxic[(stem, False)] or whole > 0


def _utf8(stem: bytes) -> bool:
    try:
        stem.decode()
    except UnicodeDecodeError:
        return False
    return True


def fit(docs: list[tuple[int, bytes]]) -> Model:
    """docs: label and text."""
    if not docs:
        return Model(None, np.zeros(0), 0.0, -2.0)
    stems, words, weights = lexicon(docs)
    labels = np.array([x for x, _ in docs], float)
    column = pa.array([t for _, t in docs], pa.binary())
    buf, off = texts(column)
    fuzzy = [w for w in words if len(w) >= 5]
    if fuzzy:
        clean: Counter = Counter()
        masses(Automaton(stems, words, fuzzy), weights, buf, off, lambda doc, term: clean.update([term] if not labels[doc] else []))
        fuzzy = [w for i, w in enumerate(words) if len(w) >= 5 and clean[i] == 0]
    automaton = Automaton(stems, words, fuzzy) if stems or words else None
    x = masses(automaton, weights, buf, off)
    slope, base = 1.0, -1.0
    for _ in range(4000):  # logistic curve, with a little weight against extremes
        p = 1 / (1 + np.exp(-(slope * x + base)))
        slope -= 0.5 * (((p - labels) * np.minimum(x, 10)).mean() + 1e-4 * slope)
        base -= 0.5 * ((p - labels).mean() + 1e-4 * base)
    return Model(automaton, weights, max(slope, 0.0), base)


def learn(docs: DataFrame, labels: DataFrame, most: int = 3000) -> Model:
    """docs: doc_id and text, all of which may be learned from; labels: doc_id and toxic (0, 1 or null)."""
    known = labels.where("toxic IS NOT NULL").groupBy("doc_id").agg({"toxic": "max"}).withColumnRenamed("max(toxic)", "toxic")
    labelled = known.join(docs.where("text IS NOT NULL").select("doc_id"), "doc_id").select("doc_id", "toxic")
    picked = F.broadcast(sample(labelled, "toxic", most))  # ids only, bounded by ``most``, so texts needn't move
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(picked, "doc_id")
    got = sorted((int(r["doc_id"]), int(r["toxic"]), r["text"].encode("utf-8", "replace")) for r in rows.collect())
    return fit([(y, t) for _, y, t in got])


def toxicity(docs: DataFrame, labels: DataFrame, most: int = 3000) -> DataFrame:
    """doc_id, held_out, score, predicted and mass (the weight of hits); learned from the rows that are not held out."""
    model = learn(docs.where(~held_out()), labels, most)

    def predict(batches):
        for batch in batches:
            mass = masses(model.automaton, model.weights, *texts(batch["text"]))
            score = model.score(mass)
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(score), pa.array((score >= PREDICT).astype(np.int32)), pa.array(mass)],
                                             names=["doc_id", "score", "predicted", "mass"])

    out = docs.select("doc_id", "text").mapInArrow(predict, "doc_id long, score double, predicted int, mass double")
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted", "mass")
