"""Learned and fitted operators: known answers, held-out accuracy, numeric gradients and brute force."""
import zlib
from collections import Counter

import numpy as np
from conftest_llm import FIXTURE, words
from pyspark.sql import functions as F

from tapeworks.llm import op3_language, op7_toxicity, op10_pll
from tapeworks.llm.hashing import texts

SMALL = FIXTURE.replace("0.001", "0.01")


def outside(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_op3_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = op3_language.language(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.held_out == got.doc_id.map(outside)).all() and got.score.between(0, 1).all()
    assert (got.lang_pred == got.lang)[got.held_out].mean() > 0.98
    assert (got.lang_pred == got.lang)[got.held_out & ~got.rejected].mean() > 0.99


def test_op3_odd_rows(spark, odd, none):
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in op3_language.language(odd).collect()]
    assert {x for i, x, _ in got if i in (3, 4, 5)} == {"und"} and all(x != "und" for i, x, _ in got if i in (1, 6, 11))
    assert len(got) == odd.count() and len({x for x in got if x[0] == 11}) == 1
    assert op3_language.language(none).count() == 0


def distance_one(a: bytes, b: bytes) -> bool:
    """At most one edit, the first byte unchanged."""
    if a[:1] != b[:1]:
        return False
    if a == b:
        return True
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] or a[i + 1:] == b[i:] or a[i:] == b[i + 1:]


def test_op7_automaton_against_distances():
    rng = np.random.default_rng(3)
    terms = sorted({bytes(rng.choice(list(b"abc"), rng.integers(4, 8))) for _ in range(25)})
    tried = {bytes(rng.choice(list(b"abcd"), rng.integers(1, 10))) for _ in range(4000)} | set(terms)
    automaton = op7_toxicity.Automaton([], terms, terms)
    for w in sorted(tried):
        buf = np.frombuffer(w, np.uint8)
        kind, _ = automaton.run(buf, np.array([0]), np.array([len(w)]))
        assert kind[0] == (2 if w in terms else 1 if any(distance_one(t, w) for t in terms) else 0), w


def test_op7_contexts_and_stems():
    a = op7_toxicity.Automaton([b"grub"], [b"idiot"], [b"idiot"])
    weights = np.ones(2)
    mass = lambda t: op7_toxicity.masses(a, weights, *texts(__import__("pyarrow").array([t])))[0]
    assert mass("you Idiot there") == 1 and mass("you idi0t there") == 0.8 and mass("grubbing") == 1 and mass("grab idiom") == 0.8
    assert mass('they said "idiot" once') == 0.2 and mass('a line "open\nidiot') == 1
    assert mass("idiot idiot") == 2.5 and mass("") == 0 and mass(None) == 0 and mass("clean words") == 0


def test_op7_held_out(spark, odd, none, labels):
    docs, marks = (spark.read.parquet(f"{FIXTURE.replace('0.001', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    got = op7_toxicity.toxicity(docs, marks).join(marks, "doc_id").toPandas()
    assert (got.held_out == got.doc_id.map(outside)).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()
    rest = got[got.held_out]
    assert rest.predicted[rest.toxic == 1].mean() > 0.8 and rest.predicted[rest.toxic == 0].mean() < 0.01
    assert op7_toxicity.toxicity(odd, labels).count() == odd.count()
    assert op7_toxicity.toxicity(none, labels).count() == 0 and op7_toxicity.toxicity(odd, labels.where("false")).count() == odd.count()


def test_op10_probabilities_and_gradient():
    rng = np.random.default_rng(1)
    net = op10_pll.Network.start()
    tok = rng.integers(0, op10_pll.TOKENS, 60).astype(np.int32)
    around = op10_pll.windows(tok, np.array([0, 20, 20, 60]))
    assert (around[:, 0][:2] == op10_pll.EDGE).all() and around[2, 0] == tok[1] and around[2, 19] == op10_pll.EDGE
    every = np.arange(op10_pll.TOKENS)
    one = np.repeat(around[:, 5:6], len(every), 1)
    assert abs(np.exp(net.log_probability(one, every)).sum() - 1) < 1e-3
    before = net.log_probability(around, tok).mean()
    for _ in range(20):
        net.learn(around, tok, 0.5)
    assert net.log_probability(around, tok).mean() > before + 0.5
    assert all((a == b).all() for a, b in zip(op10_pll.Network.of(net.flat()).p.values(), net.p.values()))


def test_op10_scores(spark, odd, none):
    got = {(r["doc_id"], r["n_words"], r["log_likelihood"], r["mean_log_likelihood"]) for r in op10_pll.pseudo_likelihood(odd).collect()}
    by = {i: (n, s, m) for i, n, s, m in got}
    assert all(n == len(words(r["text"])) for r in odd.collect() for n in [by[r["doc_id"]][0]])
    assert by[3] == by[4] == by[5] == (0, 0.0, None) and abs(by[9][1] - by[10][1]) < 1e-4 * abs(by[9][1]) and all(s < 0 for n, s, _ in by.values() if n)
    assert op10_pll.pseudo_likelihood(none).count() == 0


def test_op10_learns_the_corpus(spark):
    docs = spark.read.parquet(f"{FIXTURE}/documents.parquet")
    known = op10_pll.frequent(docs)
    net = op10_pll.train(docs, known)
    buf, off = texts(docs.select("text").toArrow()["text"])
    words_, first = op10_pll.word_hashes(buf, off)
    tok = op10_pll.tokens(words_, known)
    around = op10_pll.windows(tok, first)
    assert net.log_probability(around, tok).mean() > op10_pll.Network.start().log_probability(around, tok).mean() + 0.2


def test_op10_vocabulary_grows_with_the_corpus(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(1500))) for i in range(20)] + [(99, "seldom")], "doc_id long, text string")
    known = op10_pll.frequent(docs)
    hashes = op10_pll.word_hashes(*texts(docs.where("doc_id = 0").select("text").toArrow()["text"]))[0]
    assert set(known.tolist()) == set(hashes.tolist()) and sorted(op10_pll.tokens(hashes, known)) == list(range(1500))
    net = op10_pll.Network.start(op10_pll.side_of(len(known)))
    every = np.arange(net.side ** 2)
    assert len(every) > 1500 and abs(np.exp(net.log_probability(np.full((4, len(every)), len(every)), every)).sum() - 1) < 1e-3
    assert op10_pll.Network.of(net.flat()).side == net.side


def test_op10_every_word_has_its_own_probability(spark, odd):
    """Shares of rare words against counts by hand, repeated and null rows included, and what they do to the scores."""
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()] + [(50, " ".join(f"r{i}" for i in range(3000) for _ in range(1 + i % 2)))]
    rows += [(100 + i, f"r{i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = op10_pll.frequent(docs)
    table = docs.withColumn("fp", F.xxhash64("text")).toArrow()
    hashes, first = op10_pll.word_hashes(*texts(table["text"]))
    tok = op10_pll.tokens(hashes, known).tolist()
    times, whole = Counter(hashes.tolist()), Counter(tok)
    want = {}
    for i, fp in enumerate(table["fp"].to_pylist()):
        want[fp] = sum(np.log(times[h] / whole[t]) for h, t in zip(hashes[first[i]:first[i + 1]].tolist(), tok[first[i]:first[i + 1]]) if t >= len(known))
    got = {r["fp"]: r["share"] for r in op10_pll.rare_shares(docs, known).collect()}
    assert len(known) >= 512 and set(got) <= set(want) and all(abs(got.get(fp, 0) - s) < 1e-9 * (1 + abs(s)) for fp, s in want.items())
    scores = {r["doc_id"]: r["log_likelihood"] for r in op10_pll.pseudo_likelihood(docs).collect()}
    by = {}
    for n, fp, t in ((d, f, tok[first[i]]) for i, (d, f) in enumerate(zip(table["doc_id"].to_pylist(), table["fp"].to_pylist())) if d is not None and d >= 100):
        by.setdefault(t, []).append(scores[n] - want[fp])
    # single words of one token differ by their shares and by nothing else
    assert any(len(x) > 1 for t, x in by.items() if t >= len(known)) and all(max(x) - min(x) < 1e-4 for x in by.values())


def test_op6_rates_reach_targets(spark, odd, none, labels):
    from tapeworks.llm.op6_mixing import BUCKETS, DOMAINS, Classifier, memberships, mix

    docs, marks = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    got = mix(docs, marks, budget=0.5).toPandas()
    total = got.n_words.sum()
    for d, (share, _) in DOMAINS.items():
        assert abs((got.n_words * got.rate * got[f"p_{d}"]).sum() / total / 0.5 - share) < 1e-3
    assert (got.rate >= 0).all() and (abs(got[[f"p_{d}" for d in DOMAINS]].sum(axis=1) - 1) < 1e-9).all() and len(got) == docs.count()
    assert (got.n_words == [len(words(t)) for t in got.merge(docs.toPandas(), on="doc_id").text]).all()
    # posteriors by hand for a tiny model
    model = Classifier(["a", "b"], [[0.5] * BUCKETS], [0.6, 0.4])
    for r, x in zip(memberships(odd, model).collect(), odd.collect()):
        n = len(words(x["text"]))
        p = 1 / (1 + 0.6 / 0.4 * np.exp(-0.5 * np.sqrt(n)))
        assert r["n_words"] == n and abs(r["p1"] - p) < 1e-9
    assert mix(odd, labels).count() == odd.count() and mix(none, labels).count() == 0 and mix(odd, labels.where("false")).count() == odd.count()


def test_op6_projected_gradient_matches_numpy(spark):
    from tapeworks.llm.op6_mixing import rates

    rng = np.random.default_rng(2)
    p1 = rng.integers(0, 65, 300) / 64
    n = rng.integers(1, 500, 300)
    members = spark.createDataFrame([(int(a), float(1 - b), float(b)) for a, b in zip(n, p1)], "n_words long, p0 double, p1 double")
    got = members.select("*", rates(members, [0.3, 0.7], 0.8).alias("r")).toPandas()
    for share, p in ((0.3, got.p0), (0.7, got.p1)):
        assert abs((got.n_words * got.r * p).sum() / got.n_words.sum() - share * 0.8) < 1e-3


def test_op6_totals_of_small_posteriors(spark):
    """Words whose posteriors all lie below half a cell still count: the fitted totals are those of the exact posteriors."""
    from tapeworks.llm.op6_mixing import rates

    rng = np.random.default_rng(3)
    p1 = np.concatenate([rng.uniform(0, 1 / 128, 400), rng.uniform(0.4, 1, 40)])
    n = rng.integers(1, 500, len(p1))
    members = spark.createDataFrame([(int(a), float(1 - b), float(b)) for a, b in zip(n, p1)], "n_words long, p0 double, p1 double")
    got = members.select("*", rates(members, [0.9, 0.1], 0.5).alias("r")).toPandas()
    assert (got.r >= 0).all()
    for share, p in ((0.9, got.p0), (0.1, got.p1)):
        assert abs((got.n_words * got.r * p).sum() / got.n_words.sum() - share * 0.5) < 1e-3


def test_pipeline_decides_by_row(spark, tmp_path):
    """Of two rows with one doc_id, or with none, only the one that a stage rejects goes."""
    import corpus_pipeline as cp

    item = "the capital of the small island lies on its western shore near the old harbour"
    good = [" ".join(f"word{(i * 7 + j) % 61} runs" for i in range(25)) for j in range(4)]
    rows = [(1, good[0]), (1, f"some words before {item} and after"), (None, good[1]), (None, "too short"), (2, good[2]), (2, None), (3, good[3])]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(9, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = sorted((tuple(r)[:2] for r in cp.benchmark_items(spark, docs, str(tmp_path)).collect()), key=repr)
    assert left == sorted([rows[0], *rows[2:]], key=repr)
    left = sorted((tuple(r)[:2] for r in cp.quality_rules(spark, docs, str(tmp_path)).collect()), key=repr)
    assert (None, "too short") not in left and (2, None) not in left and {(1, good[0]), (None, good[1]), (2, good[2]), (3, good[3])} <= set(left)


def test_op5_prefixes(spark):
    from tapeworks.llm.op5_preference import preferences, same_openings, stale_replies

    turns = [("p", "chosen", 0, "user", "q"), ("p", "rejected", 0, "user", "q"), ("p", "chosen", 1, "assistant", "good"), ("p", "rejected", 1, "assistant", "bad"), ("p", "chosen", 2, "user", "more"),
             ("same", "chosen", 0, "user", None), ("same", "rejected", 0, "user", ""), ("short", "chosen", 0, None, "a"), ("short", "chosen", 1, "assistant", "b"), ("short", "rejected", 0, None, "a"),
             ("alone", "chosen", 0, "user", "x"), (None, "chosen", 0, "user", "x"), ("p", "chosen", None, "user", "x"), ("p", "chosen", 0, "user", "q")]
    sides = spark.createDataFrame([(*t, 9) for t in turns], "pair_id string, side string, turn long, role string, text string, part int")
    got = {(r["pair_id"], r["part"], r["turn"]): (r["rendered"], r["loss_from"]) for r in preferences(sides).collect()}
    assert got == {
        ("p", "prompt", 0): ("<|user|>\nq<|end|>\n", None), ("p", "chosen", 1): ("<|assistant|>\ngood<|end|>\n", 14), ("p", "rejected", 1): ("<|assistant|>\nbad<|end|>\n", 14),
        ("p", "chosen", 2): ("<|user|>\nmore<|end|>\n", None), ("same", "prompt", 0): ("<|user|>\n<|end|>\n", None), ("short", "prompt", 0): ("<|unknown|>\na<|end|>\n", None),
        ("short", "chosen", 1): ("<|assistant|>\nb<|end|>\n", 14), ("alone", "chosen", 0): ("<|user|>\nx<|end|>\n", None)}
    talks = spark.createDataFrame([(c, t, r, x) for c, said in ((1, "uA"), (2, "uAB"), (3, "uAxC"), (4, "v")) for t, (r, x) in enumerate(("user" if s.islower() else "assistant", s * 3) for s in said)], "conv_id long, turn long, role string, text string")
    stale = preferences(stale_replies(talks)).collect()
    assert {(r["pair_id"], r["part"], r["turn"]) for r in stale} == {("stale-2", "prompt", 0), ("stale-2", "prompt", 1), ("stale-2", "chosen", 2), ("stale-2", "rejected", 2),
                                                                     ("stale-3", "prompt", 0), ("stale-3", "prompt", 1), ("stale-3", "prompt", 2), ("stale-3", "chosen", 3), ("stale-3", "rejected", 3)}
    opening = preferences(same_openings(talks)).collect()
    assert {(r["pair_id"], r["part"], r["turn"]) for r in opening} == {("opening-2", "prompt", 0), ("opening-2", "prompt", 1), ("opening-2", "chosen", 2),
                                                                       ("opening-3", "prompt", 0), ("opening-3", "prompt", 1), ("opening-3", "chosen", 2), ("opening-3", "chosen", 3)}
    assert preferences(sides.where("false")).count() == 0 and stale_replies(talks.where("false")).count() == 0


def test_pipeline_stages(spark, odd, labels, tmp_path):
    """Each stage on its own input: decisions take effect, columns stay, brute-force verdicts agree."""
    import corpus_pipeline as cp
    from test_text_operators import brute_op4, brute_op9, rows_of

    docs = spark.read.parquet(f"{FIXTURE}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        stage(spark, docs, FIXTURE).write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        assert kept.columns == list(cp.COLUMNS)
        before, after = dict(rows_of(docs)), dict(rows_of(kept))
        if name == "ngram_jaccard_join":
            assert set(after) == {c for _, _, c in brute_op9(list(before.items()), 5, 80)}
        if name == "substring_dedup":
            assert {i: words(t) for i, t in after.items()} == {i: t.split(" ") for i, n, gone, t in brute_op4(list(before.items())) if n > gone or not gone}
        else:
            assert set(after) <= set(before) and all(before[i] == t for i, t in after.items())
        docs = kept
    assert cp.STAGES[-1][1](spark, docs, FIXTURE).count() == docs.count()
    for name, stage in cp.STAGES:
        stage(spark, odd, FIXTURE).count(), stage(spark, odd.where("false"), FIXTURE).count()


def test_pipeline_run(spark):
    import corpus_pipeline as cp

    assert 0 < cp.run(spark, FIXTURE).count() < 200 and [n for n, _ in cp.STAGES][-1] == "mixing"
