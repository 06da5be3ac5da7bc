"""Operators on words and bytes against brute force over whole texts."""
import hashlib
from collections import Counter, defaultdict

import pytest
from conftest_llm import FIXTURE, lower, words
from pyspark.sql import functions as F

LAST = 1 << 62


def documents(spark):
    return spark.read.parquet(f"{FIXTURE}/documents.parquet")


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def brute_op4(rows, window=13):
    least = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            g = tuple(w[k:k + window])
            least[g] = min(least.get(g, LAST), LAST if i is None else i)
    out = []
    for i, t in rows:
        w, gone = words(t), set()
        for k in range(len(w) - window + 1):
            if least[tuple(w[k:k + window])] < (LAST if i is None else i):
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def brute_op2(rows, depth=400):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[k:k + depth] for k in range(len(b) - depth + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - depth + 1):
            if seen[b[k:k + depth]] > 1:
                gone[k:k + depth] = b"\1" * depth
        out.append((i, len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def brute_op9(rows, k, num):
    sets = {}
    for n, (i, t) in enumerate(rows):
        w = words(lower(t))
        s = {tuple(w[a:a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}
        sets[n] = (i, frozenset(s))
    comp = {i: i for i, _ in sets.values() if i is not None}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x
    holders = defaultdict(list)
    for n, (i, s) in sets.items():
        if i is not None:
            for g in s:
                holders[g].append(n)
    for n, (i, s) in sets.items():
        if i is None:
            continue
        both = Counter(m for g in s for m in holders[g] if m > n)
        for m, c in both.items():
            if 100 * c >= num * (len(s) + len(sets[m][1]) - c):
                a, b = find(i), find(sets[m][0])
                comp[max(a, b)] = min(a, b)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets.values()), key=repr)


@pytest.mark.parametrize("table", ["odd", "given", "none"])
def test_op4_whole_texts(spark, odd, none, table):
    from tapeworks.llm.op4_substring import remove_repeats

    docs = {"odd": odd, "none": none, "given": documents(spark)}[table]
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in remove_repeats(docs).collect()), key=repr)
    assert got == brute_op4(rows_of(docs))


def test_op4_spacing_and_spans(spark):
    from tapeworks.llm.op4_substring import remove_repeats

    run = " ".join(f"r{i}" for i in range(13))
    docs = spark.createDataFrame([(1, run), (2, f"a\n b  {run}\t c\n"), (3, "kept  as\tis ")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in remove_repeats(docs, spacing=True).collect()}
    assert got[1]["kept_text"] == run and got[3]["kept_text"] == "kept  as\tis "
    assert got[2]["kept_text"] == "a\n b  c\n" and [tuple(s) for s in got[2]["spans"]] == [(2, 14)]


@pytest.mark.parametrize("table", ["odd", "given", "none"])
def test_op2_whole_texts(spark, odd, none, table):
    from tapeworks.llm.op2_suffix import remove_repeats

    more = spark.createDataFrame([(100 + k, t) for k, t in enumerate(["a" * 1000, "ab" * 700, "abc" * 500 + "x" * 399, "x" * 399, "xyz" * 133 + "q", "xyz" * 134])], "doc_id long, text string")
    docs = {"odd": odd.select("doc_id", "text").unionByName(more), "none": none, "given": documents(spark).where("length(text) < 4000")}[table]
    out = remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256))
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute_op2(rows_of(docs))


@pytest.mark.parametrize("table,k,num", [("odd", 3, 90), ("given", 3, 90), ("given", 5, 80), ("none", 3, 90)])
def test_op9_components(spark, odd, none, table, k, num):
    from tapeworks.llm.op9_jaccard import jaccard_join

    docs = {"odd": odd, "none": none, "given": documents(spark)}[table]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join(docs, k, num, 100).collect()), key=repr)
    assert got == brute_op9(rows_of(docs), k, num)


def test_op9_large_group_in_blocks(spark, monkeypatch):
    """A group of near copies larger than a block, with a chain that only pairs across blocks complete."""
    from tapeworks.llm import op9_jaccard

    monkeypatch.setattr(op9_jaccard, "BLOCK", 8)
    base = [f"t{i}" for i in range(120)]
    rows = [(n, " ".join([*base[n // 2:], *(f"x{j}" for j in range(n // 2))])) for n in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in op9_jaccard.jaccard_join(docs, 3, 90, 100).collect()), key=repr)
    assert got == brute_op9(rows, 3, 90)


@pytest.mark.parametrize("shared", [1, 2, 4095, 4096, 4097, 8192, 8193])
def test_op9_overlap_counts_every_token(shared):
    """Sets that share a number of tokens at and beside the edges of the pieces."""
    import numpy as np

    from tapeworks.llm.op9_jaccard import _overlap

    sets = [set(range(shared)) | {10**6}, set(range(shared)) | {10**6 + 1}, {10**6 + 2}]
    got = _overlap([np.array(sorted(s), np.uint64) for s in sets])
    assert got.tolist() == [[len(a & b) for b in sets] for a in sets]


@pytest.mark.parametrize("k, num, sizes", [(3, 90, (11, 12)), (5, 80, (8, 9)), (3, 90, (4099, 4100)), (3, 90, (4098, 4099))])
def test_op9_pair_alone_in_its_group(spark, k, num, sizes):
    """Two documents of which one is the other and a word more, without others that share a shingle with them."""
    from tapeworks.llm.op9_jaccard import jaccard_join

    rows = [(n, " ".join(f"w{i}" for i in range(size))) for n, size in enumerate(sizes)] + [(9, "no shingle of these three")]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), k, num, 100).collect())
    assert got == brute_op9(rows, k, num) and got[1][2] == 0


def test_op1_statistics_and_verdicts(spark, odd, none):
    from tapeworks.llm.op1_outliers import quality

    for docs in (odd, documents(spark)):
        for r in quality(docs, least=20).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
            w, t = words(r["text"]), r["text"] or ""
            seen = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
            cover = {j for i in range(len(w) - 7) if seen[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
            lines = [x for x in t.split("\n") if words(x)]
            assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t))
            assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(cover))
            assert r["base_failed"] == (len(w) < 20 or 100 * len(cover) > 30 * len(w)) and not (r["base_failed"] and r["kept"])
    assert quality(none).count() == 0


def test_op1_distances_match_numpy(spark):
    """The concentration steps again, in numpy, on the same vectors."""
    import numpy as np

    from tapeworks.llm import op1_outliers as o

    o.ensure_checkpoint_dir(spark)
    rows = o.vectors(o.statistics(documents(spark).select("doc_id", "lang", "source", "text")).checkpoint(), 20)
    good = rows.where(f"NOT ({o.BASE_FAILED}) AND grp IS NOT NULL").toPandas()
    got = {r["doc_id"]: r["distance"] for r in o.quality(documents(spark), least=20).collect()}
    for _, g in good.groupby("grp"):
        x = g[[f"q{i}" for i in range(o.D)]].to_numpy() / o.SCALE
        low, mid, high = np.percentile(x, (25, 50, 75), axis=0)
        mean, cov = mid, np.diag(np.maximum((high - low) / 1.349, o.FLOOR) ** 2)
        distance = lambda: np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)  # noqa: B023, E731
        for _step in range(o.STEPS):
            bins = np.floor(8 * np.log2(distance() + 1e-6))
            upto = np.sort(bins)[int(np.ceil(o.SHARE * len(x))) - 1]
            sub = x[bins <= upto]
            mean, cov = sub.mean(0), o.CONSISTENCY * np.cov(sub.T, bias=True) + np.diag(np.square(o.FLOOR))
        sub = x[distance() <= o.CORE]
        mean, cov = sub.mean(0), np.cov(sub.T, bias=True) + np.diag(np.square(o.FLOOR))
        np.testing.assert_allclose([got[i] for i in g.doc_id], distance(), rtol=1e-6, atol=1e-9)


def test_op8_containment(spark, odd, none):
    from tapeworks.llm.op8_contain import contained, size_class

    assert [size_class(n) for n in (1, 4, 5, 7, 9, 13, 17, 30)] == [4, 4, 6, 8, 12, 16, 24, 32]
    items = spark.createDataFrame([(1, " ".join(f"w{i % 977}x{i % 13}" for i in range(40, 90))), (2, "one two"), (3, None), (4, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (4, "Same LINE again and again same line again and again")], "item_id long, text string")

    def brute(docs):
        grams = lambda t: {tuple(w[i:i + 5]) for w in [words(lower(t))] for i in range(len(w) - 4)}
        own = [(i, grams(t)) for i, t in rows_of(docs)]
        return sorted(((d, r["item_id"], len(s & g) / len(s)) for r in items.collect() if (s := grams(r["text"])) for d, g in own if len(s & g) >= 0.8 * len(s)), key=repr)

    for most in (1_000_000, 10):
        assert sorted((tuple(r) for r in contained(odd, items, most_shingles=most).collect()), key=repr) == brute(odd)
    assert contained(none, items).count() == 0 and contained(odd, items.where("false")).count() == 0


def test_op8_short_items(spark):
    """Items of one to three shingles are found wherever they stand: first, last or inside long documents."""
    from tapeworks.llm.op8_contain import contained

    filler = [[f"f{(i * 31 + d) % 1999}" for i in range(400)] for d in range(200)]
    items = [(n, [f"item{n}w{i}" for i in range(4 + n)]) for n in (1, 2, 3)]
    docs, want = [], set()
    for d, words_ in enumerate(filler):
        item_id, text = items[d % 3]
        at = (0, len(words_), d * 2)[d // 3 % 3]
        docs.append((d, " ".join(words_[:at] + text + words_[at:]), d % 7))
        want.add((d, item_id, 1.0, d % 7))
    docs.append((900, " ".join(items[2][1][:-1]), 1))  # two of three shingles
    got = contained(spark.createDataFrame(docs, "doc_id long, text string, row long"), spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string"), carry=("row",))
    assert {tuple(r) for r in got.collect()} == want
