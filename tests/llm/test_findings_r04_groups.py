"""Finding 1 of the fourth review: large candidate groups of op9 send each set to a bounded number of tasks."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeworks.llm import op9_jaccard as J


def near(a, b, num, den):
    return den * min(a, b) >= num * max(a, b)


@pytest.mark.parametrize("num,den", [(90, 100), (80, 100), (1, 2), (1, 1)])
def test_f1_sizes_of_partners_lie_in_adjoining_bands(spark, num, den):
    t, sizes = J.Threshold(num, den), range(1, 400)
    band = {r.n: r.b for r in spark.range(1, 400).select(F.col("id").alias("n"), t.band(F.col("id")).alias("b")).collect()}
    assert all(abs(band[a] - band[b]) <= 1 for a in sizes for b in sizes if near(a, b, num, den))


def test_f1_pairs_of_like_size_meet_once_and_sets_are_sent_a_bounded_number_of_times(spark, monkeypatch):
    """Before, every block of a group met every other one: a set was sent as often as the group had blocks."""
    monkeypatch.setattr(J, "BLOCK", 4)
    monkeypatch.setattr(J, "PARTS", 3)
    t = J.Threshold(90, 100)
    size = {i: 10 + i % 60 * 4 for i in range(600)} | {i: 50 for i in range(600, 603)}
    group = spark.createDataFrame([(i, 7 if i < 600 else 9) for i in size], "doc_id long, group long")
    rows = J._placed(group, spark.createDataFrame(list(size.items()), "doc_id long, n long"), t).collect()
    tasks = {}
    for r in rows:
        tasks.setdefault((r["group"], r.lo, r.hi), []).append((r.doc_id, r.i))
    met = [tuple(sorted((a, b))) for (_, lo, hi), held in tasks.items() for x, (a, i) in enumerate(held) for b, j in held[x + 1:] if lo == hi or i != j]
    assert len(met) == len(set(met))
    like = {(a, b) for a in size for b in size if a < b and (a < 600) == (b < 600) and near(size[a], size[b], 90, 100)}
    assert like <= set(met)
    sent = np.bincount([r.doc_id for r in rows])
    assert sent[:600].max() <= 3 * 3 and (sent[600:] == 1).all()


def test_f1_pieces_of_blocks_meet_once(monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 3)
    side = np.array([False, True] * 5)
    for same, rows in ((True, np.zeros(10, bool)), (False, side)):
        pairs = [(int(p), int(q)) for x, y in J._pairs_of(rows, same) for p in x for q in y if x is not y or p < q]
        want = {(p, q) for p in range(10) for q in range(10) if (p < q if same else not side[p] and side[q])}
        assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_f1_forests_of_pieces_are_merged():
    root = np.arange(5)
    assert J._merged([(0, 1), (1, 2)], root) == [(0, 1), (1, 2)]
    assert J._merged([(0, 2), (3, 4), (2, 3), (1, 4)], root) == [(3, 4), (2, 3)]


def test_f1_links_of_a_group_of_many_sizes(spark, monkeypatch):
    """Texts that share rare words in a chain of sizes: one group, more than a block, over several bands."""
    monkeypatch.setattr(J, "BLOCK", 4)
    monkeypatch.setattr(J, "PARTS", 2)
    words = [f"w{i}" for i in range(80)]
    docs = {i: words[:20 + 2 * i] for i in range(30)} | {i: [*words[:18 + 2 * (i - 30)], f"x{i}"] for i in range(30, 60)}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    sets = {i: {tuple(w[x:x + 3]) for x in range(len(w) - 2)} for i, w in docs.items()}
    links = {a: {b for b in sets if a != b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])} for a in sets}
    least = {i: i for i in sets}
    for _ in sets:
        least = {i: min([least[i], *(least[j] for j in links[i])]) for i in sets}
    got = {r.doc_id: (r.component_id, r.n_links) for r in J.jaccard_join(df, 3, 90, 100).collect()}
    assert got == {i: (least[i], len(links[i])) for i in sets}


def test_f1_rows_that_share_a_doc_id_are_placed_once_for_each_size(spark):
    """Such a row must not be taken as often as the id has rows."""
    group = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, group long")
    left = spark.createDataFrame([(1, 30), (1, 30), (1, 70), (2, 30)], "doc_id long, n long")
    assert sorted((r.doc_id, r.n) for r in J._placed(group, left, J.Threshold(90, 100)).collect()) == [(1, 30), (1, 70), (2, 30)]
