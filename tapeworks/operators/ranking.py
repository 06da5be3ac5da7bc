"""Learning to rank: trees boosted on pairwise gradients, without a task that holds a query group.

Two rows of one group with different grades form a pair; its loss is the logistic loss of their score difference. A row's gradient
is a sum over its group's rows of other grades, which the grades and scores of the group determine, so rows are first counted by
(group, grade, score cell): scores lie on a grid of ``CELL``, so a group has a bounded number of cells however many rows it has.
Cells of a group meet each other, rows look their cell's gradient up, and the splits of a level come from one histogram of
gradients by (node, feature, bin). Only histograms, bin edges and the trees reach the driver; their size is features times bins.
"""
from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.plans.panel import join_on
from tapeworks.session import ensure_checkpoint_dir

CELL, REACH, SMALL = 1 / 16, 4.0, 200_000


def score_cell(score: Column) -> Column:
    """The grid cell of a score; beyond ``REACH`` all scores share the outermost cells, where the logistic gradient is flat."""
    return F.round(F.greatest(F.least(score, F.lit(REACH)), F.lit(-REACH)) / CELL).cast("int")


def pair_gradients(rows: DataFrame, group: Sequence[str], grade: str = "grade", score: str = "score") -> DataFrame:
    """(group, grade, cell, g, h): first and second derivative of the mean pairwise loss of a group by a row's score in that cell."""
    keys = list(group)
    cells = rows.groupBy(*keys, grade, score_cell(F.col(score)).alias("cell")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    other = cells.select(*[F.col(k).alias(f"o_{k}") for k in keys], F.col(grade).alias("o_grade"), F.col("cell").alias("o_cell"), F.col("n").alias("o_n"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"o_{k}"))
    p = 1 / (1 + F.exp((F.col("cell") - F.col("o_cell")) * F.lit(CELL) * F.signum(F.col(grade) - F.col("o_grade"))))
    met = cells.join(other, on & (F.col(grade) != F.col("o_grade")))
    total = F.sum("n").over(Window.partitionBy(*keys)) if keys else F.sum("n").over(Window.partitionBy(F.lit(0)))
    g = met.groupBy(*keys, grade, "cell", "n").agg(F.sum(-F.signum(F.col(grade) - F.col("o_grade")) * p * F.col("o_n")).alias("g"), F.sum(p * (1 - p) * F.col("o_n")).alias("h"))
    return g.withColumn("_t", total).select(*keys, grade, "cell", (F.col("g") / F.col("_t")).alias("g"), (F.col("h") / F.col("_t")).alias("h"))


@dataclass
class PairwiseRanker:
    """Boosted regression trees for a ranking objective; ``fit`` then ``transform`` (adds ``score``), or ``save`` and ``load`` as JSON text."""

    features: Sequence[str]
    group: Sequence[str]
    grade: str = "grade"
    rounds: int = 5
    depth: int = 3
    bins: int = 32
    rate: float = 0.3
    ridge: float = 1.0
    edges: list[list[float]] = field(default_factory=list)
    trees: list[dict] = field(default_factory=list)

    def fit(self, df: DataFrame) -> "PairwiseRanker":
        """Rows without a grade are left out of the fit; a missing feature counts as below all edges."""
        ensure_checkpoint_dir(df.sparkSession)
        d = df.where(F.col(self.grade).isNotNull())
        probs = [i / self.bins for i in range(1, self.bins)]
        got = d.select(*[F.percentile_approx(F.col(c).cast("double"), probs, 10_000).alias(c) for c in self.features]).first()
        self.edges = [sorted(set(got[c] or [])) for c in self.features]
        self.trees = []
        d = d.select(*self.group, F.col(self.grade).cast("double").alias("grade"), self._binned().alias("bins"), F.lit(0.0).alias("score")).checkpoint()
        for _ in range(self.rounds):
            cells = pair_gradients(d, self.group).withColumnRenamed("cell", "_c").checkpoint()
            if cells.count() <= SMALL:
                cells = F.broadcast(cells)
            with_g = join_on(d.withColumn("_c", score_cell(F.col("score"))), cells, [*self.group, "grade", "_c"], "left").drop("_c").checkpoint()
            tree = self._grow(with_g)
            self.trees.append(tree)
            d = with_g.withColumn("score", F.col("score") + self._value(tree)).select(*self.group, "grade", "bins", "score")
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        d = df.withColumn("bins", self._binned())
        return d.withColumn("score", sum((self._value(t) for t in self.trees), F.lit(0.0))).drop("bins")

    def to_json(self) -> str:
        return json.dumps({k: list(v) if isinstance(v, (list, tuple)) else v for k, v in self.__dict__.items()})

    @classmethod
    def from_json(cls, text: str) -> "PairwiseRanker":
        return cls(**json.loads(text))

    def _binned(self) -> Column:
        one = lambda c, e: F.size(F.filter(F.array(*[F.lit(float(x)) for x in e]), lambda x: x < F.col(c).cast("double"))) if e else F.lit(0)
        return F.array(*[F.coalesce(one(c, e), F.lit(0)) for c, e in zip(self.features, self.edges)])

    def _grow(self, d: DataFrame) -> dict:
        """A tree as {"split": (feature, bin)} or {"leaf": value} by node number; children of n are 2n and 2n + 1."""
        tree: dict = {}
        open_nodes, node = [1], F.lit(1)
        for level in range(self.depth + 1):
            rows = d.withColumn("node", node).where(F.col("node").isin(open_nodes)).select("node", F.posexplode("bins").alias("f", "b"), F.coalesce("g", F.lit(0.0)).alias("g"), F.coalesce("h", F.lit(0.0)).alias("h"))
            hist = {n: np.zeros((len(self.features), self.bins + 1, 2)) for n in open_nodes}
            for r in rows.groupBy("node", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():  # nodes x features x bins
                hist[r["node"]][r["f"], r["b"]] = r["g"], r["h"]
            nxt = []
            for n in open_nodes:
                split = best_split(hist[n], self.ridge) if level < self.depth else None
                total = hist[n][0].sum(0)
                if split is None:
                    tree[n] = {"leaf": float(-self.rate * total[0] / (total[1] + self.ridge))}
                else:
                    tree[n] = {"split": split}
                    nxt += [2 * n, 2 * n + 1]
            if not nxt:
                break
            cases = None
            for n in open_nodes:
                if "split" in tree[n]:
                    f, b = tree[n]["split"]
                    to = F.when(F.element_at("bins", f + 1) <= b, 2 * n).otherwise(2 * n + 1)
                    cases = F.when(F.col("node") == n, to) if cases is None else cases.when(F.col("node") == n, to)
            d, open_nodes = d.withColumn("node", node).withColumn("_n", cases).drop("node"), nxt
            d, node = d.withColumnRenamed("_n", f"node_{level}"), F.col(f"node_{level}")
        return {str(k): v for k, v in tree.items()}

    def _value(self, tree: dict, n: int = 1) -> Column:
        at = tree[str(n)]
        if "leaf" in at:
            return F.lit(at["leaf"])
        f, b = at["split"]
        return F.when(F.element_at("bins", f + 1) <= b, self._value(tree, 2 * n)).otherwise(self._value(tree, 2 * n + 1))


def best_split(hist: np.ndarray, ridge: float) -> tuple[int, int] | None:
    """(feature, last bin to the left) of the greatest gain of sums (feature, bin, g and h), ties to the first; None without gain."""
    left = np.cumsum(hist, 1)[:, :-1]
    whole = hist[0].sum(0)
    right = whole - left
    gain = left[..., 0] ** 2 / (left[..., 1] + ridge) + right[..., 0] ** 2 / (right[..., 1] + ridge) - whole[0] ** 2 / (whole[1] + ridge)
    best = int(np.round(gain, 12).argmax())
    return (best // gain.shape[1], best % gain.shape[1]) if gain.ravel()[best] > 1e-9 else None


def ndcg(df: DataFrame, group: Sequence[str], score: str = "score", grade: str = "grade", k: int = 10, tie: Sequence[str] = ()) -> DataFrame:
    """(group, n, ndcg): normalized discounted gain of the k best-scored rows; 0 where a group has no positive grade.

    Both top lists are rank-limited windows, which Spark cuts to k rows a group before the shuffle, so a hot group is k rows a task.
    """
    gain = (F.pow(F.lit(2.0), F.col("_y")) - 1) / F.log2(F.col("_r") + 1.0)
    d = df.select(*group, F.col(grade).cast("double").alias("_y"), F.col(score).alias("_s"), *tie).where(F.col("_y").isNotNull())

    def top(order: list[Column], name: str) -> DataFrame:
        w = Window.partitionBy(*group).orderBy(*order)
        return d.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).groupBy(*group).agg(F.sum(gain).alias(name))

    got, ideal = top([F.col("_s").desc(), *[F.col(t) for t in tie]], "_got"), top([F.col("_y").desc()], "_ideal")
    both = join_on(join_on(d.groupBy(*group).agg(F.count(F.lit(1)).alias("n")), got, group), ideal, group)
    return both.select(*group, "n", F.when(F.col("_ideal") > 0, F.col("_got") / F.col("_ideal")).otherwise(0.0).alias("ndcg"))
