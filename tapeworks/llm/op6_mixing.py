"""Soft-membership mixing, in DataFrame operations only.

A naive Bayes classifier over hashed words is fitted on a bounded sample of labelled documents (about ``most`` of each domain at
most) and gives every document a posterior over the domains, tempered to minimize the sample's log loss. A document of n words
with rate r is expected to give r * n * posterior words to each domain. Non-negative rates are fitted by projected gradient
descent from the even rate to the least squares of expected against target words; the gradient is scaled by the second moments
of the posteriors of documents with a positive rate, as weighted by words, so few iterations do. Documents whose posteriors
round to one multiple of 1 / STEPS form a cell and share a rate; a cell carries the word-weighted sums of their unrounded
posteriors, so the totals fitted are those of the posteriors as returned. Each iteration is a sum over the cells, and the driver
holds only the domains' sums.

Null and empty texts have no words, the prior as posterior and the rate that belongs to it; without labelled rows every domain is
equally likely. Domains with a target that no document leads to stay short of it. Repeated rows get equal rates; an empty table
gives an empty result. Further columns are carried if named.
"""
from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.learning import sample
from tapeworks.llm.op1_outliers import let
from tapeworks.session import ensure_checkpoint_dir

BUCKETS, STEPS, RIDGE, ITERATIONS, CLOSE = 16_384, 64, 0.05, 24, 1e-4
TEMPERATURES = (0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0)
#: target share of words and the rule of each domain, over the labels' columns
DOMAINS = {"clean": (0.85, "toxic = 0 AND quality = 1"), "junk": (0.1, "toxic = 0 AND quality = 0"), "toxic": (0.05, "toxic = 1")}


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


class Classifier:
    """Word weights of each domain against the first, and priors."""

    def __init__(self, domains: list[str], weights: list[list[float]], priors: list[float], temperature: float = 1.0):
        self.domains, self.weights, self.priors, self.temperature = domains, weights, priors, temperature

    def evidence(self, text: Column) -> Column:
        """Number of words and, for each domain after the first, the mean of its word weights times the root of that number."""
        tables = [F.split(F.lit(",".join(f"{x:.4f}" for x in w)), ",").cast("array<double>") for w in self.weights]

        def summed(buckets: Column, table: Column) -> Column:
            return F.aggregate(buckets, F.lit(0.0), lambda a, b: a + F.get(table, b))

        def scored(buckets: Column) -> Column:
            n = F.size(buckets)
            return F.struct(n.cast("long").alias("n_words"), *[(summed(buckets, t) / F.sqrt(F.greatest(n, F.lit(1)))).alias(f"e{i + 1}") for i, t in enumerate(tables)])
        return let(F.transform(_words(text), _bucket), scored)

    def posterior(self, temperature: float) -> list[Column]:
        logit = [F.lit(math.log(self.priors[0]))] + [F.col(f"e{i}") / temperature + math.log(self.priors[i]) for i in range(1, len(self.domains))]
        top = F.greatest(*logit)
        parts = [F.exp(x - top) for x in logit]
        return [p / reduce(lambda a, b: a + b, parts) for p in parts]


def fit(docs: DataFrame, labels: DataFrame, domains: dict[str, tuple[float, str]] = DOMAINS, most: int = 3000) -> Classifier:
    names = list(domains)
    rule = reduce(lambda a, x: a.when(F.expr(domains[x[1]][1]), F.lit(x[0])), list(enumerate(names))[1:], F.when(F.expr(domains[names[0]][1]), F.lit(0)))
    known = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")).select("doc_id", rule.alias("domain")).where("domain IS NOT NULL")
    labelled = known.join(docs.where("text IS NOT NULL").select("doc_id"), "doc_id").select("doc_id", "domain").checkpoint()
    picked = sample(labelled, "domain", most)  # ids only, bounded by ``most`` and the number of domains, so texts needn't move
    drawn = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("domain", "text").checkpoint()
    counts = drawn.select("domain", F.explode(F.transform(_words(F.col("text")), _bucket)).alias("bucket")).groupBy("domain", "bucket").agg(F.count("*").alias("n")).collect()
    size = {r["domain"]: r["n"] for r in labelled.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    total = [sum(r["n"] for r in counts if r["domain"] == d) for d in range(len(names))]
    log = [[math.log(1 / (t + BUCKETS))] * BUCKETS for t in total]
    for r in counts:
        log[r["domain"]][r["bucket"]] = math.log((r["n"] + 1) / (total[r["domain"]] + BUCKETS))
    weights = [[x - y for x, y in zip(log[d], log[0])] for d in range(1, len(names))]
    rows = sum(size.values())
    out = Classifier(names, weights, [(size.get(d, 0) + 1) / (rows + len(names)) for d in range(len(names))])
    if rows:
        scored = drawn.select("domain", out.evidence(F.col("text")).alias("e")).select("domain", "e.*").checkpoint()
        losses = []
        for i, t in enumerate(TEMPERATURES):
            p = out.posterior(t)
            own = reduce(lambda a, d: a.when(F.col("domain") == d, p[d]), range(1, len(names)), F.when(F.col("domain") == 0, p[0]))
            losses.append(F.avg(-F.log(F.greatest(own, F.lit(1e-12)))).alias(f"t{i}"))
        got = scored.agg(*losses).first()
        out.temperature = min(zip(got, TEMPERATURES))[1]
    return out


def memberships(docs: DataFrame, model: Classifier, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the carried columns, n_words and the posteriors p0.."""
    scored = docs.select("doc_id", *carry, model.evidence(F.col("text")).alias("e")).select("doc_id", *carry, "e.*")
    return scored.select("doc_id", *carry, "n_words", *[x.alias(f"p{i}") for i, x in enumerate(model.posterior(model.temperature))])


def _cell(k: int) -> list[Column]:
    """The posteriors p0.. in steps of 1 / STEPS; the first has what the others leave."""
    steps = [F.floor(F.col(f"p{i}") * STEPS + 0.5) / STEPS for i in range(1, k)]
    return [F.greatest(reduce(lambda a, b: a - b, steps, F.lit(1.0)), F.lit(0.0)), *steps]


def _solve(matrix: list[list[float]], right: list[float]) -> list[float]:
    """Solution of a small symmetric positive system."""
    rows = [[*m, r] for m, r in zip(matrix, right)]
    for i, pivot in enumerate(rows):
        for row in rows[i + 1:]:
            f = row[i] / pivot[i]
            row[i:] = [x - f * y for x, y in zip(row[i:], pivot[i:])]
    out = [0.0] * len(rows)
    for i in reversed(range(len(rows))):
        out[i] = (rows[i][-1] - sum(rows[i][j] * out[j] for j in range(i + 1, len(rows)))) / rows[i][i]
    return out


def rates(members: DataFrame, shares: list[float], budget: float) -> Column:
    """The fitted rate as an expression over p0... budget: target words over all words of the table."""
    k = len(shares)
    p = [F.col(f"p{i}") for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    n = F.col("n_words").cast("double")
    cells = members.where("n_words > 0").groupBy(*[c.alias(f"c{i}") for i, c in enumerate(_cell(k))]).agg(
        F.sum(n).alias("n"), *[F.sum(n * x).alias(f"s{i}") for i, x in enumerate(p)], *[F.sum(n * p[i] * p[j]).alias(f"m{i}{j}") for i, j in pairs]).coalesce(1).checkpoint()

    def rate(at: list[Column], moves: list[list[float]]) -> Column:
        return reduce(lambda r, w: F.greatest(F.lit(0.0), r - reduce(lambda a, b: a + b, [x * y for x, y in zip(at, w)])), moves, F.lit(float(budget)))

    moves, before = [], None
    for _ in range(ITERATIONS):
        held = cells.withColumn("rate", rate([F.col(f"c{i}") for i in range(k)], moves)).withColumn("live", (F.col("rate") > 0).cast("double"))
        got = held.agg(F.sum("n"), *[F.sum(F.col("rate") * F.col(f"s{i}")) for i in range(k)], *[F.sum(F.col("live") * F.col(f"m{i}{j}")) for i, j in pairs]).first()
        words = got[0] or 1.0
        gap = [(x or 0.0) / words - s * budget for x, s in zip(got[1:k + 1], shares)]
        if max(abs(g) for g in gap) < CLOSE * budget or before and max(abs(g - b) for g, b in zip(gap, before)) < CLOSE * budget / 10:
            break  # at the targets, or at the nearest point to them
        before = gap
        moment = {ij: (x or 0.0) / words for ij, x in zip(pairs, got[k + 1:])}
        full = [[moment[max(i, j), min(i, j)] + (RIDGE * max(moment[i, i], 1e-4) if i == j else 0.0) for j in range(k)] for i in range(k)]
        moves.append(_solve(full, gap))
    return rate(_cell(k), moves)


def mix(docs: DataFrame, labels: DataFrame, domains: dict[str, tuple[float, str]] = DOMAINS, budget: float = 0.5, most: int = 3000, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the carried columns, n_words, a posterior column p_<domain> for each domain, and rate."""
    ensure_checkpoint_dir(docs.sparkSession)
    members = memberships(docs, fit(docs, labels, domains, most), carry).checkpoint()
    rate = rates(members, [share for share, _ in domains.values()], budget)
    return members.select("doc_id", *carry, "n_words", *[F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(domains)], rate.alias("rate"))
