"""Mixing sources to target weights by soft membership.

A naive-Bayes classifier over hashed words, fitted on a bounded sample of the labelled table, gives every document a
posterior over the domains. Document i of n_i words then brings r_i p_id n_i words of domain d, and the rates r >= low
are fitted so that the expected totals match the targets: projected gradient steps on

    1/2 (A r - t)' M (A r - t),   A[d, i] = p_id n_i,   M = (B B' + ridge)^-1,

B being the columns of A whose rates a step can still move (a step of 1 would solve the problem if no bound were met).
A step needs sums over the documents by domain and pair of domains; the rates are a function of the few steps so far, so
that no state is kept by document. All of it is DataFrame expressions and plain arithmetic on matrices of domains x domains.

Null and empty texts have no words: their posterior is the prior, their rate is 1 (or the nearer bound). A domain
without labelled rows can't be fitted and must not have a target; without any labelled row, posteriors are empty and all
rates 1.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import sampled, stored

FEATURES = 4096
#: A miss that is worth a warning.
ALLOWED = 0.001


def features(text: Column) -> Column:
    """Hashed lower-case words, with repeats: array<int> of 0 .. FEATURES-1."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w).bitwiseAND(FEATURES - 1).cast("int"))


@dataclass
class DomainModel:
    """log_prior by domain; log_word: by feature, one value for each domain, end to end."""

    domains: list[str]
    log_prior: list[float]
    log_word: list[list[float]]


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 4000, smooth: float = 0.5, seed: int = 17) -> DomainModel:
    """labels: doc_id, domain (string). About max_docs labelled documents of each domain are used, chosen by hash;
    the prior is over all labels. An id with several domains has the smallest; null ids and domains are left out."""
    marks = labels.select("doc_id", "domain").dropna().groupBy("doc_id").agg(F.min("domain").alias("domain"))
    n = {r["domain"]: r["n"] for r in marks.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    domains = sorted(n)
    if not domains:
        return DomainModel([], [], [])
    share = F.element_at(F.create_map(*[x for d in domains for x in (F.lit(d), F.lit(max_docs / n[d]))]), F.col("domain"))
    picked = F.broadcast(marks.filter(sampled(F.col("doc_id"), share, seed)))  # about max_docs ids a domain
    words = docs.select("doc_id", "text").join(picked, "doc_id").select("domain", F.explode(F.array_distinct(features(F.col("text")))).alias("f"))
    seen = {(r["domain"], r["f"]): r["n"] for r in words.groupBy("domain", "f").agg(F.count("*").alias("n")).collect()}
    log_word = []
    total = {d: sum(seen.get((d, f), 0) for f in range(FEATURES)) + smooth * FEATURES for d in domains}
    every = sum(n.values())
    for f in range(FEATURES):
        log_word.append([log((seen.get((d, f), 0) + smooth) / total[d]) for d in domains])
    return DomainModel(domains, [log(n[d] / every) for d in domains], log_word)


def memberships(docs: DataFrame, model: DomainModel, strength: float = 50.0) -> DataFrame:
    """docs with n_words and posterior (array<double> by domain). A text's mean log likelihood by word counts
    `strength` times at most, since its words aren't independent."""
    k = len(model.domains)
    wide = docs.withColumn("_f", features(F.col("text"))).withColumn("n_words", F.size("_f").cast("long")).withColumn("_d", F.array_distinct("_f"))
    n = F.greatest(F.size("_d"), F.lit(1))
    if not k:
        return wide.withColumn("posterior", F.array().cast("array<double>")).drop("_f", "_d")

    def log_likelihood(d: int) -> Column:
        # a constant array of FEATURES numbers, folded when the plan is made
        table = F.split(F.lit(",".join(repr(row[d]) for row in model.log_word)), ",").cast("array<double>")
        total = F.aggregate("_d", F.lit(0.0), lambda s, f: s + F.get(table, f))
        return F.lit(model.log_prior[d]) + F.least(F.lit(strength), n) / n * total

    logs = [log_likelihood(d) for d in range(k)]
    wide = wide.withColumn("_l", F.array(*logs)).withColumn("_e", F.transform("_l", lambda x: F.exp(x - F.array_max("_l"))))
    total = F.aggregate("_e", F.lit(0.0), lambda s, x: s + x)
    return wide.withColumn("posterior", F.transform("_e", lambda x: x / total)).drop("_f", "_d", "_l", "_e")


def solved(matrix: list[list[float]], right: list[float]) -> list[float]:
    """Gaussian elimination with pivots, for a matrix of domains x domains."""
    m, n = [[*row, b] for row, b in zip(matrix, right, strict=True)], len(right)
    for c in range(n):
        p = max(range(c, n), key=lambda r: abs(m[r][c]))
        m[c], m[p] = m[p], m[c]
        for r in range(n):
            if r != c and m[c][c]:
                f = m[r][c] / m[c][c]
                m[r] = [x - f * y for x, y in zip(m[r], m[c], strict=True)]
    return [m[r][n] / m[r][r] if m[r][r] else 0.0 for r in range(n)]


@dataclass
class Rates:
    """rate: of each row, as an expression over n_words and posterior; reached: shares of the words by domain; miss: the
    largest difference of an expected total from its goal, as a share of the goals' sum."""

    rate: Column
    reached: dict[str, float]
    miss: float


def fit_rates(members: DataFrame, model: DomainModel, target: dict[str, float], total_words: float | None = None, low: float = 0.0, high: float = 20.0, steps: int = 30, tolerance: float = 1e-6) -> Rates:
    """Rates for members (n_words, posterior), between low and high.

    target: weights by domain, others 0. total_words: of the mixture; by default the number the documents have, or,
    if low is 1 or more, the least that lets every domain keep its expected words. Bounds can put a target out of reach:
    `miss` says by how much.
    """
    k = len(model.domains)
    if unknown := set(target) - set(model.domains):
        raise ValueError(f"no labelled row of {sorted(unknown)}")
    if not k:
        return Rates(F.lit(min(max(1.0, low), high)), {}, 0.0)
    weights = [target.get(d, 0.0) / sum(target.values()) for d in model.domains]
    a = [F.col("posterior")[d] * F.col("n_words") for d in range(k)]
    sums = members.select(*(F.sum(x).alias(f"t{d}") for d, x in enumerate(a)), *(F.sum(a[d] * a[e]).alias(f"m{d}_{e}") for d in range(k) for e in range(k))).first()
    have = [float(sums[f"t{d}"] or 0.0) for d in range(k)]
    total = total_words or (max((h / w for h, w in zip(have, weights, strict=True) if w > 0), default=0.0) if low >= 1 else sum(have))
    goal = [w * total for w in weights]

    def curvature(row) -> list[list[float]]:
        ridge = 1e-9 * max(float(row[f"m{d}_{d}"] or 0.0) for d in range(k)) + 1e-12
        return [[float(row[f"m{d}_{e}"] or 0.0) + ridge * (d == e) for e in range(k)] for d in range(k)]

    gram = curvature(sums)
    moves: list[list[float]] = []
    now, error, best, since = have, 0.0, float("inf"), 0

    def rate() -> Column:
        start = F.lit(min(max(1.0, low), high))
        if not moves:
            return start

        def step(r: Column, move: Column) -> Column:
            change = sum((F.get(move, F.lit(d)) * a[d] for d in range(k)), F.lit(0.0))
            return F.least(F.lit(high), F.greatest(F.lit(low), r - change))

        return F.aggregate(F.array(*(F.array(*map(F.lit, m)) for m in moves)), start, step)

    for step in range(steps + 1):
        rows = members.select(rate().alias("r"), *(x.alias(f"a{d}") for d, x in enumerate(a)))
        sums = rows.agg(*(F.sum(F.col("r") * F.col(f"a{d}")).alias(f"t{d}") for d in range(k))).first()
        now = [float(sums[f"t{d}"] or 0.0) for d in range(k)]
        miss = [x - g for x, g in zip(now, goal, strict=True)]
        error = max(map(abs, miss)) / max(total, 1e-300)
        best, since = (error, 0) if error < 0.999 * best else (best, since + 1)
        if error <= tolerance or step == steps or since == 5:  # reached, or no nearer for some steps
            break
        down = sum((F.col(f"a{d}") * F.lit(m) for d, m in enumerate(solved(gram, miss))), F.lit(0.0))
        free = ~(((F.col("r") <= low) & (down > 0)) | ((F.col("r") >= high) & (down < 0)))
        gram = curvature(rows.filter(free).agg(*(F.sum(F.col(f"a{d}") * F.col(f"a{e}")).alias(f"m{d}_{e}") for d in range(k) for e in range(k))).first())
        moves.append(solved(gram, miss))
    return Rates(rate(), {d: x / max(sum(now), 1e-300) for d, x in zip(model.domains, now, strict=True)}, error if total else 0.0)


def mixed(docs: DataFrame, model: DomainModel, target: dict[str, float], allowed: float | None = None, widen: int = 0, **how) -> DataFrame:
    """docs with n_words, posterior and rate. A miss of over `allowed` is an error; without it, a warning is logged.

    widen: how often the high bound may be doubled while the target is missed and that brings it nearer.
    """
    members = stored(memberships(docs, model))
    rows, high = members.select("n_words", "posterior"), how.pop("high", 20.0)
    found = fit_rates(rows, model, target, high=high, **how)
    for _ in range(widen):
        if found.miss <= (ALLOWED if allowed is None else allowed):
            break
        high *= 2
        wider = fit_rates(rows, model, target, high=high, **how)
        if wider.miss > 0.999 * found.miss:
            break
        found = wider
    if found.miss > (ALLOWED if allowed is None else allowed):
        said = f"the target {target} is missed by {found.miss:.4f} of its words within these bounds; shares reached: {found.reached}"
        if allowed is not None:
            raise ValueError(said)
        logging.getLogger(__name__).warning(said)
    return members.withColumn("rate", found.rate)


def repeated(rated: DataFrame, key: str = "doc_id", seed: int = 23) -> DataFrame:
    """Each row floor(rate) times, and once more with the rest as its chance (by the key's hash); without the rate."""
    chance = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    times = (F.floor("rate") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    return rated.withColumn("_n", F.explode(F.array_repeat(F.lit(1), times))).drop("_n", "rate")
