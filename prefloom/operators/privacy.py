"""Differentially private item response estimation: exact discrete noise, private chains, randomised response."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import uniform
from ..plans import solvers
from . import chains
from .estimators import to_frame


def bernoulli_exp(gamma: float, rng: np.random.Generator) -> int:
    """An exact draw of Bernoulli(exp(-gamma)) from uniform draws only."""
    while gamma > 1:  # exp(-gamma) is a product over whole steps and the rest
        if not bernoulli_exp(1.0, rng):
            return 0
        gamma -= 1
    k = 1
    while rng.random() < gamma / k:
        k += 1
    return k % 2


def discrete_gaussian(sigma: float, rng: np.random.Generator) -> int:
    """An exact draw with P(x) proportional to exp(-x^2 / (2 sigma^2)), by rejection from a discrete Laplace."""
    t = math.floor(sigma) + 1
    while True:
        low = int(rng.integers(t))
        if not bernoulli_exp(low / t, rng):
            continue
        high = 0
        while bernoulli_exp(1.0, rng):
            high += 1
        x, negative = low + t * high, rng.random() < 0.5
        if negative and x == 0:
            continue
        if bernoulli_exp((x - sigma * sigma / t) ** 2 / (2 * sigma * sigma), rng):
            return -x if negative else x


def two_sided_geometric(alpha: float, rng: np.random.Generator) -> int:
    """P(x) proportional to alpha^|x|."""
    if rng.random() < (1 - alpha) / (1 + alpha):
        return 0
    return int(rng.geometric(1 - alpha)) * (1 if rng.random() < 0.5 else -1)


def random_graph(n: int, p: float, seed: int = 0) -> np.ndarray:
    """Symmetric 0/1 matrix: each pair is in with probability p."""
    upper = np.triu(np.random.default_rng(seed).random((n, n)) < p, 1)
    return (upper | upper.T).astype(int)


def noisy_counts(counts: np.ndarray, mechanism: str, epsilon: float, seed: int = 0) -> np.ndarray:
    """Integer noise on non-zero counts, clipped at 1: discrete Gaussian of sigma 1 / epsilon, or geometric."""
    rng = np.random.default_rng(seed)
    draw = (lambda: discrete_gaussian(1 / epsilon, rng)) if mechanism == "gauss" else (lambda: two_sided_geometric(math.exp(-epsilon), rng))
    out = np.zeros_like(counts)
    for i, j in np.argwhere(counts > 0):
        out[i, j] = max(1, counts[i, j] + draw())
    return out


def private_chain(responses: DataFrame, n: int, mechanism: str = "gauss", lam: float = 1.0, epsilon: float = 0.1, graph: np.ndarray | None = None, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(counts, noisy counts, chain, d): counts are aggregated in Spark, noise is item-sized."""
    m = np.zeros((n, n))
    for r in chains.co_counts(responses, 1, 0).where("i <> j").collect():  # items x items
        m[r.i, r.j] = r.y
    m = np.round(m)
    noisy = noisy_counts(m * (1 if graph is None else graph), mechanism, epsilon, seed)
    rates = noisy + lam * ((noisy > 0) | (noisy.T > 0))
    d = float((rates.sum(axis=1) + 1).max())
    chain = rates / d
    np.fill_diagonal(chain, 1 - chain.sum(axis=1))
    return m, noisy, chain, d


def private_rasch(responses: DataFrame, n: int, iters: int = 1000, eps: float = 1e-5, **options) -> DataFrame:
    """(item_id, beta) from the private chain."""
    chain = private_chain(responses, n, **options)[2]
    pi = solvers.power(chain, np.ones(n), iters, eps)[0]
    return to_frame(responses.sparkSession, solvers.centred(np.log(np.maximum(pi, 1e-300))), "beta")


def randomized_response(responses: DataFrame, epsilon: float, seed: int = 0) -> DataFrame:
    """Binary scores flipped with probability 1 / (1 + e^(epsilon / responses of the user)).

    Draws are hashes of user and item, so they are the same however the table is partitioned.
    """
    n = responses.groupBy("user_id").agg(F.count("*").alias("__n"))
    flip = uniform(seed, "user_id", "item_id") < 1 / (1 + F.exp(F.lit(float(epsilon)) / F.col("__n")))
    return responses.join(n, "user_id").withColumn("score", F.when(flip, 1 - F.col("score")).otherwise(F.col("score"))).drop("__n")


def epsilon_gauss(epsilon: float, delta: float) -> float:
    """Per-release epsilon of the Gaussian mechanism."""
    return epsilon / math.sqrt(2 * math.log(1 / delta))


def epsilon_shuffle(epsilon: float, delta: float, n: int, tol: float = 1e-9) -> float:
    """Largest local epsilon whose amplification by shuffling n reports stays within (epsilon, delta), by bisection.

    The closed bound of amplification by shuffling ("hiding among the clones", theorem for local epsilons up to
    log(n / (16 log(2 / delta)))); with too few reports for it, ``epsilon`` itself.
    """

    def amplified(e0: float) -> float:
        e = math.exp(e0)
        return math.log1p((e - 1) / (e + 1) * (8 * math.sqrt(e * math.log(4 / delta) / n) + 8 * e / n))

    limit = math.log(n / (16 * math.log(2 / delta))) if n > 16 * math.log(2 / delta) else 0.0
    if limit <= 0:
        return epsilon  # too few reports to amplify
    low, high = 0.0, limit
    while high - low > tol:
        mid = (low + high) / 2
        low, high = (mid, high) if amplified(mid) <= epsilon else (low, mid)
    return low
