"""Expectation propagation for pairwise comparisons: a Gaussian posterior over utilities (driver, item-sized).

All comparisons of a pair are one site, F(x)^a F(-x)^b of the utility difference x, whose moments against the
cavity are found by quadrature around its mode; so cost depends on pairs, not on comparisons.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame

_NODES, _WEIGHTS = np.polynomial.hermite_e.hermegauss(40)
_ERFC = np.vectorize(math.erfc, otypes=[float])


def log_cdf(x: np.ndarray, model: str) -> np.ndarray:
    """log F(x) of the logistic or the normal distribution, stable in the lower tail."""
    x = np.asarray(x, float)
    if model == "logit":
        return -np.logaddexp(0, -x)
    tail = np.minimum(x, -8.0)
    ratio = np.zeros_like(tail)
    for k in range(60, 0, -1):  # continued fraction of the Mills ratio
        ratio = k / (-tail + ratio)
    low = -0.5 * tail * tail - 0.5 * math.log(2 * math.pi) - np.log(-tail + ratio)
    return np.where(x < -8, low, np.log(np.maximum(0.5 * _ERFC(-np.maximum(x, -8.0) / math.sqrt(2)), 1e-300)))


def tilted(mean: float, var: float, a: float, b: float, model: str) -> tuple[float, float]:
    """Mean and variance of N(x; mean, var) F(x)^a F(-x)^b, normalised; its logarithm is concave."""

    def g(x):
        return -((x - mean) ** 2) / (2 * var) + a * log_cdf(x, model) + b * log_cdf(-x, model)

    x, h = mean, 1e-4
    for _ in range(100):
        lo, mid, hi = g(np.array([x - h, x, x + h]))
        d1, d2 = (hi - lo) / (2 * h), min((hi - 2 * mid + lo) / (h * h), -1 / var)
        step = max(-2.0, min(2.0, -d1 / d2))
        x += step
        if abs(step) < 1e-7:
            break
    sd = math.sqrt(-1 / d2)
    t = x + sd * _NODES
    e = g(t) + _NODES**2 / 2
    w = _WEIGHTS * np.exp(e - e.max())
    w = w / w.sum()
    m = float((w * t).sum())
    return m, max(float((w * (t - m) ** 2).sum()), 1e-12)


def ep_pairwise(n: int, comparisons: Iterable[tuple[int, int, float]], alpha: float, model: str = "logit", max_iter: int = 100, tol: float = 1e-4, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(mean, covariance) for (winner, loser, count) under a N(0, 1/alpha) prior; raises if it does not converge."""
    if model not in ("logit", "probit"):
        raise ValueError("model must be logit or probit")
    sites: dict[tuple[int, int], list[float]] = {}
    for w, l, c in comparisons:
        sites.setdefault((min(w, l), max(w, l)), [0.0, 0.0])[int(w > l)] += c
    pairs = sorted(sites)
    tau, nu = np.zeros(len(pairs)), np.zeros(len(pairs))
    cov, mean = np.eye(n) / alpha, np.zeros(n)
    rng = np.random.default_rng(seed)
    for _ in range(max_iter):
        old = mean.copy()
        for k in rng.permutation(len(pairs)):
            i, j = pairs[k]
            mu, var = mean[i] - mean[j], cov[i, i] + cov[j, j] - 2 * cov[i, j]
            cav_tau, cav_nu = 1 / var - tau[k], mu / var - nu[k]
            if cav_tau <= 0:
                continue
            m, v = tilted(cav_nu / cav_tau, 1 / cav_tau, *sites[i, j], model)
            dt, dv = 1 / v - cav_tau - tau[k], m / v - cav_nu - nu[k]
            tau[k], nu[k] = tau[k] + dt, nu[k] + dv
            col = cov[:, i] - cov[:, j]
            mean = mean + col * ((dv - dt * mu) / (1 + dt * var))
            cov = cov - np.outer(col, col) * (dt / (1 + dt * var))
        # refresh from the sites, so that rank-one updates do not drift
        prec, rhs = alpha * np.eye(n), np.zeros(n)
        for (i, j), t, v in zip(pairs, tau, nu, strict=True):
            prec[[i, j], [i, j]] += t
            prec[[i, j], [j, i]] -= t
            rhs[i] += v
            rhs[j] -= v
        half = np.linalg.inv(np.linalg.cholesky(prec))
        cov = half.T @ half
        mean = cov @ rhs
        if np.abs(mean - old).max() < tol:
            return mean, cov
    raise RuntimeError("expectation propagation did not converge")


def fit(counts: DataFrame, n: int, alpha: float = 1.0, model: str = "logit", **options) -> tuple[np.ndarray, np.ndarray]:
    """From (winner, loser, cnt): at most items x items rows are collected."""
    return ep_pairwise(n, [tuple(r) for r in counts.select("winner", "loser", "cnt").orderBy("winner", "loser").collect()], alpha, model, **options)
