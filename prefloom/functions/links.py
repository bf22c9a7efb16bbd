"""Link functions of random utility models: cdf, density and quantile of a difference of utilities.

Each link works on numpy arrays (for solvers) and on columns (for plans).  The logistic, Laplace and
extreme-value links are plain column expressions; the normal one and the general normal one have no SQL
function behind them, so their columns are Arrow-batched UDFs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_ERF = np.vectorize(math.erf, otypes=[float])
_INV = np.vectorize(NormalDist().inv_cdf, otypes=[float])


def _gamma_p(a: float, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma function: series below a + 1, continued fraction above."""
    x = np.asarray(x, float)
    out = np.zeros_like(x)
    low = (x > 0) & (x < a + 1)
    if low.any():
        v = x[low]
        term = total = np.full_like(v, 1 / a)
        for k in range(1, 500):
            term = term * v / (a + k)
            total = total + term
        out[low] = total * np.exp(-v + a * np.log(v) - math.lgamma(a))
    high = x >= a + 1
    if high.any():
        v = x[high]
        f = np.zeros_like(v)
        for k in range(200, 0, -1):
            f = k * (k - a) / (v + 2 * k + 1 - a - f)
        out[high] = 1 - np.exp(-v + a * np.log(v) - math.lgamma(a)) / (v + 1 - a - f)
    return out


@dataclass(frozen=True)
class Normal:
    """Probit: the difference of two normal noises of this sigma."""

    sigma: float = 1.0

    @property
    def scale(self) -> float:
        return math.sqrt(2) * self.sigma

    def cdf(self, x):
        return 0.5 * (1 + _ERF(np.asarray(x, float) / (self.scale * math.sqrt(2))))

    def pdf(self, x):
        return np.exp(-0.5 * (np.asarray(x, float) / self.scale) ** 2) / (self.scale * math.sqrt(2 * math.pi))

    def log_slopes(self, x):
        """First and second derivative of log cdf."""
        x = np.asarray(x, float)
        r = self.pdf(x) / np.maximum(self.cdf(x), 1e-300)
        return r, -r * (x / self.scale**2 + r)

    def quantile(self, p):
        return self.scale * _INV(np.asarray(p, float))

    def cdf_col(self, x: Column) -> Column:
        return F.pandas_udf(lambda s: pd.Series(self.cdf(s)), "double")(x)

    def pdf_col(self, x: Column) -> Column:
        return F.exp(-0.5 * F.pow(x / self.scale, 2)) / (self.scale * math.sqrt(2 * math.pi))

    def quantile_col(self, p: Column) -> Column:
        return F.pandas_udf(lambda s: pd.Series(self.quantile(s)), "double")(p)


@dataclass(frozen=True)
class Logistic:
    """The difference of two Gumbel noises of this scale."""

    sigma: float = 1.0

    def cdf(self, x):
        return 1 / (1 + np.exp(-np.clip(np.asarray(x, float) / self.sigma, -700, 700)))

    def pdf(self, x):
        p = self.cdf(x)
        return p * (1 - p) / self.sigma

    def log_slopes(self, x):
        """First and second derivative of log cdf."""
        p = self.cdf(x)
        return (1 - p) / self.sigma, -p * (1 - p) / self.sigma**2

    def quantile(self, p):
        p = np.asarray(p, float)
        return self.sigma * np.log(p / (1 - p))

    def cdf_col(self, x: Column) -> Column:
        return 1 / (1 + F.exp(-x / self.sigma))

    def pdf_col(self, x: Column) -> Column:
        p = self.cdf_col(x)
        return p * (1 - p) / self.sigma

    def quantile_col(self, p: Column) -> Column:
        return self.sigma * F.log(p / (1 - p))


@dataclass(frozen=True)
class GeneralNormal:
    """Density proportional to exp(-|x / sigma|^beta): Laplace for beta 1, normal for 2."""

    sigma: float = 1.0
    beta: float = 1.0

    def cdf(self, x):
        z = np.asarray(x, float) / self.sigma
        return 0.5 + 0.5 * np.sign(z) * _gamma_p(1 / self.beta, np.abs(z) ** self.beta)

    def pdf(self, x):
        z = np.abs(np.asarray(x, float) / self.sigma)
        return self.beta / (2 * self.sigma * math.gamma(1 / self.beta)) * np.exp(-(z**self.beta))

    def log_slopes(self, x):
        """First and second derivative of log cdf."""
        x = np.asarray(x, float)
        r, z = self.pdf(x) / np.maximum(self.cdf(x), 1e-300), np.maximum(np.abs(x / self.sigma), 1e-12)
        return r, -r * (self.beta * np.sign(x) * z ** (self.beta - 1) / self.sigma + r)

    def quantile(self, p):
        p = np.asarray(p, float)
        low, high = np.full_like(p, -60.0 * self.sigma), np.full_like(p, 60.0 * self.sigma)
        for _ in range(90):
            mid = (low + high) / 2
            below = self.cdf(mid) < p
            low, high = np.where(below, mid, low), np.where(below, high, mid)
        return (low + high) / 2

    def cdf_col(self, x: Column) -> Column:
        if self.beta == 1:
            half = 0.5 * F.exp(-F.abs(x) / self.sigma)
            return F.when(x < 0, half).otherwise(1 - half)
        return F.pandas_udf(lambda s: pd.Series(self.cdf(s)), "double")(x)

    def pdf_col(self, x: Column) -> Column:
        return self.beta / (2 * self.sigma * math.gamma(1 / self.beta)) * F.exp(-F.pow(F.abs(x) / self.sigma, self.beta))

    def quantile_col(self, p: Column) -> Column:
        if self.beta == 1:
            return F.when(p < 0.5, self.sigma * F.log(2 * p)).otherwise(-self.sigma * F.log(2 * (1 - p)))
        return F.pandas_udf(lambda s: pd.Series(self.quantile(s)), "double")(p)


@dataclass(frozen=True)
class ExtremeValue:
    """Generalised extreme value: F(x) = exp(-(1 - c x / sigma)^(1 / c)) where 1 - c x / sigma is positive."""

    sigma: float = 1.0
    c: float = 1.0

    def _base(self, x):
        return np.maximum(1 - self.c * np.asarray(x, float) / self.sigma, 0.0)

    def cdf(self, x):
        b = self._base(x)
        return np.exp(-(b ** (1 / self.c))) if self.c > 0 else np.where(b > 0, np.exp(-(np.maximum(b, 1e-300) ** (1 / self.c))), 0.0)

    def pdf(self, x):
        b = np.maximum(self._base(x), 1e-300)
        return np.where(self._base(x) > 0, b ** (1 / self.c - 1) * np.exp(-(b ** (1 / self.c))) / self.sigma, 0.0)

    def log_slopes(self, x):
        """First and second derivative of log cdf."""
        b = self._base(x)
        inside, b = b > 0, np.maximum(b, 1e-300)
        with np.errstate(over="ignore"):
            return np.where(inside, b ** (1 / self.c - 1) / self.sigma, 0.0), np.where(inside, -(1 - self.c) * b ** (1 / self.c - 2) / self.sigma**2, 0.0)

    def quantile(self, p):
        return self.sigma * (1 - (-np.log(np.asarray(p, float))) ** self.c) / self.c

    def cdf_col(self, x: Column) -> Column:
        b = 1 - self.c * x / self.sigma
        return F.when(b > 0, F.exp(-F.pow(b, 1 / self.c))).otherwise(F.lit(1.0 if self.c > 0 else 0.0))

    def pdf_col(self, x: Column) -> Column:
        b = 1 - self.c * x / self.sigma
        return F.when(b > 0, F.pow(b, 1 / self.c - 1) * F.exp(-F.pow(b, 1 / self.c)) / self.sigma).otherwise(F.lit(0.0))

    def quantile_col(self, p: Column) -> Column:
        return self.sigma * (1 - F.pow(-F.log(p), self.c)) / self.c
