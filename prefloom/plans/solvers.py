"""Driver-side solvers over item-by-item statistics, whose size is the number of items, never of rows."""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import permutations

import numpy as np


def centred(u: np.ndarray) -> np.ndarray:
    return u - u.mean(axis=-1, keepdims=True)


def stationary(m: np.ndarray) -> np.ndarray:
    """Stationary distribution of a row-stochastic matrix, by least squares."""
    n = len(m)
    a = np.vstack([m.T - np.eye(n), np.ones(n)])
    pi = np.linalg.lstsq(a, np.append(np.zeros(n), 1.0), rcond=None)[0]
    pi = np.maximum(pi, 0)
    return pi / pi.sum()


def power(m: np.ndarray, start: np.ndarray | None = None, iters: int = 10_000, eps: float = 1e-6, normalise: bool = True) -> tuple[np.ndarray, int]:
    """Power iteration until the L2 change is below ``eps``: (distribution, steps)."""
    pi = np.full(len(m), 1 / len(m)) if start is None else start / start.sum()
    for k in range(1, iters + 1):
        new = pi @ m
        if normalise:
            new = new / new.sum()
        done = np.linalg.norm(new - pi) < eps
        pi = new
        if done:
            return pi, k
    return pi, iters


def minimise(fun: Callable, x0: np.ndarray, iters: int = 500, tol: float = 1e-9, memory: int = 12) -> np.ndarray:
    """Limited-memory BFGS with a backtracking line search; ``fun`` gives value and gradient."""
    x = np.array(x0, float)
    f, g = fun(x)
    s_all: list[np.ndarray] = []
    y_all: list[np.ndarray] = []
    for _ in range(iters):
        if not np.isfinite(f) or np.abs(g).max(initial=0) < tol:
            break
        q, a_all = g.copy(), []
        for s, y in zip(reversed(s_all), reversed(y_all), strict=True):
            a = (s @ q) / (y @ s)
            a_all.append(a)
            q -= a * y
        if s_all:
            q *= (s_all[-1] @ y_all[-1]) / (y_all[-1] @ y_all[-1])
        for (s, y), a in zip(zip(s_all, y_all, strict=True), reversed(a_all), strict=True):
            q += s * (a - (y @ q) / (y @ s))
        step = -q
        if step @ g >= 0:
            step = -g
            s_all, y_all = [], []
        t = 1.0 if s_all else min(1.0, 1.0 / max(np.abs(g).sum(), 1e-12))
        for _ in range(50):
            new = x + t * step
            f_new, g_new = fun(new)
            if np.isfinite(f_new) and f_new <= f + 1e-4 * t * (step @ g):
                break
            t /= 2
        else:
            break
        s, y = new - x, g_new - g
        small = abs(f - f_new) <= 1e-14 * max(1.0, abs(f))
        if s @ y > 1e-14:
            s_all, y_all = [*s_all, s][-memory:], [*y_all, y][-memory:]
        x, f, g = new, f_new, g_new
        if small:
            break
    return x


def in_centred_space(fun: Callable, u0: np.ndarray, **options) -> np.ndarray:
    """Minimises ``fun`` over vectors whose sum is zero."""
    return centred(minimise(lambda u: (lambda f, g: (f, g - g.mean()))(*fun(centred(u))), centred(u0), **options))


def strongly_connected(edge: np.ndarray) -> bool:
    def reach(a: np.ndarray) -> int:
        seen = np.zeros(len(a), bool)
        seen[0] = True
        todo = [0]
        while todo:
            new = np.flatnonzero(a[todo.pop()] & ~seen)
            seen[new] = True
            todo += new.tolist()
        return int(seen.sum())

    return len(edge) <= 1 or reach(edge) == reach(edge.T) == len(edge)


def composite_mle(wins: np.ndarray, link, u0: np.ndarray | None = None, reg: str = "l2", lam: float = 0.001) -> np.ndarray:
    """argmin of -sum wins[loser, winner] log F(U_winner - U_loser) + lam reg(U), with sum U = 0."""
    w = wins * (1 - np.eye(len(wins)))
    if lam == 0 and not strongly_connected(w > 0):
        raise ValueError("without a penalty the estimate is unbounded: the win graph is not strongly connected")

    def fun(u):
        delta = u[None, :] - u[:, None]
        p = np.maximum(link.cdf(delta), 1e-300)
        k = w * link.pdf(delta) / p
        f = -(w * np.log(p)).sum()
        g = -(k.sum(axis=0) - k.sum(axis=1))
        if reg == "l1":  # smoothed at zero, so that a gradient exists
            r = np.sqrt(u * u + 1e-10)
            return f + lam * r.sum(), g + lam * u / r
        return f + lam * (u * u).sum(), g + 2 * lam * u

    return in_centred_space(fun, np.zeros(len(w)) if u0 is None else u0)


def pinned_mle(wins: np.ndarray, link, u0: np.ndarray | None = None, reg: str = "l2", lam: float = 0.0, iters: int = 200, tol: float = 1e-11) -> np.ndarray:
    """argmin of -sum wins[loser, winner] log F(V_winner - V_loser) + lam |V|^2 with V_0 = 0, over the other n - 1; centred.

    Newton steps in the reduced space, with the exact gradient and curvature; a step that does not descend is halved.
    """
    if reg != "l2":
        raise ValueError("the pinned solver takes an l2 penalty")
    w = wins * (1 - np.eye(len(wins)))
    if lam == 0 and not strongly_connected(w > 0):
        raise ValueError("without a penalty the estimate is unbounded: the win graph is not strongly connected")
    v = np.zeros(len(w)) if u0 is None else np.asarray(u0, float) - u0[0]

    def value(v: np.ndarray) -> float:
        return float(-(w * np.log(np.maximum(link.cdf(v[None, :] - v[:, None]), 1e-300))).sum() + lam * (v * v).sum())

    f = value(v)
    for _ in range(iters):
        slope, bend = pinned_slopes(w, link, v, lam)
        if np.abs(slope).max(initial=0) < tol:
            break
        step = -np.linalg.lstsq(bend, slope, rcond=None)[0]
        if step @ slope >= 0:
            step = -slope
        for _ in range(60):
            new = np.concatenate([[0.0], v[1:] + step])
            g = value(new)
            if np.isfinite(g) and g <= f + 1e-4 * (step @ slope):
                break
            step = step / 2
        else:
            break
        v, f = new, g
    return centred(v)


def pinned_slopes(w: np.ndarray, link, v: np.ndarray, lam: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the pinned objective at V (V_0 = 0), over items 1 .. n - 1."""
    delta = v[None, :] - v[:, None]
    rate, turn = link.log_slopes(delta)
    g, h = w * rate, -w * turn
    slope = g.sum(axis=1) - g.sum(axis=0) + 2 * lam * v
    bend = np.diag(h.sum(axis=0) + h.sum(axis=1)) - h - h.T + 2 * lam * np.eye(len(w))
    return slope[1:], bend[1:, 1:]


def moment_match(p: np.ndarray, link, u0: np.ndarray | None = None, lam: float = 0.001) -> np.ndarray:
    """Generalised method of moments on p[loser, winner]: residuals p_ab F(U_a - U_b) - p_ba F(U_b - U_a)."""
    off = 1 - np.eye(len(p))

    def fun(u):
        d = u[:, None] - u[None, :]
        r = (p * link.cdf(d) - p.T * link.cdf(-d)) * off
        k = r * (p * link.pdf(d) + p.T * link.pdf(-d))
        return 0.5 * (r * r).sum() + lam / 2 * (u * u).sum(), k.sum(axis=1) - k.sum(axis=0) + lam * u

    return in_centred_space(fun, np.zeros(len(p)) if u0 is None else u0)


def ridge(values: np.ndarray, mask: np.ndarray, lam: float) -> np.ndarray:
    """Least squares of values[i, j] on U_j - U_i over masked cells with a ridge, by its normal equations."""
    v, w = np.where(mask, values, 0.0), mask.astype(float)
    a = 2 * np.diag(w.sum(axis=0) + w.sum(axis=1)) - 2 * (w + w.T) + lam * np.eye(len(w))
    return centred(np.linalg.lstsq(a, 2 * v.sum(axis=0) - 2 * v.sum(axis=1), rcond=None)[0])


def rank_two(values: np.ndarray) -> np.ndarray:
    """Rank-2 truncation of a matrix; its first row, centred."""
    u, s, vt = np.linalg.svd(values)
    return centred((u[:, :2] * s[:2]) @ vt[:2])[0]


def masked_rank_two(values: np.ndarray, mask: np.ndarray, lam: float = 0.001, iters: int = 1000, tol: float = 1e-2) -> np.ndarray:
    """Rank-2 factors of the masked cells by alternating ridge regressions from an SVD start; first row, centred."""
    v = np.where(mask, values, 0.0)
    u, s, vt = np.linalg.svd(v)
    x, y = u[:, :2] * np.sqrt(s[:2]), vt[:2].T * np.sqrt(s[:2])
    last = math.inf
    for _ in range(iters):
        x = np.stack([np.linalg.lstsq(y[m].T @ y[m] + lam * np.eye(2), y[m].T @ r[m], rcond=None)[0] for r, m in zip(v, mask, strict=True)])
        y = np.stack([np.linalg.lstsq(x[m].T @ x[m] + lam * np.eye(2), x[m].T @ r[m], rcond=None)[0] for r, m in zip(v.T, mask.T, strict=True)])
        loss = (((x @ y.T - v) * mask) ** 2).sum() + lam * ((x * x).sum() + (y * y).sum())
        if abs(last - loss) <= tol * max(loss, 1e-12):
            break
        last = loss
    return centred(x[0] @ y.T)


def assignment(cost: np.ndarray) -> np.ndarray:
    """Row i's column in a one-to-one matching of least cost (square matrix), by augmenting shortest paths."""
    n = len(cost)
    row_of = np.full(n, -1)
    pot_r, pot_c = np.zeros(n), np.zeros(n)
    for i in range(n):
        far, came, done = np.full(n, np.inf), np.full(n, -1), np.zeros(n, bool)
        at, j0, base = i, -1, 0.0
        while True:
            open_ = np.flatnonzero(~done)
            reach = base + cost[at, open_] - pot_r[at] - pot_c[open_]
            better = reach < far[open_]
            far[open_[better]], came[open_[better]] = reach[better], j0
            j0 = open_[far[open_].argmin()]
            base, done[j0] = far[j0], True
            if row_of[j0] < 0:
                break
            at = row_of[j0]
        pot_r[i] += base
        for j in np.flatnonzero(done):
            if j != j0:
                pot_r[row_of[j]] += base - far[j]
                pot_c[j] -= base - far[j]
        while True:
            before = came[j0]
            row_of[j0] = i if before < 0 else row_of[before]
            if before < 0:
                break
            j0 = before
    out = np.empty(n, int)
    out[row_of] = np.arange(n)
    return out


def best_permutation(cost: np.ndarray) -> tuple[float, tuple[int, ...]]:
    """(least total, matching); small ones by trying all."""
    n = len(cost)
    if n <= 6:
        p = min(permutations(range(n)), key=lambda q: sum(cost[i, j] for i, j in enumerate(q)))
    else:
        p = tuple(int(x) for x in assignment(cost))
    return float(sum(cost[i, j] for i, j in enumerate(p))), p


def golden(fun: Callable[[float], float], low: float, high: float, tol: float = 1e-8) -> float:
    """Least point of a unimodal function."""
    r = (math.sqrt(5) - 1) / 2
    a, b = high - r * (high - low), low + r * (high - low)
    fa, fb = fun(a), fun(b)
    while high - low > tol:
        if fa <= fb:
            high, b, fb = b, a, fa
            a = high - r * (high - low)
            fa = fun(a)
        else:
            low, a, fa = a, b, fb
            b = low + r * (high - low)
            fb = fun(b)
    return (low + high) / 2


def kmeans(x: np.ndarray, k: int, seed: int = 0, restarts: int = 5, iters: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(labels, centres) of a small dense matrix, k-means++ starts."""
    best = (math.inf, np.zeros(len(x), int), x[:k])
    for r in range(restarts):
        rng = np.random.default_rng(seed + r)
        centres = [x[rng.integers(len(x))]]
        for _ in range(1, k):
            d = np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0)
            centres.append(x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))])
        c = np.stack(centres).astype(float)
        for _ in range(iters):
            dist = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
            label = dist.argmin(axis=1)
            new = np.stack([x[label == j].mean(axis=0) if (label == j).any() else c[j] for j in range(k)])
            if np.allclose(new, c):
                break
            c = new
        loss = dist.min(axis=1).sum()
        if loss < best[0]:
            best = (loss, label, c)
    return best[1], best[2]


def shrink(a: np.ndarray, k: float) -> np.ndarray:
    """Soft threshold."""
    return np.sign(a) * np.maximum(np.abs(a) - k, 0)


def nuclear(x: np.ndarray, lam: float) -> np.ndarray:
    """argmin of |X - M|^2 / 2 + lam |M|_*: singular values, soft-thresholded."""
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    return (u * shrink(s, lam)) @ vt
