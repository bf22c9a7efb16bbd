"""Point estimators for rankings: one pass for sufficient statistics, then a small solve over items.

Every estimator takes long rankings (ranking_id, pos, item_id [, weight]) with dense item ids 0 .. n - 1 and
returns (item_id, u); ``*_from_pairs`` variants start from pairwise statistics.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.links import Logistic, Normal
from ..plans import solvers
from ..plans.state import Loop
from . import chains, passes
from . import rankings as R


def to_frame(spark: SparkSession, u: np.ndarray, name: str = "u") -> DataFrame:
    """(item_id, u), or (component, item_id, u) of a matrix."""
    u = np.asarray(u, float)
    if u.ndim == 1:
        return spark.createDataFrame([(i, float(v)) for i, v in enumerate(u)], f"item_id int, {name} double")
    return spark.createDataFrame([(k, i, float(v)) for k, row in enumerate(u) for i, v in enumerate(row)], f"component int, item_id int, {name} double")


def rank_centrality(rankings: DataFrame, n: int, nu: float = 1.0, method: str = "solve", eps: float = 1e-6, iters: int = 10_000) -> DataFrame:
    """Rank Centrality: counts of both directions of an observed pair get +nu, then the chain's stationary mass."""
    pairs = R.pairwise_matrix(R.comparisons(rankings), "all", nu)
    return rank_centrality_from_pairs(pairs, n, method, eps, iters)


def rank_centrality_from_pairs(pairs: DataFrame, n: int, method: str = "solve", eps: float = 1e-8, iters: int = 10_000) -> DataFrame:
    return to_frame(pairs.sparkSession, chains.scores(*chains.rank_centrality(pairs), n, method, iters, eps))


def ilsr_chain(arrays: DataFrame, pi: DataFrame) -> DataFrame:
    """(loser, winner, rate): sum over rankings of weight / (strength of the winner and of all it beats).

    ``pi`` is (item_id, pi), a number an item; rankings are met in one pass, without a join.
    """
    found = {r.item_id: r.pi for r in pi.collect()}  # item-sized
    n = max(found) + 1
    u = np.log(np.maximum([found.get(i, 0.0) for i in range(n)], 1e-300))
    rate = passes.sums(arrays, n, passes.Model(u[None], np.ones(1)), "rates")["rates"][0]
    return arrays.sparkSession.createDataFrame([(i, j, float(rate[i, j])) for i, j in np.argwhere(rate > 0).tolist()], "loser int, winner int, rate double")


def luce_chain(rates: np.ndarray, mle: bool, nu: float, a0: float, b0: float, dummy: float, method: str = "solve") -> tuple[np.ndarray, float]:
    """(choice probabilities, the prior's state) of rates [loser, winner]: the stationary mass of their chain."""
    n = len(rates)
    if mle:
        m = rates + nu * ((rates == 0) & (rates.T > 0))
    else:
        # prior successes flow from the dummy to items, prior exposure back to it
        m = np.zeros((n + 1, n + 1))
        m[:n, :n] = rates
        m[:n, n], m[n, :n] = b0 * dummy, a0
    m = m * (1 - np.eye(len(m)))
    m = m / max(m.sum(axis=1).max(), 1e-12)
    np.fill_diagonal(m, 1 - m.sum(axis=1))
    full = solvers.stationary(m) if method == "solve" else solvers.power(m)[0]
    return full[:n] / full[:n].sum(), dummy if mle else float(full[n] / max(full[:n].sum(), 1e-300))


def ilsr(rankings: DataFrame, n: int, a0: float = 1.0, b0: float | None = None, mle: bool = False, nu: float = 0.01, iters: int = 100, tol: float = 1e-3, method: str = "solve", start: np.ndarray | None = None, log: bool = False, at: str | None = None) -> np.ndarray:
    """Iterated Luce spectral ranking of weighted rankings: choice probabilities (or centred logs).

    Bayesian by default, with a dummy state that carries a Gamma prior (a0, b0 = n); ``mle`` has no prior and
    adds nu to cells that are empty one way.  Equal rankings are collapsed once before the loop, whose steps are kept
    in the folder ``at``, if any.
    """
    rows = passes.table(rankings)
    b0 = float(n if b0 is None else b0)

    def step(_: int, s: dict) -> tuple[dict, dict]:
        u = np.log(np.maximum(s["pi"], 1e-300))[None]
        rates = passes.sums(rows, n, passes.Model(u, np.ones(1)), "rates")["rates"][0]
        new, dummy = luce_chain(rates, mle, nu, a0, b0, float(s["dummy"][0]), method)
        return {"pi": new, "dummy": np.array([dummy])}, {"change": float(np.linalg.norm(new - s["pi"]))}

    first = np.full(n, 1 / n) if start is None else start / start.sum()
    pi = Loop(iters, tol, rankings.sparkSession, at).run({"pi": first, "dummy": np.array([1.0 / n])}, step)["pi"]
    return solvers.centred(np.log(np.maximum(pi, 1e-300))) if log else pi


def mm_statistics(arrays: DataFrame, u: DataFrame) -> DataFrame:
    """(component, item_id, wins, denom) for one MM step from utilities (component, item_id, u).

    denom adds, for each ranking that holds the item, weight times the sum of 1 / suffix strength over the
    stages at which it is still there.
    """
    rows = u.collect()  # a number an item and component
    k, n = max(r.component for r in rows) + 1, max(r.item_id for r in rows) + 1
    dense = np.zeros((k, n))
    for r in rows:
        dense[r.component, r.item_id] = r.u
    out = []
    for c in range(k):
        s = passes.sums(arrays, n, passes.Model(dense[c : c + 1], np.ones(1)), "mm")
        out += [(c, i, float(s["wins"][0, i]), float(s["denom"][0, i])) for i in np.flatnonzero(s["denom"][0]).tolist()]
    return arrays.sparkSession.createDataFrame(out, "component int, item_id int, wins double, denom double")


def mm_update(wins: np.ndarray, denom: np.ndarray, prior: float = 0.0) -> np.ndarray:
    """Centred log((wins + prior) / (denom + prior))."""
    return solvers.centred(np.log(np.maximum(wins + prior, 1e-12)) - np.log(np.maximum(denom + prior, 1e-12)))


def mm(rankings: DataFrame, n: int, prior: float = 0.0, iters: int = 10_000, tol: float = 1e-5, start: np.ndarray | None = None, at: str | None = None) -> DataFrame:
    """Hunter's minorise-maximise iteration; stops at an L1 change of ``tol`` times n.  Steps are kept in ``at``, if any."""
    rows = passes.table(rankings)

    def step(_: int, s: dict) -> tuple[dict, dict]:
        got = passes.sums(rows, n, passes.Model(s["u"], np.ones(1)), "mm")
        new = mm_update(got["wins"], got["denom"], prior)
        return {"u": new}, {"change": float(np.abs(new - s["u"]).sum())}

    u = np.zeros((1, n)) if start is None else np.atleast_2d(start).astype(float)
    return to_frame(rankings.sparkSession, Loop(iters, np.nextafter(tol * n, np.inf), rankings.sparkSession, at).run({"u": u}, step)["u"][0])


def composite(rankings: DataFrame, n: int, link=None, scheme: str = "random", init: str = "rum_lrmc", reg: str = "l1", lam: float = 0.001, nu: float = 1.0, seed: int = 0) -> DataFrame:
    """Composite marginal likelihood from a spectral start: the pairwise matrix is its sufficient statistic."""
    link = link or Normal()
    p = R.dense(R.pairwise_matrix(R.comparisons(rankings, scheme, seed), "one-sided", nu), n)
    return to_frame(rankings.sparkSession, solvers.composite_mle(p, link, spectral_start(p, link, init), reg, lam))


def spectral_start(p: np.ndarray, link, kind: str = "rum_lrmc", lam: float = 0.001) -> np.ndarray:
    """Utilities from link quantiles of p[loser, winner]: ``svt``, ``lrmc`` or ``rum_lrmc``."""
    off = ~np.eye(len(p), dtype=bool)
    mask = (p > 0) & (p < 1) & off
    values = np.zeros_like(p)
    values[mask] = link.quantile(p[mask])
    if kind == "svt":
        return solvers.rank_two(values)
    if kind == "lrmc":
        return solvers.masked_rank_two(values, mask | ~off, lam)
    if kind == "rum_lrmc":
        return solvers.ridge(values, mask & (values != 0), lam)  # cells of exactly 1/2 drop out, as zeros are not stored
    raise ValueError("unknown start")


def matrix_completion(rankings: DataFrame, n: int, kind: str, link=None, nu: float = 1.0, lam: float = 0.001, scheme: str = "random", seed: int = 0) -> DataFrame:
    """Singular value truncation, low-rank completion or the utility-structured one; every observed pair is smoothed."""
    p = R.dense(R.pairwise_matrix(R.comparisons(rankings, scheme, seed), "all", nu), n)
    return to_frame(rankings.sparkSession, spectral_start(p, link or Logistic(), kind, lam))


def gmm(rankings: DataFrame, n: int, link=None, lam: float = 0.001, start: np.ndarray | None = None) -> DataFrame:
    """Generalised method of moments on the weighted pairwise matrix."""
    p = R.dense(R.pairwise_matrix(R.comparisons(rankings), "none"), n)
    return to_frame(rankings.sparkSession, solvers.moment_match(p, link or Normal(), start, lam))


def weighted_pairs(rankings: DataFrame, weights: DataFrame, n: int, components: int) -> np.ndarray:
    """Pair weights (components, loser, winner) from posteriors (ranking_id, component, q), in one aggregation."""
    c = R.break_full(R.to_arrays(rankings)).join(weights.select("ranking_id", "component", "q"), "ranking_id")
    out = np.zeros((components, n, n))
    for r in c.groupBy("component", "loser", "winner").agg(F.sum(F.col("q") * F.col("weight")).alias("s")).collect():
        out[r.component, r.loser, r.winner] = r.s
    return out


def rates(weights: np.ndarray) -> np.ndarray:
    """Win rates [.., loser, winner] of pair weights; 0 where a pair was not seen, 1/2 on the diagonal."""
    total = weights + np.swapaxes(weights, -1, -2)
    p = np.divide(weights, total, out=np.zeros_like(weights), where=total > 0)
    i = np.arange(p.shape[-1])
    p[..., i, i] = 0.5
    return p


def dense_ids(df: DataFrame, label: str, into: str = "item_id") -> DataFrame:
    """Adds ids 0 .. n - 1 in label order; labels are counted first, so the window is over distinct ones."""
    ids = df.select(label).distinct().withColumn(into, (F.row_number().over(Window.orderBy(label)) - 1).cast("int"))
    return df.join(ids, label)
