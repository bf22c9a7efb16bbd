"""Finite mixtures of ranking models by EM.

Each iteration is one distributed pass without a shuffle (``passes``): posteriors and the weighted statistics that the
M-step needs are aggregated to components x items (or pairs); posteriors are never collected.  Equal rankings are
collapsed once, with their counts as weights.  Loops can keep their steps and go on from them (``plans.state``).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.links import Logistic, Normal
from ..plans import solvers
from ..plans.state import Loop
from ..sources.shared import cut
from . import clustering, draws, embeddings, estimators, passes
from . import rankings as R


@dataclass
class Fit:
    """Utilities (components x items), weights, and the log-likelihood and change of each iteration."""

    u: np.ndarray
    alpha: np.ndarray
    loglik: list[float] = field(default_factory=list)
    change: list[float] = field(default_factory=list)

    def frames(self, spark):
        return estimators.to_frame(spark, self.u), alpha_frame(spark, self.alpha)


def alpha_frame(spark, alpha: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(k, float(a)) for k, a in enumerate(alpha)], "component int, a double")


def e_step(rankings: DataFrame, u: np.ndarray, alpha: np.ndarray, trim: bool = False, hard: bool = False) -> DataFrame:
    """(ranking_id, component, q, lse) under Plackett-Luce; ``trim`` drops posteriors below 1 / n^2."""
    spark = rankings.sparkSession
    ll = R.pl_log_likelihood(rankings, estimators.to_frame(spark, u))
    return R.posterior(ll, alpha_frame(spark, np.maximum(alpha, 1e-300)), 1 / u.shape[1] ** 2 if trim else None, hard)


def random_start(n: int, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    return solvers.centred(np.random.default_rng(seed).normal(size=(k, n))), np.full(k, 1 / k)


def spectral_start(rankings: DataFrame, n: int, k: int, method: str = "gmm", seed: int = 0, lam: float = 0.01, link=None) -> tuple[np.ndarray, np.ndarray]:
    """Clusters of signed pair embeddings; each centre gives win rates, and those give utilities.

    method: ``rc``, ``gmm``, ``lrmc``, ``svd``, or ``cluster`` (moments on the cluster's own pair counts).
    """
    size, link = n * (n - 1) // 2, link or Logistic()
    x = embeddings.pairwise(rankings, n)
    labels = cut(clustering.spectral_clustering(x, size, k, seed=seed))
    mu, count = clustering.centres(x, labels, size, k)
    alpha = np.maximum(count, 1) / np.maximum(count, 1).sum()
    iu = np.triu_indices(n, 1)
    out = np.zeros((k, n))
    pairs = None
    if method == "cluster":
        q = labels.select("ranking_id", F.col("label").alias("component"), F.lit(1.0).alias("q"))
        pairs = estimators.rates(estimators.weighted_pairs(rankings, q, n, k))
    for c in range(k):
        t = np.zeros((n, n))
        t[iu] = mu[c]
        wins = 0.5 + t - t.T  # [i, j]: i beats j
        p = wins.T  # [loser, winner]
        inner = np.clip(p, 0.001, 0.999)
        if method == "cluster":
            out[c] = solvers.moment_match(pairs[c], link, lam=lam)
        elif method == "gmm":
            out[c] = solvers.moment_match(p, link, lam=lam)
        elif method == "rc":
            m = p * (1 - np.eye(n))
            m = m / max(m.sum(axis=1).max(), 1e-12)
            np.fill_diagonal(m, 1 - m.sum(axis=1))
            out[c] = solvers.centred(np.log(np.maximum(solvers.stationary(m), 1e-12)))
        elif method == "lrmc":
            mask = (p > 0.001) & (p < 0.999) & ~np.eye(n, dtype=bool)
            out[c] = solvers.ridge(link.quantile(inner), mask, 1.0)
        elif method == "svd":
            out[c] = solvers.rank_two(link.quantile(inner))
        else:
            raise ValueError("unknown start")
    return solvers.centred(out), alpha


def _em(rankings: DataFrame, n: int, k: int, start, m_step, iters: int, eps: float, damp: float = 1.0, want: str = "pairs", at_of=None, model_of=None, at: str | None = None, **options) -> Fit:
    """The EM loop, a pass over the rankings a step: ``m_step(sums, u, again)`` gives new utilities from the sums of
    ``want``; ``again`` finds them at other strengths under the same posteriors.

    Stops when the squared change is below ``eps``; steps are kept in the folder ``at``, if any, and a later run with
    it goes on from the last one.
    """
    rows = passes.table(rankings)
    model_of = model_of or (lambda u, alpha: passes.Model(u, alpha, **options))

    def step(_: int, s: dict) -> tuple[dict, dict]:
        u, alpha = s["u"], s["alpha"]
        model = model_of(u, alpha)
        got = passes.sums(rows, n, model, want, at_of(u) if at_of else None)
        new = (1 - damp) * u + damp * m_step(got, u, lambda v: passes.sums(rows, n, model, want, v))
        share = got["alpha"] / got["alpha"].sum()
        return {"u": new, "alpha": (1 - damp) * alpha + damp * share}, {"loglik": float(got["loglik"] / got["m"]), "change": float(((new - u) ** 2).sum())}

    return _fit(Loop(iters, eps, rankings.sparkSession, at), start, step)


def _fit(loop: Loop, start: tuple[np.ndarray, np.ndarray], step) -> Fit:
    s = loop.run({"u": np.asarray(start[0], float), "alpha": np.asarray(start[1], float)}, step)
    return Fit(s["u"], s["alpha"], [h["loglik"] for h in loop.history], [h["change"] for h in loop.history])


def emm(rankings: DataFrame, n: int, k: int, start=None, iters: int = 1000, eps: float = 1e-4, mm_iters: int = 20, mm_tol: float = 1e-5, seed: int = 0, init: str = "random", at: str | None = None) -> Fit:
    """EM with weighted minorise-maximise steps; all components step together."""

    def m_step(got, u, again):
        for i in range(mm_iters):
            new = estimators.mm_update(got["wins"], got["denom"], 1e-8)
            done = np.abs(new - u).sum() <= mm_tol * n * k
            u = new
            if done or i == mm_iters - 1:
                break
            got = again(u)
        return u

    start = start or (random_start(n, k, seed) if init == "random" else spectral_start(rankings, n, k, "gmm", seed))
    return _em(rankings, n, k, start, m_step, iters, eps, want="mm", at=at)


def em_gmm(rankings: DataFrame, n: int, k: int, start=None, iters: int = 100, eps: float = 1e-4, lam: float = 0.0, step: float = 1.0, seed: int = 0, at: str | None = None) -> Fit:
    """EM with the moment estimator on posterior-weighted win rates."""

    def m_step(got, u, again):
        p = estimators.rates(got["pairs"])
        return np.stack([solvers.moment_match(p[c], Logistic(), u[c], max(lam, 1e-6)) for c in range(k)])

    return _em(rankings, n, k, start or spectral_start(rankings, n, k, "gmm", seed), m_step, iters, eps, step, at=at)


def pl_spectral_em(rankings: DataFrame, n: int, k: int, start=None, iters: int = 100, eps: float = 1e-4, inner: int = 1, init: str = "lrmc", nu: float = 1.0, trim: bool = False, hard: bool = False, refine: bool = False, seed: int = 0, at: str | None = None) -> Fit:
    """EM with weighted iterated Luce spectral steps from a spectral start; ``refine`` adds one run of 100 inner steps."""
    shares = lambda u: u - (np.log(np.exp(u - u.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)) + u.max(axis=1, keepdims=True))

    def m_step_of(inner: int):
        def m_step(got, u, again):
            v = shares(u)
            for i in range(inner):
                new = np.stack([np.log(np.maximum(estimators.luce_chain(got["rates"][c], True, nu, 1.0, float(n), 0.0)[0], 1e-300)) for c in range(k)])
                done = np.linalg.norm(np.exp(new) - np.exp(v), axis=1).max() < 1e-3
                v = new
                if done or i == inner - 1:
                    break
                got = again(v)
            return solvers.centred(v)

        return m_step

    options = {"want": "rates", "at_of": shares, "trim": 1 / n**2 if trim else None, "hard": hard}
    start = start or spectral_start(rankings, n, k, init, seed)
    fit = _em(rankings, n, k, start, m_step_of(inner), iters, eps, at=at, **options)
    if refine:
        more = _em(rankings, n, k, (fit.u, fit.alpha), m_step_of(100), 5, eps, at=f"{at}/refined" if at else None, **options)
        fit = Fit(more.u, more.alpha, fit.loglik + more.loglik, fit.change + more.change)
    return fit


def pair_log_likelihood(rankings: DataFrame, u: DataFrame, link, pair_weights: DataFrame | None = None, pos_weights: DataFrame | None = None) -> DataFrame:
    """(ranking_id, component, loglik): composite log-likelihood, the sum of w log F(U_winner - U_loser) over pairs.

    ``pair_weights`` is (i, j, w) with i < j; ``pos_weights`` (pos_a, pos_b, w); pairs without a weight keep 1.
    """
    a = R.to_arrays(rankings)
    b = R.break_full(a)
    w = F.lit(1.0)
    if pair_weights is not None:
        b = b.withColumn("i", F.least("winner", "loser")).withColumn("j", F.greatest("winner", "loser")).join(pair_weights.withColumnRenamed("w", "w_pair"), ["i", "j"], "left")
        w = w * F.coalesce("w_pair", F.lit(1.0))
    if pos_weights is not None:
        at = R.to_long(a).select("ranking_id", F.col("item_id").alias("loser"), F.col("pos").alias("pos_b"))
        b = b.withColumnRenamed("pos", "pos_a").join(at, ["ranking_id", "loser"]).join(pos_weights.withColumnRenamed("w", "w_pos"), ["pos_a", "pos_b"], "left")
        w = w * F.coalesce("w_pos", F.lit(1.0))
    d = u.select("component", F.col("item_id").alias("winner"), F.col("u").alias("uw")).join(u.select("component", F.col("item_id").alias("loser"), F.col("u").alias("ul")), "component")
    j = b.join(d, ["winner", "loser"])
    return j.groupBy("ranking_id", "component").agg(F.sum(w * F.log(link.cdf_col(F.col("uw") - F.col("ul")))).alias("loglik"))


def composite_em(rankings: DataFrame, n: int, k: int, start=None, link=None, iters: int = 1000, eps: float = 1e-3, damp: float = 0.1, lam: float = 0.001, init: str = "svd", e: str = "pairs", pair_weights: DataFrame | None = None, pos_weights: DataFrame | None = None, seed: int = 0, space: str = "centred", at: str | None = None) -> Fit:
    """EM on the composite likelihood of any random utility model (``e="pairs"``), or with the Plackett-Luce E-step.

    The M-step solves a weighted composite likelihood whose statistic is one pair-weight matrix a component, over
    centred utilities or with item 0 pinned (``space="pinned"``).  Steps are damped, and compared with the iterate before.
    """
    link = link or Normal()
    solve = {"centred": solvers.composite_mle, "pinned": solvers.pinned_mle}[space]
    weight, places = np.ones((n, n)), None
    if pair_weights is not None:
        for r in pair_weights.collect():  # a number a pair of items
            weight[r.i, r.j] = weight[r.j, r.i] = r.w
    if pos_weights is not None:
        places = np.ones((n, n))
        for r in pos_weights.collect():
            places[r.pos_a, r.pos_b] = r.w

    def model_of(u: np.ndarray, alpha: np.ndarray) -> passes.Model:
        if e != "pairs":
            return passes.Model(u, alpha)
        f = np.stack([link.cdf(v[:, None] - v[None, :]) for v in u])
        return passes.Model(u, alpha, weight * np.log(np.maximum(f, 1e-300)), places)

    def m_step(got, u, again):
        s = got["pairs"]
        return np.stack([solve(s[c] / max(s[c].sum(), 1e-12), link, u[c], "l2", max(lam, 1e-6)) for c in range(k)])

    start = start or (random_start(n, k, seed) if init == "random" else spectral_start(rankings, n, k, init, seed, link=link))
    return _em(rankings, n, k, start, m_step, iters, eps, damp, model_of=model_of, at=at)


def em_cml(rankings: DataFrame, n: int, k: int, iters: int = 500, eps: float = 1e-5, seed: int = 0, **options) -> Fit:
    """Plackett-Luce E-step with a composite-likelihood M-step (logistic)."""
    return composite_em(rankings, n, k, link=Logistic(), iters=iters, eps=eps, damp=1.0, init="svd", e="pl", seed=seed, **options)


def gmm_mixture(rankings: DataFrame, n: int, k: int, start=None, lam: float = 0.0, seed: int = 0) -> Fit:
    """Matches mean win indicators of all pairs to sum_k alpha_k F(U_ka - U_kb); alpha by softmax weights."""
    pairs = R.pairwise_matrix(R.comparisons(rankings), "none")
    p = R.dense(pairs, n).T  # [winner, loser]
    seen = (p + p.T > 0) & ~np.eye(n, dtype=bool)
    link = Logistic()
    u, alpha = start or random_start(n, k, seed)

    def fun(v):
        w, a = v[: k * n].reshape(k, n), v[k * n :]
        a = np.exp(a - a.max()) / np.exp(a - a.max()).sum()
        d = w[:, :, None] - w[:, None, :]
        f = link.cdf(d)
        r = ((a[:, None, None] * f).sum(axis=0) - p) * seen
        g_u = a[:, None] * ((r * link.pdf(d)).sum(axis=2) - (r * link.pdf(d)).sum(axis=1)) + lam * w
        g_a = (r * f).sum(axis=(1, 2))
        return 0.5 * (r * r).sum() + lam / 2 * (w * w).sum(), np.concatenate([g_u.ravel(), a * (g_a - (a * g_a).sum())])

    v = solvers.minimise(fun, np.concatenate([u.ravel(), np.log(np.maximum(alpha, 1e-12))]))
    a = np.exp(v[k * n :] - v[k * n :].max())
    return Fit(solvers.centred(v[: k * n].reshape(k, n)), a / a.sum())


# -- Bayesian mixture: EM mode and Gibbs samples ------------------------------------------------------------------------


def bayes_map(rankings: DataFrame, n: int, k: int, start, c: float = 1.0, d: float = 0.0, alpha: float = 1.0, iters: int = 100, eps: float = 1e-6, at: str | None = None) -> Fit:
    """MAP under Gamma(c, d) strengths and a Dirichlet(alpha) weight prior; utilities are centred per component."""
    rows = passes.table(rankings)

    def step(_: int, s: dict) -> tuple[dict, dict]:
        got = passes.sums(rows, n, passes.Model(s["u"], s["alpha"]), "mm")
        new = solvers.centred(np.log(np.maximum(c - 1 + got["wins"], 1e-12)) - np.log(np.maximum(d + got["denom"], 1e-12)))
        w = (alpha - 1 + got["alpha"]) / (k * alpha - k + got["m"])
        return {"u": new, "alpha": w}, {"loglik": float(got["loglik"] / got["m"]), "change": float(((new - s["u"]) ** 2).sum())}

    return _fit(Loop(iters, eps, rankings.sparkSession, at), start, step)


def gibbs(rankings: DataFrame, n: int, k: int, start, samples: int = 1000, c: float = 1.0, d: float = 0.0, alpha: float = 1.0, seed: int = 0, burn: int = 0, chains: int = 1, store: draws.Store | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Posterior means (centred log strengths, weights) over Gibbs chains: assignments, waits, strengths, weights.

    Draws of assignments and waits are one pass over the rankings; item-sized Gamma and Dirichlet draws are local.
    Every draw is kept in ``store`` as the chain runs; a run with a store that holds draws of a chain goes on from the
    last of them, to the same draws.  Means leave out the first ``burn`` draws; with several chains, components are
    matched to those of the first chain's last draw.
    """
    rows = passes.table(rankings)
    store = store or draws.Store(rankings.sparkSession)
    for chain in range(chains):
        u, w = start if chain == 0 else random_start(n, k, seed + chain)
        done, last = store.last(chain)
        if last is not None:
            u, w = last
        for t in range(done, samples):
            got = passes.draw(rows, n, passes.Model(u, w), (seed, chain, t))
            rng = np.random.default_rng([seed, chain, t])
            u = solvers.centred(np.log(np.maximum(rng.gamma(c + got["wins"], 1 / np.maximum(d + got["waits"], 1e-9)), 1e-300)))
            w = rng.dirichlet(alpha + got["count"])
            store.add(chain, t, u, w)
        store.flush()
    return store.means(burn, samples)
