"""Item response models: Rasch and partial-credit difficulties and abilities, and mixtures of the latter.

Responses are long, (user_id, item_id, score), with dense item ids and no rows for missing ones.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import solvers
from ..plans.state import Loop
from . import chains, metrics, response_passes
from .estimators import to_frame


def rasch(responses: DataFrame, n: int, lam: float = 1.0, accelerated: bool = True, method: str = "solve", log: bool = True) -> DataFrame:
    """(item_id, beta): spectral difficulties; or the normalised stationary mass if ``log`` is off."""
    return to_frame(responses.sparkSession, chains.scores(*chains.responses(responses, lam, accelerated), n, method, log=log), "beta")


def response_patterns(responses: DataFrame, keys: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """(user_id, items, total, p1, p2): a user's items, sorted, the sum of their scores, and 128 bits that name the two."""
    g = responses.groupBy(*keys).agg(F.sort_array(F.collect_list("item_id")).alias("items"), F.sum(F.col("score").cast("double")).alias("total"))
    return g.select(*keys, "items", "total", F.xxhash64("items", "total").alias("p1"), F.xxhash64(F.lit(1), "total", "items").alias("p2"))


def ability(total: Column, betas: Column, bound: float = 6.0, steps: int = 80) -> Column:
    """The ability at which items of these betas are expected to give this total, within +-bound.

    Newton steps, halving the bracket where one would leave it; a pattern that has settled is left as it is.
    """
    low, high = F.lit(-bound), F.lit(bound)
    start = F.struct(low.alias("low"), high.alias("high"), F.lit(0.0).alias("x"), F.lit(False).alias("done"))

    def step(s: Column, _: Column) -> Column:
        def move(m: Column) -> Column:
            short = m["mean"] < total
            low, high = F.when(short, s["x"]).otherwise(s["low"]), F.when(short, s["high"]).otherwise(s["x"])
            newton = s["x"] - (m["mean"] - total) / F.greatest(m["var"], F.lit(1e-300))
            return metrics.let(
                F.struct(low.alias("low"), high.alias("high"), newton.alias("to")),
                lambda b: metrics.let(
                    F.when((b["to"] > b["low"]) & (b["to"] < b["high"]), b["to"]).otherwise((b["low"] + b["high"]) / 2),
                    lambda x: F.struct(b["low"].alias("low"), b["high"].alias("high"), x.alias("x"), (F.abs(x - s["x"]) < 1e-13).alias("done")),
                ),
            )

        return F.when(s["done"], s).otherwise(metrics.let(metrics.pcm_moments(s["x"], betas), move))

    root = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["x"])
    return F.when(metrics.pcm_moments(low, betas)["mean"] >= total, low).when(metrics.pcm_moments(high, betas)["mean"] <= total, high).otherwise(root)


def abilities(responses: DataFrame, difficulties: DataFrame, bound: float = 6.0) -> DataFrame:
    """([component,] user_id, theta): ability whose expected total score is the observed one, within +-bound.

    Works for binary difficulties (item_id, beta) and graded ones (item_id, level, beta); items without one are left
    out.  Users with the same items and total share an ability: each such pattern is solved once, by column
    expressions, and joined back.
    """
    d = difficulties if "level" in difficulties.columns else difficulties.withColumn("level", F.lit(1))
    keys = [c for c in ("component",) if c in d.columns]
    users = response_patterns(responses.join(d.select("item_id").distinct(), "item_id"))
    patterns = users.groupBy("p1", "p2").agg(F.first("items").alias("items"), F.first("total").alias("total"))
    rows = patterns.select("p1", "p2", "total", F.explode("items").alias("item_id")).join(metrics.level_arrays(d), "item_id")
    gathered = rows.groupBy(*keys, "p1", "p2").agg(F.first("total").alias("total"), F.sort_array(F.collect_list(F.struct("item_id", "betas"))).alias("b"))
    solved = gathered.select(*keys, "p1", "p2", ability(F.col("total"), F.transform("b", lambda x: x["betas"]), bound).alias("theta"))
    return users.select("user_id", "p1", "p2").join(solved, ["p1", "p2"]).select(*keys, "user_id", "theta")


def rasch_joint(responses: DataFrame, n: int, lam: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(difficulties, abilities)."""
    beta = rasch(responses, n, lam)
    return beta, abilities(responses, beta)


def level_counts(responses: DataFrame, levels: int, weight: str | None = None, power: int = 2) -> DataFrame:
    """(k, l, i, j, y) for the score pairs that the partial-credit estimator needs: (l, l - 1), (1, l) and (0, l)."""
    w = F.first(weight) if weight else F.lit(1.0)
    g = responses.groupBy("user_id").agg(F.collect_list(F.struct(F.col("item_id").alias("i"), F.col("score").alias("s"))).alias("a"), w.alias("w"))
    x = g.select(F.explode("a").alias("u"), "a", "w").select("u", F.explode("a").alias("v"), "w")
    x = x.where((F.col("u.s") <= levels) & (F.col("v.s") <= levels) & ((F.col("u.s") == F.col("v.s") + 1) | (F.col("u.s") <= 1)))
    return x.groupBy(F.col("u.s").alias("k"), F.col("v.s").alias("l"), F.col("u.i").alias("i"), F.col("v.i").alias("j")).agg(F.sum(F.pow("w", F.lit(power))).alias("y"))


def level_shift(y_1: np.ndarray, y_0: np.ndarray, beta_1: np.ndarray, beta_k: np.ndarray) -> float:
    """log of sum e^{b1_i} Y_ij(1, k-1) over sum e^{bk_j} Y_ij(0, k), i unequal j; 0 where either is empty."""
    off = 1 - np.eye(len(y_1))
    a, b = (np.exp(beta_1)[:, None] * y_1 * off).sum(), (np.exp(beta_k)[None, :] * y_0 * off).sum()
    return math.log(a / b) if a > 0 and b > 0 else 0.0


def pcm_from_counts(y: dict[tuple[int, int], np.ndarray], n: int, levels: int, lam: float = 0.1) -> np.ndarray:
    """Partial-credit difficulties (items x levels) from co-occurrence matrices by score pair."""
    zero = np.zeros((n, n))
    out = np.zeros((n, levels))
    for k in range(1, levels + 1):
        m = y.get((k, k - 1), zero) * (1 - np.eye(n))
        m = m + lam * ((m > 0) | (m.T > 0))
        d = np.maximum(m.sum(axis=1), 1.0)
        m = m / d[:, None]
        np.fill_diagonal(m, 1 - m.sum(axis=1))
        pi = solvers.stationary(m) / d
        out[:, k - 1] = solvers.centred(np.log(np.maximum(pi / pi.sum(), 1e-12)))
    for k in range(2, levels + 1):
        out[:, k - 1] += level_shift(y.get((1, k - 1), zero), y.get((0, k), zero), out[:, 0], out[:, k - 1])
    return out


def _matrices(counts: DataFrame, n: int, keys: tuple[str, ...] = ("k", "l")) -> dict[tuple, np.ndarray]:
    out: dict[tuple, np.ndarray] = {}
    for r in counts.collect():  # levels^2 x items^2
        out.setdefault(tuple(r[c] for c in keys), np.zeros((n, n)))[r["i"], r["j"]] = r["y"]
    return out


def levels_frame(spark, betas: np.ndarray) -> DataFrame:
    """(item_id, level, beta), or with a component, of (components x) items x levels."""
    if betas.ndim == 2:
        return spark.createDataFrame([(i, k + 1, float(v)) for i, row in enumerate(betas) for k, v in enumerate(row)], "item_id int, level int, beta double")
    return spark.createDataFrame([(c, i, k + 1, float(v)) for c, m in enumerate(betas) for i, row in enumerate(m) for k, v in enumerate(row)], "component int, item_id int, level int, beta double")


def pcm(responses: DataFrame, n: int, levels: int, lam: float = 0.1, weight: str | None = None, power: int = 2) -> np.ndarray:
    """Spectral partial-credit difficulties; a weight enters co-occurrences as weight^power."""
    return pcm_from_counts(_matrices(level_counts(responses, levels, weight, power), n), n, levels, lam)


@dataclass
class PcmMixture:
    betas: np.ndarray
    loglik: list[float] = field(default_factory=list)
    sigma: float = 1.0


def responsibilities(responses: DataFrame, thetas: DataFrame, betas: DataFrame, sigma: float = 1.0, prior: np.ndarray | None = None) -> DataFrame:
    """(user_id, component, q, lse): softmax over classes of the response log-likelihood and the ability's normal density."""
    d = metrics.level_arrays(betas)
    j = responses.join(d, "item_id").join(thetas, ["user_id", "component"])
    p = F.get(metrics.pcm_probabilities(F.col("theta"), F.col("betas")), F.col("score"))
    ll = j.groupBy("user_id", "component").agg(F.sum(F.log(F.greatest(p, F.lit(1e-300)))).alias("ll"), F.first("theta").alias("theta"))
    z = F.col("ll") - F.pow(F.col("theta") / sigma, 2) / 2 - math.log(sigma * math.sqrt(2 * math.pi))
    if prior is not None:
        z = z + F.element_at(F.array(*[F.lit(float(np.log(max(v, 1e-300)))) for v in prior]), F.col("component") + 1)
    by = Window.partitionBy("user_id")
    ll = ll.withColumn("z", z).withColumn("top", F.max("z").over(by)).withColumn("e", F.exp(F.col("z") - F.col("top"))).withColumn("s", F.sum("e").over(by))
    return ll.select("user_id", "component", (F.col("e") / F.col("s")).alias("q"), (F.col("top") + F.log("s")).alias("lse"))


def shift_mmle(counts: np.ndarray, betas: np.ndarray, sigma: float = 1.0, grid: int = 500) -> float:
    """Mean of the ability distribution that maximises sum of count x log marginal probability.

    ``counts`` is items x (levels + 1), weighted by class membership; abilities are N(mean, sigma).
    """
    x = np.linspace(-4 * sigma, 4 * sigma, grid)
    w = np.exp(-0.5 * (x / sigma) ** 2)
    w = w / w.sum()
    steps = np.hstack([np.zeros((len(betas), 1)), np.cumsum(betas, axis=1)])
    k = np.arange(steps.shape[1])

    def loss(mean: float) -> float:
        z = (x[:, None, None] + mean) * k - steps[None]
        e = np.exp(z - z.max(axis=2, keepdims=True))
        p = (w[:, None, None] * e / e.sum(axis=2, keepdims=True)).sum(axis=0)
        return -(counts * np.log(np.maximum(p, 1e-300))).sum()

    return solvers.golden(loss, -5.0, 5.0, 1e-5)


def user_embedding(responses: DataFrame, most_items: int = 100) -> tuple[DataFrame, int]:
    """((ranking_id = user, k, x), size): score differences over pairs of the items of highest variance."""
    top = [r.item_id for r in responses.groupBy("item_id").agg(F.variance("score").alias("v")).orderBy(F.desc_nulls_last("v"), "item_id").limit(most_items).collect()]
    place = {v: i for i, v in enumerate(sorted(top))}
    g = responses.where(F.col("item_id").isin(top)).groupBy("user_id").agg(F.collect_list(F.struct("item_id", "score")).alias("a"))
    x = g.select("user_id", F.explode("a").alias("u"), "a").select("user_id", "u", F.explode("a").alias("v")).where("u.item_id < v.item_id and u.score <> v.score")
    ids = F.create_map(*[F.lit(t) for p in place.items() for t in p])
    n = len(top)
    i, j = F.element_at(ids, F.col("u.item_id")), F.element_at(ids, F.col("v.item_id"))
    k = (n * i - F.floor(i * (i + 1) / 2) + (j - i - 1)).cast("int")
    return x.select(F.col("user_id").alias("ranking_id"), k.alias("k"), (F.col("u.score") - F.col("v.score")).cast("double").alias("x")), max(1, n * (n - 1) // 2)


def _classes(y: np.ndarray, counts: np.ndarray, lam: float, sigma: float) -> np.ndarray:
    """Difficulties of each class from weighted co-occurrences, shifted to abilities of mean zero."""
    classes, n, levels = counts.shape[0], counts.shape[1], counts.shape[2] - 1
    fits = [pcm_from_counts({(k, l): y[c, k, l] for k in range(levels + 1) for l in range(levels + 1)}, n, levels, lam) for c in range(classes)]
    return np.stack([b - shift_mmle(counts[c], b, sigma) for c, b in enumerate(fits)])


def pcm_mixture(responses: DataFrame, n: int, levels: int, classes: int, iters: int = 100, eps: float = 1e-4, sigma: float | None = 1.0, lam: float = 0.1, start: np.ndarray | None = None, validation: DataFrame | None = None, seed: int = 0, at: str | None = None) -> tuple[PcmMixture, DataFrame, DataFrame]:
    """EM for a mixture of partial-credit models: (fit, abilities, memberships).

    A step is one pass over collapsed users, without a shuffle.  Starts from clusters of users unless ``start``
    (classes x items x levels) is given; ``sigma=None`` estimates the abilities' spread; a validation set stops the
    loop when its likelihood falls; steps are kept in the folder ``at``, if any.
    """
    from . import clustering

    spark = responses.sparkSession
    rows = response_passes.table(responses)

    def clusters() -> np.ndarray:
        x, size = user_embedding(responses)
        labels = clustering.spectral_clustering(x, size, classes, seed=seed).withColumnRenamed("ranking_id", "user_id")
        own = responses.join(labels, "user_id", "left").select("user_id", "item_id", "score", F.coalesce("label", F.lit(0)).alias("component"))
        y, counts = np.zeros((classes, levels + 1, levels + 1, n, n)), np.zeros((classes, n, levels + 1))
        for c in range(classes):
            for key, m in _matrices(level_counts(own.where(F.col("component") == c), levels), n).items():
                y[(c, *key)] = m
        for r in own.groupBy("component", "item_id", "score").agg(F.count("*").alias("c")).collect():
            counts[r.component, r.item_id, r.score] = r.c
        return _classes(y, counts, lam, sigma or 1.0)

    def judged(betas: np.ndarray, spread: float) -> float | None:
        theta = abilities(responses, levels_frame(spark, betas))
        q = responsibilities(responses, theta, levels_frame(spark, betas), spread)
        return metrics.evaluate_mixture(theta, levels_frame(spark, betas), q, validation).first()["loglik"]

    def step(_: int, s: dict) -> tuple[dict, dict]:
        betas, spread = s["betas"], float(s["sigma"][0])
        if sigma is None:
            got = response_passes.sums(rows, betas, spread)
            m = got["m"] * classes
            spread = max(0.1, math.sqrt(max(0.0, (got["theta"][1] - got["theta"][0] ** 2 / m) / max(m - 1, 1))))
        if validation is not None:
            now = judged(betas, spread)
            if now is not None and now < s["last"][0]:
                return s, {"loglik": float("nan"), "change": 0.0}
            s = s | {"last": np.array([s["last"][0] if now is None else now])}
        got = response_passes.sums(rows, betas, spread)
        new = _classes(got["y"], got["counts"], lam, spread)
        return s | {"betas": new, "sigma": np.array([spread])}, {"loglik": float(got["loglik"] / got["m"]), "change": float(((new - betas) ** 2).sum())}

    loop = Loop(iters, eps, spark, at)
    found = loop.run({"betas": clusters() if start is None else np.asarray(start, float), "sigma": np.array([sigma or 1.0]), "last": np.array([-np.inf])}, step)
    fit = PcmMixture(found["betas"], [h["loglik"] for h in loop.history if not math.isnan(h["loglik"])], float(found["sigma"][0]))
    frame = levels_frame(spark, fit.betas)
    theta = abilities(responses, frame)
    return fit, theta, responsibilities(responses, theta, frame, fit.sigma)
