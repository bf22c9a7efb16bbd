"""One pass over users' responses for one step of a partial-credit mixture, without a shuffle.

Users are rows (items, scores, weight), those with equal responses collapsed.  A task lays its users out as a matrix of
scores, finds their ability in each class, their memberships, and adds up co-occurrences of scores (as matrix
products) and scores by item; a tree of tasks adds the sums.  The driver is given classes x levels^2 x items^2 numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut

#: numbers of a block of users' probabilities; numbers that a task and the driver may hold
CELLS, MOST = 1 << 20, 1 << 25


def table(responses: DataFrame) -> DataFrame:
    """Long responses as collapsed rows, written once."""
    users = responses.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("item_id", F.col("score").cast("int").alias("score")))).alias("a"))
    rows = users.select(F.transform("a", lambda x: x["item_id"]).alias("items"), F.transform("a", lambda x: x["score"]).alias("scores"))
    return cut(rows.groupBy("items", "scores").agg(F.count("*").cast("double").alias("weight")))


def blocks(batches: Iterator[pa.RecordBatch], n: int, levels: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(scores by user and item, -1 where there is none, weights)."""
    step = max(1, CELLS // (n * (levels + 1)))
    for b in batches:
        for lo in range(0, b.num_rows, step):
            part = b.slice(lo, step)
            size = part.column(0).value_lengths().to_numpy(zero_copy_only=False)
            out = np.full((part.num_rows, n), -1)
            out[np.repeat(np.arange(part.num_rows), size), part.column(0).flatten().to_numpy(zero_copy_only=False)] = part.column(1).flatten().to_numpy(zero_copy_only=False)
            yield out, part.column(2).to_numpy(zero_copy_only=False)


def probabilities(theta: np.ndarray, betas: np.ndarray) -> np.ndarray:
    """Users x items x scores."""
    run = np.hstack([np.zeros((len(betas), 1)), np.cumsum(betas, axis=1)])
    z = theta[:, None, None] * np.arange(run.shape[1]) - run[None]
    e = np.exp(z - z.max(axis=2, keepdims=True))
    return e / e.sum(axis=2, keepdims=True)


def abilities(scores: np.ndarray, betas: np.ndarray, bound: float = 6.0, steps: int = 100) -> np.ndarray:
    """Abilities at which the expected totals are the observed ones, within +-bound: Newton steps inside a bracket."""
    seen, level = scores >= 0, np.arange(betas.shape[1] + 1)
    total = np.where(seen, scores, 0).sum(axis=1)

    def moments(theta: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = probabilities(theta, betas)
        mean = p @ level
        var = p @ (level * level) - mean * mean
        return np.where(seen[own], mean, 0).sum(axis=1), np.where(seen[own], var, 0).sum(axis=1)

    every = np.arange(len(scores))
    low, high, x = np.full(len(scores), -bound), np.full(len(scores), bound), np.zeros(len(scores))
    at_low, at_high = moments(low, every)[0] >= total, moments(high, every)[0] <= total
    live = np.flatnonzero(~at_low & ~at_high)
    for _ in range(steps):
        if not len(live):
            break
        mean, var = moments(x[live], live)
        short = mean < total[live]
        low[live], high[live] = np.where(short, x[live], low[live]), np.where(short, high[live], x[live])
        to = x[live] - (mean - total[live]) / np.maximum(var, 1e-300)
        to = np.where((to > low[live]) & (to < high[live]), to, (low[live] + high[live]) / 2)
        moved = np.abs(to - x[live]) >= 1e-13
        x[live] = to
        live = live[moved]
    return np.where(at_low, -bound, np.where(at_high, bound, x))


def memberships(scores: np.ndarray, betas: np.ndarray, sigma: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(classes x users, log of their sum before scaling, abilities)."""
    theta = np.stack([abilities(scores, b) for b in betas])
    z = np.empty(theta.shape)
    rows, items = np.nonzero(scores >= 0)
    for c, b in enumerate(betas):
        p = probabilities(theta[c], b)[rows, items, scores[rows, items]]
        z[c] = np.bincount(rows, weights=np.log(np.maximum(p, 1e-300)), minlength=len(scores))
    z = z - (theta / sigma) ** 2 / 2 - np.log(sigma * np.sqrt(2 * np.pi))
    top = z.max(axis=0)
    e = np.exp(z - top)
    return e / e.sum(axis=0), top + np.log(e.sum(axis=0)), theta


def sums(rows: DataFrame, betas: np.ndarray, sigma: float) -> dict[str, np.ndarray]:
    """y [class, k, l, i, j]: squared memberships of users with k on i and l on j, for the score pairs of the spectral
    estimator; counts [class, item, score]; and the mean log-likelihood, abilities' sum, sum of squares and number."""
    classes, n, levels = betas.shape
    shapes = {"y": (classes, levels + 1, levels + 1, n, n), "counts": (classes, n, levels + 1), "loglik": (), "m": (), "theta": (2,)}
    size = sum(int(np.prod(s)) for s in shapes.values())
    if size > MOST:
        raise ValueError(f"{classes} classes of {n} items and {levels} levels are more than a task may hold")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {name: np.zeros(shape) for name, shape in shapes.items()}
        for scores, weight in blocks(batches, n, levels):
            q, lse, theta = memberships(scores, betas, sigma)
            total["loglik"] += lse @ weight
            total["m"] += weight.sum()
            total["theta"] += [(theta @ weight).sum(), ((theta * theta) @ weight).sum()]
            at = [(scores == k).astype(float) for k in range(levels + 1)]
            for c in range(classes):
                for k in range(levels + 1):
                    total["counts"][c, :, k] += (q[c] * weight) @ at[k]
                    left = (at[k] * (q[c] ** 2 * weight)[:, None]).T
                    for l in range(levels + 1) if k <= 1 else [k - 1]:
                        total["y"][c, k, l] += left @ at[l]
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([total[name].ravel() for name in shapes]).tolist()], pa.list_(pa.float64()))], ["sums"])

    add = lambda a, b: a + b
    found = rows.select("items", "scores", "weight").mapInArrow(work, "sums array<double>").rdd.map(lambda r: np.array(r["sums"])).treeAggregate(np.zeros(size), add, add)
    out, lo = {}, 0
    for name, shape in shapes.items():
        hi = lo + int(np.prod(shape))
        out[name] = found[lo:hi].reshape(shape)
        lo = hi
    return out
