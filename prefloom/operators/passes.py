"""One pass over rankings for one step of a mixture: posteriors and the sums that an M-step needs, without a shuffle.

Rankings are rows (ranking_id, items, weight), equal ones collapsed.  A task lays its rankings out as blocks, rankings
of like length together, finds their posteriors and adds up: mixture weights, the log-likelihood, and what is asked
for (``mm``: wins and exposures an item, ``pairs``: weighted wins a pair, ``rates``: Luce rates a pair).  A tree of
tasks adds the sums; the driver is given components x items^2 numbers at most, whatever the number of rankings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources.shared import cut
from . import rankings as R

#: cells of a block of rankings; numbers that a task and the driver may hold
CELLS, MOST = 1 << 18, 1 << 25


def table(rankings: DataFrame) -> DataFrame:
    """Long rankings as collapsed rows, written once."""
    return cut(R.collapse(R.to_arrays(rankings)).select("ranking_id", "items", "weight"))


@dataclass
class Model:
    """What a posterior depends on: Plackett-Luce by utilities, or a composite of pairs by ``log_f`` [c, winner, loser]."""

    u: np.ndarray
    alpha: np.ndarray
    log_f: np.ndarray | None = None
    by_place: np.ndarray | None = None
    trim: float | None = None
    hard: bool = False


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of the batch, items padded with -1, lengths, weights); rankings in order of length."""
    for b in batches:
        lists = b.column(1)
        size = lists.value_lengths().to_numpy(zero_copy_only=False)
        flat, start = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)])
        weight = b.column(2).to_numpy(zero_copy_only=False)
        order = np.argsort(size, kind="stable")
        lo = 0
        while lo < len(order):
            hi = lo + 1  # as many rankings as fit when padded to the longest
            while hi < len(order) and (hi + 1 - lo) * size[order[hi]] <= CELLS:
                hi += 1
            own = order[lo:hi]
            wide = int(size[own[-1]])
            at = np.arange(wide)
            valid = at[None, :] < size[own][:, None]
            items = np.full((len(own), wide), -1)
            items[valid] = flat[(start[own][:, None] + at)[valid]]
            yield own, items, size[own], weight[own]
            lo = hi


def strengths(items: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(utilities less the largest of the ranking, their exponentials, sums of these from each place on) by component."""
    valid = items >= 0
    v = np.where(valid[None], u[:, np.maximum(items, 0)], -np.inf)
    v = v - np.where(valid.any(axis=1), v.max(axis=2, initial=-np.inf), 0.0)[:, :, None]
    w = np.exp(v)
    return v, w, np.cumsum(w[:, :, ::-1], axis=2)[:, :, ::-1]


def log_likelihoods(items: np.ndarray, size: np.ndarray, model: Model) -> np.ndarray:
    """Components x rankings."""
    if model.log_f is None:
        v, _, tail = strengths(items, model.u)
        choice = np.arange(items.shape[1])[None, :] < (size - 1)[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(choice[None], v - np.log(tail), 0.0).sum(axis=2)
    out = np.zeros((len(model.log_f), len(items)))
    for d in range(1, items.shape[1]):
        winner, loser = items[:, :-d], items[:, d:]
        ok = loser >= 0
        f = model.log_f[:, np.maximum(winner, 0), np.maximum(loser, 0)]
        if model.by_place is not None:
            f = f * model.by_place[np.arange(items.shape[1] - d), np.arange(d, items.shape[1])][None, None, :]
        out += np.where(ok[None], f, 0.0).sum(axis=2)
    return out


def posteriors(items: np.ndarray, size: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(components x rankings, log of the mixture's likelihood)."""
    z = log_likelihoods(items, size, model) + np.log(np.maximum(model.alpha, 1e-300))[:, None]
    top = z.max(axis=0)
    e = np.exp(z - top)
    total = e.sum(axis=0)
    q = e / total
    if model.trim is not None:
        q = np.where(q < model.trim, 0.0, q)
        q = q / q.sum(axis=0)
    if model.hard:
        q = (np.arange(len(q))[:, None] == q.argmax(axis=0)[None, :]).astype(float)
    return q, top + np.log(total)


def _pair_sums(items: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Components x losers x winners: sums of ``value`` [c, ranking, winner's place] over all pairs."""
    out = np.zeros((len(value), n * n))
    for d in range(1, items.shape[1]):
        ok = items[:, d:] >= 0
        cell = (items[:, d:] * n + items[:, :-d])[ok]
        for c in range(len(value)):
            out[c] += np.bincount(cell, weights=value[c, :, :-d][ok], minlength=n * n)
    return out.reshape(len(value), n, n)


def sums(rows: DataFrame, n: int, model: Model, want: str, at: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """alpha, loglik, m, and those of ``want`` at the strengths of ``at`` (the model's own utilities by default)."""
    k = len(model.alpha)
    shapes = {"alpha": (k,), "loglik": (), "m": ()}
    shapes |= {"mm": {"wins": (k, n), "denom": (k, n)}, "pairs": {"pairs": (k, n, n)}, "rates": {"rates": (k, n, n)}}[want]
    if sum(int(np.prod(s)) for s in shapes.values()) > MOST:
        raise ValueError(f"{k} components of {n} items are more than a task may hold")
    u = model.u if at is None else at

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {name: np.zeros(shape) for name, shape in shapes.items()}
        for _, items, size, weight in blocks(batches):
            q, lse = posteriors(items, size, model)
            q = q * weight
            total["alpha"] += q.sum(axis=1)
            total["loglik"] += (lse * weight).sum()
            total["m"] += weight.sum()
            if not items.shape[1]:
                continue
            if want == "pairs":
                total["pairs"] += _pair_sums(items, np.broadcast_to(q[:, :, None], (k, *items.shape)), n)
                continue
            _, _, tail = strengths(items, u)
            top = np.where((items >= 0)[None], u[:, np.maximum(items, 0)], -np.inf).max(axis=2)[:, :, None]
            choice = (np.arange(items.shape[1])[None, :] < (size - 1)[:, None])[None]
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                inverse = np.where(choice, np.exp(-top) / tail, 0.0)
            if want == "rates":
                total["rates"] += _pair_sums(items, q[:, :, None] * inverse, n)
                continue
            several = (size > 1)[:, None] & (items >= 0)
            stay = np.cumsum(inverse, axis=2)
            for c in range(k):
                total["wins"][c] += np.bincount(items[choice[0]], weights=np.broadcast_to(q[c][:, None], items.shape)[choice[0]], minlength=n)
                total["denom"][c] += np.bincount(items[several], weights=(q[c][:, None] * stay[c])[several], minlength=n)
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([total[name].ravel() for name in shapes]).tolist()], pa.list_(pa.float64()))], ["sums"])

    add = lambda a, b: a + b
    every = rows.select("ranking_id", "items", "weight").mapInArrow(work, "sums array<double>").rdd.map(lambda r: np.array(r["sums"]))
    size = sum(int(np.prod(s)) for s in shapes.values())
    found, out, lo = every.treeAggregate(np.zeros(size), add, add), {}, 0
    for name, shape in shapes.items():
        hi = lo + int(np.prod(shape))
        out[name] = found[lo:hi].reshape(shape)
        lo = hi
    return out


def draw(rows: DataFrame, n: int, model: Model, seed: tuple[int, ...]) -> dict[str, np.ndarray]:
    """One Gibbs draw of assignments and waits: (count, wins, waits) by component.

    Equal rankings share a row with their number, so assignments are one multinomial draw a row, and a stage's waits
    of a component's rankings add to one Gamma draw.  Draws depend on the seed and the ranking alone, whatever the
    partitions and however often a task runs.
    """
    k = len(model.alpha)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, 1 + 2 * n))
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for own, items, size, weight in blocks(iter([b])):
                if (weight != np.floor(weight)).any():
                    raise ValueError("draws take whole numbers of rankings as weights")
                q, _ = posteriors(items, size, model)
                v, _, tail = strengths(items, model.u)
                top = np.where((items >= 0)[None], model.u[:, np.maximum(items, 0)], -np.inf).max(axis=2, initial=-np.inf)
                for r, i in enumerate(own):
                    rng = np.random.default_rng([*seed, int(ids[i]) & 0xFFFFFFFF, (int(ids[i]) >> 32) & 0xFFFFFFFF])
                    count = rng.multinomial(int(weight[r]), q[:, r] / q[:, r].sum())
                    total[:, 0] += count
                    last = int(size[r]) - 1
                    if last < 1:
                        continue
                    shape = np.broadcast_to(count[:, None], (k, last))
                    waits = np.cumsum(rng.gamma(np.maximum(shape, 1e-9)) * (shape > 0) * np.exp(-top[:, r])[:, None] / tail[:, r, :last], axis=1)
                    here = items[r, : last + 1]
                    total[:, 1 + here[:last]] += count[:, None]
                    total[:, 1 + n + here] += np.hstack([waits, waits[:, -1:]])
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["sums"])

    add = lambda a, b: a + b
    every = rows.select("ranking_id", "items", "weight").mapInArrow(work, "sums array<double>").rdd.map(lambda r: np.array(r["sums"]).reshape(k, -1))
    found = every.treeAggregate(np.zeros((k, 1 + 2 * n)), add, add)
    return {"count": found[:, 0], "wins": found[:, 1 : 1 + n], "waits": found[:, 1 + n :]}


def assign(rows: DataFrame, model: Model) -> DataFrame:
    """(ranking_id, component, q, lse) of each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own, items, size, _ in blocks(iter([b])):
                q, lse = posteriors(items, size, model)
                k = len(q)
                ids = b.column(0).take(pa.array(np.repeat(own, k)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(k, dtype=np.int32), len(own))), pa.array(q.T.ravel()), pa.array(np.repeat(lse, k))], ["ranking_id", "component", "q", "lse"])

    return rows.select("ranking_id", "items", "weight").mapInArrow(work, "ranking_id long, component int, q double, lse double")
