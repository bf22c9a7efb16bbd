"""Leading singular directions of sparse row tables (ranking_id, k, x), without a matrix of features by features.

Rows are dealt by ranking and written once.  A pass streams each partition's rows in blocks: Y = X V by sums over a
row's entries, X'Y by sums over a feature's, so that a pass returns features x columns numbers and rows are never
collected.  Directions come from a randomised block Krylov space with thick restarts, until their residuals settle;
singular values come from a tall-skinny QR of X V: each task folds its blocks into one small triangle, and a tree of
tasks folds the triangles.

What the driver and a task hold is ``CELLS`` numbers at most (features x columns); more is refused.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut

#: numbers of one matrix of features x columns (256 MB), entries of a block
CELLS, BLOCK = 1 << 25, 1 << 17
#: columns beyond those asked for; blocks of a Krylov space before it is restarted
OVER, WIDE = 8, 6
#: largest residual, as a share of the largest eigenvalue
TOLERANCE = 1e-10


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, row of each entry, k, x) of whole rows; input comes sorted by row."""
    held: list[tuple[np.ndarray, ...]] = []
    n = 0

    def block(ids: np.ndarray, k: np.ndarray, x: np.ndarray):
        new = np.concatenate([[True], ids[1:] != ids[:-1]])
        return ids[new], np.cumsum(new) - 1, k, x

    for b in batches:
        if not b.num_rows:
            continue
        held.append(tuple(b.column(i).to_numpy(zero_copy_only=False) for i in range(3)))
        n += b.num_rows
        if n >= most:
            ids, k, x = (np.concatenate(c) for c in zip(*held, strict=True))
            whole = np.flatnonzero(ids != ids[-1])
            at = int(whole[-1]) + 1 if len(whole) else 0
            if at:
                yield block(ids[:at], k[:at], x[:at])
            held, n = [(ids[at:], k[at:], x[at:])], len(ids) - at
    if held:
        yield block(*(np.concatenate(c) for c in zip(*held, strict=True)))


def _times(row: np.ndarray, k: np.ndarray, x: np.ndarray, n: int, v: np.ndarray) -> np.ndarray:
    return np.stack([np.bincount(row, weights=x * v[k, j], minlength=n) for j in range(v.shape[1])], axis=1)


class Rows:
    """A sparse matrix of ``size`` features; repeated entries of a cell add up."""

    def __init__(self, embedding: DataFrame, size: int, block: int = BLOCK):
        self.size, self.block, self.spark = size, block, embedding.sparkSession
        entries = embedding.select(F.col("ranking_id").cast("long").alias("ranking_id"), F.col("k").cast("int").alias("k"), F.col("x").cast("double").alias("x"))
        self.table = cut(entries.repartition("ranking_id").sortWithinPartitions("ranking_id"))

    def _send(self, v: np.ndarray):
        if v.size > CELLS:
            raise ValueError(f"{v.shape[0]} features by {v.shape[1]} columns are more than a task may hold")
        return self.spark.sparkContext.broadcast(v)

    def normal(self, v: np.ndarray) -> np.ndarray:
        """X'X v."""
        sent, block, columns = self._send(v), self.block, [f"z{j}" for j in range(v.shape[1])]

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v, z = sent.value, None
            for ids, row, k, x in _blocks(batches, block):
                y = _times(row, k, x, len(ids), v)
                z = np.zeros(v.shape) if z is None else z
                for j in range(v.shape[1]):
                    z[:, j] += np.bincount(k, weights=x * y[row, j], minlength=len(v))
            if z is not None:
                at = np.flatnonzero(z.any(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *[pa.array(z[at, j]) for j in range(z.shape[1])]], ["k", *columns])

        out = np.zeros(v.shape)
        parts = self.table.mapInArrow(work, ", ".join(["k int", *[f"{c} double" for c in columns]]))
        sums = parts.groupBy("k").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()  # a row a feature
        at = sums.column("k").to_numpy()
        for j, c in enumerate(columns):
            out[at, j] = sums.column(c).to_numpy()
        sent.unpersist()
        return out

    def triangle(self, v: np.ndarray) -> np.ndarray:
        """R of a tall-skinny QR of X v."""
        sent, block, n = self._send(v), self.block, v.shape[1]

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            r = np.zeros((0, n))
            for ids, row, k, x in _blocks(batches, block):
                r = np.linalg.qr(np.vstack([r, _times(row, k, x, len(ids), sent.value)]), mode="r")
            yield pa.RecordBatch.from_arrays([pa.array([r.ravel().tolist()], pa.list_(pa.float64()))], ["r"])

        def fold(held: np.ndarray, more: np.ndarray) -> np.ndarray:
            return np.linalg.qr(np.vstack([held, more]), mode="r")

        triangles = self.table.mapInArrow(work, "r array<double>").rdd.map(lambda t: np.array(t["r"]).reshape(-1, n))
        out = triangles.treeAggregate(np.zeros((0, n)), fold, fold)
        sent.unpersist()
        return out

    def project(self, v: np.ndarray, back: np.ndarray | None = None) -> DataFrame:
        """(ranking_id, z): X v, or X v ``back``; rows stay where they are."""
        sent, block = self._send(v), self.block

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, row, k, x in _blocks(batches, block):
                y = _times(row, k, x, len(ids), sent.value)
                wide = y if back is None else y @ back
                step = max(1, (1 << 21) // max(1, wide.shape[1]))
                for lo in range(0, len(ids), step):
                    part = wide[lo : lo + step]
                    ends = np.arange(0, part.size + 1, part.shape[1], dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[lo : lo + step]), pa.ListArray.from_arrays(pa.array(ends), pa.array(part.ravel()))], ["ranking_id", "z"])

        return self.table.mapInArrow(work, "ranking_id long, z array<double>")

    def random(self, dims: int, seed: int, sparse: bool) -> np.ndarray:
        """A random projection to ``dims`` columns that keeps distances on average."""
        if self.size * dims > CELLS:
            raise ValueError(f"{self.size} features by {dims} columns are more than a task may hold")
        rng = np.random.default_rng(seed)
        if not sparse:
            return rng.normal(size=(self.size, dims)) / np.sqrt(dims)
        density = 1 / np.sqrt(self.size)
        return rng.choice([-1.0, 0.0, 1.0], p=[density / 2, 1 - density, density / 2], size=(self.size, dims)) / np.sqrt(density * dims)

    def moments(self, m: int) -> tuple[np.ndarray, float]:
        """(mean of each feature, sum of all features' variances) over ``m`` rows, of which some may have no entry."""
        cells = self.table.groupBy("ranking_id", "k").agg(F.sum("x").alias("x"))
        found = cells.groupBy("k").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q")).toArrow()
        mean = np.zeros(self.size)
        mean[found.column("k").to_numpy()] = found.column("s").to_numpy() / m
        return mean, float(found.column("q").to_numpy().sum() / m - (mean * mean).sum())


def _beside(new: np.ndarray, held: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``new`` adds to the orthonormal columns ``held``."""
    scale = np.linalg.norm(new)
    for _ in range(2):
        new = new - held @ (held.T @ new)
    if not scale or not new.size:
        return new[:, :0]
    u, s, _ = np.linalg.svd(new, full_matrices=False)
    u = u[:, s > 1e-13 * scale]
    u = u - held @ (held.T @ u)
    return np.linalg.qr(u)[0]


def leading(apply: Callable[[np.ndarray], np.ndarray], size: int, k: int, seed: int = 0, passes: int = 300, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns), the k largest of a symmetric operator, from products with blocks alone."""
    k = min(k, size)
    width = min(size, k + OVER)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, width)))[0]
    aq = apply(q)
    for _ in range(passes):
        h = q.T @ aq
        w, s = np.linalg.eigh((h + h.T) / 2)
        w, s = w[::-1], s[:, ::-1]
        gap = aq @ s[:, :width] - (q @ s[:, :width]) * w[:width]
        if np.linalg.norm(gap[:, :k], axis=0).max() <= tolerance * max(w[0], 1e-300):
            return w[:k], q @ s[:, :k]
        if q.shape[1] + width > WIDE * width:
            q, aq = q @ s[:, : 2 * width], aq @ s[:, : 2 * width]
        new = _beside(gap, q)
        if not new.shape[1]:  # the space holds all that the operator reaches
            return w[:k], q @ s[:, :k]
        q, aq = np.hstack([q, new]), np.hstack([aq, apply(new)])
    raise RuntimeError("leading directions did not settle")


def right_vectors(rows: Rows, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right vectors as columns), the k largest; fewer features give as many."""
    _, v = leading(rows.normal, rows.size, k, seed)
    _, s, turn = np.linalg.svd(rows.triangle(v), full_matrices=True)
    return np.concatenate([s, np.zeros(v.shape[1] - len(s))]), v @ turn.T
