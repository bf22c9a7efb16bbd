"""Low-rank approximation and clustering of embedded rankings.

Leading directions come from ``lowrank``; rows are projected where they are.  Clustering is MLlib's k-means over the
projected rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import solvers
from ..sources.shared import cut
from . import lowrank


def low_rank(embedding: DataFrame, size: int, k: int, method: str = "pca", lam: float = 1.0, seed: int = 0) -> DataFrame:
    """(ranking_id, z): left vectors (``pca``), scaled ones (``pca-scaled``), random projections (``gaussian``,
    ``sparse``), soft-thresholded values (``nuclear``) or the rank-k reconstruction (``alternating``)."""
    rows = lowrank.Rows(embedding, size)
    if method in ("gaussian", "sparse"):
        m = rows.table.select("ranking_id").distinct().count()
        return rows.project(rows.random(max(1, int(8 * math.log(max(m, 2)))), seed, method == "sparse"))
    s, v = lowrank.right_vectors(rows, k, seed)
    if method == "pca":
        return rows.project(v / np.maximum(s, 1e-12))
    if method == "pca-scaled":
        return rows.project(v)
    if method == "nuclear":
        while s[-1] > lam and len(s) < size:  # all directions above the threshold, and no others
            s, v = lowrank.right_vectors(rows, 2 * len(s), seed)
        return rows.project(v * (solvers.shrink(s, lam) / np.maximum(s, 1e-12)), v.T)
    if method == "alternating":
        return rows.project(v, v.T)
    raise ValueError("unknown method")


def kmeans(points: DataFrame, k: int, seed: int = 0) -> tuple[DataFrame, np.ndarray]:
    """((ranking_id, label), centres) of (ranking_id, z)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = cut(points.select("ranking_id", array_to_vector("z").alias("features")))
    model = KMeans(k=k, seed=seed, maxIter=100).fit(x)
    out = model.transform(x).select("ranking_id", F.col("prediction").alias("label"))
    return out, np.array(model.clusterCenters())


def agglomerative(points: DataFrame, k: int, most: int = 2000) -> DataFrame:
    """(ranking_id, label) by average linkage, on the driver; ``most`` guards its quadratic memory."""
    rows = points.orderBy("ranking_id").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"agglomerative clustering takes {most} rows or fewer; use k-means")
    x = np.array([r.z for r in rows])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    size, label, live = np.ones(len(x)), np.arange(len(x)), len(x)
    while live > k:
        i, j = sorted(np.unravel_index(np.argmin(d), d.shape))
        new = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = new, new
        d[i, i], d[j], d[:, j] = np.inf, np.inf, np.inf
        size[i] += size[j]
        label[label == label[j]] = label[i]
        label[label == j] = i
        live -= 1
    names = {v: c for c, v in enumerate(dict.fromkeys(label.tolist()))}
    return points.sparkSession.createDataFrame([(r.ranking_id, names[int(v)]) for r, v in zip(rows, label, strict=True)], "ranking_id long, label int")


def spectral_clustering(embedding: DataFrame, size: int, k: int, method: str = "pca-scaled", algorithm: str = "k-means", lam: float = 1.0, seed: int = 0) -> DataFrame:
    """(ranking_id, label) of embedded rankings: low rank, then clusters."""
    z = low_rank(embedding, size, k, method, lam, seed)
    return kmeans(z, k, seed)[0] if algorithm == "k-means" else agglomerative(z, k)


def centres(embedding: DataFrame, labels: DataFrame, size: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean embedding of each cluster, cluster sizes)."""
    n = np.zeros(k)
    for r in labels.groupBy("label").count().collect():
        n[r.label] = r["count"]
    out = np.zeros((k, size))
    for r in embedding.join(labels, "ranking_id").groupBy("label", "k").agg(F.sum("x").alias("s")).collect():
        out[r.label, r.k] = r.s / n[r.label]
    return out, n


def heuristic_pair_weight(embedding: DataFrame, size: int, m: int, degree: int = 1, most: float = 1.0) -> np.ndarray:
    """Weight of each pair: |loadings| of the first ``degree`` principal components times explained variance, scaled."""
    rows = lowrank.Rows(embedding, size)
    mean, total = rows.moments(m)
    w, v = lowrank.leading(lambda x: rows.normal(x) / m - np.outer(mean, mean @ x), size, degree)
    out = (np.abs(v) * (np.maximum(w, 0) / max(total, 1e-300))).sum(axis=1)
    return out / out.max() * most if out.max() > 0 else out


def disjoint_pair_clustering(embedding: DataFrame, n: int, k: int, seed: int = 0) -> DataFrame:
    """Clusters on the pairs of a random perfect matching of items only."""
    order = np.random.default_rng(seed).permutation(n)
    index = lambda i, j: n * i - i * (i + 1) // 2 + (j - i - 1)
    keep = [index(*sorted((int(order[2 * a]), int(order[2 * a + 1])))) for a in range(n // 2)]
    some = embedding.where(F.col("k").isin(keep))
    return spectral_clustering(some, n * (n - 1) // 2, k, seed=seed)
