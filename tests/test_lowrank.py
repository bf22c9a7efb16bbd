import numpy as np
import pytest
from prefloom.operators import clustering, embeddings, lowrank
from prefloom.plans import solvers


def frame(spark, x):
    rows = [(i, int(k), float(r[k])) for i, r in enumerate(x) for k in np.flatnonzero(r)]
    return spark.createDataFrame(rows, "ranking_id long, k int, x double").repartition(3)


def same_space(a, b):
    """Sine of the largest angle between two column spaces."""
    return np.linalg.norm(a - b @ (b.T @ a), 2)


def sparse(m, d, share, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(m, d)) * (rng.random((m, d)) < share)
    x[:, :7] += np.outer(rng.normal(size=m), np.arange(min(d, 7)) + 1.0)
    return x


@pytest.mark.parametrize("m, d, k", [(40, 10, 3), (300, 60, 2), (5, 30, 4), (30, 3, 3), (50, 25, 25)])
def test_right_vectors_equal_dense(spark, m, d, k):
    x = sparse(m, d, 0.4)
    s, v = lowrank.right_vectors(lowrank.Rows(frame(spark, x), d, block=64), k)
    _, want, vt = np.linalg.svd(x, full_matrices=False)
    assert s == pytest.approx(np.concatenate([want, np.zeros(d)])[:k], abs=1e-9)
    live = min(k, (want > 1e-9).sum())
    assert same_space(v[:, :live], vt[:live].T) < 1e-6 and np.allclose(v.T @ v, np.eye(k), atol=1e-9)


def test_ties_and_rank_one(spark):
    x = np.kron(np.eye(6), np.ones((4, 2)))  # six equal values
    s, v = lowrank.right_vectors(lowrank.Rows(frame(spark, x), 12), 2)
    assert s == pytest.approx([np.sqrt(8)] * 2) and np.allclose(x.T @ (x @ v), 8 * v)
    one = np.outer(np.arange(1, 9.0), [1.0, 0, -2, 0, 3])
    s, _ = lowrank.right_vectors(lowrank.Rows(frame(spark, one), 5), 3)
    assert s == pytest.approx([np.linalg.norm(one), 0, 0], abs=1e-8)


def test_many_features(spark):
    """124,750 features (500 items): no square matrix of features, and the same space as a dense decomposition."""
    n, m = 500, 90
    rng = np.random.default_rng(1)
    u = np.stack([np.linspace(3, 0, n), rng.permutation(np.linspace(3, 0, n))])
    rows = []
    for r in range(m):
        some = rng.choice(n, 40, replace=False)
        best = some[np.argsort(-(u[r % 2][some] + rng.gumbel(size=40)))]
        rows += [(r, p, int(i)) for p, i in enumerate(best)]
    x = embeddings.pairwise(spark.createDataFrame(rows, "ranking_id long, pos int, item_id int"), n)
    d = n * (n - 1) // 2
    s, v = lowrank.right_vectors(lowrank.Rows(x, d), 2)
    dense = np.zeros((m, d), np.float64)
    for e in x.collect():
        dense[e.ranking_id, e.k] = e.x
    _, want, vt = np.linalg.svd(dense, full_matrices=False)
    assert s == pytest.approx(want[:2], rel=1e-9) and same_space(v, vt[:2].T) < 1e-6


def test_methods_equal_dense(spark):
    x = sparse(80, 12, 0.5, 3)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    got = {}
    for method in ("pca", "pca-scaled", "nuclear", "alternating"):
        rows = clustering.low_rank(frame(spark, x), 12, 2, method, lam=float(s[4])).collect()
        got[method] = np.array([r.z for r in sorted(rows)])
    assert np.allclose(np.abs(got["pca"]), np.abs(u[:, :2]), atol=1e-7)
    assert np.allclose(np.abs(got["pca-scaled"]), np.abs(u[:, :2] * s[:2]), atol=1e-7)
    assert np.allclose(got["nuclear"], solvers.nuclear(x, float(s[4])), atol=1e-7)
    assert np.allclose(got["alternating"], (u[:, :2] * s[:2]) @ vt[:2], atol=1e-7)


def test_pair_weights_equal_dense(spark):
    x = sparse(60, 9, 0.6, 5)
    cov = np.cov(x.T, bias=True)
    w, v = np.linalg.eigh(cov)
    want = np.abs(v[:, ::-1][:, :2]) @ (w[::-1][:2] / w.sum())
    got = clustering.heuristic_pair_weight(frame(spark, x), 9, 60, degree=2, most=2.0)
    assert got == pytest.approx(want / want.max() * 2)


def test_too_many_columns_are_refused(spark, monkeypatch):
    monkeypatch.setattr(lowrank, "CELLS", 10)
    with pytest.raises(ValueError, match="more than a task may hold"):
        lowrank.right_vectors(lowrank.Rows(frame(spark, np.eye(6)), 6), 2)
