"""Operator 11, centroid clustering: Lloyd rounds over integer vectors, exact to the last digit.

Components become integers floor(scale * x).  Squared distances come from |x|^2 - 2 x.c + |c|^2: one blocked
float64 matrix product for a block of rows and all centroids.  Rows and centroids whose components are small enough
that d (|x| + |c|)^2 stays below 2^53 give exact products; larger ones take 64-bit integers while these hold them,
and Python's integers beyond.  Each task sums its own rows by cluster, and a tree aggregation adds the sums, so that
the driver is given (clusters x components) numbers, whatever the table's size.  Vectors are read once a round and
never shuffled.

Defined results: only vectors of exactly ``dims`` components, none null or non-finite, are kept; others give no row
(a null or empty vector among them).  Rows that repeat are vectors of their own; a null vec_id counts as an empty text
in the hash; vectors that share a vec_id start in the order of their components.  Fewer kept vectors than clusters
make fewer clusters; an empty table gives none.  Components of any size are exact; a distance or inertia beyond a
long is given as the greatest long.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K = 16
DIMS = 64
ROUNDS = 3
SCALE = 64
SEED = 1
#: rows of one matrix product
BLOCK = 4096
LONGEST = (1 << 63) - 1
OUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def limits(dims: int) -> tuple[int, int]:
    """The greatest magnitudes for which d (2 m)^2 stays below 2^53, and below 2^63."""
    return math.isqrt(((1 << 53) - 1) // dims) // 2, math.isqrt(LONGEST // dims) // 2


def tiers(x: np.ndarray, dims: int) -> np.ndarray:
    """0, 1 or 2 a row: exact in float64, in 64-bit integers, in Python's integers only."""
    if not len(x):
        return np.empty(0, np.int64)
    low, high = limits(dims)
    most = np.maximum(x.max(axis=1), -x.min(axis=1))
    return (most > low).astype(np.int64) + (most > high)


def whole(x: np.ndarray, scale: int) -> list[np.ndarray]:
    """floor(scale * x) of finite doubles, as (int64 rows, Python-integer rows) with their places: [at, values] twice."""
    wide = (np.abs(x) >= 2.0**62 / scale).any(axis=1)
    at, far = np.flatnonzero(~wide), np.flatnonzero(wide)
    small = np.floor(x[at] * scale).astype(np.int64)
    large = np.empty((len(far), x.shape[1]), object)
    for i, row in enumerate(x[far].tolist()):
        large[i] = [exact_floor(v, scale) for v in row]
    return [at, small, far, large]


def exact_floor(v: float, scale: int) -> int:
    over, under = v.as_integer_ratio()
    return over * scale // under


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of one tier (int64 or objects) to the centroids (objects)."""
    dims = c.shape[1]
    row_tier, col_tier = int(tiers(x, dims).max(initial=0)), tiers(c, dims)
    out = np.empty((len(x), len(c)), object if max(row_tier, int(col_tier.max(initial=0))) == 2 else np.int64)
    for t in np.unique(np.maximum(col_tier, row_tier)):
        cols = np.flatnonzero(np.maximum(col_tier, row_tier) == t)
        if t == 0:
            a, b = x.astype(np.float64), c[cols].astype(np.float64)
            out[:, cols] = ((a * a).sum(axis=1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)
            continue
        kind = np.int64 if t == 1 else object
        a = x.astype(kind)
        for j in cols:
            gap = a - c[j].astype(kind)
            out[:, j] = (gap * gap).sum(axis=1)
    return out


def blocks(batches: Iterator[pa.RecordBatch], dims: int, scale: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, integer rows) of the kept vectors, in blocks whose rows share a tier."""
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK):
            part = batch.slice(lo, BLOCK)
            ids, x = kept(part, dims)
            at, small, far, large = whole(x, scale)
            for where, rows in ((at, small), (far, large)):
                level = tiers(rows, dims)
                for t in np.unique(level):
                    own = np.flatnonzero(level == t)
                    yield ids.take(pa.array(where[own])), rows[own]


def kept(batch: pa.RecordBatch, dims: int) -> tuple[pa.Array, np.ndarray]:
    """Ids and components of the vectors that have ``dims`` finite components."""
    ids, lists = batch.column(0), batch.column(1)
    sizes = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(sizes == dims)
    flat = lists.take(pa.array(at)).flatten()
    x = flat.cast(pa.float64()).fill_null(math.nan).to_numpy(zero_copy_only=False).reshape(len(at), dims)
    good = np.isfinite(x).all(axis=1)
    return ids.take(pa.array(at[good])), x[good]


def first_centroids(vectors: DataFrame, k: int, dims: int, scale: int, seed: int) -> np.ndarray:
    """The k kept vectors of least hash; each task passes on k of its own at most."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = kept(b, dims)
            yield pa.RecordBatch.from_arrays([ids, pa.FixedSizeListArray.from_arrays(x.ravel(), dims).cast(pa.list_(pa.float64()))], ["vec_id", "x"])

    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.mapInArrow(clean, "vec_id long, x array<double>").select(named.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    out = np.empty((len(rows), dims), object)
    for i, r in enumerate(sorted(rows, key=lambda r: (r["h"], r["x"]))):
        out[i] = [exact_floor(v, scale) for v in r["x"]]
    return out


def assigned(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row (ties: smaller number), and the distance to it."""
    d = distances(x, c)
    at = d.argmin(axis=1).astype(np.int64)
    return at, d[np.arange(len(x)), at]


def totals(vectors: DataFrame, c: np.ndarray, dims: int, scale: int) -> dict[int, list[int]]:
    """cluster: [count, inertia, sum of each component] under the centroids ``c``, all exact."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, inertia = [0] * len(c), [0] * len(c)
        sums = np.zeros(c.shape, object)
        for _, x in blocks(batches, dims, scale):
            at, d = assigned(x, c)
            if x.dtype != object and tiers(x, dims).max(initial=0) == 0:  # a block's sums stay far below 2^53
                member = np.zeros((len(c), len(x)))
                member[at, np.arange(len(x))] = 1.0
                sums += (member @ x.astype(np.float64)).astype(np.int64).astype(object)
            else:
                for j in np.unique(at):
                    sums[j] += x[at == j].astype(object).sum(axis=0)
            for j in np.unique(at):
                own = at == j
                n[j] += int(own.sum())
                inertia[j] += int(d[own].astype(object).sum())
        had = [j for j in range(len(c)) if n[j]]
        rows = [[str(n[j]), str(inertia[j]), *map(str, sums[j])] for j in had]
        yield pa.RecordBatch.from_arrays([pa.array(had, pa.int32()), pa.array(rows, pa.list_(pa.string()))], ["cluster", "sums"])

    def add(held: dict, row) -> dict:
        return join(held, {row["cluster"]: [int(v) for v in row["sums"]]})

    def join(a: dict, b: dict) -> dict:
        for j, v in b.items():
            a[j] = [s + t for s, t in zip(a[j], v, strict=True)] if j in a else v
        return a

    return vectors.mapInArrow(work, "cluster int, sums array<string>").rdd.treeAggregate({}, add, join)


def cluster(vectors: DataFrame, k: int = K, dims: int = DIMS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """Each kept vector's cluster after ``rounds`` rounds, its squared distance, the inertias, and its centroid's hash."""
    spark = vectors.sparkSession
    vectors = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    c = first_centroids(vectors, k, dims, scale, seed)
    if not len(c):
        return spark.createDataFrame([], OUT)
    for _ in range(rounds):
        for j, (n, _, *sums) in totals(vectors, c, dims, scale).items():
            c[j] = [s // n for s in sums]
    found = totals(vectors, c, dims, scale)
    own = np.array([min(LONGEST, found[j][1]) if j in found else 0 for j in range(len(c))], np.int64)
    inertia = min(LONGEST, sum(v[1] for v in found.values()))
    names = np.array([hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c], object)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in blocks(batches, dims, scale):
            at, d = assigned(x, c)
            if d.dtype == object:
                d = np.array([min(LONGEST, v) for v in d], np.int64)
            cols = [ids, pa.array(at, pa.int32()), pa.array(d, pa.int64()), pa.array(own[at]), pa.array(np.full(len(at), inertia, np.int64)), pa.array(names[at], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in OUT.split(", ")])

    return vectors.mapInArrow(work, OUT)
