"""Operator 10, SimHash near-duplicates by vantage-point trees.

A document's fingerprint has the bits that are set in over half of its shingles' XXH64 hashes.  Two
fingerprints are linked when at most R bits differ.  Equal fingerprints are one point; the distinct ones are
searched exactly by a forest of vantage-point trees:

*Trees.*  The 64 bits are cut into ``BLOCKS`` runs; a tree measures the Hamming distance on its own run.  Two
fingerprints within R bits differ by at most b = R // BLOCKS bits on one of the runs, and there the triangle
bound |d(x, v) - d(y, v)| <= d(x, y) <= b holds for every vantage point v.  A node has a vantage point and a
radius, both chosen on a sample of fingerprints (``forest``): what lies within the radius goes to one
side, the rest to the other, and what lies within b of the radius goes to a boundary shard as well, which is
asked for the pairs that the split parts.  No other branch can hold a partner.

*Shards.*  Leaves are dealt to tasks, which carry the same tree on in memory, down to buckets that are compared
pair by pair.  Points that no split tells apart (a dense group) are compared with pivots and the triangle bound
on all 64 bits; a dense leaf is dealt in pieces, two of which meet in each task.  Each shard returns a spanning
forest of its links, never all pairs; components come from distributed star contraction.

One tree on all 64 bits (BLOCKS = 1, b = 4) finds the same pairs, but unlike texts lie 32 +- 4 bits from any
vantage point, so that some 70 % of the points fall into the boundary of each split.  With three runs it is a
third: see ``visited`` and the README for measured shares.

Defined results: null, empty and word-free texts have fingerprint zero; repeated rows are linked to each
other; ties cannot arise, as links and least ids are unique; texts of any length are read whole; an empty table
gives none; other columns are ignored; ids pass through untouched, and a component of null ids only has none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, component_ids, connected, cut, mix64, release, rolling

SHINGLE = 4
RADIUS = 4
SEED = 42
BITS = 64
BLOCKS = 3
#: fingerprints that choose vantage points and radii, at least; fingerprints that stand behind a sampled one, at most (so
#: that leaves, and with them shards, stay as large however many there are); fingerprints a shard should hold; least
#: sampled ones of a leaf
SAMPLE, BEHIND, SHARD, LEAST = 16384, 1 << 16, 8192, 16
#: points of a bucket that are compared pair by pair, vantage points tried for a split, and points dealt at a time
BUCKET, TRIES, CHUNK = 128, 6, 1 << 16


def fingerprint(text: str | None, n: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits as an unsigned number."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    m = max(1, len(words) - n + 1)
    digest = xxhash.xxh64_intdigest
    last = ends[n - 1 :] if len(words) >= n else ends[-1:]
    h = np.fromiter([digest(whole[a:b], seed) for a, b in zip(starts[:m].tolist(), last.tolist(), strict=True)], np.uint64, m)
    return majority(h)


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, n, seed) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, fp long")


# -- vantage-point trees ---------------------------------------------------------------------------------------------


def runs(blocks: int) -> list[int]:
    """Masks of ``blocks`` runs of bits."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]


def distance(x: np.ndarray, v: int, mask: int) -> np.ndarray:
    return np.bitwise_count((x ^ np.uint64(v)) & np.uint64(mask)).astype(np.int16)


def split(x: np.ndarray, mask: int, bound: int, seed: int = 0) -> tuple[int, int] | None:
    """The vantage point and radius, of some tried, that leave the fewest pairs; none if no split saves a tenth of them."""
    tried = x[(mix64(np.arange(TRIES, dtype=np.uint64) + np.uint64(seed)) % np.uint64(len(x))).astype(np.int64)]
    best = (0.9 * len(x) ** 2, None)
    for v in np.unique(tried).tolist():
        n = np.cumsum(np.bincount(distance(x, v, mask), minlength=BITS + 1)).astype(np.float64)  # points up to a distance
        r = np.arange(BITS)
        edge = n[np.minimum(r + bound, BITS)] - np.where(r >= bound, n[np.maximum(r - bound, 0)], 0)
        cost = n[r] ** 2 + (len(x) - n[r]) ** 2 + (edge**2 if bound else 0)
        k = int(cost.argmin())
        if cost[k] < best[0]:
            best = (cost[k], (v, k))
    return best[1]


def sides(d: np.ndarray, radius: int, bound: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which points lie within the radius, beyond it, and within the bound of it on either side."""
    inside = d <= radius
    return inside, ~inside, (d > radius - bound) & (d <= radius + bound)


class Tree:
    """Nodes in arrays: vantage point, radius and three children; a negative child -1 - k is leaf k."""

    def __init__(self, sample: np.ndarray, mask: int, bound: int, scale: float, shard: int):
        """``scale`` points stand behind each sampled one."""
        self.mask, self.bound = mask, bound
        self.vantage, self.radius, self.children, self.pieces = [], [], [], []
        least = max(LEAST, shard / max(scale, 1e-9))
        self.top = self.grow(sample, least, scale, shard)

    def grow(self, x: np.ndarray, least: float, scale: float, shard: int) -> int:
        cut = split(x, self.mask, self.bound, len(self.vantage)) if len(x) > least else None
        if cut is None:
            self.pieces.append(max(1, int(np.ceil(len(x) * scale / (4 * shard)))) if len(x) > least else 1)
            return -len(self.pieces)
        node = len(self.vantage)
        self.vantage.append(cut[0])
        self.radius.append(cut[1])
        self.children.append(None)
        parts = sides(distance(x, cut[0], self.mask), cut[1], self.bound)
        self.children[node] = tuple(self.grow(x[p], least, scale, shard) for p in parts[: 3 if self.bound else 2])
        return node

    def deal(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(shard, places of the points that go there); a leaf of k pieces is k (k + 1) / 2 shards."""
        first = np.cumsum([0, *(k * (k + 1) // 2 for k in self.pieces)])
        todo = [(self.top, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            if node >= 0:
                parts = sides(distance(x[at], self.vantage[node], self.mask), self.radius[node], self.bound)
                todo += [(c, at[p]) for c, p in zip(self.children[node], parts) if p.any()]
                continue
            k, base = self.pieces[-1 - node], int(first[-1 - node])
            piece = (mix64(x[at]) % np.uint64(k)).astype(np.int64)
            for i in range(k):
                for j in range(i, k):
                    some = at[(piece == i) | (piece == j)]
                    if len(some):
                        yield base + j * (j + 1) // 2 + i, some


def shard_links(x: np.ndarray, mask: int = -1, bound: int = RADIUS, radius: int = RADIUS, seen: list[int] | None = None) -> list[tuple[int, int]]:
    """Links (as pairs of places) that connect what is connected within ``radius`` and ``bound`` on the mask's bits.

    The tree goes on until buckets are small.  ``seen`` gathers the number of comparisons.
    """
    mask &= (1 << BITS) - 1
    out: list[tuple[int, int]] = []
    root = np.arange(len(x))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return int(i)

    def join(i: int, j: int) -> None:
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((int(i), int(j)))

    def count(n: int) -> None:
        if seen is not None:
            seen.append(n)

    todo = [np.arange(len(x))]
    while todo:
        at = todo.pop()
        if len(at) < 2:
            continue
        if len(at) <= BUCKET:
            count(len(at) * (len(at) - 1) // 2)
            i, j = np.nonzero(np.triu(np.bitwise_count(x[at][:, None] ^ x[at][None, :]) <= radius, 1))
            for a, b in zip(at[i].tolist(), at[j].tolist()):
                join(a, b)
            continue
        cut = split(x[at], mask, bound, len(todo))
        if cut is None:
            dense(x, at, radius, find, join, count)
            continue
        count(len(at))
        todo += [at[p] for p in sides(distance(x[at], cut[0], mask), cut[1], bound)[: 3 if bound else 2]]
    return out


def dense(x: np.ndarray, at: np.ndarray, radius: int, find, join, count) -> None:
    """A group that no split tells apart: pivots, whose neighbours are linked to them at once.

    Two pivots' sets are compared only where the triangle bound allows a link, d(p, q) <= r_p + r_q + R, only by
    the members on the facing boundary, and not if they are linked already.
    """
    pivots, members, reach, free = [], [], [], at
    while len(free):
        d = np.bitwise_count(x[free] ^ x[free[0]])
        count(len(free))
        near = d <= radius
        pivots.append(int(free[0]))
        members.append(free[near])
        reach.append(int(d[near].max()))
        for j in free[near][1:].tolist():
            join(pivots[-1], j)
        free = free[~near]
    p, r = x[np.array(pivots)], np.array(reach)
    for a in range(len(pivots) - 1):
        between = np.bitwise_count(p[a + 1 :] ^ p[a]).astype(np.int64)
        count(len(between))
        for b in (a + 1 + np.flatnonzero(between <= r[a] + r[a + 1 :] + radius)).tolist():
            if find(pivots[a]) == find(pivots[b]):
                continue
            u = members[a][np.bitwise_count(x[members[a]] ^ p[b]) <= r[b] + radius]
            v = members[b][np.bitwise_count(x[members[b]] ^ p[a]) <= r[a] + radius]
            count(len(members[a]) + len(members[b]))
            if len(u) > len(v):
                u, v = v, u
            for i in u.tolist() if len(v) else ():
                count(len(v))
                hit = np.flatnonzero(np.bitwise_count(x[v] ^ x[i]) <= radius)
                if len(hit):
                    join(i, int(v[hit[0]]))
                    break


def forest(points: DataFrame, count: int, radius: int = RADIUS, blocks: int = BLOCKS, shard: int = SHARD) -> list[Tree]:
    """The trees, from a sample of the distinct ``fp``: some ``SAMPLE`` of them, or one of ``BEHIND`` where that is more.

    The sample is 8 bytes a fingerprint on the driver: 12 MB of 10^11.
    """
    share = min(1.0, max(SAMPLE / max(1, count), 1 / BEHIND))
    some = points.select("fp").where(F.pmod(F.xxhash64(F.lit(SEED), "fp"), F.lit(1 << 30)) <= int(share * (1 << 30)))
    sample = np.sort(np.array([r.fp for r in some.collect()], np.int64).view(np.uint64))
    return [Tree(sample, m, radius // blocks, count / max(1, len(sample)), shard) for m in runs(blocks)]


def links(points: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, shard: int = SHARD) -> DataFrame:
    """(u, v) links among the distinct ``fp`` of ``points`` that keep every component whole."""
    shared = points.sparkSession.sparkContext.broadcast(forest(points, points.count(), radius, blocks, shard))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def dealt(x: np.ndarray) -> Iterator[pa.RecordBatch]:
            for no, tree in enumerate(shared.value):
                some = list(tree.deal(x))
                ids = np.repeat(np.array([no << 48 | s for s, _ in some], np.int64), [len(at) for _, at in some])
                fps = x[np.concatenate([at for _, at in some])].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(fps)], ["shard", "fp"])

        held, size = [], 0
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(x), CHUNK):
                held.append(x[i : i + CHUNK])
                size += len(held[-1])
                if size >= CHUNK:
                    yield from dealt(np.concatenate(held))
                    held, size = [], 0
        if size:
            yield from dealt(np.concatenate(held))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(one: int, fps: np.ndarray) -> pa.RecordBatch:
            tree = shared.value[one >> 48]
            found = np.array(shard_links(fps.view(np.uint64), tree.mask, tree.bound, radius), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(fps[found[:, 0]]), pa.array(fps[found[:, 1]])], ["u", "v"])

        for one, (fps,) in lists(batches):
            if len(fps) > 1:
                yield solve(one, fps)

    keyed = points.select("fp").mapInArrow(deal, "shard long, fp long").repartition("shard").sortWithinPartitions("shard", "fp")
    return keyed.mapInArrow(work, "u long, v long")


def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """(key, its rows' other columns) one after another, from batches that are sorted by their first column."""
    held: list[tuple[np.ndarray, ...]] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        at = np.concatenate(([0], np.flatnonzero(cols[0][1:] != cols[0][:-1]) + 1, [len(cols[0])]))
        for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
            if held and held[0][0][0] != cols[0][i]:
                yield int(held[0][0][0]), tuple(np.concatenate(x) for x in zip(*held))[1:]
                held = []
            held.append(tuple(c[i:j] for c in cols))
    if held:
        yield int(held[0][0][0]), tuple(np.concatenate(x) for x in zip(*held))[1:]


def near_duplicates(docs: DataFrame, radius: int = RADIUS, n: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id: the least doc_id that links reach."""
    fps = cut(fingerprints(docs, n, seed))
    points = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    named = component_ids(points, links(points, radius), "fp", "least")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# -- the pipeline's stage: SimHash links and shingle prefixes propose, shingle sets confirm ------------------------------

SIMILARITY = 0.8
STAGE_SHINGLE = 5
#: documents from which common shingles are told, and in how many of them a common one is
COMMON_SAMPLE, COMMON = 8192, 8
#: lists of up to so many sets are compared pair by pair, longer ones with a pivot and then in pieces of so many sets
CROWD, PIECE = 32, 4096
#: sets, and bytes of sets, of a piece of pairs that are confirmed together
CELL_SETS, CELL_BYTES = 1024, 1 << 24
#: bits of a set's parities for each shingle, and least and most of them (powers of two); how many of these are one coarse bit
PARITY_EACH, PARITY, PARITY_MOST, COARSE = 4, 2048, 1 << 18, 4
#: pairs or ids that are handed to tasks rather than shuffled
SMALL = 1 << 20
#: each Python worker's memory of words
WORDS = WordHash()


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    return rolling(WORDS.array(words), min(n, len(words))) if words else np.empty(0, np.uint64)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Distinct hashes of a text's shingles, ascending."""
    return np.unique(shingle_hashes(text, n))


def set_key(s: np.ndarray) -> int:
    """A shingle set's name: 64 bits as a signed number; zero for the empty set."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).astype(np.int64)) if len(s) else 0


def is_in(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    return common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s if len(common) else np.zeros(len(s), bool)


def prefix(s: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles in one order for all sets (common ones last): two sets alike enough share one of these."""
    s = s[np.argsort(is_in(s, common), kind="stable")]
    return s[: len(s) - int(np.ceil(similarity * len(s) - 1e-9)) + 1] if len(s) else s


def parities(s: np.ndarray) -> bytes:
    """Whether each class of shingles has an odd number in the set: two sets differ in as many shingles at least as in bits."""
    size = min(PARITY_MOST, max(PARITY, PARITY_EACH << len(s).bit_length()))
    return np.packbits(np.bincount((s >> np.uint64(20)).astype(np.int64) % size, minlength=size) & 1).tobytes()


def fold(bits: bytes, size: int) -> np.ndarray:
    """Parities over fewer classes (``size`` bytes)."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint8).reshape(-1, size))


def least_difference(a: bytes, b: bytes) -> int:
    size = min(len(a), len(b))
    return int(np.bitwise_count(fold(a, size) ^ fold(b, size)).sum())


def pack_bits(bits: bytes) -> bytes:
    """Parities are sparse: a text of few shingles sets few of the least number of bits."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(bits)


def unpack_bits(blob: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(blob)


def common_shingles(docs: DataFrame, n: int) -> np.ndarray:
    """Hashes (sorted) of shingles that many texts hold, from a bounded sample; they set the order, not the result."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = np.concatenate([shingle_set(t, n) for t in b.column(0).to_pylist()] or [np.empty(0, np.uint64)])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    some = docs.select("text").where("text is not null").sample(min(1.0, COMMON_SAMPLE / max(1, docs.count())), seed=SEED).distinct()
    rows = some.mapInArrow(work, "h long").groupBy("h").count().where(F.col("count") >= COMMON).select("h").toPandas()
    return np.sort(rows["h"].to_numpy(np.int64).view(np.uint64))


def named_sets(docs: DataFrame, n: int) -> DataFrame:
    """A row for each document: doc_id, a hash of its text, and its shingle set's key, size, parities and fingerprint."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = [shingle_hashes(t, n) for t in b.column(2).to_pylist()]
            sets = [np.unique(h) for h in hashes]
            bits = [parities(s) for s in sets]
            cols = [
                pa.array([set_key(s) for s in sets], pa.int64()),
                pa.array([len(s) for s in sets], pa.int32()),
                pa.array([pack_bits(x) for x in bits], pa.binary()),
                pa.array([fold(x, len(x) // COARSE).tobytes() for x in bits], pa.binary()),
                pa.array(np.array([majority(h) for h in hashes], np.uint64).view(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["doc_id", "text_hash", "key", "size", "bits", "coarse", "fp"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(work, "doc_id long, text_hash long, key long, size int, bits binary, coarse binary, fp long")


def candidates(docs: DataFrame, n: int, common: np.ndarray, similarity: float) -> DataFrame:
    """(h, u, v): pairs of sets that share a prefix shingle, with h null; a crowded shingle h's sets as u, with v null.

    A task posts a set once, whatever the number of its copies.  Common shingles are crowded without a count: their
    postings are dealt by set, so that no shingle gathers a large share of the sets in one task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common)
    kind = "part long, h long, key long, size int, place int"

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            h, key, size = [], [], []
            for text in b.column(0).to_pylist():
                s = shingle_set(text, n)
                k = set_key(s)
                if len(s) and k not in seen:
                    seen.add(k)
                    h.append(prefix(s, shared.value, similarity))
                    key.append(k)
                    size.append(len(s))
            if not h:
                continue
            many = np.array([len(x) for x in h])
            h = np.concatenate(h)
            key, size = np.repeat(np.array(key, np.int64), many), np.repeat(np.array(size, np.int32), many)
            place = np.concatenate([np.arange(n, dtype=np.int32) for n in many])
            crowd = is_in(h, shared.value)
            part = np.where(crowd, mix64(key.view(np.uint64)) | np.uint64(1), h & ~np.uint64(1))  # even parts are lists
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (part.view(np.int64), h.view(np.int64), key, size, place)], ["part", "h", "key", "size", "place"])

    def record(u: np.ndarray, v: np.ndarray, h: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        """Pairs (u, v), then crowded postings (h, key)."""
        empty = lambda n: pa.nulls(n, pa.int64())
        low, high = np.minimum(u, v), np.maximum(u, v)
        cols = [pa.concat_arrays([empty(len(u)), pa.array(h)]), pa.concat_arrays([pa.array(low), pa.array(key)]), pa.concat_arrays([pa.array(high), empty(len(h))])]
        return pa.RecordBatch.from_arrays(cols, ["h", "u", "v"])

    def solve(h: np.ndarray, key: np.ndarray, size: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        """Lists of one batch, sorted by (h, key).

        A pair's first shared shingle, in the order of all sets, has all that they share at its place and after it; if
        less is left there than alike sets share, the pair goes.  It need not pass at its later shared shingles.
        """
        one = np.append(True, (h[1:] != h[:-1]) | (key[1:] != key[:-1]))  # tasks may have posted copies of a set
        h, key, size, place = h[one], key[one], size[one].astype(np.int64), place[one]
        start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        length = np.diff(np.append(start, len(h)))
        us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for c in np.unique(length[(length > 1) & (length <= CROWD)]):
            i, j = np.triu_indices(c, 1)
            i, j = ((start[length == c][:, None] + x).ravel() for x in (i, j))
            ok = np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-9
            most = np.minimum(size[i] - place[i], size[j] - place[j])
            ok &= most * (1 + similarity) >= similarity * (size[i] + size[j]) - 1e-6
            us.append(key[i[ok]])
            vs.append(key[j[ok]])
        crowd = np.repeat(length > CROWD, length)
        return record(np.concatenate(us), np.concatenate(vs), h[crowd], key[crowd])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        held: list[tuple[np.ndarray, ...]] = []  # the end of what was read: its last list may go on
        crowded = None  # a long list that was passed on in part
        for b in batches:
            part, h, key, size, place = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            lone = (part & 1) == 1
            if lone.any():
                yield record(none, none, h[lone], key[lone])
            h, key, size, place = h[~lone], key[~lone], size[~lone], place[~lone]
            if crowded is not None:
                more = h == crowded
                yield record(none, none, h[more], key[more])
                h, key, size, place = h[~more], key[~more], size[~more], place[~more]
            if not len(h):
                continue
            crowded = None
            held.append((h, key, size, place))
            now = tuple(np.concatenate(x) for x in zip(*held))
            first = len(now[0]) - int(np.argmax((now[0] != now[0][-1])[::-1])) if (now[0] != now[0][-1]).any() else 0
            if first:
                yield solve(*(x[:first] for x in now))
            held = [tuple(x[first:] for x in now)]
            if len(held[0][0]) > 1 << 16:
                crowded = int(held[0][0][0])
                yield record(none, none, *held[0][:2])
                held = []
        if held:
            yield solve(*(np.concatenate(x) for x in zip(*held)))

    dealt = docs.select("text").mapInArrow(spread, kind).repartition("part").sortWithinPartitions("part", "h", "key")
    return dealt.mapInArrow(work, "h long, u long, v long").distinct()


def possible(pairs: DataFrame, points: DataFrame, similarity: float) -> DataFrame:
    """The (u, v) whose parities (key, size, bits, coarse) don't rule out that the sets are alike enough: coarse ones first."""

    def check(read):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                u, v, nu, nv = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
                differ = np.fromiter((least_difference(read(x), read(y)) for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist())), np.int64, len(u))
                ok = differ <= (1 - similarity) / (1 + similarity) * (nu.astype(np.int64) + nv) + 1e-6
                yield pa.RecordBatch.from_arrays([pa.array(u[ok]), pa.array(v[ok])], ["u", "v"])

        return work

    for column, read in (("coarse", bytes), ("bits", unpack_bits)):
        bits = points.select("key", "size", column)
        both = pairs.join(bits.toDF("u", "nu", "bu"), "u").join(bits.toDF("v", "nv", "bv"), "v")
        pairs = both.select("u", "v", "nu", "nv", "bu", "bv").mapInArrow(check(read), "u long, v long")
    return pairs


def confirmed(pairs: DataFrame, docs: DataFrame, named: DataFrame, points: DataFrame, similarity: float, n: int) -> DataFrame:
    """Links (u, v) that connect what the ``pairs`` (written, distinct) of enough exact Jaccard likeness connect.

    Pairs that hang together meet in cells of two pieces, each of a bounded number and size of sets.  A set goes to a
    cell once, however many pairs it has there; what links have joined in a cell is not compared again.
    """
    parts = cut(connected(pairs).join(points.select(F.col("key").alias("node"), "size"), "node"))
    pieces = F.ceil(F.greatest(F.count("*") / CELL_SETS, F.sum("size") * 8 / CELL_BYTES)).cast("int")
    wide = cut(parts.groupBy("root").agg(pieces.alias("k")))
    placed = cut(parts.join(wide, "root").select("node", "root", F.pmod(F.xxhash64("node"), "k").alias("piece")))
    both = pairs.join(placed.toDF("u", "root", "pu"), "u").join(placed.select(F.col("node").alias("v"), F.col("piece").alias("pv")), "v")
    cells = cut(both.select(F.xxhash64("root", F.least("pu", "pv"), F.greatest("pu", "pv")).alias("cell"), "u", "v"))
    wanted = cut(cells.select("cell", F.col("u").alias("key")).union(cells.select("cell", "v")).distinct())
    hand = F.broadcast if wanted.count() <= SMALL else lambda x: x
    sets = sets_of(docs, placed.select(F.col("node").alias("key")), named, n).join(hand(wanted), "key")
    dealt = sets.select("cell", F.lit(0).alias("pair"), F.col("key").alias("u"), F.lit(0).cast("long").alias("v"), "s")
    asked = cells.select("cell", F.lit(1).alias("pair"), "u", "v", F.lit(b"").alias("s"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (pair, u, v, s) in lists(batches):
            first = int(np.searchsorted(pair, 1))
            held = {k: np.frombuffer(x, np.uint64) if x else np.empty(0, np.uint64) for k, x in zip(u[:first].tolist(), s[:first])}
            root = {k: k for k in held}

            def find(k: int) -> int:
                while root[k] != k:
                    root[k] = root[root[k]]
                    k = root[k]
                return k

            found = []
            for i, j in zip(u[first:].tolist(), v[first:].tolist()):
                a, b = find(i), find(j)
                if a == b:
                    continue
                x, y = held[i], held[j]
                same = len(np.intersect1d(x, y, assume_unique=True))
                if same >= similarity * (len(x) + len(y) - same) - 1e-9:
                    root[max(a, b)] = min(a, b)
                    found.append((i, j))
            links = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["u", "v"])

    return dealt.union(asked).repartition("cell").sortWithinPartitions("cell", "pair", "u", "v").mapInArrow(work, "u long, v long")


def crowd_pairs(crowd: DataFrame, points: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """(u, v) within the lists (h, key) of sets of different components whose parities don't rule out a link.

    A list's largest component is met by all other sets, once for all lists that have the same largest component; the
    others meet each other list by list.  Both are dealt in pieces of about ``PIECE`` sets, two of which meet in a task,
    so that lists that are one component and a few others cost no more than that component's length.  A set brings all
    its parities to a task, so that no pair travels before it has passed them: coarse ones, those all sets have, then
    all that both sets have.
    """
    rooted = cut(crowd.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")))
    parts = rooted.groupBy("h", "root").agg(F.count("*").alias("n"))
    most = parts.groupBy("h").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("of")).where("of > 1")
    pieces = lambda n: F.greatest(F.ceil(n / PIECE), F.lit(1)).cast("int")
    held = cut(most.select("h", F.col("top.root").alias("top"), pieces(F.col("n") - F.col("top.n")).alias("l"), "of"))
    met = rooted.join(held, "h")
    own = lambda n: F.pmod(F.xxhash64("key"), n).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    cell = lambda of, i, j: F.xxhash64(F.lit(of), F.col(of), i, j)
    sides = cut(met.select("top", "key", "root").distinct().withColumn("large", F.col("root") == F.col("top")))
    wide = cut(sides.groupBy("top").agg(pieces(F.count(F.when(F.col("large"), 1))).alias("k"), pieces(F.count(F.when(~F.col("large"), 1))).alias("l")))
    k, n = F.col("k"), F.col("l")
    across = F.when(F.col("large"), F.transform(upto(n), lambda j: cell("top", own(k), j))).otherwise(F.transform(upto(k), lambda i: cell("top", i, own(n))))
    among = F.transform(upto(n), lambda j: cell("h", F.least(own(n), j), F.greatest(own(n), j)))
    rest = met.where("root <> top and of > 2").withColumn("large", F.lit(False))
    dealt = sides.join(wide, "top").select("key", "root", "large", F.explode(across).alias("list")).union(rest.select("key", "root", "large", F.explode(among)))
    listed = dealt.join(points.select("key", "size", "bits"), "key").select("list", "large", "root", "key", "size", "bits")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = (1 - similarity) / (1 + similarity)
        for _, (large, root, key, size, blobs) in lists(batches):
            large = large.astype(bool)
            order = np.lexsort((root, ~large))  # the largest component first, if it is here
            root, key, size, blobs = root[order], key[order], size[order].astype(np.int32), blobs[order]
            fine = np.stack([fold(unpack_bits(x), PARITY // 8) for x in blobs]).view(np.uint64)
            coarse = np.bitwise_xor.reduce(fine.reshape(len(key), COARSE, -1), axis=1)
            wide = lru_cache(maxsize=1024)(lambda i, blobs=blobs: unpack_bits(blobs[i]))
            start = np.flatnonzero(np.append(True, root[1:] != root[:-1]))
            end, step = np.append(start[1:], len(root)), max(1, (1 << 18) // len(root))  # bounds the memory of a long list
            for a, b in list(zip(start.tolist(), end.tolist()))[: 1 if large.any() else None]:
                for i in range(a, b, step):
                    j = min(b, i + step)
                    most = share * (size[i:j, None] + size[None, b:]) + 1e-6
                    differ = np.zeros((j - i, len(root) - b), np.int32)
                    for w in range(coarse.shape[1]):
                        differ += np.bitwise_count(coarse[i:j, None, w] ^ coarse[None, b:, w])
                    x, y = np.nonzero(differ <= most)
                    most, x, y = most[x, y], x + i, y + b
                    differ = np.zeros(len(x), np.int32)
                    for w in range(fine.shape[1]):
                        differ += np.bitwise_count(fine[x, w] ^ fine[y, w])
                    ok = differ <= most
                    for k in np.flatnonzero(ok & (np.minimum(size[x], size[y]) >= PARITY // PARITY_EACH)):
                        ok[k] = least_difference(wide(int(x[k])), wide(int(y[k]))) <= most[k]
                    if ok.any():
                        u, v = key[x[ok]], key[y[ok]]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

    return listed.repartition("list").sortWithinPartitions("list", "key").mapInArrow(work, "u long, v long").distinct()


def sets_of(docs: DataFrame, keys: DataFrame, named: DataFrame, n: int) -> DataFrame:
    """(key, s): the shingle sets of some keys (written, distinct), each from one of the documents that have it.

    Where rows repeat, each task that holds some gives the set once.
    """
    at = F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("doc_id"), F.col("text_hash").alias("text_hash"))
    ids = named.select("key", "doc_id", "text_hash").join(keys, "key").groupBy("key").agg(F.min(at).alias("at")).select("at.doc_id", "at.text_hash").distinct()
    if keys.count() <= SMALL:
        ids = F.broadcast(ids)

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            sets = {set_key(s): s for s in (shingle_set(t, n) for t in b.column(0).to_pylist())}
            new = [k for k in sets if k not in seen]
            seen.update(new)
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.int64()), pa.array([sets[k].tobytes() for k in new], pa.binary())], ["key", "s"])

    d = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    texts = d.join(ids, d["doc_id"].eqNullSafe(ids["doc_id"]) & (d["text_hash"] == ids["text_hash"]), "left_semi")
    return texts.select("text").mapInArrow(shingles, "key long, s binary")


def set_links(docs: DataFrame, named: DataFrame, points: DataFrame, similarity: float, n: int) -> DataFrame:
    """Confirmed (u, v) among keys that connect all that is alike enough.

    Fingerprints within ``RADIUS`` bits and sets that share a prefix shingle are candidates.  First each set meets one
    partner of each kind and a crowded list its pivot; only what lies in different components then is compared further.
    """
    least = cut(points.groupBy("fp").agg(F.min("key").alias("key")))
    near = links(least.select("fp")).join(least.toDF("u", "ku"), "u").join(least.toDF("v", "kv"), "v").select(F.least("ku", "kv").alias("u"), F.greatest("ku", "kv").alias("v"))
    same = points.join(least.toDF("fp", "u"), "fp").where("key <> u").select("u", F.col("key").alias("v"))
    found = cut(candidates(docs, n, common_shingles(docs, n), similarity))
    release(docs.sparkSession)  # postings are by far the most that this stage shuffles
    pairs = cut(possible(found.where("v is not null").select("u", "v"), points, similarity))
    crowd = found.where("v is null").select("h", F.col("u").alias("key"))
    pivots = cut(crowd.groupBy("h").agg(F.min("key").alias("u")))
    by_pivot = crowd.join(pivots, "h").where("key <> u").select("u", F.col("key").alias("v"))
    first = pairs.groupBy("v").agg(F.min("u").alias("u")).select("u", "v")
    first = cut(first.union(possible(near.union(same).union(by_pivot).distinct(), points, similarity)).distinct())
    sure = cut(confirmed(first, docs, named, points, similarity, n))
    release(docs.sparkSession)
    roots = cut(connected(sure).withColumnRenamed("node", "key"))
    of = lambda k: roots.select(F.col("key").alias(k), F.col("root").alias(f"r{k}"))
    left = pairs.join(of("u"), "u", "left").join(of("v"), "v", "left").where(F.coalesce("ru", "u") != F.coalesce("rv", "v")).select("u", "v")
    rest = cut(left.union(crowd_pairs(crowd, points, roots, similarity)).exceptAll(first.select("u", "v")).distinct())
    release(docs.sparkSession)
    if rest.isEmpty():
        return sure
    return sure.union(confirmed(rest, docs, named, points, similarity, n))


def _grouped(docs: DataFrame, similarity: float, n: int) -> DataFrame:
    """(doc_id, text_hash, root): the component of each document, by its shingle set."""
    named = cut(named_sets(docs, n))
    points = cut(named.groupBy("key").agg(F.first("size").alias("size"), F.first("bits").alias("bits"), F.first("coarse").alias("coarse"), F.first("fp").alias("fp")))
    roots = component_ids(points.select("key"), set_links(docs, named, points, similarity, n), "key", "key").withColumnRenamed("component_id", "root")
    return cut(named.select("doc_id", "text_hash", "key").join(roots, "key").select("doc_id", "text_hash", "root"))


def groups(docs: DataFrame, similarity: float = SIMILARITY, n: int = STAGE_SHINGLE) -> DataFrame:
    """(doc_id, component_id) for deduplication: components of all pairs of texts whose ``n``-word shingles are ``similarity`` alike.

    Texts of one shingle set (also those without a word) are one point.  Prefixes miss no pair that is alike enough,
    and every link is confirmed by its sets.
    """
    rows = _grouped(docs, similarity, n)
    low = cut(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    return rows.join(low, "root").select("doc_id", "component_id")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, n: int = STAGE_SHINGLE) -> DataFrame:
    """The one row of ``docs`` of each group that has the least doc_id (then text hash); null ids come last, equal rows leave one."""
    rows = _grouped(docs, similarity, n)
    at = F.struct(F.col("doc_id").isNull().alias("blank"), "doc_id", "text_hash")
    best = rows.groupBy("root").agg(F.min(at).alias("at")).select("at.doc_id", "at.text_hash", F.lit(True).alias("best"))
    times = rows.groupBy("doc_id", "text_hash").agg(F.count("*").alias("times"))
    same = times["doc_id"].eqNullSafe(best["doc_id"]) & (times["text_hash"] == best["text_hash"])
    kept = F.coalesce("best", F.lit(False))
    all_ids = cut(times.join(best, same, "left").select(times["doc_id"].alias("__id"), times["text_hash"].alias("__hash"), (kept & (F.col("times") == 1)).alias("once"), (kept & (F.col("times") > 1)).alias("more")))
    once, more, total = (x or 0 for x in all_ids.agg(F.count_if("once"), F.count_if("more"), F.count("*")).first())
    release(docs.sparkSession)

    def pick(which: str, count: int, how: str) -> DataFrame:
        k = all_ids.where(which).select("__id", "__hash")
        k = F.broadcast(k) if count <= SMALL else k  # so that texts need not be shuffled
        return docs.join(k, docs["doc_id"].eqNullSafe(k["__id"]) & (F.xxhash64(docs["text"]) == k["__hash"]), how)

    # the fewer ids are handed out: most rows stay, so that those that go still fit where those that stay do not
    out = pick("once", once, "left_semi") if 2 * once <= total else pick("not once", total - once, "left_anti")
    return out.unionByName(pick("more", more, "left_semi").dropDuplicates(["doc_id", "text"])) if more else out
