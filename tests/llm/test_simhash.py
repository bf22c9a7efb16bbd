import re
from collections import defaultdict

import numpy as np
import xxhash
from prefloom.llm import simhash as S


def brute_fp(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), seed=42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(fps):
    ids = sorted(fps, key=lambda x: (x[0] is None, x[0]))
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (ids[i][1] ^ ids[j][1]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(ids):
        groups[find(i)].append(d)
    return sorted(((ids[i][0], f"{ids[i][1]:016x}", min((d for d in groups[find(i)] if d is not None), default=None)) for i in range(len(ids))), key=str)


def check(df):
    got = sorted([tuple(r) for r in S.near_duplicates(df).collect()], key=str)
    want = brute_components([(r.doc_id, brute_fp(r.text)) for r in df.collect()])
    assert got == want
    return got


def test_documents(documents):
    got = check(documents)
    assert len({r[2] for r in got}) < len(got)


def test_odd_rows(odd, nothing):
    check(odd)
    assert S.near_duplicates(nothing).count() == 0


def random_points(rng, n, dense):
    base = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
    for _ in range(dense):  # near copies of near copies
        i, j = rng.integers(0, n, 2)
        base[i] = base[j] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False)))
    return np.unique(base)


def components(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_shards_keep_components_whole():
    rng = np.random.default_rng(5)
    for n, dense in ((40, 60), (700, 1500), (1500, 200)):
        x = random_points(rng, n, dense)
        near = np.argwhere(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= 4, 1))
        got = S.shard_links(x)
        assert len(got) < len(x)
        assert all((int(x[i]) ^ int(x[j])).bit_count() <= 4 for i, j in got)
        assert components(len(x), got) == components(len(x), near)


def near_pairs(x):
    return np.argwhere(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= 4, 1))


def test_trees_meet_every_near_pair():
    rng = np.random.default_rng(6)
    x = random_points(rng, 3000, 3000)
    for blocks in (1, 2, 3, 5):
        trees = [S.Tree(x[::7], m, 4 // blocks, 7.0, 256) for m in S.runs(blocks)]
        assert blocks == 1 or all(len(t.pieces) > 8 for t in trees)
        met = set()
        for no, tree in enumerate(trees):
            for leaf, at in tree.deal(x):
                met |= {(no, leaf, int(p)) for p in at}
        where = {}
        for no, leaf, p in met:
            where.setdefault(p, set()).add((no, leaf))
        assert all(where[i] & where[j] for i, j in near_pairs(x).tolist())


def test_pruned_shards_keep_components_whole():
    x = random_points(np.random.default_rng(8), 4000, 1000)
    want = components(len(x), near_pairs(x).tolist())
    for blocks in (2, 3, 5):
        pairs, seen = [], []
        for m in S.runs(blocks):
            pairs += S.shard_links(x, m, 4 // blocks, 4, seen)
        assert components(len(x), pairs) == want
        assert sum(seen) < 0.6 * len(x) ** 2 / 2  # the triangle bound prunes


def test_dense_leaves_are_dealt_in_pieces():
    rng = np.random.default_rng(9)
    one = rng.integers(0, 1 << 63, dtype=np.uint64)
    x = np.unique(one ^ np.array([sum(1 << int(b) for b in rng.choice(60, 3, replace=False)) for _ in range(2000)], np.uint64))
    tree = S.Tree(x, 0, 0, 1.0, 64)  # no bit tells them apart
    assert tree.pieces[0] > 4
    met = [set(at.tolist()) for _, at in tree.deal(x)]
    assert max(map(len, met)) < len(x)
    assert all(any(i in m and j in m for m in met) for i, j in rng.integers(0, len(x), (200, 2)).tolist())


def test_distributed_links(spark):
    x = random_points(np.random.default_rng(7), 800, 900)
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    place = {int(v): i for i, v in enumerate(x.view(np.int64))}
    for shard in (8192, 64):  # one leaf and many
        pairs = [(place[r.u], place[r.v]) for r in S.links(df, shard=shard).collect()]
        assert components(len(x), pairs) == components(len(x), near_pairs(x).tolist())


def test_star_and_chain_components(spark):
    from prefloom.llm.common import component_ids, connected

    edges = [(0, i) for i in range(1, 400)] + [(i, i + 1) for i in range(500, 700)]
    points = spark.range(800).selectExpr("id as node", "id + 5 as least")
    edges = spark.createDataFrame(edges, "u long, v long")
    for e in (edges, edges.selectExpr("concat('é', u) as u", "concat('é', v) as v")):
        assert sorted(map(tuple, connected(e, many=200).collect())) == sorted(map(tuple, connected(e).collect()))
    got = {r.node: r.component_id for r in component_ids(points, edges, "node", "least").collect()}
    assert got == {i: 5 if i < 400 else 505 if 500 <= i <= 700 else i + 5 for i in range(800)}
