"""Op7's tier has a restaurant for each word before."""

from pathlib import Path

import numpy as np
from prefloom.llm import pitman_yor
from prefloom.llm.common import shared_dir


def test_each_word_before_has_its_own_restaurant(spark):
    """600 words, each with a follower of its own among 40 common ones: no two of them may share what they have learned."""
    pairs = [(f"before{i}", f"after{i * 7 % 40}") for i in range(600)]
    rows = [(k, " ".join(w for x in np.random.default_rng(k).permutation(600)[:150] for w in pairs[x])) for k in range(400)]
    got = pitman_yor.score(spark.createDataFrame(rows, "doc_id long, text string"), common=200).collect()
    held = [r for r in got if r.held_out]
    # a follower is sure once its word is known, which is one of 600, so that a pair costs log10(600)
    assert held and np.mean([r.score / 150 for r in held]) > -1.1 * np.log10(600)


def test_restaurants_add_to_one():
    rng = np.random.default_rng(3)
    words = np.unique(rng.integers(1, 1 << 40, 30).astype(np.uint64) << np.uint64(16))
    key = rng.choice(words[:-1], 500) | rng.integers(0, 9, 500).astype(np.uint64)
    r = pitman_yor.Restaurants(key, np.ones(500), np.minimum(np.arange(9), 5).astype(np.uint64))
    m = {"d": 0.5, "burn_in": 1, "parents": [x / x.sum() for x in rng.random((4, 6))]}
    p = r.mean(m, (words[:, None] | np.arange(6, dtype=np.uint64)).ravel()).reshape(-1, 6)
    assert np.allclose(p.sum(axis=1), 1)


def texts(spark, n, words):
    rng = np.random.default_rng(5)
    return spark.createDataFrame([(k, " ".join(f"w{x}" for x in rng.integers(0, words, 300))) for k in range(n)], "doc_id long, text string")


def test_dealt_tokens_are_not_written_again(spark):
    """Tokens lie in the shuffle's files alone: what is written beside them grows with the common words only."""
    shared_dir(spark)
    written = lambda: sum(f.stat().st_size for f in Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).rglob("*") if f.is_file())
    docs, before = texts(spark, 400, 5000), written()
    assert pitman_yor.score(docs, common=200).count() == 400
    assert written() - before < 120_000  # tokens: 120,400


def test_scores_depend_on_no_partitions(spark):
    docs = texts(spark, 120, 900)
    one, many = (sorted(map(tuple, pitman_yor.score(docs.repartition(n), common=200).collect())) for n in (1, 7))
    assert one == many and len(one) == 120


def test_packed_cells_and_sums_come_back():
    rng = np.random.default_rng(6)
    key = np.unique(rng.integers(0, 1 << 63, 500).astype(np.uint64) << np.uint64(1))
    key = np.unique(np.append(key, key[:200] ^ np.uint64(1)))
    local, n = rng.integers(0, 1 << 16, len(key)), rng.integers(1, 1 << 32, len(key))
    assert all(np.array_equal(x, y) for x, y in zip(pitman_yor.unpack(*pitman_yor.pack(key, local, n)), (key, local, n), strict=True))
    row = np.unique(rng.integers(0, 1 << 60, 300))
    sums = [rng.integers(-(1 << 62), 1 << 62, len(row)) for _ in range(3)]
    assert all(np.array_equal(x, y) for x, y in zip(pitman_yor.unpack_sums(pitman_yor.pack_sums(row, *sums)), (row, *sums), strict=True))
    u, a = pitman_yor.add_up(np.array([5, 1, 5]), np.array([1 << 61, 7, 1]))
    assert u.tolist() == [1, 5] and a.tolist() == [7, (1 << 61) + 1]
