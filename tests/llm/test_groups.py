"""The pipeline's near-duplicate groups against all pairs."""

import numpy as np
import pytest
from prefloom.llm import simhash


def grams(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def likeness(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b)


def bits(a, b):
    return (simhash.fingerprint(a, simhash.STAGE_SHINGLE) ^ simhash.fingerprint(b, simhash.STAGE_SHINGLE)).bit_count()


def variant(rng, words, edits):
    out = list(words)
    for i in rng.choice(len(out), edits, replace=False):
        out[i] = f"v{rng.integers(1 << 30)}"
    return " ".join(out)


def found(spark, texts):
    got = {r.doc_id: r.component_id for r in simhash.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    return [got[i] for i in range(len(texts))]


def brute(texts):
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    g = [grams(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(g[i] & g[j]) >= 4 * len(g[i] | g[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_alike_texts_meet_at_any_distance_in_bits(spark):
    rng, texts = np.random.default_rng(11), []
    while len(texts) < 10:
        words = [f"w{x}" for x in rng.integers(1 << 30, size=200)]
        a, b = " ".join(words), variant(rng, words, 4)
        if bits(a, b) > 10 and likeness(a, b) >= 0.8:
            texts += [a, b]
    assert found(spark, texts) == brute(texts) == [0, 0, 2, 2, 4, 4, 6, 6, 8, 8]


def test_unlike_texts_of_near_fingerprints_stay_apart(spark):
    said = "one phrase that is said once more " * 90
    tails = [" ".join(f"t{k}x{i}" for i in range(20)) for k in range(4)]
    texts = [said + t for t in tails]
    assert all(likeness(a, b) < 0.8 and bits(a, b) <= simhash.RADIUS for a in texts for b in texts if a != b)
    texts += [texts[0], "", " "]
    assert found(spark, texts) == [0, 1, 2, 3, 0, 5, 5]


def test_dense_lists_join_only_what_is_confirmed(spark):
    rng, texts = np.random.default_rng(12), []
    line = [f"line{i}" for i in range(30)]
    for words in ([f"a{i}" for i in range(150)], [f"b{i}" for i in range(150)]):
        for _ in range(60):  # from copies to texts that are alike only over others
            texts.append(variant(rng, words, int(rng.integers(0, 8))))
    for k in range(80):  # unlike texts that are mostly one line
        texts.append(" ".join(line + [f"k{k}x{i}" for i in range(int(rng.integers(5, 20)))]))
    want = brute(texts)
    assert 80 < len(set(want)) < len(texts) - 30
    assert found(spark, texts) == want


def test_one_row_of_each_group_stays(spark, odd, nothing):
    line = " ".join(f"w{i}" for i in range(60))
    rows = [(1, line, "x"), (1, line, "x"), (2, line, "y"), (None, "a lone text", None), (None, "another lone text", None), (None, None, None), (7, "", None), (8, f"{line} end", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root string")
    got = sorted([tuple(r) for r in simhash.keep_one(docs).collect()], key=str)
    assert got == sorted([(1, line, "x"), (None, "a lone text", None), (None, "another lone text", None), (7, "", None)], key=str)
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} <= {r.doc_id for r in odd.collect()}
    assert simhash.keep_one(nothing).count() == 0


def test_crowds_meet_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", 16)
    test_dense_lists_join_only_what_is_confirmed(spark)


def test_pairs_meet_in_cells_of_few_sets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL_SETS", 3)
    rng = np.random.default_rng(29)
    words = [f"w{x}" for x in rng.integers(1 << 30, size=80)]
    texts = [variant(rng, words, int(k)) for k in rng.integers(1, 4, size=40)] + [" ".join(words)] * 3
    assert found(spark, texts) == brute(texts)


@pytest.mark.parametrize("small, joins", [(1 << 20, 0), (8, 0), (0, 1)])
def test_texts_are_shuffled_once_at_most(spark, monkeypatch, small, joins):
    """Few ids go and many stay: those that go are handed out; where even these are too many, texts move once, not twice."""
    monkeypatch.setattr(simhash, "SMALL", small)
    rng = np.random.default_rng(31)
    words = [[f"w{x}" for x in rng.integers(1 << 30, size=60)] for _ in range(40)]
    rows = [(i, " ".join(w)) for i, w in enumerate(words)] + [(100 + i, variant(rng, words[i], 1)) for i in range(5)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert kept._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") == joins
    assert sorted(r.doc_id for r in kept.collect()) == list(range(40))
    again = simhash.keep_one(spark.createDataFrame(rows + rows[:9], "doc_id long, text string"))
    assert sorted(r.doc_id for r in again.collect()) == list(range(40))
