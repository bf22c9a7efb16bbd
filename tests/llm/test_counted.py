"""Centroids, source divergence and pieces: against plain versions on the tables and on awkward rows."""

import hashlib
import math
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from prefloom.llm import centroids, divergence, pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")

# -- centroid clustering -------------------------------------------------------------------------------------------------


def lloyd(rows, k=16, dims=64, rounds=3):
    """[(vec_id, cluster, distance, cluster_inertia, inertia, sha)] by Python's integers alone."""
    kept = [(i, [math.floor(64 * Fraction(v)) for v in x]) for i, x in rows if x is not None and len(x) == dims and all(v is not None and math.isfinite(v) for v in x)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [list(x) for _, x in start[:k]]

    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, m, strict=True)), j) for j, m in enumerate(c))

    for _ in range(rounds):
        own = [near(x)[1] for _, x in kept]
        c = [[sum(col) // own.count(j) for col in zip(*[x for (_, x), o in zip(kept, own, strict=True) if o == j], strict=True)] if j in own else m for j, m in enumerate(c)]
    best = [near(x) for _, x in kept]
    total = Counter()
    for d, j in best:
        total[j] += d
    top = (1 << 63) - 1
    shas = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted(((i, j, min(d, top), min(total[j], top), min(sum(total.values()), top), shas[j]) for (i, _), (d, j) in zip(kept, best, strict=True)), key=str)


def clustered(spark, rows, **how):
    df = spark.createDataFrame([(i, x, "k") for i, x in rows], "vec_id long, embedding array<double>, cluster string").repartition(3)
    return sorted((tuple(r) for r in centroids.cluster(df, **how).collect()), key=str)


def vectors(n, size=3.0, dims=64, seed=0):
    return [(i, x.tolist()) for i, x in enumerate(np.random.default_rng(seed).normal(0, size, (n, dims)))]


def test_clusters_equal_plain_integers(spark):
    rows = vectors(150)
    assert clustered(spark, rows) == lloyd(rows)


@pytest.mark.parametrize("size", [1e5, 2e6, 1e9, 1e20, 1e300])
def test_large_components_stay_exact(spark, size):
    rows = vectors(25) + [(100 + i, x) for i, x in vectors(6, size, seed=1)]
    assert clustered(spark, rows) == lloyd(rows)


def test_awkward_vectors(spark):
    good = vectors(20, seed=3)
    odd = [(30, None), (31, []), (32, [1.0] * 63), (33, [1.0] * 65), (34, [1.0] * 63 + [None]), (35, [math.nan] + [0.0] * 63), (36, [math.inf] * 64), (None, [0.5] * 64), (None, [0.25] * 64)]
    rows = good + odd + good[:3] + [good[0]] * 4 + [(7, [-0.001] * 64), (40, [-0.0] * 64), (41, [5e-324] * 64), (42, [1.7e308] * 64)]
    assert clustered(spark, rows) == lloyd(rows)
    assert clustered(spark, good[:5]) == lloyd(good[:5])  # fewer vectors than clusters
    assert clustered(spark, good + odd, k=4, rounds=6) == lloyd(good + odd, k=4, rounds=6)
    assert clustered(spark, odd[:7]) == [] == clustered(spark, [])


def test_equal_vectors_share_the_smaller_cluster(spark):
    rows = [(i, [1.0] * 64) for i in range(40)]
    assert {r[1] for r in clustered(spark, rows)} == {0} and clustered(spark, rows) == lloyd(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(1 << 70), 1 << 70), min_size=4, max_size=12), st.integers(0, 66))
def test_distances_at_the_bounds(values, shift):
    """Rows and centroids of every tier, near 2^53 and 2^63."""
    x = np.array([[v >> shift for v in values]], object)
    c = np.array([[(v + 1) >> max(0, shift - 3) for v in reversed(values)], [0] * len(values)], object)
    if abs(x).max() < 1 << 62:
        x = x.astype(np.int64)
    got = centroids.distances(x, c)
    assert [[int(v) for v in r] for r in got] == [[sum((int(a) - b) ** 2 for a, b in zip(r, m, strict=True)) for m in c] for r in x]


# -- source divergence ---------------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def audited(rows, ranks=200):
    docs = [(lang or "", source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TERM.findall(text or "")]) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        n_docs, total = Counter(), Counter()
        for _, _, words in own:
            n_docs.update(set(words))
            total.update(words)
        kept = sorted((w for w in n_docs if n_docs[w] >= 3), key=lambda w: w.encode())
        count = {s: Counter() for s in {d[1] for d in own}}
        for _, s, words in own:
            count[s].update(w for w in words if n_docs[w] >= 3)

        def share(c):
            size = sum(c[w] for w in kept)
            return {w: 1 + 10**9 * (c[w] + 1) // (size + len(kept)) for w in kept}  # noqa: B023

        q, p = share(total), {s: share(c) for s, c in count.items()}
        for s in count:
            pairs = [(o, sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept)) for o in count if o != s]
            terms = [(w, (p[s][w] - q[w]) ** 2 // q[w]) for w in kept if count[s][w] and p[s][w] > q[w]]
            for part, items, most in (("pair", pairs, None), ("term", terms, ranks)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, r + 1) for r, (i, v) in enumerate(items[:most])]
    return sorted(out)


def audit(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], "text string, lang string, source string, n int").repartition(3)
    return sorted(tuple(r) for r in divergence.audit(df).collect())


def test_audit_of_odd_rows(spark, odd, nothing):
    rows = [(r.text, r.lang, r.source) for r in odd.collect()]
    assert sorted(tuple(r) for r in divergence.audit(odd).collect()) == audited(rows) != []
    assert divergence.audit(nothing).count() == 0


def test_audit_equals_plain_version(spark, docs_pd, monkeypatch):
    rows = [tuple(r) for r in docs_pd[["text", "lang", "source"]].itertuples(index=False)]
    want = audited(rows)
    assert audit(spark, rows) == want
    for name, value in (("CHUNK", 50), ("SOURCES", 1), ("HELD", 200), ("CELLS", 10)):  # chunks, blocks of pairs and flushes
        monkeypatch.setattr(divergence, name, value)
    assert audit(spark, rows) == want


def test_audit_cases(spark):
    rows = [("one Two öl", "a", "s")] * 3 + [("", "a", "empty"), (None, "a", None), ("two 😀", "a", "t")] * 2
    rows += [("rare words only", "b", "s"), ("others", "b", "t"), (None, None, None), ("lone word lone word lone word " * 9, "c", "s")] + [("x " * 5000 + "y" * 100_000, "d", s) for s in "stu"]
    assert audit(spark, rows) == audited(rows)
    got = audited(rows)
    assert ("b", "s", "pair", "t", 0, 1) in got and not any(r[0] == "c" for r in got)


def test_shares_beyond_64_bits():
    big = np.array([1 << 40, 3, 0], np.int64)
    assert list(divergence.shares(big, 1 << 41, 5)) == [1 + (int(x) + 1) * 10**9 // ((1 << 41) + 5) for x in big]


# -- pieces --------------------------------------------------------------------------------------------------------------

ODD_TEXTS = [None, "", " ", "   ", "a", " a", "a ", "  a  b   c ", "▁", "▁▁a▁ b ▁", "tab\tnew\nline\r\n", "\x00 x\x00y", "日本語 テキスト", "😀😀 👩‍👩‍👧", "<s> </s> <unk> <0x41>", "a b c", "İıſ ﬁ", "x" * 3000, "word " * 5000, "�", "é é"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def expected(library, text):
    ids = library.encode(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_round_trips_equal_the_library(spark, odd, nothing, docs_pd, library):
    for df in (odd, spark.read.parquet("/root/testdata/sf0.001/documents.parquet")):
        texts = [(r.doc_id, r.text) for r in df.collect()]
        got = sorted((tuple(r) for r in pieces.round_trips(df, MODEL).collect()), key=str)
        assert got == sorted(((i, *expected(library, t)) for i, t in texts), key=str)
    assert pieces.round_trips(nothing, MODEL).count() == 0


def test_encode_and_decode_equal_the_library(spark, library):
    df = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "doc_id long, text string")
    ids = pieces.encode(df, MODEL)
    assert {r.doc_id: r.ids for r in ids.collect()} == {i: library.encode(t or "") for i, t in enumerate(ODD_TEXTS)}
    assert {r.doc_id: r.text for r in pieces.decode(ids, MODEL).collect()} == {i: library.decode(library.encode(t or "")) for i, t in enumerate(ODD_TEXTS)}
    assert pieces.decode(ids.selectExpr("doc_id", "cast(null as array<int>) ids"), MODEL).first().text == ""


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*" ▁ab,1é日😀\n\t", "the", " the", "  "]), max_size=60).map("".join) | st.text(st.characters(exclude_categories=["Cs"]), max_size=40))
def test_any_text(library, text):
    for most in (pieces.CHUNKS, 3):
        own = pieces.Pieces(pieces.read_model(MODEL), most)
        for _ in range(2):  # from an empty table, and from a filled one
            n, ids, back = own.round_trip(text)
            want = library.encode(text)
            assert (n, ids, back) == (len(want), ",".join(map(str, want)), library.decode(want)) and own.encode(text) == want


def test_a_word_is_segmented_once(docs_pd):
    own = pieces.Pieces(pieces.read_model(MODEL))
    texts = docs_pd.text.dropna().tolist()
    words = [c for t in texts if t for c in own.chunks(t)]
    for t in texts:
        own.round_trip(t)
    assert own.segmented == len({c for c in words if len(c) <= pieces.LONGEST}) + sum(len(set(c for c in own.chunks(t) if len(c) > pieces.LONGEST)) for t in texts if t)
    assert own.segmented < len(words) / 2


def test_models_whose_pieces_cross_markers(library):
    from sentencepiece import sentencepiece_model_pb2

    model = pieces.read_model(MODEL)
    assert not pieces.crossing(model)
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model)
    proto.pieces[5000].piece = "of▁the"
    assert pieces.crossing(proto.SerializeToString())
    own = pieces.Pieces(model, whole=True)
    assert all(own.encode(t) == library.encode(t or "") and own.round_trip(t)[2] == library.decode(library.encode(t or "")) for t in ODD_TEXTS)
