import hashlib
import re

import numpy as np
import pytest

from prefloom.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, span=10):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(span, len(w))
        for k in range(len(w) - n + 1) if w else ():
            windows.setdefault(tuple(w[k : k + n]), set()).add("" if i is None else str(i))
    lengths = {len(w) for w in windows}
    out = []
    for doc_id, t in docs:
        w = words(t)
        hit, names = set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if got := windows.get(tuple(w[k : k + n])):
                    names |= got
                    hit |= set(range(k, k + n))
        out.append((doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def rows(df):
    return sorted([tuple(r) for r in df.select(*COLUMNS).collect()], key=str)


ITEMS = [
    (1, "Quick brown fox jumps over the lazy dog near the river bank today, and more words follow it here"),
    (1, "lazy dog"),
    (2, "beta gamma delta epsilon alpha beta gamma delta epsilon alpha beta gamma"),
    (3, None),
    (4, "..."),
    (10, "wenigen Wörtern"),
    (None, "über straßen"),
]


@pytest.mark.parametrize("limit", [1 << 20, 400])
def test_equals_brute_force(spark, odd, limit):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = rows(D.decontaminate(odd, bench, index_bytes=limit))
    assert got == brute([(r.doc_id, r.text) for r in odd.collect()], ITEMS)


@pytest.mark.parametrize("limit", [1 << 24, 40000])
def test_documents(spark, documents, limit):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = rows(D.decontaminate(documents, bench, index_bytes=limit))
    want = brute([(r.doc_id, r.text) for r in documents.collect()], [tuple(r) for r in bench.select("item_id", "text").collect()])
    assert got == want
    assert any(r[-1] for r in got)


def test_empty_tables(spark, odd, nothing):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.decontaminate(nothing, none).count() == 0
    assert not any(r.contaminated for r in D.decontaminate(odd, none).collect())


def test_every_long_shared_span_is_found():
    rng = np.random.default_rng(3)
    for _ in range(50):
        item = [b"w%d" % x for x in rng.integers(0, 30, 40)]
        at = int(rng.integers(0, 30))
        doc = [b"d%d" % x for x in rng.integers(0, 30, 15)] + item[at : at + 10] + [b"z"] * 5
        items, runs = D.Index([("i", item)]).hits(D.WordHash().array(doc))
        assert items == {0} and any(a <= 15 and b >= 25 for a, b in zip(runs[::2], runs[1::2]))


def test_repeated_words_take_linear_time():
    import time

    index = D.Index([("i", [b"w"] * 2000), ("j", [b"w"] * 1500)])
    h = D.WordHash().array([b"x"] + [b"w"] * 20000)
    began = time.perf_counter()
    assert index.hits(h) == ({0, 1}, [1, 20001])
    assert time.perf_counter() - began < 0.5
