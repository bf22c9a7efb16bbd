"""Language predictions against a plain version: loops over trigrams, planes and votes, by Python's numbers alone."""

import math
import zlib

import pytest
from prefloom.llm import language


def plain_features(text):
    kept = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in text.lower().encode())
    padded = b" " + b" ".join(kept.split()) + b" "
    count = {}
    for a, b, c in zip(padded, padded[1:], padded[2:], strict=False):
        h = ((a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) * 0x27D4EB2F) % (1 << 32)
        place = h >> (32 - language.BITS)
        count[place] = count.get(place, 0) + 1
    return {k: math.sqrt(n / (len(padded) - 2)) for k, n in count.items()}


def plain(model, text):
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0
    f = plain_features(text)
    share = []
    for plane, (b, slope, shift) in zip(model.w, model.rest, strict=True):
        margin = sum(float(plane[k]) * v for k, v in f.items()) + b
        share.append(1 / (1 + math.exp(-max(-30, min(30, slope * margin + shift)))))
    n = len(model.family_planes)
    best = max(range(n), key=lambda i: (share[i], -i)) if n else 0
    p = share[best] / max(sum(share[:n]), 1e-12) if n else 1.0
    names = model.within[model.families[best]]
    votes = dict.fromkeys(names, 0.0)
    for (a, b), q in zip(model.pairs, share[n:], strict=True):
        if a in votes:
            votes[a] += q
            votes[b] += 1 - q
    if len(names) == 1:
        return names[0], p
    top = max(names, key=lambda v: (votes[v], -names.index(v)))
    return top, p * votes[top] / (len(names) - 1)


def test_predictions_equal_the_plain_version(spark, documents, odd):
    model = language.learn(documents)
    assert len(model.families) > 1 and model.pairs
    for df in (documents.select("doc_id", "text", "lang"), odd):
        for r in language.identify(df, model).collect():
            lang, score = plain(model, r.text)
            assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-4)
            assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 3 == 1)


def test_only_rows_that_are_not_held_out_teach(spark, documents):
    """Other labels on held-out rows, or on rows of null language, change nothing."""
    kept = documents.where(~language.held_out())
    spoiled = kept.unionByName(documents.where(language.held_out()).withColumn("lang", language.F.lit("xx")))
    a, b = language.learn(kept), language.learn(spoiled)
    assert a.langs == b.langs and (a.w == b.w).all() and (a.rest == b.rest).all()
