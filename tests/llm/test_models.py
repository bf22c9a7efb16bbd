"""License scans, personal data, language models and language identification, and the pipeline."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from prefloom.llm import language, licenses, mixing, pii, pitman_yor, simhash
from pyspark.sql import functions as F

# -- licenses ----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model(documents):
    return licenses.train(documents, 400)


def test_license_scan_equals_plain_prediction(spark, documents, odd, nothing, model):
    lines = ["Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "All rights reserved.", "A fishing license costs ten dollars.", "SPDX-License-Identifier: MPL-2.0"]
    more = spark.createDataFrame([(500, "\n".join(["some text", *lines, ""]))], "doc_id long, text string")
    for df in (documents.select("doc_id", "text"), odd.select("doc_id", "text"), more):
        for r in licenses.scan(df, model).collect():
            want = []
            for i, p in enumerate((r.text or "").split("\n")):
                f, prob, like = model.predict(p)
                if f != "unknown" and prob >= licenses.LEAST_P:
                    want.append((i, f, pytest.approx(prob), pytest.approx(like), like >= licenses.LEAST_LIKENESS))
            assert [tuple(x) for x in r.licenses] == want
    found = [(x.family, x.confirmed) for x in licenses.scan(more, model).first().licenses]
    assert found == [("apache", True), ("mit", True), ("proprietary", True), ("mpl", True)]
    assert licenses.by_document(nothing, model).count() == 0


def test_licenses_in_documents(documents, model):
    wanted = re.compile(r"licensed under|released under|all rights reserved", re.I)
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in licenses.by_document(documents, model).collect():
        assert bool(r.families) == bool(wanted.search(texts[r.doc_id]))


# -- personal data --------------------------------------------------------------------------------------------------------------


def luhn(s):
    d = [int(c) for c in s][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


PEOPLE = [
    (1, "Mail jane.doe7@mail.example.com or JANE.DOE7@MAIL.EXAMPLE.COM, call +1 (212) 555-0187."),
    (2, "jane.doe7@mail.example.com paid with 4111 1111 1111 1111 from 10.20.30.40; card 4111111111111111, not 4111111111111112"),
    (3, "Mrs. Maria Schmidt met Mr. John Miller and господин Иван Петров. Mr. John Miller left."),
    (4, "ssn 123-45-6789 iban DE89 3704 0044 0532 0130 00 phone +1-212-555-0187"),
    (5, None),
    (6, ""),
    (7, "version 1.2.3 of 2024-01-02 has 12345 rows"),
    (1, "again jane.doe7@mail.example.com"),
]


def test_surrogates(spark, nothing):
    df = spark.createDataFrame(PEOPLE, "doc_id long, text string")
    out = {}
    for r in pii.replace(df, "a key").collect():
        out.setdefault(r.doc_id, []).append(r.text)
    assert sum(map(len, out.values())) == len(PEOPLE)
    assert out[5] == [None] and out[6] == [""] and out[7] == [PEOPLE[6][1]]
    one = next(t for t in out[1] if t.startswith("Mail"))
    mails = re.findall(r"[\w.]+@[\w.]+\w", one)
    assert mails[0].upper() == mails[1] and "jane" not in one.lower()
    assert re.fullmatch(r"[a-z]{4}\.[a-z]{3}\d@[a-z]{4}\.[a-z]{7}\.com", mails[0])
    assert mails[0] in out[2][0] and any(mails[0] in t for t in out[1] if t.startswith("again"))
    cards = re.findall(r"\d{4} \d{4} \d{4} \d{4}|\d{16}", out[2][0])
    assert cards[0].replace(" ", "") == cards[1] and luhn(cards[1]) and cards[1] != "4111111111111111" and cards[2] == "4111111111111112"
    assert "10.20.30.40" not in out[2][0] and re.search(r"from (\d{1,3}\.){3}\d{1,3};", out[2][0])
    three = out[3][0]
    assert re.match(r"Mrs\. [A-Z][a-z]+ [A-Z][a-z]+ met Mr\. [A-Z][a-z]+ [A-Z][a-z]+ and господин [А-ЯЁ][а-яё]+ [А-ЯЁ][а-яё]+\. Mr\. ", three)
    assert len(set(re.findall(r"Mr\. (\w+ \w+)", three))) == 1 and "Miller" not in three and "Schmidt" not in three and "Петров" not in three
    assert re.search(r"Mrs\. (\w+)", three)[1] in pii.GIVEN["f", "latin"]
    phone = re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", one)[0]
    assert re.sub(r"\D", "", phone) == re.sub(r"\D", "", re.search(r"\+1-\d{3}-\d{3}-\d{4}", out[4][0])[0])  # one number in two layouts
    assert "123-45-6789" not in out[4][0] and re.search(r"ssn \d{3}-\d{2}-\d{4} iban DE\d\d \d{4}", out[4][0])
    assert pii.replace(nothing, "a key").count() == 0
    assert sorted(map(str, (r.text for r in pii.replace(df, "a key").collect()))) == sorted(map(str, (t for v in out.values() for t in v)))
    assert sorted(map(str, (r.text for r in pii.replace(df, "other key").collect()))) != sorted(map(str, (t for v in out.values() for t in v)))


def iban_ok(x):
    x = x.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def test_surrogates_keep_type_and_format(spark, odd):
    long = "x" * 60 + "@" + ".".join(["y" * 60] * 7) + ".org"
    texts = {
        "phone": ["+44 20 7946 0958", "+442079460958", "+353 1 234 5678", "(212) 555-0187"],
        "email": ["John.Doe@Example.com", "john.doe@example.com", long],
        "iban": ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"],
        "ip6": ["2001:db8::1", "fe80:0:0:0:1:2:3:4A"],
        "person": ["Mr John Smith", "Mr Smith", "Mr Jack Smith", "κυρία Ελένη Παππά", "Mrs Smith"],
    }
    rows = [(i, kind, t, f"see {t}, please") for i, (kind, t) in enumerate((k, t) for k, v in texts.items() for t in v)]
    df = spark.createDataFrame(rows, "row long, mention string, swap string, text string").withColumn("n_pii", F.lit("x")).withColumn("d", F.lit(1))
    got = pii.replace(df, "a key")
    assert got.columns == ["row", "mention", "swap", "text", "d", "n_pii"]
    got = {r.swap: r.text.removeprefix("see ").removesuffix(", please") for r in got.collect()}
    assert all(a != b for a, b in got.items())
    shape = lambda t: re.sub(r"[0-9]", "9", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", t)))
    for kind in ("phone", "email", "iban"):
        assert all(shape(a) == shape(got[a]) for a in texts[kind])
    assert got["+44 20 7946 0958"].startswith("+44 ") and got["+353 1 234 5678"].startswith("+353 ")
    assert re.sub(r"\D", "", got["+44 20 7946 0958"]) == re.sub(r"\D", "", got["+442079460958"])
    assert got["John.Doe@Example.com"].lower() == got["john.doe@example.com"]
    assert all(iban_ok(got[a]) for a in texts["iban"])
    assert all(re.sub("[0-9A-Fa-f]", "", a) == re.sub("[0-9A-Fa-f]", "", got[a]) for a in texts["ip6"])
    family = {got[a].split()[-1] for a in ("Mr John Smith", "Mr Smith", "Mr Jack Smith", "Mrs Smith")}
    assert len(family) == 1 and got["Mr John Smith"] != got["Mr Jack Smith"]
    assert re.fullmatch(r"κυρία [Α-ΩΆ-Ώ][α-ωά-ώ]+ [Α-ΩΆ-Ώ][α-ωά-ώ]+", got["κυρία Ελένη Παππά"])
    entities = [t.lower().replace(" ", "") for v in texts.values() for t in v]
    assert not set(entities) & {g.lower().replace(" ", "") for g in got.values()}
    assert sorted(str(r.text) for r in pii.replace(odd, "a key").collect()) == sorted(str(r.text) for r in odd.collect())
    with pytest.raises(ValueError):
        pii.replace(odd, "")


def test_surrogates_stay_distinct(spark):
    df = spark.range(300).select(F.lit("ip").alias("kind"), F.concat(F.lit("1.2."), (F.col("id") / 200).cast("int").cast("string"), F.lit("."), (F.col("id") % 200).cast("string")).alias("entity"))
    a = pii.assign(df, "k")
    assert a.select("surrogate").distinct().count() == 300
    assert a.select("surrogate").join(df.select(F.col("entity").alias("surrogate")), "surrogate").count() == 0
    # two-letter domains leave few surrogates, so some must be drawn again
    few = spark.createDataFrame([("email", f"{c}@b.co") for c in "abcdefghijklmnopqrstuvwxyz"], "kind string, entity string")
    assert pii.assign(few, "k").select("surrogate").distinct().count() == 26


# -- language model ------------------------------------------------------------------------------------------------------------------


def test_scores(documents, odd, nothing):
    for df in (documents, odd):
        rows = df.select("doc_id", "text").collect()
        tok = [((r.text or "").encode().lower().split() + [b""], zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 1) for r in rows]
        c = Counter(w for t, held in tok if not held for w in t)
        n, v = sum(c.values()), len(c)
        want = sorted((str(r.doc_id), held, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 4)) for r, (t, held) in zip(rows, tok, strict=True))
        got = pitman_yor.score(df).collect()
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
        assert all(r.score < 0 for r in got)
    held = [r for r in pitman_yor.score(documents).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert pitman_yor.score(nothing).count() == 0


def test_probabilities_add_to_one():
    rng = np.random.default_rng(0)
    tier = pitman_yor.tier_model(rng.poisson(2, (8, 20)))
    assert np.allclose((10**tier).sum(axis=1), 1)
    words = (rng.integers(1, 1 << 40, 50).astype(np.uint64) << np.uint64(16)) & pitman_yor.HIGH
    key = np.unique(rng.choice(words, 300) | rng.integers(0, 4, 300).astype(np.uint64))
    cells = pitman_yor.Cells(key, rng.integers(1, 9, len(key)))
    sums = lambda x: np.bincount(cells.ctx, weights=x, minlength=65536)
    m = {"d": 0.6, "d1": 0.5, "uniform": 1 / (len(cells.word) + 1)}
    g = pitman_yor.Totals(sums(cells.c), sums(cells.t), cells.c1.sum(), cells.t1.sum())
    cells.sweep(g, m, 1)
    g = pitman_yor.Totals(sums(cells.c), sums(cells.t), cells.c1.sum(), cells.t1.sum())
    for ctx in range(4):
        p = cells.score(g, m, np.append(cells.word, np.uint64(12345) << np.uint64(16)) | np.uint64(ctx))
        assert p.sum() == pytest.approx(1)


def test_seating_follows_the_restaurant():
    """Mean tables of one dish against customers seated one by one."""
    rng = np.random.default_rng(1)
    d, new = 0.5, 2.0
    for c in (1, 5, 30, 200):
        plain = []
        for _ in range(300):
            t = 1
            for i in range(1, c):
                t += rng.random() < new / (new + i - d * t)
            plain.append(t)
        got = pitman_yor.seat(np.full(2000, c), np.full(2000, new), d, np.arange(2000).astype(np.uint64), c)
        assert got.mean() == pytest.approx(np.mean(plain), rel=0.08)
        assert got.min() >= 1 and got.max() <= c


# -- language identification ----------------------------------------------------------------------------------------------------------


def test_language(documents, odd, nothing):
    r = language.identify(documents).select("doc_id", "lang", "held_out", "lang_pred", "score").collect()
    for x in r:
        assert x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) and 0 <= x.score <= 1
    held = [x for x in r if x.held_out]
    assert np.mean([x.lang == x.lang_pred for x in held]) > 0.95
    o = language.identify(odd).collect()
    assert len(o) == odd.count()
    for x in o:
        if x.text is None or not any(map(str.isalpha, x.text)):
            assert (x.lang_pred, x.score) == ("und", 0.0)
        else:
            assert x.lang_pred in ("en", "de", "fr")
    assert language.identify(nothing).count() == 0
    assert {x.lang_pred for x in language.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_numerals_are_no_letters(spark, odd):
    model = language.learn(odd.where("lang in ('en', 'de')"))
    assert all(model.predict(t) == ("und", 0.0) for t in ("½ ² Ⅷ ①", "１２３", "٣"))
    assert model.predict("½ é")[0] != "und"
    clash = odd.withColumnRenamed("key", "__p").withColumn("score", F.lit("x"))
    assert set(language.identify(clash, model).columns) == {*clash.columns, "held_out", "lang_pred"}


def test_many_languages():
    rng = np.random.default_rng(2)
    letters = {"en": "abcdef", "de": "cdefgh", "nl": "efghij", "fr": "klmnop", "xx": "qrstuv"}
    text = lambda lang: " ".join("".join(rng.choice(list(letters[lang]), 5)) for _ in range(30))
    langs = [x for x in letters for _ in range(40)]
    m = language.Model(np.stack([language.features(text(x)) for x in langs]), langs)
    assert set(m.families) == {"germanic", "romance", "=xx"} and len(m.pairs) == 3
    assert np.mean([m.predict(text(x))[0] == x for x in langs]) > 0.95
    assert all(0 <= m.predict(text(x))[1] <= 1 for x in langs)


# -- pipeline --------------------------------------------------------------------------------------------------------------------------


def test_near_duplicate_groups(documents):
    def grams(t):
        w = t.encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    g = {r.doc_id: grams(r.text) for r in documents.collect()}
    root = {i: i for i in g}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in g:
        for b in g:
            if a < b and 5 * len(g[a] & g[b]) >= 4 * len(g[a] | g[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {r.doc_id: r.component_id for r in simhash.groups(documents).collect()} == {i: find(i) for i in g}


def test_pipeline_stages(spark, documents):
    import corpus_pipeline as P

    docs = documents
    kept = []
    for name, stage in P.STAGES:
        before, docs = docs, stage(spark, docs, "/root/testdata/sf0.001").cache()
        kept.append(docs.select("doc_id").distinct().count())
    assert kept == sorted(kept, reverse=True) and kept[0] == 200
    rows = lambda df: sorted((r.doc_id, r.epoch, r.text) for r in df.collect())
    assert rows(docs) == rows(P.run(spark, "/root/testdata/sf0.001"))
    size = {r.doc_id: (r.source, r.n) for r in before.select("doc_id", "source", mixing.size_of(F.col("text")).alias("n")).collect()}
    taken = docs.select("doc_id", mixing.size_of(F.col("text")).alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n")).collect()
    assert all(r.n <= 2 * size[r.doc_id][1] for r in taken)
    target = {r.source: r.target for r in mixing.mix(before).select("source", "target").distinct().collect()}
    for s, t in target.items():
        assert abs(sum(r.n for r in taken if size[r.doc_id][0] == s) - t) <= 1


def test_pipeline_stages_take_odd_rows(spark, odd, nothing):
    import corpus_pipeline as P

    more = spark.createDataFrame([((1 << 53) + 2, "see john.doe@example.com and more", "en", "a", 1), (9, "The Quick brown fox", "en", "a", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    for rows in (odd, odd.limit(0)):
        docs = rows.unionByName(more.withColumn("key", F.lit("k")) if rows is odd else more.limit(0).withColumn("key", F.lit("k"))).select(*P.COLUMNS)
        ids = {r.doc_id for r in docs.collect()}
        for name, stage in P.STAGES:
            docs = stage(spark, docs, "/root/testdata/sf0.001").cache()
            assert {r.doc_id for r in docs.collect()} <= ids, name
            assert name == "source mix" or docs.columns == list(P.COLUMNS)
        if rows is odd:
            left = {r.doc_id for r in docs.collect()}
            assert {1 << 53, (1 << 53) + 1, (1 << 53) + 2, (1 << 63) - 1, -(1 << 63), None, 9} <= left and not left & {3, 4, 5, 8}
    blank = odd.withColumn("lang", F.lit(None).cast("string")).select(*P.COLUMNS)  # nothing to learn from: only what has no letter goes
    assert {r.doc_id for r in P.language_id(spark, blank, "").collect()} == {r.doc_id for r in odd.collect() if r.text and any(map(str.isalpha, r.text))}
