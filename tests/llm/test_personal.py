"""Surrogates: texts built from known entities must come back with the same gaps and one distinct surrogate an entity."""

import random
import re

import pytest
from prefloom.llm import pii, secrets
from pyspark.sql import functions as F

MENTIONS = {
    "email": ["jane.doe@mail.example.com", "x" * 65 + "@example.org", "a@b.c.d.e.f.g.h.i.j.k.com", "jörg@exämple.de", "user@bücher.example", "иван@почта.рф", "μαρία@παράδειγμα.ελ", "a+b%c@x-y.museum", "y" * 20_000 + "@" + "z." * 5000 + "info"],
    "phone": ["020 7946 0958", "212 555 0187", "2125550199", "0176/12345678", "tel. 0171/7654321", "Tel: 5550123456", "030-12345678", "+49 30 901820", "(212) 555-0186"],
    "person": ["Mr. McDonald", "Mr. O'Brien", "Dr. Smith", "Mr. JOHN SMYTHE", "Mrs. Smith-Jones", "Frau Dr. Anna Müller", "Prof. Ada Byron", "Señora Núñez", "Lady Ashworth-Cole-Hart", "Herr Groß"],
    "ip": ["10.20.30.40", "192.0.2.7"],
    "ip6": ["::1", "2001:db8::ff"],
    "card": ["4111 1111 1111 1111", "378282246310005"],
    "ssn": ["123-45-6789"],
    "iban": ["DE89 3704 0044 0532 0130 00"],
}
GAPS = [" see ", " wrote to ", " and then, ", "; ", " 😀 on 2024-01-02 in room 12345: ", "\n", " of 01.02.2020 12:30 or 01-02-2020 12:30, ", " id 1700000000, "]


def built(n=40, seed=1):
    """[(doc_id, gaps, mentions)]: texts alternate gaps and mentions."""
    rng = random.Random(seed)
    every = [m for v in MENTIONS.values() for m in v]
    out = []
    for i in range(n):
        own = rng.sample(every, 3) if i >= len(every) else [every[i], rng.choice(every)]
        out.append((i, [rng.choice(GAPS) for _ in range(len(own) + 1)], own))
    return out


def test_known_entities_are_replaced_in_place(spark):
    docs = built()
    text = lambda gaps, own: "".join(g + m for g, m in zip(gaps, [*own, ""], strict=True))
    df = spark.createDataFrame([(i, text(g, m)) for i, g, m in docs], "doc_id long, text string").repartition(3)
    to = {}
    for r in pii.replace(df, "a key").collect():
        _, gaps, own = docs[r.doc_id]
        found = re.fullmatch("(.+?)".join(map(re.escape, gaps)), r.text, re.S)
        assert found, r.text[:300]
        assert r.n_pii == len(own)
        for mention, new in zip(own, found.groups(), strict=True):
            assert to.setdefault(mention, new) == new and new != mention  # the same wherever it stands
    assert len(set(to.values())) == len(to) == sum(map(len, MENTIONS.values()))
    assert not set(to.values()) & set(to)
    for kind in ("email", "phone"):
        for m in MENTIONS[kind]:
            assert len(to[m]) == len(m) and re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "9", to[m])) .count("@") == m.count("@")
            assert [c for c in to[m] if not c.isalnum()] == [c for c in m if not c.isalnum()]
    assert to["Mr. JOHN SMYTHE"].split()[1].isupper() and to["Frau Dr. Anna Müller"].startswith("Frau Dr. ") and "Jones" not in to["Mrs. Smith-Jones"]
    assert re.fullmatch(r"[а-я]+@[а-я]+\.рф", to["иван@почта.рф"]) and re.fullmatch(r"[α-ω]+@[α-ω]+\.ελ", to["μαρία@παράδειγμα.ελ"])


def test_names_agree_across_forms(spark):
    rows = ["Mr John Smith", "Mr Smith", "Dr. Smith", "MR", "Mr JOHN SMITH", "Mr. Smith's hat", "Mr. d", "Dr"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {rows[r.doc_id]: r.text for r in pii.replace(df, "a key").collect()}
    name = got["Mr Smith"].split()[1]
    assert got["Mr John Smith"].split()[2] == name == got["Dr. Smith"].split()[1] and got["Mr. Smith's hat"] == f"Mr. {name}'s hat"
    assert got["Mr JOHN SMITH"] == "Mr " + " ".join(got["Mr John Smith"].split()[1:]).upper()
    assert all(got[t] == t for t in ("MR", "Mr. d", "Dr"))


@pytest.mark.parametrize(
    "texts",
    [
        [f"::{i}" for i in range(1, 10)],
        [f"{a}@{b}.co" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"],
        [f"+1 234567{i:02d}" for i in range(100)],
    ],
    ids=["ip6", "email", "phone"],
)
def test_shapes_with_too_few_values_grow(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.replace(df, "k").collect()}
    assert len(set(got.values())) == len(texts) and not set(got.values()) & set(texts)


def test_clean_numbers_stay(spark):
    texts = ["1234567890 rows", "from 1999-12-31 to 2000-01-01", "pi is 3.14159265358979", "4111111111111112", "version 10.2", "01.02.2020 12:30", "a@b", "@home", "x@y.z1", "1,234,567,890", "200.300.400.500"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.text for r in pii.replace(df, "k").orderBy("doc_id").collect()] == texts


# -- secrets in rows that repeat -------------------------------------------------------------------------------------------------------

SECRET = "token=abcdefgh1 and password: hunter22 0123456789abcdef0123456789"


def test_repeated_rows_with_findings(spark):
    one = spark.createDataFrame([(1, SECRET)], "doc_id long, text string")
    want = secrets.scan(one)[0].first()
    rows = [(1, SECRET)] * 3 + [(None, SECRET)] * 2 + [(2, SECRET), (2, "token=another1"), (1, "clean"), (3, None), (3, None)]
    many = spark.createDataFrame(rows, "doc_id long, text string").withColumn("blob", F.lit("x")).repartition(3)
    found, ledger = secrets.scan(many)
    got = found.collect()
    assert len(got) == len(rows) and ledger.count() == ledger.select("blob").distinct().count() == 4
    assert sum((r.spans, r.base_sha256, r.n_assign, r.n_hex) == (want.spans, want.base_sha256, 2, 1) for r in got) == 6
    again, fresh = secrets.scan(many, ledger)
    assert fresh.count() == 0 and sorted(map(str, again.collect())) == sorted(map(str, got))


def test_a_blob_under_many_paths(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, F.concat(F.lit("secret=abcdef"), F.col("id").cast("string"))).otherwise(F.lit(SECRET)).alias("text"))
    found, ledger = secrets.scan(df)
    assert ledger.count() == 301 and found.groupBy("spans").count().count() <= 6
    assert found.where("doc_id % 10 <> 0").select("spans").distinct().count() == 1
