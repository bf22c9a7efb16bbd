"""Operator 8, language identification by hierarchical discrimination.

The language family is predicted first (one linear SVM for each family against the rest), then one-versus-one
linear SVMs separate the languages of that family.  Features are square roots of the frequencies of hashed
byte trigrams over the whole text, with everything but letters reduced to spaces.  Margins are calibrated by
logistic curves on rows that the planes were not fitted on; the score is P(family) times P(language within it).

The classifier learns from a sample of labelled documents: for each language, those with the least hash of
doc_id and text, ``PER_LANGUAGE`` at most and ``SAMPLE`` over all languages; equal rows are one.  Whole texts are
reduced to features by the executors, and only features reach the driver, which fits the separating planes.

Defined results: a null text, or one without any letter, is ``und`` with score 0, as is everything if no
labelled document could be learned from; one learned language is predicted with score 1; ties go to the
first language by name; repeated rows each get a result; an empty table gives none; texts of any length are
read whole; other columns pass through (held_out, lang_pred and score are replaced); a null doc_id counts as an
empty text in the hold-out rule.  A letter is what Unicode calls one (category L): digits and numerals are none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


BITS = 13
PER_LANGUAGE = 600
SAMPLE = 4000
#: Language families by language code; any other code is a family of its own
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz tt ky tk",
    "indo-aryan": "hi ur bn pa gu mr ne si",
    "iranian": "fa ku ps tg",
    "semitic": "ar he am mt",
    "dravidian": "ta te kn ml",
    "austronesian": "id ms tl jv su mg",
    "celtic": "ga gd cy br",
    "sinitic": "zh yue wuu",
}
CALIBRATE = 5  # every fifth row of a class is kept for its curve
_KEEP = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def family_of(lang: str) -> str:
    code = re.split(r"[-_]", lang.lower())[0]
    return next((f for f, codes in FAMILIES.items() if code in codes.split()), f"={code}")


def features(text: str, bits: int = BITS) -> np.ndarray:
    """Square roots of trigram frequencies: a vector of length one."""
    b = np.frombuffer(b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_KEEP).split()) + b" ", np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(1 << bits, np.float32)
    with np.errstate(over="ignore"):
        x = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    n = np.bincount(x >> np.uint32(32 - bits), minlength=1 << bits)
    return np.sqrt(n / len(x)).astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray, c: float = 20.0, steps: int = 150) -> tuple[np.ndarray, float]:
    """A linear SVM (squared hinge, classes weighted alike) by accelerated gradient; y is +1 or -1, or 0 for rows left out."""
    # all products stay in single precision, as the features are, and no rows are picked out, so that the driver never holds a copy
    weight = (np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * c * (y != 0)).astype(np.float32)
    y = y.astype(np.float32)
    rate = np.float32(1.0 / (1.0 + 2.0 * float((weight * (1.0 + np.einsum("ij,ij->i", x, x))).sum())))
    w = v = np.zeros(x.shape[1], np.float32)
    b = u = np.float32(0)
    for t in range(1, steps + 1):
        g = 2 * weight * y * np.maximum(0, 1 - y * (x @ v + u))
        new, bias = v - rate * (v - g @ x), u - rate * (u - g.sum())
        m = np.float32((t - 1) / (t + 2))
        w, v, b, u = new, new + m * (new - w), bias, bias + m * (bias - b)
    return w, float(b)


def calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a m + b))), by Newton steps on smoothed targets."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        s = p * (1 - p) + 1e-9
        g = np.array([((p - target) * margin).sum(), (p - target).sum()])
        h = np.array([[(s * margin * margin).sum() + 1e-3, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(float(a), 1e-3), float(b)


class Model:
    """Planes of the families and of the language pairs within each."""

    def __init__(self, x: np.ndarray, lang: list[str]):
        self.langs = sorted(set(lang))
        labels = np.array(lang)
        self.families = sorted({family_of(v) for v in self.langs})
        fam = np.array([family_of(v) for v in lang])
        self.within = {f: [v for v in self.langs if family_of(v) == f] for f in self.families}
        self.family_planes = [self.fit(x, np.where(fam == f, 1, -1)) for f in self.families] if len(self.families) > 1 else []
        self.pairs = {}
        for f in self.families:
            for a, b in combinations(self.within[f], 2):
                self.pairs[a, b] = self.fit(x, np.where(labels == a, 1, np.where(labels == b, -1, 0)))
        planes = [*self.family_planes, *self.pairs.values()]
        self.w = np.stack([p[0] for p in planes]) if planes else None
        self.rest = np.array([p[1:] for p in planes]) if planes else None

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, float, float]:
        place = np.zeros(len(y), np.int64)
        for side in (1, -1):
            place[y == side] = np.arange((y == side).sum())
        own = (place % CALIBRATE == CALIBRATE - 1) & (y != 0)
        if min((own & (y > 0)).sum(), (own & (y < 0)).sum()) < 5:  # too few to spare
            w, b = svm(x, y)
            own = y != 0
        else:
            w, b = svm(x, np.where(own, 0, y))
        return w, b, *calibrate((x @ w + b)[own], y[own])

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not has_letter(text):
            return "und", 0.0
        if self.w is None:
            return self.langs[0], 1.0
        m = self.w @ features(text) + self.rest[:, 0]
        p = 1 / (1 + np.exp(-np.clip(self.rest[:, 1] * m + self.rest[:, 2], -30, 30)))
        n = len(self.family_planes)
        best, p_family = 0, 1.0
        if n:
            best = int(np.argmax(p[:n]))
            p_family = p[best] / max(p[:n].sum(), 1e-12)
        names = self.within[self.families[best]]
        votes = dict.fromkeys(names, 0.0)
        for (a, b), q in zip(self.pairs, p[n:], strict=True):
            if a in votes:
                votes[a] += q
                votes[b] += 1 - q
        if len(names) == 1:
            return names[0], float(p_family)
        top = max(names, key=lambda v: votes[v])
        return top, float(p_family * votes[top] / (len(names) - 1))


def held_out(mod: int = 3):
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(mod)) == 1


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, sample: int = SAMPLE, mod: int = 3) -> Model:
    d = docs.where(~held_out(mod) & F.col("lang").isNotNull() & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).select("doc_id", "text", "lang")
    d = d.withColumn("h", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 31)))
    counts = dict(docs.where(~held_out(mod) & F.col("lang").isNotNull()).groupBy("lang").count().collect())
    if not counts:
        return Model(np.zeros((0, 1 << BITS), np.float32), [])
    most = max(1, min(per_language, sample // len(counts)))
    keep = F.lit(False)
    for lang, n in counts.items():  # one entry a language
        keep = keep | ((F.col("lang") == lang) & (F.col("h") < int(min(1.0, (1.3 * most + 50) / n) * (1 << 31))))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            v = [features(t) for t in frame["text"]]
            at = [np.flatnonzero(x) for x in v]
            yield pd.DataFrame({"lang": frame["lang"], "h": frame["h"], "at": [a.astype(np.int32) for a in at], "x": [x[a] for x, a in zip(v, at, strict=True)]})

    rows = d.where(keep).dropDuplicates(["lang", "h"]).mapInPandas(work, "lang string, h long, at array<int>, x array<float>").toPandas()
    rows = rows.assign(len=[len(a) for a in rows["at"]]).sort_values(["lang", "h", "len"], kind="stable").groupby("lang").head(most)
    x = np.zeros((len(rows), 1 << BITS), np.float32)
    for i, (at, v) in enumerate(zip(rows["at"], rows["x"], strict=True)):
        x[i, np.asarray(at, np.int64)] = v
    labels = list(rows["lang"])
    del rows
    return Model(x, labels)


def identify(docs: DataFrame, model: Model | None = None, mod: int = 3) -> DataFrame:
    """All columns of ``docs``, with held_out, lang_pred and score."""
    model = learn(docs, mod=mod) if model is None else model
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def judge(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in text], columns=["lang_pred", "score"])

    rest = [c for c in docs.columns if c not in ("held_out", "lang_pred", "score")]
    d = docs.select(F.struct(*rest).alias("row"), held_out(mod).alias("held_out"), judge("text").alias("p"))
    return d.select(*[F.col("row").getField(c).alias(c) for c in rest], "held_out", "p.lang_pred", "p.score")
