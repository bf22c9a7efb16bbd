"""Operator 4, document fingerprints: bottom-k sketches of word shingles.

A sketch holds the K least distinct 32-bit hashes of a text's five-word shingles.  Sketches of parts merge
into the sketch of the whole; two of them estimate resemblance and containment, and one of them the number
of distinct shingles (exact up to K).

``compare_edited`` sketches each document and an edited copy, whose end comes from the next document by
doc_id.  Documents are dealt to ranges of doc_id that start at ids taken from the table itself, and the first
document of each range also goes to the end of the range before it, so texts travel once and no task sees
more than its range.

Defined results: a null text is empty; an empty text has an empty sketch, and two of those are alike (1),
while an empty and another one are not (0); a null doc_id comes before all others (with the least long, before
it); rows that share a doc_id are ordered by text; a lone document is its own next; texts of any length are read
whole; ids pass through untouched; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from .common import WordHash, rolling

K = 256
SHINGLE = 5
RANGES = 4
FIRST = -(1 << 63)


def sketch(text: str | None, memo: WordHash | None = None, k: int = K, shingle: int = SHINGLE) -> np.ndarray:
    """The k least distinct hashes, ascending.  Words are runs of other than ASCII white space, A-Z lower-cased."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint32)
    h = (WordHash() if memo is None else memo).array(words)
    h = (rolling(h, min(shingle, len(h))) >> np.uint64(32)).astype(np.uint32)
    if len(h) > 8 * k:  # the few least first, unless repeats leave too few of them
        least = np.unique(np.partition(h, 4 * k)[: 4 * k])
        if len(least) >= k:
            return least[:k]
    return np.unique(h)[:k]


def merge(*parts: np.ndarray, k: int = K) -> np.ndarray:
    return np.unique(np.concatenate(parts))[:k] if parts else np.empty(0, np.uint32)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard likeness: of the k least hashes of the union, the share that both hold."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = merge(a, b, k=k)
    return int((np.isin(union, a, assume_unique=True) & np.isin(union, b, assume_unique=True)).sum()) / len(union)


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[-1]) + 1) / 2.0**32)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b holds."""
    if not len(a):
        return 1.0
    n_union = distinct(merge(a, b, k=k), k)
    return min(1.0, resemblance(a, b, k) * n_union / distinct(a, k))


def pack(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u4").tobytes()).decode()


def unpack(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), "<u4").astype(np.uint32)


def fingerprints(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, n_distinct) of whole texts; no shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHash()
        for b in batches:
            s = [sketch(t, memo, k, shingle) for t in b.column(1).to_pylist()]
            cols = [b.column(0), pa.array([pack(x) for x in s], pa.string()), pa.array([distinct(x, k) for x in s], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "fingerprint", "n_distinct"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, fingerprint string, n_distinct double")


def merged(parts: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """``by`` columns, with the sketch (and distinct count) of all parts of a group, from (by, fingerprint) rows.

    The least k distinct hashes of a group are found by a partial aggregation of hashes and a ranking of what is
    left, both of which Spark spreads: first within salts of a group, then over the salts, so that no task meets
    more than k hashes of each salt of a large group.
    """
    hashes = parts.withColumn("h", F.explode(_hashes_of("fingerprint"))).withColumn("salt", F.pmod(F.hash("h"), F.lit(64)))
    for keys in ([*by, "salt"], by):
        least = Window.partitionBy(*keys).orderBy("h")
        hashes = hashes.select(*by, "salt", "h").distinct().withColumn("place", F.row_number().over(least)).where(F.col("place") <= k)
    packed = hashes.groupBy(*by).agg(F.sort_array(F.collect_list("h")).alias("h"))
    return parts.select(*by).distinct().join(packed, by, "left").select(*by, _packed("h").alias("fingerprint"))


@F.pandas_udf(ArrayType(LongType()))
def _hashes_of(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unpack(x or "").astype(np.int64))


@F.pandas_udf(StringType())
def _packed(h: pd.Series) -> pd.Series:
    return h.map(lambda x: pack(np.asarray([] if x is None else x, np.uint32)))


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_distinct double, within_edited double"


def compare_edited(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """A row a document: its sketch, that of its edited text, their likeness, that to the next document's, the estimated
    number of distinct shingles, and the estimated share of them that the edited text holds."""
    spark = docs.sparkSession
    d = docs.select(F.coalesce(F.col("doc_id"), F.lit(FIRST)).alias("id"), "text", F.col("doc_id").isNotNull().alias("named"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    at = [float(x) for x in np.arange(1, RANGES * n) / (RANGES * n)] or [0.5]
    low, cuts = d.agg(F.min("id"), F.percentile_approx("id", F.array(*[F.lit(x) for x in at]), F.lit(100 * RANGES * n))).first()
    if low is None:
        return spark.createDataFrame([], OUT)
    starts = np.array(sorted(set(cuts) - {low}), np.int64)

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series) -> pd.Series:
        """2 x range, and 2 x range + 1 where the row is the next one of a range's last."""
        x = ids.to_numpy(np.int64)
        own, left = np.searchsorted(starts, x, side="right"), np.searchsorted(starts, x, side="left")
        out = [[2 * int(i)] if i == j else [2 * int(i), 2 * int(i) - 1] for i, j in zip(own, left, strict=True)]
        for i in np.flatnonzero(x == low):
            out[i] = [0, 2 * len(starts) + 1]
        return pd.Series(out)

    dealt = d.withColumn("p", F.explode(places("id"))).withColumn("part", F.shiftright("p", 1)).repartition(n, "part").sortWithinPartitions("p", "id", "named", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHash()
        held = None  # (part, id, text, sketch) of the row that waits for its next one
        for b in batches:
            rows = []
            for p, i, named, text in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                extra, part, text = p & 1, p >> 1, text or ""
                if extra and (held is None or held[0] != part):
                    continue
                s = sketch(text, memo, k, shingle)
                if held is not None and held[0] == part:
                    _, j, own, fp = held
                    m = len(own) // 2
                    edited = own[: len(own) - m] + text[:m]
                    e = sketch(edited, memo, k, shingle)
                    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    rows.append((j, len(own), sha, pack(fp), pack(e), resemblance(fp, e, k), resemblance(fp, s, k), distinct(fp, k), containment(fp, e, k)))
                held = None if extra else (part, i if named else None, text, s)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 9, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in OUT.split(", ")])

    return dealt.select("p", "id", "named", "text").mapInArrow(work, OUT)
