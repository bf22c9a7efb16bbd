"""Operator 12, source divergence audit: how far each source of a language departs from the others and from the whole.

Terms are runs of A-Z (lower-cased), a-z and characters beyond ASCII.  Tasks encode the words of their texts as
integers and count them by (language, source) group; what they have counted is summed by Spark, and terms in fewer
than three documents of a language go.  Kept terms are dealt to ranges of (language, term) in UTF-8 order and packed
in chunks: a sorted array of terms, whose places are their ids, and entries found in it by binary search.  A chunk's
counts become dense vectors, one a group, by ``bincount``; from them come each pair's part of the divergence and each
group's leading terms (ties by id, which is UTF-8 order).  Vocabularies, groups and counts are never held whole by
the driver or a task; sources of one language are held as one list, as its pairs are part of the result anyway.

Shares are parts in 10^9, smoothed by one count, p = 1 + floor(10^9 (count + 1) / (N + V)); a departure is
floor((p - q)^2 / q).  All arithmetic is exact: 64-bit integers, or Python's where a count could overflow them.

Defined results: null text, lang and source are ''; rows that repeat are documents of their own; a group without
terms counts zero of each kept term; a language without kept terms has pairs of value 0; a language of one source
has no pairs; texts and terms of any length are read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SHARE = 1_000_000_000
LEAST_DOCUMENTS = 3
RANKS = 200
#: terms of a chunk; sources of one block of pairs; (group, term) pairs that a task holds before it passes them on
CHUNK, SOURCES, HELD = 4096, 64, 1 << 18
#: sums of pairs that a task holds before it passes them on
CELLS = 1 << 20
#: copies of a language's list of sources, so that its chunks meet it in several tasks; parts of a group's terms that are ranked first
SALTS, RANK_SALTS = 64, 8
#: counts below this have 64-bit shares
EXACT = ((1 << 63) - 1) // SHARE - 1
_OTHER = bytes(c for c in range(128) if not chr(c).isalpha())
TERMS = bytes.maketrans(_OTHER + bytes(range(65, 91)), b" " * len(_OTHER) + bytes(range(97, 123)))


class Ids(dict):
    """Word to its number, in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Tally:
    """Occurrences and documents of (group, term) pairs, by integer ids; groups are (lang, source)."""

    def __init__(self):
        self.groups, self.terms, self.pending, self.size = Ids(), Ids(), [], 0

    def add(self, lang: str, source: str, text: bytes) -> None:
        group = self.groups[lang, source]
        words = text.translate(TERMS).split()
        ids, n = np.unique(np.fromiter(map(self.terms.__getitem__, words), np.int64, len(words)), return_counts=True)
        self.pending.append((ids + (group << 40), n, np.ones(len(ids), np.int64)))
        self.size += len(ids)
        if self.size > 2 * HELD:
            self.compact()

    def compact(self) -> None:
        if self.pending:
            keys, n, docs = (np.concatenate(x) for x in zip(*self.pending, strict=True))
            keys, at = np.unique(keys, return_inverse=True)
            held = []
            for x in (n, docs):
                total = np.zeros(len(keys), np.int64)
                np.add.at(total, at, x)
                held.append(total)
            self.pending = [(keys, *held)]
            self.size = len(keys)

    def full(self) -> bool:
        return self.size > HELD or len(self.terms) > HELD

    def take(self) -> pa.RecordBatch:
        """All that is held, and a row without a term for each group; the tally is then empty."""
        self.compact()
        keys, n, docs = self.pending[0] if self.pending else (np.empty(0, np.int64),) * 3
        groups, terms = list(self.groups), pa.array(list(self.terms), pa.binary())
        of = np.concatenate([keys >> 40, np.arange(len(groups))])
        none = np.zeros(len(groups), np.int64)
        lang, source = (pa.array([g[i] for g in groups], pa.string()).take(pa.array(of)) for i in (0, 1))
        term = pa.chunked_array([terms.take(pa.array(keys & ((1 << 40) - 1))), pa.nulls(len(groups), pa.binary())]).combine_chunks()
        self.__init__()
        return pa.RecordBatch.from_arrays([lang, source, term, pa.array(np.concatenate([n, none])), pa.array(np.concatenate([docs, none]))], ["lang", "source", "term", "n", "docs"])


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = Tally()
    for b in batches:
        for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            held.add(lang, source, text.as_py())
            if held.size > 2 * HELD or len(held.terms) > HELD:
                held.compact()
                if held.full():
                    yield held.take()
    yield held.take()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term of a group; a null term for each group."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), text.alias("text"))
    counted = rows.mapInArrow(_tally, "lang string, source string, term binary, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of rows that come sorted by (lang, term): sorted terms, their totals, and entries by id and source."""
    lang, terms, totals, ids, sources, counts, size, number = None, [], [], [], [], [], 0, 0

    def chunk() -> pa.RecordBatch:
        order = np.empty(len(terms), object)
        order[:] = terms
        words = np.empty(len(ids), object)
        words[:] = ids
        at = np.searchsorted(order, words)
        cols = [[lang], [number % SALTS], [terms], [totals], [at.astype(np.int32)], [sources], [counts]]
        kinds = [pa.string(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["lang", "salt", "terms", "totals", "at", "sources", "n"])

    for b in batches:
        for of, term, source, n, total in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if terms and (of != lang or term != terms[-1] and (len(terms) >= CHUNK or len(ids) >= 16 * CHUNK or size > 1 << 24)):
                yield chunk()
                terms, totals, ids, sources, counts, size, number = [], [], [], [], [], 0, number + 1
            lang = of
            if not terms or term != terms[-1]:
                terms.append(term)
                totals.append(total)
                size += len(term)
            ids.append(term)
            sources.append(source)
            counts.append(n)
    if terms:
        yield chunk()


def shares(counts: np.ndarray, totals: np.ndarray | int, kept: int) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / (N + V)), exactly."""
    if counts.size and int(counts.max()) >= EXACT:
        counts = counts.astype(object)
    return 1 + (counts + 1) * SHARE // (totals + kept)


def departures(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    gap = p - q
    return gap * gap // q


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk, each pair's part of the divergence and each group's leading terms."""
    sums: dict[str, tuple[list[str], np.ndarray]] = {}  # of languages whose pairs of sources are few
    for b in batches:
        for r in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
            names, kept, terms = r["names"], r["kept"], r["terms"]
            of = {s: i for i, s in enumerate(names)}
            group = np.fromiter((of[s] for s in r["sources"]), np.int64, len(r["sources"]))
            at, n = np.array(r["at"], np.int64), np.array(r["n"], np.int64)
            size = np.array(r["sizes"], np.int64)
            base = shares(np.array(r["totals"], np.int64), r["total"], kept)

            def dense(lo: int) -> tuple[np.ndarray, np.ndarray]:
                """Counts and shares of sources lo, lo + 1, ..., a row a source."""
                high = min(lo + SOURCES, len(names))
                own = (group >= lo) & (group < high)
                count = np.zeros((high - lo) * len(terms), np.int64)
                place = (group[own] - lo) * len(terms) + at[own]
                if n[own].max(initial=0) < 1 << 52:
                    count[:] = np.bincount(place, weights=n[own], minlength=len(count))
                else:
                    count[place] = n[own]  # an entry is met once
                count = count.reshape(high - lo, len(terms))
                return count, shares(count, size[lo:high, None], kept)

            few = len(names) <= 16 * SOURCES
            if few and r["lang"] not in sums:
                if sum(len(x) ** 2 for x, _ in sums.values()) > CELLS:
                    for lang, (held, total) in sums.items():
                        yield from _pairs(lang, held, held, total)
                    sums.clear()
                sums[r["lang"]] = names, np.zeros((len(names), len(names)), object)
            for lo in range(0, len(names), SOURCES):
                count, p = dense(lo)
                yield from _leading(r["lang"], names[lo : lo + SOURCES], terms, count, p, base)
                for lo2 in range(0, len(names), SOURCES):
                    q = p if lo2 == lo else dense(lo2)[1]
                    part = np.empty((len(p), len(q)), object)
                    for i in range(len(p)):
                        part[i] = departures(p[i], q).sum(axis=1)
                    if few:
                        sums[r["lang"]][1][lo : lo + len(p), lo2 : lo2 + len(q)] += part
                    else:
                        yield from _pairs(r["lang"], names[lo : lo + SOURCES], names[lo2 : lo2 + SOURCES], part)
    for lang, (names, total) in sums.items():
        yield from _pairs(lang, names, names, total)


def _rows(lang: str, sources: list[str], part: str, items: list[bytes], values: list[int]) -> pa.RecordBatch:
    n = len(items)
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * n, pa.string()), pa.array(sources, pa.string()), pa.array([part] * n, pa.string()), pa.array(items, pa.binary()), pa.array(values, pa.int64())],
        ["lang", "source", "part", "item", "value"],
    )


def _leading(lang: str, names: list[str], terms: list[bytes], count: np.ndarray, p: np.ndarray, base: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i, source in enumerate(names):
        own = np.flatnonzero((count[i] > 0) & (p[i] > base))
        value = departures(p[i, own], base[own]).astype(np.int64)
        first = own[order := np.lexsort((own, -value))[:RANKS]]
        if len(first):
            yield _rows(lang, [source] * len(first), "term", [terms[k] for k in first], value[order].tolist())


def _pairs(lang: str, names: list[str], others: list[str], value: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i, source in enumerate(names):
        at = [j for j, other in enumerate(others) if other != source]
        if at:
            yield _rows(lang, [source] * len(at), "pair", [others[j].encode() for j in at], [int(value[i, j]) for j in at])


def audit(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): departures from each other source, and the terms that lead from the whole."""
    counts = cut(term_counts(docs))
    term = Window.partitionBy("lang", "term")
    kept = counts.where("term is not null").withColumn("in_docs", F.sum("docs").over(term)).withColumn("total", F.sum("n").over(term))
    kept = cut(kept.where(F.col("in_docs") >= LEAST_DOCUMENTS).select("lang", "term", "source", "n", "total"))
    sizes = counts.where("term is null").select("lang", "source").join(kept.groupBy("lang", "source").agg(F.sum("n").alias("size")), ["lang", "source"], "left")
    groups = sizes.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("size", F.lit(0)).alias("size")))).alias("g"))
    vocabulary = kept.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("total"))
    langs = cut(groups.join(vocabulary, "lang", "left").select("lang", F.col("g.source").alias("names"), F.col("g.size").alias("sizes"), "kept", "total"))

    packed = kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term", "source").mapInArrow(
        _pack, "lang string, salt int, terms array<binary>, totals array<long>, at array<int>, sources array<string>, n array<long>"
    )
    salted = langs.where("kept > 0").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = cut(packed.join(salted, ["lang", "salt"]).mapInArrow(_compare, "lang string, source string, part string, item binary, value long"))

    bare = langs.where("kept is null").select("lang", "names", F.explode("names").alias("source")).withColumn("other", F.explode("names")).where("source <> other")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value"))
    pairs = pairs.union(bare.select("lang", "source", F.lit("pair"), F.col("other").cast("binary"), F.lit(0).cast("long")))
    place = lambda *by: F.row_number().over(Window.partitionBy("lang", "source", "part", *by).orderBy(F.desc("value"), "item"))
    terms = found.where("part = 'term'")
    for by in (F.pmod(F.hash("item"), F.lit(RANK_SALTS)),), ():  # first within salts of a group, to which many chunks have added
        terms = terms.withColumn("rank", place(*by)).where(F.col("rank") <= RANKS)
    ranked = pairs.withColumn("rank", place()).union(terms)
    return ranked.select("lang", "source", "part", F.col("item").cast("string").alias("item"), "value", "rank")
