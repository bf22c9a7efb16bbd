"""Operator 5, benchmark decontamination by winnowing.

Benchmark items and documents are reduced to winnowed fingerprints: of the K-gram hashes in each window of
K + W - 1 = SPAN words, the least is kept.  Two texts that share SPAN consecutive words share the fingerprint
of that window, so that looking up a document's fingerprints among the benchmark's misses no span.  Where a
fingerprint meets, the windows it stands for are compared, and windows that follow each other are one longer
run: a hit is extended window by window, in time linear in the document, however often words repeat.  An item
of fewer words than SPAN is one window: its whole word sequence is looked up at every place.

The benchmark's index is handed to all tasks in blocks of at most ``INDEX_BYTES`` of text (or one item); a
benchmark of several blocks is matched block by block, and what the blocks find in a document is added up.
Documents are read where they lie: no text and no fingerprint is shuffled, so no common passage is a hot key.
Items that hold the same window share one list of owners.

Defined results: null and empty texts have no words; an item without words never occurs; items that repeat
an id count once; a null item_id is written as an empty string; repeated documents each get their result;
texts of any length are read whole; ids pass through untouched; an empty table of either kind gives the
documents there are, uncontaminated; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, cut, rolling

SPAN = 10
K = 5
INDEX_BYTES = 8 << 20
#: lower-cases A-Z and turns every other ASCII character that is no letter or digit into a space
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
OUT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<int>"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TO_WORDS).split() if text else []


def least_places(g: np.ndarray, span: int = SPAN, k: int = K) -> np.ndarray:
    """For each window of ``span`` words, the place of the least of its K-gram hashes (the first one of equal ones)."""
    w = span - k + 1
    if len(g) < w:
        return np.empty(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(g, w)
    return np.arange(len(view)) + view.argmin(axis=1)


class Index:
    """Benchmark items' fingerprints and windows, sorted for lookup; windows point to the list of items that hold them."""

    def __init__(self, items: list[tuple[str, list[bytes]]], span: int = SPAN, k: int = K):
        self.span, self.k = span, k
        memo, prints = WordHash(), []
        grams: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}
        self.ids = sorted({name for name, words in items if words})
        place = {name: i for i, name in enumerate(self.ids)}
        for name, words in items:
            if not words:
                continue
            h, n = memo.array(words), min(len(words), span)
            if n == span:
                g = rolling(h, k)
                prints.append(np.unique(g[least_places(g, span, k)]))
            windows = np.unique(rolling(h, n))
            some = grams.setdefault(n, ([], []))
            some[0].append(windows)
            some[1].append(np.full(len(windows), place[name]))
        self.prints = np.unique(np.concatenate(prints)) if prints else np.empty(0, np.uint64)
        #: by length: the windows' hashes, and for each its list of owners
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.owners: list[list[int]] = []
        known: dict[bytes, int] = {}
        for n, (hashes, of) in grams.items():
            h, item = np.concatenate(hashes), np.concatenate(of)
            order = np.lexsort((item, h))
            h, item = h[order], item[order]
            start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            own = []
            for a, b in zip(start.tolist(), np.append(start[1:], len(h)).tolist()):
                some = np.unique(item[a:b])
                no = known.setdefault(some.tobytes(), len(self.owners))
                if no == len(self.owners):
                    self.owners.append(some.tolist())
                own.append(no)
            self.windows[n] = (h[start], np.array(own, np.int64))

    def hits(self, h: np.ndarray) -> tuple[set[int], list[int]]:
        """(numbers of the items with occurring windows, merged runs as first words and ends in turn) in a document's word hashes."""
        lists: set[int] = set()
        cover = None
        for n, (windows, own) in self.windows.items():
            if len(h) < n:
                continue
            start = np.arange(len(h) - n + 1)
            if n == self.span:
                g = rolling(h, self.k)
                meets = is_in(g, self.prints)
                if not meets.any():
                    continue
                start = start[meets[least_places(g, self.span, self.k)]]
            found = rolling(h, n)[start]
            at = np.minimum(np.searchsorted(windows, found), len(windows) - 1)
            ok = windows[at] == found
            if ok.any():
                lists.update(np.unique(own[at[ok]]).tolist())
                cover = np.zeros(len(h) + 1, np.int64) if cover is None else cover
                np.add.at(cover, start[ok], 1)
                np.add.at(cover, start[ok] + n, -1)
        if cover is None:
            return set(), []
        inside = np.concatenate(([False], np.cumsum(cover)[:-1] > 0, [False]))
        return set().union(*(self.owners[i] for i in lists)), np.flatnonzero(inside[1:] != inside[:-1]).tolist()


def is_in(x: np.ndarray, some: np.ndarray) -> np.ndarray:
    return some[np.minimum(np.searchsorted(some, x), len(some) - 1)] == x if len(some) else np.zeros(len(x), bool)


def merged(spans: list[int]) -> list[int]:
    """Runs in any order, with those that touch made one."""
    out: list[int] = []
    for a, b in sorted(zip(spans[::2], spans[1::2])):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def records(doc_id: pa.Array, n_words: list[int], names: list[list[str]], spans: list[list[int]]) -> pa.RecordBatch:
    n_hit = [sum(s[1::2]) - sum(s[::2]) for s in spans]
    sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]
    cols = [doc_id, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in names], pa.int64()), pa.array(sha, pa.string())]
    cols += [pa.array([x > 0 for x in n_hit], pa.bool_()), pa.array(names, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in OUT.split(", ")])


def _by_index(docs: DataFrame, index: Index) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idx, memo = shared.value, WordHash()
        for b in batches:
            n, names, spans = [], [], []
            for text in b.column(1).to_pylist():
                words = words_of(text)
                found, runs = idx.hits(memo.array(words)) if words else ((), [])
                n.append(len(words))
                names.append(sorted(idx.ids[i] for i in found))
                spans.append(runs)
            yield records(b.column(0), n, names, spans)

    return docs.select("doc_id", "text").mapInArrow(work, OUT)


def _by_blocks(docs: DataFrame, items: DataFrame, blocks: int, span: int, k: int) -> DataFrame:
    """For benchmarks of any size: block after block, each handed to the tasks; rows are told by a number that is written first."""
    d = cut(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()))
    one, found = None, None
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        part = _by_index(d.select(F.col("row").alias("doc_id"), "text"), Index([(r[0], words_of(r[1])) for r in rows], span, k))
        one = part if one is None else one
        part = cut(part.where("n_hit > 0").select(F.col("doc_id").alias("row"), "items", "spans"))
        found = part if found is None else found.union(part)
    base = one.select(F.col("doc_id").alias("row"), "n_words").join(d.select("row", "doc_id"), "row")
    found = found.groupBy("row").agg(F.collect_list("items").alias("items"), F.collect_list("spans").alias("spans"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, names, spans = (b.column(i).to_pylist() for i in (1, 2, 3))
            yield records(b.column(0), n, [sorted(set().union(*(x or []))) for x in names], [merged([y for x in s or [] for y in x]) for s in spans])

    return base.join(found, "row", "left").select("doc_id", "n_words", "items", "spans").mapInArrow(finish, OUT)


def decontaminate(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = K, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """One row a document: counts, digest of the item ids found, ``items`` and merged word ``spans`` (starts and ends in turn)."""
    if not 1 <= k <= span:
        raise ValueError("k must be between 1 and span")
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").where("text is not null")
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    if size > index_bytes:
        return _by_blocks(docs, items, int(2 * size // max(1, index_bytes)) + 1, span, k)
    return _by_index(docs, Index([(r[0], words_of(r[1])) for r in items.collect()], span, k))
