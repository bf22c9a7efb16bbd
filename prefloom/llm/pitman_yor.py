"""Operator 7, LM scoring by a hierarchical Pitman-Yor model.

Tokens are words and one end.  Common words have at least 1 / ``COMMON`` of the training tokens, so there are
at most ``COMMON`` of them; all others are rare.  Two hierarchies of restaurants share the work:

* tier: a restaurant for each word before, all with one restaurant of all tokens as their parent, over a uniform
  base.  Its dishes are the common words and "a rare word".
* rare words: a restaurant for each of 65,536 contexts (the word before, hashed), all with one restaurant of
  rare words as their parent, over a uniform base on the known rare words and one unknown.

The probability of a token is the tier's, times for rare words that of the rare hierarchy.  Seating is
sampled by Gibbs sweeps, blocked by level: a sweep re-seats each dish's customers given its restaurant's
tables and its parent's predictive probabilities in the state before; tables are customers of the parent.
The first customers of a dish are seated one by one, later ones in blocks of a quarter of those seated,
within which the probability of a new table is held.  Draws are hashes of dish, sweep and step, so they
depend neither on partitioning nor on lost executors.  Predictive probabilities are averaged over the sweeps
after ``BURN_IN``.

Scale.  The tier's counts are dealt by the word before, so that a restaurant is whole in a task; what tasks must know of
all others is the parent's probability of each dish, at most ``COMMON`` of them.  Restaurants of words with 1 /
``FREQUENT`` of the tokens or so are handed to all tasks, as is the parent; tokens after other words are dealt to their
restaurants.  The rare words' contexts are hashed, so that their totals may meet on the driver.  Rare tokens are
pre-aggregated and dealt by word as packed arrays; they are both counted and scored where they meet.  Documents' sums are
then added up, as whole numbers of ``UNIT``.  No text is shuffled.  A word is told by 48 bits of its hash.

Dealt tokens lie on disk once: all passes read the files of one shuffle, and nothing is written beside them.  Files of
an executor that is lost are made again from the documents, which must then come in the same order, as those of stored
tables do; documents that come from a join or a grouping should be written first.

Defined results: a null or empty text is one end token; with no training document all words are unknown;
repeated rows are scored, and learned from, each; an empty table gives none; a null doc_id counts as an
empty text in the hold-out rule; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import count, groupby, islice

import numpy as np
import pandas as pd
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, cut, mix64, release, uniform

MOD = 5
COMMON = 8192
#: a word before with about this share of the tokens has its restaurant handed to all tasks
FREQUENT = 1024
SWEEPS = 3
BURN_IN = 1
STRENGTH = 1.0
#: tokens that one packed part should hold, about
PART_TOKENS = 1_000_000
END, START = b"", b" "
HIGH = np.uint64(0xFFFFFFFFFFFF0000)
LOW = np.uint64(0xFFFF)
#: a token's logarithms are added up as whole numbers of this unit, so that sums depend on no order
UNIT = 2.0**-30


def held_out(mod: int = MOD):
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(mod)) == 1


def tokens(text: str | None) -> list[bytes]:
    """Words (runs of other than ASCII white space, A-Z lower-cased), then the end."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    words.append(END)
    return words


def seat(customers: np.ndarray, new: np.ndarray, discount: float, key: np.ndarray, *salt: int) -> np.ndarray:
    """Numbers of tables of dishes with these customers; ``new`` is (strength + discount tables) x parent's probability."""
    tables = np.minimum(customers, 1).astype(np.float64)
    live = np.flatnonzero(customers > 1)
    seated, step = 1, 0
    while len(live):
        block = 1 if seated < 32 else seated // 4
        size = np.minimum(block, customers[live] - seated).astype(np.float64)
        t = tables[live]
        p = new[live] / (new[live] + np.maximum(seated + (size - 1) / 2 - discount * t, 1e-9))
        u = uniform(key[live], *salt, step)
        if block == 1:
            tables[live] = t + (u < p)
        else:  # a binomial draw: by inversion where few are expected, else from the normal curve
            mean = size * p
            draw, few = np.zeros(len(live)), mean < 12
            pmf = np.exp(-mean[few])
            cdf, k = pmf.copy(), np.zeros(len(pmf))
            for n in range(1, 80):
                more = u[few] > cdf
                if not more.any():
                    break
                k[more] += 1
                pmf = pmf * mean[few] / n
                cdf = cdf + pmf
            draw[few] = k
            z = np.sqrt(-2 * np.log(u[~few])) * np.cos(2 * np.pi * uniform(key[live][~few], *salt, step, 1))
            draw[~few] = np.round(mean[~few] + z * np.sqrt(mean[~few] * (1 - p[~few])))
            tables[live] = t + np.clip(draw, 0, size)
        seated, step = seated + block, step + 1
        live = live[customers[live] > seated]
    return tables


def discount_of(ones: float, twos: float) -> float:
    """n1 / (n1 + 2 n2), kept away from 0 and 1."""
    return float(min(0.95, max(0.05, ones / (ones + 2 * twos)))) if ones + twos else 0.5


def place(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Where ``among`` (sorted) has the values; its length for those that it lacks."""
    if not len(among):
        return np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(among, x), len(among) - 1)
    return np.where(among[at] == x, at, len(among))


# -- the tier ----------------------------------------------------------------------------------------------------------


def parent_of(c1: np.ndarray, t1: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
    """The parent's tables and predictive probabilities of dishes with these customers, from its tables before."""
    dishes = len(c1)
    d1 = discount_of((c1 == 1).sum(), (c1 == 2).sum())
    t1 = seat(c1, np.full(dishes, (STRENGTH + d1 * t1.sum()) / dishes), d1, np.arange(dishes).astype(np.uint64), 22, s)
    return t1, (c1 - d1 * t1 + (STRENGTH + d1 * t1.sum()) / dishes) / (STRENGTH + c1.sum())


class Restaurants:
    """The tier's restaurants of some words before: counts by (word before, dish), and a state of seating."""

    def __init__(self, key: np.ndarray, n: np.ndarray, dish_of: np.ndarray):
        """``dish_of``: the dish of each candidate."""
        self.key, at = np.unique((key & HIGH) | dish_of[(key & LOW).astype(np.int64)], return_inverse=True)
        self.c = np.bincount(at, weights=n, minlength=len(self.key)).astype(np.int64)
        self.dish = (self.key & LOW).astype(np.int64)
        self.word, self.at = np.unique(self.key & HIGH, return_inverse=True)
        self.total = np.bincount(self.at, weights=self.c, minlength=len(self.word))
        self.t = np.minimum(self.c, 1).astype(np.float64)

    def tables(self) -> np.ndarray:
        return np.bincount(self.at, weights=self.t, minlength=len(self.word))

    def sweep(self, parent: np.ndarray, d: float, s: int) -> None:
        self.t = seat(self.c, (STRENGTH + d * self.tables()[self.at]) * parent[self.dish], d, self.key, 21, s)

    def score(self, parent: np.ndarray, d: float, key: np.ndarray) -> np.ndarray:
        """Predictive probabilities of any (word before, dish)."""
        share = np.append((STRENGTH + d * self.tables()) / (STRENGTH + self.total), 1.0)
        own = np.append((self.c - d * self.t) / (STRENGTH + self.total)[self.at], 0.0)
        return own[place(key, self.key)] + share[place(key & HIGH, self.word)] * parent[(key & LOW).astype(np.int64)]

    def mean(self, m: dict, key: np.ndarray) -> np.ndarray:
        """Runs all sweeps; the mean of the probabilities after each but the first ones."""
        p, sweeps = np.zeros(len(key)), len(m["parents"]) - 1
        for s in range(1, sweeps + 1):
            self.sweep(m["parents"][s - 1], m["d"], s)
            if s > m["burn_in"]:
                p += self.score(m["parents"][s], m["d"], key) / (sweeps - m["burn_in"])
        return p


def tier_model(counts: np.ndarray, sweeps: int = SWEEPS, burn_in: int = BURN_IN) -> np.ndarray:
    """log10 of predictive probabilities, context x dish, from the counts of the same shape: all of the tier in one place."""
    classes, dishes = counts.shape
    row, dish = np.nonzero(counts)
    c = counts[row, dish].astype(np.int64)
    d = discount_of((c == 1).sum(), (c == 2).sum())
    key = (row * dishes + dish).astype(np.uint64)
    t, c1 = np.minimum(c, 1).astype(np.float64), None
    parent, total, out = np.full(dishes, 1 / dishes), counts.sum(axis=1), np.zeros(counts.shape)
    t1 = np.zeros(dishes)
    for s in range(1, sweeps + 1):
        tables = np.bincount(row, weights=t, minlength=classes)
        t = seat(c, (STRENGTH + d * tables[row]) * parent[dish], d, key, 21, s)
        c1 = np.bincount(dish, weights=t, minlength=dishes).astype(np.int64)
        t1, parent = parent_of(c1, t1, s)
        if s > burn_in:
            tables = np.bincount(row, weights=t, minlength=classes)
            p = ((STRENGTH + d * tables) / (STRENGTH + total))[:, None] * parent
            p[row, dish] += (c - d * t) / (STRENGTH + total)[row]
            out += p / (sweeps - burn_in)
    return np.log10(out)


# -- rare words: sampled where they are dealt ------------------------------------------------------------------------


class Totals:
    """What tasks must know of all others: customers and tables of the contexts and of their parent."""

    def __init__(self, customers: np.ndarray, tables: np.ndarray, c1: float, t1: float):
        self.customers, self.tables, self.c1, self.t1 = customers, tables, c1, t1


class Cells:
    """The distinct (word, context) of some words with their training counts, and a state of seating."""

    def __init__(self, key: np.ndarray, c: np.ndarray):
        self.key, self.c = key, c
        self.ctx = (key & LOW).astype(np.int64)
        self.word, self.at = np.unique(key & HIGH, return_inverse=True)
        self.t = np.minimum(c, 1).astype(np.float64)
        self.c1 = np.bincount(self.at, weights=self.t, minlength=len(self.word)).astype(np.int64)
        self.t1 = np.minimum(self.c1, 1).astype(np.float64)

    def parent(self, g: Totals, m: dict) -> np.ndarray:
        return (self.c1 - m["d1"] * self.t1 + (STRENGTH + m["d1"] * g.t1) * m["uniform"]) / (STRENGTH + g.c1)

    def sweep(self, g: Totals, m: dict, s: int) -> None:
        self.t = seat(self.c, (STRENGTH + m["d"] * g.tables[self.ctx]) * self.parent(g, m)[self.at], m["d"], self.key, 31, s)
        self.c1 = np.bincount(self.at, weights=self.t, minlength=len(self.word)).astype(np.int64)
        self.t1 = seat(self.c1, np.full(len(self.word), (STRENGTH + m["d1"] * g.t1) * m["uniform"]), m["d1"], self.word, 32, s)

    def score(self, g: Totals, m: dict, key: np.ndarray) -> np.ndarray:
        """Predictive probabilities of any (word, context)."""
        unknown = (STRENGTH + m["d1"] * g.t1) * m["uniform"] / (STRENGTH + g.c1)
        ctx = (key & LOW).astype(np.int64)
        p1 = np.full(len(key), unknown)
        own, cell = np.zeros(len(key)), np.zeros(len(key), np.int64)
        if len(self.key):
            at = np.minimum(np.searchsorted(self.word, key & HIGH), len(self.word) - 1)
            some = self.word[at] == (key & HIGH)
            p1[some] = self.parent(g, m)[at[some]]
            cell = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            same = self.key[cell] == key
            own[same] = (self.c - m["d"] * self.t)[cell[same]]
        return (own + (STRENGTH + m["d"] * g.tables[ctx]) * p1) / (STRENGTH + g.customers[ctx])


def squeeze(columns: list[np.ndarray], widths: list[int]) -> bytes:
    """Columns of whole numbers of so many bytes, split into planes of bytes."""
    import zstandard

    planes = (x.astype(f"<u{w if w in (2, 4) else 8}").view(np.uint8).reshape(len(x), -1)[:, :w].T.tobytes() if len(x) else b"" for x, w in zip(columns, widths, strict=True))
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unsqueeze(blob: bytes, widths: list[int]) -> list[np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    m, at, out = len(raw) // sum(widths), 0, []
    for w in widths:
        x = np.zeros((m, 8), np.uint8)
        x[:, :w] = raw[at : at + w * m].reshape(w, m).T
        out.append(x.view("<u8").ravel())
        at += w * m
    return out


#: bytes of a word's difference and number of cells; of a cell's lower key, place and count; of a row's difference and sums
WORD, CELL, SUMS = [6, 4], [2, 2, 4], [8, 8, 8, 8]


def pack(key: np.ndarray, local: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted keys, each word (the upper 48 bits) once, with the places and counts."""
    word = key >> np.uint64(16)
    first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    words = squeeze([np.diff(word[first], prepend=np.uint64(0)), np.diff(np.append(first, len(key)))], WORD)
    return words, squeeze([key & LOW, local, n], CELL)


def unpack(words: bytes, cells: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    step, times = unsqueeze(words, WORD)
    low, local, n = unsqueeze(cells, CELL)
    return np.repeat(np.cumsum(step, dtype=np.uint64) << np.uint64(16), times.astype(np.int64)) | low, local.astype(np.int64), n.astype(np.int64)


def pack_sums(row: np.ndarray, *sums: np.ndarray) -> bytes:
    """Sorted rows as differences, then signed sums, small ones in few bytes."""
    return squeeze([np.diff(row, prepend=np.int64(0)), *((x << 1) ^ (x >> 63) for x in sums)], SUMS)


def unpack_sums(blob: bytes) -> list[np.ndarray]:
    row, *sums = (x.astype(np.int64) for x in unsqueeze(blob, SUMS))
    return [np.cumsum(row), *(((x >> 1) & np.int64((1 << 63) - 1)) ^ -(x & 1) for x in sums)]


def add_up(row: np.ndarray, *sums: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(row)
    row = row[order]
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.empty(0, np.int64)
    return row[first], *(np.add.reduceat(x[order], first) if len(first) else x for x in sums)


class Reader:
    """Texts to words' numbers; by number, words' hashes (``h``), these mixed (as words before), dishes and places among ``contexts``."""

    def __init__(self, common: np.ndarray, contexts: np.ndarray | None = None, most: int = 400_000):
        self.common, self.contexts, self.most = common, np.empty(0, np.uint64) if contexts is None else contexts, most
        self.clear()

    def clear(self) -> None:
        self.words: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.h, self.mixed, self.dish, self.cls = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.start = self.words[START]

    def read(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all texts' tokens: the word's number, the text's, and that of the word before."""
        import xxhash

        if len(self.words) > self.most:
            self.clear()
        parts = [np.fromiter(map(self.words.__getitem__, w), np.int64, len(w)) for w in map(tokens, texts)]
        if new := len(self.words) - len(self.h):
            h = np.fromiter(map(xxhash.xxh64_intdigest, islice(reversed(self.words), new)), np.uint64, new)[::-1]
            mixed = mix64(h)
            self.h, self.mixed = np.append(self.h, h), np.append(self.mixed, mixed)
            self.dish, self.cls = np.append(self.dish, place(h, self.common)), np.append(self.cls, place(mixed & HIGH, self.contexts))
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        word = np.concatenate(parts)
        before = np.roll(word, 1)
        before[np.cumsum(n) - n] = self.start
        return word, np.repeat(np.arange(len(n)), n), before


def chunks(rows: Iterable[tuple], most: int = 4_000_000) -> Iterator[list[tuple]]:
    """Lists of rows whose last fields, texts, have ``most`` characters or so, and not over 2^15 rows."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1] or "")
        if size >= most or len(held) == 1 << 15:
            yield held
            held, size = [], 0
    if held:
        yield held


def common_words(docs: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes (sorted) of all words that may have 1 / most of all tokens, those of about 1 / ``FREQUENT``, and the number of tokens.

    Each task sends only words that may have half that share of its own tokens.  A word of the full share has half of it
    in tasks that send it, so the words that are sent for half the share (2 ``most`` at most, but for upper bounds) hold
    all common ones, however the table is partitioned; ``tier_counts`` then counts them exactly.
    """

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()
        n, lost = 0, 0  # tokens, and how many of a word's may have been forgotten
        for frame in frames:
            for t in frame["text"]:
                w = tokens(t)
                n += len(w)
                found.update(w)
            if len(found) > 4_000_000:
                lost += n // (8 * most)
                found = Counter({w: c for w, c in found.items() if c > n // (8 * most)})
        memo = WordHash()
        top = [(np.uint64(memo[w]).astype(np.int64), c + lost) for w, c in found.items() if (c + lost) * most * 2 >= n]
        yield pd.DataFrame({"h": [x for x, _ in top] + [0], "c": [c for _, c in top] + [n], "all": [False] * len(top) + [True]})

    g = cut(docs.select("text").mapInPandas(work, "h long, c long, all boolean").groupBy("h", "all").agg(F.sum("c").alias("c")))
    total = int(g.where("all").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])
    rows = g.where(~F.col("all") & (F.col("c") * most * 2 >= total)).select("h", "c").toPandas() if total else pd.DataFrame({"h": [], "c": []})
    h = rows["h"].to_numpy(np.int64).view(np.uint64)
    return np.unique(h), np.unique(h[rows["c"].to_numpy(np.int64) * FREQUENT >= total]), total


def packed(key: np.ndarray, local: np.ndarray, n: np.ndarray, parts: int) -> Iterator[tuple[int, tuple[bytes, bytes]]]:
    """(part, blobs) of sorted keys."""
    if not len(key):
        return
    part = ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    edges = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    for i, j in zip(edges, np.append(edges[1:], len(key)), strict=True):
        yield int(part[i]), pack(key[i:j], local[i:j], n[i:j])


def tier_counts(docs: DataFrame, candidates: np.ndarray, parts: int, n: int) -> RDD:
    """Packed counts of (word before, candidate or another word), dealt by the word before."""

    def work(rows: Iterator) -> Iterator[tuple[int, tuple]]:
        r = Reader(candidates)
        for some in chunks(rows):
            word, _, before = r.read([x[0] for x in some])
            key, c = np.unique((r.mixed[before] & HIGH) | r.dish[word].astype(np.uint64), return_counts=True)
            yield from ((part, (0, *blobs)) for part, blobs in packed(key, np.zeros(len(key), np.int64), c, parts))

    # an RDD, as its jobs all read the files of one shuffle; a frame would shuffle anew, or be written a second time
    return docs.select("text").rdd.mapPartitions(work).partitionBy(n)


def sum_of(rdd: RDD) -> np.ndarray | None:
    """Arrays of whole numbers, added up by a tree of tasks."""

    def add(a: bytes | None, b: bytes | None) -> bytes | None:
        return a or b if a is None or b is None else squeeze([unsqueeze(a, [8])[0] + unsqueeze(b, [8])[0]], [8])

    blob = rdd.map(lambda x: squeeze([x], [8])).treeAggregate(None, add, add)
    return None if blob is None else unsqueeze(blob, [8])[0].astype(np.float64)


def by_dish(cells: RDD, width: int, weigh) -> np.ndarray:
    """Sums over all parts of what ``weigh`` makes of a part's (key, n): ``width`` numbers."""

    def work(items: Iterator) -> Iterator[np.ndarray]:
        sums = None
        for _, key, _, n, _ in by_part(items):
            sums = weigh(key, n) + (0 if sums is None else sums)
        if sums is not None:
            yield sums

    found = sum_of(cells.mapPartitions(work))
    return np.zeros(width) if found is None else found


def tier_states(cells: RDD, dish_of: np.ndarray, dishes: int, sweeps: int, burn_in: int) -> dict:
    """The discount, and the parent's probabilities before all sweeps and after each."""

    def customers(m: dict) -> np.ndarray:
        shared = cells.ctx.broadcast((dish_of, m))

        def weigh(key: np.ndarray, n: np.ndarray) -> np.ndarray:
            dish_of, m = shared.value
            r = Restaurants(key, n, dish_of)
            for s, parent in enumerate(m["parents"], 1):
                r.sweep(parent, m["d"], s)
            return np.append(np.bincount(r.dish, weights=r.t, minlength=dishes), [(r.c == 1).sum(), (r.c == 2).sum()])

        return by_dish(cells, dishes + 2, weigh)

    m = {"d": discount_of(*customers({"parents": []})[dishes:]), "parents": [np.full(dishes, 1 / dishes)], "burn_in": burn_in}
    t1 = np.zeros(dishes)
    for s in range(1, sweeps + 1):
        t1, parent = parent_of(customers(m)[:dishes].astype(np.int64), t1, s)
        m["parents"].append(parent)
    return m


def frequent_rows(cells: RDD, dish_of: np.ndarray, dishes: int, m: dict, contexts: np.ndarray) -> np.ndarray:
    """log10 of predictive probabilities, frequent context x dish."""
    shared = cells.ctx.broadcast((dish_of, m, contexts))

    def work(items: Iterator) -> Iterator[tuple[int, np.ndarray]]:
        dish_of, m, contexts = shared.value
        for _, key, _, n, _ in by_part(items):
            r = Restaurants(key, n, dish_of)
            for k in np.flatnonzero(place(contexts, r.word) < len(r.word)):
                mine = r.at == place(contexts[k : k + 1], r.word)[0]
                one = Restaurants(r.key[mine], r.c[mine], np.arange(dishes, dtype=np.uint64))
                yield int(k), np.log10(one.mean(m, contexts[k] | np.arange(dishes, dtype=np.uint64)))

    out = np.tile(np.log10(np.mean(m["parents"][m["burn_in"] + 1 :], axis=0)), (len(contexts), 1))
    for k, p in cells.mapPartitions(work).collect():  # some ``FREQUENT`` rows at most
        out[k] = p
    return out


def deal(docs: DataFrame, common: np.ndarray, contexts: np.ndarray, tier: np.ndarray, counts: np.ndarray, parts: int, n_tasks: int, mod: int) -> RDD:
    """Packed rare tokens by word, packed dishes by the word before (in parts from ``parts`` on), and what is known of documents.

    That is in parts from twice ``parts`` on, by bucket: rows, ids, where these are null, hold-out, numbers of tokens and
    of known ones, and sums over the common words and over the dishes after the frequent ``contexts``.  The shuffle's files
    are the only copy of all this, and every later pass reads them; lost ones are made again from the documents.
    """
    shared = docs.sparkSession.sparkContext.broadcast((common, contexts, tier, np.append(np.log10(counts + 0.5), 0.0)))

    def work(piece: int, rows: Iterator) -> Iterator[tuple[int, tuple]]:
        common, contexts, tier, base = shared.value
        r = Reader(common, contexts)
        own, size, row = [], 0, piece << 36

        def known() -> Iterator[tuple[int, tuple]]:
            every = [np.concatenate(x) for x in zip(*own, strict=True)]
            bucket = bucket_of(every[0], n_tasks)
            yield from ((2 * parts + int(b), tuple(x[bucket == b] for x in every)) for b in np.unique(bucket))

        def sorted_cells(rank: np.ndarray, low: np.ndarray, doc: np.ndarray, held: np.ndarray, words: np.ndarray):
            # numbers of words, lower keys and documents fit one integer, which sorts faster than keys are looked up
            cell, times = np.unique((rank.astype(np.uint64) << np.uint64(32)) | (low << np.uint64(16)) | doc.astype(np.uint64), return_counts=True)
            at = (cell & LOW).astype(np.int64)
            return packed(words[(cell >> np.uint64(32)).astype(np.int64)] | (cell >> np.uint64(16) & LOW), at << 1 | held[at], times, parts)

        for some in chunks(rows):
            word, doc, before = r.read([x[2] for x in some])
            n = len(some)
            held = np.fromiter((x[1] for x in some), bool, n)
            dish, cls = r.dish[word], r.cls[before]
            often, rare = cls < len(contexts), dish == len(common)
            sums = lambda w: np.bincount(doc, weights=w, minlength=n)  # noqa: E731, B023
            own.append(
                (
                    row + np.arange(n),
                    np.fromiter((x[0] or 0 for x in some), np.int64, n),
                    np.fromiter((x[0] is None for x in some), bool, n),
                    held,
                    np.bincount(doc, minlength=n),
                    np.bincount(doc[~rare], minlength=n),
                    sums(base[dish]),
                    np.bincount(doc[often], weights=tier[cls[often], dish[often]], minlength=n),
                )
            )
            for first, x, number, low, hashes in (
                (0, np.flatnonzero(rare), word, lambda x: r.mixed[before[x]] & LOW, r.h),  # noqa: B023
                (parts, np.flatnonzero(~often), before, lambda x: dish[x].astype(np.uint64), r.mixed),  # noqa: B023
            ):
                words, rank = np.unique(hashes & HIGH, return_inverse=True)
                yield from ((first + part, (row, *blobs)) for part, blobs in sorted_cells(rank[number[x]], low(x), doc[x], held, words))
            row, size = row + n, size + n
            if size >= 1 << 17:
                yield from known()
                own, size = [], 0
        if own:
            yield from known()

    d = docs.select(F.col("doc_id").cast("long"), held_out(mod), "text")
    return d.rdd.mapPartitionsWithIndex(work).partitionBy(n_tasks)


def bucket_of(row: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(row.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def by_part(items: Iterable[tuple[int, tuple]]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, key, row, n, train) of all blobs of one part after another."""
    for part, some in groupby(sorted(items, key=lambda x: x[0]), key=lambda x: x[0]):
        held = []
        for _, (base, *blobs) in some:
            key, local, n = unpack(*blobs)
            held.append((key, (local >> 1) + base, n, (local & 1) == 0))
        yield part, *(np.concatenate(x) for x in zip(*held, strict=True))


def cells_of(key: np.ndarray, n: np.ndarray, train: np.ndarray) -> Cells:
    u, at = np.unique(key[train], return_inverse=True)
    return Cells(u, np.bincount(at, weights=n[train], minlength=len(u)).astype(np.int64))


def _totals(dealt: RDD, parts: int, before: list[Totals], m: dict | None) -> tuple[Totals, dict]:
    """Runs all sweeps so far and one more, and adds up what tasks have: (totals, counts of counts)."""
    shared = dealt.ctx.broadcast((before, m))

    def work(items: Iterator) -> Iterator[np.ndarray]:
        before, m = shared.value
        customers, tables, rest, some = np.zeros(65536), np.zeros(65536), np.zeros(8), False
        for _, key, _, n, train in by_part(x for x in items if x[0] < parts):
            c, some = cells_of(key, n, train), True
            for s, g in enumerate(before, 1):
                c.sweep(g, m, s)
            customers += np.bincount(c.ctx, weights=c.c, minlength=65536)
            tables += np.bincount(c.ctx, weights=c.t, minlength=65536)
            words = np.bincount(c.at, weights=c.c, minlength=len(c.word))
            rest += [c.c1.sum(), c.t1.sum(), len(c.word), words.sum(), (c.c == 1).sum(), (c.c == 2).sum(), (c.c1 == 1).sum(), (c.c1 == 2).sum()]
        if some:
            yield np.concatenate([customers, tables, rest])

    found = sum_of(dealt.mapPartitions(work))
    a = np.zeros(2 * 65536 + 8) if found is None else found
    r = a[2 * 65536 :]
    return Totals(a[:65536], a[65536 : 2 * 65536], r[0], r[1]), {"types": r[2], "n": r[3], "ones": r[4:6], "ones1": r[6:8]}


def score(docs: DataFrame, mod: int = MOD, common: int = COMMON, sweeps: int = SWEEPS, burn_in: int = BURN_IN) -> DataFrame:
    """One row a document; ``score`` and ``base_score`` are log10 probabilities of its tokens."""
    spark = docs.sparkSession
    train = docs.where(~held_out(mod))
    candidates, frequent, total = common_words(train, common)
    n = int(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), total // (8 * PART_TOKENS)))
    parts = int(max(2 * n, total // PART_TOKENS + 1))
    cells = tier_counts(train, candidates, parts, n)
    width = len(candidates) + 1
    counts = by_dish(cells, width, lambda key, n: np.bincount((key & LOW).astype(np.int64), weights=n, minlength=width))[:-1]
    is_common = counts * common >= max(1, total)
    often, dishes = candidates[is_common], int(is_common.sum()) + 1
    dish_of = np.full(len(candidates) + 1, dishes - 1, np.uint64)
    dish_of[:-1][is_common] = np.arange(dishes - 1)
    seats = tier_states(cells, dish_of, dishes, sweeps, burn_in)
    contexts = np.unique(mix64(np.append(frequent, np.uint64(WordHash()[START]))) & HIGH)
    tier = frequent_rows(cells, dish_of, dishes, seats, contexts)
    del cells
    release(spark)
    dealt = deal(docs, often, contexts, tier, counts[is_common], parts, n, mod)
    g, stats = _totals(dealt, parts, [], None)
    m = {"d": discount_of(*stats["ones"]), "d1": discount_of(*stats["ones1"]), "uniform": 1.0 / (stats["types"] + 1)}
    states = [g]
    for _ in range(sweeps):
        states.append(_totals(dealt, parts, states, m)[0])
    shared = spark.sparkContext.broadcast((states, m, np.arange(dishes, dtype=np.uint64), seats))
    z = float(np.log10(total + 0.5 * (len(often) + stats["types"] + 1)))

    def units(x: np.ndarray) -> np.ndarray:
        return np.rint(np.log10(x) / UNIT).astype(np.int64)

    def rare_sums(asked: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
        states, m, *_ = shared.value
        cells = Cells(asked[c > 0], c[c > 0])
        p = np.zeros(len(asked))
        for s in range(1, len(states)):
            cells.sweep(states[s - 1], m, s)
            if s > burn_in:
                p += cells.score(states[s], m, asked) / (len(states) - 1 - burn_in)
        of_word = np.append(np.bincount(cells.at, weights=cells.c, minlength=len(cells.word)), 0.0)[place(asked & HIGH, cells.word)]
        return (of_word > 0).astype(np.int64), units(of_word + 0.5), units(p)

    def tier_sums(asked: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
        *_, dishes, seats = shared.value
        none = np.zeros(len(asked), np.int64)
        return none, none, units(Restaurants(asked[c > 0], c[c > 0], dishes).mean(seats, asked))

    def answer(items: Iterator) -> Iterator[tuple[int, tuple]]:
        """(bucket, what is known of its documents, or sums of them): packed, as a document's dealt tokens lie with many tasks."""
        mine, held, size = [], [], 0

        def out() -> Iterator[tuple[int, tuple]]:
            every = add_up(*(np.concatenate(x) for x in zip(*held, strict=True)))
            bucket = bucket_of(every[0], n)
            order = np.argsort(bucket, kind="stable")
            at = np.searchsorted(bucket[order], np.arange(n + 1))
            yield from ((b, (pack_sums(*(x[order[at[b] : at[b + 1]]] for x in every)),)) for b in range(n) if at[b] < at[b + 1])

        for part, x in items:
            if part >= 2 * parts:
                yield part - 2 * parts, x
            else:
                mine.append((part, x))
        for part, key, row, times, train in by_part(mine):
            asked, at = np.unique(key, return_inverse=True)
            c = np.bincount(at, weights=times * train, minlength=len(asked)).astype(np.int64)
            held.append((row, *(times * x[at] for x in (rare_sums if part < parts else tier_sums)(asked, c))))
            size += len(row)
            if size > 4_000_000:
                yield from out()
                held, size = [], 0
        if held:
            yield from out()

    def gather(items: Iterator) -> Iterator[tuple]:
        for _, some in groupby(sorted(items, key=lambda x: x[0]), key=lambda x: x[0]):
            own, sums = [], []
            for _, x in some:
                (own if len(x) > 1 else sums).append(x)
            row, doc_id, null, held, n_tokens, n_known, base, lp = (np.concatenate(x) for x in zip(*own, strict=True))
            if sums:
                rows, known, bases, lps = add_up(*(np.concatenate(x) for x in zip(*(unpack_sums(x) for (x,) in sums), strict=True)))
                order = np.argsort(row)
                at = order[np.searchsorted(row[order], rows)]
                n_known[at] += known
                base[at] += bases * UNIT
                lp[at] += lps * UNIT
            ids = (None if no else x for x, no in zip(doc_id.tolist(), null.tolist(), strict=True))
            yield from zip(ids, held.tolist(), n_tokens.tolist(), n_known.tolist(), [total] * len(row), (base - n_tokens * z).tolist(), lp.tolist(), strict=True)

    rows = dealt.mapPartitions(answer).partitionBy(n).mapPartitions(gather)
    return spark.createDataFrame(rows, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double", verifySchema=False)
