"""Interpolated modified Kneser-Ney n-gram model, counted in Spark, stored as sorted hash arrays, memory-mapped to score.

Tokens are the words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased and one end token.  The model is a folder of flat
files:

* words: sorted 64-bit word keys (hashes) in ranges of equal width (``words-00003.h``) with counts (``.c``); a word's id is its
  rank over all ranges.
* grams2, grams3, ...: sorted 64-bit keys of the n-grams, again in ranges; an n-gram's id is its rank.  A key is a bijective mix
  of the id of the first n-1 words and the id of the last one, so keys never collide and each order is built from the one below.
* of every gram below the top: ``.n1 .n2 .n3`` hold how many different words follow it once, twice, more often, ``.t`` how often
  any does, ``.a`` (words: ``.cont``) how many different words come before it.  A document's first gram of an order has nothing
  before the begin token and keeps its count.

Counting combines within each task first and then shuffles one row of packed arrays for each range and task; a range is
merged by one task, and ranges are as many as the text asks for, so a frequent word is one entry of each task and no
group grows with it.  Statistics of contexts and continuations are merged the same way, from the top order down.  Only totals
(one row for each range) reach the driver.  Shuffle files of an order go as soon as it is merged.  Scoring sorts the queries of
a slice of text and searches them in the mapped arrays.  No sort needs to be stable: equal keys are summed or give the same
answer, and numpy's default sort of 64-bit numbers takes a quarter of the time of its stable one.  A slice's distinct words are
hashed together, eight bytes of all at a time, since every pass over the text hashes them again.

``p(w|h) = (max(a(hw) - D, 0) + (D1 N1(h) + D2 N2(h) + D3 N3(h)) p(w|h')) / t(h)``, where h' is h without its first word and a is
the count at the top order, and ``p(w) = (max(N(w) - D', 0) + G') / T`` with ``G'`` spread evenly over the V known words and one
unknown.  An unknown h gives p(w|h'); a document's first token has the begin token alone as context.

Defined results: a null or empty text is the end token alone; an unseen word counts as the unknown one; without training
rows every token has probability 1; repeated rows count and are scored each; only id and text are read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NONSPACE, map_file, mix, shared_dir, slices, text_rows, utf8, word_keys, words, write_file  # noqa: F401  (mix: beside unmix)

RANGE_BYTES = 24 << 20  # training text for each range of an order's n-grams
WORD_RANGE_BYTES = 64 << 20
FLUSH = 2_000_000  # entries that a counting task combines at a time
PART = 1 << 19  # n-grams that a statistics task takes at a time
END_KEY = word_keys(pa.array([b" "], pa.binary()))  # no word has a space
PACKED = "kind int, range int, keys binary, counts binary"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of ``mix``."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(33)
        x *= np.uint64(0x9CB4B2F8129337DB)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0x4F74430C22A54005)
        x ^= x >> np.uint64(33)
    return x


def mixed(x: np.ndarray, bits: int) -> np.ndarray:
    """A bijective mix of numbers below ``2 ** bits``, in the upper bits of the keys (the rest is zero and packs to nothing)."""
    x, half, mask = x.astype(np.uint64, copy=True), np.uint64((bits + 1) // 2), np.uint64(2 ** bits - 1)
    with np.errstate(over="ignore"):
        for odd in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x ^= x >> half
            x *= np.uint64(odd)
            x &= mask
        x ^= x >> half
    return x << np.uint64(64 - bits)


def unmixed(keys: np.ndarray, bits: int) -> np.ndarray:
    """The inverse of ``mixed``."""
    x, half, mask = keys >> np.uint64(64 - bits), np.uint64((bits + 1) // 2), np.uint64(2 ** bits - 1)
    with np.errstate(over="ignore"):
        for odd in (0x9CB4B2F8129337DB, 0x4F74430C22A54005):
            x ^= x >> half
            x *= np.uint64(odd)
            x &= mask
        x ^= x >> half
    return x


def planes(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones and so on, which leaves runs for the shuffle's compression."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def from_planes(data: bytes, kind: str) -> np.ndarray:
    rows = np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(rows.T).view(kind).ravel()


def narrow(columns: list[np.ndarray]) -> list[np.ndarray]:
    """The columns in the narrowest unsigned type that holds them all."""
    kind = np.min_scalar_type(max(int(c.max()) for c in columns))
    return [c.astype(kind) for c in columns]


def steps(ascending: np.ndarray) -> bytes:
    return planes(np.diff(ascending.astype(np.uint64, copy=False), prepend=np.uint64(0)))


def from_steps(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, "<u8"), dtype=np.uint64)


def ranges(keys: np.ndarray, n: int) -> np.ndarray:
    """The range of each 64-bit key; ascending keys have ascending ranges."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def combined(keys: list[np.ndarray], counts: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and their summed counts."""
    k = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    if not len(k):
        return k, np.zeros(0, np.int64)
    if counts is None:
        k.sort()
        c = np.ones(len(k), np.int64)
    else:
        c = np.concatenate(counts).astype(np.int64)
        order = np.argsort(k)
        k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[first], np.add.reduceat(c, first)


def packed(kind: int, keys: np.ndarray, counts: np.ndarray, n: int) -> pa.RecordBatch:
    """One row for each range with entries."""
    r = ranges(keys, n)
    cuts = np.searchsorted(r, np.arange(n + 1))
    own = np.flatnonzero(np.diff(cuts))
    return pa.record_batch([pa.array([kind] * len(own), pa.int32()), pa.array(own, pa.int32()),
                            pa.array([steps(keys[cuts[i]:cuts[i + 1]]) for i in own], pa.binary()),
                            pa.array([planes(counts[cuts[i]:cuts[i + 1]].astype("<u4")) for i in own], pa.binary())],
                           names=["kind", "range", "keys", "counts"])


def unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and summed counts of the rows of a range."""
    return combined([from_steps(b.as_py()) for b in table["keys"]], [from_planes(b.as_py(), "<u4") for b in table["counts"]])


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts: each token's index in ``keys`` (the end token is the last one), the keys of the words, which
    tokens begin a document, and each document's first token (and one entry at the end)."""
    data, offs = utf8(column)
    w = words(data, offs, NONSPACE)
    keys = np.append(word_keys(w.vocabulary), END_KEY)
    n = len(offs) - 1
    first = w.first + np.arange(n + 1)
    out = np.full(len(w.index) + n, len(keys) - 1, np.int64)
    keep = np.ones(len(out), bool)
    keep[first[1:] - 1] = False
    out[keep] = w.index
    begin = np.zeros(len(out), bool)
    begin[first[:-1]] = True
    return out, keys, begin, first


def _count_words(n: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for part in itertools.chain.from_iterable(map(slices, batches)):
            index, k, _, _ = tokens(part.column(0))
            keys.append(k)
            counts.append(np.bincount(index, minlength=len(k)))
            held += len(k)
            if held > FLUSH:
                k, c = combined(keys, counts)
                keys, counts, held = [k], [c], len(k)
                if held > FLUSH // 2:
                    yield packed(0, k, c, n)
                    keys, counts, held = [], [], 0
        if keys:
            yield packed(0, *combined(keys, counts), n)
    return rows


def _merge_words(folder: str):
    def merge(key, table):
        r = key[1].as_py()
        k, c = unpacked(table)
        write_file(f"{folder}/words-{r:06d}.h", k.tobytes())
        write_file(f"{folder}/words-{r:06d}.c", c.astype("<u8").tobytes())
        return pa.table({"range": pa.array([r], pa.int32()), "n": pa.array([len(k)], pa.int64()), "total": pa.array([int(c.sum())], pa.int64())})
    return merge


def write_small(uri: str, values: np.ndarray) -> None:
    """A byte for each value; those from 255 on also as (position, value) in a file beside it."""
    big = np.flatnonzero(values >= 255)
    write_file(uri, np.minimum(values, 255).astype("u1").tobytes())
    write_file(f"{uri}+", np.concatenate([big, values[big]]).astype("<u8").tobytes())


class Ranges:
    """Sorted keys in ranges of a model folder, mapped when first asked for."""

    def __init__(self, folder: str, name: str, sizes: list[int], values: dict[str, str]):
        self.folder, self.name, self.sizes, self.values = folder, name, sizes, values
        self.base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.maps: dict[tuple[int, str], np.ndarray] = {}

    def array(self, r: int, suffix: str) -> np.ndarray:
        if (r, suffix) not in self.maps:
            kind = self.values.get(suffix, "<u8")
            self.maps[r, suffix] = np.asarray(map_file(f"{self.folder}/{self.name}-{r:06d}.{suffix}", kind))  # a plain view indexes faster
        return self.maps[r, suffix]

    def column(self, r: int, suffix: str, at: np.ndarray) -> np.ndarray:
        """The values at positions of a range."""
        small = self.array(r, suffix)[at]
        out = small.astype(np.int64)
        if self.values[suffix] == "u1" and len(big := np.flatnonzero(small == 255)):
            where, values = self.array(r, f"{suffix}+").reshape(2, -1)
            out[big] = values[np.searchsorted(where, at[big].astype(np.uint64))]
        return out

    def look_up(self, keys: np.ndarray, columns: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """The rank of each key over all ranges (-1: absent) and the columns' values (0: absent)."""
        rank = np.full(len(keys), -1, np.int64)
        values = [np.zeros(len(keys), np.int64) for _ in columns]
        order = np.argsort(keys)
        k = keys[order]
        cuts = np.searchsorted(ranges(k, len(self.sizes)), np.arange(len(self.sizes) + 1))
        for r in np.flatnonzero(np.diff(cuts)):
            if not self.sizes[r]:
                continue
            own, at = order[cuts[r]:cuts[r + 1]], k[cuts[r]:cuts[r + 1]]
            table = self.array(r, "h")
            i = np.minimum(np.searchsorted(table, at), len(table) - 1)
            hit = table[i] == at
            rank[own[hit]] = self.base[r] + i[hit]
            for v, c in zip(values, columns, strict=True):
                v[own[hit]] = self.column(r, c, i[hit])
        return rank, values

    def keys_at(self, rank: np.ndarray) -> np.ndarray:
        out = np.empty(len(rank), np.uint64)
        order = np.argsort(rank)
        cuts = np.searchsorted(rank[order], self.base)
        for r in np.flatnonzero(np.diff(cuts)):
            own = order[cuts[r]:cuts[r + 1]]
            out[own] = self.array(r, "h")[rank[own] - self.base[r]]
        return out


WORD_FILES = {"c": "<u8", "t": "<u8", "n1": "<u4", "n2": "<u4", "n3": "<u4", "cont": "<u4"}
GRAM_FILES = {"c": "u1", "a": "u1", "t": "u1", "n1": "u1", "n2": "u1", "n3": "u1"}


class Levels:
    """The words and the n-grams of the orders counted so far: ``sizes[m - 1]`` holds the sizes of order m's ranges."""

    def __init__(self, folder: str, sizes: list[list[int]]):
        self.folder, self.sizes, self.n_words = folder, sizes, sum(sizes[0])
        self.tables = [Ranges(folder, "words" if m == 1 else f"grams{m}", x, WORD_FILES if m == 1 else GRAM_FILES) for m, x in enumerate(sizes, 1)]

    def bits(self, m: int) -> int:
        """Of the numbers of order m's n-grams: contexts (at order 2 the words and the begin token) times words."""
        n = ((self.n_words + 1 if m == 2 else sum(self.sizes[m - 2])) * self.n_words - 1).bit_length()
        if n > 64:
            raise ValueError(f"n-grams of order {m} no longer fit a key of 64 bits")
        return max(1, n)

    def keys(self, m: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        return mixed(context.astype(np.uint64) * np.uint64(self.n_words) + word.astype(np.uint64), self.bits(m))

    def split(self, m: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Context id and word id of order m's keys."""
        context, word = np.divmod(unmixed(keys, self.bits(m)), np.uint64(self.n_words))
        return context.astype(np.int64), word.astype(np.int64)

    def look_up(self, m: int, context: np.ndarray, word: np.ndarray, columns: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """As ``Ranges.look_up``, of order m's n-grams; a context or word of -1 is absent."""
        known = np.flatnonzero((context >= 0) & (word >= 0))
        rank, values = self.tables[m - 1].look_up(self.keys(m, context[known], word[known]), columns)
        out = np.full(len(word), -1, np.int64)
        out[known] = rank
        wide = [np.zeros(len(word), np.int64) for _ in columns]
        for x, v in zip(wide, values, strict=True):
            x[known] = v
        return out, wide

    def tail(self, m: int, ids: np.ndarray) -> np.ndarray:
        """Ids (of order m - 1) of order m's n-grams without their first words."""
        context, word = self.split(m, self.tables[m - 1].keys_at(ids))
        return word if m == 2 else self.look_up(m - 1, self.tail(m - 1, context), word, [])[0]


def shifted(x: np.ndarray, begin: np.ndarray, first: int) -> np.ndarray:
    """Each token's left neighbour; ``first`` where a document begins."""
    y = np.empty_like(x)
    y[1:] = x[:-1]
    y[begin] = first
    return y


def _count_grams(folder: str, sizes: list[list[int]], n: int):
    """Of the order above those in ``sizes``."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, top, keys, held = Levels(folder, sizes), len(sizes) + 1, [], 0
        for part in itertools.chain.from_iterable(map(slices, batches)):
            index, k, begin, _ = tokens(part.column(0))
            word = levels.tables[0].look_up(k, [])[0][index]
            context = shifted(word, begin, levels.n_words)
            for m in range(2, top):
                context = shifted(levels.look_up(m, context, word, [])[0], begin, -1)
            own = context >= 0
            keys.append(levels.keys(top, context[own], word[own]))
            held += len(keys[-1])
            if held > FLUSH:
                yield packed(0, *combined(keys), n)
                keys, held = [], 0
        if keys:
            yield packed(0, *combined(keys), n)
    return rows


def _merge_grams(folder: str, m: int):
    def merge(key, table):
        r = key[1].as_py()
        k, c = unpacked(table)
        write_file(f"{folder}/grams{m}-{r:06d}.h", k.tobytes())
        write_small(f"{folder}/grams{m}-{r:06d}.c", c)
        return pa.table({"range": pa.array([r], pa.int32()), "n": pa.array([len(k)], pa.int64())})
    return merge


def _statistics(levels: Levels, m: int, r: int, a: np.ndarray, part: int = PART) -> list[tuple]:
    """Rows for the ranges of order m - 1, from a range of order m and its n-grams' counts: statistics of contexts (kind 1) and
    numbers of continuations (kind 2), which add up over parts and ranges; for range 0 the totals (kind 3)."""
    base, lower = levels.tables[m - 2].base, int(levels.tables[m - 2].base[-1])

    def by_range(kind: int, ids: np.ndarray, *columns: np.ndarray) -> list[tuple]:
        cuts = np.searchsorted(ids, base)
        return [(kind, i, steps(ids[x:y] - base[i]), b"".join(map(planes, narrow([c[x:y] for c in columns]))))
                for i, (x, y) in enumerate(itertools.pairwise(cuts)) if y > x]

    start, rows = np.zeros(3, np.int64), []
    for at in range(0, len(a), part):
        context, word = levels.split(m, levels.tables[m - 1].array(r, "h")[at:at + part])
        order = np.argsort(context)
        context, word, c = context[order], word[order], a[at:at + part][order]
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        ids = context[first]
        n = [np.add.reduceat(c, first), *(np.add.reduceat(x.astype(np.int64), first) for x in (c == 1, c == 2, c > 2))]
        inner = ids < lower  # at order 2 the begin token is no word
        start += [int(x[~inner].sum()) for x in n[1:]]
        rows += by_range(1, ids[inner], *(x[inner] for x in n))
        if m > 2:
            tail = np.repeat(levels.tail(m - 1, ids), np.diff(np.append(first, len(context))))
            word = levels.look_up(m - 1, tail, word, [])[0]
        rows += by_range(2, *np.unique(word, return_counts=True))
    totals = np.array([m, *(int((a == i).sum()) for i in range(1, 5)), *start], "<i8")
    return rows + [(3, 0, b"", totals.tobytes())] + [(4, r, b"", b"")] * (m > 2)  # kind 4: no range of n-grams is left out


def _batch(rows: list[tuple]) -> dict:
    kinds = pa.int32(), pa.int32(), pa.binary(), pa.binary()
    return {name: pa.array([x[i] for x in rows], kinds[i]) for i, name in enumerate(("kind", "range", "keys", "counts"))}


def _top_statistics(folder: str, sizes: list[list[int]]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, m = Levels(folder, sizes), len(sizes)
        for r in itertools.chain.from_iterable(b.column(0).to_pylist() for b in batches):
            n = sizes[-1][r]
            a = levels.tables[-1].column(r, "c", np.arange(n)) if n else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_pydict(_batch(_statistics(levels, m, r, a)))
    return rows


def _merge_statistics(folder: str, sizes: list[list[int]], m: int):
    """Writes the statistics of a range of order m; gives its rows for the order below."""
    def merge(key, table):
        r = key[0].as_py()
        levels = Levels(folder, sizes)
        size, out, passed = sizes[m - 1][r], np.zeros((5, sizes[m - 1][r]), np.int64), []
        for kind, ids, stats in ((x.as_py() for x in row) for row in zip(table["kind"], table["keys"], table["counts"], strict=True)):
            if kind == 3:
                passed.append((3, 0, b"", stats))
            elif kind < 3:
                at, own = from_steps(ids).astype(np.int64), (0, 1, 2, 3) if kind == 1 else (4,)
                step = len(stats) // len(own)
                for i, row in enumerate(own):
                    out[row, at] += from_planes(stats[i * step:(i + 1) * step], f"<u{step // len(at)}").astype(np.int64)  # ids of a row are distinct
        names, a = ("t", "n1", "n2", "n3"), out[4]
        if m > 1:
            if size:
                a = np.where(a > 0, a, levels.tables[m - 1].column(r, "c", np.arange(size)))
            for name, values in zip((*names, "a"), (*out[:4], a), strict=True):
                write_small(f"{folder}/grams{m}-{r:06d}.{name}", values)
            return pa.table(_batch(passed + _statistics(levels, m, r, a)))
        for name, values in zip((*names, "cont"), out, strict=True):
            write_file(f"{folder}/words-{r:06d}.{name}", values.astype(WORD_FILES[name]).tobytes())
        totals = np.array([1, *(int((a == i).sum()) for i in range(1, 5)), 0, 0, 0], "<i8")
        return pa.table(_batch(passed + [(3, 0, b"", totals.tobytes())]))
    return merge


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """D1, D2, D3+ from the counts of counts; where they give none between 0 and the count, 0.5, 1.0, 1.5."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    d = [1 - 2 * y * n2 / n1 if n1 else 0.0, 2 - 3 * y * n3 / n2 if n2 else 0.0, 3 - 4 * y * n4 / n3 if n3 else 0.0]
    return tuple(x if 0 < x < i + 1 else 0.5 * (i + 1) for i, x in enumerate(d))


@dataclass
class NgramModel:
    folder: str
    sizes: list[list[int]]  # of the ranges of the words, of the pairs and so on
    n_tokens: int
    start: tuple[int, int, int, int]  # of the begin token: its count, N1, N2, N3+
    discounts: list[tuple[float, float, float]]  # of each order
    low_counts: tuple[int, int, int]  # words with one, two, more different words before them

    @property
    def n_words(self) -> int:
        return sum(self.word_sizes)

    @property
    def order(self) -> int:
        return len(self.sizes)

    @property
    def word_sizes(self) -> list[int]:
        return self.sizes[0]

    @property
    def pair_sizes(self) -> list[int]:
        return self.sizes[1]

    def levels(self) -> Levels:
        if self.folder not in _OPEN:
            _OPEN.clear()
            _OPEN[self.folder] = Levels(self.folder, self.sizes)
        return _OPEN[self.folder]

    def score(self, column: pa.Array) -> pa.Array:
        """n_tokens, n_known, base_score and score of each text."""
        index, keys, begin, first = tokens(column)
        levels = self.levels()
        rank, (c, total, n1, n2, n3, cont) = levels.tables[0].look_up(keys, ["c", "t", "n1", "n2", "n3", "cont"])
        t = sum(self.pair_sizes)  # different bigrams
        if not t:
            p = np.ones(len(index))
        else:
            e = np.array([0.0, *self.discounts[0]])
            spread = float(np.dot(e[1:], self.low_counts))
            p = ((cont - e[np.minimum(cont, 3)] + spread / (self.n_words + 1)) / t)[index]
            word = rank[index]
            context = shifted(word, begin, self.n_words)
            # Of each token's context: how often a word follows it, and how many do once, twice, more often.
            follow = [shifted(x[index], begin, s) for x, s in zip((total, n1, n2, n3), self.start, strict=True)]
            for m in range(2, self.order + 1):
                d = np.array([0.0, *self.discounts[m - 1]])
                at, (a, *more) = levels.look_up(m, context, word, ["c"] if m == self.order else ["a", "t", "n1", "n2", "n3"])
                seen = follow[0] > 0
                back = d[1] * follow[1] + d[2] * follow[2] + d[3] * follow[3]
                p = np.where(seen, (a - d[np.minimum(a, 3)] + back * p) / np.where(seen, follow[0], 1), p)
                if m < self.order:
                    context, follow = shifted(at, begin, -1), [shifted(x, begin, 0) for x in more]
        base = np.log10((c + 1) / (self.n_tokens + self.n_words + 1))
        at = first[:-1]  # every text has its end token, so no run is empty
        add = (lambda x: np.add.reduceat(x, at)) if len(at) else (lambda x: np.zeros(0, x.dtype))
        return pa.StructArray.from_arrays(
            [pa.array(np.diff(first), pa.int64()), pa.array(add((c > 0)[index].astype(np.int64)), pa.int64()),
             pa.array(add(base[index])), pa.array(add(np.log10(p)))], names=["n_tokens", "n_known", "base_score", "score"])


_OPEN: dict[str, Levels] = {}


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Shuffle files of the queries inside go when the query ends."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def train(docs: DataFrame, text_col: str = "text", *, order: int = 2, range_bytes: int = RANGE_BYTES,
          word_range_bytes: int = WORD_RANGE_BYTES) -> NgramModel:
    """Count all rows of ``docs`` (null text: empty) and write the model below the shared folder."""
    if order < 2:
        raise ValueError("the order is 2 or more")
    with shuffles_dropped(docs.sparkSession):
        return _train(docs, text_col, order, range_bytes, word_range_bytes)


def _train(docs: DataFrame, text_col: str, order: int, range_bytes: int, word_range_bytes: int) -> NgramModel:
    spark: SparkSession = docs.sparkSession
    folder = shared_dir(spark, "ngrams")
    t = docs.select(F.col(text_col).cast("string").alias("text"))
    size = t.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_words, n = max(1, -(-size // word_range_bytes)), max(1, -(-size // range_bytes))
    merged = (t.mapInArrow(_count_words(n_words), PACKED).groupBy("kind", "range")
              .applyInArrow(_merge_words(folder), "range int, n bigint, total bigint"))
    rows = {r["range"]: r for r in merged.collect()}
    sizes = [[rows[r]["n"] if r in rows else 0 for r in range(n_words)]]
    if sum(sizes[0]) >= 2 ** 32 - 1:
        raise ValueError("more than 2^32 words: ids no longer fit half a key")
    total = sum(r["total"] for r in rows.values())
    for m in range(2, order + 1):
        grams = (t.mapInArrow(_count_grams(folder, sizes, n), PACKED).groupBy("kind", "range")
                 .applyInArrow(_merge_grams(folder, m), "range int, n bigint"))
        found = {r["range"]: r["n"] for r in grams.collect()}
        sizes = [*sizes, [found.get(r, 0) for r in range(n)]]
    stats = spark.range(0, n, 1, n).mapInArrow(_top_statistics(folder, sizes), PACKED)
    for m in range(order - 1, 0, -1):
        stats = stats.groupBy("range").applyInArrow(_merge_statistics(folder, sizes, m), PACKED)
    sums = np.zeros((order + 1, 7), np.int64)
    for r in stats.collect():
        m, *values = np.frombuffer(r["counts"], "<i8")
        sums[m] += values
    n_docs = int(t.count())
    c = [int(x) for x in sums[1, :4]]
    # Words that occur: all but those without a word before them; every word has one, as the begin token counts.
    more = sum(sizes[0]) - c[0] - c[1]
    return NgramModel(folder, sizes, int(total), (n_docs, *(int(x) for x in sums[2, 4:])),
                      [discounts(*(int(x) for x in sums[m, :4])) for m in range(1, order + 1)], (c[0], c[1], more))


def perplexity(text: Column, model: NgramModel) -> Column:
    """Struct column (n_tokens, n_known, base_score, score) of a text column; scores are log10 probabilities."""

    @F.arrow_udf("struct<n_tokens:bigint, n_known:bigint, base_score:double, score:double>")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            parts = [model.score(p.column(0)) for p in slices(pa.record_batch([column], names=["text"]))]
            yield pa.concat_arrays(parts) if parts else model.score(column)

    return run.asNondeterministic()(text)


def score_documents(docs: DataFrame, model: NgramModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    t = text_rows(docs, id_col, text_col)
    return (t.select("doc_id", perplexity(F.col("text"), model).alias("r"))
            .select("doc_id", "r.n_tokens", "r.n_known", F.lit(model.n_tokens).cast("bigint").alias("train_tokens"), "r.base_score", "r.score",
                    F.pow(F.lit(10.0), -F.col("r.score") / F.col("r.n_tokens")).alias("perplexity")))
