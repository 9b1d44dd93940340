"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  The automaton holds every run of words of
every item; a document is streamed through it word by word, and after each word the state gives the longest run that
ends there and occurs in an item.  A run of ``window`` words or more (for an item of fewer words: the whole item) hits its
words.  Hit words that touch form a span; spans are cut from the clean text, and a document whose hit words reach
``coverage`` of its words is contaminated.

Items are dealt over as many automata as their size asks for, ``ITEM_BYTES`` of text each; each is built by one task,
written to the shared folder and read by the workers, so none is broadcast and the set of items may be of any size.
Only runs of words that occur in the items at all, long enough for the shortest window, reach the automaton.

Defined results: a null or empty text has no words, no hits and isn't contaminated; items that are null, without words
or repeated match nothing or once (a repeated item_id is one item with the windows of all its rows); items with a
null item_id hit words like any other and are in no list of items; empty tables work; columns beside id and text are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, map_file, shared_dir, slices, text_rows, utf8, words, write_file

WINDOW, COVERAGE = 13, 0.05
ITEM_BYTES = 1 << 20
RESULT = ("struct<n_words:bigint, n_hit:bigint, longest:bigint, items:array<string>, "
          "spans:array<struct<first:bigint,last:bigint>>, contaminated:boolean, clean_text:string>")


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences, with what a stream needs to know at each state."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[tuple[str | None, list[int]]] = []

    def add(self, item: str | None, tokens: list[bytes]) -> None:
        ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in tokens]
        if ids:
            self.items.append((item, ids))
            last = 0
            for w in ids:
                last = self._extend(last, w)

    def _state(self, length: int, like: int | None = None) -> int:
        self.next.append({} if like is None else dict(self.next[like]))
        self.link.append(-1 if like is None else self.link[like])
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        """The state of the runs of q that are no longer than p's run and w."""
        clone = self._state(self.length[p] + 1, like=q)
        self.link[q] = clone
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        if (q := self.next[last].get(w)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
        new, p = self._state(self.length[last] + 1), last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p == -1:
            self.link[new] = 0
        else:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return new

    def finish(self) -> SuffixAutomaton:
        """Mark for each state the items of its window and the whole short items that end with it."""
        n = len(self.length)
        order = sorted(range(1, n), key=self.length.__getitem__)
        self.anchor = [-1] * n  # the state of the last `window` words
        for s in order:
            if self.length[s] >= self.window:
                up = self.link[s]
                self.anchor[s] = self.anchor[up] if self.length[up] >= self.window else s
        found: dict[int, set[str]] = {}
        for item, ids in self.items:
            s = 0
            for w in ids:
                s = self.next[s][w]
                if self.anchor[s] >= 0:
                    found.setdefault(self.anchor[s], set()).add(item)
        self.found = {s: frozenset(x) for s, x in found.items()}
        # Whole short items that are suffixes of a state's runs, longest last; states share their parent's tuple.
        self.short: list[tuple[tuple[int, frozenset[str]], ...]] = [()] * n
        lengths = {len(ids) for _, ids in self.items if len(ids) < self.window}
        ends: dict[int, dict[int, set[str]]] = {}
        for item, ids in self.items:
            if len(ids) < self.window:
                s = 0
                for w in ids:
                    s = self.next[s][w]
                ends.setdefault(s, {}).setdefault(len(ids), set()).add(item)
        for s in order:
            own = tuple((k, frozenset(x)) for k, x in sorted(ends.get(s, {}).items()))
            self.short[s] = self.short[self.link[s]] + own
        self.least = min([*lengths, self.window])
        return self

    def stream(self, ids: np.ndarray, hit: np.ndarray, items: set[str]) -> int:
        """Stream one run of known words; marks hit words, adds the items, returns the longest match."""
        follow, link, length, window = self.next, self.link, self.length, self.window
        s = run = longest = 0
        for p, w in enumerate(ids.tolist()):
            while s and w not in follow[s]:
                s = link[s]
                run = length[s]
            t = follow[s].get(w)
            if t is None:
                run = 0
                continue
            s, run = t, run + 1
            if run > longest:
                longest = run
            if run >= window:
                hit[p - window + 1:p + 1] = True
                items |= self.found[self.anchor[s]]
            for k, names in self.short[s]:
                if k <= run:
                    hit[p - k + 1:p + 1] = True
                    items |= names
        return longest


def _build(folder: str, window: int):
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = SuffixAutomaton(window)
        for batch in batches:
            data, offs = utf8(batch.column(1))
            w = words(data, offs, ALNUM)
            vocabulary = w.vocabulary.to_pylist()
            for i, item in enumerate(batch.column(0).to_pylist()):
                a.add(item, [vocabulary[j] for j in w.index[w.first[i]:w.first[i + 1]]])
        if a.items:
            name = f"{folder}/{TaskContext.get().partitionId():06d}.automaton"
            write_file(name, pickle.dumps(a.finish()))
            yield pa.record_batch([pa.array([name])], names=["file"])
    return shards


def build_automata(items: DataFrame, id_col: str = "item_id", text_col: str = "text", *, window: int = WINDOW,
                   item_bytes: int = ITEM_BYTES) -> list[str]:
    """Build and write the automata of the items; returns their files (one for each ``item_bytes`` of text)."""
    t = text_rows(items, id_col, text_col).where("text is not null").select(F.col("doc_id").cast("string"), "text").distinct()
    size = t.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    folder = shared_dir(items.sparkSession, "automata")
    t = t.repartition(max(1, -(-size // item_bytes)), "doc_id", "text")  # rows of one id may lie in several automata
    return sorted(r[0] for r in t.mapInArrow(_build(folder, window), "file string").collect())


_LOADED: dict[str, SuffixAutomaton] = {}


def _load(file: str) -> SuffixAutomaton:
    if file not in _LOADED:
        if len(_LOADED) >= 4:  # a worker holds a few automata at a time
            _LOADED.clear()
        _LOADED[file] = pickle.loads(map_file(file, "u1").tobytes())
    return _LOADED[file]


def match(column: pa.Array, files: list[str], coverage: float, with_text: bool) -> pa.Array:
    """The result struct of each text of a column."""
    data, offs = utf8(column)
    w = words(data, offs, ALNUM)
    n = len(column)
    hit = np.zeros(len(w.index), bool)
    items: list[set[str]] = [set() for _ in range(n)]
    longest = np.zeros(n, np.int64)
    for file in files:
        a = _load(file)
        known = pc.index_in(w.vocabulary, value_set=pa.array(list(a.vocabulary), pa.binary()))
        ids = known.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)[w.index]
        # Runs of known words within one document.
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (ids >= 0).view(np.int8), [0]])))
        inner = w.first[1:-1]
        cuts = np.unique(inner[(inner > 0) & (inner < len(ids))])
        cuts = cuts[(ids[cuts] >= 0) & (ids[cuts - 1] >= 0)] if len(cuts) else cuts
        lo = np.sort(np.concatenate([edge[::2], cuts]))
        hi = np.sort(np.concatenate([edge[1::2], cuts]))
        long = hi - lo >= a.least
        lo, hi = lo[long], hi[long]
        for b, e, d in zip(lo, hi, np.searchsorted(w.first, lo, side="right") - 1, strict=True):
            longest[d] = max(longest[d], a.stream(ids[b:e], hit[b:e], items[d]))
    sizes = np.diff(w.first)
    total = np.concatenate([[0], np.cumsum(hit)])
    n_hit = total[w.first[1:]] - total[w.first[:-1]]
    spans, clean = [], []
    for d in range(n):
        found = []
        if n_hit[d]:
            own = hit[w.first[d]:w.first[d + 1]].view(np.int8)
            edge = np.flatnonzero(np.diff(np.concatenate([[0], own, [0]])))
            found = [{"first": int(x), "last": int(y) - 1} for x, y in zip(edge[::2], edge[1::2], strict=True)]
        spans.append(found)
        if with_text and column[d].is_valid:
            at, parts = offs[d], []
            for s in found:
                parts.append(data[at:w.starts[w.first[d] + s["first"]]].tobytes())
                at = w.ends[w.first[d] + s["last"]]
            clean.append(b"".join([*parts, data[at:offs[d + 1]].tobytes()]).decode())
        else:
            clean.append(None)
    span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    return pa.StructArray.from_arrays(
        [pa.array(sizes, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(longest), pa.array([sorted(x - {None}) for x in items], pa.list_(pa.string())),
         pa.array(spans, span), pa.array((n_hit > 0) & (n_hit >= coverage * sizes - 1e-9)), pa.array(clean, pa.string())],
        names=["n_words", "n_hit", "longest", "items", "spans", "contaminated", "clean_text"])


def contamination(text: Column, files: list[str], *, coverage: float = COVERAGE, with_text: bool = True) -> Column:
    """Struct column (``RESULT``) of a text column, for use in any select or filter."""

    @F.arrow_udf(RESULT)
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            parts = [match(p.column(0), files, coverage, with_text) for p in slices(pa.record_batch([column], names=["text"]))]
            yield pa.concat_arrays(parts) if parts else match(column, [], coverage, with_text)

    return run.asNondeterministic()(text)


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, item_id_col: str = "item_id",
                  item_text_col: str = "text", window: int = WINDOW, coverage: float = COVERAGE, with_text: bool = True) -> DataFrame:
    """One row per document: doc_id and n_words, n_hit, longest (match), items, spans (word numbers, inclusive), contaminated,
    clean_text (the text without the spans; null if ``with_text`` is off)."""
    files = build_automata(items, item_id_col, item_text_col, window=window)
    t = text_rows(docs, id_col, text_col)
    return t.select("doc_id", contamination(F.col("text"), files, coverage=coverage, with_text=with_text).alias("r")).select("doc_id", "r.*")
