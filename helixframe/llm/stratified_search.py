"""Ranked lexical search over a length-stratified index.

Terms are maximal runs of ASCII letters, digits and all non-ASCII characters, A-Z lower-cased.  N documents have a term at all, L is the number of
their terms with repeats, n that of one document, df the number of documents with a term, tf its occurrences in one.  A term weighs
``w = floor(1000 ln((2N + 2) / (2 df + 1)))``; a document's normaliser is ``m = 100 - b + (b n N) div L``; the score of an item (query) is the sum
over its distinct terms of ``w * ((10^9 tf) div (1000 tf + k m))``, in 64-bit integers.

Documents of equal m form a stratum, where a term's contribution depends on tf alone.  The index is a set of written files, each for a
bounded number of documents (a unit): documents in order of m, so that a stratum is a run of them; postings of a term by stratum and falling
tf; and each run of postings of equal (term, m, tf) with its impact, which is computed once.  The first run of a term in a stratum
bounds what the term can add there, so an item has a bound for each stratum.  It visits the strata with the highest bounds first,
and then only those whose bound reaches the score of the last of its best documents so far.

What moves: one pass over the texts counts terms into a profile of each document (narrow); profiles are dealt to units, bands of m and a hash
within a band, as many as the band's count asks for, so that no length, however common, is one task's work; units meet the items in
blocks; each task returns the best few of each item.  An index may be limited to the terms that will be asked for: documents, N, L, n
and df are whole in any case.

Defined cases: a null text has no term; documents without a term (and with score 0) are in no result; an item without a term has
none; equal rows of items count once, and items of one id but different texts are ranked each for itself; rows of documents that repeat are documents of
their own; a null doc_id is smallest among equal scores.  A very long text is held by one task (as the row itself).  Empty
tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ALNUM, map_file, materialize, shared_dir, slices, text_rows, utf8, words, write_file

TERMS = 1 << 18  # of one vocabulary file
UNIT = 16384  # documents of an index file, about
BANDS = 8  # bands of m in each octave
ITEMS = 4096  # scored in one go
NO_ID = -(1 << 63)


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue()


def _read(file: str) -> pa.RecordBatch:
    return pa.ipc.open_file(pa.py_buffer(map_file(file, "u1"))).get_batch(0)


class Terms(NamedTuple):
    """A vocabulary: table (term, id), and its files with the id of their first term."""

    table: DataFrame
    files: list[tuple[str, int]]


def _distinct_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct terms of each row (id, text, key): (id, key, term)."""
    for batch in batches:
        for part in slices(batch):
            w = words(*utf8(part.column(1)), ALNUM)
            size = max(1, len(w.vocabulary))
            pairs = np.unique(np.repeat(np.arange(part.num_rows), np.diff(w.first)) * size + w.index)
            row = pa.array(pairs // size)
            yield pa.record_batch([part.column(0).take(row), part.column(2).take(row), w.vocabulary.take(pa.array(pairs % size))], names=["item_id", "key", "term"])


def _write_terms(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column(0) for b in batches if b.num_rows]
        if parts:
            terms = pa.chunked_array(parts).combine_chunks().cast(pa.binary())
            name = f"{folder}/{TaskContext.get().partitionId():06d}.terms"
            write_file(name, _ipc(pa.record_batch([terms], names=["term"])))
            yield pa.record_batch([terms, pa.array([name] * len(terms)), pa.array(np.arange(len(terms)))], names=["term", "file", "at"])
    return run


def vocabulary(terms: DataFrame) -> Terms:
    """Number the distinct values of the column ``term`` and write them in files of bounded size."""
    spark = terms.sparkSession
    terms = materialize(terms.select("term").distinct(), "terms")
    n = terms.count()
    folder = shared_dir(spark, "vocabulary")
    t = materialize(terms.repartition(max(1, -(-n // TERMS)), "term").mapInArrow(_write_terms(folder), "term binary, file string, at long"), "vocabulary")
    sizes = sorted((r.file, r["count"]) for r in t.groupBy("file").count().collect())
    first = dict(zip([f for f, _ in sizes], np.cumsum([0, *(c for _, c in sizes)]).tolist(), strict=False))
    ids = F.create_map(*[F.lit(x) for pair in first.items() for x in pair]) if first else F.create_map(F.lit(""), F.lit(0))
    return Terms(t.select("term", (ids[F.col("file")] + F.col("at")).cast("long").alias("term_id")), list(first.items()))


def _profiles(files: list[tuple[str, int]]):
    """Tasks count terms: (doc_id, n, terms, tfs) of each text with a term; terms of the vocabulary only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [(_read(f).column(0), first) for f, first in files]
        for batch in batches:
            for part in slices(batch):
                w = words(*utf8(part.column(1)), ALNUM)
                ids = np.full(len(w.vocabulary), -1, np.int64)
                for terms, first in known:
                    at = pc.index_in(w.vocabulary, value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False)
                    ids = np.where(at >= 0, at + first, ids)
                doc = np.repeat(np.arange(part.num_rows), np.diff(w.first))
                size = max(1, len(w.vocabulary))
                asked = ids[w.index] >= 0 if len(w.index) else np.zeros(0, bool)
                pairs, tf = np.unique(doc[asked] * size + w.index[asked], return_counts=True)
                n = np.diff(w.first)
                keep = np.flatnonzero(n)
                bounds = np.searchsorted(pairs // size, np.arange(part.num_rows + 1)).astype(np.int32)
                offs = pa.array(np.append(bounds[keep], bounds[-1]).astype(np.int32))  # documents without a term have no pairs
                lists = [pa.ListArray.from_arrays(offs, pa.array(x)) for x in (ids[pairs % size], tf.astype(np.int64))]
                yield pa.record_batch([part.column(0).take(pa.array(keep)), pa.array(n[keep], pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])
    return run


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        term, n = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
        yield pa.record_batch([pa.array(term, pa.int64()), pa.array(n, pa.int64())], names=["term_id", "df"])


def impact(tf: np.ndarray, m: np.ndarray, k: int) -> np.ndarray:
    """What one unit of weight adds at a term frequency in a stratum."""
    return (1_000_000_000 * tf) // (1000 * tf + k * m)


def _build_unit(folder: str, k: int):
    """A unit's file: documents by m; of each term the runs of equal (m, tf), with their impact, and the runs' documents."""
    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids = t.column("doc_id").fill_null(NO_ID).to_numpy()
        m = t.column("m").to_numpy()
        o = np.lexsort((ids, m))
        place = np.empty(len(o), np.int64)
        place[o] = np.arange(len(o))
        terms, tfs = (t.column(c).combine_chunks() for c in ("terms", "tfs"))
        terms = terms.chunk(0) if isinstance(terms, pa.ChunkedArray) else terms
        tfs = tfs.chunk(0) if isinstance(tfs, pa.ChunkedArray) else tfs
        doc = np.repeat(np.arange(len(ids)), np.diff(terms.offsets.to_numpy()))
        term, tf = terms.flatten().to_numpy(), tfs.flatten().to_numpy()
        p = np.lexsort((place[doc], -tf, m[doc], term))
        doc, term, tf = doc[p], term[p], tf[p]
        run_at = np.flatnonzero(np.diff(term, prepend=-1) | np.diff(m[doc], prepend=-1) | np.diff(tf, prepend=-1))
        term_at = np.flatnonzero(np.diff(term[run_at], prepend=-1))
        cuts = np.flatnonzero(np.diff(m[o], prepend=-1))  # first document of each stratum
        cols = {"doc_id": ids[o], "cuts": np.append(cuts, len(o)), "term": term[run_at][term_at], "term_at": np.append(term_at, len(run_at)),
                "run_at": np.append(run_at, len(doc)), "impact": impact(tf[run_at], m[doc[run_at]], k),
                "stratum": np.searchsorted(cuts, place[doc[run_at]], side="right") - 1, "docs": place[doc].astype(np.int32)}
        one = pa.record_batch([pa.array([x]) for x in cols.values()], names=list(cols))
        name = f"{folder}/{t.column('band')[0].as_py()}-{t.column('part')[0].as_py()}.unit"
        write_file(name, _ipc(one))
        return pa.table({"band": t.column("band")[:1], "part": t.column("part")[:1], "file": [name], "n_docs": pa.array([len(o)], pa.int64())})
    return run


class Index(NamedTuple):
    """Units (band, part, file, n_docs), the vocabulary, and the terms' (term_id, df, w)."""

    units: DataFrame
    terms: Terms
    weights: DataFrame
    k: int


def all_terms(texts: DataFrame) -> DataFrame:
    """The distinct terms of a table (doc_id, text)."""
    t = texts.select(F.lit(0).alias("item_id"), "text", F.lit(0).alias("key"))
    return t.mapInArrow(_distinct_terms, "item_id int, key int, term binary").select("term").distinct()


def build_index(docs: DataFrame, terms: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", *, b: int = 90, k: int = 8,
                unit: int = UNIT) -> Index:
    """Index every document, for all terms or those in the column ``term`` (binary) of ``terms``."""
    spark = docs.sparkSession
    t = text_rows(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    known = vocabulary(terms if terms is not None else all_terms(t))
    rows = t.mapInArrow(_profiles(known.files), "doc_id long, n long, terms array<long>, tfs array<long>")
    rows = materialize(rows.withColumn("uid", F.monotonically_increasing_id()), "profiles")
    total = rows.agg(F.count("n").alias("n"), F.sum("n").alias("l")).first()
    n, length = total["n"], total["l"] or 1
    df = rows.select("terms").mapInArrow(_document_counts, "term_id long, df long").groupBy("term_id").agg(F.sum("df").alias("df"))
    w = F.floor(1000 * F.log((2.0 * n + 2) / (2 * F.col("df").cast("double") + 1))).cast("bigint")
    weights = materialize(df.withColumn("w", w), "weights")
    rows = rows.withColumn("m", F.expr(f"{100 - b} + ({b}L * n * {n}L) div {length}L"))
    rows = rows.withColumn("band", F.floor(F.log2(F.col("m").cast("double")) * BANDS).cast("int"))
    parts = {r.band: -(-r["count"] // unit) for r in rows.groupBy("band").count().collect()}  # some hundred bands at most
    parts = F.create_map(*[F.lit(x) for pair in sorted(parts.items()) for x in pair]) if parts else F.create_map(F.lit(0), F.lit(1))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("uid"), parts[F.col("band")]).cast("int"))
    made = rows.select("doc_id", "m", "terms", "tfs", "band", "part").groupBy("band", "part").applyInArrow(
        _build_unit(shared_dir(spark, "index"), k), "band int, part int, file string, n_docs long")
    return Index(materialize(made, "units"), known, weights, k)


def _write_items(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, batch in enumerate(batches):
            for j in range(0, batch.num_rows, ITEMS):
                name = f"{folder}/{TaskContext.get().partitionId():06d}-{i}-{j}.items"
                write_file(name, _ipc(batch.slice(j, ITEMS)))
                yield pa.record_batch([pa.array([name])], names=["file"])
    return run


class Unit:
    """One file of the index, searched by one item at a time."""

    def __init__(self, file: str):
        one = _read(file)
        get = lambda name: one.column(one.schema.get_field_index(name)).flatten().to_numpy()
        self.doc_id, self.cuts, self.term, self.term_at, self.run_at, self.impact, self.stratum, self.docs = map(
            get, ("doc_id", "cuts", "term", "term_at", "run_at", "impact", "stratum", "docs"))
        self.sizes = np.diff(self.cuts)

    def search(self, terms: np.ndarray, weights: np.ndarray, top: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of the best ``top`` of this unit that score ``floor`` or more (and above 0)."""
        at = np.searchsorted(self.term, terms)
        ok = at < len(self.term)
        ok[ok] = self.term[at[ok]] == terms[ok]
        runs = [(self.term_at[i], self.term_at[i + 1], w) for i, w in zip(at[ok], weights[ok], strict=True) if w]
        bound = np.zeros(len(self.sizes), np.int64)
        for lo, hi, w in runs:
            s = self.stratum[lo:hi]
            lead = np.flatnonzero(np.diff(s, prepend=-1))  # the highest tf of each stratum
            bound[s[lead]] += w * self.impact[lo:hi][lead]
        floor = max(1, floor)
        score = np.zeros(len(self.doc_id), np.int64)
        # The strata with the highest bounds, until they hold enough documents; then the others that can still matter.
        order = np.argsort(-bound, kind="stable")
        first = np.zeros(len(bound), bool)
        first[order[:int(np.searchsorted(np.cumsum(self.sizes[order]), 8 * top)) + 1]] = True
        first &= bound >= floor
        self._add(score, runs, first)
        if np.count_nonzero(score) >= top:
            floor = max(floor, int(np.partition(score, -top)[-top]))
        self._add(score, runs, (bound >= floor) & ~first)
        if len(score) > top:
            floor = max(floor, int(np.partition(score, -top)[-top]))
        found = np.flatnonzero(score >= floor)
        best = found[np.lexsort((self.doc_id[found], -score[found]))][:top]
        return self.doc_id[best], score[best]

    def _add(self, score: np.ndarray, runs: list[tuple[int, int, int]], visit: np.ndarray) -> None:
        """Add the terms' contributions in the strata to visit."""
        if not visit.any():
            return
        whole = visit.all()
        for lo, hi, w in runs:
            if whole:
                begin, end = self.run_at[lo], self.run_at[hi]
                score[self.docs[begin:end]] += np.repeat(w * self.impact[lo:hi], np.diff(self.run_at[lo:hi + 1]))
                continue
            r = lo + np.flatnonzero(visit[self.stratum[lo:hi]])
            if len(r):
                size = self.run_at[r + 1] - self.run_at[r]
                at = np.arange(size.sum()) + np.repeat(self.run_at[r] - (np.cumsum(size) - size), size)
                score[self.docs[at]] += np.repeat(w * self.impact[r], size)


def _search(files: list[str], top: int):
    """Tasks search their units for all items, a block of items at a time, and return the best of each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = sorted(f for b in batches for f in b.column(0).to_pylist())
        for file in files if units else ():
            items = _read(file)
            get = lambda name: items.column(items.schema.get_field_index(name))
            terms = [(np.asarray(t, np.int64), np.asarray(w, np.int64)) for t, w in zip(get("terms").to_pylist(), get("weights").to_pylist(), strict=True)]
            best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(terms)
            for name in units:
                unit = Unit(name)
                for i, (t, w) in enumerate(terms):
                    ids, scores = best[i]
                    d, s = unit.search(t, w, top, int(scores[-1]) if len(scores) == top else 1)
                    if len(d):
                        d, s = np.append(ids, d), np.append(scores, s)
                        o = np.lexsort((d, -s))[:top]
                        best[i] = d[o], s[o]
            row = pa.array(np.repeat(np.arange(len(best)), [len(d) for d, _ in best]))
            d, s = (np.concatenate([x[j] for x in best]) for j in (0, 1))
            yield pa.record_batch([get("item_id").take(row), get("key").take(row), pa.array(d, mask=d == NO_ID), pa.array(s)], names=["item_id", "key", "doc_id", "score"])
    return run


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, key, term) of the items' distinct terms; ``key`` tells texts of one id apart."""
    t = text_rows(items, id_col, text_col).where("text is not null").withColumn("key", F.xxhash64("text"))
    kind = t.schema["doc_id"].dataType.simpleString()
    return t.mapInArrow(_distinct_terms, f"item_id {kind}, key long, term binary").distinct()


def search(index: Index, terms: DataFrame, top: int = 10) -> DataFrame:
    """The best ``top`` documents of each item (``item_terms``): item_id, rank (int, from 1), doc_id, score."""
    spark = terms.sparkSession
    kind = terms.schema["item_id"].dataType.simpleString()
    weighted = index.terms.table.join(index.weights, "term_id").select("term", "term_id", "w")
    asked = terms.join(weighted, "term").groupBy("item_id", "key").agg(F.sort_array(F.collect_list(F.struct("term_id", "w"))).alias("t"))
    asked = asked.select("item_id", "key", F.col("t.term_id").alias("terms"), F.col("t.w").alias("weights"))
    files = sorted(r[0] for r in asked.mapInArrow(_write_items(shared_dir(spark, "items")), "file string").collect())
    units = index.units.select("file").repartition(max(1, -(-index.units.count() // 4)), "file")
    found = units.mapInArrow(_search(files, top), f"item_id {kind}, key long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item_id", "key").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, item_id_col: str = "item_id", item_text_col: str = "text",
                  top: int = 10, b: int = 90, k: int = 8, unit: int = UNIT) -> DataFrame:
    """Index the documents for the items' terms and search it."""
    terms = materialize(item_terms(items, item_id_col, item_text_col), "item-terms")
    return search(build_index(docs, terms, id_col, text_col, b=b, k=k, unit=unit), terms, top)
