"""Hard negatives by threshold joins in the manner of L2AP.

Rows are (vec_id, label, vector of integers).  Each anchor has positives (its best rows of the same label) and, for each of them, a
window of scores in which rows of other labels are hard negatives; the best few of the window are mined.  A score is the integer
inner product; higher scores come first, equal ones by smaller vec_id.

Both searches are threshold joins of the anchors with all rows.  A join has a threshold for each anchor:

- Dimensions are taken in one order, those with the most energy last.  A row leaves out of the inverted index the leading
  dimensions whose norm times that of any anchor stays below the threshold: no pair can reach it there alone.
- Anchors accumulate partial scores over the postings, last dimensions first.  A pair goes as soon as its partial score plus
  the product of the two remaining norms is below the threshold; the few that are left get their remaining dimensions.
- Anchors whose windows are not full go on to the next join with a lower threshold, down to the window's end; after the last
  one nothing is missing, so that results are exact.

Rows are dealt by hash in blocks of ``ROWS``, anchors are read from written files, also in blocks: the stated query set meets all
rows, and memory is one block of each.  A task returns only the best few of an anchor and row block, since no others can be
among the best few of all, so a vector that a third of all rows share costs arithmetic alone.

Defined cases: rows with a null label, a null vector, or a component that is null, NaN or infinite take no part; rows that are equal
in id, label and vector count once; rows of one id that differ are separate rows (an anchor's "other rows" are those that differ from
it in any of the three); a null id is allowed and counts as smallest.  Vectors of unequal length are padded with zeros, an empty
vector scores 0 with all.  Vectors whose squared norm exceeds 2^53 raise, because scores would no longer be exact.  Empty tables give
no rows.  Columns that the operator doesn't name are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_file, materialize, shared_dir, write_file

ROWS = 4096  # of one block of the inverted index
ANCHORS = 256  # scored against a block at a time
CHUNK = 8  # dimensions between two prunings
SPARSE = 0.04  # share of a block's pairs from which the rest is computed pair by pair
LEVELS = (0.7, 0.5, 0.35, 0.25, 0.15, 0.0)  # thresholds of the positives, as a share of the norms' product; then all rows
LOWER = (0.9, 0.75)  # thresholds of the negatives, as a share of the windows' upper ends; then their lower ends
ALL = -(1 << 60)
NO_ID = -(1 << 63)

HITS = "a_id long, a_key long, slot int, vec_id long, key long, score long"


def integer_vector(vector: Column, scale: float) -> Column:
    """Components times ``scale``, rounded down; null if the vector or a component is null, NaN or infinite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def _prepared(rows: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """vec_id, label, q (integers), key (tells rows of one id apart), n2 (squared norm); equal rows once."""
    t = rows.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("bigint").alias("label"),
                    F.col(vector_col).cast("array<bigint>").alias("q"))
    t = t.where("label is not null and q is not null").distinct()
    t = t.withColumn("n2", F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    key = F.xxhash64("label", "q")
    return t.select("vec_id", "label", "q", key.alias("key"),
                    F.when(F.col("n2") <= float(1 << 53), F.col("n2")).otherwise(F.raise_error(F.lit("vector too long for exact scores"))).alias("n2"))


def _energy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each dimension and task: the sum of squares."""
    total = np.zeros(0)
    for batch in batches:
        col = batch.column(0)
        sizes = np.diff(col.offsets.to_numpy())
        flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        dim = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        part = np.bincount(dim, flat * flat)
        wide = np.zeros(max(len(part), len(total)))
        wide[:len(total)] += total
        wide[:len(part)] += part
        total = wide
    if len(total):
        yield pa.record_batch([pa.array(np.arange(len(total)), pa.int64()), pa.array(total)], names=["dim", "energy"])


def _matrix(column: pa.Array, order: np.ndarray) -> np.ndarray:
    """The vectors of a batch, padded with zeros, dimensions in ``order``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    x = np.zeros((len(column), len(order)), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    x[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return x[:, order]


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _write_anchors(folder: str, order: np.ndarray, slots: int):
    """Tasks write their anchors as rows of integers: id, key, label, threshold, lower ends, upper ends, vector."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            get = lambda name: b.column(b.schema.get_field_index(name))
            ends = [np.stack(get(c).to_pylist()).astype(np.int64).reshape(b.num_rows, slots) for c in ("lows", "highs")]
            m = np.concatenate([np.stack([_ids(get("vec_id")), _ids(get("key")), _ids(get("label")), _ids(get("theta"))], 1), *ends,
                                _matrix(get("q"), order)], 1)
            name = f"{folder}/{uuid.uuid4().hex}.anchors"
            write_file(name, np.ascontiguousarray(m).tobytes())
            yield pa.record_batch([pa.array([name])], names=["file"])
    return write


class Block:
    """Inverted index of some rows for thresholds of ``least`` or more (a score divided by the anchor's norm).

    Rows that leave out fewer dimensions come first, so that the postings of a chunk of dimensions are the first so many rows.
    """

    def __init__(self, ids: np.ndarray, keys: np.ndarray, labels: np.ndarray, x: np.ndarray, least: float):
        self.edges = np.append(np.arange(0, x.shape[1], CHUNK), x.shape[1])
        norms = self.norms(x)
        out = np.maximum((norms < least).sum(1) - 1, 0)  # chunks left out: the norm of the dimensions up to there is too small
        o = np.argsort(out, kind="stable")
        self.ids, self.keys, self.labels, self.x, self.out, self.left = ids[o], keys[o], labels[o], x[o], out[o], norms[o]
        self.posted = np.searchsorted(self.out, np.arange(len(self.edges) - 1), side="right")

    def norms(self, x: np.ndarray) -> np.ndarray:
        """Norms of the dimensions before each edge."""
        squares = np.concatenate([np.zeros((len(x), 1)), np.cumsum(x * x, axis=1)], 1)
        return np.sqrt(squares[:, self.edges])

    def join(self, q: np.ndarray, theta: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, score) of the wanted pairs that reach the anchor's threshold."""
        left = self.norms(q)
        part = np.zeros(wanted.shape)
        for c in range(len(self.edges) - 2, -1, -1):
            k, dims = self.posted[c], slice(self.edges[c], self.edges[c + 1])
            part[:, :k] += q[:, dims] @ self.x[:k, dims].T
            bound = left[:, c, None] * self.left[None, :, c]
            # Rows that are not posted here still have the dimensions up to their own edge ahead of them.
            if k < len(self.x):
                rest = np.arange(k, len(self.x))
                bound[:, k:] = left[:, self.out[rest]] * self.left[rest, self.out[rest]][None]
            wanted &= part + bound * (1 + 1e-9) + 1e-3 >= theta[:, None]
            if c == 0 or np.count_nonzero(wanted) <= SPARSE * wanted.size:
                break
        else:
            c = 0
        a, r = np.nonzero(wanted)
        score = part[a, r]
        ahead = np.maximum(c, self.out[r])  # chunks that the pair has not met yet
        for e in range(int(ahead.max(initial=0))):
            at = np.flatnonzero(ahead > e)
            dims = slice(self.edges[e], self.edges[e + 1])
            score[at] += np.einsum("ij,ij->i", q[a[at], dims], self.x[r[at], dims])
        ok = score >= theta[a]
        return a[ok], r[ok], score[ok].astype(np.int64)


def _best(a: np.ndarray, r: np.ndarray, score: np.ndarray, block: Block, n: int) -> np.ndarray:
    """Positions of the first ``n`` hits of each anchor."""
    o = np.lexsort((block.keys[r], block.ids[r], -score, a))
    head = np.flatnonzero(np.diff(a[o], prepend=-1))
    rank = np.arange(len(o)) - np.repeat(head, np.diff(np.append(head, len(o))))
    return o[rank < n]


def _join(files: list[str], order: np.ndarray, slots: int, same: bool, n: int):
    """Task of a threshold join: all anchors meet the task's rows, block by block."""
    width = 4 + 2 * slots + len(order)

    def anchors() -> Iterator[np.ndarray]:
        for file in files:
            m = map_file(file, "<i8").reshape(-1, width)
            for i in range(0, len(m), ANCHORS):
                yield np.array(m[i:i + ANCHORS])

    def scan(ids, keys, labels, x) -> Iterator[pa.RecordBatch]:
        block, least = None, None
        for m in anchors():
            theta, q = m[:, 3].astype(np.float64), m[:, 4 + 2 * slots:].astype(np.float64)
            size = np.sqrt((q * q).sum(1))
            share = np.where(theta > 0, theta / np.maximum(size, 1e-300), 0.0).min()
            # The index serves these anchors if it was built for no higher threshold; it is built anew for much lower ones.
            if block is None or share < least or share > 1.2 * least:
                least = 0.97 * share
                block = Block(ids, keys, labels, x, least)
            equal = m[:, 2, None] == block.labels[None]
            if same:
                wanted = equal & ~((m[:, 0, None] == block.ids[None]) & (m[:, 1, None] == block.keys[None]))
            else:
                wanted = ~equal
            a, r, score = block.join(q, theta, wanted)
            for s in range(slots):
                inside = (score >= m[a, 4 + s]) & (score <= m[a, 4 + slots + s])
                at = np.flatnonzero(inside)
                at = at[_best(a[at], r[at], score[at], block, n)]
                if len(at):
                    ids_out = block.ids[r[at]]
                    yield pa.record_batch([pa.array(m[a[at], 0], mask=m[a[at], 0] == NO_ID), pa.array(m[a[at], 1]), pa.array(np.full(len(at), s, np.int32)),
                                           pa.array(ids_out, mask=ids_out == NO_ID), pa.array(block.keys[r[at]]), pa.array(score[at])],
                                          names=["a_id", "a_key", "slot", "vec_id", "key", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                held.append(b.slice(i, ROWS))
                if sum(h.num_rows for h in held) >= ROWS:
                    yield from flush(held)
                    held = []
        if held:
            yield from flush(held)

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        col = lambda name: t.column(name).combine_chunks()
        yield from scan(_ids(col("vec_id")), _ids(col("key")), _ids(col("label")), _matrix(col("q"), order).astype(np.float64))

    return run


def threshold_join(rows: DataFrame, anchors: DataFrame, order: np.ndarray, *, slots: int, same: bool, n: int) -> DataFrame:
    """The best ``n`` rows (columns ``HITS``) in each of an anchor's windows [lows, highs] that reach its ``theta``.

    ``anchors`` has vec_id, key, label, q, theta, and the arrays lows and highs of ``slots`` entries.  ``same``: rows of the
    anchor's label other than itself, or else rows of other labels.  The result is a written table.
    """
    folder = shared_dir(rows.sparkSession, "anchors")
    files = [r[0] for r in anchors.mapInArrow(_write_anchors(folder, order, slots), "file string").collect()]
    hits = rows.select("vec_id", "key", "label", "q").mapInArrow(_join(sorted(files), order, slots, same, n), HITS)
    rank = F.row_number().over(Window.partitionBy("a_id", "a_key", "slot").orderBy(F.desc("score"), F.asc_nulls_first("vec_id"), "key"))
    return materialize(hits.withColumn("rank", rank).where(F.col("rank") <= n), "hits")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def mine(rows: DataFrame, is_anchor: Column, *, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "vector", positives: int = 5,
         negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank (int, from 1), negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on the column ``vec_id``; ``vector_col`` holds integers (``integer_vector``).  A negative's score times 100 lies between
    ``low`` and ``high`` times the positive's.
    """
    if not 0 <= low < high:
        raise ValueError("0 <= low < high is needed")
    t = _prepared(rows, id_col, label_col, vector_col)
    t = materialize(t.repartition(max(1, -(-rows.count() // ROWS)), "vec_id", "key"), "vectors")
    energy = t.select("q").mapInArrow(_energy, "dim long, energy double").groupBy("dim").agg(F.sum("energy").alias("energy"))
    energy = sorted((r.energy, r.dim) for r in energy.collect())
    order = np.array([d for _, d in energy], np.int64)
    longest = float(np.sqrt(t.agg(F.max("n2")).first()[0] or 0.0))
    anchors = t.where(is_anchor)

    # Positives: a threshold for each anchor, lowered until it has enough rows above it.
    open_, found = anchors, []
    me = ["vec_id", "key"]
    for level in (*LEVELS, None):
        theta = F.lit(ALL) if level is None else F.floor(F.sqrt("n2") * longest * level).cast("bigint")
        asked = open_.withColumn("theta", theta).withColumn("lows", F.array("theta")).withColumn("highs", F.array(F.lit(1 << 62)))
        hits = threshold_join(t, asked, order, slots=1, same=True, n=positives)
        full = hits.groupBy("a_id", "a_key").count().where(F.col("count") >= positives) if level is not None else hits.select("a_id", "a_key").distinct()
        found.append(hits.join(full, (hits.a_id.eqNullSafe(full.a_id)) & (hits.a_key == full.a_key), "left_semi"))
        if level is not None:
            open_ = materialize(open_.join(full, open_.vec_id.eqNullSafe(full.a_id) & (open_.key == full.a_key), "left_anti"), "anchors")
            if open_.isEmpty():
                break
    pos = _union(found).select("a_id", "a_key", F.col("rank").alias("p"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # A negative score has no window, since low < high.
    pos = pos.where("positive_score >= 0").withColumns({"lo": F.expr(f"({low} * positive_score + 99) div 100"), "hi": F.expr(f"({high} * positive_score) div 100")})
    pos = materialize(pos.where("lo <= hi"), "windows")

    # Negatives: all windows of an anchor in one join, open ones only, from their upper ends downwards.
    open_, found = pos, []
    for share in (*LOWER, None):
        floor = F.col("lo") if share is None else F.greatest("lo", F.floor(F.col("hi") * share).cast("bigint"))
        w = open_.withColumn("at", floor)
        ends = lambda c, none: F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda i: F.coalesce(F.element_at(F.col(c), i), F.lit(none)))
        w = w.groupBy("a_id", "a_key").agg(F.min("at").alias("theta"), F.map_from_entries(F.collect_list(F.struct("p", "at"))).alias("at"),
                                           F.map_from_entries(F.collect_list(F.struct("p", "hi"))).alias("hi"))
        w = w.select("a_id", "a_key", "theta", ends("at", 1).alias("lows"), ends("hi", 0).alias("highs"))
        asked = anchors.join(w, anchors.vec_id.eqNullSafe(w.a_id) & (anchors.key == w.a_key)).select(*me, "label", "q", "theta", "lows", "highs")
        hits = threshold_join(t, asked, order, slots=positives, same=False, n=negatives).withColumn("p", F.col("slot") + 1)
        n = hits.groupBy(F.col("a_id").alias("b_id"), F.col("a_key").alias("b_key"), F.col("p").alias("b_p")).count()
        state = open_.join(n, F.col("a_id").eqNullSafe(F.col("b_id")) & (F.col("a_key") == F.col("b_key")) & (F.col("p") == F.col("b_p")), "left")
        done = (F.coalesce("count", F.lit(0)) >= negatives) | (floor <= F.col("lo"))
        cols = ["a_id", "a_key", "p", "positive_id", "positive_score", "lo", "hi"]
        full = state.where(done).select(F.col("a_id").alias("b_id"), F.col("a_key").alias("b_key"), F.col("p").alias("b_p"), "positive_id", "positive_score")
        found.append(full.join(hits, F.col("a_id").eqNullSafe(F.col("b_id")) & (F.col("a_key") == F.col("b_key")) & (F.col("p") == F.col("b_p"))).select(
            F.col("a_id").alias("anchor_id"), "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
        if share is not None:
            open_ = materialize(state.where(~done).select(*cols), "windows")
            if open_.isEmpty():
                break
    return _union(found)
