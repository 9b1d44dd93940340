"""Near-duplicates with Order MinHash: candidates that share an ordered sketch, verified by banded alignment.

A text is the sequence of its shingles of ``K`` words (words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, A-Z lower-cased; a text of fewer
words is one shingle).  Two texts are linked when the longest common subsequence of their shingles is at least
``SIMILARITY`` of the shingles either has: ``L / (n + m - L) >= 0.8``.  Classes are the connected components of the links.

Each shingle is labelled with its occurrence in the text.  A sketch takes the ``SMALLEST`` labelled shingles under one hash
function and keeps them in text order, so that texts agree on it only if they share these shingles in the same order; a
text has ``SKETCHES`` of them (a link at the threshold shares none with a probability of about 1e-6; texts of up to
``SHORT`` shingles, too few to draw from, also have ``SHORT_SKETCHES`` sketches of one shingle).  A shared sketch is a bucket.

Texts with equal words are one node from the start.

Texts with equal words are one node from the start.  Within a bucket not all pairs are looked at:

1. Every member is compared with the bucket's hub, the member with the most company over all its buckets.  The links make
   components.
2. A bucket of two, or with all members in one component, is done.  In the others, every member outside the largest component is
   compared with one member of it, a different one in each bucket.
3. The members of buckets that still are not done, unlike texts that share a passage for the most part, are joined by an
   exact rule instead of by bucket: if shingles are ordered by how many of these
   texts have them, two linked texts share one among the rarest ``n - ceil(0.8 n) + 1`` of each.  A shared passage is not
   among them, so only such pairs meet that could be links, in one pass at any size of the bucket, and none is lost.  Of a
   pair, the first shingle in common also bounds how many can follow; pairs that it leaves too few are not made.

Defined results: a null text, an empty one, and one without words are classes of their own; a null doc_id is the smallest; of a
class the smallest doc_id stays (of rows that tie in id, one); repeated rows are copies; an empty table gives no rows; only id and
text are read.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, Words, materialize, mix, slices, text_rows, utf8, word_hashes, words
from .components import components
from .exact_dedup import keep_rows

K, SIMILARITY = 5, 0.8
SMALLEST, SKETCHES = 5, 40
SHORT, SHORT_SKETCHES = 12, 12
SEEDS = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64))
ODD = mix(np.arange(101, 101 + SKETCHES, dtype=np.uint64)) | np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all documents, and each document's first shingle (and one entry at the end)."""
    sizes = np.diff(first)
    n = np.where(sizes >= k, sizes - k + 1, (sizes > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(n)])
    start = np.arange(at[-1]) - np.repeat(at[:-1], n) + np.repeat(first[:-1], n)
    left = np.repeat(np.minimum(sizes, k), n)  # words in the shingle
    out = np.zeros(len(start), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            word = hashes[np.minimum(start + i, max(len(hashes) - 1, 0))] if len(hashes) else out
            out = np.where(i < left, mix(out * STEP + word + np.uint64(i + 1)), out)
    return out, at


def labelled(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The shingles with the number of their occurrence in the document mixed in."""
    doc = np.repeat(np.arange(len(at) - 1, dtype=np.uint64), np.diff(at))
    with np.errstate(over="ignore"):
        key = mix(s + doc * STEP)
        order = np.argsort(key, kind="stable")
        k = key[order]
        run = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        nth = np.arange(len(k)) - np.repeat(run, np.diff(np.append(run, len(k))))
        out = np.empty_like(s)
        out[order] = np.where(nth > 0, mix(s[order] + nth.astype(np.uint64) * ODD[0]), s[order])
    return out


def sketches(x: np.ndarray, smallest: int, count: int) -> np.ndarray:
    """Ordered sketches of one document's labelled shingles."""
    out = np.empty(count, np.uint64)
    rows = max(1, min(count, (1 << 20) // max(1, len(x))))  # hash functions at a time
    with np.errstate(over="ignore"):
        for i in range(0, count, rows):
            j = np.arange(i, min(i + rows, count))
            if len(x) > smallest:
                h = (x[None] ^ SEEDS[j, None]) * ODD[j, None]
                pick = np.sort(np.argpartition(h, smallest - 1, axis=1)[:, :smallest], axis=1)
            else:
                pick = np.broadcast_to(np.arange(len(x)), (len(j), len(x)))
            sig = (j + 1).astype(np.uint64) * ODD[smallest]
            for c in range(pick.shape[1]):
                sig = mix(sig * STEP + x[pick[:, c]])
            out[j] = sig
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            data, offs = utf8(part.column(2))
            w: Words = words(data, offs, ALNUM)
            hashes = word_hashes(w.vocabulary)[w.index] if len(w.index) else np.zeros(0, np.uint64)
            s, at = shingles(hashes, w.first)
            x = labelled(s, at)
            prints, sigs = [], []
            for d in range(part.num_rows):
                own = x[at[d]:at[d + 1]]
                h = xxhash.xxh3_128_digest(hashes[w.first[d]:w.first[d + 1]].tobytes())
                prints.append((int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)))
                sig = sketches(own, SMALLEST, SKETCHES) if len(own) else np.zeros(0, np.uint64)
                if 0 < len(own) <= SHORT:
                    sig = np.concatenate([sig, sketches(own, 1, SHORT_SKETCHES)])
                sigs.append(sig.view(np.int64))
            cells = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(g) for g in sigs])]), pa.int32()),
                                             pa.array(np.concatenate(sigs) if sigs else np.zeros(0, np.int64)))
            yield pa.record_batch([part.column(0), part.column(1), pa.array(np.diff(at)), pa.array([p[0] for p in prints], pa.int64()),
                                   pa.array([p[1] for p in prints], pa.int64()), cells],
                                  names=["doc_id", "row_hash", "n", "fp1", "fp2", "sigs"])


def aligned(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> int:
    """Length of the longest common subsequence, by an alignment in the band that the similarity leaves; if the result is
    too short for the similarity, it is only a lower bound."""
    n, m = len(a), len(b)
    least = min(n, m)
    diff = np.flatnonzero(a[:least] != b[:least])
    head = int(diff[0]) if len(diff) else least
    a, b = a[head:], b[head:]
    least = min(len(a), len(b))
    diff = np.flatnonzero(a[::-1][:least] != b[::-1][:least])
    tail = int(diff[0]) if len(diff) else least
    a, b = a[:len(a) - tail], b[:len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    # L / (n + m - L) >= s leaves n + m - 2 L insertions and deletions at most: so far from the diagonal may a path go.
    band = int((n + m) * (1 - 2 * similarity / (1 + similarity)) + 1e-9) + 1
    width = 2 * band + 1
    pad = np.concatenate([np.zeros(band, np.uint64), b, np.zeros(band + len(a), np.uint64)])
    inside = np.concatenate([np.zeros(band, bool), np.ones(len(b), bool), np.zeros(band + len(a), bool)])
    row = np.zeros(width + 1, np.int32)  # row[j]: the best with i of a and up to i - band + j of b
    for i in range(len(a)):
        match = (pad[i:i + width] == a[i]) & inside[i:i + width]
        # Moving one down shifts the band by one: the diagonal neighbour keeps its index, the upper one is a step right.
        new = np.maximum(row[:width] + match, row[1:])
        np.maximum.accumulate(new, out=new)
        row[:width] = new
        row[width] = 0
    at = len(b) - len(a) + band
    return head + tail + int(row[min(max(at, 0), width - 1)])


def chain(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest run of shared labelled shingles in the same order: an alignment, though it matches only
    equal occurrences."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    j = j[np.argsort(i)]
    if (np.diff(j) > 0).all():
        return len(j)
    tails: list[int] = []
    for x in j.tolist():
        at = bisect.bisect_left(tails, x)
        tails[at:at + 1] = [x]
    return len(tails)


def similarity_of(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, threshold: float = SIMILARITY) -> tuple[float, float]:
    """Overlap (shared labelled shingles of all) and, if it reaches the threshold, the aligned similarity (else 0).

    The chain of labelled shingles gives a lower bound of the alignment; where it reaches the threshold, as it does unless
    repeated passages have moved, it is the result, otherwise the banded alignment of all shingles is.
    """
    n, m = len(a), len(b)
    shared = len(np.intersect1d(la, lb, assume_unique=True))
    overlap = shared / (n + m - shared) if n + m else 0.0
    if overlap < threshold - 1e-9:
        return overlap, 0.0
    length = chain(la, lb)
    if length < threshold * (n + m - length):
        length = max(length, aligned(a, b, threshold))
    return overlap, length / (n + m - length)


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of each text in their order (64-bit hashes, binary)."""
    for batch in batches:
        for part in slices(batch):
            data, offs = utf8(part.column(1))
            w = words(data, offs, ALNUM)
            s, at = shingles(word_hashes(w.vocabulary)[w.index], w.first)
            cells = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer((at * 8).astype(np.int64)), pa.py_buffer(s.tobytes())])
            yield pa.record_batch([part.column(0), cells.cast(pa.binary())], names=["uid", "shingles"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hub, s, x = None, None, None

    def of(cell: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
        own = np.frombuffer(cell.as_buffer(), np.uint64)
        return own, labelled(own, np.array([0, len(own)]))

    for batch in batches:
        overlap, similar = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
        for i, a in enumerate(batch.column(0).to_pylist()):
            if a != hub:  # the pairs of a hub come together
                hub, (s, x) = a, of(batch.column(2)[i])
            t, y = of(batch.column(3)[i])
            overlap[i], similar[i] = similarity_of(s, t, x, y)
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(overlap), pa.array(similar)], names=["a", "b", "overlap", "similarity"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, overlap and similarity of candidate pairs (a, b); texts: uid, shingles."""
    j = (pairs.join(texts.select(F.col("uid").alias("a"), F.col("shingles").alias("sa")), "a")
         .join(texts.select(F.col("uid").alias("b"), F.col("shingles").alias("sb")), "b").select("a", "b", "sa", "sb"))
    return materialize(j.sortWithinPartitions("a").mapInArrow(_verify, "a bigint, b bigint, overlap double, similarity double"), "verified")


def _near_size() -> Column:
    """Whether the sizes n and m of two members allow a link."""
    return F.least("n", "m") >= SIMILARITY * F.greatest("n", "m") - 1e-9


def _labels(members: DataFrame, links: DataFrame) -> DataFrame:
    """members with the column comp, the component of each uid."""
    c = components(links)
    return members.join(c, members.uid == c.node, "left").withColumn("comp", F.coalesce("component", "uid")).drop("node", "component")


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each labelled shingle of a text."""
    for batch in batches:
        for uid, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = np.frombuffer(cell.as_buffer(), np.uint64)
            x = labelled(own, np.array([0, len(own)])).view(np.int64)
            yield pa.record_batch([pa.array(np.full(len(x), uid)), pa.array(x)], names=["uid", "x"])


def _rest(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of members (uid, n, comp) in different components that share one of each other's rarest shingles."""
    x = materialize(texts.join(members.select("uid"), "uid", "left_semi").select("uid", "shingles").mapInArrow(_explode, "uid bigint, x bigint"), "rest")
    # Shingles of one text alone are the rarest; of them only the number matters.
    shared = x.groupBy("x").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    own = (x.join(shared, "x").groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("df", "x"))).alias("xs"))
           .join(members, "uid"))
    left = F.col("n") - F.ceil(SIMILARITY * F.col("n") - 1e-9) + 1 - (F.col("n") - F.size("xs"))
    keys = (own.withColumn("left", left.cast("int")).where("left > 0")
            .select("uid", "n", "comp", F.size("xs").alias("s"), F.posexplode(F.slice("xs", 1, F.col("left"))).alias("at", "k"))
            .select("uid", "n", "comp", (F.col("s") - F.col("at")).alias("s"), F.col("k.df").alias("texts"), F.col("k.x").alias("x")))
    keys = materialize(keys, "rarest")
    # Shingles of a passage have the same texts: of those, one is enough, the first in order.
    mixed = (keys.groupBy("x").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("df"), F.min("uid").alias("first"),
                                   F.max("uid").alias("last"), F.bit_xor(F.xxhash64("uid")).alias("who"), F.min("texts").alias("texts"))
             .where("lo < hi").groupBy("lo", "hi", "df", "first", "last", "who").agg(F.min(F.struct("texts", "x")).alias("k")).select("k.x"))
    keys = keys.drop("texts").join(mixed, "x")
    other = keys.select("x", F.col("uid").alias("b"), F.col("n").alias("m"), F.col("comp").alias("cb"), F.col("s").alias("t"))
    # s and t: the shared shingles from this one on.  At the first that two texts have in common they share no more than
    # either has left; a link needs so many of both sizes.
    enough = F.least("s", "t") >= SIMILARITY / (1 + SIMILARITY) * (F.col("n") + F.col("m")) - 1e-9
    return (keys.withColumnRenamed("uid", "a").join(other, "x")
            .where((F.col("a") < F.col("b")) & (F.col("comp") != F.col("cb")) & _near_size() & enough).select("a", "b").distinct())


def _links(members: DataFrame, texts: DataFrame) -> DataFrame:
    """All links (a, b) of the members (bucket, uid, n) of buckets."""
    link = F.col("similarity") >= SIMILARITY - 1e-9
    # 1. Every member against its bucket's hub.
    company = members.join(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")), "bucket").groupBy("uid").agg(F.sum("size").alias("company"))
    hubs = members.join(company, "uid").groupBy("bucket").agg(F.max(F.struct("company", "uid", "n")).alias("h")).select(
        "bucket", F.col("h.uid").alias("hub"), F.col("h.n").alias("m"))
    m = materialize(members.join(hubs, "bucket"), "hubs")
    pairs = m.where((F.col("uid") != F.col("hub")) & _near_size()).select(F.col("hub").alias("a"), F.col("uid").alias("b")).distinct()
    star = verified(pairs, texts)
    m = materialize(_open(m.select("bucket", "uid", "n"), star.where(link)), "open")
    # 2. In buckets that are not done, every member outside the largest component against one member of it.
    one = (m.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct(F.xxhash64("bucket", "uid").alias("h"), "uid", "n")).alias("r"))
           .groupBy("bucket").agg(F.max(F.struct("size", "comp", "r")).alias("t"))
           .select("bucket", F.col("t.comp").alias("most"), F.col("t.r.uid").alias("a"), F.col("t.r.n").alias("m")))
    pairs = m.join(one, "bucket").where((F.col("comp") != F.col("most")) & _near_size()).select("a", F.col("uid").alias("b")).distinct()
    star = star.union(verified(_new(pairs, star), texts))
    # 3. What is left, by the rarest shingles.
    m = _open(m.select("bucket", "uid", "n"), star.where(link)).select("uid", "n", "comp").distinct()
    rest = _new(_rest(materialize(m, "open"), texts), star)
    return star.union(verified(rest, texts)).where(link).select("a", "b")


def _open(members: DataFrame, links: DataFrame) -> DataFrame:
    """The members of buckets that are not done (more than two members, in more than one component), with comp."""
    m = materialize(_labels(members, links.select("a", "b")), "labelled")
    todo = (m.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
            .where("size > 2 and lo < hi").select("bucket"))
    return m.join(todo, "bucket")


def _new(pairs: DataFrame, done: DataFrame) -> DataFrame:
    """Pairs (a, b) that are not among the verified ones, in either order."""
    d = done.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    return pairs.join(d, (F.least("a", "b") == F.col("x")) & (F.greatest("a", "b") == F.col("y")), "left_anti")


def _classified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    t = text_rows(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    t = t.select("doc_id", F.xxhash64("text").alias("row_hash"), "text")
    kind = t.schema["doc_id"].dataType.simpleString()
    rows = t.mapInArrow(_sketch, f"doc_id {kind}, row_hash bigint, n bigint, fp1 bigint, fp2 bigint, sigs array<bigint>")
    # The row numbers are part of the written table: numbers made while reading would change with the split of its files.
    rows = materialize(rows.withColumn("uid", F.monotonically_increasing_id()), "sketches")
    # Texts with equal words are one node, their smallest row.
    same = rows.where("n > 0").groupBy("fp1", "fp2").agg(F.min("uid").alias("rep"))
    nodes = rows.select("uid", "doc_id", "row_hash", "n", "fp1", "fp2").join(same, ["fp1", "fp2"], "left").withColumn(
        "rep", F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("uid"))).drop("fp1", "fp2")
    nodes = materialize(nodes, "nodes")
    # Buckets with company.
    reps = nodes.where("uid = rep and n > 0").select("uid")
    spread = rows.select("uid", "n", F.explode("sigs").alias("bucket")).join(reps, "uid", "left_semi")
    shared = spread.groupBy("bucket").count().where("count > 1").select("bucket")
    members = materialize(spread.join(shared, "bucket").select("bucket", "uid", "n").distinct(), "buckets")
    # Shingles of the candidates alone.
    wanted = members.select("uid").distinct()
    who = nodes.join(wanted, "uid", "left_semi").select("uid", F.col("doc_id").alias("w_id"), F.col("row_hash").alias("w_hash"))
    texts = materialize(t.join(who, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("row_hash") == F.col("w_hash")))
                        .dropDuplicates(["uid"]).select("uid", "text").mapInArrow(_shingle_rows, "uid bigint, shingles binary"), "shingles")
    c = components(_links(members, texts))
    return (nodes.join(c, nodes.rep == c.node, "left").withColumn("comp", F.coalesce("component", "rep"))
            .select("uid", "doc_id", "row_hash", "comp"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, class_id (the smallest doc_id of the class), class_size, kept, row_hash."""
    rows = materialize(_classified(docs, id_col, text_col), "classes")
    top = rows.groupBy("comp").agg(F.min(F.struct("doc_id", "uid")).alias("top"), F.count(F.lit(1)).alias("class_size"))
    return rows.join(top, "comp").select("doc_id", F.col("top.doc_id").alias("class_id"), "class_size",
                                         (F.col("uid") == F.col("top.uid")).alias("kept"), "row_hash")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each class, with all their columns."""
    return keep_rows(docs, near_dedup(docs, id_col, text_col), id_col, text_col)
