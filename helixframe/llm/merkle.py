"""Document fingerprints as Merkle trees, with DataFrame functions only.

A text is cut into paragraphs: after a line feed, after a full stop, question or exclamation mark and one white space, and after ``LONGEST``
UTF-16 units since the last cut (a paragraph that holds a character outside the basic plane has no such limit).  Paragraphs keep all
their characters, so the cut loses nothing.  Each has a 64-bit hash.  A section is a run of paragraphs that ends after one whose hash
is a multiple of ``SECTION`` (or with the text), so that an edit moves no border but those near it; a section's hash is that of its paragraphs'
hashes.  The root is the SHA-256 of the sections' hashes.  Equal texts have equal trees; unequal texts have unequal roots, but for
collisions of 64-bit hashes.  The printed fingerprint is the root and the sections' hashes.

Equal roots end a comparison.  Otherwise sections of equal hash are left out and the paragraphs of the others are compared, which locates
edits (``differing_sections``).  The likeness of two trees is the number of paragraphs they share, repeats counted, divided by those
of the longer one.

``edit_fingerprints`` holds each document against its own edited text and against the next document.  Order is found on narrow keys
(doc_id, hash of the text): ranges of keys are written with their number, the next key comes from a window within a range, and the ends
of ranges meet the first keys of the ranges that follow.  Each text is then shuffled once; the next document's first characters and
tree come to it in a second, smaller shuffle.

Defined cases: a null text counts as empty; an empty text is one empty paragraph; two empty texts are alike (1.0).  Texts of fewer than four
characters are not changed by the edit.  The last document is followed by the first, a single one by itself.  Rows of
one doc_id are ordered by the hash of their texts; equal rows count as one document in the order, and each of them gets its row.
A null doc_id comes first.  An empty table gives no rows; a very long text is one row of one task.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_rows

LONGEST = 64
SECTION = 8
KEYS = 100_000  # of a range of the order, about


def paragraphs(text: Column, longest: int = LONGEST) -> Column:
    """The paragraphs of a text, in order and complete."""
    return F.split(F.coalesce(text, F.lit("")), rf"(?s)(?:(?<=[.!?]\s|\n)|(?<=\G.{{{longest}}}))(?=.)", -1)


def leaves(text: Column, longest: int = LONGEST) -> Column:
    """The hashes of the paragraphs."""
    return F.transform(paragraphs(text, longest), lambda p: F.xxhash64(p))


def sections(leaf: Column, section: int = SECTION) -> Column:
    """Runs of leaves: array of (hash, first, leaves); ``first`` is the number of the first paragraph, from 1."""
    n = F.size(leaf)
    ends = F.filter(F.transform(leaf, lambda x, i: F.when((F.pmod(x, F.lit(section)) == 0) | (i + 1 == n), i + 1)), lambda e: e.isNotNull())
    starts = F.slice(F.concat(F.array(F.lit(0)), ends), 1, F.size(ends))
    return F.zip_with(starts, ends, lambda s, e: F.struct(F.xxhash64(F.slice(leaf, s + 1, e - s)).alias("hash"), (s + 1).alias("first"),
                                                          F.slice(leaf, s + 1, e - s).alias("leaves")))


def root(section: Column) -> Column:
    """Root of the tree as hexadecimal text."""
    return F.sha2(F.array_join(F.transform(section, lambda s: F.hex(s["hash"])), ","), 256)


def fingerprint(section: Column) -> Column:
    """The printed tree: root and sections."""
    return F.concat(root(section), F.lit(":"), F.array_join(F.transform(section, lambda s: F.hex(s["hash"])), ","))


def differing_sections(a: Column, b: Column) -> Column:
    """The sections of ``a`` that ``b`` doesn't have: (hash, first, leaves), in order."""
    own = F.array_except(F.transform(a, lambda s: s["hash"]), F.transform(b, lambda s: s["hash"]))
    return F.filter(a, lambda s: F.array_contains(own, s["hash"]))


def shared_leaves(a: Column, b: Column) -> Column:
    """How many leaves two trees share, repeats counted as often as both have them."""
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    side = lambda x, v: F.transform(x, lambda e: F.struct(e.alias("x"), F.lit(v).alias("v")))
    both = F.array_sort(F.concat(side(a, 1), side(b, -1)))
    # Within one value the entries of b come first: they are counted, and each entry of a takes one of them.
    start = F.struct(F.lit(None).cast("long").alias("x"), F.lit(0).alias("waiting"), F.lit(0).alias("shared"))
    def step(s: Column, e: Column) -> Column:
        waiting = F.when(s["x"] == e["x"], s["waiting"]).otherwise(0)
        takes = (e["v"] == 1) & (waiting > 0)
        return F.struct(e["x"].alias("x"), F.when(e["v"] == -1, waiting + 1).when(takes, waiting - 1).otherwise(waiting).alias("waiting"),
                        (s["shared"] + F.when(takes, 1).otherwise(0)).alias("shared"))
    return F.when(plain, F.size(F.array_intersect(a, b))).otherwise(F.aggregate(both, start, step, lambda s: s["shared"]))


def likeness(a: Column, b: Column) -> Column:
    """Share of the leaves that two trees have in common, 0 to 1."""
    return shared_leaves(a, b) / F.greatest(F.size(a), F.size(b), F.lit(1)).cast("double")


def next_keys(keys: DataFrame) -> DataFrame:
    """(doc_id, h, n) with the key that follows in ascending order (next_id, next_h); the last is followed by the first."""
    count = keys.count()
    ranges = keys.repartitionByRange(max(1, -(-count // KEYS)), F.asc_nulls_first("doc_id"), "h").withColumn("range", F.spark_partition_id())
    ranges = materialize(ranges, "keys")  # the numbers of the ranges are fixed from here on
    order = Window.partitionBy("range").orderBy(F.asc_nulls_first("doc_id"), "h")
    # One row for each range: its first key, and the first key of the range that follows.
    heads = ranges.groupBy("range").agg(F.min(F.struct("doc_id", "h")).alias("head"))
    heads = heads.withColumn("follows", F.coalesce(F.lead("head").over(Window.orderBy("range")), F.min(F.struct("range", "head")).over(Window.partitionBy())["head"]))
    t = ranges.withColumn("following", F.lead(F.struct("doc_id", "h")).over(order)).join(heads.select("range", "follows"), "range")
    t = t.withColumn("following", F.coalesce("following", "follows"))
    return t.select("doc_id", "h", "n", F.col("following.doc_id").alias("next_id"), F.col("following.h").alias("next_h"))


def edit_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, longest: int = LONGEST, section: int = SECTION) -> DataFrame:
    """One row per document: doc_id, n_chars, the tree of its text and of its edited text (``tree``, ``edited_tree``: sections), edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next, edits (the sections of the edited text that the text doesn't have).

    The edited text has its last ``n_chars div 4`` code points replaced by the first as many of the next document.
    """
    t = text_rows(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    keys = t.select("doc_id", "h", F.char_length("text").cast("long").alias("n")).distinct()
    following = next_keys(keys)
    # Each document as the one that follows another: the characters that the other needs, and its own leaves.
    d = t.join(following.select("next_id", "next_h", F.col("doc_id").alias("to_id"), F.col("h").alias("to_h"), F.expr("n div 4").alias("need")),
               t.doc_id.eqNullSafe(F.col("next_id")) & (t.h == F.col("next_h")))
    d = d.select("to_id", "to_h", F.expr("substring(text, 1, int(need))").alias("given"), leaves(F.col("text"), longest).alias("next_leaves"))
    d = d.groupBy("to_id", "to_h").agg(F.first("given").alias("given"), F.first("next_leaves").alias("next_leaves"))  # equal rows give the same
    r = t.join(d, t.doc_id.eqNullSafe(F.col("to_id")) & (t.h == F.col("to_h")))
    r = r.select("doc_id", "text", F.char_length("text").alias("n"), "given", "next_leaves")
    r = r.withColumn("edited", F.expr("concat(substring(text, 1, n - n div 4), given)"))
    r = r.select("doc_id", F.col("n").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), leaves(F.col("text"), longest).alias("a"),
                 leaves(F.col("edited"), longest).alias("b"), "next_leaves")
    r = r.withColumns({"tree": sections(F.col("a"), section), "edited_tree": sections(F.col("b"), section)})
    return r.select("doc_id", "n_chars", "tree", "edited_tree", "edited_sha256", fingerprint(F.col("tree")).alias("fingerprint"),
                    fingerprint(F.col("edited_tree")).alias("edited_fingerprint"), likeness(F.col("a"), F.col("b")).alias("near_edited"),
                    likeness(F.col("a"), F.col("next_leaves")).alias("near_next"), differing_sections(F.col("edited_tree"), F.col("tree")).alias("edits"))
