"""Exact duplicates by composable polynomial fingerprints and a chunkwise comparison of equal ones.

Two texts are equal when they are identical after lower-casing A-Z.  The fingerprint of bytes b_0..b_(n-1) is
``sum b_i * R^(n-1-i) mod p`` for two primes p.  It composes: the fingerprint of a concatenation is
``f(left) * R^len(right) + f(right)``, so the chunks of a huge document are hashed by different tasks, each result is
shifted by the length behind it, and the shifted terms are summed.

Equal fingerprints are not trusted.  The texts of such groups are cut into chunks and compared at each chunk number by
the smallest and the largest chunk, an aggregate that combines map-side: a group of any size or heat is compared as a
stream and never gathered.  Groups that turn out to be collisions are split by content.

Defined results: a null text counts as empty; empty texts are equal to each other; a null doc_id is the smallest id;
of rows that tie (same doc_id, equal text) exactly one is kept; an empty table gives no rows; columns other than
the id and the text are never read, so clashing names do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UPPER, free_name, materialize, slices, text_rows, utf8

PRIMES = (2147483647, 2147483629)
RADIX = (1000003, 998244353)
CHUNK = 1 << 16
AZ, az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def powers(radix: int, prime: int, n: int = CHUNK) -> np.ndarray:
    """R^(n-1), ..., R, 1 modulo the prime."""
    out = np.ones(n, np.uint64)
    for i in range(1, n):
        out[n - 1 - i] = int(out[n - i]) * radix % prime
    return out


class Fingerprinter:
    """Fingerprints of byte runs, chunk by chunk."""

    def __init__(self, primes: tuple[int, ...] = PRIMES):
        self.primes = primes
        self.tables = [powers(r, p) for r, p in zip(RADIX, primes, strict=True)]

    def run(self, values: np.ndarray) -> tuple[int, ...]:
        """Fingerprint of a run of bytes (as uint64), combining its chunks from left to right."""
        out = []
        for p, r, table in zip(self.primes, RADIX, self.tables, strict=True):
            h = 0
            for i in range(0, len(values), CHUNK):
                part = values[i:i + CHUNK]
                h = (h * pow(r, len(part), p) + int(part @ table[CHUNK - len(part):]) % p) % p
            out.append(h)
        return tuple(out)

    def shift(self, h: tuple[int, ...], behind: int) -> tuple[int, ...]:
        """The term of a run that has ``behind`` bytes after it."""
        return tuple(x * pow(r, behind, p) % p for x, r, p in zip(h, RADIX, self.primes, strict=True))


def _whole(primes: tuple[int, ...]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Fingerprinter(primes)
        for batch in batches:
            for part in slices(batch):
                data, offs = utf8(part.column(2))
                low = UPPER[data]
                wide = low.astype(np.uint64)
                h = [f.run(wide[a:b]) for a, b in zip(offs[:-1], offs[1:], strict=True)]
                sha = [hashlib.sha256(low[a:b]).hexdigest() for a, b in zip(offs[:-1], offs[1:], strict=True)]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(np.diff(offs)),
                                       pa.array([x[0] for x in h], pa.int64()), pa.array([x[1] for x in h], pa.int64()),
                                       pa.array(sha, pa.string())],
                                      names=["doc_id", "row_hash", "n_bytes", "h1", "h2", "text_sha256"])
    return rows


def _chunks(primes: tuple[int, ...]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Fingerprinter(primes)
        for batch in batches:
            data, offs = utf8(batch.column(batch.schema.get_field_index("chunk")))
            behind = batch.column(batch.schema.get_field_index("behind")).to_pylist()
            h = [f.shift(f.run(UPPER[data[a:b]].astype(np.uint64)), n)
                 for a, b, n in zip(offs[:-1], offs[1:], behind, strict=True)]
            keys = [batch.column(batch.schema.get_field_index(c)) for c in ("row", "doc_id", "row_hash", "n_bytes", "text_sha256")]
            yield pa.record_batch([*keys, pa.array([x[0] for x in h], pa.int64()), pa.array([x[1] for x in h], pa.int64())],
                                  names=["row", "doc_id", "row_hash", "n_bytes", "text_sha256", "h1", "h2"])
    return rows


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, huge_bytes: int = 8 << 20,
                 primes: tuple[int, ...] = PRIMES) -> DataFrame:
    """One row per row: doc_id, row_hash, n_bytes, h1, h2, text_sha256.

    Documents above ``huge_bytes`` are cut into chunks of that size that other tasks hash in parallel.
    """
    t = text_rows(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    t = t.select("doc_id", F.xxhash64("text").alias("row_hash"), "text")
    id_type = t.schema["doc_id"].dataType.simpleString()
    n = F.octet_length("text")
    small = t.where(n <= huge_bytes).mapInArrow(
        _whole(primes), f"doc_id {id_type}, row_hash bigint, n_bytes bigint, h1 bigint, h2 bigint, text_sha256 string")
    big = (t.where(n > huge_bytes)
           .select(F.monotonically_increasing_id().alias("row"), "doc_id", "row_hash", n.cast("bigint").alias("n_bytes"),
                   F.sha2(F.translate("text", AZ, az), 256).alias("text_sha256"), F.col("text").cast("binary").alias("raw"))
           .withColumn("part", F.explode(F.sequence(F.lit(0), ((F.col("n_bytes") - 1) / huge_bytes).cast("int"))))
           .select("row", "doc_id", "row_hash", "n_bytes", "text_sha256",
                   F.substring("raw", F.col("part") * huge_bytes + 1, F.lit(huge_bytes)).alias("chunk"),
                   F.greatest(F.col("n_bytes") - (F.col("part") + 1) * F.lit(huge_bytes).cast("bigint"), F.lit(0)).alias("behind"))
           .repartition("row", "behind")
           .mapInArrow(_chunks(primes), f"row bigint, doc_id {id_type}, row_hash bigint, n_bytes bigint, text_sha256 string, h1 bigint, h2 bigint")
           .groupBy("row", "doc_id", "row_hash", "n_bytes", "text_sha256")
           .agg((F.sum("h1") % primes[0]).alias("h1"), (F.sum("h2") % primes[1]).alias("h2"))
           .select(*small.columns))
    return small.unionByName(big)


def _collisions(docs: DataFrame, members: DataFrame, chunk: int) -> DataFrame:
    """The fingerprints (n_bytes, h1, h2) whose texts differ in some chunk.  docs: doc_id, row_hash, text."""
    m = members.withColumnRenamed("doc_id", "m_id").withColumnRenamed("row_hash", "m_hash")
    t = (docs.join(m, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("row_hash") == F.col("m_hash")))
         .select("n_bytes", "h1", "h2", F.translate("text", AZ, az).cast("binary").alias("raw")))
    c = (t.withColumn("part", F.explode(F.sequence(F.lit(0), ((F.greatest(F.col("n_bytes"), F.lit(1)) - 1) / chunk).cast("int"))))
         .select("n_bytes", "h1", "h2", "part", F.substring("raw", F.col("part") * chunk + 1, F.lit(chunk)).alias("c")))
    return (c.groupBy("n_bytes", "h1", "h2", "part").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
            .where("lo <> hi").select("n_bytes", "h1", "h2").distinct())


def _classified(docs: DataFrame, id_col: str, text_col: str, huge_bytes: int, primes: tuple[int, ...],
                compare_bytes: int) -> DataFrame:
    fp = fingerprints(docs, id_col, text_col, huge_bytes=huge_bytes, primes=primes)
    fp = materialize(fp.withColumn("uid", F.monotonically_increasing_id()), "fingerprints")  # the numbers are stored: no other split of files changes them
    key = ["n_bytes", "h1", "h2"]
    multi = fp.groupBy(*key).count().where("count > 1").select(*key)
    members = fp.join(multi, key, "left_semi").select(*key, "doc_id", "row_hash").distinct()
    texts = text_rows(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bad = materialize(_collisions(texts.select("doc_id", F.xxhash64("text").alias("row_hash"), "text"), members, compare_bytes), "collisions")
    fp = (fp.join(bad.withColumn("bad", F.lit(True)), key, "left")
          .withColumn("variant", F.when(F.col("bad"), F.col("text_sha256")).otherwise(F.lit(""))).drop("bad"))
    key.append("variant")
    groups = fp.groupBy(*key).agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "uid")).alias("top"))
    return (fp.join(groups, key)
            .withColumn("kept", F.col("uid") == F.col("top.uid")).withColumn("keep_id", F.col("top.doc_id")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, huge_bytes: int = 8 << 20,
                primes: tuple[int, ...] = PRIMES, compare_bytes: int = CHUNK) -> DataFrame:
    """One row per input row: doc_id, keep_id (largest doc_id of the equal texts), group_size, kept, text_sha256,
    n_bytes and the fingerprint (h1, h2)."""
    return _classified(docs, id_col, text_col, huge_bytes, primes, compare_bytes).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256", "n_bytes", "h1", "h2")


def keep_rows(docs: DataFrame, rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` for which ``rows`` (one for each row of ``docs``: doc_id, row_hash, kept) says kept.

    Rows that tie in id and text are told apart by nothing, so of those as many stay as are kept: one.
    """
    again = rows.groupBy("doc_id", "row_hash").count().where("count > 1").select(
        F.col("doc_id").alias("a_id"), F.col("row_hash").alias("a_hash"))
    k_id, k_hash, k_again = (free_name(docs, n) for n in ("kept_id", "kept_hash", "kept_again"))
    k = rows.where("kept").select(F.col("doc_id").alias(k_id), F.col("row_hash").alias(k_hash))
    k = (k.join(again, F.col(k_id).eqNullSafe(F.col("a_id")) & (F.col(k_hash) == F.col("a_hash")), "left")
         .select(k_id, k_hash, F.col("a_hash").isNotNull().alias(k_again)))
    k = materialize(k, "kept")
    j = docs.join(k, docs[id_col].eqNullSafe(k[k_id]) & (F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))) == k[k_hash]))
    one = j.where(F.col(k_again)).dropDuplicates([k_id, k_hash]).select(*docs.columns)
    return j.where(~F.col(k_again)).select(*docs.columns).unionByName(one)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, huge_bytes: int = 8 << 20,
                primes: tuple[int, ...] = PRIMES, compare_bytes: int = CHUNK) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of equal texts, with all their columns."""
    rows = _classified(docs, id_col, text_col, huge_bytes, primes, compare_bytes)
    return keep_rows(docs, rows.select("doc_id", "row_hash", "kept"), id_col, text_col)
