"""Token counts of flat token files that have no index, by a scan for the end-of-document id.

Files are cut into blocks of equal size, whatever documents they hold.  Each block is scanned at once (a vectorised
search for the separator) and gives the positions of its separators.  A document may span any number of blocks: where the
last separator before a block stands, and how many there are, comes from a prefix scan over the blocks of the file (a
running maximum and a running sum), so no task reads more than its block.

Defined results: a file without ids has no documents; ids after the last separator are one more document that is marked
as not ended; consecutive separators enclose a document of no tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_file, materialize

BLOCK_IDS = 1 << 20


def _scan(folder: str, dtype: str, separator: int):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, block, lo, hi in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                flat = map_file(f"{folder}/{name}.bin", dtype)
                hi = min(hi, len(flat))
                at = np.flatnonzero(flat[lo:hi] == separator) + lo
                yield pa.record_batch([pa.array([name]), pa.array([block], pa.int64()), pa.array([hi], pa.int64()),
                                       pa.array([len(flat)], pa.int64()), pa.array([at.tolist()], pa.list_(pa.int64()))],
                                      names=["shard", "block", "hi", "file_ids", "ends"])
    return blocks


def token_counts(files: DataFrame, folder: str, separator: int, *, dtype: str = "<u2", block_ids: int = BLOCK_IDS) -> DataFrame:
    """One row per document: shard, doc_no (0-based in the file), start, n_tokens (without the separator), ended.

    ``files``: shard (the file is ``folder/shard.bin``) and n_tokens, its length in ids.
    """
    b = (files.where("n_tokens > 0")
         .select("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n_tokens - 1) div {block_ids}"))).alias("block"))
         .select("shard", "block", (F.col("block") * block_ids).alias("lo"), ((F.col("block") + 1) * block_ids).alias("hi"))
         .repartition("shard", "block"))
    s = materialize(b.mapInArrow(_scan(folder, dtype, separator), "shard string, block bigint, hi bigint, file_ids bigint, ends array<bigint>"), "separators")
    # The prefix scan sees one narrow row for each block; the positions stay where they are and join it.
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scan = s.select("shard", "block", F.size("ends").cast("bigint").alias("n"),
                    F.when(F.size("ends") > 0, F.element_at("ends", -1)).alias("last"))
    scan = scan.select("shard", "block", F.coalesce(F.max("last").over(before), F.lit(-1)).alias("carry"),
                       F.coalesce(F.sum("n").over(before), F.lit(0)).alias("doc_base"))
    j = s.join(scan, ["shard", "block"])
    # Each separator ends a document that begins after the one before it; the first one of a block begins at the carry.
    prev = F.concat(F.array("carry"), F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0))))
    ended = (j.where(F.size("ends") > 0)
             .select("shard", "doc_base", F.posexplode(F.arrays_zip(F.col("ends").alias("e"), prev.alias("p"))).alias("i", "d"))
             .select("shard", (F.col("doc_base") + F.col("i")).alias("doc_no"), (F.col("d.p") + 1).alias("start"),
                     (F.col("d.e") - F.col("d.p") - 1).alias("n_tokens"), F.lit(True).alias("ended")))
    tail = (j.where("hi = file_ids")
            .select("shard", (F.col("doc_base") + F.size("ends")).alias("doc_no"),
                    (F.when(F.size("ends") > 0, F.element_at("ends", -1)).otherwise(F.col("carry")) + 1).alias("start"), "file_ids")
            .where("start < file_ids")
            .select("shard", "doc_no", "start", (F.col("file_ids") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended")))
    return ended.unionByName(tail)
