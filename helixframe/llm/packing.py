"""Packing by powers of two: each document is split into pieces of binary length, equal lengths share a bucket.

A document of n ids becomes ``n // max_len`` pieces of ``max_len`` ids and then one piece for each set bit of the rest,
longest first (``write_buckets`` keeps buckets apart in the files).  Every piece is a sequence of its own, so no sequence crosses documents, none is padded, and a
batch takes sequences of one bucket (``max_len / length`` of them hold as many ids as one of the longest).  Nothing has to be
placed across documents: the work is one pass without a shuffle, whatever the size or the skew.

Defined results: a null or empty text is the end id alone (one piece of length 1); rows that repeat a doc_id are each
packed; a null doc_id stays null; an empty table has no pieces; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, text_rows
from .tokens import encoder, with_end


def binary_pieces(sizes: np.ndarray, max_len: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each piece of documents of these sizes: the document's index, the start in it, the length."""
    full, rest = sizes // max_len, sizes % max_len
    docs = [np.repeat(np.arange(len(sizes)), full)]
    first = np.cumsum(full) - full
    starts = [(np.arange(full.sum()) - np.repeat(first, full)) * max_len]
    lengths = [np.full(full.sum(), max_len)]
    done = full * max_len
    bit = max_len >> 1
    while bit:
        d = np.flatnonzero(rest & bit)
        docs.append(d)
        starts.append(done[d])
        lengths.append(np.full(len(d), bit))
        done = done + (rest & bit)
        bit >>= 1
    docs, starts, lengths = map(np.concatenate, (docs, starts, lengths))
    order = np.lexsort((starts, docs))
    return docs[order], starts[order], lengths[order]


def _pack(path: str, end_id: int, max_len: int, plain: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Numbers of sequences: the partition in the upper bits, a running number in the lower 38.
        number = TaskContext.get().partitionId() << 38
        for batch in batches:
            for part in slices(batch, limit=1 << 20):
                tokens, offs = with_end(*encoder(path, plain).encode(part.column(1)), end_id)
                sizes = np.diff(offs)
                d, start, length = binary_pieces(sizes, max_len)
                ends = np.cumsum(length)  # pieces are in the order of the ids
                at = np.append(0, ends) * 4
                ids = pa.Array.from_buffers(pa.large_binary(), len(d), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(tokens.tobytes())])
                n = len(d)
                yield pa.record_batch(
                    [part.column(0).take(pa.array(d)), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(sizes[d], pa.int64()),
                     pa.array(number + np.arange(n)), pa.array(np.zeros(n, np.int64)), pa.array(length, pa.int64()), ids.cast(pa.binary())],
                    names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "bucket", "ids"])
                number += n
    return rows


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", *, end_id: int = 0,
         max_len: int = 1024, plain_specials: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, bucket (the length of the sequence),
    ids (little-endian unsigned 32-bit, binary).  ``max_len`` must be a power of two."""
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    t = text_rows(docs, id_col, text_col)
    kind = t.schema["doc_id"].dataType.simpleString()
    return t.mapInArrow(_pack(tokenizer_path, end_id, max_len, plain_specials),
                        f"doc_id {kind}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, bucket bigint, ids binary")


def write_buckets(pieces: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write pieces in folders by bucket, so that a reader who wants sequences of one length opens only those.

    Each task writes the files of its own pieces: nothing is shuffled, and the bucket of the longest pieces, with
    most of the ids, lies in as many files as there are tasks.
    """
    pieces.write.mode(mode).partitionBy("bucket").parquet(path)


def read_bucket(spark: SparkSession, path: str, length: int) -> DataFrame:
    """The sequences of one length; the folders of other buckets are not read.  A length without sequences gives no rows."""
    return spark.read.parquet(path).where(F.col("bucket") == length)
