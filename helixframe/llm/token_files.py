"""Token-id files: flat unsigned integers with 64-bit document offsets, memory-mapped to read.

A data set is a folder of shards.  Shard ``s`` has ``s.bin`` (the ids of its documents one after another, little-endian
unsigned 16 or 32 bit), ``s.idx`` (little-endian 64-bit offsets, one per document and one at the end, in ids, from the
shard's begin) and ``s.doc`` (the document ids as an Arrow file).  Documents are in ascending doc_id order over all shards.
The first id of a shard within the whole data set is the prefix sum of the shards' sizes; only one row for each
shard takes part in it.

Defined results: a null text is empty (its document is the end id alone); a null doc_id comes first; rows that repeat
a doc_id each have an entry, ordered by a hash of the text; an empty table gives a data set without documents; other
columns are not read.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, NewFile, map_file, materialize, shared_dir, slices, text_rows
from .tokens import encoder, vocabulary_size, with_end

MANIFEST = "shard string, n_docs bigint, n_tokens bigint"


def ordered(docs: DataFrame, id_col: str, text_col: str, shard_bytes: int) -> DataFrame:
    """doc_id and text in ascending order over partitions of about ``shard_bytes`` bytes of text."""
    t = text_rows(docs, id_col, text_col)
    size = t.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    h = F.xxhash64("text")
    return (t.repartitionByRange(max(1, -(-size // shard_bytes)), F.col("doc_id").asc_nulls_first(), h)
            .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), h))


def _write(folder: str, path: str, dtype: str, end_id: int, plain: bool):
    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{TaskContext.get().partitionId():08d}"
        parts = (part for batch in batches for part in slices(batch))
        if (head := next(parts, None)) is None:
            return
        schema = pa.schema([("doc_id", head.schema.field(0).type)])
        n, total = 0, 0
        # Ids, offsets and names go to the files slice by slice: the task holds one slice.
        with (NewFile(f"{folder}/{name}.bin") as ids, NewFile(f"{folder}/{name}.idx") as index, NewFile(f"{folder}/{name}.doc") as names,
              pa.ipc.new_file(names, schema) as table):
            index.write(np.zeros(1, "<i8").tobytes())
            for part in itertools.chain([head], parts):
                tokens, offs = with_end(*encoder(path, plain).encode(part.column(1)), end_id)
                ids.write(tokens.astype(dtype).tobytes())
                index.write((offs[1:] + total).astype("<i8").tobytes())
                table.write_batch(pa.record_batch([part.column(0)], schema=schema))
                n, total = n + part.num_rows, total + len(tokens)
        yield pa.record_batch([pa.array([name]), pa.array([n], pa.int64()), pa.array([total], pa.int64())], names=["shard", "n_docs", "n_tokens"])
    return shard


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", *,
                      dtype: str = "<u2", shard_bytes: int = 16 << 20, plain_specials: bool = False, in_order: bool = True,
                      folder: str | None = None) -> tuple[str, DataFrame]:
    """Write the data set; returns its folder and the manifest (shard, n_docs, n_tokens, base).

    A shard is written by one task from about ``shard_bytes`` bytes of text; with ``in_order`` off, documents stay in the
    partitions and the order in which they come, and nothing is shuffled.  Files get their names when complete, so a
    task may run again or twice.  ``dtype`` is ``<u2`` (vocabularies of up to 65,536 ids) or ``<u4``; ids that it can't hold raise
    before the job starts.
    """
    largest = max(vocabulary_size(tokenizer_path) - 1, end_id)
    if largest > np.iinfo(dtype).max or end_id < 0:
        raise ValueError(f"ids up to {largest} don't fit {dtype}")
    folder = folder or shared_dir(docs.sparkSession, "tokens")
    t = ordered(docs, id_col, text_col, shard_bytes) if in_order else text_rows(docs, id_col, text_col)
    rows = t.mapInArrow(
        _write(folder, tokenizer_path, dtype, end_id, plain_specials), MANIFEST)
    m = materialize(rows, "manifest")
    # One row for each shard: the prefix sum over them is the only step in one task.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return folder, m.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _read(folder: str, dtype: str):
    def docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                flat, offs = map_file(f"{folder}/{name}.bin", dtype), map_file(f"{folder}/{name}.idx", "<i8")
                ids = pa.ipc.open_file(pa.py_buffer(map_file(f"{folder}/{name}.doc", "u1"))).read_all().column(0).combine_chunks()
                step = 0
                while step < len(ids):  # about SLICE_BYTES of ids at a time
                    to = max(step + 1, int(np.searchsorted(offs, offs[step] + SLICE_BYTES // 4, side="right")) - 1)
                    to = min(to, len(ids))
                    at = offs[step:to + 1]
                    body = flat[at[0]:at[-1]].astype("<u4").tobytes()
                    cells = pa.Array.from_buffers(pa.large_binary(), to - step, [None, pa.py_buffer(((at - at[0]) * 4).astype(np.int64)), pa.py_buffer(body)])
                    yield pa.record_batch([ids.slice(step, to - step), pa.array(base + at[:-1]), pa.array(np.diff(at)), cells.cast(pa.binary())],
                                          names=["doc_id", "start", "n_tokens", "ids"])
                    step = to
    return docs


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame, dtype: str = "<u2", id_type: str = "bigint") -> DataFrame:
    """The documents of a data set: doc_id, start (ids before it in the whole set), n_tokens, ids (little-endian
    unsigned 32-bit, binary).  One task maps the files of a shard."""
    shards = manifest.select("shard", "base")
    n = max(1, manifest.count())
    return shards.repartitionByRange(n, "shard").mapInArrow(
        _read(folder, dtype), f"doc_id {id_type}, start bigint, n_tokens bigint, ids binary")


def crc32_of(ids: str = "ids"):
    """Unsigned crc32 of a binary column of ids."""
    return F.crc32(F.col(ids))


def crc32_bytes(ids: np.ndarray) -> int:
    """The same for an array."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


def _names(folder: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                ids = pa.ipc.open_file(pa.py_buffer(map_file(f"{folder}/{name}.doc", "u1"))).read_all().column(0).combine_chunks()
                for i in range(0, len(ids), 1 << 16):
                    part = ids.slice(i, 1 << 16)
                    yield pa.record_batch([pa.array([name] * len(part)), pa.array(np.arange(i, i + len(part))), part],
                                          names=["shard", "doc_no", "doc_id"])
    return rows


def document_names(spark: SparkSession, folder: str, manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """The document ids of a data set in file order: shard, doc_no (0-based in the shard), doc_id."""
    return (manifest.select("shard").repartitionByRange(max(1, manifest.count()), "shard")
            .mapInArrow(_names(folder), f"shard string, doc_no bigint, doc_id {id_type}"))
