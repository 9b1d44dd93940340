"""Helpers shared by the training-data operators: shared scratch tables, byte views of Arrow text, words.

Workers see text as one byte array with document offsets, so that the operators use vectorised numpy on
bounded slices (``slices``) and never hold more than one slice of a partition.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20
LONG_WORD = 64
UPPER = np.arange(256, dtype=np.uint8)
UPPER[65:91] += 32  # A-Z to a-z, all other bytes unchanged
ALNUM = np.zeros(256, bool)  # words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
NONSPACE = np.ones(256, bool)  # words [^\x20\x09-\x0D]+
NONSPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder path below the folder in ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session (``local[...]``) may leave the setting unset; it then gets a scratch folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="llm-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: lineage ends here, and rows are fixed."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_path(uri: str) -> str | None:
    """The file path of a URI on a mounted file system, None for other stores."""
    u = urlparse(uri)
    return u.path if u.scheme in ("", "file") else None


class NewFile:
    """A file that gets its name when it is complete, so that a retried or doubled task is harmless."""

    def __init__(self, uri: str):
        part = f"{uri}.{uuid.uuid4().hex}.tmp"
        self.path, self.part, self.store = local_path(uri), local_path(part), None
        if self.path is not None:
            os.makedirs(os.path.dirname(self.path), exist_ok=True)
            self.out = open(self.part, "wb")
            return
        from pyarrow import fs

        self.store, self.path = fs.FileSystem.from_uri(uri)
        self.part = fs.FileSystem.from_uri(part)[1]
        self.store.create_dir(os.path.dirname(self.path), recursive=True)
        self.out = self.store.open_output_stream(self.part)

    def __enter__(self):
        return self.out

    def __exit__(self, kind, error, trace):
        self.out.close()
        if kind is None:
            (self.store.move if self.store else os.replace)(self.part, self.path)
        else:
            (self.store.delete_file if self.store else os.remove)(self.part)


def write_file(uri: str, data: bytes | memoryview) -> None:
    """Write a whole file at once."""
    with NewFile(uri) as f:
        f.write(data)


def map_file(uri: str, dtype: str) -> np.ndarray:
    """Memory-map a flat file; one in another store is first copied to the task's own scratch folder."""
    p = local_path(uri)
    if p is None:
        from pyarrow import fs

        store, q = fs.FileSystem.from_uri(uri)
        p = os.path.join(tempfile.mkdtemp(prefix="map-"), os.path.basename(q))
        with store.open_input_stream(q) as src, open(p, "wb") as dst:
            while chunk := src.read(1 << 24):
                dst.write(chunk)
    return np.memmap(p, dtype=dtype, mode="r") if os.path.getsize(p) else np.zeros(0, dtype)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n; 0 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0))


def sample_key(doc_id: Column, text: Column) -> Column:
    """A uniform 63-bit number of a row's id and text."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("sample"), doc_id.cast("string"), text), 1)


def training_sample(rows: DataFrame, texts: DataFrame, label: str, per_label: int, max_bytes: int) -> tuple[list[tuple], dict]:
    """A bounded sample of whole labelled texts, and how many rows each label has in all.

    ``rows``: h (``sample_key``), bytes (of the text) and the column ``label``, without nulls; ``texts``: h and text.  Of each label that
    occurs, the rows with the smallest keys, up to ``per_label`` of them and until their texts reach ``max_bytes`` (one at least);
    equal rows count once.  The sample, a list of (text, label), is sorted by label and key: it is the same for any order and
    partitioning of the rows.  Labels are ranked among about twice as many rows as are wanted, chosen by their keys, so no
    label is ranked as a whole.  The driver receives the keys, one row for each label, and then the sample's texts, which the
    keys fetch by a broadcast of that size; texts are never shuffled.
    """
    spark = rows.sparkSession
    t = rows.select(label, "h", F.col("bytes").cast("bigint").alias("bytes"))
    counts = {r[label]: r["count"] for r in t.groupBy(label).count().collect()}
    if not counts:
        return [], {}
    some = 2 * per_label + 50
    limits = {k: some * (1 << 63) // n if n > some else (1 << 63) - 1 for k, n in counts.items()}
    ends = F.create_map(*[F.lit(x) for pair in sorted(limits.items()) for x in pair])
    order = Window.partitionBy(label).orderBy("h")
    near = t.where(F.col("h") <= ends[F.col(label)]).distinct().withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_label)
    before = F.coalesce(F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    keys = sorted((r[label], r["h"]) for r in near.withColumn("before", before).where(F.col("before") < max_bytes).select(label, "h").collect())
    wanted = spark.createDataFrame([(h,) for h in sorted({h for _, h in keys})], "key bigint")
    got = texts.join(F.broadcast(wanted), F.col("h") == F.col("key")).dropDuplicates(["h"]).select("h", "text").collect()
    text = {r["h"]: r["text"] for r in got}
    return [(text[h], k) for k, h in keys], counts


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that an operator reads, under fixed names; other columns can't clash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of at most ``rows`` rows with about ``limit`` bytes of text (one row at least)."""
    _, offs = utf8(batch.column(batch.schema.get_field_index(column)))
    i, n = 0, batch.num_rows
    while i < n:
        j = min(i + rows, max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1))
        yield batch.slice(i, j - i)
        i = j


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column (null: empty) and the offsets of its rows in them."""
    arr = arr.cast(pa.large_binary())
    if arr.null_count:
        arr = arr.fill_null(b"")
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset:arr.offset + len(arr) + 1]
    data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0]:offs[-1]], offs - offs[0]


class Words(NamedTuple):
    """Words of a run of documents: each word's index in the vocabulary (binary), each document's first word (and one
    entry at the end), and where the words begin and end in the bytes."""

    index: np.ndarray
    vocabulary: pa.Array
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def words(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> Words:
    """Words of all documents, A-Z lower-cased; a word is a maximal run of ``is_word`` bytes in one document."""
    keep = is_word[data]
    starts, ends = keep.copy(), keep.copy()
    inner = offs[1:-1][(offs[1:-1] > 0) & (offs[1:-1] < len(data))]
    if len(data):
        starts[1:] &= ~keep[:-1]
        starts[inner] = keep[inner]
        ends[:-1] &= ~keep[1:]
        ends[inner - 1] = keep[inner - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends)
    bounds = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts + 1, out=bounds[1:])
    flat = UPPER[data[keep]]
    arr = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(flat)])
    enc = arr.dictionary_encode()
    index = enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return Words(index, enc.dictionary, np.searchsorted(starts, offs), starts, ends + 1)


def word_hashes(vocabulary: pa.Array) -> np.ndarray:
    """64-bit hash of each word of a vocabulary."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocabulary.to_pylist()), np.uint64, len(vocabulary))


def word_keys(vocabulary: pa.Array) -> np.ndarray:
    """64-bit keys of the words of a vocabulary, eight bytes of all words at a time; a word of more than ``LONG_WORD`` bytes by its
    own hash.  Words of one length up to eight bytes never share a key."""
    data, offs = utf8(vocabulary)
    size = np.diff(offs)
    lanes = np.ndarray(len(data) + 1, "<u8", np.append(data, np.zeros(8, np.uint8)), strides=(1,))  # the eight bytes from each on
    with np.errstate(over="ignore"):
        out = mix(size.astype(np.uint64))
        for i in range(0, min(LONG_WORD, int(size.max(initial=0))), 8):
            own = np.flatnonzero(size > i) if i else slice(None)
            beyond = np.maximum(8 - (size[own] - i), 0).astype(np.uint64) * np.uint64(8)  # bits of the lane behind the word
            lane = (lanes[offs[:-1][own] + i] << (beyond & np.uint64(63))) * (beyond < 64)
            out[own] = mix(out[own] ^ lane)
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = xxhash.xxh3_64_intdigest(data[offs[i]:offs[i + 1]].tobytes())
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: equal only for equal input, spread over all bits."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(33)
    return x
