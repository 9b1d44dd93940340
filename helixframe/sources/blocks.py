"""Block-compressed text (gzip files made of independent blocks), read and written by many tasks.

Such a file is a series of gzip members of at most 64 kB of text each; a field in a member's header tells its
length, so a reader can start at any member.  Any gzip reader can read the file as a whole.  A task gets a range of bytes,
finds the first member that begins in it, and reads the lines that begin in its members:
a line belongs to the range that holds the line feed before it (the first range also has the first line), and a task
reads on past its range to the end of its last line.  No index has to be built or read beforehand.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

# Fixed values of the format: the start of a member's header, its extra field, and the empty member at the end of a file.
MAGIC = b"\x1f\x8b\x08\x04"
EXTRA = b"\x06\x00BC\x02\x00"
HEADER = 18
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BLOCK = 0xFF00  # bytes of text in a member
RANGE = 64 << 20  # bytes of a file that a task reads
BATCH = 4 << 20  # bytes of lines in an Arrow batch


def _open(uri: str):
    u = urlparse(uri)
    if u.scheme in ("", "file"):
        return open(u.path or uri, "rb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def is_member(head: bytes) -> bool:
    """Whether these bytes are the header of a member that tells its length."""
    return head[:4] == MAGIC and head[10:16] == EXTRA


def find_member(data: bytes, at: int = 0) -> int:
    """Where the first member from ``at`` on begins, -1 if none does."""
    while (at := data.find(MAGIC, at)) >= 0:
        if is_member(data[at:at + HEADER]):
            return at
        at += 1
    return -1


def members(f, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """The members that begin in [start, end) and all that follow: (begin, text)."""
    at = start
    if start:
        window = 1 << 17  # a member has at most 64 kB, so one begins in the next 128 kB
        f.seek(start)
        i = find_member(f.read(window))
        if i < 0 or start + i >= end:
            return
        at = start + i
    while True:
        f.seek(at)
        head = f.read(HEADER)
        if len(head) < HEADER:
            return
        if not is_member(head):
            raise ValueError(f"no block begins at byte {at}")
        size = struct.unpack("<H", head[16:18])[0] + 1
        body = f.read(size - HEADER)
        yield at, zlib.decompress(body[:-8], -15)
        at += size


def lines(f, start: int, end: int) -> Iterator[bytes]:
    """Whole lines, with their line feeds, of the range [start, end) in pieces of many lines."""
    held, begun = b"", start == 0
    for at, text in members(f, start, end):
        if at >= end:
            if not begun:
                return
            # The last line ends in a later member, or at the end of the file.
            if (i := text.find(b"\n")) >= 0:
                yield held + text[:i + 1]
                return
            held += text
            continue
        if not begun:
            if (i := text.find(b"\n")) < 0:
                continue
            begun, text = True, text[i + 1:]
        held += text
        if (i := held.rfind(b"\n")) >= 0 and len(held) >= BATCH:
            yield held[:i + 1]
            held = held[i + 1:]
    if held:
        yield held


def _read_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, start, end in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            n = 0
            with _open(file) as f:
                for piece in lines(f, start, end):
                    rows = piece.decode().split("\n")
                    if rows[-1] == "":
                        rows.pop()
                    rows = [r.removesuffix("\r") for r in rows]
                    yield pa.record_batch([pa.array(rows, pa.string()), pa.array([file] * len(rows), pa.string()), pa.array([start] * len(rows), pa.int64()),
                                           pa.array(range(n, n + len(rows)), pa.int64())], names=["value", "_file", "_blk", "_mid"])
                    n += len(rows)


def block_files(spark: SparkSession, path: str) -> list[tuple[str, int]] | None:
    """The files at ``path`` with their lengths, if all are made of blocks and tasks can open them; else None."""
    from .sinks import _fs_files

    found = [(f, n) for f, n, _ in _fs_files(spark, path) if n and not os.path.basename(f).startswith(("_", "."))]
    if not found or not all(f.endswith(".gz") for f, _ in found):
        return None
    jvm = spark.sparkContext._jvm
    for f, _ in found:
        p = jvm.org.apache.hadoop.fs.Path(f)
        stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
        try:
            head = bytes(max(0, stream.read()) for _ in range(HEADER))
        finally:
            stream.close()
        if not is_member(head):
            return None
        if urlparse(f).scheme not in ("", "file"):
            from pyarrow import fs

            try:
                fs.FileSystem.from_uri(f)
            except (pa.ArrowException, OSError, Py4JError):
                return None
    return found


def read_blocks(spark: SparkSession, found: list[tuple[str, int]], range_bytes: int = RANGE) -> DataFrame:
    """Lines of block-compressed files: value, _file, _blk (the range's first byte), _mid (line in the range)."""
    ranges = [(f, a, min(a + range_bytes, n)) for f, n in found for a in range(0, n, range_bytes)]
    d = spark.createDataFrame(ranges, "file string, start long, end long")
    return d.repartition(len(ranges), "file", "start").mapInArrow(_read_range, "value string, _file string, _blk bigint, _mid bigint")


def _write_file(folder: str, suffix: str):
    def member(text: bytes) -> bytes:
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(text) + z.flush()
        head = MAGIC + b"\0\0\0\0\0\xff" + EXTRA + struct.pack("<H", HEADER + len(body) + 8 - 1)
        return head + body + struct.pack("<II", zlib.crc32(text), len(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"part-{TaskContext.get().partitionId():05d}{suffix}"
        part, n, held = f"{folder}/.{name}.{uuid.uuid4().hex}", 0, b""
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(part) if "://" in part or part.startswith("file:") else (fs.LocalFileSystem(), part)
        store.create_dir(os.path.dirname(path), recursive=True)
        with store.open_output_stream(path, compression=None) as out:
            for batch in batches:
                rows = batch.column(0).to_pylist()
                n += len(rows)
                held += "".join(f"{r or ''}\n" for r in rows).encode()
                while len(held) >= BLOCK:
                    out.write(member(held[:BLOCK]))
                    held = held[BLOCK:]
            if held:
                out.write(member(held))
            out.write(END)
        # A complete file gets its name at once, so a task that runs again or twice does no harm.
        store.move(path, f"{os.path.dirname(path)}/{name}")
        yield pa.record_batch([pa.array([name]), pa.array([n], pa.int64())], names=["file", "n"])
    return run


def write_blocks(text: DataFrame, path: str, suffix: str = ".fa.gz") -> None:
    """Write the column ``value`` as block-compressed text, one file for each partition, its rows in order."""
    text.select("value").mapInArrow(_write_file(path.rstrip("/"), suffix), "file string, n bigint").write.format("noop").mode("overwrite").save()
