"""Block-compressed text: ranges of a file give each line once, in order."""

import gzip
import io
import random

import pytest
from pyspark.sql import functions as F

from helixframe.sources import blocks, files


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    """A file of small blocks, with lines that cross many of them, empty lines, carriage returns and no line feed at the end of a block."""
    r = random.Random(6)
    rows = ["".join(r.choice("ACGT\x1f\x8b") for _ in range(r.choice([0, 3, 60, 61, 5000]))) for _ in range(300)] + ["x" * 40_000, "last"]
    path = str(tmp_path_factory.mktemp("blocks"))
    old, blocks.BLOCK = blocks.BLOCK, 1500
    try:
        run = blocks._write_file(path, ".txt.gz")
        import pyarrow as pa
        blocks.TaskContext.get, get = staticmethod(lambda: type("T", (), {"partitionId": lambda self: 0})()), blocks.TaskContext.get
        list(run([pa.record_batch([pa.array(rows)], names=["value"])]))
        blocks.TaskContext.get = get
    finally:
        blocks.BLOCK = old
    with open(f"{path}/part-00000.txt.gz", "rb") as f:
        return rows, f.read()


def test_any_reader_reads_the_file(written):
    rows, data = written
    assert gzip.decompress(data).decode() == "".join(r + "\n" for r in rows)


@pytest.mark.parametrize("size", [1, 97, 700, 2000, 9999, 1 << 30])
def test_ranges_have_each_line_once(written, size):
    rows, data = written
    got = [b"".join(blocks.lines(io.BytesIO(data), a, min(a + size, len(data)))) for a in range(0, len(data), size)] if size > 1 else \
          [b"".join(blocks.lines(io.BytesIO(data), a, a + 1)) for a in [0, *[i for i in range(1, len(data)) if data[i:i + 4] == blocks.MAGIC]]]
    assert b"".join(got).decode() == "".join(r + "\n" for r in rows)


def test_members_are_told_from_their_likes(written):
    _, data = written
    assert blocks.find_member(b"\x1f\x8b\x08\x04 no header here" + data[:100]) == 19
    assert blocks.find_member(b"nothing") == -1
    with pytest.raises(ValueError, match="no block begins"):
        list(blocks.members(io.BytesIO(data[:blocks.find_member(data, 1)] + b"junk" * 20), 0, 4000))


def test_fasta_of_blocks_is_read_by_many_tasks(spark, tmp_path, monkeypatch):
    """As the plain file gives it, from more than one task; a plain gzip file is still read."""
    r = random.Random(1)
    text = "".join(f">c{k} note\n" + "".join("".join(r.choice("ACGTN") for _ in range(60)) + "\n" for _ in range(400 + 90 * k)) for k in range(5))
    (tmp_path / "plain.fa").write_text(text)
    with gzip.open(tmp_path / "plain.fa.gz", "wt") as f:
        f.write(text)
    monkeypatch.setattr(blocks, "BLOCK", 3000)
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(text.splitlines())], "i long, value string").coalesce(1).sortWithinPartitions("i")
    blocks.write_blocks(rows, str(tmp_path / "made"))
    found = blocks.block_files(spark, str(tmp_path / "made"))
    assert len(found) == 1 and blocks.block_files(spark, str(tmp_path / "plain.fa.gz")) is None
    parts = blocks.read_blocks(spark, found, range_bytes=found[0][1] // 6)
    assert parts.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    read = lambda p: sorted((x["line_no"], x["chrom"], x["bases"]) for x in files.read_fasta_lines(spark, str(tmp_path / p)).collect())
    want = read("plain.fa")
    monkeypatch.setattr(files, "read_blocks", lambda s, f: blocks.read_blocks(s, f, range_bytes=f[0][1] // 6))
    assert len(want) == 5 * 400 + 90 * 10 and read("made") == want and read("plain.fa.gz") == want
