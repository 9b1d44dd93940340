"""The written genome store: publishing, pruning, spreading; keyed k-mer counts."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helixframe.operators import genome as gn
from helixframe.sources import sinks

LETTERS = "ACGTN"


def sequences(seed=3, contigs=4, length=900):
    r = random.Random(seed)
    return {f"c{i}": "".join(r.choice(LETTERS) for _ in range(length + 37 * i)) for i in range(contigs)}


def lines_of(spark, seqs, width=23):
    rows = [(c, i, s[i * width:(i + 1) * width]) for c, s in seqs.items() for i in range(-(-len(s) // width))]
    return spark.createDataFrame(rows, "chrom string, line_no long, bases string").repartition(3)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    seqs = sequences()
    path = str(tmp_path_factory.mktemp("genome") / "store")
    gn.write_genome(gn.build_genome(lines_of(spark, seqs), chunk_size=16, halo=8), path)
    return seqs, gn.read_genome(spark, path)


def intervals_of(spark, rows):
    return spark.createDataFrame(rows, "id int, chrom string, start long, end long")


def got(df):
    return sorted((r["id"], r["seq"]) for r in df.collect())


@pytest.mark.parametrize("max_pages", [4096, 1])
def test_pruned_fetch_gives_the_same_rows(spark, store, monkeypatch, max_pages):
    """Whatever is left out is never asked for; with too many pages only contigs prune."""
    monkeypatch.setattr(gn, "PAGE", 3)
    seqs, g = store
    r = random.Random(1)
    rows = [(i, r.choice(["c1", "c3"]), s := r.randrange(-20, 1100), s + r.randrange(1, 90)) for i in range(60)]
    iv = intervals_of(spark, rows)
    for options in ({}, {"max_len": 8}, {"no_padding": True}):
        part = iv if "max_len" not in options else iv.withColumn("end", F.least("end", F.col("start") + 8))
        p = gn.prune(g, part, max_pages=max_pages)
        assert got(gn.fetch_intervals(p, part, **options)) == got(gn.fetch_intervals(g, part, **options))


def test_pruning_reaches_the_scan(spark, store, monkeypatch):
    """Other contigs' files are no part of the scan, and ranges of chunks are pushed to Parquet."""
    monkeypatch.setattr(gn, "PAGE", 4)
    _, g = store
    iv = intervals_of(spark, [(0, "c2", 100, 120), (1, "c2", 690, 700)])
    p = gn.prune(g, iv)
    plan = p.chunks._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(chrom" in plan or "PartitionFilters: [chrom" in plan
    pushed = plan[plan.index("PushedFilters"):]
    assert "GreaterThanOrEqual(chunk_id" in pushed and "LessThanOrEqual(chunk_id" in pushed
    assert {(r["chrom"], r["chunk_id"]) for r in p.chunks.collect()} == {("c2", i) for i in (4, 5, 6, 7, 40, 41, 42, 43)}


def test_pruning_nothing_touched(spark, store):
    _, g = store
    iv = intervals_of(spark, [(0, "c0", -50, -40), (1, "c1", 90000, 90004)])
    assert got(gn.fetch_intervals(gn.prune(g, iv), iv)) == [(0, "N" * 10), (1, "N" * 4)]
    assert gn.prune(g, iv.where("id < 0")).chunks.count() == 0


@pytest.mark.parametrize(("pages", "limit", "want"), [([], 3, []), ([1, 2, 3, 7], 9, [(1, 3), (7, 7)]), ([1, 3, 10, 12, 50], 2, [(1, 12), (50, 50)]),
                                                      ([0, 9], 1, [(0, 9)])])
def test_ranges_of_pages(pages, limit, want):
    assert gn._merged(pages, limit) == want


def test_hot_chunk_is_spread(spark, store):
    """Rows that all lie in one chunk, half of them equal, come back complete and pass a rebalancing exchange."""
    seqs, g = store
    rows = [(i, "c0", 4 + i % 2 * (i % 5), 10 + i % 2 * (i % 5)) for i in range(3000)]
    f = gn.fetch_intervals(g, intervals_of(spark, rows), max_len=8)
    assert "REBALANCE" in f._jdf.queryExecution().executedPlan().toString().upper()
    assert got(f) == sorted((i, seqs["c0"][s:e]) for i, _, s, e in rows)


def test_too_long_intervals_raise_before_they_are_cut(spark, store):
    _, g = store
    big = intervals_of(spark, [(0, "c0", 0, 5)])
    old, gn.MAX_INTERVAL = gn.MAX_INTERVAL, 4
    try:
        with pytest.raises(Exception, match="interval of more than 4 bases"):
            gn.fetch_intervals(g, big).collect()
    finally:
        gn.MAX_INTERVAL = old


def test_kmer_counts_by_key(spark, store):
    """A contig may count for several keys or none."""
    seqs, g = store
    keys = [("c0", "a", 1), ("c1", "a", 1), ("c1", "b", 2), ("c3", "b", 2)]
    df = spark.createDataFrame(keys, "chrom string, sample string, lane int")
    counts = gn.kmer_counts(g, 3, 1, 1, keys=df)
    want = Counter()
    for c, s, lane in keys:
        t = "N" + seqs[c] + "N"
        want.update((s, lane, t[i:i + 3]) for i in range(len(seqs[c])))
    assert {(r["sample"], r["lane"], r["kmer"]): r["n"] for r in counts.collect()} == dict(want)
    with pytest.raises(ValueError, match="column to count by"):
        gn.kmer_counts(g, 3, keys=df.select("chrom"))


def test_half_written_sets_are_not_read(spark, tmp_path):
    """A builder that fails leaves nothing that a later reader takes for the data set."""
    source = str(tmp_path / "source")
    spark.range(3).write.parquet(source)
    root = str(tmp_path / "prepared")

    def fails(path):
        spark.range(5).write.parquet(f"{path}/first")
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        sinks.publish(spark, root, source, {"n": 1}, fails)
    assert [f for f in os.listdir(root) if not f.startswith(".")] == []
    d = sinks.materialize(lambda: spark.range(7), spark, root, source, {"n": 1})
    assert d.count() == 7


def test_the_loser_of_a_race_reads_the_winner(spark, tmp_path):
    """While one builder writes, another publishes: both read what was published first, and no copy is left."""
    source = str(tmp_path / "source")
    spark.range(3).write.parquet(source)
    root = str(tmp_path / "prepared")
    inner = []

    def slow():
        inner.append(sinks.materialize(lambda: spark.range(10), spark, root, source, {}).count())
        return spark.range(99)

    assert sinks.materialize(slow, spark, root, source, {}).count() == 10
    assert inner == [10] and len(os.listdir(root)) == 1
    spark.range(4).write.mode("overwrite").parquet(source)  # another state of the source is another data set
    assert sinks.materialize(lambda: spark.range(11), spark, root, source, {}).count() == 11
