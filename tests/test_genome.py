import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators import genome as gn
from helixframe.sources.files import read_fasta_lines

from conftest import CHR_T

COMP = str.maketrans("ACGTUNacgtun", "TGCAANtgcaan")


def py_fetch(seq, start, end, left=None, right=None, no_padding=False, reverse=False, pad="N"):
    """Direct slicing model of J1 (borders clamped to the contig)."""
    assert start < end
    n = len(seq)
    left = 0 if left is None else min(max(left, 0), n)
    right = n if right is None else min(max(right, 0), n)
    left = min(left, right)
    if start >= right or end <= left:
        start, end = right, right + end - start
    lp = rp = 0
    if not no_padding:
        if start < left:
            lp, start = left - start, left
        if end > right:
            rp, end = end - right, right
    else:
        start, end = max(start, left), min(end, right)
    s = pad * lp + seq[start:end] + pad * rp
    return s.translate(COMP)[::-1] if reverse else s


@pytest.fixture(scope="module")
def genome(spark, chrt_fasta):
    return gn.build_genome(read_fasta_lines(spark, chrt_fasta), chunk_size=4, halo=2)


def fetch(spark, genome, rows, **kw):
    df = spark.createDataFrame(rows, "id int, chrom string, start long, end long")
    out = gn.fetch_intervals(genome, df, **kw)
    return {r["id"]: r["seq"] for r in out.collect()}


def test_worked_examples(spark, genome):
    rows = [(0, "chrT", -2, 3), (1, "chrT", 12, 17), (2, "chrT", 20, 23), (3, "chrT", -5, -1)]
    assert fetch(spark, genome, rows) == {0: "NNAAC", 1: "CCNNN", 2: "NNN", 3: "NNNN"}
    clipped = fetch(spark, genome, rows, no_padding=True)
    assert clipped[1] == "CC" and clipped[2] == ""
    assert fetch(spark, genome, [(0, "chrT", 0, 4)], reverse=True) == {0: "CGTT"}


def test_contigs_and_chunks(spark, genome):
    lens = {r["chrom"]: r["length"] for r in genome.contigs.collect()}
    assert lens == {"chrT": 14, "chrU": 8}
    chunks = sorted((r["chunk_id"], r["bases"], r["ext"]) for r in genome.chunks.where("chrom = 'chrT'").collect())
    assert chunks == [(0, "AACG", "TT"), (1, "TTNG", "CA"), (2, "CATG", "CC"), (3, "CC", "")]


def test_random_intervals_match_python_model(spark, genome):
    rnd = random.Random(7)
    seqs = {"chrT": CHR_T, "chrU": "acgtnACG"}
    rows, want = [], {}
    for i in range(300):
        chrom = rnd.choice(list(seqs))
        s = rnd.randint(-12, 25)
        e = s + rnd.randint(1, 15)
        rows.append((i, chrom, s, e))
        want[i] = py_fetch(seqs[chrom], s, e)
    assert fetch(spark, genome, rows) == want


def test_random_bordered_reverse(spark, genome):
    rnd = random.Random(11)
    rows, want = [], {}
    for i in range(200):
        s = rnd.randint(-8, 20)
        e = s + rnd.randint(1, 12)
        lo = rnd.randint(-3, 10)
        hi = lo + rnd.randint(0, 12)
        rows.append((i, "chrT", s, e, lo, hi))
        want[i] = py_fetch(CHR_T, s, e, lo, hi, reverse=True)
    df = spark.createDataFrame(rows, "id int, chrom string, start long, end long, lo long, hi long")
    out = gn.fetch_intervals(genome, df, left="lo", right="hi", reverse=True)
    assert {r["id"]: r["seq"] for r in out.collect()} == want


def test_bad_inputs_raise(spark, genome):
    with pytest.raises(Exception):
        fetch(spark, genome, [(0, "chrT", 5, 5)])
    with pytest.raises(Exception):
        fetch(spark, genome, [(0, "chrZ", 0, 3)])


def py_kmers(seq, k, lp, rp, step):
    p = "N" * lp + seq + "N" * rp
    return [p[s:s + k] for s in range(0, len(seq), step)]


@pytest.mark.parametrize("k,lp,rp,step", [(3, 1, 1, 1), (3, 0, 0, 2), (5, 2, 0, 3), (2, 0, 4, 1)])
def test_kmer_counts_match_python(spark, genome, chrt_fasta, k, lp, rp, step):
    if k - 1 > genome.halo:  # a chunk must hold all that its items need
        with pytest.raises(ValueError):
            gn.kmer_counts(genome, k, lp, rp, step)
        genome = gn.build_genome(read_fasta_lines(spark, chrt_fasta), chunk_size=4, halo=4)
    want = {}
    for seq in (CHR_T, "acgtnACG"):
        for km in py_kmers(seq, k, lp, rp, step):
            want[km] = want.get(km, 0) + 1
    got = {r["kmer"]: r["n"] for r in gn.kmer_counts(genome, k, lp, rp, step).collect()}
    assert got == want


@pytest.mark.parametrize("chunk,halo", [(4, 2), (5, 5), (16, 8)])
def test_repeated_and_long_intervals_at_any_chunk(spark, chrt_fasta, chunk, halo):
    """Rows keep their number, whatever their length against chunk and halo."""
    g = gn.build_genome(read_fasta_lines(spark, chrt_fasta), chunk_size=chunk, halo=halo)
    rows = [(0, 6), (0, 6), (0, 40), (0, 40), (0, 40), (3, 4), (20, 25), (-3, 14), (-3, 14)]
    df = spark.createDataFrame([("chrT", a, b) for a, b in rows], "chrom string, start long, end long")
    got = sorted((r["start"], r["end"], r["seq"]) for r in gn.fetch_intervals(g, df).collect())
    assert got == sorted((a, b, py_fetch(CHR_T, a, b)) for a, b in rows)


def test_file_splits_do_not_change_offsets(spark, tmp_path):
    """H1: many small splits give the same genome as one split."""
    rnd = random.Random(3)
    contigs = {f"c{i}": "".join(rnd.choice("ACGTN") for _ in range(rnd.randint(50, 400))) for i in range(6)}
    lines = []
    for name, seq in contigs.items():
        lines.append(f">{name} desc")
        lines += [seq[i:i + 37] for i in range(0, len(seq), 37)]
    p = tmp_path / "g.fasta"
    p.write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        g = gn.build_genome(read_fasta_lines(spark, str(p)), chunk_size=64, halo=16)
        rows = [(i, c, 10 * i % 50, 10 * i % 50 + 90) for i, c in enumerate(contigs)]
        got = fetch(spark, g, rows)
        assert spark.read.text(str(p)).rdd.getNumPartitions() > 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {i: py_fetch(contigs[c], s, e) for i, c, s, e in rows}
    assert {r["chrom"]: r["length"] for r in g.contigs.collect()} == {c: len(s) for c, s in contigs.items()}


def test_write_and_read_genome(spark, genome, tmp_path):
    gn.write_genome(genome, str(tmp_path / "store"))
    g2 = gn.read_genome(spark, str(tmp_path / "store"))
    assert (g2.chunk_size, g2.halo) == (4, 2)
    assert fetch(spark, g2, [(0, "chrT", -2, 3)]) == {0: "NNAAC"}


def test_single_join_path_with_max_len(spark, chrt_fasta):
    """Intervals bounded by the halo: one join, empty (clipped) intervals kept."""
    g = gn.build_genome(read_fasta_lines(spark, chrt_fasta), chunk_size=4, halo=4)
    rnd = random.Random(13)
    rows, want, want_clip = [], {}, {}
    for i in range(200):
        s = rnd.randint(-6, 20)
        e = s + rnd.randint(1, 4)
        rows.append((i, "chrT", s, e))
        want[i] = py_fetch(CHR_T, s, e)
        want_clip[i] = py_fetch(CHR_T, s, e, no_padding=True)
    assert fetch(spark, g, rows, max_len=4) == want
    assert fetch(spark, g, rows, max_len=4, no_padding=True) == want_clip


def test_wrong_max_len_raises(spark, genome):
    with pytest.raises(Exception):
        fetch(spark, genome, [(0, "chrT", 0, 9)], max_len=2)


@pytest.mark.parametrize("size,halo", [(2, 2), (2, 1), (4, 2)])
def test_rechunk_matches_store(spark, chrt_fasta, size, halo):
    g = gn.build_genome(read_fasta_lines(spark, chrt_fasta), chunk_size=8, halo=4)
    fine = gn.rechunk(g, size, halo)
    joined = "".join(r["bases"] for r in fine.chunks.where("chrom = 'chrT'").orderBy("chunk_id").collect())
    assert joined == CHR_T
    rnd = random.Random(size * 10 + halo)
    rows = [(i, "chrT", s, s + rnd.randint(1, halo)) for i, s in enumerate(rnd.randint(-4, 18) for _ in range(120))]
    want = {i: py_fetch(CHR_T, s, e) for i, _, s, e in rows}
    assert fetch(spark, fine, rows, max_len=halo) == want
