import pytest
from pyspark.sql import functions as F

from helixframe.operators import genome as gn
from helixframe.operators import labels, samples, splits, windows
from helixframe.sources.files import read_annotation, read_fasta_lines


@pytest.fixture(scope="module")
def ann_path(tmp_path_factory):
    d = tmp_path_factory.mktemp("ann")
    p = d / "ann.txt"
    p.write_text("# gene paralog chrom strand tx_start tx_end jn_start jn_end\n"
                 "GA\t0\tchrT\t+\t3\t12\t4,7,\t9,7,\n"
                 "GB\t0\tchrT\t-\t3\t12\t4,7,\t9,7,\n"
                 "GC\t1\tchrT\t+\t1\t5\t\t\n")
    return str(p)


@pytest.fixture(scope="module")
def genes(spark, ann_path):
    return read_annotation(spark, ann_path)


@pytest.fixture(scope="module")
def genome(spark, chrt_fasta):
    return gn.build_genome(read_fasta_lines(spark, chrt_fasta), chunk_size=4, halo=2)


def test_site_labels_worked_example(spark, genes):
    got = {(r["gene"], r["pos"]): r["label"] for r in labels.site_labels(genes).collect()}
    assert got == {("GA", 3): 1, ("GA", 8): 2, ("GA", 6): -100,
                   ("GB", 8): 1, ("GB", 3): 2, ("GB", 6): -100}


def test_empty_lists_and_tiles(spark, genes):
    t = windows.tile(genes, 4)
    starts = sorted(r["start"] for r in t.where("gene = 'GA'").collect())
    assert starts == [2, 6, 10]
    assert sorted(r["start"] for r in t.where("gene = 'GC'").collect()) == [0, 4]  # range(0, 5, 4)


def _window(spark, genes, gene, start, window=4, flank=4):
    w = windows.tile(genes, window).where(F.col("gene") == gene).where(F.col("tile") == 0)
    w = w.withColumn("start", F.lit(start).cast("bigint"))
    return windows.window_bounds(w, window, flank)


def test_window_labels_and_tokens(spark, genes, genome):
    sites = labels.site_labels(genes)
    for gene, start, lab, tok in [
            ("GA", 10, [0, 0, -100, -100], [2, 5, 8, 7, 6, 9, 8, 5, 5, 5, 5, 5, 5, 3]),
            ("GB", 2, [0, 0, 2, 0], [2, 9, 8, 7, 5, 6, 6, 7, 8, 5, 5, 5, 5, 3])]:
        w = _window(spark, genes, gene, start)
        # the tile id of a moved window: recompute from its start
        w = w.withColumn("tile", ((F.col("start") - F.col("tx_start")) / 4).cast("bigint"))
        got = samples.window_labels(w, sites, 4).select(samples.labels_to_array("labels").alias("l")).first()["l"]
        assert got == lab
        s = samples.window_sequences(w, genome)
        t = s.select(samples.token_array(samples.window_tokens("seq")).alias("t")).first()["t"]
        assert t == tok
        assert len(t) == 2 * 4 + 4 + 2


def test_jittered_labels_cross_tiles(spark, genes):
    """A window shifted by the jitter reads sites of the neighbouring tile."""
    sites = labels.site_labels(genes)
    w = windows.tile(genes, 4).where("gene = 'GA' and tile = 1")  # start 6
    w = windows.window_bounds(w.withColumn("start", F.lit(5).cast("bigint")), 4, 4)
    got = samples.window_labels(w, sites, 4).select(samples.labels_to_array("labels")).first()[0]
    assert got == [0, -100, 0, 2]  # positions 5..8 span tiles 0 and 1: 6 ambiguous, 8 acceptor


def test_split_rules(spark):
    rows = [("g1", "chr1", 0), ("g2", "chr1", 1), ("g3", "chr2", 0), ("g4", "chr2", 1), ("g5", "chr4", 0)]
    w = spark.createDataFrame(rows, "gene string, chrom string, paralog int")
    s = {r["gene"]: r["split"] for r in splits.assign_split(w, num_val_genes=1, seed=0).collect()}
    assert s["g1"] == "test" and s["g2"] is None and s["g4"] == "train"
    assert sorted([s["g3"], s["g5"]]) == ["train", "val"]
    with pytest.raises(Exception, match="cannot draw 5 validation genes from a pool of 2"):
        splits.assign_split(w, num_val_genes=5).collect()
    labels.assert_disjoint(splits.assign_split(w, num_val_genes=2))


def test_shuffle_batches_are_a_permutation(spark):
    w = spark.range(1000).select(F.concat(F.lit("G"), (F.col("id") % 97).cast("string")).alias("gene"),
                                 F.col("id").alias("tile"),
                                 F.when(F.col("id") % 3 == 0, "val").otherwise("train").alias("split"))
    b = splits.shuffle_batches(w, 32, seed=1, epoch=2).collect()
    for sp in ("train", "val"):
        pos = sorted(r["batch_id"] * 32 + r["batch_pos"] for r in b if r["split"] == sp)
        assert pos == list(range(len(pos)))
    b2 = splits.shuffle_batches(w, 32, seed=1, epoch=3).collect()
    order = {(r["gene"], r["tile"]): r["batch_id"] for r in b if r["split"] == "train"}
    order2 = {(r["gene"], r["tile"]): r["batch_id"] for r in b2 if r["split"] == "train"}
    assert order != order2


def test_partition_count_does_not_change_results(spark, genes):
    base = sorted(labels.site_labels(genes).collect())
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert sorted(labels.site_labels(genes.repartition(3)).collect()) == base
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_jitter_without_a_split_warns(spark, genes):
    w = windows.tile(genes, 4)
    with pytest.warns(UserWarning, match="assign splits first"):
        same = windows.jitter(w, 23)
    assert sorted(same.collect()) == sorted(w.collect())


def test_batches_keep_the_order_of_lines(spark):
    """Validation and test windows by line and tile, over many blocks of lines; training ones shuffled."""
    lines = [(i * 577 % 5000, f"G{i % 83}", t, ("val", "test", "train", None)[i % 4]) for i in range(700) for t in range(3)]
    w = spark.createDataFrame(lines, "line_no long, gene string, tile long, split string").repartition(5)
    b = splits.shuffle_batches(w, 7).collect()
    assert len(b) == sum(r[3] is not None for r in lines)
    for split in ("val", "test"):
        mine = sorted((r["batch_id"] * 7 + r["batch_pos"], r["line_no"], r["tile"]) for r in b if r["split"] == split)
        assert [m[0] for m in mine] == list(range(len(mine)))
        assert [m[1:] for m in mine] == sorted((i, t) for i, _, t, s in lines if s == split)
    train = [r["line_no"] for r in sorted((r for r in b if r["split"] == "train"), key=lambda r: r["batch_id"] * 7 + r["batch_pos"])]
    assert train != sorted(train)
