import pytest
from pyspark.sql import functions as F

from helixframe.operators import windows
from helixframe.sources import files, sinks
from helixframe.functions.sequence import encode, to_tokens


def test_fasta_lines_order_and_names(spark, chrt_fasta):
    rows = files.read_fasta_lines(spark, chrt_fasta).orderBy("line_no").collect()
    assert [(r["chrom"], r["bases"]) for r in rows] == [
        ("chrT", "AACGT"), ("chrT", "TNGCA"), ("chrT", "TGCC"), ("chrU", "acgtn"), ("chrU", "ACG")]


def test_unknown_suffix_rejected(spark, tmp_path):
    with pytest.raises(TypeError):
        files.read_fasta_lines(spark, str(tmp_path / "x.fna"))


def test_records_and_activity_positional_join(spark, tmp_path):
    fa = tmp_path / "records.fa"
    fa.write_text(">r0\nACGTN\n>r1\nAC\nGT\n>r2\nTTTTT\n")
    tsv = tmp_path / "activity.tsv"
    tsv.write_text("ID\tDev_log2_enrichment\tHk_log2_enrichment\nr0\t1.5\t-0.5\nr1\t2.0\tbad\nr2\t0\t3\n")
    rec = files.read_fasta_records(spark, str(fa))
    assert [(r["ordinal"], r["name"], r["bases"]) for r in rec.orderBy("ordinal").collect()] == [
        (0, "r0", "ACGTN"), (1, "r1", "ACGT"), (2, "r2", "TTTTT")]
    act = files.read_activity(spark, str(tsv))
    j = files.positional_join(rec.drop("_file"), act.drop("_file")).orderBy("ordinal").collect()
    assert [(r["name"], r["y_dev"], r["y_hk"]) for r in j] == [("r0", 1.5, -0.5), ("r1", 2.0, None), ("r2", 0.0, 3.0)]
    short = act.drop("_file").where("ordinal < 2")
    with pytest.raises(Exception):
        files.positional_join(rec.drop("_file"), short).collect()


def test_annotation_comments_and_empty_lists(spark, tmp_path):
    p = tmp_path / "annotation.txt"
    p.write_text("#header\nGA\t0\tchr1\t+\t3\t12\t4,7,\t9,7,\nGB\t1\tchr2\t-\t1\t5\t\t\n")
    g = {r["gene"]: r for r in files.read_annotation(spark, str(p)).collect()}
    assert g["GA"]["tx_start"] == 2 and g["GA"]["jn_start"] == [3, 6] and g["GB"]["jn_end"] == []
    assert [r["gene"] for r in files.read_annotation(spark, str(p), exclude_paralogs=True).collect()] == ["GA"]


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0, "ACGTN")], "ordinal long, s string").withColumn(
        "tokens", to_tokens(encode("s", "afirst")))
    sinks.write_encoded_sequences(df, str(tmp_path / "enc"))
    back = spark.read.parquet(str(tmp_path / "enc")).first()
    assert back["tokens"] == [2, 5, 6, 7, 8, 9, 3]
    calls = []

    def build():
        calls.append(1)
        return df.select("ordinal")

    a = sinks.materialize(build, spark, str(tmp_path / "cache"), str(tmp_path / "enc"), {"window": 4})
    b = sinks.materialize(build, spark, str(tmp_path / "cache"), str(tmp_path / "enc"), {"window": 4})
    assert a.count() == b.count() == 1 and len(calls) == 1
    m = spark.createDataFrame([(1, "loss", 0.5, 0)], "run_id long, tag string, value double, step long")
    sinks.append_metrics(m, str(tmp_path / "log"), batch="0")
    sinks.append_metrics(m, str(tmp_path / "log"), batch="1")
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    prog = spark.createDataFrame([(1, 0, True), (1, 1, False)], "run_id long, epoch long, improved boolean")
    preds = spark.createDataFrame([(1, e, 1.0, 1.1, 2.0, 2.1) for e in (0, 1)],
                                  "run_id long, epoch long, dev double, dev_preds double, hk double, hk_preds double")
    sinks.write_predictions(preds, prog, str(tmp_path / "preds"))
    out = spark.read.parquet(str(tmp_path / "preds"))
    assert [r["epoch"] for r in out.collect()] == [0]


def test_training_shards(spark, tmp_path):
    from helixframe.operators import splits
    w = spark.range(300).select(F.concat(F.lit("G"), (F.col("id") % 50).cast("string")).alias("gene"),
                                F.col("id").alias("tile"), F.lit("train").alias("split"))
    b = splits.shuffle_batches(w, 8, seed=3)
    sinks.write_training_shards(b, str(tmp_path / "shards"), shard_batches=10)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == 300
    assert sorted(r["shard"] for r in back.select("shard").distinct().collect()) == [0, 1, 2, 3]


def test_gzipped_fasta(spark, tmp_path):
    import gzip
    p = tmp_path / "genome.fa.gz"
    with gzip.open(p, "wt") as fh:
        fh.write(">chrA\nACGT\nNNAC\n>chrB\nGG\n")
    rows = files.read_fasta_lines(spark, str(p)).orderBy("line_no").collect()
    assert [(r["chrom"], r["bases"]) for r in rows] == [("chrA", "ACGT"), ("chrA", "NNAC"), ("chrB", "GG")]


def test_duplicate_genes_rejected(spark, tmp_path):
    p = tmp_path / "dup.txt"
    p.write_text("GA\t0\tchr1\t+\t3\t12\t4,\t9,\nGA\t0\tchr2\t+\t3\t12\t4,\t9,\nGB\t0\tchr1\t+\t1\t5\t\t\n")
    with pytest.raises(ValueError, match="GA"):
        files.read_annotation(spark, str(p))
    assert files.read_annotation(spark, str(p), reject_duplicates=False).count() == 3


def test_positional_join_of_several_files(spark, tmp_path):
    """Ordinals restart in each file: the group keeps files apart; without it, a repeated ordinal raises."""
    for g in ("Train", "Val"):
        (tmp_path / "fa").mkdir(exist_ok=True)
        (tmp_path / "act").mkdir(exist_ok=True)
        (tmp_path / "fa" / f"Sequences_{g}.fa").write_text(f">a\nAC{'G' if g == 'Val' else 'T'}\n>b\nGGG\n")
        (tmp_path / "act" / f"Sequences_activity_{g}.txt").write_text(
            "id\tDev_log2_enrichment\tHk_log2_enrichment\n" + "".join(f"{i}\t{i + (g == 'Val') * 10}\t0\n" for i in range(2)))
    rec = files.read_fasta_records(spark, str(tmp_path / "fa")).drop("_file")
    act = files.read_activity(spark, str(tmp_path / "act")).drop("_file")
    j = files.positional_join(rec, act, group="group").collect()
    assert sorted((r["group"], r["ordinal"], r["bases"], r["y_dev"]) for r in j) == [
        ("Train", 0, "ACT", 0.0), ("Train", 1, "GGG", 1.0), ("Val", 0, "ACG", 10.0), ("Val", 1, "GGG", 11.0)]
    with pytest.raises(Exception, match="ordinal repeats"):
        files.positional_join(rec.drop("group"), act.drop("group")).collect()


def write_records(path, records, width=7):
    path.write_text("".join(f">{name} note\n" + "".join(seq[i:i + width] + "\n" for i in range(0, len(seq), width)) for name, seq in records))
    return str(path)


def test_records_in_pieces(spark, tmp_path):
    """A huge record, short ones, one without bases, pieces and lines that don't meet; blocks of a file read apart."""
    records = [("a", "ACGT" * 9000), ("empty", ""), ("b", "TTG"), ("c", "ACGTN" * 200)]
    path = write_records(tmp_path / "r.fa", records)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = files.read_fasta_pieces(spark, path, piece=1000).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    got = {}
    for r in sorted(rows, key=lambda r: (r["ordinal"], r["piece"])):
        assert r["start"] == r["piece"] * 1000 and len(r["bases"]) == min(1000, r["length"] - r["start"])
        got.setdefault((r["ordinal"], r["name"], r["length"]), []).append(r["bases"])
    assert {k: "".join(v) for k, v in got.items()} == {(i, n, len(s)): s for i, (n, s) in enumerate(records) if s}


def test_records_above_the_limit_raise(spark, tmp_path):
    path = write_records(tmp_path / "r.fa", [("a", "ACGT" * 30), ("b", "A")])
    assert files.read_fasta_records(spark, path, max_record=120).count() == 2
    with pytest.raises(Exception, match="a record of more than 100 bases: a"):
        files.read_fasta_records(spark, path, max_record=100).collect()


def test_equal_lengths(spark, tmp_path):
    same = write_records(tmp_path / "same.fa", [("a", "ACGTACGTA"), ("b", "TTTTTTTTT")])
    assert sorted(r["bases"] for r in files.read_fasta_records(spark, same, equal_lengths=True).collect()) == ["ACGTACGTA", "TTTTTTTTT"]
    other = write_records(tmp_path / "other.fa", [("a", "ACGTACGTA"), ("b", "TTTTTTTT")])
    for read in (files.read_fasta_records, files.read_fasta_pieces):
        with pytest.raises(Exception, match="unequal lengths"):
            read(spark, other, equal_lengths=True).collect()


def test_annotation_in_file_order(spark, tmp_path):
    """Line numbers run on through the files, comments are no records, and tiles carry them."""
    folder = tmp_path / "annotation"
    folder.mkdir()
    names = [f"G{i * 7 % 100}" for i in range(100)]
    for k in range(2):
        body = "".join(f"{g}\t0\tchr2\t+\t{10 + i}\t{400 + i}\t12,\t14,\n" + ("# note\n" if i % 9 == 0 else "") for i, g in enumerate(names[k * 50:k * 50 + 50]))
        (folder / f"part-{k}.txt").write_text(body)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        genes = files.read_annotation(spark, str(folder), line_order=True)
        assert [r["gene"] for r in sorted(genes.collect(), key=lambda r: r["line_no"])] == names
        assert sorted(r["line_no"] for r in genes.collect()) == list(range(100))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    tiles = windows.tile(genes, 300).collect()
    assert {(r["gene"], r["line_no"]) for r in tiles} == {(g, i) for i, g in enumerate(names)}
