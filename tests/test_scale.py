"""Plans and views of the genome queries that keep work per row small (findings F1 to F8)."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from helixframe.functions.sequence import kmers
from helixframe.operators import genome as gn
from helixframe.operators import samples, scoring, windows
from helixframe.plans import queries
from helixframe.session import materialize, shuffles_dropped
from helixframe.sources import fixtures as fx
from helixframe.sources import sinks


def plan(df, which="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), which)().toString()


@pytest.fixture(scope="module")
def store(spark):
    rng = random.Random(5)
    lines = [(f"chr{i % 2}", i, "".join(rng.choice("ACGTUNacgtun") for _ in range(rng.randint(1, 90)))) for i in range(120)]
    df = spark.createDataFrame(lines, "chrom string, line_no long, bases string")
    text = {c: "".join(b for k, _, b in lines if k == c) for c in ("chr0", "chr1")}
    return df, text, gn.build_genome(df, 256, 64)


@pytest.mark.parametrize("k,left,right,step", [(3, 1, 1, 1), (5, 0, 2, 3), (1, 0, 0, 1)])
def test_kmers_are_cut_from_short_texts(spark, store, k, left, right, step):
    lines, text, _ = store
    g = gn.build_genome(lines, 2048, 64)  # more than one block of blocks
    got = gn.kmer_counts(g, k, left, right, step)
    assert "zip_with" not in plan(got) and plan(got).count("explode(") >= 3
    contigs = spark.createDataFrame([(t,) for t in text.values()], "t string")
    want = contigs.select(F.explode(kmers("t", k, left, right, step)).alias("kmer")).groupBy("kmer").count()
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def _windows(spark, text):
    rows = [(f"g{i}", 0, f"chr{i % 2}", "+-"[i // 2 % 2] if i % 11 else None, 40 + 7 * i, 40 + 7 * i + 20 + i, 40 + 7 * i) for i in range(40)]
    w = spark.createDataFrame(rows, "gene string, tile long, chrom string, strand string, tx_start long, tx_end long, start long")
    return windows.window_bounds(w, 16, 8)


def test_windows_are_turned_and_encoded_per_chunk(spark, store):
    _, text, g = store
    w = _windows(spark, text)
    s = samples.window_sequences(w, g, span=32)
    t = samples.window_sequences(w, samples.token_genome(g), span=32).withColumn("tokens", samples.window_tokens("seq", codebook=None))
    for p in (plan(s), plan(t)):
        assert p.index("Join LeftOuter, ((_chrom") < p.index("translate(")  # below the join: on chunks, not on windows
    comp = str.maketrans("ACGTUNacgtun", "TGCAANtgcaan")
    want = {}
    for r in w.collect():
        core = "".join(text[r.chrom][r.seq_lo:r.seq_hi]).ljust(r.seq_hi - r.seq_lo, "N")
        seq = "N" * (r.seq_lo - r.left) + core + "N" * (r.right - r.seq_hi)
        want[r.gene] = seq[::-1].translate(comp) if r.strand == "-" else seq
    assert {r.gene: r.seq for r in s.collect()} == want
    one = s.select("gene", samples.window_tokens("seq").alias("tokens"))
    assert {tuple(r) for r in t.select("gene", "tokens").collect()} == {tuple(r) for r in one.collect()}


def test_turned_fetch_with_padding_of_two_letters(spark, store):
    _, text, g = store
    iv = spark.createDataFrame([("chr0", -3, 6), ("chr1", 5, 9)], "chrom string, start long, end long")
    for bound in (None, 16):
        got = {r.chrom: r.seq for r in gn.fetch_intervals(g, iv, reverse=True, padding="AC", max_len=bound).collect()}
        comp = str.maketrans("ACGTUNacgtun", "TGCAANtgcaan")
        assert got == {"chr0": ("ACACAC" + text["chr0"][:6])[::-1].translate(comp), "chr1": text["chr1"][5:9][::-1].translate(comp)}


def test_codebook_without_complement(store):
    with pytest.raises(ValueError, match="complement"):
        gn.encoded(store[2], {"N": 0, "A": 1, "C": 1, "G": 3, "T": 4})


def test_fetch_does_not_repeat_its_clamping(spark, store):
    iv = spark.createDataFrame([("chr0", 1, 1200), ("chr1", 99999, 100010)], "chrom string, start long, end long")
    f = gn.fetch_intervals(store[2], iv, no_padding=True)
    assert not [x for x in plan(f).splitlines() if "Filter" in x and "raise_error" in x]
    assert {r.chrom: r.seq for r in f.collect()} == {"chr0": store[1]["chr0"][1:1200], "chr1": ""}


def test_intervals_are_not_dealt_by_contig(spark):
    p = plan(fx.intervals(spark, "/root/testdata/sf0.001"))
    join = next(x for x in p.splitlines() if "Join Inner" in x)
    assert "rightHint=(strategy=broadcast)" in join


def test_store_is_built_from_lines_cut_once(spark, store, tmp_path):
    lines, text, g = store
    with sinks.staged(lines, str(tmp_path / "lines")) as kept:
        built = gn.build_genome(kept, 256, 64)
        gn.write_genome(replace(built, contigs=None), str(tmp_path / "store"))
    assert not (tmp_path / "lines").exists()
    read = gn.read_genome(spark, str(tmp_path / "store"))
    assert {tuple(r) for r in read.contigs.collect()} == {(c, len(t)) for c, t in text.items()}


def test_positions_come_from_flat_lists(spark):
    df = spark.createDataFrame([("g", 0, "256789663", "01x")], "gene string, tile long, tokens string, labels string")

    def two():
        import numpy as np

        return lambda t: np.stack([t, t % 3], axis=2).astype(float)

    s = scoring.score_windows(df, two, window=3, flank=2)  # fewer classes than the default
    assert "struct<" not in s._jdf.queryExecution().analyzed().toString() and "_logits" in plan(s)
    assert [(r.offset, r.label, r.logits) for r in s.orderBy("offset").collect()] == [(0, 0, [7.0, 1.0]), (1, 1, [8.0, 2.0]), (2, -100, [9.0, 0.0])]


@pytest.fixture
def by_key(spark):
    """Joins deal their rows by key, as on tables too large to be broadcast."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _labelled(spark):
    """Windows and sites of genes of which one has two records, with other starts, and one has no name."""
    genes = [("g1", "+", 10, 58), ("g1", "-", 13, 50), ("g2", "-", 0, 16), (None, "+", 4, 30), ("g3", None, 2, 40)]
    rows = [(g, t, "chr0", s, a, b, a + 16 * t) for g, s, a, b in genes for t in range((b - a + 15) // 16)]
    w = spark.createDataFrame(rows + rows[:2], "gene string, tile long, chrom string, strand string, tx_start long, tx_end long, start long")
    w = w.withColumn("start", F.col("start") + F.when(F.col("tile") == 1, 5).otherwise(0))
    sites = [(g, a, p, (1, 2, -100)[p % 3]) for g, s, a, b in genes for p in range(a, b, 5)]
    return windows.window_bounds(w, 16, 8), spark.createDataFrame(sites, "gene string, tx_start long, pos long, label int"), sites


def test_windows_meet_their_sites_before_they_are_wide(spark):
    w, sites, known = _labelled(spark)
    whole = samples.window_labels(w, sites, 16)
    first = samples.window_labels(samples.join_sites(w, sites, 16).withColumn("wide", F.lit("x")), None, 16)
    assert whole.columns == [*w.columns, "labels"] and first.columns == [*w.columns, "wide", "labels"]
    got = sorted(whole.collect(), key=str)
    assert sorted(first.drop("wide").collect(), key=str) == got and len(got) == w.count()
    for r in got:
        code = ["x" if not r.tx_start <= p < r.tx_end else "0" for p in range(r.start, r.end)]
        t = (r.lab_lo - r.tx_start) // 16
        for g, a, p, v in known:  # of the window's tile and the next, counted from the start of the site's own record
            if g is not None and g == r.gene and (p - a) // 16 in (t, t + 1) and r.lab_lo <= p < r.lab_hi:
                code[p - r.start] = "x" if v == -100 else str(v)
        assert r.labels == "".join(code[::-1] if r.strand == "-" else code)


def test_sites_are_not_dealt_anew(spark, by_key):
    """Windows and sites of genes that are dealt by gene stay where they are."""
    genes = spark.createDataFrame([("g", "+", 0, 40)], "gene string, strand string, tx_start long, tx_end long").repartition("gene")
    sites = genes.select("gene", "tx_start", F.lit(3).cast("bigint").alias("pos"), F.lit(1).alias("label"))
    w = windows.window_bounds(windows.tile(genes, 16), 16, 8)
    p = plan(samples.window_labels(w, sites, 16), "executedPlan")
    assert "SortMergeJoin" in p and p.count("Exchange") == 2 == p.count("REPARTITION_BY_COL")


def test_windows_are_dealt_once(spark, store, by_key):
    w = _windows(spark, store[1])
    p = plan(samples.window_sequences(w, store[2], span=32), "executedPlan")
    assert "REBALANCE" not in p and "hashpartitioning(_chrom" in p
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    small = replace(store[2], chunks=materialize(store[2].chunks))
    assert "REBALANCE" in plan(samples.window_sequences(w, small, span=32), "executedPlan")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, "ACGTNacgtu ZZ" * 40) for i in range(50)], "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    orders = [(k, k * 7, "OF"[k % 2], ("1-URGENT", "5-LOW")[k % 3 == 0]) for k in (0, 1, 2, 3, 4, 5, 6, 6, 40)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{d}/orders.parquet")
    items = [(k, k * 31 + n, k + n, n) for k in range(7) for n in range(1, 6)]
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{d}/lineitem.parquet")
    return str(d)


def test_scored_windows_are_not_shuffled_wide(spark, tables, by_key):
    """Tokens and labels go from the join with the chunks to their sums as they are; what the windows are made of was written before."""
    df = queries.q_score_windows(spark, tables)
    p = plan(df, "executedPlan")
    scored, join = p.index("MapInArrow"), p.index("SortMergeJoin")
    assert scored < p.index("AS tokens#") < join and p[join:].startswith("SortMergeJoin [_chrom#")
    assert "Exchange" not in p[scored:join] and "REBALANCE" not in p and "listagg" not in p
    labelled = samples.window_labels(queries._token_windows(spark, tables), queries._sites(spark, tables), 300)
    s = scoring.score_windows(labelled, queries._position_model, 300, 300)
    want = s.groupBy("gene", "tile").agg(F.count("label").alias("n"), F.sum("label").alias("labels"), F.sum(F.col("logits")[1]).cast("bigint").alias("thirds"))
    got = {tuple(r) for r in df.select("gene", "tile", "n", "labels", "thirds").collect()}
    assert got == {tuple(r) for r in want.collect()} and {r[2] for r in got} == {300, 600} and any(r[3] for r in got)


def test_shuffles_are_dropped_only_inside(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    for old in (None, "false"):
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)
        usual = spark.conf.get(key, None)
        with pytest.raises(KeyError), shuffles_dropped(spark):
            assert spark.conf.get(key) == "true"
            raise KeyError
        assert spark.conf.get(key, None) == usual
    spark.conf.unset(key) if before is None else spark.conf.set(key, before)
