"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads the driver's tables through the fixture views, so its work
grows with the data.  Column names and types match ``plans/oracle.py``;
counts and integers are BIGINT, doubles are rounded to 6 places.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import (digits_to_array, encode, kmers, reverse_complement, reverse_complement_array,
                                  reverse_complement_codes)
from ..operators import genome as gn
from ..functions.scores import center_slice, class_logits, one_vs_rest, round_half_precision, softmax
from ..operators import labels, metrics, runs, samples, scoring, splits, windows
from ..session import ensure_checkpoint_dir, materialize, shuffles_dropped
from ..sources import blocks, files, sinks
from ..sources import fixtures as fx
from . import params as P


def _genes(spark, sf_dir, exclude_paralogs=False) -> DataFrame:
    return labels.prepare_genes(fx.annotation(spark, sf_dir), exclude_paralogs=exclude_paralogs)


def _tiles(spark, sf_dir) -> DataFrame:
    return windows.tile(_genes(spark, sf_dir), P.WINDOW)


def _split_tiles(spark, sf_dir) -> DataFrame:
    return splits.assign_split(_tiles(spark, sf_dir), P.TEST_CHROMS, P.NUM_VAL_GENES, P.SEED)


def q_site_labels(spark, sf_dir):
    sites = labels.site_labels(_genes(spark, sf_dir))
    return sites.select("gene", F.col("pos").cast("bigint").alias("pos"),
                        F.col("label").cast("bigint").alias("label"))


def q_tiles(spark, sf_dir):
    return _tiles(spark, sf_dir).select("gene", "tile", "start")


def q_exclude_paralogs(spark, sf_dir):
    t = windows.tile(_genes(spark, sf_dir, exclude_paralogs=True), P.WINDOW)
    return (t.groupBy("chrom").agg(F.count_distinct("gene").cast("bigint").alias("n_genes"),
                                   F.count(F.lit(1)).cast("bigint").alias("n_windows")))


def q_split_assignment(spark, sf_dir):
    return _split_tiles(spark, sf_dir).select("gene", "tile", "split")


def q_split_summary(spark, sf_dir):
    return splits.split_summary(_split_tiles(spark, sf_dir))


def q_split_leakage(spark, sf_dir):
    return labels.split_leakage(_split_tiles(spark, sf_dir))


def q_window_bounds(spark, sf_dir):
    w = windows.window_bounds(_tiles(spark, sf_dir), P.WINDOW, P.FLANK)
    return w.select("gene", "tile", "start", "end", "left", "right",
                    "lab_lo", "lab_hi", "seq_lo", "seq_hi")


def q_window_jitter(spark, sf_dir):
    w = windows.jitter(_split_tiles(spark, sf_dir), P.SHIFT, P.SEED, P.EPOCH)
    w = windows.window_bounds(w, P.WINDOW, P.FLANK)
    return w.select("gene", "tile", "split", "start", "end", "lab_lo", "lab_hi")


def _genome(spark, sf_dir) -> gn.Genome:
    """The genome store of ``sf_dir``, read from its written form.

    It is built and published once below the shared folder (S7) for each state of the
    source files, as a pipeline converts its FASTA once and fetches
    from the store many times; every query and session after that finds it there."""
    def write(path):
        # The lines are cut from the texts once, the contigs' lengths come from the written chunks.
        with sinks.staged(fx.fasta_lines(spark, sf_dir), f"{path}.lines") as lines:
            g = gn.build_genome(lines, P.CHUNK, P.HALO)
            gn.write_genome(replace(g, contigs=None), path)

    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/genomes"
    source = f"{sf_dir.rstrip('/')}/documents.parquet"
    return gn.read_genome(spark, sinks.publish(spark, root, source, {"chunk": P.CHUNK, "halo": P.HALO}, write))


def _jittered(spark, sf_dir) -> DataFrame:
    w = windows.jitter(_split_tiles(spark, sf_dir), P.SHIFT, P.SEED, P.EPOCH)
    return windows.window_bounds(w, P.WINDOW, P.FLANK)


def _sites(spark, sf_dir) -> DataFrame:
    return labels.site_labels(_genes(spark, sf_dir))


def q_genome_contigs(spark, sf_dir):
    return _genome(spark, sf_dir).contigs.select("chrom", "length")


def q_genome_chunks(spark, sf_dir):
    c = _genome(spark, sf_dir).chunks
    return c.select("chrom", "chunk_id", F.col("chunk_start").cast("bigint").alias("chunk_start"),
                    F.length("bases").cast("bigint").alias("n_bases"),
                    F.md5("bases").alias("bases_md5"), F.md5("ext").alias("ext_md5"))


def _fetch_out(df, col="seq"):
    return df.select("gene", F.length(col).cast("bigint").alias("seq_len"), F.md5(col).alias("seq_md5"))


def q_fetch_intervals(spark, sf_dir):
    iv = fx.intervals(spark, sf_dir)
    return _fetch_out(gn.fetch_intervals(_genome(spark, sf_dir), iv, "start_pos", "end_pos"))


def q_fetch_intervals_bordered(spark, sf_dir):
    iv = fx.intervals(spark, sf_dir)
    f = gn.fetch_intervals(_genome(spark, sf_dir), iv, "start_pos", "end_pos",
                           left=F.col("start_pos") + 5, right=F.col("end_pos") - 5,
                           reverse=F.col("strand") == "-")
    return _fetch_out(f)


def q_fetch_clipped(spark, sf_dir):
    iv = fx.intervals(spark, sf_dir)
    f = gn.fetch_intervals(_genome(spark, sf_dir), iv, "start_pos", "end_pos", no_padding=True)
    return _fetch_out(f)


def _repeated(spark, sf_dir):
    """Each interval once to three times, by its gene."""
    times = F.sequence(F.lit(0), F.pmod(F.length("gene"), F.lit(3)))
    return fx.intervals(spark, sf_dir).withColumn("copy", F.explode(times))


def q_fetch_repeated(spark, sf_dir):
    return _fetch_out(gn.fetch_intervals(_genome(spark, sf_dir), _repeated(spark, sf_dir), "start_pos", "end_pos"))


def q_fetch_long(spark, sf_dir):
    """Intervals of several chunks, repeated."""
    iv = _repeated(spark, sf_dir).withColumn("end_pos", F.col("end_pos") + 2 * P.CHUNK)
    return _fetch_out(gn.fetch_intervals(_genome(spark, sf_dir), iv, "start_pos", "end_pos"))


def q_fetch_pruned(spark, sf_dir):
    """Intervals of the first bases of two contigs, from a store cut to the pages they touch."""
    iv = fx.intervals(spark, sf_dir).where(F.col("chrom").isin("chr4", "chr11") & (F.col("end_pos") <= 2 * P.CHUNK))
    g = gn.prune(_genome(spark, sf_dir), iv, "start_pos", "end_pos")
    return _fetch_out(gn.fetch_intervals(g, iv, "start_pos", "end_pos"))


def q_window_sequences(spark, sf_dir):
    w = samples.window_sequences(_jittered(spark, sf_dir), _genome(spark, sf_dir), span=P.WINDOW + 2 * P.FLANK)
    return w.select("gene", "tile", F.length("seq").cast("bigint").alias("seq_len"),
                    F.md5("seq").alias("seq_md5"))


def q_window_labels(spark, sf_dir):
    w = samples.window_labels(_jittered(spark, sf_dir), _sites(spark, sf_dir), P.WINDOW)
    return _label_digest(w)


def q_window_labels_far(spark, sf_dir):
    """Windows moved by up to three tiles."""
    w = windows.jitter(_split_tiles(spark, sf_dir), P.FAR_SHIFT, P.SEED, P.EPOCH)
    w = windows.window_bounds(w, P.WINDOW, P.FLANK)
    return _label_digest(samples.window_labels(w, _sites(spark, sf_dir), P.WINDOW))


def _label_digest(w):
    lab = F.col("labels")

    def count(ch):
        return (F.length(lab) - F.length(F.regexp_replace(lab, ch, ""))).cast("bigint")

    return w.select("gene", "tile", F.md5(lab).alias("labels_md5"),
                    count("1").alias("n_donor"), count("2").alias("n_acceptor"),
                    count("x").alias("n_ignored"))


def q_window_tokens(spark, sf_dir):
    t = _token_windows(spark, sf_dir)
    return t.select("gene", "tile", F.length("tokens").cast("bigint").alias("n_tokens"),
                    F.md5("tokens").alias("tokens_md5"))


def q_splice_motifs(spark, sf_dir):
    return samples.splice_motifs(_sites(spark, sf_dir), _genome(spark, sf_dir))


def q_label_counts(spark, sf_dir):
    return samples.label_counts(_sites(spark, sf_dir), _genome(spark, sf_dir))


def _lines(spark, sf_dir):
    return fx.fasta_lines(spark, sf_dir)


def q_encode_nfirst(spark, sf_dir):
    return _lines(spark, sf_dir).select(
        "line_no", F.length("bases").cast("bigint").alias("n"), F.md5(encode("bases", "nfirst")).alias("codes_md5"))


def q_encode_afirst(spark, sf_dir):
    return _lines(spark, sf_dir).select(
        "line_no", F.length("bases").cast("bigint").alias("n"),
        F.md5(encode("bases", "afirst", mode="to_n")).alias("codes_md5"))


def q_reverse_complement(spark, sf_dir):
    return _lines(spark, sf_dir).select("line_no", F.md5(reverse_complement("bases")).alias("rc_md5"))


def q_reverse_complement_codes(spark, sf_dir):
    """The integer form: as digits and as an array, on the codes of each line."""
    codes = _lines(spark, sf_dir).select("line_no", encode("bases", "nfirst").alias("codes"))
    digits = reverse_complement_codes("codes")
    array = F.array_join(reverse_complement_array(digits_to_array("codes")), "")
    return codes.select("line_no", F.md5(digits).alias("digits_md5"), F.md5(array).alias("array_md5"))


def q_kmers(spark, sf_dir):
    k = kmers("bases", P.KMER_K, P.KMER_LEFT, P.KMER_RIGHT, P.KMER_STEP)
    return _lines(spark, sf_dir).select("line_no", F.size(k).cast("bigint").alias("n_kmers"),
                                        F.md5(F.concat_ws(",", k)).alias("kmers_md5"))


def q_kmer_counts(spark, sf_dir):
    return gn.kmer_counts(_genome(spark, sf_dir), P.KMER_K, P.KMER_LEFT, P.KMER_RIGHT, P.KMER_STEP)


def q_kmer_counts_by_key(spark, sf_dir):
    """By contig, and by the parity of the contig's number."""
    g = _genome(spark, sf_dir)
    number = F.substring("chrom", 4, 9).cast("int") % 2
    keys = g.contigs.select("chrom", F.col("chrom").alias("key")).unionByName(
        g.contigs.select("chrom", F.when(number == 0, "even").otherwise("odd").alias("key")))
    return gn.kmer_counts(g, P.KMER_K, P.KMER_LEFT, P.KMER_RIGHT, P.KMER_STEP, keys=keys)


def _r6(c):
    return F.round(c, 6)


def _logits(spark, sf_dir) -> DataFrame:
    """pred3, one row per model: its logits ``lp`` and, as a second pass, those
    of the model after it ``lq`` (arrays of scalars picked from the vector)."""
    def of(m):
        return F.array(*class_logits("z", m))

    models = F.transform(F.sequence(F.lit(0), F.lit(P.N_MODELS - 1)), lambda m: F.struct(
        m.alias("model"), of(m).alias("lp"), of(F.pmod(m + 1, F.lit(P.N_MODELS))).alias("lq")))
    return fx.pred3(spark, sf_dir).select("vec_id", "label", F.inline(models))


def _probs(spark, sf_dir) -> DataFrame:
    """Rows with a kept label (P2), one per model: probabilities."""
    return labels.drop_ignored(_logits(spark, sf_dir)).select("vec_id", "label", "model", softmax("lp").alias("p"))


def _ovr(spark, sf_dir, rounded=True) -> DataFrame:
    """F12 one-vs-rest rows (vec_id, model, class, label, score)."""
    rows = one_vs_rest("label", {"donor": F.element_at("p", 2), "acceptor": F.element_at("p", 3)},
                       {"donor": labels.DONOR, "acceptor": labels.ACCEPTOR})
    d = (_probs(spark, sf_dir).select("vec_id", "model", rows.alias("_r"))
         .select("vec_id", "model", F.inline("_r")))
    # Rounding names its input many times: behind the explode that is a column.
    return d.withColumn("score", round_half_precision("score")) if rounded else d


def q_softmax_scores(spark, sf_dir):
    d = _probs(spark, sf_dir)
    return d.select("vec_id", F.col("model").cast("bigint").alias("model"),
                    *[_r6(F.element_at("p", i + 1)).alias(f"p{i}") for i in range(3)])


def q_half_precision(spark, sf_dir):
    return fx.scored(spark, sf_dir).select("event_id", round_half_precision("score").alias("half"))


def q_one_vs_rest(spark, sf_dir):
    return _ovr(spark, sf_dir).select("vec_id", F.col("model").cast("bigint").alias("model"), "class",
                                      F.col("label").cast("bigint").alias("label"), "score")


def q_center_slice(spark, sf_dir):
    c = center_slice("z", P.CENTER_FLANK, P.CENTER_WINDOW, True)
    return labels.drop_ignored(fx.pred3(spark, sf_dir)).select(
        "vec_id", F.size(c).cast("bigint").alias("n_kept"),
        _r6(F.aggregate(c, F.lit(0.0).cast("double"), lambda a, x: a + x)).alias("center_sum"))


def _topk_out(df, keys):
    return df.select(*keys, F.col("n").cast("bigint").alias("n"), F.col("n_pos").cast("bigint").alias("n_pos"),
                     _r6("threshold").alias("threshold"), _r6("topk_precision").alias("topk_precision"))


def q_topk_precision(spark, sf_dir):
    t = metrics.topk_precision(_ovr(spark, sf_dir), ["model", "class"])
    return _topk_out(t.withColumn("model", F.col("model").cast("bigint")), ["model", "class"])


def q_topk_precision_scored(spark, sf_dir):
    s = fx.scored(spark, sf_dir).withColumn("score", round_half_precision("score"))
    t = metrics.topk_precision(s, [])
    return _topk_out(t, [])


def q_average_precision(spark, sf_dir):
    a = metrics.average_precision(_ovr(spark, sf_dir), ["model", "class"])
    return a.select(F.col("model").cast("bigint").alias("model"), "class", F.col("n").cast("bigint").alias("n"),
                    F.col("n_pos").cast("bigint").alias("n_pos"), _r6("average_precision").alias("average_precision"))


def q_average_precision_scored(spark, sf_dir):
    s = fx.scored(spark, sf_dir).withColumn("score", round_half_precision("score"))
    a = metrics.average_precision(s, [], ranges=P.RANGES)
    return a.select(F.col("n").cast("bigint").alias("n"), F.col("n_pos").cast("bigint").alias("n_pos"),
                    _r6("average_precision").alias("average_precision"))


def q_ensemble_topk(spark, sf_dir):
    o = _ovr(spark, sf_dir, rounded=False)
    e = metrics.ensemble_mean(o, ["vec_id", "class"]).withColumn("score", round_half_precision("score"))
    t = metrics.topk_precision(e, ["class"])
    a = metrics.average_precision(e, ["class"])
    return (t.select("class", _r6("topk_precision").alias("topk_precision"))
            .join(a.select("class", _r6("average_precision").alias("average_precision")), "class"))


def q_seed_summary(spark, sf_dir):
    t = metrics.topk_precision(_ovr(spark, sf_dir), ["model", "class"])
    s = metrics.seed_summary(t, ["class"], "topk_precision")
    return s.select("class", "n_runs", _r6("mean").alias("mean"), _r6("sd_samp").alias("sd_samp"),
                    _r6("sd_pop").alias("sd_pop"))


def _model_rows(df, *cols):
    return df.select(F.col("model").cast("bigint").alias("model"), *cols)


def q_cross_entropy(spark, sf_dir):
    c = metrics.cross_entropy(_logits(spark, sf_dir), "lp", keys=["model"])
    return _model_rows(c, _r6("cross_entropy").alias("cross_entropy"), "n")


def q_symmetric_kl(spark, sf_dir):
    k = metrics.symmetric_kl(_logits(spark, sf_dir), "lp", "lq", keys=["model"])
    return _model_rows(k, _r6("symmetric_kl").alias("symmetric_kl"), "n")


def q_combined_loss(spark, sf_dir):
    c = metrics.combined_loss(_logits(spark, sf_dir), "lp", "lq", P.KL_WEIGHT, keys=["model"])
    return _model_rows(c, *[_r6(x).alias(x) for x in ("cross_entropy", "symmetric_kl", "loss")])


def _targets(spark, sf_dir):
    a = fx.activity(spark, sf_dir)
    return a.select(F.expr("stack(2, 'dev', dev, dev_pred, 'hk', hk, hk_pred) as (target, y, p)"))


def q_pearson(spark, sf_dir):
    r = metrics.pearson(_targets(spark, sf_dir), "y", "p", ["target"])
    return r.select("target", "n", _r6("pearson").alias("pearson"))


def q_spearman(spark, sf_dir):
    r = metrics.spearman(_targets(spark, sf_dir), "y", "p", ["target"])
    return r.select("target", "n", _r6("spearman").alias("spearman"))


def q_spearman_nulls(spark, sf_dir):
    """Incomplete pairs: every seventh y and every eleventh p is NULL."""
    a = fx.activity(spark, sf_dir)
    y = F.when(F.col("l_orderkey") % 7 != 0, F.col("dev"))
    p = F.when(F.col("l_orderkey") % 11 != 0, F.col("dev_pred"))
    r = metrics.spearman(a.select("l_linenumber", y.alias("y"), p.alias("p")), "y", "p", ["l_linenumber"], ranges=P.RANGES)
    return r.select(F.col("l_linenumber").cast("bigint").alias("line"), "n", _r6("spearman").alias("spearman"))


def q_mse(spark, sf_dir):
    m = metrics.mse(fx.activity(spark, sf_dir), {"dev": ("dev", "dev_pred"), "hk": ("hk", "hk_pred")})
    return m.select(*[_r6(c).alias(c) for c in ("mse_dev", "mse_hk", "mse_total")])


def q_trailing_mean(spark, sf_dir):
    t = runs.trailing_mean(fx.epoch_log(spark, sf_dir), "run_id", "epoch", "val_score", P.TRAILING_N)
    return t.select("run_id", F.col("epoch").cast("bigint").alias("epoch"),
                    _r6("trailing_mean").alias("trailing_mean"))


def q_trailing_mean_100(spark, sf_dir):
    """The default width."""
    t = runs.trailing_mean(fx.epoch_log(spark, sf_dir), "run_id", "epoch", "val_score")
    return t.select("run_id", F.col("epoch").cast("bigint").alias("epoch"), F.round("trailing_mean", 12).alias("trailing_mean"))


def _best_out(b):
    return b.select("run_id", F.col("stop_epoch").cast("bigint").alias("stop_epoch"), "n_epochs",
                    F.col("best_epoch").cast("bigint").alias("best_epoch"), _r6("best_score").alias("best_score"))


def q_best_epoch(spark, sf_dir):
    return _best_out(runs.best_epoch(fx.epoch_log(spark, sf_dir), "enhancer"))


def q_best_epoch_splice(spark, sf_dir):
    return _best_out(runs.best_epoch(fx.epoch_log(spark, sf_dir), "splice"))


def q_test_at_best(spark, sf_dir):
    log = fx.epoch_log(spark, sf_dir)
    t = runs.test_at_best(log, runs.best_epoch(log, "enhancer"))
    return t.select("run_id", F.col("epoch").cast("bigint").alias("epoch"), _r6("val_score").alias("val_score"))


def q_shuffle_batches(spark, sf_dir):
    b = splits.shuffle_batches(_split_tiles(spark, sf_dir), P.BATCH_SIZE, P.SEED, P.EPOCH)
    return b.select("gene", "tile", "split", "batch_id", "batch_pos")


def _annotation_files(spark, sf_dir):
    """The annotation as tab files, lines by contig, start and name."""
    path = _scratch(spark, "annotation")
    a = fx.annotation(spark, sf_dir)
    order = ["chrom", "tx_start", "gene"]
    a.repartitionByRange(4, *order).sortWithinPartitions(*order).write.option("sep", "\t").option("quote", "").option("emptyValue", "").csv(path)
    return path


def q_shuffle_batches_file_order(spark, sf_dir):
    """Validation and test windows in the order of the annotation's lines."""
    genes = files.read_annotation(spark, _annotation_files(spark, sf_dir), line_order=True)
    t = splits.assign_split(windows.tile(genes, P.WINDOW), P.TEST_CHROMS, P.NUM_VAL_GENES, P.SEED)
    b = splits.shuffle_batches(t, P.ORDER_BATCH, P.SEED, P.EPOCH)
    return b.select("gene", "tile", "split", "line_no", "batch_id", "batch_pos")


def q_sample_fraction(spark, sf_dir):
    s = splits.sample_fraction(_tiles(spark, sf_dir), P.SAMPLE_FRACTION, P.SEED)
    return s.select("gene", "tile")


# Files and sinks: a table is written as files of the format, read back by the
# operator, and compared with the table.

def _scratch(spark, name):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _fasta_files(spark, sf_dir):
    """The contigs as FASTA text, lines in order."""
    lines = fx.fasta_lines(spark, sf_dir)
    headers = lines.select("chrom").distinct().select("chrom", F.lit(-1).alias("line_no"), F.concat(F.lit(">"), "chrom", F.lit(" contig")).alias("bases"))
    path = _scratch(spark, "fasta")
    (lines.unionByName(headers).repartition("chrom").sortWithinPartitions("chrom", "line_no").select(F.col("bases").alias("value"))
     .write.text(path))
    return path


def q_read_fasta_lines(spark, sf_dir):
    d = files.read_fasta_lines(spark, _fasta_files(spark, sf_dir))
    # Lines keep their order; empty ones are no lines.
    n = F.row_number().over(Window.partitionBy("chrom").orderBy("line_no"))
    return d.select("chrom", n.cast("bigint").alias("n"), F.md5("bases").alias("bases_md5"))


def q_read_fasta_blocks(spark, sf_dir):
    """The same contigs as block-compressed files."""
    path = _scratch(spark, "blocks")
    blocks.write_blocks(spark.read.text(_fasta_files(spark, sf_dir)), path)
    d = files.read_fasta_lines(spark, path)
    n = F.row_number().over(Window.partitionBy("chrom").orderBy("line_no"))
    return d.select("chrom", n.cast("bigint").alias("n"), F.md5("bases").alias("bases_md5"))


def q_read_fasta_records(spark, sf_dir):
    d = files.read_fasta_records(spark, _fasta_files(spark, sf_dir))
    return d.select("name", F.length("bases").cast("bigint").alias("length"), F.md5("bases").alias("bases_md5"))


def q_read_fasta_pieces(spark, sf_dir):
    """Records of any length, in pieces."""
    d = files.read_fasta_pieces(spark, _fasta_files(spark, sf_dir), P.PIECE)
    return d.select("name", "piece", "start", "length", F.md5("bases").alias("bases_md5"))


def q_read_equal_records(spark, sf_dir):
    """Lines cut to one length, as records that must be equally long."""
    lines = _lines(spark, sf_dir).where(F.length("bases") >= 40)
    path = _scratch(spark, "equal")
    (lines.repartitionByRange("line_no").sortWithinPartitions("line_no")
     .select(F.concat(F.lit(">s"), "line_no", F.lit("\n"), F.substring("bases", 1, 25), F.lit("\n"), F.substring("bases", 26, 15)).alias("value")).write.text(path))
    d = files.read_fasta_records(spark, path, equal_lengths=True)
    return d.select("name", F.length("bases").cast("bigint").alias("length"), F.md5("bases").alias("bases_md5"))


def _groups(spark, sf_dir):
    lines = fx.fasta_lines(spark, sf_dir).where("bases <> ''")
    return lines.select("line_no", F.concat(F.lit("g"), (F.col("line_no") % 2).cast("string")).alias("group"), "bases",
                        (F.length("bases") / 2).cast("float").alias("dev"), (F.col("line_no") % 97).cast("float").alias("hk"))


def _activity_files(spark, sf_dir):
    d = _groups(spark, sf_dir)
    rows = d.select("group", "line_no", F.concat_ws("\t", "line_no", "dev", "hk").alias("value"))
    head = d.select("group").distinct().select("group", F.lit(-1).alias("line_no"), F.lit("id\tDev_log2_enrichment\tHk_log2_enrichment").alias("value"))
    path = _scratch(spark, "activity")
    (rows.unionByName(head).repartition("group").sortWithinPartitions("group", "line_no").select("group", "value")
     .write.partitionBy("group").text(path))
    return path


def q_read_activity(spark, sf_dir):
    d = files.read_activity(spark, _activity_files(spark, sf_dir))
    return d.select("group", "ordinal", F.col("y_dev").cast("double").alias("y_dev"), F.col("y_hk").cast("double").alias("y_hk"))


def q_positional_join(spark, sf_dir):
    """Records and activity rows of two groups, each with its own ordinals."""
    d = _groups(spark, sf_dir).select("group", "line_no", F.concat(F.lit(">s"), "line_no", F.lit("\n"), "bases").alias("value"))
    path = _scratch(spark, "records")
    (d.repartition("group").sortWithinPartitions("group", "line_no").select("group", "value").write.partitionBy("group").text(path))
    rec = files.read_fasta_records(spark, path).drop("_file")
    act = files.read_activity(spark, _activity_files(spark, sf_dir)).drop("_file")
    j = files.positional_join(rec, act, group="group")
    return j.select("group", "ordinal", "name", F.md5("bases").alias("bases_md5"), F.col("y_dev").cast("double").alias("y_dev"))


def q_read_annotation(spark, sf_dir):
    path = _scratch(spark, "annotation")
    a = fx.annotation(spark, sf_dir)
    a.write.option("sep", "\t").option("quote", "").option("emptyValue", "").csv(path)
    return files.read_annotation(spark, path, raw=True).select(
        "gene", F.col("paralog").cast("bigint").alias("paralog"), "chrom", "strand", "tx_start", "tx_end", "jn_start", "jn_end")


def q_materialize(spark, sf_dir):
    """Built once, then found: the second builder is never called."""
    root, source = _scratch(spark, "prepared"), f"{sf_dir.rstrip('/')}/orders.parquet"
    sinks.materialize(lambda: _tiles(spark, sf_dir), spark, root, source, {"window": P.WINDOW})

    def again():
        raise AssertionError("the prepared data set was not found")

    return sinks.materialize(again, spark, root, source, {"window": P.WINDOW}).select("gene", "tile", "start")


def q_write_encoded_sequences(spark, sf_dir):
    path = _scratch(spark, "encoded")
    lines = _lines(spark, sf_dir).select("line_no", encode("bases", "nfirst").alias("codes"))
    sinks.write_encoded_sequences(lines, path, "codes")
    d = spark.read.parquet(path)
    return d.select("line_no", F.size("codes").cast("bigint").alias("n"), F.md5(F.array_join("codes", "")).alias("codes_md5"))


def q_write_predictions(spark, sf_dir):
    log = fx.epoch_log(spark, sf_dir)
    path = _scratch(spark, "predictions")
    preds = log.select("run_id", "epoch", F.col("val_score").alias("dev"), (F.col("val_score") * 2).alias("dev_preds"),
                       F.col("epoch").cast("double").alias("hk"), F.lit(1.5).alias("hk_preds"))
    # Epochs after a run's stop do not exist.
    stops = runs.best_epoch(log, "enhancer").select("run_id", "stop_epoch")
    seen = runs.epoch_progress(log).join(stops, "run_id").where("stop_epoch is null or epoch <= stop_epoch")
    sinks.write_predictions(preds, seen, path)
    d = spark.read.parquet(path)
    return d.select(F.col("run_id").cast("bigint").alias("run_id"), F.col("epoch").cast("bigint").alias("epoch"),
                    *[_r6(F.col(c).cast("double")).alias(c) for c in ("dev", "dev_preds", "hk", "hk_preds")])


def q_append_metrics(spark, sf_dir):
    """Two batches; the first is appended twice, as by a retried job."""
    log = fx.epoch_log(spark, sf_dir)
    path = _scratch(spark, "metrics")
    for tag, value in (("valid/score", F.col("val_score")), ("valid/twice", F.col("val_score") * 2), ("valid/score", F.col("val_score"))):
        sinks.append_metrics(log.select(F.pmod("run_id", F.lit(8)).alias("run_id"), F.lit(tag).alias("tag"), value.alias("value"),
                                        F.col("epoch").alias("step")), path, batch=tag.replace("/", "-"))
    d = sinks.read_metrics(spark, path)
    return (d.groupBy(F.col("run_id").cast("bigint").alias("run_id"), "tag")
            .agg(F.count(F.lit(1)).cast("bigint").alias("n"), _r6(F.sum("value")).alias("total"), F.max("step").alias("last_step")))


# Models of a closed form: what they give can be said in SQL.

def _token_windows(spark, sf_dir, w=None):
    """Windows with their tokens: all tiles, or those of ``w``."""
    if w is None:
        w = windows.window_bounds(_tiles(spark, sf_dir), P.WINDOW, P.FLANK)
    g = samples.token_genome(_genome(spark, sf_dir))
    w = samples.window_sequences(w, g, span=P.WINDOW + 2 * P.FLANK)
    return w.withColumn("tokens", samples.window_tokens("seq", codebook=None))


def _position_model():
    import numpy as np

    return lambda tokens: np.stack([tokens, tokens % 3, np.arange(tokens.shape[1])[None] + 0 * tokens.astype(int)], axis=2).astype(float)


def _sequence_model():
    import numpy as np

    return lambda tokens: np.stack([tokens.astype(float).sum(1), (tokens == 6).sum(1)], axis=1)


def q_score_windows(spark, sf_dir):
    # Genes are dealt out before they are tiled, and windows meet their sites while they are narrow.  What that dealt out
    # goes when the windows are written; from there on only they are dealt, once, to the chunks.
    tiles = windows.tile(_genes(spark, sf_dir).repartition("gene"), P.WINDOW)
    w = samples.join_sites(windows.window_bounds(tiles, P.WINDOW, P.FLANK), _sites(spark, sf_dir), P.WINDOW)
    with shuffles_dropped(spark):
        w = materialize(w)
    w = samples.window_labels(_token_windows(spark, sf_dir, w), None, P.WINDOW)
    s = scoring.score_windows(w, _position_model, P.WINDOW, P.FLANK)
    x = [F.element_at("logits", i + 1) for i in range(3)]
    return (s.groupBy("gene", "tile").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"), F.sum(F.col("label").cast("bigint")).alias("labels"),
        F.sum(x[0] * (F.col("offset") + 1)).cast("bigint").alias("weighted"), F.sum(x[1]).cast("bigint").alias("thirds"),
        F.sum(x[2] - F.col("offset")).cast("bigint").alias("places")))


def q_score_sequences(spark, sf_dir):
    s = scoring.score_sequences(_token_windows(spark, sf_dir), _sequence_model, keys=("gene", "tile"))
    return s.select("gene", "tile", F.col("dev_pred").cast("bigint").alias("total"), F.col("hk_pred").cast("bigint").alias("n_a"))


def q_attach_gene_info(spark, sf_dir):
    bare = _tiles(spark, sf_dir).select("gene", "tile", "start")
    return windows.attach_gene_info(bare, _genes(spark, sf_dir)).select("gene", "tile", "start", "chrom", "strand", "tx_start", "tx_end")


def q_member_of(spark, sf_dir):
    """Tiles on the test chromosomes whose gene has a paralog: one test by a list, one by a table."""
    t = _tiles(spark, sf_dir)
    paralogs = t.where("paralog = 1").select("gene")
    return splits.member_of(splits.member_of(t, "chrom", P.TEST_CHROMS), "gene", paralogs).select("gene", "tile")


def q_distinct_genes(spark, sf_dir):
    return labels.distinct_genes(_tiles(spark, sf_dir))


QUERIES = {
    "read_fasta_lines": q_read_fasta_lines,
    "read_fasta_blocks": q_read_fasta_blocks,
    "read_fasta_records": q_read_fasta_records,
    "read_fasta_pieces": q_read_fasta_pieces,
    "read_equal_records": q_read_equal_records,
    "read_activity": q_read_activity,
    "read_annotation": q_read_annotation,
    "positional_join": q_positional_join,
    "materialize": q_materialize,
    "write_encoded_sequences": q_write_encoded_sequences,
    "write_predictions": q_write_predictions,
    "append_metrics": q_append_metrics,
    "score_windows": q_score_windows,
    "score_sequences": q_score_sequences,
    "attach_gene_info": q_attach_gene_info,
    "member_of": q_member_of,
    "distinct_genes": q_distinct_genes,
    "site_labels": q_site_labels,
    "tiles": q_tiles,
    "exclude_paralogs": q_exclude_paralogs,
    "split_assignment": q_split_assignment,
    "split_summary": q_split_summary,
    "split_leakage": q_split_leakage,
    "window_bounds": q_window_bounds,
    "window_jitter": q_window_jitter,
    "genome_contigs": q_genome_contigs,
    "genome_chunks": q_genome_chunks,
    "fetch_intervals": q_fetch_intervals,
    "fetch_intervals_bordered": q_fetch_intervals_bordered,
    "fetch_clipped": q_fetch_clipped,
    "fetch_repeated": q_fetch_repeated,
    "fetch_long": q_fetch_long,
    "fetch_pruned": q_fetch_pruned,
    "window_sequences": q_window_sequences,
    "window_labels": q_window_labels,
    "window_labels_far": q_window_labels_far,
    "window_tokens": q_window_tokens,
    "splice_motifs": q_splice_motifs,
    "label_counts": q_label_counts,
    "encode_nfirst": q_encode_nfirst,
    "encode_afirst": q_encode_afirst,
    "reverse_complement": q_reverse_complement,
    "reverse_complement_codes": q_reverse_complement_codes,
    "kmers": q_kmers,
    "kmer_counts": q_kmer_counts,
    "kmer_counts_by_key": q_kmer_counts_by_key,
    "softmax_scores": q_softmax_scores,
    "half_precision": q_half_precision,
    "one_vs_rest": q_one_vs_rest,
    "center_slice": q_center_slice,
    "topk_precision": q_topk_precision,
    "topk_precision_scored": q_topk_precision_scored,
    "average_precision": q_average_precision,
    "average_precision_scored": q_average_precision_scored,
    "ensemble_topk": q_ensemble_topk,
    "seed_summary": q_seed_summary,
    "cross_entropy": q_cross_entropy,
    "symmetric_kl": q_symmetric_kl,
    "combined_loss": q_combined_loss,
    "pearson": q_pearson,
    "spearman": q_spearman,
    "spearman_nulls": q_spearman_nulls,
    "mse": q_mse,
    "trailing_mean": q_trailing_mean,
    "trailing_mean_100": q_trailing_mean_100,
    "best_epoch": q_best_epoch,
    "best_epoch_splice": q_best_epoch_splice,
    "test_at_best": q_test_at_best,
    "shuffle_batches": q_shuffle_batches,
    "shuffle_batches_file_order": q_shuffle_batches_file_order,
    "sample_fraction": q_sample_fraction,
}


def flagship(spark, sf_dir):
    """Windows and labelled sites per split: annotation -> site labels ->
    tiles -> split -> per (split, label) counts."""
    genes = _genes(spark, sf_dir)
    tiles = splits.assign_split(windows.tile(genes, P.WINDOW), P.TEST_CHROMS,
                                P.NUM_VAL_GENES, P.SEED)
    sites = labels.site_labels(genes).withColumn("tile", ((F.col("pos") - F.col("tx_start")) / P.WINDOW).cast("bigint"))
    per_split = tiles.select("gene", "tile", "split")
    return (per_split.join(sites.select("gene", "tile", "label"), ["gene", "tile"])
            .groupBy("split", "label")
            .agg(F.count(F.lit(1)).cast("bigint").alias("n_sites"),
                 F.count_distinct("gene", "tile").cast("bigint").alias("n_windows")))
