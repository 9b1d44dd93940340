"""
closed-form scorer: every operator output feeds the next one."""

import numpy as np
from pyspark.sql import functions as F

from helixframe.functions.scores import round_half_precision, softmax
from helixframe.operators import genome as gn
from helixframe.operators import labels, metrics, samples, scoring, splits, windows
from helixframe.sources import fixtures as fx

SF = "/root/testdata/sf0.001"
W, FL = 100, 100


def test_splice_track(spark):
    genes = labels.prepare_genes(fx.annotation(spark, SF))
    g = gn.build_genome(fx.fasta_lines(spark, SF), 1024, 512)
    tiles = splits.assign_split(windows.tile(genes, W), num_val_genes=50, seed=1)
    w = windows.window_bounds(windows.jitter(tiles, 7, seed=1), W, FL)
    w = w.where(F.col("split").isin("val", "test"))
    seqs = samples.window_sequences(w, g, span=W + 2 * FL).withColumn("tokens", samples.window_tokens("seq"))
    labs = samples.window_labels(w, labels.site_labels(genes), W)
    sample = seqs.select("gene", "tile", "split", "tokens").join(labs.select("gene", "tile", "labels"),
                                                                 ["gene", "tile"])
    n_windows = sample.count()
    assert n_windows > 0

    def factory():
        def predict(tok):
            out = np.zeros(tok.shape + (3,))
            out[:, :-2, 1] = ((tok[:, 1:-1] == 8) & (tok[:, 2:] == 9)).astype(float)  # ...G T after the base
            out[:, 2:, 2] = ((tok[:, :-2] == 6) & (tok[:, 1:-1] == 8)).astype(float)   # A G before the base
            return out
        return predict

    pos = scoring.score_windows(sample, factory, window=W, flank=FL, batch_size=16)
    assert pos.count() == n_windows * W
    kept = labels.drop_ignored(pos)
    p = softmax("logits")
    ovr = kept.select(F.inline(F.array(
        F.struct(F.lit("donor").alias("class"), (F.col("label") == 1).cast("int").alias("label"),
                 round_half_precision(F.element_at(p, 2)).alias("score")),
        F.struct(F.lit("acceptor").alias("class"), (F.col("label") == 2).cast("int").alias("label"),
                 round_half_precision(F.element_at(p, 3)).alias("score")))))
    t = {r["class"]: r for r in metrics.topk_precision(ovr, ["class"]).collect()}
    a = {r["class"]: r for r in metrics.average_precision(ovr, ["class"]).collect()}
    n_kept = kept.count()
    for c in ("donor", "acceptor"):
        assert t[c]["n"] == n_kept and a[c]["n"] == n_kept
        assert 0.0 <= t[c]["topk_precision"] <= 1.0 and 0.0 <= a[c]["average_precision"] <= 1.0
    # label counts agree between the dense labels and the scored positions
    donors = labs.select(F.sum(F.length("labels") - F.length(F.regexp_replace("labels", "1", "")))).first()[0]
    assert t["donor"]["n_pos"] == donors
