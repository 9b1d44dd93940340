
import random

import numpy as np
from pyspark.sql import functions as F

from helixframe.functions.sequence import encode, to_tokens
from helixframe.operators import metrics, runs, scoring
from helixframe.sources import files, sinks


def test_enhancer_track(spark, tmp_path):
    rnd = random.Random(5)
    seqs = ["".join(rnd.choice("ACGTN") for _ in range(40)) for _ in range(60)]
    (tmp_path / "seqs.fa").write_text("".join(f">s{i}\n{s[:25]}\n{s[25:]}\n" for i, s in enumerate(seqs)))
    gc = [sum(c in "GC" for c in s) / len(s) for s in seqs]
    body = "".join(f"s{i}\t{g * 4:.4f}\t{1 - g:.4f}\n" for i, g in enumerate(gc))
    (tmp_path / "act.tsv").write_text("ID\tDev_log2_enrichment\tHk_log2_enrichment\n" + body)

    rec = files.read_fasta_records(spark, str(tmp_path / "seqs.fa")).drop("_file")
    act = files.read_activity(spark, str(tmp_path / "act.tsv")).drop("_file")
    data = files.positional_join(rec, act).withColumn("tokens", to_tokens(encode("bases", "afirst", "to_n")))

    def factory():
        # closed-form "model": GC share from A-first tokens (C=6, G=7)
        def predict(tok):
            gcf = ((tok[:, 1:-1] == 6) | (tok[:, 1:-1] == 7)).mean(axis=1)
            return np.stack([gcf * 4, 1 - gcf], axis=1)
        return predict

    pred = scoring.score_sequences(data, factory, batch_size=16).join(data.select("ordinal", "y_dev", "y_hk"), "ordinal")
    assert pred.count() == 60
    pr = pred.select(F.expr("stack(2, 'dev', y_dev, dev_pred, 'hk', y_hk, hk_pred) as (target, y, p)"))
    pc = {r["target"]: r["pearson"] for r in metrics.pearson(pr, "y", "p", ["target"]).collect()}
    sc = {r["target"]: r["spearman"] for r in metrics.spearman(pr, "y", "p", ["target"]).collect()}
    assert pc["dev"] > 0.999 and sc["hk"] > 0.999
    m = metrics.mse(pred, {"dev": ("y_dev", "dev_pred"), "hk": ("y_hk", "hk_pred")}).first()
    assert m["mse_total"] < 1e-6

    # early stopping over a per-epoch log of the summed correlations, then the predictions sink
    log = spark.createDataFrame([(0, e, s) for e, s in enumerate([1.2, 1.5, 1.4, 1.3, 1.1, 1.0, 0.9, 0.8, 1.6])],
                                "run_id long, epoch long, val_score double")
    best = runs.best_epoch(log, "enhancer").first()
    assert (best["best_epoch"], best["stop_epoch"]) == (1, 7)  # wait 6 > 5 at epoch 7; epoch 8 never runs
    prog = runs.epoch_progress(log)
    preds = pred.select(F.lit(0).cast("bigint").alias("run_id"), F.lit(1).cast("bigint").alias("epoch"),
                        F.col("y_dev").alias("dev"), F.col("dev_pred").alias("dev_preds"),
                        F.col("y_hk").alias("hk"), F.col("hk_pred").alias("hk_preds"))
    sinks.write_predictions(preds, prog, str(tmp_path / "preds"))
    assert spark.read.parquet(str(tmp_path / "preds")).count() == 60
