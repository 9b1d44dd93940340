"""Run-log analytics: trailing loss mean, early stopping, test at best.

A log has one row per (run, epoch) with 0-based consecutive epochs, some hundreds
of them; the trailing mean over steps, of which a run has any number, is blocked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import bounded_window_mean

# Fixed stopping rules of the two tracks: splice stops at wait >= 20,
# enhancer at wait > 5 (patience 5).
STOP_RULES = {"splice": (">=", 20), "enhancer": (">", 5)}


def trailing_mean(log: DataFrame, run: str = "run_id", step: str = "step", value: str = "loss",
                  n: int = 100, out: str = "trailing_mean") -> DataFrame:
    """Mean of the last ``n`` values (steps step-n+1 .. step) per run.

    [decision] a true trailing mean; the reference's ring buffer is indexed
    by in-epoch step and only matches this once it has filled."""
    return bounded_window_mean(log, [run], step, value, n, out=out)


def epoch_progress(log: DataFrame, run: str = "run_id", epoch: str = "epoch",
                   score: str = "val_score") -> DataFrame:
    """Per row: best score before the epoch, whether it improved (strictly,
    best starts at 0), and the wait since the last improvement.

    NaN never improves: Python's ``nan > best`` is false while Spark orders
    NaN above everything, so NaN is mapped to NULL first.  All values are
    running ones over one run's epochs: one exchange, one sort.  A run has as
    many rows as epochs, some hundreds.
    """
    w = Window.partitionBy(run).orderBy(epoch)
    d = log.withColumn("_s", F.when(~F.isnan(F.col(score)), F.col(score)))
    before = F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("best_before", F.greatest(F.lit(0.0), F.coalesce(before, F.lit(0.0))))
    d = d.withColumn("improved", F.coalesce(F.col("_s") > F.col("best_before"), F.lit(False)))
    last = F.max(F.when(F.col("improved"), F.col(epoch))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("wait", F.coalesce(F.col(epoch) - last, F.col(epoch) + 1).cast("bigint")).drop("_s")


def best_epoch(log: DataFrame, mode: str = "splice", patience: int | None = None,
               run: str = "run_id", epoch: str = "epoch", score: str = "val_score") -> DataFrame:
    """R2: per run, the epoch the loop stops at and the best epoch before it.

    Output: run, stop_epoch (NULL if the log ends first), n_epochs (rows the
    loop would have run), best_epoch, best_score (NULL if nothing improved).
    """
    op, default_p = STOP_RULES[mode]
    p = default_p if patience is None else patience
    d = epoch_progress(log, run, epoch, score)
    stops = F.col("wait") >= p if op == ">=" else F.col("wait") > p
    d = d.withColumn("stop_epoch", F.min(F.when(stops, F.col(epoch))).over(Window.partitionBy(run)))
    kept = d.where(F.col("stop_epoch").isNull() | (F.col(epoch) <= F.col("stop_epoch")))
    return (kept.groupBy(run)
            .agg(F.max("stop_epoch").alias("stop_epoch"),
                 F.count(F.lit(1)).cast("bigint").alias("n_epochs"),
                 F.max(F.when(F.col("improved"), F.col(epoch))).alias("best_epoch"),
                 F.max_by(F.when(F.col("improved"), F.col(score)),
                          F.when(F.col("improved"), F.col(epoch))).alias("best_score")))


def test_at_best(log: DataFrame, best: DataFrame, run: str = "run_id", epoch: str = "epoch") -> DataFrame:
    """The log row of each run's best epoch (both tracks log test
    metrics every epoch); a run without an improvement has NULLs."""
    b = best.select(run, F.col("best_epoch").alias(epoch), "stop_epoch")
    return b.join(log, [run, epoch], "left")
