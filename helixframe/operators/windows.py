"""Tiling, jitter and window bounds.

A window row carries its gene's record (chrom, strand, tx_start, tx_end), so
the gene lookup J4 is done once by the tiling explode instead of per sample.
Window key: (gene, tile).
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GENE_COLS = ["gene", "paralog", "chrom", "strand", "tx_start", "tx_end", "line_no"]  # line_no: if the genes have it


def tile(genes: DataFrame, window: int) -> DataFrame:
    """starts = range(tx_start, tx_end, window); the last tile may overrun.

    ``sequence`` errors when stop < start, so empty transcripts are filtered
    first (Python's range yields nothing for them)."""
    if window <= 0:
        raise ValueError("window must be positive")
    cols = [c for c in GENE_COLS if c in genes.columns]
    return (genes.where(F.col("tx_end") > F.col("tx_start"))
            .select(*cols, F.posexplode(F.sequence("tx_start", F.col("tx_end") - 1,
                                                     F.lit(window).cast("bigint")))
                    .alias("tile", "start"))
            .withColumn("tile", F.col("tile").cast("bigint")))


def hash_uniform_int(key: Column, lo: int, hi: int) -> Column:
    """Deterministic integer in [lo, hi] from the first 32 bits of md5(key).

    Stable under recomputation and re-partitioning, unlike rand()."""
    span = hi - lo + 1
    h = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")
    return (h % F.lit(span) + F.lit(lo)).cast("bigint")


def jitter(windows: DataFrame, shift: int, seed: int = 0, epoch: int = 0,
           split_col: str = "split", train_value: str = "train") -> DataFrame:
    """P5: training windows only: start += uniform integer in [-shift, shift].

    The draw is keyed by (seed, epoch, gene, tile).  Without a split column
    no window is known to be for training: the shift is not applied, with a warning."""
    if shift <= 0:
        return windows
    if split_col not in windows.columns:
        warnings.warn(f"no column {split_col!r}: windows are not shifted; assign splits first", stacklevel=2)
        return windows
    key = F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), F.col("gene"),
                      F.col("tile").cast("string"))
    delta = hash_uniform_int(key, -shift, shift)
    return windows.withColumn(
        "start", F.when(F.col(split_col) == train_value, F.col("start") + delta)
        .otherwise(F.col("start")))


def window_bounds(windows: DataFrame, window: int, flank: int | None = None) -> DataFrame:
    """Clamp and derive the label and sequence ranges of each window.

    start  = max(min(start, tx_end - 1), tx_start - flank + 1)
    end    = start + window;  left = start - flank;  right = end + flank
    label range  [lab_lo, lab_hi) = [start, end) ∩ [tx_start, tx_end), padded with -100
    sequence range [seq_lo, seq_hi) = [left, right) ∩ [tx_start, tx_end), padded with N
    (pads are relative to the transcript, not the chromosome).
    """
    flank = window if flank is None else flank
    s = F.greatest(F.least(F.col("start"), F.col("tx_end") - 1), F.col("tx_start") - flank + 1)
    df = (windows.withColumn("start", s.cast("bigint"))
          .withColumn("end", F.col("start") + window)
          .withColumn("left", F.col("start") - flank)
          .withColumn("right", F.col("end") + flank)
          .withColumn("lab_lo", F.greatest("start", "tx_start"))
          .withColumn("lab_hi", F.least("end", "tx_end"))
          .withColumn("seq_lo", F.greatest("left", "tx_start"))
          .withColumn("seq_hi", F.least("right", "tx_end")))
    # The reference asserts a non-empty label slice; flank > window with a
    # large shift can break it, so fail loudly instead of emitting bad rows.
    return df.withColumn(
        "lab_hi", F.when(F.col("lab_hi") > F.col("lab_lo"), F.col("lab_hi")).otherwise(
            F.raise_error(F.concat(F.lit("empty label range for window of gene "), F.col("gene")))
        ).cast("bigint"))


def attach_gene_info(windows: DataFrame, genes: DataFrame) -> DataFrame:
    """Look up gene records by name for windows that carry only (gene, start).

    A plain equi-join: AQE broadcasts the gene table when its measured size
    is under the threshold and keeps a shuffle join otherwise."""
    cols = [c for c in GENE_COLS if c in genes.columns]
    extra = [c for c in windows.columns if c not in cols or c == "gene"]
    return windows.select(*extra).join(genes.select(*cols), "gene")
