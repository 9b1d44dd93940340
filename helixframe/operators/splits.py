"""Leak-free splits, shuffled batches and sampling.

Random draws are keyed hashes (md5 of seed and row key) instead of rand():
they are identical on recomputation after an executor loss, on any number
of partitions, and in DuckDB, which makes them checkable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .labels import distinct_genes

# Fixed value: the reference's test chromosomes.
DEFAULT_TEST_CHROMS = ("chr1", "chr3", "chr5", "chr7", "chr9")


MAX_BROADCAST_GENES = 100_000


def member_of(df: DataFrame, col: str, values, anti: bool = False) -> DataFrame:
    """``np.isin`` — a literal list uses ``isin``; a DataFrame of keys
    uses a left-semi (or left-anti) join, which never duplicates rows."""
    if isinstance(values, DataFrame):
        keys = values.select(F.col(values.columns[0]).alias(col)).distinct()
        return df.join(keys, col, "left_anti" if anti else "left_semi")
    cond = F.col(col).isin(list(values))
    return df.where(~cond if anti else cond)


def draw_genes(pool: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Draw ``n`` genes without replacement: the n smallest md5(seed:gene).

    Runs as a distributed top-n (each task keeps n rows), so the result is
    bounded by ``n`` whatever the pool size."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("gene")))
    return pool.select("gene", key.alias("_h")).orderBy("_h", "gene").limit(n).select("gene")


def assign_split(windows: DataFrame, test_chroms=DEFAULT_TEST_CHROMS,
                 num_val_genes: int = 1000, seed: int = 0, check: bool = True) -> DataFrame:
    """Add ``split`` = test / val / train / NULL.

    test  = chrom in test_chroms and paralog = 0
    val   = every window of num_val_genes genes drawn from non-test, paralog-0 genes
    train = non-test chromosome, not val (paralogs allowed)
    Paralog windows on test chromosomes belong to no split.
    A pool smaller than the draw is an error: with ``check`` the size of the
    draw is a subquery of the result's own plan, which raises when it runs.
    """
    is_test = F.col("chrom").isin(list(test_chroms))
    pool = distinct_genes(windows.where(~is_test & (F.col("paralog") == 0)))
    val = draw_genes(pool, num_val_genes, seed)
    # The draw holds at most num_val_genes rows; a small number is broadcast,
    # with a larger one the planner joins by gene.
    val = val.withColumn("_val", F.lit(True))
    if num_val_genes <= MAX_BROADCAST_GENES:
        val = F.broadcast(val)
    split = (F.when(is_test & (F.col("paralog") == 0), F.lit("test"))
             .when(is_test, F.lit(None).cast("string"))
             .when(F.col("_val"), F.lit("val"))
             .otherwise(F.lit("train")))
    out = windows.join(val, "gene", "left").withColumn("split", split).drop("_val")
    if check:
        got = draw_genes(pool, num_val_genes, seed).agg(F.count(F.lit(1))).scalar()
        enough = F.when(got >= num_val_genes, F.lit(True)).otherwise(F.raise_error(F.concat(
            F.lit(f"cannot draw {num_val_genes} validation genes from a pool of "), got.cast("string"))).cast("boolean"))
        out = out.where(enough)
    return out


def split_summary(windows: DataFrame) -> DataFrame:
    """Windows and distinct genes per (split, chrom)."""
    return (windows.groupBy("split", "chrom")
            .agg(F.count(F.lit(1)).cast("bigint").alias("n_windows"),
                 F.count_distinct("gene").cast("bigint").alias("n_genes")))


# Ranking buckets: the first BUCKET_HEX hex digits of an md5 key.  md5 is
# uniform, so buckets are equal in size without sampling; 16^4 = 65536
# buckets keep each in-bucket sort at rows/65536 (the bucket-size table
# stays at most 65536 rows per split).
BUCKET_HEX = 4


# Lines of an annotation that share a bucket of the file order.
ORDER_BLOCK = 1024


def shuffle_batches(windows: DataFrame, batch_size: int, seed: int = 0, epoch: int = 0,
                    split_col: str = "split", key_cols=("gene", "tile"),
                    shuffle_values=("train",), order_col: str = "line_no") -> DataFrame:
    """Order each split and cut it into batches of ``batch_size``.

    Training rows are ordered by md5(seed:epoch:key) (a fresh permutation per
    epoch).  Other splits keep the order of the input: the number of the gene's
    line in the annotation (``order_col``, from ``read_annotation(line_order=True)``), then
    the key.  Windows without that column are ordered by md5(gene), then the
    key, which also keeps the tiles of a gene together.  The last batch may be
    partial.  Windows of no split (NULL) belong to no loader and are left out.
    Adds ``batch_id`` and ``batch_pos``.

    The global rank is computed without a single-task window: rows are
    bucketed by the first hex digits of their hash or by ``ORDER_BLOCK`` lines of
    the file, bucket sizes (at most 65536 rows for a shuffled split, one for each
    block of lines for an ordered one) get running offsets, and rows
    are numbered inside their bucket only.
    """
    windows = windows.where(F.col(split_col).isNotNull())
    kc = [F.col(c).cast("string") for c in key_cols]
    shuffled = F.col(split_col).isin(list(shuffle_values))
    drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), *kc))
    by_hash = lambda h: F.conv(F.substring(h, 1, BUCKET_HEX), 16, 10).cast("bigint")
    if order_col in windows.columns:
        df = windows.withColumn("_h", F.when(shuffled, drawn)).withColumn("_o", F.when(~shuffled, F.col(order_col)))
        df = df.withColumn("_b", F.coalesce(by_hash(F.col("_h")), F.expr(f"_o div {ORDER_BLOCK}")))
    else:
        df = windows.withColumn("_h", F.when(shuffled, drawn).otherwise(F.md5(F.col("gene").cast("string")))).withColumn("_o", F.lit(0))
        df = df.withColumn("_b", by_hash(F.col("_h")))
    order = [F.col("_o"), F.col("_h")] + [F.col(c) for c in key_cols]
    sizes = (df.groupBy(split_col, "_b").agg(F.count(F.lit(1)).alias("_n"))
             .withColumn("_off", F.coalesce(F.sum("_n").over(
                 Window.partitionBy(split_col).orderBy("_b")
                 .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
             .drop("_n"))
    ranked = (df.join(sizes, [split_col, "_b"])
              .withColumn("_r", F.col("_off") - 1 + F.row_number().over(
                  Window.partitionBy(split_col, "_b").orderBy(*order))))
    return (ranked.withColumn("batch_id", (F.col("_r") / batch_size).cast("bigint"))
            .withColumn("batch_pos", (F.col("_r") % batch_size).cast("bigint"))
            .drop("_h", "_o", "_b", "_off", "_r"))


def hash_fraction(key) -> "F.Column":
    """Uniform [0, 1) from the first 32 bits of md5(key)."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def sample_fraction(df: DataFrame, fraction: float, seed: int = 0, key_cols=("gene", "tile")) -> DataFrame:
    """D3: keep a stable ``fraction`` of rows (the 20% shown in the scatter).

    A keyed hash, so the same rows come back on every run and partitioning."""
    key = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in key_cols])
    return df.where(hash_fraction(key) < F.lit(fraction))
