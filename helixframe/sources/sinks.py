"""Sinks: prepared-data cache, encoded sequences, predictions, metric log
(S7-S10).  Every sink writes through the DataFrame writer to a shared file
system path; nothing is collected to the driver.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sequence import digits_to_array

DATASET_VERSION = "0.0.1"


def _fs_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def _fs_files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Path, length and modification time of the file, or of each file below the folder."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    out, it = [], fs.listFiles(p, True)
    while it.hasNext():
        f = it.next()
        out.append((f.getPath().toString(), int(f.getLen()), int(f.getModificationTime())))
    return sorted(out)


def cache_key(spark: SparkSession, source: str, params: dict) -> str:
    """S7 key: the source's files with length and modification time,
    parameters, version."""
    body = json.dumps({"source": source, "files": _fs_files(spark, source),
                       "version": DATASET_VERSION, **params}, sort_keys=True)
    return hashlib.sha1(body.encode()).hexdigest()[:16]


def _rename(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder; False if ``target`` exists (then nothing has changed)."""
    sc = spark.sparkContext
    fs = sc._jvm.org.apache.hadoop.fs
    a, b = fs.Path(source), fs.Path(target)
    none = sc._gateway.new_array(fs.Options.Rename, 0)
    try:
        # FileContext's rename fails if the target exists; FileSystem's would move into it.
        fs.FileContext.getFileContext(a.toUri(), sc._jsc.hadoopConfiguration()).rename(a, b, none)
    except Py4JJavaError as e:
        if _fs_exists(spark, target):
            return False
        raise e
    return True


@contextmanager
def staged(df: DataFrame, path: str) -> Iterator[DataFrame]:
    """``df`` written to ``path`` and read back, for a builder that reads it more than once; dropped at the end."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def publish(spark: SparkSession, root: str, source: str, params: dict, write: Callable[[str], None]) -> str:
    """The folder of a prepared data set below ``root``, written if it is not there yet.

    ``write(path)`` writes all of it to a staging folder, whose name starts with a dot
    so that no reader takes it for data.  A rename then publishes it: the folder of a
    key is there as a whole or not at all.  What a failed builder leaves in its
    staging folder is never read.  Of several builders the first to rename
    wins; the others drop their own copy and return the winner's folder.
    """
    root = root.rstrip("/")
    key = cache_key(spark, source, params)
    path = f"{root}/{key}"
    if _fs_exists(spark, path):
        return path
    staging = f"{root}/.{key}-{uuid.uuid4().hex}"
    write(staging)
    if not _rename(spark, staging, path):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staging)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return path


def materialize(df_builder: Callable[[], DataFrame], spark: SparkSession, root: str, source: str, params: dict,
                partition_by=None) -> DataFrame:
    """Reuse a prepared data set when present, else build and publish it.

    ``df_builder()`` returns the DataFrame to write; the result is read back
    from the written table (lineage cut, survives executor loss).
    """
    def write(path: str) -> None:
        w = df_builder().write
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(path)

    return spark.read.parquet(publish(spark, root, source, params, write))


def write_encoded_sequences(df: DataFrame, path: str, digits_col: str = "tokens",
                            out_col: str | None = None, mode: str = "overwrite") -> None:
    """Encoded sequences as ARRAY<TINYINT> in Parquet (zstd)."""
    out_col = out_col or digits_col
    (df.withColumn(out_col, digits_to_array(digits_col))
     .write.mode(mode).option("compression", "zstd").parquet(path))


PREDICTION_COLUMNS = ("dev", "dev_preds", "hk", "hk_preds")


def write_predictions(preds: DataFrame, best: DataFrame, path: str, run: str = "run_id",
                      epoch: str = "epoch", columns=PREDICTION_COLUMNS, format: str = "parquet",
                      files: int | None = None) -> None:
    """Test-set predictions for the epochs that improved on validation
    (from ``runs.epoch_progress``), clustered by (run, epoch).

    Files hold ranges of (run, epoch), so their number follows the size of the data
    (or ``files``), not the number of runs and epochs, and Parquet's
    column statistics lead a reader of one run to the few files and row groups that
    have it.  ``format="csv"`` writes the same files with a header row, for
    readers that want text and prune nothing.
    """
    improving = best.where(F.col("improved")).select(run, epoch).distinct()
    d = preds.join(improving, [run, epoch], "left_semi").select(run, epoch, *columns)
    # All columns deal, so that a run and epoch with a large share of the rows is cut too.
    order = [run, epoch, *columns]
    d = d.repartitionByRange(files, *order) if files else d.repartitionByRange(*order)
    w = d.sortWithinPartitions(run, epoch).write.mode("overwrite")
    if format == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def append_metrics(metrics: DataFrame, path: str, batch: str, run: str = "run_id") -> None:
    """Append (tag, value, step) metric rows under the name of their ``batch``.

    A batch (an epoch, a job's id) is a partition of the log, replaced as a whole:
    appending it again, after a failure or by a retried job, leaves each of its rows
    there once, and other batches as they are.  A batch of no rows changes nothing.
    Inside a batch rows are sorted by run and tag.
    """
    if not batch or "/" in batch:
        raise ValueError("a batch needs a name without slashes")
    d = metrics.select(run, F.col("tag").cast("string"), F.col("value").cast("double"), F.col("step").cast("bigint"), F.lit(batch).alias("batch"))
    (d.repartitionByRange(run, "tag", "step").sortWithinPartitions(run, "tag", "step")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The metric log: the appended columns and ``batch`` (text)."""
    fields = [f for f in spark.read.parquet(path).schema.fields if f.name != "batch"]
    return spark.read.schema(T.StructType([*fields, T.StructField("batch", T.StringType())])).parquet(path)


def write_training_shards(batches: DataFrame, path: str, shard_batches: int = 256,
                          split_col: str = "split", mode: str = "overwrite") -> None:
    """D2 sink: rows with ``batch_id`` / ``batch_pos`` (from
    ``splits.shuffle_batches``) written as shards of ``shard_batches``
    consecutive batches, one folder per (split, shard), rows in batch order
    inside each file, so a reader streams a shard front to back."""
    d = batches.withColumn("shard", (F.col("batch_id") / shard_batches).cast("bigint"))
    (d.repartition(split_col, "shard")
     .sortWithinPartitions(split_col, "shard", "batch_id", "batch_pos")
     .write.mode(mode).partitionBy(split_col, "shard").parquet(path))
