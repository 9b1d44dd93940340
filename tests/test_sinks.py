"""Clustered predictions and the metric log."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from helixframe.sources import sinks


def predictions(spark, runs=40, epochs=6, rows=5):
    d = spark.range(runs * epochs * rows).select((F.col("id") % runs).alias("run_id"), (F.col("id") / runs % epochs).cast("long").alias("epoch"), F.col("id"))
    d = d.select("run_id", "epoch", *[(F.col("id") + i).cast("double").alias(c) for i, c in enumerate(sinks.PREDICTION_COLUMNS)])
    best = d.select("run_id", "epoch").distinct().withColumn("improved", F.col("epoch") % 2 == 0)
    return d, best


def test_files_do_not_follow_runs_and_epochs(spark, tmp_path):
    d, best = predictions(spark)
    path = str(tmp_path / "p")
    sinks.write_predictions(d, best, path, files=5)
    back = spark.read.parquet(path)
    assert sorted(back.collect()) == sorted(d.where("epoch % 2 = 0").select(back.columns).collect())
    assert len(glob.glob(f"{path}/*.parquet")) == 5 and not [f for f in os.listdir(path) if "=" in f]
    # Each run is in one file or two, and a filter on runs is pushed to the files' statistics.
    named = back.select("run_id", F.input_file_name().alias("file"))
    held = named.groupBy("run_id").agg(F.count_distinct("file").alias("n")).agg(F.max("n")).first()[0]
    assert held <= 2
    assert "GreaterThanOrEqual(run_id,38)" in back.where("run_id >= 38")._jdf.queryExecution().executedPlan().toString()


def test_one_run_of_all_rows_is_cut(spark, tmp_path):
    d, best = predictions(spark, runs=1, epochs=1, rows=4000)
    sinks.write_predictions(d, best, str(tmp_path / "p"), files=4)
    named = spark.read.parquet(str(tmp_path / "p")).select(F.input_file_name().alias("file"))
    sizes = [r["count"] for r in named.groupBy("file").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2000


def test_text_form(spark, tmp_path):
    d, best = predictions(spark, runs=3, epochs=2, rows=1)
    sinks.write_predictions(d, best, str(tmp_path / "p"), format="csv")
    back = spark.read.option("header", True).csv(str(tmp_path / "p"))
    assert back.columns == ["run_id", "epoch", *sinks.PREDICTION_COLUMNS] and back.count() == 3


def rows_of(spark, path):
    return sorted((r["run_id"], r["tag"], r["value"], r["step"], r["batch"]) for r in sinks.read_metrics(spark, path).collect())


def test_a_batch_appended_twice_is_there_once(spark, tmp_path):
    path = str(tmp_path / "log")
    one = spark.createDataFrame([("r1", "valid/d_acc", 0.5, 1), ("r2", "valid/d_acc", 0.25, 1), ("r1", "valid/d_acc", 0.5, 1)],
                                "run_id string, tag string, value double, step long")
    two = one.withColumn("step", F.col("step") + 1)
    sinks.append_metrics(one, path, batch="007")
    sinks.append_metrics(two, path, batch="8")
    before = rows_of(spark, path)
    assert len(before) == 6 and {r[4] for r in before} == {"007", "8"}
    sinks.append_metrics(one, path, batch="007")  # a retried job
    assert rows_of(spark, path) == before
    sinks.append_metrics(one.limit(0), path, batch="9")
    assert rows_of(spark, path) == before
    with pytest.raises(ValueError, match="batch"):
        sinks.append_metrics(one, path, batch="a/b")


def test_a_failed_append_leaves_the_batch_as_it_was(spark, tmp_path):
    path = str(tmp_path / "log")
    one = spark.createDataFrame([(1, "t", 0.5, 1)], "run_id long, tag string, value double, step long")
    sinks.append_metrics(one, path, batch="b")
    broken = one.withColumn("value", F.when(F.col("value") > 9, F.col("value")).otherwise(F.raise_error(F.lit("lost")).cast("double")))
    with pytest.raises(Exception, match="lost"):
        sinks.append_metrics(broken, path, batch="b")
    assert rows_of(spark, path) == [(1, "t", 0.5, 1, "b")]
