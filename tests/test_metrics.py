import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import metrics, ranking, runs


def test_topk_and_ap_worked_example(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.3), (0, 0.1)], "label int, score double")
    t = metrics.topk_precision(df, []).first()
    assert abs(t["threshold"] - 0.55) < 1e-12 and t["topk_precision"] == 0.5
    a = metrics.average_precision(df, []).first()
    assert abs(a["average_precision"] - 0.833333) < 1e-6


def test_no_positive_gives_nan(spark):
    df = spark.createDataFrame([(0, 0.9), (0, 0.1)], "label int, score double")
    assert math.isnan(metrics.topk_precision(df, []).first()["topk_precision"])
    assert math.isnan(metrics.average_precision(df, []).first()["average_precision"])


def py_topk(labels, scores):
    labels, scores = np.asarray(labels), np.asarray(scores)
    q = np.quantile(scores, 1 - labels.sum() / len(labels))
    return (scores[labels == 1] >= q).sum() / max(1, (scores >= q).sum())


def test_topk_random_against_numpy(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(3):
        n = 2000
        s = np.round(rng.random(n), 3)  # many ties
        lab = (rng.random(n) < 0.1 + 0.2 * k).astype(int)
        rows += [(k, int(l), float(x)) for l, x in zip(lab, s)]
    df = spark.createDataFrame(rows, "k int, label int, score double")
    got = {r["k"]: r["topk_precision"] for r in metrics.topk_precision(df, ["k"], ranges=16).collect()}
    for k in range(3):
        sub = [(l, x) for kk, l, x in rows if kk == k]
        assert abs(got[k] - py_topk([l for l, _ in sub], [x for _, x in sub])) < 1e-12


def test_value_ranks_exact_for_any_bucket_count(spark):
    rng = np.random.default_rng(1)
    vals = rng.integers(0, 50, 3000)
    df = spark.createDataFrame([(int(v),) for v in vals], "v long")
    for b in (1, 7, 64):
        got = {r["value"]: r["cnt_before"] for r in ranking.value_ranks(df, [], "v", None, b).collect()}
        assert got == {int(v): int((vals < v).sum()) for v in np.unique(vals)}


@pytest.mark.parametrize("ranges", [1, 5, 24])
def test_ranks_in_place(spark, ranges):
    """Weights before, at and over all of a value, for values that fill many ranges, NaN, a NULL key and a key of one row."""
    rng = np.random.default_rng(8)
    rows = [(k, float(v), i, int(w)) for i, (k, v, w) in enumerate(zip(rng.choice(["a", "b"], 900), rng.choice([1.0, 2.0, 2.0, 2.0, 2.0, 5.5, float("nan")], 900),
                                                                       rng.integers(0, 4, 900), strict=True))]
    rows += [(None, 3.0, 1000, 2), (None, 1.0, 1001, 1), ("c", -1.0, 1002, 7)]
    df = spark.createDataFrame(rows, "k string, v double, id long, w long").withColumn("u", F.lit(1))
    got = ranking.rank_in_place(df, ["k"], "v", ["w", "u"], ["id"], ranges=ranges).collect()
    place = lambda v: (math.isnan(v), 0.0 if math.isnan(v) else v)
    assert len(got) == len(rows)
    for r in got:
        mine = [(place(v), w) for k, v, _, w in rows if k == r["k"]]
        here = place(r["v"])
        assert (r["w_before"], r["w_here"], r["w_all"]) == (sum(w for v, w in mine if v < here), sum(w for v, w in mine if v == here), sum(w for _, w in mine))
        assert (r["u_before"], r["u_here"], r["u_all"]) == (sum(v < here for v, _ in mine), sum(v == here for v, _ in mine), len(mine))


def test_spearman_of_a_hot_value(spark):
    """A value that most pairs share is cut over the ranges, and no join is on a value."""
    rng = np.random.default_rng(4)
    x = np.where(rng.random(3000) < 0.7, 1.0, np.round(rng.random(3000), 2))
    y = np.round(rng.random(3000) + x, 3)
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "x double, y double")
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    s = metrics.spearman(df, "x", "y", ranges=9)
    assert abs(s.first()["spearman"] - np.corrcoef(rank(x), rank(y))[0, 1]) < 1e-12
    joins = [line for line in s._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert joins and not any("_x#" in j or "_y#" in j for j in joins)


def test_spearman_worked_example(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (2.0, 2.0), (3.0, 4.0)], "x double, y double")
    assert abs(metrics.spearman(df, "x", "y").first()["spearman"] - 0.948683) < 1e-6


def test_spearman_incomplete_pairs_and_nan(spark):
    """Pairs with a NULL are left out before ranking; a NaN gives NaN."""
    rows = [("a", 1.0, 1.0), ("a", 2.0, 3.0), ("a", 3.0, None), ("a", 4.0, 2.0), ("a", 5.0, 5.0), ("b", 1.0, float("nan")), ("b", 2.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    got = {r["k"]: (r["n"], r["spearman"]) for r in metrics.spearman(df, "x", "y", ["k"]).collect()}
    assert got["a"][0] == 4 and abs(got["a"][1] - 0.8) < 1e-12 and math.isnan(got["b"][1])


def test_labels_other_than_0_and_1_raise(spark):
    df = spark.createDataFrame([(2, 0.5), (1, 0.1)], "label int, score double")
    with pytest.raises(Exception, match="labels must be 0 or 1"):
        metrics.topk_precision(df, []).collect()


def test_infinite_logits_and_weight_zero(spark):
    """Weight 0 switches the consistency term off even where it is infinite."""
    inf = float("inf")
    df = spark.createDataFrame([(0, [0.0, -inf, -inf], [-inf, 0.0, -inf])], "label int, lp array<double>, lq array<double>")
    assert metrics.combined_loss(df, "lp", "lq", 0.0).first()["loss"] == 0.0


def test_pearson_constant_is_nan(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 3.0)], "x double, y double")
    assert math.isnan(metrics.pearson(df, "x", "y").first()["pearson"])


def test_symmetric_kl_worked_example(spark):
    p = [math.log(x) for x in (0.5, 0.25, 0.25)]
    q = [math.log(x) for x in (0.25, 0.5, 0.25)]
    df = spark.createDataFrame([(0, p, q)], "label int, lp array<double>, lq array<double>")
    assert abs(metrics.symmetric_kl(df, "lp", "lq").first()["symmetric_kl"] - 0.346574) < 1e-6
    c = metrics.combined_loss(df, "lp", "lq", 0.0).first()
    assert abs(c["loss"] - (-math.log(0.5))) < 1e-9


def log(spark, scores, run=1):
    return spark.createDataFrame([(run, i, s) for i, s in enumerate(scores)],
                                 "run_id long, epoch long, val_score double")


def test_best_epoch_worked_examples(spark):
    b = runs.best_epoch(log(spark, [0.5, 0.6, 0.6, 0.55, 0.7]), "enhancer", patience=1).first()
    assert (b["best_epoch"], b["stop_epoch"], b["n_epochs"]) == (1, 3, 4)
    nan = float("nan")
    b = runs.best_epoch(log(spark, [nan, nan, 0.4]), "enhancer").first()
    assert b["best_epoch"] == 2 and b["stop_epoch"] is None


def test_running_helpers_across_blocks(spark):
    vals = [float(x) for x in np.random.default_rng(2).random(700)]
    d = log(spark, vals)
    r = runs.trailing_mean(d, "run_id", "epoch", "val_score", n=100).orderBy("epoch").collect()
    want = [np.mean(vals[max(0, i - 99):i + 1]) for i in range(len(vals))]
    assert np.allclose([x["trailing_mean"] for x in r], want)
    m = ranking.running(d, ["run_id"], "epoch", "val_score", "max", inclusive=False, block=64).orderBy("epoch").collect()
    assert m[0]["running_max_val_score"] is None
    assert np.allclose([x["running_max_val_score"] for x in m[1:]], np.maximum.accumulate(vals)[:-1])


def test_seed_summary(spark):
    df = spark.createDataFrame([("d", 1.0), ("d", 3.0)], "c string, v double")
    r = metrics.seed_summary(df, ["c"], "v").first()
    assert r["mean"] == 2.0 and abs(r["sd_samp"] - math.sqrt(2)) < 1e-12 and r["sd_pop"] == 1.0
