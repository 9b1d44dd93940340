"""Evaluation metrics as distributed aggregations.

Only metric rows reach the driver.  Ranking metrics go through
``ranking.value_ranks`` (a table of distinct scores with counts before each),
so no key is ever sorted in one task and ties cost one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import log_softmax
from .ranking import rank_in_place, value_ranks


def _nan():
    return F.lit(float("nan"))


def _lerp(a, b, t):
    """numpy's linear interpolation (switches form at t >= 0.5)."""
    d = b - a
    return F.when(t >= 0.5, b - d * (F.lit(1.0) - t)).otherwise(a + d * t)


def topk_precision(df: DataFrame, keys, label: str = "label", score: str = "score",
                   ranges: int | None = None) -> DataFrame:
    """A3: q = linear quantile of the scores at 1 - n_pos/n; value =
    #(positives with score >= q) / max(1, #(score >= q)).  NaN when a key
    has no positive.  Labels must be 0/1.

    The order statistics floor(h) and floor(h)+1, h = (n-1)(1 - n_pos/n),
    are read from the distinct-score table: value v holds ranks
    [cnt_before, cnt_before + cnt).  No score lies between the two, so the
    selection begins at the first of them that is q or more, and what is
    before it is known: one aggregate gives the metric.
    """
    keys = list(keys)
    r = value_ranks(df, keys, score, label, ranges)
    n, npos = F.col("n").cast("double"), F.col("n_pos").cast("double")
    h = (n - 1) * (F.lit(1.0) - npos / n)
    r = r.withColumn("_h", h).withColumn("_lo", F.floor(h).cast("bigint"))

    def at(i):
        holds = (F.col("cnt_before") <= i) & (i < F.col("cnt_before") + F.col("cnt"))
        return F.max(F.when(holds, F.struct("value", "cnt_before", "pos_before")))

    q = (r.groupBy(*keys)
         .agg(F.max("n").alias("n"), F.max("n_pos").alias("n_pos"), F.max("_h").alias("_h"),
              at(F.col("_lo")).alias("_a"), at(F.col("_lo") + 1).alias("_b"))
         .withColumn("_b", F.coalesce("_b", "_a")))
    t = F.col("_h") - F.floor(F.col("_h"))
    q = q.withColumn("threshold", _lerp(F.col("_a.value"), F.col("_b.value"), t))
    q = q.withColumn("_v", F.when(F.col("_a.value") >= F.col("threshold"), F.col("_a")).otherwise(F.col("_b")))
    return q.select(*keys, "n", "n_pos", "threshold",
                    F.when(F.col("n_pos") == 0, _nan()).otherwise(
                        (F.col("n_pos") - F.col("_v.pos_before"))
                        / F.greatest(F.lit(1), F.col("n") - F.col("_v.cnt_before"))).alias("topk_precision"))


def average_precision(df: DataFrame, keys, label: str = "label", score: str = "score",
                      ranges: int | None = None) -> DataFrame:
    """A4: sum over distinct thresholds (descending) of
    (positives at the threshold / n_pos) * precision at the threshold.
    NaN without positives."""
    keys = list(keys)
    r = value_ranks(df, keys, score, label, ranges)
    prec = (F.col("n_pos") - F.col("pos_before")) / (F.col("n") - F.col("cnt_before"))
    return (r.groupBy(*keys)
            .agg(F.first("n").alias("n"), F.first("n_pos").alias("n_pos"),
                 F.sum(F.col("pos") * prec).alias("_s"))
            .select(*keys, "n", "n_pos",
                    F.when(F.col("n_pos") == 0, _nan()).otherwise(F.col("_s") / F.col("n_pos"))
                    .alias("average_precision")))


def pearson_expr(x: str, y: str):
    """A5 as an aggregate: covar_pop / sqrt(var_pop x * var_pop y); NaN for a
    constant column (Spark's corr raises under ANSI mode)."""
    den = F.sqrt(F.var_pop(x) * F.var_pop(y))
    return F.coalesce(F.try_divide(F.covar_pop(x, y), den), _nan())


def pearson(df: DataFrame, x: str, y: str, keys=()) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                                 pearson_expr(x, y).alias("pearson"))


def spearman(df: DataFrame, x: str, y: str, keys=(), ranges: int | None = None) -> DataFrame:
    """Pearson of average ranks (scipy spearmanr) over complete pairs: rows
    with a NULL are left out before ranking; a NaN makes the result NaN.

    Equal pairs are collapsed first, so ties cost one row each, and both
    rankings are passes over these pairs (``rank_in_place``): the pairs are dealt by
    the ranges of one column, get their rank there, and carry it to the ranges of the
    other.  No pair is joined on a value, so one that fills a large share
    of the rows is no hot key.  The mean of average ranks is (n + 1) / 2, which
    centres the weighted moments.
    """
    keys = list(keys)
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    pairs = d.groupBy(*keys, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count(F.lit(1)).cast("bigint").alias("_w"))
    # The column's own type may hold no NaN (decimals, integers).
    nan = [F.isnan(c) for c in ("_x", "_y") if dict(pairs.dtypes)[c] in ("double", "float")]
    bad = F.lit(False)
    for c in nan:
        bad = bad | c
    for c, other, out in (("_x", "_y", "_rx"), ("_y", "_x", "_ry")):
        pairs = rank_in_place(pairs, keys, c, ["_w"], [other], ranges)
        rank = F.col("_w_before") + (F.col("_w_here") + 1) / 2.0 - (F.col("_w_all") + 1) / 2.0
        pairs = pairs.withColumn(out, rank).drop("_w_before", "_w_here", "_w_all")

    def moment(a, b):
        return F.sum(F.col("_w") * F.col(a) * F.col(b))

    return (pairs.groupBy(*keys)
            .agg(F.coalesce(F.sum("_w"), F.lit(0)).cast("bigint").alias("n"), F.max(bad).alias("_bad"), moment("_rx", "_ry").alias("_xy"),
                 F.sqrt(moment("_rx", "_rx") * moment("_ry", "_ry")).alias("_den"))
            .select(*keys, "n", F.when(F.col("_bad"), _nan()).otherwise(
                F.coalesce(F.try_divide("_xy", "_den"), _nan())).alias("spearman")))


def mse(df: DataFrame, pairs: dict, keys=()) -> DataFrame:
    """Mean squared error per target and their sum ``total``."""
    aggs = [F.avg((F.col(p) - F.col(y)) ** 2).alias(f"mse_{name}") for name, (y, p) in pairs.items()]
    out = df.groupBy(*keys).agg(*aggs)
    total = None
    for name in pairs:
        total = F.col(f"mse_{name}") if total is None else total + F.col(f"mse_{name}")
    return out.withColumn("mse_total", total)


def _pick(arr, idx):
    return F.element_at(arr, (idx + 1).cast("int"))


def cross_entropy(df: DataFrame, logits: str, label: str = "label", keys=()) -> DataFrame:
    """Mean of -log_softmax[label] over rows with label != -100."""
    d = df.where(F.col(label) != -100).select(*keys, F.col(label).alias("_l"), log_softmax(logits).alias("_lp"))
    return (d.groupBy(*keys).agg(F.avg(-_pick(F.col("_lp"), F.col("_l"))).alias("cross_entropy"),
                                 F.count(F.lit(1)).cast("bigint").alias("n")))


def _kl_terms(lp: str, lq: str, n_classes: int = 3):
    """sum_i q_i (log q_i - log p_i) with q = exp(lq)."""
    terms = None
    for i in range(1, n_classes + 1):
        a, b = F.element_at(lp, i), F.element_at(lq, i)
        term = F.exp(b) * (b - a)
        terms = term if terms is None else terms + term
    return terms


def symmetric_kl(df: DataFrame, logits_p: str, logits_q: str, label: str = "label", keys=()) -> DataFrame:
    """(sum KL(q||p) + sum KL(p||q)) / rows over kept rows (label >= 0);
    "batchmean" divides by rows, not elements."""
    d = (df.where(F.col(label) >= 0)
         .select(*keys, log_softmax(logits_p).alias("_lp"), log_softmax(logits_q).alias("_lq")))
    per_row = _kl_terms("_lp", "_lq") + _kl_terms("_lq", "_lp")
    return d.groupBy(*keys).agg((F.sum(per_row) / F.count(F.lit(1))).alias("symmetric_kl"),
                                F.count(F.lit(1)).cast("bigint").alias("n"))


def combined_loss(df: DataFrame, logits_p: str, logits_q: str, weight: float = 1.0,
                  label: str = "label", keys=()) -> DataFrame:
    """A10: cross entropy + weight * symmetric KL.  Weight 0 switches KL off: it
    is neither computed nor added, and reported as 0.

    Both parts come from one pass over the rows."""
    d = df.where(F.col(label) != -100).select(
        *keys, F.col(label).alias("_l"), log_softmax(logits_p).alias("_lp"), log_softmax(logits_q).alias("_lq"))
    ce = F.avg(-_pick(F.col("_lp"), F.col("_l"))).alias("cross_entropy")
    if weight == 0:
        out = d.groupBy(*keys).agg(ce).withColumn("symmetric_kl", F.lit(0.0))
        return out.withColumn("loss", F.col("cross_entropy"))
    kept = F.col("_l") >= 0
    kl = _kl_terms("_lp", "_lq") + _kl_terms("_lq", "_lp")
    out = d.groupBy(*keys).agg(ce, (F.sum(F.when(kept, kl)) / F.sum(kept.cast("int"))).alias("symmetric_kl"))
    return out.withColumn("loss", F.col("cross_entropy") + F.lit(weight) * F.col("symmetric_kl"))


def ensemble_mean(scores: DataFrame, keys, model: str = "model", score: str = "score") -> DataFrame:
    """Mean score over models per position (keys), label kept."""
    return scores.groupBy(*keys).agg(F.avg(score).alias(score), F.first("label").alias("label"),
                                     F.count(model).cast("bigint").alias("n_models"))


def seed_summary(metrics: DataFrame, keys, value: str) -> DataFrame:
    """Mean and both standard deviations over seeds (runs)."""
    return metrics.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_runs"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd_samp"),
        F.stddev_pop(value).alias("sd_pop"))
