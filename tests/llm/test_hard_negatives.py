import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm import hard_negatives as H

ROW = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])


def mined(spark, rows, condition="vec_id % 3 = 0", extra=True, **options):
    d = spark.createDataFrame(rows, ROW).repartition(3)
    if extra:
        for name in ("score", "q", "rank", "theta", "key", "slot"):
            d = d.withColumn(name, F.lit("clash"))
    d = d.withColumn("vector", H.integer_vector(F.col("embedding"), 256.0))
    out = H.mine(d, F.expr(condition), **options).collect()
    return sorted(((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in out), key=repr)


def brute(rows, is_anchor, positives=5, negatives=3):
    ok = sorted({(i, x, tuple(math.floor(256 * float(c)) for c in np.float32(v))) for i, x, v in rows
                 if x is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)}, key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    place = lambda r: (r[0] is not None, r[0] or 0)
    out = []
    for a in ok:
        if not is_anchor(a[0]):
            continue
        same = sorted(((-dot(a[2], b[2]), place(b), b) for b in ok if b is not a and b[1] == a[1]), key=lambda t: t[:2])[:positives]
        other = sorted(((-dot(a[2], b[2]), place(b), b) for b in ok if b[1] != a[1]), key=lambda t: t[:2])
        for s, _, p in same:
            window = [(n, -t) for t, _, n in other if 50 * -s <= 100 * -t <= 95 * -s][:negatives]
            out += [(a[0], p[0], k + 1, n[0], -s, t) for k, (n, t) in enumerate(window)]
    return sorted(out, key=repr)


def cloud(seed, n, dim, labels=4, share=0.0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim)) + 0.7 * r.normal(size=(labels, dim))[r.integers(0, labels, n)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[r.random(n) < share] = x[0]
    return [(i, int(r.integers(0, labels)), x[i].astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize(("seed", "n", "dim", "share"), [(1, 300, 24, 0.0), (2, 200, 3, 0.0), (3, 240, 16, 0.4), (4, 60, 70, 0.0)])
def test_against_brute_force(spark, seed, n, dim, share):
    rows = cloud(seed, n, dim, share=share)
    want = brute(rows, lambda i: i % 3 == 0)
    assert want and mined(spark, rows) == want


def test_blocks_prune_without_loss():
    """Every pair at or above the threshold is found, whatever the index leaves out."""
    r = np.random.default_rng(5)
    x, q = np.floor(r.normal(size=(500, 40)) * 30), np.floor(r.normal(size=(50, 40)) * 30)
    full = q @ x.T
    for share in (0.0, 0.2, 0.5, 0.9):
        theta = np.quantile(full, share, axis=1) if share else np.full(50, -1e18)
        least = max(0.0, (theta / np.linalg.norm(q, axis=1)).min())
        block = H.Block(np.arange(500), np.zeros(500, np.int64), np.zeros(500, np.int64), x, least)
        a, row, score = block.join(q, theta, np.ones((50, 500), bool))
        got = {(int(i), int(block.ids[j])): int(s) for i, j, s in zip(a, row, score, strict=True)}
        assert got == {(int(i), int(j)): int(full[i, j]) for i, j in zip(*np.nonzero(full >= theta[:, None]), strict=True)}
        assert share < 0.9 or block.out.max() > 0


def test_edges(spark):
    """Rows that take no part, unequal lengths, an empty vector, ties, repeated rows and ids, a null id."""
    v = [0.5, 0.25, -0.125]
    rows = [(0, 1, v), (0, 1, v), (3, 1, v), (1, 1, v), (2, 1, v), (4, 2, [0.4, 0.2]), (5, 2, [0.4, 0.2]), (6, 2, [0.4, 0.2, 0.0, 0.9]), (7, 2, []),
            (9, None, v), (12, 1, None), (15, 1, [0.5, None]), (18, 2, [float("nan")]), (21, 2, [float("inf"), 0.0]), (3, 3, [0.4, 0.19]), (None, 3, [0.41, 0.2])]
    got = mined(spark, rows)
    assert got == brute(rows, lambda i: i is not None and i % 3 == 0)
    assert {r[0] for r in got} == {0, 3} and any(r[3] is None for r in got)


def test_empty_and_alone(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, 1, [1.0])]) == []
    assert mined(spark, [(0, 1, [1.0]), (1, 1, [1.0])]) == []


def test_scores_that_would_be_inexact_raise(spark):
    with pytest.raises(Exception, match="too long"):
        mined(spark, [(0, 1, [1e9]), (1, 1, [1.0])])
