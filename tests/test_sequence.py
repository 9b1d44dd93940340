import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import scores as S
from helixframe.functions import sequence as Q


def one(spark, expr, value="", schema="s string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_kmers_worked_examples(spark):
    assert one(spark, Q.kmers("s", 3, 1, 1, 1), "ACGTA") == ["NAC", "ACG", "CGT", "GTA", "TAN"]
    assert one(spark, Q.kmers("s", 3, 0, 0, 2), "ACGTA") == ["ACG", "GTA", "A"]
    assert one(spark, Q.kmers("s", 3, 1, 1, 1), "") == []


def test_afirst_tokens(spark):
    t = one(spark, Q.to_tokens(Q.encode("s", "afirst")), "ACGTN")
    assert [int(c) for c in t] == [2, 5, 6, 7, 8, 9, 3]
    assert one(spark, Q.digits_to_array(Q.to_tokens(Q.encode("s", "afirst"))), "ACGTN") == [2, 5, 6, 7, 8, 9, 3]


def test_nfirst_codes_both_cases(spark):
    assert one(spark, Q.encode("s", "nfirst"), "NnAaCcGgTtUu") == "001122334444"
    assert one(spark, Q.encode("s", "nfirst"), "") == ""


def test_unknown_letter_strict_raises(spark):
    with pytest.raises(Exception):
        one(spark, Q.encode("s", "nfirst"), "ACGX")
    with pytest.raises(Exception):
        one(spark, Q.encode("s", "afirst"), "ACGU")  # A-first has no U
    assert one(spark, Q.encode("s", "afirst", mode="to_n"), "ACGU") == "0124"


def test_reverse_complement(spark):
    assert one(spark, Q.reverse_complement("s"), "AACGn") == "nCGTT"
    assert one(spark, Q.reverse_complement_codes("s"), "01234") == "12340"


def test_parse_positions(spark):
    assert one(spark, Q.parse_positions("s"), "4,7,") == [3, 6]
    assert one(spark, Q.parse_positions("s"), "") == []
    assert one(spark, Q.parse_positions("s"), "4,7") == [3, 6]
    assert one(spark, Q.parse_positions("s", compat=True), "4,7") == [3]


def test_pad_sequence(spark):
    assert one(spark, Q.pad_sequence("s", 2, -1), "AC") == "NNAC"


def test_half_precision_matches_numpy(spark):
    rng = np.random.default_rng(0)
    vals = np.concatenate([rng.random(3000), rng.random(500) * 1e-5, -rng.random(200) * 70000,
                           [0.0, 1.0, 0.5, 2 ** -24, 6.1e-5, 65504.0, 65519.0, 65520.0]])
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = [r["h"] for r in df.select(S.round_half_precision("x").alias("h")).collect()]
    want = vals.astype(np.float16).astype(np.float64)
    assert np.array_equal(np.array(got), want)


def test_softmax_and_center_slice(spark):
    df = spark.createDataFrame([([0.0, 1.0, 2.0],)], "a array<double>")
    r = df.select(S.softmax("a").alias("p"), S.log_softmax("a").alias("lp")).first()
    e = np.exp([0.0, 1.0, 2.0]) / np.exp([0.0, 1.0, 2.0]).sum()
    assert np.allclose(r["p"], e) and np.allclose(r["lp"], np.log(e))
    arr = spark.createDataFrame([(list(range(20)),)], "a array<int>")
    assert arr.select(S.center_slice("a", 3, 5, True)).first()[0] == [4, 5, 6, 7, 8]
