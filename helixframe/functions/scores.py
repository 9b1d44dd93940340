"""Column expressions over model outputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def center_slice(arr, flank: int, window: int, has_special: bool = True) -> Column:
    """drop flanks (and a leading special token) from per-token output.

    The reference keeps ``[301:601]`` = 1 special + 300 flank, 300 window.
    """
    start = flank + (1 if has_special else 0) + 1
    return F.slice(_col(arr), start, window)


def class_logits(z, model, n_classes: int = 3, has_special: bool = True) -> list[Column]:
    """Logits of ``model`` (a number or an integer Column) in a packed vector:
    a leading special value, then ``n_classes`` values for each model."""
    first = model * n_classes + (2 if has_special else 1)
    return [F.element_at(_col(z), (F.lit(first + i) if isinstance(first, int) else first + i)) for i in range(n_classes)]


def _classes(logits, n_classes: int) -> list[Column]:
    if isinstance(logits, (list, tuple)):
        return [_col(c) for c in logits]
    return [F.element_at(_col(logits), i + 1) for i in range(n_classes)]


def _sum(cols: list[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out


def softmax(logits, n_classes: int = 3) -> Column:
    """numerically stable softmax of an ARRAY<DOUBLE> or of a list of
    columns, as an array.  Plain scalar expressions: the maximum and the sum
    are shared by the classes instead of being computed for each."""
    x = _classes(logits, n_classes)
    m = F.greatest(*x) if len(x) > 1 else x[0]
    e = [F.exp(c - m) for c in x]
    s = _sum(e)
    return F.array(*[c / s for c in e])


def log_softmax(logits, n_classes: int = 3) -> Column:
    """``x - max - log(sum(exp(x - max)))``."""
    x = _classes(logits, n_classes)
    m = F.greatest(*x) if len(x) > 1 else x[0]
    s = F.log(_sum([F.exp(c - m) for c in x]))
    return F.array(*[c - m - s for c in x])


def round_half_precision(col) -> Column:
    """round a double to the IEEE half-precision grid (round half even).

    The reference casts scores to float16 before ranking, which creates ties
    that change the metric.  Spacing is 2^(e-10) with e = max(floor(log2|x|),
    -14) (the subnormal floor); magnitudes past the float16 maximum become
    infinite, NaN stays NaN.
    """
    x = _col(col).cast("double")
    a = F.abs(x)
    e = F.greatest(F.floor(F.log2(a)), F.lit(-14))
    u = F.pow(F.lit(2.0), e - 10)
    r = F.rint(a / u) * u
    signed = F.when(x < 0, -r).otherwise(r)
    return (F.when(F.isnan(x), x)
            .when(x == 0, F.lit(0.0))
            .when(a >= 65520.0, F.when(x < 0, F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
            .otherwise(signed))


def one_vs_rest(label, scores: dict[str, Column], codes: dict[str, int]) -> Column:
    """explode (class, label01, score) rows for each named class.

    ``scores`` maps class name -> score column, ``codes`` maps class name ->
    the label value meaning "positive".  Returns an array of structs to be
    exploded by the caller (``inline``).
    """
    lab = _col(label)
    return F.array(*[
        F.struct(F.lit(name).alias("class"),
                 (lab == F.lit(codes[name])).cast("int").alias("label"),
                 sc.cast("double").alias("score"))
        for name, sc in scores.items()
    ])
