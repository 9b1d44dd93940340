"""Global ranks and running aggregates without a single-task window (H1/H2).

``Window.partitionBy(key).orderBy(v)`` puts a whole key in one task; with a
key holding a third of the rows that task holds a third of the data.  Ranks
go through a range exchange instead: rows sorted by (key, value) are dealt to ranges
of equal size wherever keys begin and end, the exact running values inside a range
come from a window over that range, and what lies before it from the totals of the ranges, a
table of one row for each key and range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

def _same(keys: list[str], left: str = "{}", right: str = "_k_{}") -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(left.format(k)).eqNullSafe(F.col(right.format(k)))
    return cond


def rank_in_place(df: DataFrame, keys, value: str, weights: list[str], ties=(), ranges: int | None = None) -> DataFrame:
    """Add to each row, for each column ``w`` of ``weights`` (sums of it, not
    negative): ``w_before`` over the key's rows of smaller ``value``, ``w_here``
    over those of equal value, and ``w_all`` over the key.

    The rows are written once, range-partitioned by (keys, value, ties) into
    ``ranges`` parts, or into as many as the session's shuffle partitions and AQE's sizes
    give; a row's part is a column from then on.  ``ties`` names columns that
    tell rows of one value apart, so that a value with a large share of the rows is
    cut like any other stretch.  No row is joined on its value: such a value
    begins or ends each part it is in, so the table of parts (one row for each key and part: its first
    and last value with their weights, and its totals) knows all there is to know
    about it.  NULL values must be left out before; NaN is the largest value.
    """
    keys = list(keys)
    order = [*keys, value, *ties]
    dealt = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
    dealt = materialize(dealt.withColumn("_part", F.spark_partition_id()))
    kp = [*keys, "_part"]
    inside = Window.partitionBy(*kp).orderBy(value).rangeBetween(Window.unboundedPreceding, 0)
    equal = Window.partitionBy(*kp, value)
    for w in weights:
        dealt = dealt.withColumn(f"{w}_here", F.sum(w).over(equal)).withColumn(f"{w}_before", F.sum(w).over(inside) - F.col(f"{w}_here"))

    # One row for each key and part.
    parts = dealt.groupBy(*kp).agg(
        F.min(value).alias("_lo"), F.max(value).alias("_hi"), *[F.sum(w).alias(f"_t_{w}") for w in weights],
        *[F.min_by(f"{w}_here", value).alias(f"_l_{w}") for w in weights], *[F.max_by(f"{w}_here", value).alias(f"_h_{w}") for w in weights])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    for w in weights:
        parts = parts.withColumn(f"_c_{w}", F.coalesce(F.sum(f"_t_{w}").over(before), F.lit(0))).withColumn(f"_a_{w}", F.sum(f"_t_{w}").over(whole))
    # The values at the edges of parts, each with the weight it has in its part and what the key has before it there.
    def edge(which: str, v: str) -> Column:
        fields = []
        for w in weights:
            fields.append(F.col(f"_{which}_{w}").alias(f"_e_{w}"))
            fields.append((F.col(f"_c_{w}") if which == "l" else F.col(f"_c_{w}") + F.col(f"_t_{w}") - F.col(f"_h_{w}")).alias(f"_f_{w}"))
        return F.struct(F.lit(which).alias("_side"), F.col(v).alias("_v"), *fields)

    edges = F.when(F.col("_lo") == F.col("_hi"), F.array(edge("l", "_lo"))).otherwise(F.array(edge("l", "_lo"), edge("h", "_hi")))
    sums = [F.col(f"{p}_{w}") for w in weights for p in ("_c", "_a")]
    e = parts.select(*kp, *sums, "_lo", "_hi", F.inline(edges))
    at = Window.partitionBy(*keys, "_v")
    for w in weights:
        # What lies before a value grows along the parts, so the least is that of its first part.
        e = e.withColumn(f"_f_{w}", F.min(f"_f_{w}").over(at)).withColumn(f"_e_{w}", F.sum(f"_e_{w}").over(at))
    both = F.struct(*[F.col(f"{p}_{w}") for w in weights for p in ("_f", "_e")])
    table = e.groupBy(*[F.col(k).alias(f"_k_{k}") for k in kp]).agg(
        F.max(F.when(F.col("_side") == "l", both)).alias("_first"), F.max(F.when(F.col("_side") == "h", both)).alias("_last"),
        F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi"), *[F.max(f"{p}_{w}").alias(f"{p}_{w}") for w in weights for p in ("_c", "_a")])

    out = dealt.join(table, _same(kp))
    first, last = F.col(value) == F.col("_lo"), F.col(value) == F.col("_hi")
    cols = [c for c in dealt.columns if c != "_part" and c not in {f"{w}_{s}" for w in weights for s in ("here", "before")}]
    new = []
    for w in weights:
        new.append(F.when(first, F.col(f"_first._f_{w}")).when(last, F.col(f"_last._f_{w}")).otherwise(F.col(f"_c_{w}") + F.col(f"{w}_before")).alias(f"{w}_before"))
        new.append(F.when(first, F.col(f"_first._e_{w}")).when(last, F.col(f"_last._e_{w}")).otherwise(F.col(f"{w}_here")).alias(f"{w}_here"))
        new.append(F.col(f"_a_{w}").alias(f"{w}_all"))
    return out.select(*cols, *new)


def value_ranks(df: DataFrame, keys, value: str, positive: str | None = None,
                ranges: int | None = None) -> DataFrame:
    """Distinct values per key with their counts and the counts before them.

    Output: keys, value, ``cnt`` (rows with this value), ``pos`` (sum of the
    0/1 column ``positive``, 0 if None), ``cnt_before`` / ``pos_before`` (the same
    over strictly smaller values), ``n`` / ``n_pos`` (key totals).  NULL values are left out.

    Ties are collapsed first (a partial aggregation), so a hot value is one
    row; the distinct values are ranked by ``rank_in_place``.
    """
    keys = list(keys)
    if positive:
        label = F.col(positive).cast("bigint")
        posc = F.when(label.isin(0, 1), label).otherwise(F.raise_error(F.lit("labels must be 0 or 1")).cast("bigint"))
    else:
        posc = F.lit(0).cast("bigint")
    dist = (df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("value"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("cnt"), F.sum(posc).cast("bigint").alias("pos")))
    r = rank_in_place(dist, keys, "value", ["cnt", "pos"], ranges=ranges)
    return r.select(*keys, "value", "cnt", "pos", F.col("cnt_all").alias("n"), F.col("pos_all").alias("n_pos"), "cnt_before", "pos_before")


def running(df: DataFrame, keys, order: str, col: str, func: str = "sum",
            inclusive: bool = True, block: int = 1024, out: str | None = None) -> DataFrame:
    """Running ``func`` (sum / max / min) of ``col`` per key in ``order``.

    ``order`` must be integer valued; rows are grouped in blocks of
    ``block`` consecutive order values.  ``inclusive=False`` covers strictly
    earlier rows only (NULL when there are none).
    """
    keys = list(keys)
    out = out or f"running_{func}_{col}"
    agg = {"sum": F.sum, "max": F.max, "min": F.min}[func]
    comb = {"sum": lambda a, b: a + b, "max": F.greatest, "min": F.least}[func]
    d = df.withColumn("_blk", F.floor(F.col(order) / F.lit(block)).cast("bigint"))
    kb = keys + ["_blk"]
    totals = (d.groupBy(*kb).agg(agg(col).alias("_bt"))
              .withColumn("_carry", agg("_bt").over(
                  Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)))
              .drop("_bt"))
    frame_end = 0 if inclusive else -1
    inb = agg(col).over(Window.partitionBy(*kb).orderBy(order)
                        .rowsBetween(Window.unboundedPreceding, frame_end))
    d = d.join(totals, kb).withColumn("_inb", inb)
    # greatest/least skip NULLs; a sum must treat a missing side as 0 only
    # when the other side exists.
    if func == "sum":
        val = F.when(F.col("_carry").isNull() & F.col("_inb").isNull(), F.lit(None)).otherwise(
            F.coalesce(F.col("_carry"), F.lit(0)) + F.coalesce(F.col("_inb"), F.lit(0)))
    else:
        val = comb(F.col("_carry"), F.col("_inb"))
    return d.withColumn(out, val).drop("_blk", "_carry", "_inb")


def bounded_window_mean(df: DataFrame, keys, order: str, col: str, n: int,
                        block: int | None = None, out: str | None = None) -> DataFrame:
    """Mean of ``col`` over order values in (order - n, order] per key.

    Blocks of ``block`` (>= n) order values each borrow the last n-1 values
    of the previous block, so the window runs inside (key, block) with a
    bounded frame, never over a whole key.
    """
    keys = list(keys)
    block = max(block or 4 * n, n)
    out = out or f"mean_{col}"
    d = df.withColumn("_blk", F.floor(F.col(order) / F.lit(block)).cast("bigint"))
    own = d.withColumn("_own", F.lit(True))
    halo = (d.where(F.col(order) - F.col("_blk") * block >= block - (n - 1))
            .withColumn("_blk", F.col("_blk") + 1).withColumn("_own", F.lit(False)))
    w = (Window.partitionBy(*keys, "_blk").orderBy(F.col(order).cast("bigint"))
         .rangeBetween(-(n - 1), 0))
    return (own.unionByName(halo)
            .withColumn(out, F.avg(col).over(w))
            .where("_own").drop("_blk", "_own"))
