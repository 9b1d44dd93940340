"""Gene records and per-base splice-site labels.

Site labels are a long sparse table ``(gene, pos, label)`` holding only the
non-zero positions; dense vectors are made per window (J3).  All label work
is row-local on the gene record (array set operations), so building labels
needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import parse_positions, to_half_open

# Fixed label values of the splice-site track.
NEITHER, DONOR, ACCEPTOR, IGNORED = 0, 1, 2, -100


def prepare_genes(annotation: DataFrame, exclude_paralogs: bool = False,
                  compat_positions: bool = False) -> DataFrame:
    """Annotation rows (1-based, text lists) -> gene records.

    Output: gene, paralog, chrom, strand, tx_start (0-based), tx_end,
    jn_start ARRAY<BIGINT>, jn_end ARRAY<BIGINT> (0-based).
    ``line_no`` (file order) is kept if there.
    ``exclude_paralogs`` (P1) is a plain filter, pushed below everything.
    """
    df = annotation
    if exclude_paralogs:
        df = exclude_paralog_rows(df)
    start, end = to_half_open(F.col("tx_start").cast("bigint"), F.col("tx_end").cast("bigint"))
    return df.select(
        "gene",
        F.col("paralog").cast("int").alias("paralog"),
        "chrom", "strand", start.alias("tx_start"), end.alias("tx_end"),
        parse_positions("jn_start", compat_positions).alias("jn_start"),
        parse_positions("jn_end", compat_positions).alias("jn_end"),
        *[c for c in ("line_no",) if c in df.columns],
    )


def exclude_paralog_rows(df: DataFrame) -> DataFrame:
    """Keep paralog = 0."""
    return df.where(F.col("paralog") == 0)


def drop_ignored(df: DataFrame, label: str = "label") -> DataFrame:
    """Keep rows whose label is not the ignore code -100."""
    return df.where(F.col(label) != IGNORED)


def site_labels(genes: DataFrame) -> DataFrame:
    """L1 + P3: per gene, sites in both lists -> -100, starts only -> donor,
    ends only -> acceptor ('-' strand swaps donor and acceptor), clipped to
    [tx_start, tx_end).  Duplicates collapse.

    Output: gene, chrom, strand, tx_start, tx_end, pos BIGINT, label INT.
    """
    starts, ends = F.col("jn_start"), F.col("jn_end")
    both = F.array_intersect(starts, ends)
    s_only = F.array_except(starts, both)
    e_only = F.array_except(ends, both)
    minus = F.col("strand") == "-"
    donors = F.when(minus, e_only).otherwise(s_only)
    acceptors = F.when(minus, s_only).otherwise(e_only)

    def tag(arr, code):
        return F.transform(arr, lambda p: F.struct(p.alias("pos"), F.lit(code).alias("label")))

    sites = F.concat(tag(donors, DONOR), tag(acceptors, ACCEPTOR), tag(both, IGNORED))
    return (genes
            .select("gene", "chrom", "strand", "tx_start", "tx_end", F.inline(sites))
            .where((F.col("pos") >= F.col("tx_start")) & (F.col("pos") < F.col("tx_end"))))


def distinct_genes(df: DataFrame) -> DataFrame:
    """L2: the set of genes (np.unique)."""
    return df.select("gene").distinct()


def duplicate_genes(annotation: DataFrame) -> DataFrame:
    """Gene names that occur on more than one annotation line.

    The reference lets the last line win for labels but keeps every line's
    tiles; we list the duplicates so callers can reject them."""
    return (annotation.groupBy("gene").agg(F.count(F.lit(1)).alias("n_lines"))
            .where(F.col("n_lines") > 1))


def split_leakage(windows: DataFrame, split_col: str = "split") -> DataFrame:
    """L3: genes seen in more than one split (must be empty), as one summary
    row: genes checked, genes leaking, and the pairwise overlaps."""
    per_gene = (windows.where(F.col(split_col).isNotNull())
                .groupBy("gene")
                .agg(F.count_distinct(split_col).alias("n_splits"),
                     F.max((F.col(split_col) == "train").cast("int")).alias("tr"),
                     F.max((F.col(split_col) == "val").cast("int")).alias("va"),
                     F.max((F.col(split_col) == "test").cast("int")).alias("te")))
    return per_gene.agg(
        F.count(F.lit(1)).cast("bigint").alias("n_genes"),
        F.sum((F.col("n_splits") > 1).cast("bigint")).cast("bigint").alias("n_leaking"),
        F.sum(F.col("tr") * F.col("va")).cast("bigint").alias("train_val"),
        F.sum(F.col("tr") * F.col("te")).cast("bigint").alias("train_test"),
        F.sum(F.col("va") * F.col("te")).cast("bigint").alias("val_test"),
    )


def assert_disjoint(windows: DataFrame, split_col: str = "split") -> None:
    """L3 as a check: raise if a gene is in two splits (one aggregate row)."""
    row = split_leakage(windows, split_col).first()
    if row and row["n_leaking"]:
        raise AssertionError(f"genes shared between splits: {row.asDict()}")
