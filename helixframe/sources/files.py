"""File sources with file order.

Text and CSV sources split large files into blocks read by different tasks.
File order is recovered without a one-task sort: inside a split, rows come
in file order with consecutive ``monotonically_increasing_id`` values; splits
of a file are ordered by ``_metadata.file_block_start``.  Per-split counts
(one row per split) get running carries per file and are joined back.
A plain gzip file is a single split; one made of independent blocks is read in
ranges by many tasks (``blocks``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.labels import duplicate_genes, prepare_genes
from .blocks import block_files, read_blocks

HEADER_BLOCK = 65536  # lines that share one copy of their header
# Accepted genome file suffixes (FASTA, gzipped FASTA).
FASTA_SUFFIXES = (".fa", ".fasta", "fa.gz", "fna.gz")


def with_file_order(df: DataFrame, is_marker=None, across_files: bool = False) -> DataFrame:
    """Add ``_file`` and ``_ord`` (0-based row index in its file, file
    order) to a DataFrame read straight from files.  With ``is_marker`` (a
    boolean Column), also add ``_mark_idx``: the number of marker rows at or
    before the row (0 before the first marker).  ``across_files`` numbers on
    through all files in the order of their paths.

    Must be applied directly on the file scan so the row id and the file
    metadata come from the same split.
    """
    d = df.select("*", F.col("_metadata.file_path").alias("_file"),
                  F.col("_metadata.file_block_start").alias("_blk"),
                  F.monotonically_increasing_id().alias("_mid"))
    return _numbered(d, is_marker, across_files)


def _numbered(d: DataFrame, is_marker=None, across_files: bool = False) -> DataFrame:
    """``with_file_order`` from the file, its part (``_blk``) and an increasing number in the part (``_mid``)."""
    mark = (is_marker if is_marker is not None else F.lit(False)).cast("bigint")
    d = d.withColumn("_mk", mark)
    per_split = (d.groupBy("_file", "_blk")
                 .agg(F.min("_mid").alias("_m0"), F.count(F.lit(1)).alias("_n"), F.sum("_mk").alias("_nm")))
    # One row per split: a table some millions of times smaller than the data.
    wf = (Window.orderBy("_file", "_blk") if across_files else Window.partitionBy("_file").orderBy("_blk")).rowsBetween(Window.unboundedPreceding, -1)
    per_split = (per_split
                 .withColumn("_row_carry", F.coalesce(F.sum("_n").over(wf), F.lit(0)))
                 .withColumn("_mark_carry", F.coalesce(F.sum("_nm").over(wf), F.lit(0)))
                 .drop("_n", "_nm"))
    inb = F.sum("_mk").over(Window.partitionBy("_file", "_blk").orderBy("_mid")
                            .rowsBetween(Window.unboundedPreceding, 0))
    d = d.join(per_split, ["_file", "_blk"])
    d = (d.withColumn("_ord", (F.col("_row_carry") + F.col("_mid") - F.col("_m0")).cast("bigint"))
         .withColumn("_mark_idx", (F.col("_mark_carry") + inb).cast("bigint")))
    return d.drop("_blk", "_mid", "_mk", "_m0", "_row_carry", "_mark_carry")


def _check_fasta_path(path: str) -> None:
    p = path.rstrip("/")
    if "." in p.rsplit("/", 1)[-1] and not p.endswith(FASTA_SUFFIXES):
        raise TypeError(f"Unknown file type: {path}, expect one of {', '.join(FASTA_SUFFIXES)}")


def _fasta_rows(spark: SparkSession, path: str) -> DataFrame:
    _check_fasta_path(path)
    is_hdr = F.col("value").startswith(">")
    made_of_blocks = block_files(spark, path)
    d = _numbered(read_blocks(spark, made_of_blocks), is_hdr) if made_of_blocks else with_file_order(spark.read.text(path), is_hdr)
    # The header name of each row: the header row with the same mark index.
    # Headers are few beside lines, but all lines of a contig share one: lines
    # are dealt by (header, block of lines) to a copy of the header per block.
    hdr = (d.where(is_hdr)
           .select("_file", "_mark_idx",
                   F.split(F.trim(F.substring(F.col("value"), 2, 1 << 30)), r"\s+").getItem(0).alias("name")))
    d = d.withColumn("_lines", F.expr(f"_ord div {HEADER_BLOCK}"))
    blocks = d.groupBy("_file", "_mark_idx", "_lines").agg(F.lit(1).alias("_one")).drop("_one")
    per_block = blocks.join(hdr, ["_file", "_mark_idx"])
    return d.join(per_block, ["_file", "_mark_idx", "_lines"], "left").drop("_lines")


def read_fasta_lines(spark: SparkSession, path: str) -> DataFrame:
    """Base lines of FASTA file(s) as (chrom, line_no, bases).

    ``line_no`` is the line index in its file (file order), ready for
    ``genome.build_genome``.  Lines before the first header are an error.
    """
    d = _fasta_rows(spark, path).where(~F.col("value").startswith(">"))
    bases = F.regexp_replace(F.col("value"), r"\s+", "")
    return (d.where(F.length(bases) > 0)
            .select(F.when(F.col("name").isNotNull(), F.col("name"))
                    .otherwise(F.raise_error(F.lit("FASTA line before the first header"))).alias("chrom"),
                    F.col("_ord").alias("line_no"), bases.alias("bases")))


def _group_of(file: str):
    """The data set a file belongs to: its ``group=`` folder if it is in one,
    else the last part of its name, as in ``Sequences_Train.fa`` and
    ``Sequences_activity_Train.txt``."""
    folder = F.regexp_extract(file, r"group=([^/]+)/", 1)
    return F.when(folder != "", folder).otherwise(F.regexp_extract(file, r"([^/_.]+)\.[^/]*$", 1))


MAX_RECORD = 1 << 28  # bases of a record that is one row; a longer one raises, ``read_fasta_pieces`` has no limit
PIECE = 65536


def _record_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of records: _file, _mark_idx (record number, from 1), _ord, name, bases, n."""
    d = _fasta_rows(spark, path).where(~F.col("value").startswith(">") & (F.col("_mark_idx") > 0))
    return (d.select("_file", "_mark_idx", "_ord", "name", F.regexp_replace(F.col("value"), r"\s+", "").alias("bases"))
            .withColumn("n", F.length("bases").cast("bigint")))


def _record_lengths(lines: DataFrame) -> DataFrame:
    """Length of each record: one partial aggregate, no record is gathered."""
    return lines.groupBy(F.col("_file").alias("_rf"), F.col("_mark_idx").alias("_rm")).agg(F.sum("n").alias("length"))


def require_equal_lengths(records: DataFrame, length: str = "length") -> DataFrame:
    """The records, if all lengths are equal, as a matrix of encoded sequences
    needs them; else reading them raises.  Two numbers decide, by a subquery."""
    same = records.agg((F.coalesce(F.min(length), F.lit(0)) == F.coalesce(F.max(length), F.lit(0))).alias("same")).scalar()
    return records.where(F.when(same, F.lit(True)).otherwise(F.raise_error(F.lit("records of unequal lengths")).cast("boolean")))


def read_fasta_pieces(spark: SparkSession, path: str, piece: int = PIECE, equal_lengths: bool = False) -> DataFrame:
    """S2 without a limit: each record as rows (ordinal, name, piece, start,
    bases, length, _file, group) of ``piece`` bases, the last one shorter; ``length`` is
    the record's.  A record without bases has no row.

    A line's offset in its record is found in two levels (blocks of lines, then
    the blocks' totals), lines are cut at the borders of pieces, and a piece gathers
    ``piece`` bases at most, however long the record is.
    """
    from ..operators.genome import line_offsets

    lines = _record_lines(spark, path).where(F.col("n") > 0)
    lines = lines.withColumn("_rec", F.concat_ws("\n", "_file", F.col("_mark_idx").cast("string")))
    lo = line_offsets(lines, "_rec", "_ord", "n")
    cut = (lo.withColumn("piece", F.explode(F.sequence(F.expr(f"offset div {piece}"), F.expr(f"(offset + n - 1) div {piece}"))))
           .withColumn("_a", F.greatest(F.col("offset"), F.col("piece") * piece))
           .withColumn("_b", F.least(F.col("offset") + F.col("n"), (F.col("piece") + 1) * piece))
           .withColumn("_part", F.expr("substr(bases, cast(_a - offset + 1 as int), cast(_b - _a as int))")))
    made = (cut.groupBy("_file", "_mark_idx", "piece").agg(
        F.first("name").alias("name"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_a", "_part"))), lambda x: x["_part"]), "").alias("bases")))
    lengths = _record_lengths(lines)
    if equal_lengths:
        lengths = require_equal_lengths(lengths)
    made = made.join(lengths, (F.col("_file") == F.col("_rf")) & (F.col("_mark_idx") == F.col("_rm")))
    return made.select((F.col("_mark_idx") - 1).cast("bigint").alias("ordinal"), "name", "piece", (F.col("piece") * piece).alias("start"), "bases",
                       F.col("length").cast("bigint").alias("length"), "_file", _group_of("_file").alias("group"))


def read_fasta_records(spark: SparkSession, path: str, equal_lengths: bool = False, max_record: int = MAX_RECORD) -> DataFrame:
    """One sequence per record as (ordinal, name, bases), ordinal =
    0-based record index in file order.  Multi-line records are joined in
    line order (the reference would count each line as a record).

    A record is one row here, so one of more than ``max_record`` bases raises,
    before its lines are gathered; ``read_fasta_pieces`` reads any.
    ``equal_lengths``: raise unless all records are equally long.
    """
    lines = _record_lines(spark, path)
    lengths = _record_lengths(lines)
    if equal_lengths:
        lengths = require_equal_lengths(lengths)
    fits = F.when(F.col("length") <= max_record, F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit(f"a record of more than {max_record} bases: "), F.coalesce("name", F.lit("")))).cast("boolean"))
    checked = lines.join(lengths, (F.col("_file") == F.col("_rf")) & (F.col("_mark_idx") == F.col("_rm"))).where(fits)
    return (checked.groupBy("_file", "_mark_idx")
            .agg(F.first("name").alias("name"),
                 F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_ord", "bases"))),
                                          lambda x: x["bases"]), "").alias("bases"))
            .select((F.col("_mark_idx") - 1).cast("bigint").alias("ordinal"), "name", "bases", "_file",
                    _group_of("_file").alias("group")))


def read_activity(spark: SparkSession, path: str,
                  columns=("Dev_log2_enrichment", "Hk_log2_enrichment"),
                  names=("y_dev", "y_hk")) -> DataFrame:
    """S3: tab file with a header; the two activity columns as FLOAT, with
    the 0-based data-row ordinal in file order."""
    raw = spark.read.text(path)
    d = with_file_order(raw)
    header = d.where(F.col("_ord") == 0).select("_file", F.split("value", "\t").alias("_hdr"))
    # One short row per file: AQE broadcasts the side if its measured size allows.
    body = d.where(F.col("_ord") > 0).join(header, "_file")
    fields = F.split("value", "\t")
    out = [(F.col("_ord") - 1).cast("bigint").alias("ordinal")]
    for col, name in zip(columns, names):
        idx = F.array_position(F.col("_hdr"), col)
        out.append(F.when(idx > 0, F.try_element_at(fields, idx.cast("int")))
                   .otherwise(F.raise_error(F.lit(f"column {col} missing")))
                   .try_cast("float").alias(name))
    return body.select(*out, "_file", _group_of("_file").alias("group"))


ANNOTATION_SCHEMA = T.StructType([
    T.StructField("gene", T.StringType()), T.StructField("paralog", T.IntegerType()),
    T.StructField("chrom", T.StringType()), T.StructField("strand", T.StringType()),
    T.StructField("tx_start", T.LongType()), T.StructField("tx_end", T.LongType()),
    T.StructField("jn_start", T.StringType()), T.StructField("jn_end", T.StringType()),
])


def read_annotation(spark: SparkSession, path: str, exclude_paralogs: bool = False,
                    raw: bool = False, reject_duplicates: bool = True, line_order: bool = False) -> DataFrame:
    """The 8-field tab annotation ('#' lines skipped) as gene records
    (``raw=True`` keeps the file layout).  ``line_order`` adds ``line_no``, the
    0-based number of the record in file order (through all files, in the order
    of their paths), which tiles carry on and ``splits.shuffle_batches`` orders by.

    [decision] A gene name on two lines is rejected and listed (the
    reference lets the last line win for labels but keeps every line's
    tiles).  The check is one small aggregate over the annotation."""
    df = (spark.read.schema(ANNOTATION_SCHEMA)
          .option("sep", "\t").option("comment", "#").option("quote", "").option("header", "false")
          .option("mode", "FAILFAST").csv(path))
    if line_order:
        df = with_file_order(df, across_files=True).withColumnRenamed("_ord", "line_no").drop("_file", "_mark_idx")
    df = df.withColumns({c: F.coalesce(c, F.lit("")) for c in ("jn_start", "jn_end")})
    if reject_duplicates:
        dups = [r["gene"] for r in duplicate_genes(df).orderBy("gene").limit(20).collect()]
        if dups:
            raise ValueError(f"duplicate gene names in {path}: {', '.join(dups)}")
    return df if raw else prepare_genes(df, exclude_paralogs)


def positional_join(sequences: DataFrame, table: DataFrame, on: str = "ordinal",
                    group: str | None = None) -> DataFrame:
    """Row i of ``sequences`` with row i of ``table`` (no key check in
    the reference).  Ordinals restart in each file, so tables of several files
    need ``group``, the column that names the file's data set on both sides;
    without it an ordinal that repeats raises.  [decision] a count mismatch
    raises: a full outer join on the ordinal fails on the first unmatched row,
    lazily and exactly."""
    keys = [group, on] if group else [on]
    both = []
    for d, mark in ((sequences, "_ls"), (table, "_rs")):
        seen = F.count(F.lit(1)).over(Window.partitionBy(*keys))
        both.append(d.withColumn(mark, F.when(seen == 1, F.lit(True)).otherwise(
            F.raise_error(F.lit("an ordinal repeats; name the group column")).cast("boolean"))))
    j = both[0].join(both[1], keys, "full_outer")
    ok = F.col("_ls").isNotNull() & F.col("_rs").isNotNull()
    # A filter, not a dropped column: Catalyst would prune an unused check.
    return (j.where(F.when(ok, F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("sequence and table row counts differ at ordinal "),
                               F.col(on).cast("string")))))
            .drop("_ls", "_rs"))
