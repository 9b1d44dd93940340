"""Chunked genome store and bulk interval fetch (S6, J1, F5 job).

A genome is a table of fixed-size chunks ``(chrom, chunk_id, chunk_start,
bases, ext)`` where ``ext`` holds the first ``halo`` bases of the next
chunk.  Fetching collapses equal intervals first, explodes the distinct ones
to the chunks they touch, joins on ``(chrom, chunk_id)``, reassembles each
(a group of length / chunk pieces) and joins the bases back on the
interval, so repeated rows cost nothing and keep their number.  A caller who
declares ``max_len <= halo`` gets the same rows from one equi-join and a
``substr``; a longer interval then raises.  The rows are spread first
(``spread``), unless that join deals them by key anyway: a few bytes of interval become a whole window of bases, so a
task's share of the work is not its share of the input.

Dense regions make hot chunk keys; the chunk side holds one row per key, so
AQE's skew-join split of the interval side handles them.  The genome side is
never broadcast by hint: it grows with the genome (AQE may broadcast it when
its measured size is small).
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import COMPLEMENT_FROM, COMPLEMENT_TO, code_alphabet, encode, reverse_complement, shift_codes

DEFAULT_CHUNK = 65536
DEFAULT_HALO = 4096
PAGE = 256  # chunks of a contig that one task writes, and that pruning reads as one
MAX_PAGES = 4096  # pages that a pruned read may name
MAX_RANGES = 64  # ranges of chunks in a pruned read's filter
KMER_BLOCK = 32  # bases whose k-mers are cut from one short text
MAX_INTERVAL = 1 << 28  # bases of one fetched interval, a row of the result; a longer one raises


@dataclass
class Genome:
    chunks: DataFrame     # chrom, chunk_id, chunk_start, bases, ext
    contigs: DataFrame | None  # chrom, length (None: to be summed from the chunks when written)
    chunk_size: int = DEFAULT_CHUNK
    halo: int = DEFAULT_HALO
    fill: str = "N"       # the unknown base
    complement: tuple[str, str] = (COMPLEMENT_FROM, COMPLEMENT_TO)  # letters and their complements


# --------------------------------------------------------------------------
# Lines -> chunks
# --------------------------------------------------------------------------

def line_offsets(lines: DataFrame, chrom: str = "chrom", order: str = "line_no",
                 length: str = "n", block: int = 4096) -> DataFrame:
    """Running start offset of each line inside its contig (H1).

    A per-contig window would run one task per contig.  Instead lines are
    grouped in blocks of ``block`` consecutive ``order`` values.  One window
    stage partitioned by (contig, block) gives each line its in-block offset
    and its block total; the block totals (a table 1/block the size of the
    input) get running carries per contig and are joined back.
    Adds ``offset`` and ``_btot`` (block total, used for contig lengths).
    """
    wb = Window.partitionBy(chrom, "_blk")
    df = (lines.withColumn("_blk", F.floor(F.col(order) / F.lit(block)).cast("bigint"))
          .withColumn("_inb", F.coalesce(F.sum(length).over(
              wb.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
          .withColumn("_btot", F.sum(length).over(wb)))
    carries = (df.groupBy(chrom, "_blk").agg(F.first("_btot").alias("_tot"))
               .withColumn("_carry", F.coalesce(F.sum("_tot").over(
                   Window.partitionBy(chrom).orderBy("_blk")
                   .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
               .select(chrom, "_blk", "_carry"))
    return (df.join(carries, [chrom, "_blk"])
            .withColumn("offset", (F.col("_carry") + F.col("_inb")).cast("bigint"))
            .drop("_carry", "_inb"))


def contig_lengths(offsets: DataFrame, chrom: str = "chrom") -> DataFrame:
    """Contig lengths from the block totals of ``line_offsets`` (small)."""
    return (offsets.groupBy(chrom, "_blk").agg(F.first("_btot").alias("_tot"))
            .groupBy(chrom).agg(F.sum("_tot").cast("bigint").alias("length")))


def chunk_lengths(chunks: DataFrame) -> DataFrame:
    """Contig lengths from all chunks of a store."""
    return chunks.groupBy("chrom").agg(F.sum(F.length("bases")).cast("bigint").alias("length"))


def build_genome(lines: DataFrame, chunk_size: int = DEFAULT_CHUNK, halo: int = DEFAULT_HALO,
                 chrom: str = "chrom", order: str = "line_no", bases: str = "bases",
                 block: int = 4096, checkpoint: bool = False,
                 validate: str | None = "ACGTUNacgtun") -> Genome:
    """FASTA-like lines (contig, order key, bases) -> chunk table.

    Each line is cut into the pieces that fall in each chunk; pieces are
    concatenated per chunk in offset order (a group bounded by chunk_size
    bases).  ``ext`` = first ``halo`` bases of the next chunk.
    ``checkpoint=True`` writes both tables to the session's shared
    checkpoint folder (``spark.checkpoint.dir``), cutting the lineage so
    later fetches read the store instead of rebuilding it.  ``validate``
    lists the allowed letters (a line with any other letter raises), so
    sequences fetched from the store can be encoded without a check.
    """
    if not 0 < halo <= chunk_size:
        raise ValueError("need 0 < halo <= chunk_size")
    C = chunk_size
    ls = (lines.select(F.col(chrom).alias("chrom"), F.col(order).alias("line_no"),
                       F.col(bases).alias("bases"))
          .withColumn("n", F.length("bases").cast("bigint"))
          .where(F.col("n") > 0))
    if validate:
        ls = ls.withColumn("bases", F.when(~F.col("bases").rlike(f"[^{validate}]"), F.col("bases")).otherwise(
            F.raise_error(F.concat(F.lit("unexpected letter in contig "), F.col("chrom")))))
    lo = line_offsets(ls, "chrom", "line_no", "n", block)
    # A chunk is made of the pieces of lines in it and, for its halo, of those in
    # the first bases of the next one: each line goes to the chunks whose bases
    # or halo it touches, and one grouping makes both.
    lines_in = F.sequence(F.greatest(F.floor((F.col("offset") - halo) / C).cast("bigint"), F.lit(0).cast("bigint")),
                          ((F.col("offset") + F.col("n") - 1) / C).cast("bigint"))
    pieces = (lo.select("chrom", "offset", "n", "bases", F.explode(lines_in).alias("chunk_id"))
              .withColumn("p_lo", F.greatest(F.col("offset"), F.col("chunk_id") * C))
              .withColumn("p_hi", F.least(F.col("offset") + F.col("n"), (F.col("chunk_id") + 1) * C + halo))
              .where("p_lo < p_hi")
              .select("chrom", "chunk_id", "p_lo",
                      F.expr("substr(bases, cast(p_lo - offset + 1 as int), cast(p_hi - p_lo as int))")
                      .alias("piece")))
    chunks = (pieces.groupBy("chrom", "chunk_id")
              .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_lo", "piece"))),
                                            lambda x: x["piece"]), "").alias("_all"))
              .withColumn("chunk_start", F.col("chunk_id") * C)
              .select("chrom", "chunk_id", "chunk_start", F.substring("_all", 1, C).alias("bases"),
                      F.expr(f"substr(_all, {C + 1})").alias("ext")))
    contigs = contig_lengths(lo)
    if checkpoint:
        from ..session import ensure_checkpoint_dir
        ensure_checkpoint_dir(chunks.sparkSession)
        chunks = chunks.checkpoint(eager=True)
        # From the written chunks: one small scan instead of a rebuild.
        contigs = chunk_lengths(chunks).checkpoint(eager=True)
    return Genome(chunks, contigs, chunk_size, halo)


CHUNK_SCHEMA = "chunk_id bigint, chunk_start bigint, bases string, ext string, chrom string"


def write_genome(genome: Genome, path: str, mode: str = "overwrite") -> None:
    """Persist the store: chunks partitioned by contig (partition pruning on
    chrom, row-group statistics on chunk_id), contigs, and the parameters.
    A task writes a page of ``PAGE`` chunks, so one contig is many tasks' work.
    Without contigs (None), their lengths are summed from the written chunks, so that the lines are read once."""
    spark = genome.chunks.sparkSession
    (genome.chunks.repartition("chrom", F.expr(f"chunk_id div {PAGE}")).sortWithinPartitions("chrom", "chunk_id")
     .write.mode(mode).partitionBy("chrom").parquet(f"{path}/chunks"))
    contigs = genome.contigs
    if contigs is None:
        contigs = chunk_lengths(spark.read.schema(CHUNK_SCHEMA).parquet(f"{path}/chunks"))
    contigs.write.mode(mode).parquet(f"{path}/contigs")
    meta = json.dumps({"chunk_size": genome.chunk_size, "halo": genome.halo})
    spark.createDataFrame([(meta,)], "meta string").write.mode(mode).text(f"{path}/meta")


def read_genome(spark, path: str) -> Genome:
    """The store at ``path`` (S6); scans are pruned by contig where a filter or join names it, see ``prune``."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(f"{path}/chunks")
    contigs = spark.read.schema("chrom string, length bigint").parquet(f"{path}/contigs")
    return Genome(chunks.select("chrom", "chunk_id", "chunk_start", "bases", "ext"), contigs,
                  meta["chunk_size"], meta["halo"])


def _merged(pages: list[int], limit: int) -> list[tuple[int, int]]:
    """Sorted pages as at most ``limit`` ranges (first, last); the narrowest gaps are closed first."""
    runs: list[tuple[int, int]] = []
    for p in pages:
        if runs and p <= runs[-1][1] + 1:
            runs[-1] = (runs[-1][0], p)
        else:
            runs.append((p, p))
    gaps = sorted(range(1, len(runs)), key=lambda i: runs[i][0] - runs[i - 1][1])
    close = set(gaps[:max(0, len(runs) - limit)])
    out: list[tuple[int, int]] = []
    for i, r in enumerate(runs):
        if i in close:
            out[-1] = (out[-1][0], r[1])
        else:
            out.append(r)
    return out


def prune(genome: Genome, intervals: DataFrame, start="start", end="end", chrom: str = "chrom",
          max_pages: int = MAX_PAGES) -> Genome:
    """A written store cut to what ``intervals`` can touch, for fetches of a small part of it.

    One distinct over the intervals finds the pages (runs of ``PAGE`` chunks
    of a contig) they touch.  Up to ``max_pages`` of them become literals: the contigs
    are a partition filter, so other contigs' files are not listed or opened, and
    the ranges of chunk ids are pushed to Parquet, which leaves out row groups by
    their statistics.  With more pages than that no list is made: the contigs
    alone prune, by a subquery that runs with the scan.  Rows outside
    the ranges are never asked for, so a fetch gives the same rows.
    """
    width = genome.chunk_size * PAGE
    s = F.greatest(_as_col(start, None).cast("bigint"), F.lit(0).cast("bigint"))
    e = F.greatest(_as_col(end, None).cast("bigint"), s + 1)
    touched = intervals.select(F.col(chrom).alias("chrom"), s.alias("_s"), e.alias("_e"))
    # A disjoint interval is moved behind its border and reads nothing; the others read within [start, end).
    touched = touched.join(genome.contigs.select(F.col("chrom").alias("_kc"), "length"), F.col("chrom") == F.col("_kc"))
    last = F.least(F.col("_e"), F.col("length")) - 1
    touched = touched.where(F.col("_s") <= last)
    pages = touched.select("chrom", F.explode(F.sequence((F.col("_s") / width).cast("bigint"), (last / width).cast("bigint"))).alias("page")).distinct()
    named = pages.limit(max_pages + 1).collect()
    if len(named) > max_pages:
        contigs = touched.agg(F.collect_set("chrom")).scalar()
        return replace(genome, chunks=genome.chunks.where(F.array_contains(contigs, F.col("chrom"))))
    ranges = _merged(sorted({r["page"] for r in named}), MAX_RANGES)
    inside = F.lit(False)
    for a, b in ranges:
        inside = inside | F.col("chunk_id").between(a * PAGE, (b + 1) * PAGE - 1)
    chunks = genome.chunks.where(F.col("chrom").isin(sorted({r["chrom"] for r in named})) & inside)
    return replace(genome, chunks=chunks)


def rechunk(genome: Genome, size: int, halo: int) -> Genome:
    """A finer view of the store for short lookups: sub-chunks of ``size``
    (dividing the chunk size) with ``halo`` (<= size, <= the store's halo).

    Derived by a narrow explode of each chunk row (no shuffle).  A lookup of
    a few bases then joins a row of size + halo bytes instead of a whole
    chunk, which matters when the lookups (sites) far outnumber chunks.
    """
    C = genome.chunk_size
    if C % size or not 0 < halo <= min(size, genome.halo):
        raise ValueError("size must divide the chunk size and 0 < halo <= min(size, store halo)")
    if size == C:
        return genome
    per = C // size
    j = F.col("_j")
    nxt = (j + 1) * size
    sub = (genome.chunks
           .select("chrom", "chunk_id", "chunk_start", "bases", "ext",
                   F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), ((F.length("bases") - 1) / size)
                                                              .cast("int")))).alias("_j"))
           .select("chrom",
                   (F.col("chunk_id") * per + j).cast("bigint").alias("chunk_id"),
                   (F.col("chunk_start") + j * size).cast("bigint").alias("chunk_start"),
                   F.expr(f"substr(bases, _j * {size} + 1, {size})").alias("bases"),
                   # The halo lies in this chunk unless the sub-chunk is its
                   # last one (halo <= size, so it never straddles).
                   F.when(nxt < F.length("bases"), F.expr(f"substr(bases, (_j + 1) * {size} + 1, {halo})"))
                   .otherwise(F.substring("ext", 1, halo)).alias("ext")))
    return replace(genome, chunks=sub, chunk_size=size, halo=halo)


def encoded(genome: Genome, codebook: str | dict = "nfirst", offset: int = 0) -> Genome:
    """The store's letters as code digits (F1) plus ``offset``, encoded once for each chunk.

    Encoding a base does not depend on its neighbours, so windows cut from this view
    are the codes of the windows cut from the store; overlapping windows then
    share the work, which is a lookup for each letter.
    """
    fill, complement = code_alphabet(codebook, offset)

    def code(c):
        return shift_codes(encode(c, codebook, "trusted"), offset)

    chunks = genome.chunks.withColumns({"bases": code("bases"), "ext": code("ext")})
    return replace(genome, chunks=chunks, fill=fill, complement=complement)


# --------------------------------------------------------------------------
# Bulk interval fetch
# --------------------------------------------------------------------------

def _as_col(v, default: Column) -> Column:
    if v is None:
        return default
    if isinstance(v, Column):
        return v
    if isinstance(v, str):
        return F.col(v)
    return F.lit(v)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out evenly before work that is large for each row.

    A scan's tasks are sized by the bytes they read, and a join with a broadcast
    genome would leave all bases to be cut out and written in them.  The rows go through
    a rebalancing exchange instead: round robin, so that a hot chunk is no task's own,
    with as many tasks as the measured size of the rows asks for (AQE; at least the
    cluster's parallelism).  A join that shuffles would deal its side again by key: rows of the single-join fetch
    are spread only where the chunks are small enough to be broadcast.
    """
    return df.hint("rebalance")


def _dealt_by_key(chunks: DataFrame) -> bool:
    """Whether a join with ``chunks`` deals its rows by key: the planner's estimate is above what it broadcasts."""
    conf = chunks.sparkSession._jsparkSession.sessionState().conf()
    return chunks._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() > conf.autoBroadcastJoinThreshold()


def fetch_intervals(genome: Genome, intervals: DataFrame, start="start", end="end",
                    chrom: str = "chrom", left=None, right=None, padding: str | None = None,
                    no_padding: bool = False, reverse=None, out: str = "seq",
                    max_len: int | None = None) -> DataFrame:
    """Add ``out`` = sequence of [start, end) on ``chrom`` (0-based half-open).

    Borders default to 0 and the contig length and are clamped to the
    contig.  An interval disjoint from [left, right) moves past the right
    border (all right padding).  Otherwise it is padded to its requested
    length with ``padding`` (the store's unknown base), or clipped when ``no_padding`` (may be empty).
    ``reverse`` (bool, column name or Column) takes the reverse complement.
    start >= end, an unknown contig and an interval above ``MAX_INTERVAL``
    raise.  Rows may repeat.  ``max_len``: a declared bound on end - start; if it
    is at most the halo, a single join serves all intervals, and one that
    breaks the bound raises.
    """
    in_cols = intervals.columns
    clen = F.col("_clen")
    single = max_len is not None and max_len <= genome.halo
    df = ((intervals if single else spread(intervals))
          .withColumn("_chrom", F.col(chrom))
          .withColumn("_s0", _as_col(start, None).cast("bigint"))
          .withColumn("_e0", _as_col(end, None).cast("bigint"))
          .join(genome.contigs.select(F.col("chrom").alias("_kc"), F.col("length").alias("_clen")),
                F.col("_chrom") == F.col("_kc"), "left")
          .drop("_kc"))
    zero = F.lit(0).cast("bigint")
    L = F.least(F.greatest(_as_col(left, zero).cast("bigint"), zero), clen)
    R = F.least(F.greatest(_as_col(right, clen).cast("bigint"), zero), clen)
    df = (df.withColumn("_clen", F.when(clen.isNotNull(), clen).otherwise(
              F.raise_error(F.concat(F.lit("unknown contig: "), F.col(chrom).cast("string")))))
          .withColumn("_s0", F.when(F.col("_s0") < F.col("_e0"), F.col("_s0")).otherwise(
              F.raise_error(F.lit("interval start must be smaller than end"))))
          .withColumn("_R", R).withColumn("_L", F.least(L, F.col("_R"))))
    oor = (F.col("_s0") >= F.col("_R")) | (F.col("_e0") <= F.col("_L"))
    df = (df.withColumn("_s1", F.when(oor, F.col("_R")).otherwise(F.col("_s0")))
          .withColumn("_e1", F.when(oor, F.col("_R") + F.col("_e0") - F.col("_s0")).otherwise(F.col("_e0")))
          .withColumn("_cs", F.greatest(F.col("_s1"), F.col("_L")))
          .withColumn("_ce", F.least(F.col("_e1"), F.col("_R"))))
    if no_padding:
        df = df.withColumn("_lp", zero).withColumn("_rp", zero)
    else:
        df = (df.withColumn("_lp", F.greatest(zero, F.col("_L") - F.col("_s1")))
              .withColumn("_rp", F.greatest(zero, F.col("_e1") - F.col("_R"))))
    df = df.withColumn("_n", F.col("_ce") - F.col("_cs"))

    turned = reverse is not None and reverse is not False
    rev = F.lit(turned) if not turned or reverse is True else F.coalesce(_as_col(reverse, None), F.lit(False))
    df = df.withColumn("_rev", rev)
    if single:
        core = _fetch_single(genome, df, turned)
    else:
        core = _fetch_distinct(genome, df)
        if turned:
            core = core.withColumn("_core", F.when(F.col("_rev"), reverse_complement("_core", genome.complement)).otherwise(F.col("_core")))
    # The core is on its strand: a turned one has its right padding first.
    pad = F.lit(genome.fill if padding is None else padding)
    back = reverse_complement(pad, genome.complement)
    lp, rp = F.col("_lp").cast("int"), F.col("_rp").cast("int")
    seq = F.concat(F.repeat(pad, lp), F.col("_core"), F.repeat(pad, rp))
    if turned:
        seq = F.when(F.col("_rev"), F.concat(F.repeat(back, rp), F.col("_core"), F.repeat(back, lp))).otherwise(seq)
    return core.withColumn(out, seq).select(*in_cols, out)


def _cut(text: str, at: str, n: str) -> Column:
    """``substr(text, at, n)`` of a long text.  On characters it walks the whole of it; where
    ``_flat`` says that each is one byte, it is cut as bytes."""
    part = f"cast({at} as int), cast({n} as int)"
    return F.expr(f"case when _flat then cast(substr(cast({text} as binary), {part}) as string) else substr({text}, {part}) end")


def _flat(text: str) -> Column:
    return F.octet_length(text) == F.length(text)


def _chunk_side(genome: Genome) -> DataFrame:
    return genome.chunks.select(F.col("chrom").alias("_kc"), F.col("chunk_id").alias("_kid"),
                                F.col("chunk_start").alias("_cstart"), F.col("bases").alias("_text"),
                                F.length("bases").cast("bigint").alias("_tlen"), _flat("bases").alias("_flat"))


def _fetch_single(genome: Genome, df: DataFrame, turned: bool = False) -> DataFrame:
    """Bases of [_cs, _ce) into ``_core``, every interval within the halo of
    the chunk that holds its start; with ``turned``, the reverse complement where _rev.

    What takes a lookup for each letter is done to the chunks, before the join: a turned interval
    is cut from the reverse complement of the chunk and its halo."""
    H = genome.halo
    whole = genome.chunks.select(F.col("chrom").alias("_kc"), F.col("chunk_id").alias("_kid"), F.col("chunk_start").alias("_cstart"),
                                 F.concat("bases", "ext").alias("_text")).withColumn("_flat", _flat("_text"))
    if turned:
        whole = whole.withColumns({"_tlen": F.length("_text").cast("bigint"), "_back": reverse_complement("_text", genome.complement)})
    # Rows that the join deals by key are written once for it (AQE splits those of a hot chunk); others are spread.
    by_key = _dealt_by_key(whole)
    if by_key:
        whole = whole.hint("merge")
    # Empty intervals match no chunk; their negative ids spread them.
    d = (df if by_key else spread(df)).withColumn("_cid", F.when(F.col("_n") > 0, (F.col("_cs") / genome.chunk_size).cast("bigint"))
                      .otherwise(-1 - F.pmod(F.xxhash64("_s0", "_e0"), F.lit(4096))))
    j = d.join(whole, (F.col("_chrom") == F.col("_kc")) & (F.col("_cid") == F.col("_kid")), "left")
    cut = _cut("_text", "_cs - _cstart + 1", "_n")
    if turned:
        cut = F.when(F.col("_rev"), _cut("_back", "_tlen - (_cs - _cstart) - _n + 1", "_n")).otherwise(cut)
    core = (F.when(F.col("_n") > H, F.raise_error(F.lit(
                f"interval longer than the halo ({H}); max_len was too small")).cast("string"))
            .when(F.col("_n") > 0, cut)
            .otherwise(F.lit("")))
    return j.withColumn("_core", core).drop("_kc", "_kid", "_cid", "_cstart", "_text", "_tlen", "_back", "_flat")


def _fetch_distinct(genome: Genome, df: DataFrame) -> DataFrame:
    """Bases of [_cs, _ce) into ``_core``, whatever the lengths.

    Each distinct interval is read once: one row per touched chunk, put
    together in chunk order.  The core range is clipped to the contig, so every
    touched chunk exists.
    """
    C = genome.chunk_size
    # Checked before any interval is cut into pieces.
    df = df.withColumn("_cs", F.when(F.col("_n") <= MAX_INTERVAL, F.col("_cs")).otherwise(F.raise_error(F.lit(
        f"interval of more than {MAX_INTERVAL} bases")).cast("bigint")))
    # Empty ones touch no chunk.  A filter, also one against NULL that a join infers, would be pushed below
    # the clamping and name it many times over: there is none, and the bounds (never NULL) are declared so.
    touched = F.when(F.col("_ce") > F.col("_cs"), F.sequence((F.col("_cs") / C).cast("bigint"), ((F.col("_ce") - 1) / C).cast("bigint")))
    bounds = [F.coalesce(c, F.lit(-1).cast("bigint")).alias(c) for c in ("_cs", "_ce")]
    iv = df.select("_chrom", *bounds).distinct().withColumn("_cid", F.explode(touched))
    ex = (iv.join(_chunk_side(genome), (F.col("_chrom") == F.col("_kc")) & (F.col("_cid") == F.col("_kid")))
          .withColumn("_plo", F.greatest(F.col("_cs"), F.col("_cstart")))
          .withColumn("_phi", F.least(F.col("_ce"), F.col("_cstart") + F.col("_tlen")))
          .withColumn("_piece", _cut("_text", "_plo - _cstart + 1", "_phi - _plo")))
    core = (ex.groupBy(F.col("_chrom").alias("_dc"), F.col("_cs").alias("_ds"), F.col("_ce").alias("_de"))
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_cid", "_piece"))),
                                          lambda x: x["_piece"]), "").alias("_core")))
    j = df.join(core, (F.col("_chrom") == F.col("_dc")) & (F.col("_cs") == F.col("_ds")) & (F.col("_ce") == F.col("_de")), "left")
    return j.withColumn("_core", F.coalesce("_core", F.lit(""))).drop("_dc", "_ds", "_de")


# --------------------------------------------------------------------------
# F5 job: k-mer counts over a chunked genome
# --------------------------------------------------------------------------

def kmer_counts(genome: Genome, k: int, left_pad: int = 0, right_pad: int = 0,
                step: int = 1, keys: DataFrame | None = None) -> DataFrame:
    """Counts of the k-mers that F5 emits for each whole contig.

    ``keys`` groups the counts: a table with the column ``chrom`` and one or
    more columns to count by, such as the assembly or sample a contig belongs
    to (a contig with several rows counts for each, one with none not at
    all).  Without it the counts are of the whole genome.

    A chunk row holds what its items need: its own bases and, in ``ext``, the
    first bases of the next chunk; only the contig's first chunk adds the left
    pad and its last one the right pad.  Item i begins at contig position
    i - left_pad, and the chunk that holds this position emits it (the first
    chunk the items in the left pad, the last one those in the right pad).  The explode feeds a
    map-side aggregation: the only shuffle of counts is that of (keys, kmer, count).
    The keys, a row or so for each contig, join the chunks before they are cut.
    """
    if k - 1 > genome.halo:
        raise ValueError(f"k - 1 must be at most the halo ({genome.halo})")
    lp, rp = left_pad, right_pad
    ends = genome.contigs.select(F.col("chrom").alias("_kc"), F.col("length").alias("_clen"))
    ch = genome.chunks.join(ends, F.col("chrom") == F.col("_kc")).drop("_kc")
    by = []
    if keys is not None:
        by = [c for c in keys.columns if c != "chrom"]
        if not by:
            raise ValueError("keys needs a column to count by besides chrom")
        ch = ch.join(keys.withColumnRenamed("chrom", "_kc"), F.col("chrom") == F.col("_kc"))
    n = F.length("bases")
    first, last = F.col("chunk_start") == 0, F.col("chunk_start") + n >= F.col("_clen")
    left = F.when(first, F.lit(lp)).otherwise(0)
    text = F.concat(F.repeat(F.lit("N"), left), "bases",
                    F.when(last, F.repeat(F.lit("N"), F.lit(rp))).otherwise(
                        F.concat(F.substring("ext", 1, k - 1), F.when(F.length("ext") < k - 1, F.repeat(
                            F.lit("N"), F.least(F.lit(rp), k - 1 - F.length("ext")))).otherwise(F.lit("")))))
    # Items i in [lo, hi) of this chunk; there are as many items as bases.
    lo = F.when(first, F.lit(0)).otherwise(F.col("chunk_start") + lp)
    hi = F.least(F.when(last, F.col("_clen")).otherwise(F.col("chunk_start") + n + lp), F.col("_clen"))
    ch = ch.select(*by, text.alias("_text"), lo.alias("_lo"), (hi - lo).alias("_items")).where(F.col("_items") > 0)
    # ``substr`` walks its text from the start: blocks of blocks keep the walks short.
    for size in (KMER_BLOCK ** 2, KMER_BLOCK):
        at = F.col("_j") * size
        ch = (ch.withColumn("_flat", _flat("_text"))
              .withColumn("_j", F.explode(F.sequence(F.lit(0).cast("bigint"), ((F.col("_items") - 1) / size).cast("bigint"))))
              .select(*by, _cut("_text", f"_j * {size} + 1", f"{size + k - 1}").alias("_text"),
                      (F.col("_lo") + at).alias("_lo"), F.least(F.lit(size), F.col("_items") - at).alias("_items")))
    items = ch.withColumn("_j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_items") - 1)))
    if step > 1:
        items = items.where(F.pmod(F.col("_lo") + F.col("_j"), F.lit(step)) == 0)
    return (items.select(*by, F.expr(f"substr(_text, cast(_j + 1 as int), {k})").alias("kmer"))
            .groupBy(*by, "kmer").agg(F.count(F.lit(1)).cast("bigint").alias("n")))
