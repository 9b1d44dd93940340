"""Oracle SQL for DuckDB: an independent formulation of each registered query.

The Spark side uses array set operations, chunked joins and bucketed ranks;
the oracle uses plain group-bys, whole-contig strings and window functions,
so agreement checks the semantics rather than a shared implementation.
"""

from __future__ import annotations

from ..sources.fixtures import DUCKDB_VIEWS, VIEW_DEPS
from . import params as P

_TEST = ", ".join(f"'{c}'" for c in P.TEST_CHROMS)

def _jittered(shift: int) -> str:
    return f"""
        select *, greatest(least(start + case when split = 'train' then
                     cast('0x' || substr(md5('{P.SEED}:{P.EPOCH}:' || gene || ':' || cast(tile as varchar)), 1, 8) as bigint)
                     % {2 * shift + 1} - {shift} else 0 end, tx_end - 1), tx0 - {P.FLANK} + 1) s2
        from split_tiles"""


# Extra CTEs built on the fixture views: name -> (sql, deps).
_CTES = {
    "tiles": (f"""
        select gene, paralog, chrom, strand, tx_start - 1 tx0, tx_end, s start,
               (s - (tx_start - 1)) // {P.WINDOW} tile
        from annotation, unnest(range(tx_start - 1, tx_end, {P.WINDOW})) t(s)""", ["annotation"]),
    "val_genes": (f"""
        select gene from (select distinct gene from tiles where chrom not in ({_TEST}) and paralog = 0)
        order by md5('{P.SEED}:' || gene), gene limit {P.NUM_VAL_GENES}""", ["tiles"]),
    "split_tiles": (f"""
        select t.*, case when chrom in ({_TEST}) and paralog = 0 then 'test'
                         when chrom in ({_TEST}) then null
                         when v.gene is not null then 'val' else 'train' end split
        from tiles t left join val_genes v on v.gene = t.gene""", ["tiles", "val_genes"]),
    "sites": ("""
        select f.gene, f.pos,
               case when s = 1 and e = 1 then -100
                    when s = 1 then (case when a.strand = '-' then 2 else 1 end)
                    else (case when a.strand = '-' then 1 else 2 end) end label
        from (select gene, pos, max(s) s, max(e) e from (
                select gene, cast(unnest(list_filter(string_split(jn_start, ','), lambda x: x <> '')) as bigint) - 1 pos,
                       1 s, 0 e from annotation
                union all
                select gene, cast(unnest(list_filter(string_split(jn_end, ','), lambda x: x <> '')) as bigint) - 1 pos,
                       0 s, 1 e from annotation) u
              group by gene, pos) f
        join annotation a on a.gene = f.gene
        where f.pos >= a.tx_start - 1 and f.pos < a.tx_end""", ["annotation"]),
    "contig_seq": ("""
        select chrom, string_agg(bases, '' order by line_no) seq, cast(sum(length(bases)) as bigint) len
        from fasta_lines group by chrom""", ["fasta_lines"]),
    "site_info": ("""
        select s.gene, s.pos, s.label, a.chrom, a.strand, a.tx_start - 1 tx0, a.tx_end, c.seq, c.len clen
        from sites s join annotation a on a.gene = s.gene join contig_seq c on c.chrom = a.chrom""",
                  ["sites", "annotation", "contig_seq"]),
    "logits": (f"""
        select *, a - mx - ln(exp(a - mx) + exp(b - mx) + exp(c - mx)) l0, b - mx - ln(exp(a - mx) + exp(b - mx) + exp(c - mx)) l1,
               c - mx - ln(exp(a - mx) + exp(b - mx) + exp(c - mx)) l2
        from (select *, greatest(a, b, c) mx from (
          select vec_id, label, model, z[3 * model + 2] a, z[3 * model + 3] b, z[3 * model + 4] c
          from pred3, range({P.N_MODELS}) m(model)))""", ["pred3"]),
    "passes": (f"""
        select p.model, p.label, case p.label when 0 then p.l0 when 1 then p.l1 else p.l2 end ll,
               exp(q.l0) * (q.l0 - p.l0) + exp(q.l1) * (q.l1 - p.l1) + exp(q.l2) * (q.l2 - p.l2)
               + exp(p.l0) * (p.l0 - q.l0) + exp(p.l1) * (p.l1 - q.l1) + exp(p.l2) * (p.l2 - q.l2) kl
        from logits p join logits q on p.vec_id = q.vec_id and q.model = (p.model + 1) % {P.N_MODELS}
        where p.label <> -100""", ["logits"]),
    "probs": ("""
        select vec_id, label, model,
               exp(a - mx) / (exp(a - mx) + exp(b - mx) + exp(c - mx)) p0,
               exp(b - mx) / (exp(a - mx) + exp(b - mx) + exp(c - mx)) p1,
               exp(c - mx) / (exp(a - mx) + exp(b - mx) + exp(c - mx)) p2
        from logits where label <> -100""", ["logits"]),
    "ovr": ("""
        select vec_id, model, 'donor' class, case when label = 1 then 1 else 0 end lab, p1 raw
        from probs
        union all
        select vec_id, model, 'acceptor' class, case when label = 2 then 1 else 0 end lab, p2 raw
        from probs""", ["probs"]),
    "targets": ("""
        select 'dev' target, dev y, dev_pred p from activity
        union all select 'hk' target, hk y, hk_pred p from activity""", ["activity"]),
    "progress": ("""
        select *, case when last_imp is null then epoch + 1 else epoch - last_imp end wait from (
          select *, max(case when improved then epoch end) over (partition by run_id order by epoch
                      rows between unbounded preceding and current row) last_imp from (
            select *, coalesce(s > greatest(0.0, coalesce(best_before, 0.0)), false) improved from (
              select *, max(s) over (partition by run_id order by epoch
                          rows between unbounded preceding and 1 preceding) best_before from (
                select *, case when isnan(val_score) then null else val_score end s from epoch_log))))""",
                 ["epoch_log"]),
    "jittered": (_jittered(P.SHIFT), ["split_tiles"]),
    "jittered_far": (_jittered(P.FAR_SHIFT), ["split_tiles"]),
    "grouped": ("""
        select *, row_number() over (partition by grp order by line_no) - 1 ordinal from (
          select line_no, 'g' || cast(line_no % 2 as varchar) grp, bases, length(bases) / 2 dev, cast(line_no % 97 as double) hk
          from fasta_lines where bases <> '')""", ["fasta_lines"]),
    "repeated": ("""
        select i.*, c.seq, c.len clen from intervals i join contig_seq c on c.chrom = i.chrom,
               unnest(range(0, length(gene) % 3 + 1)) t(copy)""", ["intervals", "contig_seq"]),
}


def _fetch(src: str, s0: str, e0: str, left: str = "0", right: str = "clen",
           no_padding: bool = False, reverse: str | None = None) -> str:
    """J1 over whole-contig strings: ``src`` must expose seq and clen."""
    pad_l = "0" if no_padding else "greatest(0, L - s1)"
    pad_r = "0" if no_padding else "greatest(0, e1 - R)"
    core = "case when ce > cs then substr(seq, cs + 1, ce - cs) else '' end"
    body = f"repeat('N', {pad_l}) || {core} || repeat('N', {pad_r})"
    if reverse:
        body = (f"case when {reverse} then reverse(translate({body}, 'ACGTUNacgtun', 'TGCAANtgcaan')) "
                f"else {body} end")
    return f"""(select *, {body} fseq from (
        select *, greatest(s1, L) cs, least(e1, R) ce from (
          select *, case when s0 >= R or e0 <= L then R else s0 end s1,
                    case when s0 >= R or e0 <= L then R + e0 - s0 else e0 end e1 from (
            select *, least(least(greatest({left}, 0), clen), R) L from (
              select *, least(greatest({right}, 0), clen) R from (
                select *, {s0} s0, {e0} e0 from {src}))))))"""


def _half(x: str) -> str:
    """F11 in DuckDB: nearest half-precision value (round half even)."""
    u = f"pow(2.0, greatest(floor(log2(abs({x}))), -14) - 10)"
    return (f"(case when isnan({x}) then {x} when {x} = 0 then 0.0 "
            f"else sign({x}) * round_even(abs({x}) / {u}, 0) * {u} end)")


def _topk(src: str, keys: str) -> str:
    """A3 via row_number order statistics.  src: keys, score, lab."""
    k = keys + ", " if keys else ""
    part = f"partition by {keys}" if keys else ""
    using = f"using ({keys})" if keys else "on true"
    grp = f"group by {keys}" if keys else ""
    return f"""(with r as (select *, row_number() over ({part} order by score) - 1 i,
                        count(*) over ({part}) n, sum(lab) over ({part}) npos from {src}),
         hq as (select {k} any_value(n) n, any_value(npos) npos,
                       (any_value(n) - 1) * (1 - any_value(npos) / any_value(n)) h from r {grp}),
         x as (select {k} any_value(hq.n) n, any_value(hq.npos) npos, any_value(h) h,
                      max(case when i = floor(h) then score end) a,
                      max(case when i = floor(h) + 1 then score end) b0
               from r join hq {using} {grp}),
         q as (select *, coalesce(b0, a) b, h - floor(h) t from x),
         qq as (select *, case when t >= 0.5 then b - (b - a) * (1 - t) else a + (b - a) * t end q from q)
    select {k} cast(any_value(qq.n) as bigint) n, cast(any_value(qq.npos) as bigint) n_pos,
           round(any_value(q), 6) threshold,
           round(case when any_value(qq.npos) = 0 then 'nan'::double else
                 sum(case when score >= q then lab else 0 end)
                 / greatest(1, sum(case when score >= q then 1 else 0 end)) end, 6) topk_precision
    from {src} s join qq {using} {grp})"""


def _ap(src: str, keys: str) -> str:
    """A4 via descending running sums over distinct scores."""
    k = keys + ", " if keys else ""
    part = f"partition by {keys}" if keys else ""
    grp = f"group by {keys}" if keys else ""
    return f"""(with d as (select {k} score, count(*) c, sum(lab) p from {src} group by {k} score),
         w as (select *, sum(c) over ({part} order by score desc rows between unbounded preceding and current row) n_ge,
                         sum(p) over ({part} order by score desc rows between unbounded preceding and current row) tp_ge,
                         sum(p) over ({part}) npos, sum(c) over ({part}) n from d)
    select {k} cast(any_value(n) as bigint) n, cast(any_value(npos) as bigint) n_pos,
           round(case when any_value(npos) = 0 then 'nan'::double else sum(p * tp_ge / n_ge) / any_value(npos) end, 6)
           average_precision
    from w {grp})"""


def _b(q: str) -> str:
    """Upper-case base at genomic position q inside the transcript and the
    contig, else N (site_info columns)."""
    return (f"(case when ({q}) >= tx0 and ({q}) < least(tx_end, clen) and ({q}) >= 0 "
            f"then upper(substr(seq, ({q}) + 1, 1)) else 'N' end)")


def _c(x: str) -> str:
    return f"translate({x}, 'ACGTUN', 'TGCAAN')"


def _with(*names: str) -> str:
    order: list[str] = []

    def visit(n):
        deps = VIEW_DEPS[n] if n in VIEW_DEPS else _CTES[n][1]
        for d in deps:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    parts = []
    for n in order:
        body = DUCKDB_VIEWS[n] if n in DUCKDB_VIEWS else _CTES[n][0]
        parts.append(f"{n} as ({body})")
    return "with " + ",\n".join(parts) + "\n"


def _window_labels(jittered: str) -> str:
    return _with(jittered, "sites") + f"""
        select gene, cast(tile as bigint) tile,
               md5(string_agg(case when lab = -100 then 'x' else cast(lab as varchar) end, ''
                              order by case when strand = '-' then -p else p end)) labels_md5,
               cast(sum(case when lab = 1 then 1 else 0 end) as bigint) n_donor,
               cast(sum(case when lab = 2 then 1 else 0 end) as bigint) n_acceptor,
               cast(sum(case when lab = -100 then 1 else 0 end) as bigint) n_ignored
        from (select j.gene, j.tile, j.strand, t.p,
                     case when t.p < j.tx0 or t.p >= j.tx_end then -100 else coalesce(s.label, 0) end lab
              from {jittered} j, unnest(range(j.s2, j.s2 + {P.WINDOW})) t(p)
              left join sites s on s.gene = j.gene and s.pos = t.p)
        group by gene, tile"""


_NFIRST = """
        select line_no, cast(length(bases) as bigint) n, md5(case when bases = '' then '' else
               array_to_string(list_transform(string_split(bases, ''), lambda c: case upper(c) when 'N' then '0' when 'A' then '1' when 'C' then '2' when 'G' then '3' when 'T' then '4' when 'U' then '4' end), '') end) codes_md5
        from fasta_lines"""

_TOKENS = f"""(
          select *, '2' || array_to_string(list_transform(string_split(wseq, ''), lambda c: case upper(c) when 'N' then '5' when 'A' then '6' when 'C' then '7' when 'G' then '8' when 'T' then '9' when 'U' then '9' end), '') || '3' tok from (
          select *, case when strand = '-' then reverse(translate(w, 'ACGTUNacgtun', 'TGCAANtgcaan')) else w end wseq
          from (select *, repeat('N', seq_lo - (s2 - {P.FLANK})) || fseq || repeat('N', s2 + {P.WINDOW + P.FLANK} - seq_hi) w
                from """ + _fetch(
        f"""(select t.*, greatest(s2 - {P.FLANK}, tx0) seq_lo, least(s2 + {P.WINDOW + P.FLANK}, tx_end) seq_hi,
                   c.seq, c.len clen from (select *, greatest(least(start, tx_end - 1), tx0 - {P.FLANK} + 1) s2 from tiles) t
                   join contig_seq c on c.chrom = t.chrom)""",
        "seq_lo", "seq_hi") + ")))"

ORACLE = {
    "site_labels": _with("sites") + "select gene, cast(pos as bigint) pos, cast(label as bigint) label from sites",
    "tiles": _with("tiles") + "select gene, cast(tile as bigint) tile, cast(start as bigint) start from tiles",
    "exclude_paralogs": _with("tiles") + """
        select chrom, cast(count(distinct gene) as bigint) n_genes, cast(count(*) as bigint) n_windows
        from tiles where paralog = 0 group by chrom""",
    "split_assignment": _with("split_tiles") + "select gene, cast(tile as bigint) tile, split from split_tiles",
    "split_summary": _with("split_tiles") + """
        select split, chrom, cast(count(*) as bigint) n_windows, cast(count(distinct gene) as bigint) n_genes
        from split_tiles group by split, chrom""",
    "split_leakage": _with("split_tiles") + """
        select cast(count(*) as bigint) n_genes, cast(sum(case when n > 1 then 1 else 0 end) as bigint) n_leaking,
               cast(sum(tr * va) as bigint) train_val, cast(sum(tr * te) as bigint) train_test,
               cast(sum(va * te) as bigint) val_test
        from (select gene, count(distinct split) n,
                     max(case when split = 'train' then 1 else 0 end) tr,
                     max(case when split = 'val' then 1 else 0 end) va,
                     max(case when split = 'test' then 1 else 0 end) te
              from split_tiles where split is not null group by gene)""",
    "window_bounds": _with("tiles") + f"""
        select gene, cast(tile as bigint) tile, s2 start, s2 + {P.WINDOW} "end", s2 - {P.FLANK} "left",
               s2 + {P.WINDOW + P.FLANK} "right", greatest(s2, tx0) lab_lo, least(s2 + {P.WINDOW}, tx_end) lab_hi,
               greatest(s2 - {P.FLANK}, tx0) seq_lo, least(s2 + {P.WINDOW + P.FLANK}, tx_end) seq_hi
        from (select *, greatest(least(start, tx_end - 1), tx0 - {P.FLANK} + 1) s2 from tiles)""",
    "window_jitter": _with("jittered") + f"""
        select gene, cast(tile as bigint) tile, split, s2 start, s2 + {P.WINDOW} "end",
               greatest(s2, tx0) lab_lo, least(s2 + {P.WINDOW}, tx_end) lab_hi from jittered""",
    "genome_contigs": _with("fasta_lines") + """
        select chrom, cast(sum(length(bases)) as bigint) length from fasta_lines group by chrom""",
    "genome_chunks": _with("contig_seq") + f"""
        select chrom, cast(i as bigint) chunk_id, cast(i * {P.CHUNK} as bigint) chunk_start,
               cast(length(substr(seq, i * {P.CHUNK} + 1, {P.CHUNK})) as bigint) n_bases,
               md5(substr(seq, i * {P.CHUNK} + 1, {P.CHUNK})) bases_md5,
               md5(substr(seq, (i + 1) * {P.CHUNK} + 1, {P.HALO})) ext_md5
        from contig_seq, unnest(range(0, (len + {P.CHUNK - 1}) // {P.CHUNK})) t(i)""",
    "fetch_intervals": _with("intervals", "contig_seq") + """
        select gene, cast(length(fseq) as bigint) seq_len, md5(fseq) seq_md5 from """ + _fetch(
        "(select i.*, c.seq, c.len clen from intervals i join contig_seq c on c.chrom = i.chrom)",
        "start_pos", "end_pos"),
    "fetch_intervals_bordered": _with("intervals", "contig_seq") + """
        select gene, cast(length(fseq) as bigint) seq_len, md5(fseq) seq_md5 from """ + _fetch(
        "(select i.*, c.seq, c.len clen from intervals i join contig_seq c on c.chrom = i.chrom)",
        "start_pos", "end_pos", left="start_pos + 5", right="end_pos - 5", reverse="strand = '-'"),
    "fetch_clipped": _with("intervals", "contig_seq") + """
        select gene, cast(length(fseq) as bigint) seq_len, md5(fseq) seq_md5 from """ + _fetch(
        "(select i.*, c.seq, c.len clen from intervals i join contig_seq c on c.chrom = i.chrom)",
        "start_pos", "end_pos", no_padding=True),
    "fetch_repeated": _with("repeated") + """
        select gene, cast(length(fseq) as bigint) seq_len, md5(fseq) seq_md5 from """ + _fetch("repeated", "start_pos", "end_pos"),
    "fetch_long": _with("repeated") + """
        select gene, cast(length(fseq) as bigint) seq_len, md5(fseq) seq_md5 from """ + _fetch(
        "repeated", "start_pos", f"end_pos + {2 * P.CHUNK}"),
    "fetch_pruned": _with("intervals", "contig_seq") + """
        select gene, cast(length(fseq) as bigint) seq_len, md5(fseq) seq_md5 from """ + _fetch(
        f"(select i.*, c.seq, c.len clen from intervals i join contig_seq c on c.chrom = i.chrom where i.chrom in ('chr4', 'chr11') and end_pos <= {2 * P.CHUNK})",
        "start_pos", "end_pos"),
    "window_sequences": _with("jittered", "contig_seq") + f"""
        select gene, cast(tile as bigint) tile, cast(length(wseq) as bigint) seq_len, md5(wseq) seq_md5 from (
          select *, case when strand = '-' then reverse(translate(w, 'ACGTUNacgtun', 'TGCAANtgcaan')) else w end wseq
          from (select *, repeat('N', seq_lo - (s2 - {P.FLANK})) || fseq || repeat('N', s2 + {P.WINDOW + P.FLANK} - seq_hi) w
                from """ + _fetch(
        f"""(select j.*, greatest(s2 - {P.FLANK}, tx0) seq_lo, least(s2 + {P.WINDOW + P.FLANK}, tx_end) seq_hi,
                   c.seq, c.len clen from jittered j join contig_seq c on c.chrom = j.chrom)""",
        "seq_lo", "seq_hi") + "))",
    "window_labels": _window_labels("jittered"),
    "window_labels_far": _window_labels("jittered_far"),
    "window_tokens": _with("tiles", "contig_seq") + f"""
        select gene, cast(tile as bigint) tile, cast(length(tok) as bigint) n_tokens, md5(tok) tokens_md5 from {_TOKENS}""",
    "score_sequences": _with("tiles", "contig_seq") + f"""
        select gene, cast(tile as bigint) tile,
               cast(list_sum(list_transform(string_split(tok, ''), lambda c: cast(c as int))) as bigint) total,
               cast(length(tok) - length(replace(tok, '6', '')) as bigint) n_a from {_TOKENS}""",
    "score_windows": _with("tiles", "contig_seq", "sites") + f"""
        select t.gene, cast(t.tile as bigint) tile, cast(count(*) as bigint) n, cast(sum(lab) as bigint) labels,
               cast(sum(k * (i + 1)) as bigint) weighted, cast(sum(k % 3) as bigint) thirds, cast(sum({P.FLANK + 1}) as bigint) places
        from (select w.*, i, cast(substr(tok, {P.FLANK + 2} + i, 1) as int) k,
                     case when p < tx0 or p >= tx_end then -100 else coalesce(s.label, 0) end lab
              from (select *, case when strand = '-' then s2 + {P.WINDOW - 1} - i else s2 + i end p
                    from {_TOKENS} q, unnest(range(0, {P.WINDOW})) u(i)) w
              left join sites s on s.gene = w.gene and s.pos = w.p) t
        group by t.gene, t.tile""",
    "read_fasta_lines": _with("fasta_lines") + """
        select chrom, row_number() over (partition by chrom order by line_no) n, md5(bases) bases_md5 from fasta_lines where bases <> ''""",
    "read_fasta_blocks": _with("fasta_lines") + """
        select chrom, row_number() over (partition by chrom order by line_no) n, md5(bases) bases_md5 from fasta_lines where bases <> ''""",
    "read_fasta_records": _with("contig_seq") + "select chrom as name, len length, md5(seq) bases_md5 from contig_seq",
    "read_fasta_pieces": _with("contig_seq") + f"""
        select chrom as name, cast(i as bigint) piece, cast(i * {P.PIECE} as bigint) as start, len length, md5(substr(seq, i * {P.PIECE} + 1, {P.PIECE})) bases_md5
        from contig_seq, unnest(range(0, (len + {P.PIECE - 1}) // {P.PIECE})) t(i)""",
    "read_equal_records": _with("fasta_lines") + """
        select 's' || cast(line_no as varchar) as name, cast(40 as bigint) length, md5(substr(bases, 1, 40)) bases_md5 from fasta_lines where length(bases) >= 40""",
    "read_activity": _with("grouped") + "select grp as group, ordinal, dev y_dev, hk y_hk from grouped".replace("as group", 'as "group"'),
    "positional_join": _with("grouped") + """
        select grp as "group", ordinal, 's' || cast(line_no as varchar) as name, md5(bases) bases_md5, dev y_dev from grouped""",
    "read_annotation": _with("annotation") + """
        select gene, cast(paralog as bigint) paralog, chrom, strand, tx_start, tx_end, jn_start, jn_end from annotation""",
    "materialize": _with("tiles") + "select gene, cast(tile as bigint) tile, cast(start as bigint) start from tiles",
    "write_predictions": _with("progress") + """
        select run_id, cast(epoch as bigint) epoch, round(val_score, 6) dev, round(val_score * 2, 6) dev_preds,
               cast(epoch as double) hk, cast(1.5 as double) hk_preds
        from (select *, min(case when wait > 5 then epoch end) over (partition by run_id) stop_epoch from progress)
        where improved and (stop_epoch is null or epoch <= stop_epoch)""",
    "append_metrics": _with("epoch_log") + """
        select cast(run_id % 8 as bigint) run_id, tag, cast(count(*) as bigint) n, round(sum(value), 6) total, cast(max(epoch) as bigint) last_step
        from (select run_id, epoch, 'valid/score' tag, val_score value from epoch_log
              union all select run_id, epoch, 'valid/twice', val_score * 2 from epoch_log) group by 1, 2""",
    "attach_gene_info": _with("tiles") + """
        select gene, cast(tile as bigint) tile, cast(start as bigint) start, chrom, strand, cast(tx0 as bigint) tx_start, tx_end from tiles""",
    "member_of": _with("tiles") + f"""
        select gene, cast(tile as bigint) tile from tiles where chrom in ({_TEST}) and paralog = 1""",
    "distinct_genes": _with("tiles") + "select distinct gene from tiles",
    "splice_motifs": _with("site_info") + f"""
        select kind, motif, cast(count(*) as bigint) n from (
          select case when label = 1 then 'donor' else 'acceptor' end kind,
                 case when label = 1 and strand = '+' then {_b("pos + 1")} || {_b("pos + 2")}
                      when label = 2 and strand = '+' then {_b("pos - 2")} || {_b("pos - 1")}
                      when label = 1 then {_c(_b("pos - 1"))} || {_c(_b("pos - 2"))}
                      else {_c(_b("pos + 2"))} || {_c(_b("pos + 1"))} end motif
          from site_info where label in (1, 2))
        group by kind, motif""",
    "label_counts": _with("site_info") + f"""
        select chrom, cast(sum(case when label = 1 then 1 else 0 end) as bigint) n_donors,
               cast(sum(case when label = 2 then 1 else 0 end) as bigint) n_acceptors,
               cast(sum(case when label = -100 and {_b("pos")} <> 'N' then 1 else 0 end) as bigint) n_unknown
        from site_info group by chrom""",
    "write_encoded_sequences": _with("fasta_lines") + _NFIRST,
    "encode_nfirst": _with("fasta_lines") + _NFIRST,
    "encode_afirst": _with("fasta_lines") + """
        select line_no, cast(length(bases) as bigint) n, md5(case when bases = '' then '' else
               array_to_string(list_transform(string_split(bases, ''), lambda c: case upper(c) when 'N' then '4' when 'A' then '0' when 'C' then '1' when 'G' then '2' when 'T' then '3' when 'U' then '4' end), '') end) codes_md5
        from fasta_lines""",
    "reverse_complement": _with("fasta_lines") + """
        select line_no, md5(case when bases = '' then '' else array_to_string(list_reverse(list_transform(
               string_split(bases, ''), lambda c: case c when 'A' then 'T' when 'C' then 'G' when 'G' then 'C'
               when 'T' then 'A' when 'U' then 'A' when 'N' then 'N' when 'a' then 't' when 'c' then 'g'
               when 'g' then 'c' when 't' then 'a' when 'u' then 'a' when 'n' then 'n' end)), '') end) rc_md5
        from fasta_lines""",
    "reverse_complement_codes": _with("fasta_lines") + """
        select line_no, md5(rc) digits_md5, md5(rc) array_md5 from (
          select line_no, reverse(translate(translate(upper(bases), 'ACGTUN', '123440'), '01234', '04321')) rc from fasta_lines)""",
    "kmers": _with("fasta_lines") + f"""
        select line_no, cast(len(km) as bigint) n_kmers, md5(array_to_string(km, ',')) kmers_md5 from (
          select line_no, list_transform(range(0, length(bases), {P.KMER_STEP}),
                 lambda i: substr(repeat('N', {P.KMER_LEFT}) || bases || repeat('N', {P.KMER_RIGHT}), i + 1, {P.KMER_K})) km
          from fasta_lines)""",
    "kmer_counts": _with("contig_seq") + f"""
        select substr(repeat('N', {P.KMER_LEFT}) || seq || repeat('N', {P.KMER_RIGHT}), i + 1, {P.KMER_K}) kmer,
               cast(count(*) as bigint) n
        from contig_seq, unnest(range(0, len, {P.KMER_STEP})) t(i) group by kmer""",
    "kmer_counts_by_key": _with("contig_seq") + f"""
        , g as (select chrom, substr(repeat('N', {P.KMER_LEFT}) || seq || repeat('N', {P.KMER_RIGHT}), i + 1, {P.KMER_K}) kmer
                   from contig_seq, unnest(range(0, len, {P.KMER_STEP})) t(i))
        select chrom as key, kmer, cast(count(*) as bigint) n from g group by all
        union all
        select case when cast(substr(chrom, 4) as int) % 2 = 0 then 'even' else 'odd' end, kmer, cast(count(*) as bigint) from g group by all""",
    "softmax_scores": _with("probs") + """
        select vec_id, cast(model as bigint) model, round(p0, 6) p0, round(p1, 6) p1, round(p2, 6) p2 from probs""",
    "half_precision": _with("scored") + f"select event_id, {_half('score')} half from scored",
    "one_vs_rest": _with("ovr") + f"""
        select vec_id, cast(model as bigint) model, class, cast(lab as bigint) label, {_half('raw')} score from ovr""",
    "center_slice": _with("pred3") + f"""
        select vec_id, cast(len(sl) as bigint) n_kept, round(list_reduce(sl, lambda a, x: a + x, 0.0), 6) center_sum
        from (select vec_id, z[{P.CENTER_FLANK + 2}:{P.CENTER_FLANK + 1 + P.CENTER_WINDOW}] sl
              from pred3 where label <> -100)""",
    "topk_precision": _with("ovr") + "select cast(model as bigint) model, class, n, n_pos, threshold, topk_precision from "
        + _topk(f"(select model, class, lab, {_half('raw')} score from ovr)", "model, class"),
    "topk_precision_scored": _with("scored") + "select n, n_pos, threshold, topk_precision from "
        + _topk(f"(select label lab, {_half('score')} score from scored)", ""),
    "average_precision": _with("ovr") + "select cast(model as bigint) model, class, n, n_pos, average_precision from "
        + _ap(f"(select model, class, lab, {_half('raw')} score from ovr)", "model, class"),
    "average_precision_scored": _with("scored") + "select n, n_pos, average_precision from "
        + _ap(f"(select label lab, {_half('score')} score from scored)", ""),
    "ensemble_topk": _with("ovr") + f"""
        select t.class, t.topk_precision, a.average_precision from """
        + _topk(f"(select class, any_value(lab) lab, {_half('avg(raw)')} score from ovr group by vec_id, class)", "class")
        + " t join " + _ap(f"(select class, any_value(lab) lab, {_half('avg(raw)')} score from ovr group by vec_id, class)", "class")
        + " a on a.class = t.class",
    "seed_summary": _with("ovr") + """
        select class, cast(count(*) as bigint) n_runs, round(avg(topk_precision), 6) mean,
               round(stddev_samp(topk_precision), 6) sd_samp, round(stddev_pop(topk_precision), 6) sd_pop from (
        select class, topk_precision from """
        + _topk(f"(select model, class, lab, {_half('raw')} score from ovr)", "model, class") + ") group by class",
    "cross_entropy": _with("passes") + """
        select cast(model as bigint) model, round(avg(-ll), 6) cross_entropy, cast(count(*) as bigint) n from passes group by model""",
    "symmetric_kl": _with("passes") + """
        select cast(model as bigint) model, round(sum(kl) / count(*), 6) symmetric_kl, cast(count(*) as bigint) n
        from passes where label >= 0 group by model""",
    "combined_loss": _with("passes") + f"""
        select cast(model as bigint) model, round(avg(-ll), 6) cross_entropy, round(sum(kl) / count(*), 6) symmetric_kl,
               round(avg(-ll) + {P.KL_WEIGHT} * (sum(kl) / count(*)), 6) loss from passes group by model""",
    "pearson": _with("targets") + """
        select target, cast(count(*) as bigint) n, round(covar_pop(y, p) / sqrt(var_pop(y) * var_pop(p)), 6) pearson
        from targets group by target""",
    "spearman": _with("targets") + """
        select target, cast(count(*) as bigint) n, round(covar_pop(ry, rp) / sqrt(var_pop(ry) * var_pop(rp)), 6) spearman
        from (select target,
                     rank() over (partition by target order by y) - 1 + (count(*) over (partition by target, y) + 1) / 2.0 ry,
                     rank() over (partition by target order by p) - 1 + (count(*) over (partition by target, p) + 1) / 2.0 rp
              from targets) group by target""",
    "spearman_nulls": _with("activity") + """
        select cast(l_linenumber as bigint) line, cast(count(*) as bigint) n,
               round(covar_pop(ry, rp) / sqrt(var_pop(ry) * var_pop(rp)), 6) spearman
        from (select l_linenumber,
                     rank() over (partition by l_linenumber order by dev) - 1 + (count(*) over (partition by l_linenumber, dev) + 1) / 2.0 ry,
                     rank() over (partition by l_linenumber order by dev_pred) - 1
                         + (count(*) over (partition by l_linenumber, dev_pred) + 1) / 2.0 rp
              from activity where l_orderkey % 7 <> 0 and l_orderkey % 11 <> 0) group by l_linenumber""",
    "mse": _with("activity") + """
        select round(avg((dev_pred - dev) ^ 2), 6) mse_dev, round(avg((hk_pred - hk) ^ 2), 6) mse_hk,
               round(avg((dev_pred - dev) ^ 2) + avg((hk_pred - hk) ^ 2), 6) mse_total from activity""",
    "trailing_mean": _with("epoch_log") + f"""
        select run_id, cast(epoch as bigint) epoch,
               round(avg(val_score) over (partition by run_id order by epoch
                     range between {P.TRAILING_N - 1} preceding and current row), 6) trailing_mean from epoch_log""",
    "trailing_mean_100": _with("epoch_log") + """
        select run_id, cast(epoch as bigint) epoch,
               round(avg(val_score) over (partition by run_id order by epoch range between 99 preceding and current row), 12) trailing_mean from epoch_log""",
    "best_epoch": _with("progress") + """
        select run_id, cast(any_value(stop_epoch) as bigint) stop_epoch, cast(count(*) as bigint) n_epochs,
               cast(max(case when improved then epoch end) as bigint) best_epoch,
               round(arg_max(case when improved then val_score end, case when improved then epoch end), 6) best_score
        from (select *, min(case when wait > 5 then epoch end) over (partition by run_id) stop_epoch from progress)
        where stop_epoch is null or epoch <= stop_epoch group by run_id""",
    "best_epoch_splice": _with("progress") + """
        select run_id, cast(any_value(stop_epoch) as bigint) stop_epoch, cast(count(*) as bigint) n_epochs,
               cast(max(case when improved then epoch end) as bigint) best_epoch,
               round(arg_max(case when improved then val_score end, case when improved then epoch end), 6) best_score
        from (select *, min(case when wait >= 20 then epoch end) over (partition by run_id) stop_epoch from progress)
        where stop_epoch is null or epoch <= stop_epoch group by run_id""",
    "test_at_best": _with("progress") + """
        select b.run_id, cast(b.best_epoch as bigint) epoch, round(l.val_score, 6) val_score
        from epoch_log l right join (
          select run_id, max(case when improved then epoch end) best_epoch
          from (select *, min(case when wait > 5 then epoch end) over (partition by run_id) stop_epoch from progress)
          where stop_epoch is null or epoch <= stop_epoch group by run_id) b
        on l.run_id = b.run_id and l.epoch = b.best_epoch""",
    "shuffle_batches": _with("split_tiles") + f"""
        select gene, cast(tile as bigint) tile, split, cast(r // {P.BATCH_SIZE} as bigint) batch_id,
               cast(r % {P.BATCH_SIZE} as bigint) batch_pos from (
          select *, row_number() over (partition by split order by h, gene, tile) - 1 r from (
            select *, case when split = 'train'
                           then md5('{P.SEED}:{P.EPOCH}:' || gene || ':' || cast(tile as varchar))
                           else md5(gene) end h from split_tiles where split is not null))""",
    "shuffle_batches_file_order": _with("split_tiles") + f"""
        , l as (select gene, row_number() over (order by chrom, tx_start, gene) - 1 line_no from annotation)
        select gene, cast(tile as bigint) tile, split, line_no, cast(r // {P.ORDER_BATCH} as bigint) batch_id,
               cast(r % {P.ORDER_BATCH} as bigint) batch_pos from (
          select *, row_number() over (partition by split order by o, h, gene, tile) - 1 r from (
            select s.*, line_no, case when split <> 'train' then line_no end o,
                   case when split = 'train' then md5('{P.SEED}:{P.EPOCH}:' || gene || ':' || cast(tile as varchar)) end h
            from split_tiles s join l using (gene) where split is not null))""",
    "sample_fraction": _with("tiles") + f"""
        select gene, cast(tile as bigint) tile from tiles
        where cast('0x' || substr(md5('{P.SEED}:' || gene || ':' || cast(tile as varchar)), 1, 8) as bigint)
              / 4294967296.0 < {P.SAMPLE_FRACTION}""",
}
