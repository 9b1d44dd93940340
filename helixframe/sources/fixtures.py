"""Test inputs derived from the driver's tables (FIXTURES.md part 2).

Each view is a DataFrame built from the parquet tables under ``sf_dir`` so
its size grows with the data.  Views are passed to ``spark.sql`` as
DataFrame arguments instead of session-wide temp views, so several scale
factors can be open in one session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fasta_lines(spark, sf_dir) -> DataFrame:
    """(chrom, line_no, bases): FASTA-like lines, contig = lines in line_no order."""
    return spark.sql(
        "select concat('chr', cast(doc_id % 25 + 1 as string)) chrom, doc_id line_no, "
        # A run of other letters is one match: the same bases for a fraction of the time.
        "regexp_replace(text, '[^ACGTNUacgtnu]+', '') bases from {documents}",
        documents=table(spark, sf_dir, "documents"))


def gene_base(spark, sf_dir) -> DataFrame:
    return spark.sql(
        "select concat('G', cast(o_orderkey as string)) gene, o_orderkey, "
        "case when o_orderpriority = '1-URGENT' then 1 else 0 end paralog, "
        "concat('chr', cast(o_custkey % 25 + 1 as string)) chrom, "
        "case when o_orderstatus = 'F' then '-' else '+' end strand, "
        "(o_orderkey * 37) % 4000 + 1 tx_start1, 200 + (o_orderkey % 7) * 150 tx_len from {orders}",
        orders=table(spark, sf_dir, "orders"))


def junctions(spark, sf_dir) -> DataFrame:
    return spark.sql(
        "select g.gene, tx_start1 - 20 + (l_partkey * 13) % (tx_len + 40) js, "
        "case when l_linenumber % 5 = 0 then tx_start1 - 20 + (l_partkey * 13) % (tx_len + 40) "
        "else tx_start1 - 20 + (l_suppkey * 29 + l_linenumber * 101) % (tx_len + 40) end je "
        "from {gene_base} g join {lineitem} on l_orderkey = o_orderkey",
        gene_base=gene_base(spark, sf_dir), lineitem=table(spark, sf_dir, "lineitem"))


def annotation(spark, sf_dir) -> DataFrame:
    """The annotation file layout: lists as text with a trailing comma."""
    return spark.sql(
        "select g.gene, paralog, chrom, strand, tx_start1 tx_start, tx_start1 + tx_len - 1 tx_end, "
        "coalesce(a.jn_start, '') jn_start, coalesce(a.jn_end, '') jn_end "
        "from {gene_base} g left join ( "
        "  select gene, listagg(cast(js as string) || ',', '') within group (order by js) jn_start, "
        "         listagg(cast(je as string) || ',', '') within group (order by je) jn_end "
        "  from {junctions} group by gene) a on a.gene = g.gene",
        gene_base=gene_base(spark, sf_dir), junctions=junctions(spark, sf_dir))


def intervals(spark, sf_dir) -> DataFrame:
    return spark.sql(
        # Joined with the few contigs broadcast: dealt by contig, or streamed past broadcast genes, all rows would be some tasks' own.
        "select /*+ broadcast(c) */ g.gene, g.chrom, g.strand, "
        "case when o_orderkey % 50 = 0 then 90000000 + o_orderkey "
        "     when o_orderkey % 50 = 25 then c.len - 10 else tx_start1 - 301 end start_pos, "
        "case when o_orderkey % 50 = 0 then 90000000 + o_orderkey + 25 "
        "     when o_orderkey % 50 = 25 then c.len + 20 else tx_start1 - 1 + tx_len + 300 end end_pos "
        "from {gene_base} g "
        "join (select chrom, cast(sum(length(bases)) as bigint) len from {fasta_lines} group by chrom) c "
        "on c.chrom = g.chrom",
        gene_base=gene_base(spark, sf_dir), fasta_lines=fasta_lines(spark, sf_dir))


def pred3(spark, sf_dir) -> DataFrame:
    return spark.sql(
        "select vec_id, case when label = 9 then -100 when label < 6 then 0 when label < 8 then 1 else 2 end label, "
        "transform(embedding, x -> cast(x as double)) z from {embeddings}",
        embeddings=table(spark, sf_dir, "embeddings"))


def scored(spark, sf_dir) -> DataFrame:
    return spark.sql(
        "select event_id, case when event_type in ('error', 'signup') and value > 20 then 1 else 0 end label, "
        "value / 500.0 score from {events}",
        events=table(spark, sf_dir, "events"))


def activity(spark, sf_dir) -> DataFrame:
    return spark.sql(
        "select l_orderkey, l_linenumber, l_extendedprice dev, "
        "cast(0.7 as double) * l_extendedprice + cast(600 as double) * l_quantity dev_pred, "
        "l_tax hk, l_discount hk_pred from {lineitem}",
        lineitem=table(spark, sf_dir, "lineitem"))


def epoch_log(spark, sf_dir) -> DataFrame:
    return spark.sql(
        "select user_id run_id, row_number() over (partition by user_id order by ts, event_id) - 1 epoch, "
        "value / 500.0 val_score from {events}",
        events=table(spark, sf_dir, "events"))


# DuckDB text of the same views, used by the oracle SQL (FIXTURES.md).
DUCKDB_VIEWS = {
    "fasta_lines": "select concat('chr', cast(doc_id % 25 + 1 as string)) chrom, doc_id line_no, "
                   "regexp_replace(text, '[^ACGTNUacgtnu]', '', 'g') bases from documents",
    "gene_base": "select concat('G', cast(o_orderkey as string)) gene, o_orderkey, "
                 "case when o_orderpriority = '1-URGENT' then 1 else 0 end paralog, "
                 "concat('chr', cast(o_custkey % 25 + 1 as string)) chrom, "
                 "case when o_orderstatus = 'F' then '-' else '+' end strand, "
                 "(o_orderkey * 37) % 4000 + 1 tx_start1, 200 + (o_orderkey % 7) * 150 tx_len from orders",
    "junctions": "select g.gene, tx_start1 - 20 + (l_partkey * 13) % (tx_len + 40) js, "
                 "case when l_linenumber % 5 = 0 then tx_start1 - 20 + (l_partkey * 13) % (tx_len + 40) "
                 "else tx_start1 - 20 + (l_suppkey * 29 + l_linenumber * 101) % (tx_len + 40) end je "
                 "from gene_base g join lineitem on l_orderkey = o_orderkey",
    "annotation": "select g.gene, paralog, chrom, strand, tx_start1 tx_start, tx_start1 + tx_len - 1 tx_end, "
                  "coalesce(a.jn_start, '') jn_start, coalesce(a.jn_end, '') jn_end "
                  "from gene_base g left join ( "
                  "  select gene, string_agg(cast(js as string) || ',', '' order by js) jn_start, "
                  "         string_agg(cast(je as string) || ',', '' order by je) jn_end "
                  "  from junctions group by gene) a on a.gene = g.gene",
    "intervals": "select g.gene, g.chrom, g.strand, "
                 "case when o_orderkey % 50 = 0 then 90000000 + o_orderkey "
                 "     when o_orderkey % 50 = 25 then c.len - 10 else tx_start1 - 301 end start_pos, "
                 "case when o_orderkey % 50 = 0 then 90000000 + o_orderkey + 25 "
                 "     when o_orderkey % 50 = 25 then c.len + 20 else tx_start1 - 1 + tx_len + 300 end end_pos "
                 "from gene_base g "
                 "join (select chrom, cast(sum(length(bases)) as bigint) len from fasta_lines group by chrom) c "
                 "on c.chrom = g.chrom",
    "pred3": "select vec_id, case when label = 9 then -100 when label < 6 then 0 when label < 8 then 1 else 2 end label, "
             "list_transform(embedding, lambda x: cast(x as double)) z from embeddings",
    "scored": "select event_id, case when event_type in ('error', 'signup') and value > 20 then 1 else 0 end label, "
              "value / 500.0 score from events",
    "activity": "select l_orderkey, l_linenumber, l_extendedprice dev, "
                "cast(0.7 as double) * l_extendedprice + cast(600 as double) * l_quantity dev_pred, "
                "l_tax hk, l_discount hk_pred from lineitem",
    "epoch_log": "select user_id run_id, row_number() over (partition by user_id order by ts, event_id) - 1 epoch, "
                 "value / 500.0 val_score from events",
}
# Which views each view needs, so the oracle only inlines what it uses.
VIEW_DEPS = {
    "fasta_lines": [], "gene_base": [], "junctions": ["gene_base"],
    "annotation": ["gene_base", "junctions"], "intervals": ["gene_base", "fasta_lines"],
    "pred3": [], "scored": [], "activity": [], "epoch_log": [],
}


def duckdb_with(*names: str) -> str:
    """A ``WITH`` prefix defining the named fixture views (and their deps)."""
    order: list[str] = []

    def visit(n):
        for d in VIEW_DEPS[n]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    return "with " + ",\n".join(f"{n} as ({DUCKDB_VIEWS[n]})" for n in order) + "\n"
