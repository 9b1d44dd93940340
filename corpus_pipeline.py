"""Corpus pipeline: quality classifier, exact dedup, near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the columns of documents; the last
returns the packed pieces.  ``run`` writes each stage's rows as Parquet below the shared folder and reads them back.

Nulls, empty texts, ties, repeated rows, empty tables and extra columns are handled as each operator's docstring says: a
null text is scored as empty, equals other empty texts, has no near copy and no benchmark words, and packs to its
end id; of rows that repeat, one stays after exact dedup; extra columns pass through to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import decontaminate, near_dedup, packing, quality, registry
from helixframe.llm import exact_dedup as exact
from helixframe.llm.common import fold, free_name, materialize


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level network rejects (score below 0.5) go.  It learns from the labelled documents outside the
    held-out third."""
    held_out = fold(F.col("doc_id"), 3) == 1
    model = quality.fit_table(docs.where(~held_out), registry.table(spark, sf_dir, "labels").where(~held_out))
    return docs.where(quality.probability(F.col("text"), model) >= 0.5)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal after lower-casing A-Z, the row with the largest doc_id stays."""
    return exact.drop_copies(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates, the row with the smallest doc_id stays."""
    return near_dedup.drop_near_copies(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go if benchmark windows hit a twentieth of their words or more; others stay as they are."""
    files = decontaminate.build_automata(registry.table(spark, sf_dir, "benchmark"))
    r = decontaminate.contamination(F.col("text"), files, with_text=False)
    name = free_name(docs, "hits")
    hit, n = F.col(f"{name}.n_hit"), F.col(f"{name}.n_words")
    return docs.withColumn(name, r).where(~((hit > 0) & (20 * hit >= n))).select(*docs.columns)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents that are left, cut into sequences of binary length: one row per piece."""
    return packing.pack(docs, registry.tokenizer("byte_bpe_50k.json"), end_id=0, max_len=1024)


STAGES = [
    ("quality_classifier", quality_filter),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmark_decontamination),
    ("packing", pack_documents),
]

# A trained network, the near-duplicate verification and a tokenizer are not SQL: tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = registry.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
