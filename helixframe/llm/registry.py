"""Registered queries of the training-data operators: thin functions (spark, sf_dir) -> DataFrame, and their SQL.

Each reads whole tables, applies its operator with production parameters and derives the digest columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup as dedup
from . import chat, decontaminate, hard_negatives, kneser_ney, language_id, merkle, near_dedup, packing, quality, stratified_search, token_counts, token_files
from .common import fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 3) == 1
    model = language_id.fit_table(docs.where(~held_out))
    return language_id.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op2_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=0, max_len=1024)
    return p.select("doc_id", "start", "length", token_files.crc32_of().alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op3_byte_convolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 3) == 1
    model = quality.fit_table(docs.where(~held_out), table(spark, sf_dir, "labels").where(~held_out))
    return quality.quality_scores(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder, manifest = token_files.write_token_files(docs, tokenizer("word_bpe_49k.json"), end_id=1)
    rows = token_files.read_token_files(spark, folder, manifest, id_type=docs.schema["doc_id"].dataType.simpleString())
    return rows.select("doc_id", "start", "n_tokens", token_files.crc32_of().alias("ids_crc32"))


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")


def op6_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    rows = decontaminate.decontaminate(docs, items, with_text=False)
    names = F.array_join(F.array_sort("items"), ",")
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(names, 256).alias("items_sha256"),
                       ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 7) == 2
    model = kneser_ney.train(docs.where(~held_out), order=3)
    return kneser_ney.score_documents(docs, model).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.rotate(table(spark, sf_dir, "conversations"))
    ranges = F.transform("mask", lambda m: F.concat(m["begin"].cast("string"), F.lit("-"), m["end"].cast("string")))
    return rows.select("conv_id", "perspective", F.col("part").cast("bigint").alias("part"), F.col("slot").cast("bigint").alias("slot"),
                       F.col("n_turns").cast("bigint").alias("n_turns"), F.col("n_own").cast("bigint").alias("n_own"), "text",
                       F.array_join(ranges, ",").alias("mask"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256", "n_bytes")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of the documents, by a scan of flat 16-bit files for the separator."""
    docs = table(spark, sf_dir, "documents")
    end = 50256  # of the tokenizer file; no text encodes to it, as strings of special tokens are plain text here
    folder, manifest = token_files.write_token_files(docs, tokenizer("byte_bpe_50k.json"), end_id=end, plain_specials=True, in_order=False)
    counts = token_counts.token_counts(manifest, folder, end)
    # The scan reads ids alone; its document numbers then meet the names in the writer's order.
    names = token_files.document_names(spark, folder, manifest, id_type=docs.schema["doc_id"].dataType.simpleString())
    return counts.join(names, ["shard", "doc_no"], "full").select("doc_id", "shard", "doc_no", "start", "n_tokens", "ended")


def op11_merkle_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edit_fingerprints(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op12_length_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_l2ap_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", label.alias("label"), hard_negatives.integer_vector(F.col("embedding"), 256.0).alias("vector"))
    return hard_negatives.mine(rows, F.col("vec_id") % 50 == 0)


QUERIES = {f.__name__: f for f in (
    op1_language_codes, op2_power_of_two_packing, op3_byte_convolution, op4_token_files, op5_order_minhash, op6_suffix_automaton, op7_kneser_ney,
    op8_perspective_rotation, op9_exact_dedup, op10_token_counts, op11_merkle_tree, op12_length_strata, op13_l2ap_negatives)}

ORACLE = {
    "op6_suffix_automaton": r"""
        with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents),
        i as (select cast(item_id as varchar) item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from benchmark where text is not null),
        k as (select item, ws, least(13, len(ws)) n, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) p from i where len(ws) > 0),
        win as (select distinct item, n, array_to_string(ws[p:p + n - 1], ' ') g from k),
        lens as (select distinct n from win),
        pos as (select doc_id, ws, unnest(range(1, len(ws) + 1)) p from w),
        hits as (select doc_id, p, lens.n, item from pos join lens on p + lens.n - 1 <= len(ws)
                 join win on win.n = lens.n and win.g = array_to_string(ws[p:p + lens.n - 1], ' ')),
        words as (select doc_id, count(distinct q) n_hit from (select doc_id, unnest(range(p, p + n)) q from hits) group by doc_id),
        items as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) names from (select distinct doc_id, item from hits where item is not null) group by doc_id)
        select w.doc_id, cast(len(ws) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(names, '')) items_sha256,
               coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) contaminated
        from w left join words on w.doc_id = words.doc_id left join items on w.doc_id = items.doc_id""",
    "op8_perspective_rotation": r"""
        with c as (select conv_id, coalesce(turn, -1) turn, coalesce(role, '') r0,
                          regexp_replace(coalesce(text, ''), '<\|(im_start|im_end)\|>', '<\1>', 'g') body from conversations),
        t as (select conv_id, turn, body, turn >> 8 part,
                     case when r0 = '' then 'unknown' else regexp_replace(regexp_replace(r0, '<\|(im_start|im_end)\|>', '<\1>', 'g'), '[\n\r]', ' ', 'g') end as role from c),
        n as (select *, (row_number() over (partition by conv_id, part order by turn, role, body) - 1) >> 8 slot from t),
        people as (select distinct conv_id, role perspective from t where role <> 'system'),
        s as (select n.*, perspective, role = perspective own,
                     '<|im_start|>' || case when role = perspective then 'assistant' when role = 'system' then 'system' else 'user name=' || role end || chr(10) head,
                     body || '<|im_end|>' || chr(10) rest
              from n join people on n.conv_id is not distinct from people.conv_id),
        p as (select *, coalesce(sum(length(head) + length(rest)) over (partition by conv_id, perspective, part, slot order by turn, role, body
                     rows between unbounded preceding and 1 preceding), 0) before,
                     row_number() over (partition by conv_id, perspective, part, slot order by turn, role, body) k from s)
        select conv_id, perspective, part, slot, count(*) n_turns, count(*) filter (where own) n_own, string_agg(head || rest, '' order by k) as text,
               coalesce(string_agg(cast(cast(before + length(head) as bigint) as varchar) || '-' || cast(cast(before + length(head) + length(rest) - 1 as bigint) as varchar), ','
                        order by k) filter (where own), '') mask
        from p group by conv_id, perspective, part, slot""",
    "op9_exact_dedup": """
        with t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') n from documents)
        select doc_id, max(doc_id) over (partition by n) keep_id, count(*) over (partition by n) group_size,
               doc_id = max(doc_id) over (partition by n) kept, sha256(n) text_sha256, cast(strlen(n) as bigint) n_bytes from t""",
    "op12_length_strata": r"""
        with d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') ws from documents where text is not null),
        t as (select cast(count(*) as bigint) nn, cast(sum(len(ws)) as bigint) ll from d where len(ws) > 0),
        u as (select doc_id, cast(len(ws) as bigint) n, unnest(ws) term from d),
        p as (select doc_id, n, term, count(*) tf from u group by doc_id, n, term),
        f as (select term, count(*) df from p group by term),
        q as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term from benchmark where text is not null),
        s as (select item_id, doc_id, cast(sum(cast(floor(1000 * ln((2.0::double * nn + 2) / (2.0::double * df + 1))) as bigint)
                     * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll)))) as bigint) score
              from q join p using (term) join f using (term) cross join t group by item_id, doc_id)
        select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score
        from s where score > 0 qualify rank <= 10""",
    "op13_l2ap_negatives": """
        with v as (select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) q
                   from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        p as (select a.vec_id anchor_id, a.label, a.q, b.vec_id positive_id, cast(list_inner_product(a.q, b.q) as bigint) positive_score
              from v a join v b on a.vec_id % 50 = 0 and a.label = b.label and a.vec_id <> b.vec_id
              qualify row_number() over (partition by a.vec_id order by positive_score desc, b.vec_id) <= 5),
        n as (select a.vec_id anchor_id, b.vec_id negative_id, cast(list_inner_product(a.q, b.q) as bigint) negative_score
              from v a join v b on a.vec_id % 50 = 0 and a.label <> b.label)
        select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by negative_score desc, negative_id) as integer) as rank, negative_id,
               positive_score, negative_score
        from p join n using (anchor_id) where 50 * positive_score <= 100 * negative_score and 100 * negative_score <= 95 * positive_score
        qualify rank <= 3""",
}
