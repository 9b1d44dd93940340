import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe.llm import packing, registry, token_counts, token_files, tokens

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
PIECES = st.lists(st.sampled_from(["the", "Word", " ", "  ", "\n", ".", ",", "é", "ß", "İ", "ΑΣ", "'s", "x1", "×", "\x00", "\x1c", " ", "́",
                                   "<|endoftext|>", "日本", "don't", "!", "ÿ", "Ñandú", "\t", "-", " ", "😀"]), max_size=25).map("".join)


@pytest.mark.parametrize("name", FILES)
@pytest.mark.parametrize("plain", [False, True])
def test_pieces_encode_as_whole_texts(name, plain):
    e = tokens.TextEncoder(registry.tokenizer(name), plain)

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.one_of(PIECES, st.text(max_size=30)), min_size=1, max_size=4))
    def check(texts):
        flat, offs = e.encode(pa.array(texts))
        for i, t in enumerate(texts):
            assert flat[offs[i]:offs[i + 1]].tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids

    check()


def test_memory_of_pieces_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_BYTES", 900)
    e = tokens.TextEncoder(registry.tokenizer(FILES[0]))
    for text in ("a b c d", "e f g h i j k l", "a b c d", "z" * 5000, "a b", "q"):
        flat, _ = e.encode(pa.array([text]))
        assert flat.tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(e.known) < 4  # emptied after the long piece


ROWS = [(5, "The first text, of a few words."), (2, ""), (3, None), (9, "word " * 3000), (None, "no id"), (5, "same id"), (7, "The first text, of a few words.")]


def ids_of(name, text, plain=False):
    return tokens.encoder(registry.tokenizer(name), plain).tokenizer.encode(text or "", add_special_tokens=False).ids


def test_ids_that_do_not_fit_raise_before_the_job(docs_of):
    name = registry.tokenizer(FILES[1])
    assert tokens.vocabulary_size(name) <= 1 << 16
    for options in ({"dtype": "<u1", "end_id": 1}, {"end_id": 1 << 16}, {"end_id": -1}):
        with pytest.raises(ValueError, match="don't fit"):
            token_files.write_token_files(docs_of(ROWS), name, **options)


@pytest.mark.parametrize("shard_bytes", [64, 1 << 20])
def test_files_round_trip(spark, docs_of, shard_bytes):
    folder, manifest = token_files.write_token_files(docs_of(ROWS), registry.tokenizer(FILES[1]), 1, shard_bytes=shard_bytes)
    got = sorted(token_files.read_token_files(spark, folder, manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 2, 3, 5, 5, 7, 9]
    want = sorted((str(i), tuple(ids_of(FILES[1], t) + [1])) for i, t in ROWS)
    assert sorted((str(r.doc_id), tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    digests = token_files.read_token_files(spark, folder, manifest).select("ids", token_files.crc32_of().alias("c")).collect()
    assert all(d.c == zlib.crc32(d.ids) for d in digests)


def test_empty_files(spark, docs_of):
    folder, manifest = token_files.write_token_files(docs_of([]), registry.tokenizer(FILES[1]), 1)
    assert token_files.read_token_files(spark, folder, manifest).collect() == []


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 20])
def test_separator_scan(spark, tmp_path, block):
    """Documents of no tokens, a file without separators, an empty file, and ids after the last separator."""
    rng = np.random.default_rng(5)
    files = {"a": np.where(rng.random(500) < 0.1, 9, 1), "b": np.full(100, 2), "c": np.array([], int), "d": np.array([9, 9, 3, 9]), "e": np.array([1] * 300 + [9])}
    for name, ids in files.items():
        (tmp_path / f"{name}.bin").write_bytes(ids.astype("<u2").tobytes())
    m = spark.createDataFrame([(k, len(v)) for k, v in files.items()], "shard string, n_tokens bigint")
    got = {(r.shard, r.doc_no): (r.start, r.n_tokens, r.ended) for r in token_counts.token_counts(m, str(tmp_path), 9, block_ids=block).collect()}
    want = {}
    for name, ids in files.items():
        start = no = 0
        for i, x in enumerate(ids.tolist()):
            if x == 9:
                want[name, no] = (start, i - start, True)
                start, no = i + 1, no + 1
        if start < len(ids):
            want[name, no] = (start, len(ids) - start, False)
    assert got == want


def test_token_counts_of_documents(spark, docs_of, tmp_path):
    docs_of(ROWS, extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.op10_token_counts(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(i), len(ids_of(FILES[0], t, True))) for i, t in ROWS)
    assert all(r.ended for r in got)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=20), st.sampled_from([1, 2, 16, 1024]))
def test_binary_pieces(sizes, longest):
    doc, start, length = packing.binary_pieces(np.array(sizes, np.int64), longest)
    for d, n in enumerate(sizes):
        own = doc == d
        assert length[own].sum() == n and (start[own] == np.cumsum(length[own]) - length[own]).all()
        short = [x for x in length[own].tolist() if x < longest]
        assert all(x & (x - 1) == 0 for x in length[own].tolist()) and len(set(short)) == len(short)


def test_packing(docs_of):
    got = packing.pack(docs_of(ROWS), registry.tokenizer(FILES[0])).collect()
    assert len({r.sequence_id for r in got}) == len(got) and all(r.offset == 0 and r.bucket == r.length for r in got)
    texts = {}
    for r in sorted(got, key=lambda r: r.sequence_id):
        texts.setdefault((r.doc_id, r.doc_tokens), []).append(np.frombuffer(r.ids, "<u4"))
    want = sorted(tuple(ids_of(FILES[0], t) + [0]) for i, t in ROWS)
    assert sorted(tuple(np.concatenate(x).tolist()) for x in texts.values()) == sorted(want)
    assert sum(r.length for r in got) == sum(map(len, want))
    assert packing.pack(docs_of([]), registry.tokenizer(FILES[0])).collect() == []
    with pytest.raises(ValueError):
        packing.pack(docs_of([]), registry.tokenizer(FILES[0]), max_len=1000)


def test_one_bucket_is_read_alone(spark, docs_of, tmp_path):
    """The pieces of a length are in folders of their own, the largest bucket in several files."""
    path = str(tmp_path / "packed")
    docs = docs_of([*ROWS, *[(100 + i, "many words here " * 900) for i in range(12)]], parts=4)
    pieces = packing.pack(docs, registry.tokenizer(FILES[0]), max_len=64)
    packing.write_buckets(pieces, path)
    want = [tuple(r) for r in pieces.select("doc_id", "start", "bucket", "ids").collect()]
    for length in (64, 1, 2, 16):
        one = packing.read_bucket(spark, path, length)
        plan = one._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(bucket" in plan and f"= {length})" in plan
        assert sorted((r.doc_id or 0, r.start, r.ids) for r in one.collect()) == sorted((i or 0, s, x) for i, s, b, x in want if b == length)
    assert packing.read_bucket(spark, path, 3).count() == 0
    assert len(list((tmp_path / "packed" / "bucket=64").glob("*.parquet"))) > 1
