import math
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixframe.llm import kneser_ney as K
from helixframe.llm import language_id as L
from helixframe.llm import quality as Q
from helixframe.llm import registry
from helixframe.llm.common import fold, word_keys

LANGS = {"en": "the of and in that ing tion her was with", "de": "der die und ein sch ung nicht von zu keit", "fr": "le la les de des eau ment que pour avec",
         "es": "el los del que por ado ción una para con"}


def sentence(lang, seed, n=40):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(LANGS[lang].split(), n))


@pytest.mark.parametrize("n", [2, 3, 4, 5, 9, 20])
def test_codewords_differ(n):
    code = L.codebook(n)
    assert set(np.unique(code)) == {-1.0, 1.0}
    gaps = [int((code[i] != code[j]).sum()) for i in range(n) for j in range(i)]
    assert min(gaps) >= (1 if n == 2 else 2) and all(abs(c.sum()) < n for c in code.T)


def test_languages_held_out():
    texts = [(k, sentence(k, s)) for k in LANGS for s in range(60)]
    model = L.fit([t for _, t in texts], [k for k, _ in texts])
    probe = [(k, sentence(k, s)) for k in LANGS for s in range(1000, 1030)]
    got = model.predict(pa.array([t for _, t in probe])).to_pylist()
    assert np.mean([g["lang_pred"] == k for g, (k, _) in zip(got, probe, strict=True)]) >= 0.95
    assert all(0 <= g["score"] <= 1 for g in got)


def test_language_codes_correct_an_error():
    """A wrong bit does not change the answer; two codewords equally near are ambiguous."""
    code = L.codebook(4)
    m = L.LanguageModel(list("abcd"), code, None, None, np.full(code.shape, 1 / code.shape[1]), 0.25)
    wrong = code.copy() * 3
    wrong[:, 2] *= -1
    best, score, ambiguous, _ = m.decode(wrong)
    assert best.tolist() == [0, 1, 2, 3] and not ambiguous.any() and (score > 0.5).all()
    assert m.decode(np.zeros((1, code.shape[1])))[2].all()


def brute_language(model, text):
    """The model's answer for one text, trigram by trigram and language by language."""
    form = [b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalpha() else 32 for b in text.encode()]
    counts = Counter()
    for i in range(len(form) - 2):
        a, b, c = form[i:i + 3]
        counts[((a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) % 2**32) >> 19] += 1
    n = max(1, sum(counts.values()))
    margins = [sum(math.sqrt(k / n) * float(model.weights[h, j]) for h, k in counts.items()) + float(model.bias[j]) for j in range(model.code.shape[1])]
    loss = [sum(float(model.trust[i, j]) * math.log1p(math.exp(-m * float(model.code[i, j]))) for j, m in enumerate(margins)) for i in range(len(model.languages))]
    p = [math.exp(-4 * (x - min(loss))) for x in loss]
    best = loss.index(min(loss))
    return model.languages[best], p[best] / sum(p), sorted(loss)[1] - sorted(loss)[0] < model.gap


def test_languages_against_brute_force():
    texts = [(k, sentence(k, s)) for k in LANGS for s in range(40)]
    model = L.fit([t for _, t in texts], [k for k, _ in texts])
    probe = [sentence(k, s, 1 + s % 50) for k in LANGS for s in range(2000, 2012)] + ["É à ñ 12, the", "zzz", "ab", "la 日本 der " * 900]
    for text, got in zip(probe, model.predict(pa.array(probe)).to_pylist(), strict=True):
        lang, score, ambiguous = brute_language(model, text)
        assert (got["lang_pred"], got["ambiguous"]) == (lang, ambiguous) and abs(got["score"] - score) < 1e-3


def test_training_sample_is_whole_bounded_and_in_one_order(spark, docs_of):
    """Every label that occurs, whole texts, the same rows for any partitioning; equal rows once."""
    from helixframe.llm import common

    def training_sample(d, *bounds):
        t = d.withColumn("h", common.sample_key(F.col("doc_id"), F.col("text"))).withColumn("bytes", F.octet_length("text"))
        return common.training_sample(t.select("h", "bytes", "lang"), t.select("h", "text"), *bounds)

    rows = [(i, f"text {i} " * (1 + i % 7), "b" if i % 10 else "a") for i in range(400)] + [(1000, "rare", "c")] + [(7, "same", "b")] * 500
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got, counts = training_sample(d.repartition(5), "lang", 30, 1 << 20)
    assert counts == {"a": 40, "b": 860, "c": 1} and Counter(k for _, k in got) == {"a": 30, "b": 30, "c": 1}
    assert {(t, k) for t, k in got} <= {(t, k) for _, t, k in rows} and ("rare", "c") in got
    assert got == training_sample(d.orderBy(F.desc("doc_id")).coalesce(1), "lang", 30, 1 << 20)[0]
    few, _ = training_sample(d, "lang", 30, 100)
    assert {k for _, k in few} == {"a", "b", "c"} and few == [r for r in got if r in few]
    sizes = defaultdict(list)
    for text, k in few:
        sizes[k].append(len(text))
    assert all(sum(v[:-1]) < 100 for v in sizes.values())


def test_language_edges(docs_of):
    rows = [(1, None), (2, ""), (3, "12 34 !!"), (4, "the of and"), (5, "日本"), (6, "the of and"), (None, "the of"), (8, "½² Ⅷ ٣ ①"), (9, "½ é")]
    for langs in ([], ["en"], ["en", "de"]):
        model = L.fit([sentence(k, 1) for k in langs], langs)
        got = {r.doc_id: r for r in L.identify(docs_of(rows), model).collect()}
        assert [got[i].lang_pred for i in (1, 2, 3, 8)] == ["und"] * 4 and got[1].score == 0.0  # numerals are no letters
        assert got[9].lang_pred in langs or not langs
        assert got[4] == got[4] and (got[5].lang_pred in langs or not langs)
    assert L.identify(docs_of([]), model).collect() == []
    assert L.fit_table(docs_of([])).languages == []


def junk(seed):
    return sentence("en", seed).upper().replace(" ", "!! ")


def test_quality_held_out():
    rows = [(sentence("en", s, 30 + s % 200), 1) for s in range(300)] + [(junk(s), 0) for s in range(60)]
    model = Q.fit([t for t, _ in rows], [y for _, y in rows])
    probe = [(sentence("de", s, 100), 1) for s in range(500, 540)] + [(junk(s), 0) for s in range(500, 540)]
    score = model.score(pa.array([t for t, _ in probe]))
    assert np.mean((score >= 0.5) == np.array([y for _, y in probe])) >= 0.95


def test_quality_sees_the_whole_document():
    """Junk behind many clean chunks changes the pooled responses; batches don't change a score."""
    model = Q.fit([sentence("en", s) for s in range(50)] + [junk(s) for s in range(50)], [1] * 50 + [0] * 50)
    clean = sentence("en", 7, 4000)
    a, b = model.score(pa.array([clean, clean + junk(3)]))
    assert a > b
    texts = [clean, "", None, "x", junk(1), clean[:511], clean[:512], clean[:513]]
    one = np.concatenate([model.score(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(model.score(pa.array(texts)), one, atol=1e-5)


def brute_quality(model, text):
    """The network's score of one text, window by window."""
    data = text.encode()
    chunks = []
    for i in range(max(1, -(-len(data) // Q.CHUNK))):
        piece = data[i * Q.CHUNK:i * Q.CHUNK + Q.CHUNK + Q.STEP]
        x = list(piece) + [0] * (Q.CHUNK + Q.STEP - len(piece))
        flag = [any(p >= lag + 7 and all(x[p - j] == x[p - j - lag] != 0 for j in range(8)) for lag in Q.LAGS) for p in range(len(x))]
        rows = [np.concatenate([[*model.embed[x[p]], float(flag[p])] for p in range(s, s + Q.STEP)]) for s in range(0, len(x), Q.STEP)]
        left = [r @ model.filters[:, :Q.FILTERS] for r in rows]
        right = [r @ model.filters[:, Q.FILTERS:] for r in rows]
        chunks.append(np.maximum(np.max([a + b + model.bias for a, b in zip(left[:-1], right[1:], strict=True)], axis=0), 0))
    f = np.concatenate([np.max(chunks, axis=0), np.mean(chunks, axis=0)])
    return 1 / (1 + math.exp(-float(np.tanh(f @ model.hidden + model.hidden_bias) @ model.out + model.out_bias)))


def test_quality_against_brute_force():
    model = Q.fit([sentence("en", s) for s in range(40)] + [junk(s) for s in range(40)], [1] * 40 + [0] * 40)
    texts = ["", "a", sentence("fr", 1), junk(4), "buy now " * 90, sentence("de", 2, 300) + junk(9), "é" * 700]
    assert np.allclose(model.score(pa.array(texts)), [brute_quality(model, t) for t in texts], atol=1e-4)


def test_quality_model_does_not_depend_on_the_order_of_rows(spark, docs_of):
    rows = [(i, sentence("en", i, 20 + i) if i % 3 else junk(i)) for i in range(90)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(90)], "doc_id long, quality int")
    a = Q.fit_table(docs_of(rows, parts=2), labels)
    b = Q.fit_table(docs_of(rows[::-1], parts=7), labels.repartition(5))
    assert all(np.array_equal(getattr(a, k), getattr(b, k)) for k in ("embed", "filters", "bias", "hidden", "hidden_bias", "out", "out_bias"))


def test_quality_of_a_rare_label(spark, docs_of):
    """Two rejected documents among many accepted ones are in the sample, whatever their hashes."""
    rows = [(i, sentence("en", i)) for i in range(60)] + [(100, junk(1)), (101, junk(2))]
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in rows], "doc_id long, quality int")
    model = Q.fit_table(docs_of(rows), labels, per_label=20)
    assert model.constant is None and model.score(pa.array([junk(1)]))[0] < model.score(pa.array([sentence("en", 3)]))[0]


def test_chunks_cover_all_bytes():
    data = np.arange(1, 251, dtype=np.uint8).repeat(7)
    x, doc = Q.chunk_bytes(data, np.array([0, 0, 600, len(data)]))
    assert doc.tolist() == [0, 1, 1, 2, 2, 2]
    assert x[1, :512].tolist() + x[2, :88].tolist() == data[:600].tolist() and x[1, 512:].tolist() == data[512:516].tolist()


def test_quality_edges(spark, docs_of):
    labels = spark.createDataFrame([(1, 1), (2, None)], "doc_id long, quality int")
    model = Q.fit_table(docs_of([(1, "a"), (2, "b")]), labels)
    assert [r.score for r in Q.quality_scores(docs_of([(1, None), (2, "")]), model).collect()] == [1.0, 1.0]
    assert Q.quality_scores(docs_of([]), model).collect() == []
    assert Q.fit_table(docs_of([]), labels).constant == 0.5


def brute_kn(train, probe):
    """The model from its formulas, with dictionaries."""
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    seqs = [words(t) + ["</s>"] for t in train]
    c1 = Counter(w for s in seqs for w in s)
    c2 = Counter(p for s in seqs for p in zip(["<s>", *s], s, strict=False))
    cont = Counter(v for _, v in c2)
    follow = defaultdict(Counter)
    for (u, _), c in c2.items():
        follow[u][min(c, 3)] += 1
    d = (0.0, *K.discounts(*(sum(c == i for c in c2.values()) for i in range(1, 5))))
    e = (0.0, *K.discounts(*(sum(c == i for c in cont.values()) for i in range(1, 5))))
    total, v = len(c2), len(c1)
    spread = sum(e[min(n, 3)] for n in cont.values())
    c1["<s>"] = len(train)

    def low(w):
        return (cont[w] - e[min(cont[w], 3)] + spread / (v + 1)) / total

    def p(u, w):
        if not c1[u]:
            return low(w)
        return (c2[u, w] - d[min(c2[u, w], 3)] + sum(d[k] * n for k, n in follow[u].items()) * low(w)) / c1[u]

    out = []
    for t in probe:
        s = words(t) + ["</s>"]
        out.append(sum(math.log10(p(u, w)) for u, w in zip(["<s>", *s], s, strict=False)))
    known = [w for w in c1 if w != "<s>"]
    assert all(abs(sum(p(u, w) for w in known) + p(u, "never seen") - 1) < 1e-9 for u in ["<s>", *known[:5], "unknown"])
    return out, sum(c1.values()) - len(train)


def test_kneser_ney_against_formulas(docs_of, spoken):
    train = [(i, spoken(i % 7, 120, 60)) for i in range(40)] + [(50, None), (51, ""), (52, "A a  A\n"), (53, "A a  A\n"), (None, "b")]
    probe = [(1, spoken(3, 50, 60)), (2, None), (3, "unseen words here"), (4, "a A \t b"), (4, "a A \t b"), (None, spoken(99, 30))]
    model = K.train(docs_of(train), range_bytes=4000, word_range_bytes=3000)
    assert len(model.pair_sizes) > 3 and len(model.word_sizes) > 3
    got = K.score_documents(docs_of(probe, parts=1), model).collect()
    want, n = brute_kn([t for _, t in train], [t for _, t in probe])
    assert {(r.doc_id, round(r.score, 8)) for r in got} == {(i, round(s, 8)) for (i, _), s in zip(probe, want, strict=True)}
    assert all(r.train_tokens == n for r in got) and {r.doc_id: r.n_tokens for r in got}[2] == 1


def brute_ngrams(train, probe, order):
    """Scores of a model of any order, by recursion over dictionaries of whole n-grams."""
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    seqs = [["<s>", *words(t), "</s>"] for t in train]
    raw = {m: Counter(tuple(s[i:i + m]) for s in seqs for i in range(len(s) - m + 1)) for m in range(1, order + 1)}
    count = {order: raw[order]}
    for m in range(1, order):
        before = Counter(g[1:] for g in raw[m + 1])
        count[m] = Counter({g: c if m > 1 and g[0] == "<s>" else before[g] for g, c in raw[m].items() if m > 1 or g != ("<s>",)})
    d = {m: (0.0, *K.discounts(*(sum(c == i for c in count[m].values()) for i in range(1, 5)))) for m in count}
    total, follow = defaultdict(int), defaultdict(Counter)
    for m in range(2, order + 1):
        for g, c in count[m].items():
            total[g[:-1]] += c
            follow[g[:-1]][min(c, 3)] += 1
    v, t = len(count[1]), len(raw[2])
    spread = sum(d[1][min(c, 3)] for c in count[1].values())

    def p(h, w):
        if not h:
            c = count[1][w,]
            return (c - d[1][min(c, 3)] + spread / (v + 1)) / t
        if not total[h]:
            return p(h[1:], w)
        m = len(h) + 1
        c = count[m][*h, w]
        return (c - d[m][min(c, 3)] + sum(d[m][k] * n for k, n in follow[h].items()) * p(h[1:], w)) / total[h]

    out = []
    for x in probe:
        s = ["<s>", *words(x), "</s>"]
        out.append(sum(math.log10(p(tuple(s[max(0, i - order + 1):i]), s[i])) for i in range(1, len(s))))
    for h in [h for h in total if len(h) == order - 1][:5]:
        assert abs(sum(p(h, w) for w, in count[1]) + p(h, "never seen") - 1) < 1e-9
    return out


@pytest.mark.parametrize("order", [2, 3, 4])
def test_kneser_ney_orders_against_formulas(docs_of, spoken, order):
    passage = spoken(500, 40, 60)
    train = ([(i, spoken(i % 7, 60, 12) + " " + passage) for i in range(40)] + [(50, None), (51, ""), (52, "A a  A\n"), (53, "A a  A\n"), (None, "b")]
             + [(60 + i, "a b c") for i in range(300)])
    probe = [(1, spoken(3, 50, 12)), (2, None), (3, "unseen words here"), (4, "a A \t b c"), (4, "a A \t b c"), (5, passage), (None, spoken(99, 30))]
    model = K.train(docs_of(train), order=order, range_bytes=4000, word_range_bytes=3000)
    assert model.order == order and all(len(x) > 3 for x in model.sizes)
    got = K.score_documents(docs_of(probe, parts=1), model).collect()
    want = brute_ngrams([t for _, t in train], [t for _, t in probe], order)
    assert sorted((str(r.doc_id), round(r.score, 8)) for r in got) == sorted((str(i), round(s, 8)) for (i, _), s in zip(probe, want, strict=True))


def test_kneser_ney_statistics_add_up_over_parts(docs_of, spoken):
    model = K.train(docs_of([(i, spoken(i % 7, 120, 60)) for i in range(40)]), order=3)
    levels = model.levels()
    a = levels.tables[2].column(0, "c", np.arange(model.sizes[2][0]))

    def added(part):
        out = Counter()
        for kind, r, ids, stats in K._statistics(levels, 3, 0, a, part):
            at = K.from_steps(ids) if kind < 3 else []
            if len(at):
                n = 4 if kind == 1 else 1
                step = len(stats) // n
                for i in range(n):
                    for x, v in zip(at, K.from_planes(stats[i * step:(i + 1) * step], f"<u{step // len(at)}"), strict=True):
                        out[kind, r, int(x), i] += int(v)
            elif kind == 3:
                out[kind, stats] += 1
        return out

    assert len(a) > 500 and added(50) == added(len(a))


def test_kneser_ney_query_sees_two_words_of_context(spark, tmp_path):
    """What follows "b" depends on the word before it: a pair model gives both texts the same score."""
    rows = [(i, "a b c" if i % 2 else "d b e") for i in range(400)] + [(1000, "a b c"), (1001, "a b e")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.score for r in registry.op7_kneser_ney(spark, str(tmp_path)).where("doc_id >= 1000").collect()}
    assert got[1000] > got[1001] + 1


def test_kneser_ney_orders_without_training_rows(docs_of):
    got = K.score_documents(docs_of([(1, "a b"), (2, None)]), K.train(docs_of([]), order=3)).collect()
    assert {(r.doc_id, r.score, r.base_score, r.n_known) for r in got} == {(1, 0.0, 0.0, 0), (2, 0.0, 0.0, 0)}


@pytest.mark.parametrize("bits", [1, 2, 5, 31, 47, 64])
def test_keys_of_any_width(bits):
    x = np.unique(np.random.default_rng(bits).integers(0, 2 ** bits, 1000, dtype=np.uint64))
    k = K.mixed(x, bits)
    assert (K.unmixed(k, bits) == x).all() and len(np.unique(k)) == len(x)
    assert (K.from_steps(K.steps(np.sort(k))) == np.sort(k)).all()


def test_kneser_ney_without_training_rows(docs_of):
    got = K.score_documents(docs_of([(1, "a b"), (2, None)]), K.train(docs_of([]))).collect()
    assert {(r.doc_id, r.score, r.base_score, r.n_known) for r in got} == {(1, 0.0, 0.0, 0), (2, 0.0, 0.0, 0)}


def test_keys_mix_and_unmix():
    x = np.random.default_rng(0).integers(0, 2 ** 62, 1000).astype(np.uint64)
    assert (K.unmix(K.mix(x)) == x).all()


def test_fold(spark):
    import zlib
    got = spark.createDataFrame([(i,) for i in (0, 7, 123, None)], "doc_id long").select("doc_id", fold(__import__("pyspark").sql.functions.col("doc_id"), 7).alias("f")).collect()
    assert [r.f for r in got] == [zlib.crc32(str(i).encode()) % 7 for i in (0, 7, 123)] + [0]


def test_word_keys_tell_words_apart_wherever_they_stand():
    rng = np.random.default_rng(7)
    some = {rng.integers(0, 256, int(n), np.uint8).tobytes() for n in rng.choice([1, 2, 7, 8, 9, 16, 17, 63, 64, 65, 200], 20_000)}
    some = sorted(some | {b"\0" * i for i in range(130)} | {b"a" * i for i in range(130)})
    keys = word_keys(pa.array(some, pa.binary()))
    assert keys.dtype == np.uint64 and len(set(keys.tolist())) == len(some)
    at = rng.permutation(len(some))[:500]
    assert (word_keys(pa.array([some[i] for i in at], pa.binary())) == keys[at]).all()
    assert (word_keys(pa.array(some, pa.binary()).slice(100, 50)) == keys[100:150]).all()
    assert len(word_keys(pa.array([], pa.binary()))) == 0
    assert np.bincount((keys >> np.uint64(60)).astype(int), minlength=16).min() > len(some) / 16 * 0.8
    assert K.END_KEY == word_keys(pa.array([b" "], pa.binary()))


def test_chunks_are_cut_in_little_memory():
    data = np.full(8 << 20, 97, np.uint8)
    tracemalloc.start()
    x, _ = Q.chunk_bytes(data, np.array([0, 5, len(data)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * x.nbytes
