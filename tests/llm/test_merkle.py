import hashlib
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from helixframe.llm import merkle as M


def pieces(t, longest=M.LONGEST):
    out, last = [], 0
    for p in range(1, len(t)):
        run = t[last:p]
        if re.search(r"[.!?][ \t\n\x0b\f\r]\Z|\n\Z", t[max(0, p - 2):p]) or len(run) == longest and max(map(ord, run)) < 0x10000:
            out.append(run)
            last = p
    return [*out, t[last:]]


def long_of(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def tree(t, longest=M.LONGEST, section=M.SECTION):
    leaves = [long_of(xxhash.xxh64_intdigest(p.encode(), 42)) for p in pieces(t, longest)]
    runs, run = [], []
    for i, x in enumerate(leaves):
        run.append(x)
        if x % section == 0 or i + 1 == len(leaves):
            runs.append(run)
            run = []
    hashes = []
    for r in runs:
        h = 42
        for x in r:
            h = xxhash.xxh64_intdigest((x % (1 << 64)).to_bytes(8, "little"), h)
        hashes.append(f"{h:X}")
    text = ",".join(hashes)
    return leaves, hashlib.sha256(text.encode()).hexdigest() + ":" + text


def like(a, b):
    rest = list(b)
    shared = 0
    for x in a:
        if x in rest:
            rest.remove(x)
            shared += 1
    return shared / max(len(a), len(b))


def brute(rows):
    order = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0, long_of(xxhash.xxh64_intdigest(r[1].encode(), 42))))
    after = dict(zip(order, [*order[1:], *order[:1]], strict=True))
    out = []
    for i, t in rows:
        t = t or ""
        q = len(t) // 4
        nxt = after[(i, t)][1]
        edited = t[:len(t) - q] + nxt[:q]
        (a, fa), (b, fb), (c, _) = tree(t), tree(edited), tree(nxt)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), fa, fb, round(like(a, b), 9), round(like(a, c), 9)))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9))
                   for r in df.collect()), key=repr)


LINES = "One line. Two? Three!\n\nFour lines  here\r\n"


def test_against_brute_force(spark, docs_of, spoken, monkeypatch):
    """Several ranges of keys; ties, repeated rows, nulls, empty and long texts, other alphabets, copies."""
    rows = [(3 * i, spoken(i, 5 + i * 7 % 130).replace(" a", ". A").replace(" b", "\n")) for i in range(60)]
    rows += [(1, None), (2, ""), (4, "abc"), (5, "abcd"), (5, "abcd"), (5, "dcba"), (None, LINES), (None, LINES * 9), (7, LINES * 9), (8, LINES * 9 + "x"),
             (10, "東京 é " * 300), (11, "\U0001f600" * 150 + ". end"), (13, "x" * 64), (14, "x" * 65), (16, "same. " * 40), (17, "long words " * 40000)]
    monkeypatch.setattr(M, "KEYS", 9)
    got = rows_of(M.edit_fingerprints(docs_of(rows)))
    assert got == brute(rows)
    assert all(g[5] > 0.5 and g[6] < 0.1 for g in got if g[1] > 500 and g[0] is not None and 20 < g[0] < 170)


def test_paragraphs_keep_the_text(spark):
    texts = [LINES, "x" * 200, "", "no end", "a.b.c. d", "\n\n\n", "é" * 130 + ". ü"]
    d = spark.createDataFrame([(t,) for t in texts], "text string").select("text", M.paragraphs(F.col("text")).alias("p"))
    for r in d.collect():
        assert "".join(r.p) == r.text and r.p == pieces(r.text)


def test_edits_are_located(spark, spoken):
    """One changed word touches the sections around it only."""
    words = spoken(5, 2000).split()
    a = ". ".join(" ".join(words[i:i + 8]) for i in range(0, 2000, 8))
    words[1000] = "changed"
    b = ". ".join(" ".join(words[i:i + 8]) for i in range(0, 2000, 8))
    d = spark.createDataFrame([(a, b)], "a string, b string").select(*[M.sections(M.leaves(F.col(c))).alias(c) for c in "ab"])
    r = d.select(M.differing_sections(F.col("b"), F.col("a")).alias("e"), F.size("b").alias("n"), (M.root(F.col("a")) == M.root(F.col("b"))).alias("same")).first()
    assert 1 <= len(r.e) <= 2 < r.n and not r.same
    at = pieces(b).index(next(p for p in pieces(b) if "changed" in p)) + 1
    assert r.e[0]["first"] <= at < r.e[-1]["first"] + len(r.e[-1]["leaves"])


@pytest.mark.parametrize("rows", [[], [(1, "alone in the table. Two.")]])
def test_small_tables(docs_of, rows):
    assert rows_of(M.edit_fingerprints(docs_of(rows))) == brute(rows)


def test_native_plan(spark, docs_of):
    plan = M.edit_fingerprints(docs_of([(1, "a"), (2, "b")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
