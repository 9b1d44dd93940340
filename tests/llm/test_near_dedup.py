import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe.llm import components as C
from helixframe.llm import near_dedup as N
from helixframe.llm.components import components

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return [tuple(w[i:i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []


def lcs(a, b):
    prev = [0] * (len(b) + 1)
    for x in a:
        cur = [0]
        for j, y in enumerate(b):
            cur.append(prev[j] + 1 if x == y else max(prev[j + 1], cur[j]))
        prev = cur
    return prev[-1]


def classes(rows):
    """The smallest id of each row's class, from all pairs."""
    s = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = s[i], s[j]
            if not a or not b or min(len(a), len(b)) < 0.8 * max(len(a), len(b)) or root(i) == root(j):
                continue
            shared = sum((Counter(a) & Counter(b)).values())
            if shared >= 0.8 * (len(a) + len(b) - shared) and (n := lcs(a, b)) >= 0.8 * (len(a) + len(b) - n) - 1e-9:
                up[root(i)] = root(j)
    ids = {}
    for i, (k, _) in enumerate(rows):
        ids.setdefault(root(i), []).append((k is not None, k or 0))
    return Counter((k, min(ids[root(i)])[1] if min(ids[root(i)])[0] else None) for i, (k, _) in enumerate(rows))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.lists(st.integers(0, 3), max_size=8), st.data())
def test_band_gives_the_whole_alignment(a, edits, data):
    b = list(a)
    for e in edits:
        i = data.draw(st.integers(0, len(b)))
        b[i:i + data.draw(st.integers(0, 1))] = [e] if data.draw(st.booleans()) else []
    want = lcs(a, b)
    got = N.aligned(np.array(a, np.uint64), np.array(b, np.uint64))
    n, m = len(a), len(b)
    assert got <= want
    if n + m and want >= 0.8 * (n + m - want):
        assert got == want


def edited(text, share, seed, kinds="ris"):
    r, w = random.Random(seed), text.split()
    for _ in range(max(1, int(share * len(w)))):
        i, kind = r.randrange(len(w)), r.choice(kinds)
        w[i:i + 1] = [f"new{r.randrange(10 ** 6)}"] if kind == "r" else [w[i], "more"] if kind == "i" else []
    return " ".join(w)


def test_against_all_pairs(docs_of, spoken):
    rows, k = [], 0
    for g in range(25):
        base = spoken(1000 + g, random.Random(g).choice([6, 9, 14, 17, 30, 60, 200, 500]))
        rows.append((k := k + 1, base))
        for c in range(random.Random(g).randrange(5)):
            rows.append((k := k + 1, edited(base, random.Random(g * 9 + c).choice([0.003, 0.01, 0.02, 0.03, 0.05]), g * 100 + c)))
    line = spoken(5, 40)
    rows += [(k := k + 1, line + " " + spoken(2000 + i, 15 + i)) for i in range(60)]  # a common line, not copies
    rows += [(k := k + 1, None), (k := k + 1, ""), (k := k + 1, "!!"), (k := k + 1, "Two words"), (k := k + 1, "two, words!"), (None, "two words"),
             (3, rows[2][1]), (3, rows[2][1])]
    half = spoken(77, 300).split()
    rows += [(k := k + 1, " ".join(half)), (k := k + 1, " ".join(half[150:] + half[:150]))]  # same shingles in another order
    got = N.near_dedup(docs_of(rows, parts=4)).collect()
    assert Counter((r.doc_id, r.class_id) for r in got) == classes(rows)
    assert sum(r.kept for r in got) == len({r.class_id if r.class_size > 1 or r.doc_id is not None else repr(r) for r in got})


def test_unlike_texts_in_shared_buckets(docs_of, spoken):
    """Texts that share most of a passage, with hidden near copies: no link is lost, and few pairs meet."""
    line = spoken(5, 60)
    rows = [(i, line + " " + spoken(3000 + i, 16)) for i in range(40)]
    rows += [(100 + i, edited(rows[i][1], 0.01, i, "r")) for i in range(0, 40, 5)]
    got = N.near_dedup(docs_of(rows)).collect()
    assert Counter((r.doc_id, r.class_id) for r in got) == classes(rows)


def test_texts_near_the_threshold_hardly_meet(docs_of, spoken, monkeypatch):
    """Edits of one text, most of them too many for a link: all links are found, without all pairs meeting."""
    base, found, real = spoken(9, 150), [], N._rest

    def rest(members, texts):
        out = N.materialize(real(members, texts), "counted")
        found.append((members.count(), out.count()))
        return out

    monkeypatch.setattr(N, "_rest", rest)
    rows = [(i, edited(base, 0.006 + 0.004 * (i % 9), i, "ris")) for i in range(90)]
    got = N.near_dedup(docs_of(rows, parts=4)).collect()
    assert Counter((r.doc_id, r.class_id) for r in got) == classes(rows)
    (n, pairs), = found
    assert n > 40 and pairs < n * 5


def test_large_group_of_near_copies(docs_of, spoken):
    base = spoken(4, 150)
    rows = [(i, edited(base, 0.007, i, "r")) for i in range(400)] + [(1000 + i, spoken(5000 + i, 100)) for i in range(100)]
    got = N.near_dedup(docs_of(rows, parts=4)).collect()
    assert {r.class_id for r in got if r.doc_id < 1000} == {0} and sum(r.kept for r in got) == 101


@pytest.mark.parametrize("module", ["near", "exact"])
def test_another_split_of_files_between_jobs(spark, docs_of, spoken, monkeypatch, module):
    """Executors that come or go change how written tables are read; the numbers of rows, and so the classes, stay."""
    from helixframe.llm import exact_dedup as E

    rows = [(i, spoken(i, 60)) for i in range(200)] + [(1000 + i, edited(spoken(i, 60), 0.01, i) if module == "near" else spoken(i, 60)) for i in range(50)]
    d = docs_of(rows, parts=7)
    target = N if module == "near" else E
    run = (lambda: N.near_dedup(d)) if module == "near" else (lambda: E.exact_dedup(d))
    key = "class_id" if module == "near" else "keep_id"
    want = Counter((r.doc_id, r[key], r.kept) for r in run().collect())
    real, splits = target.materialize, iter([1, 9, 2, 30, 3, 17] * 40)

    def other(df, name):
        out = real(df, name)
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", next(splits))
        spark.conf.set("spark.sql.files.openCostInBytes", 1 << (10 + next(splits) % 12))
        return out

    monkeypatch.setattr(target, "materialize", other)
    try:
        assert Counter((r.doc_id, r[key], r.kept) for r in run().collect()) == want
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sum(r[2] for r in want) == 200


def test_rows_that_stay(docs_of, spoken):
    base = spoken(1, 100)
    d = docs_of([(1, base), (1, base), (2, edited(base, 0.01, 1)), (3, None), (4, None), (5, spoken(2, 100))])
    out = N.drop_near_copies(d)
    assert out.columns == d.columns and sorted(r.doc_id for r in out.collect()) == [1, 3, 4, 5]
    assert N.near_dedup(docs_of([])).collect() == []


@pytest.mark.parametrize("n", [1, 2, 30])
def test_components_of_chains(spark, n):
    links = spark.createDataFrame([(i + 1, i) for i in range(n)] + [(100, 101), (101, 100)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {100: 100, 101: 100}
    assert components(links.where("a < 0")).collect() == []


def test_a_round_of_components_reads_its_edges_few_times(spark, monkeypatch):
    scans = []

    def counted(df, name, real=C.materialize):
        scans.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
        return real(df, name)

    monkeypatch.setattr(C, "materialize", counted)
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "a bigint, b bigint")
    assert {r.component for r in components(links).collect()} == {0}
    assert len(scans) > 3 and 0 < max(scans) <= 4
