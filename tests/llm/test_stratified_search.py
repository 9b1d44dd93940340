import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import stratified_search as S

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(t):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, top=10, b=90, k=8):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, length = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    out = []
    for item, text in {*items}:
        scored = []
        for i, c in counts:
            m = 100 - b + (b * sum(c.values()) * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + k * m)) for w in set(terms(text)) if c[w])
            if s > 0:
                scored.append((-s, (i is not None, i or 0)))
        out += [(item, r + 1, i[1] if i[0] else None, -s) for r, (s, i) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("rank", F.lit("clash")).withColumn("term", F.lit("clash")).repartition(2)


def found(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=repr)


@pytest.mark.parametrize("unit", [S.UNIT, 7])
def test_against_brute_force(spark, docs_of, spoken, unit):
    docs = [(i, spoken(i, 3 + (i * i) % 90, vocabulary=60 if i % 3 else 300)) for i in range(120)]
    docs += [(200 + i, docs[5][1]) for i in range(15)]  # copies: one length, equal scores
    items = [(i, spoken(i, 12, vocabulary=60 if i % 3 else 300)) for i in range(20)] + [(50, docs[5][1])]
    assert found(S.ranked_search(docs_of(docs), items_of(spark, items), unit=unit)) == brute(docs, items)


def test_index_of_all_terms_serves_any_query(spark, docs_of, spoken):
    docs = [(i, spoken(i % 9, 30)) for i in range(40)]
    index = S.build_index(docs_of(docs), unit=16)
    assert index.units.agg(F.sum("n_docs")).first()[0] == 40
    for items in ([(1, docs[0][1])], [(2, "nothing shared"), (3, docs[4][1][:40])]):
        got = found(S.search(index, S.item_terms(items_of(spark, items)), top=3))
        assert got == brute(docs, items, top=3)


def test_edges(spark, docs_of):
    """Nulls, no terms, other alphabets, digits, capitals, repeated rows and ids, a very long text, clashing columns."""
    docs = [(1, None), (2, ""), (3, "--- ..."), (4, "Één É é 東京 42"), (5, "één 42 b"), (None, "b b b"), (6, "b"), (6, "b"), (7, "b " * 60000 + "rare"), (8, "B-b_b")]
    items = [(1, "één É"), (2, None), (3, "?!"), (4, "b rare B"), (4, "東京 unknown"), (4, "b rare B"), (None, "42"), (5, "")]
    got = found(S.ranked_search(docs_of(docs), items_of(spark, items)))
    want = brute(docs, items)
    assert [r for r in got if r[0] != 4] == [r for r in want if r[0] != 4]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_empty_tables(spark, docs_of):
    assert found(S.ranked_search(docs_of([]), items_of(spark, [(1, "a")]))) == []
    assert found(S.ranked_search(docs_of([(1, "a")]), items_of(spark, []))) == []


def test_a_unit_visits_only_strata_that_can_matter(tmp_path):
    """Strata below the floor are left out, and what is returned is the same as by scoring all."""
    r = np.random.default_rng(2)
    import pyarrow as pa
    n = 400
    lists = [np.unique(r.integers(0, 30, r.integers(1, 12))) for _ in range(n)]
    t = pa.table({"doc_id": pa.array(r.permutation(n)), "m": pa.array(r.integers(10, 60, n)), "terms": pa.array([x.tolist() for x in lists]),
                  "tfs": pa.array([r.integers(1, 5, len(x)).tolist() for x in lists]), "band": pa.array([3] * n), "part": pa.array([0] * n)})
    unit = S.Unit(S._build_unit(str(tmp_path), 8)(t)["file"][0].as_py())
    terms, w = np.arange(0, 30, 3), r.integers(0, 900, 10)
    rows = t.to_pylist()
    score = {d["doc_id"]: sum(int(w[int(x) // 3]) * int(S.impact(f, d["m"], 8)) for x, f in zip(d["terms"], d["tfs"], strict=True) if x % 3 == 0) for d in rows}
    want = sorted(((-s, i) for i, s in score.items() if s > 0))[:10]
    for floor in (0, -want[9][0]):
        ids, scores = unit.search(terms, w, 10, floor)
        assert list(zip((-scores).tolist(), ids.tolist(), strict=True)) == want
    seen = []
    add = S.Unit._add
    S.Unit._add = lambda self, score, runs, visit: (seen.append(int(visit.sum())), add(self, score, runs, visit))
    try:
        unit.search(terms, w, 10, -want[0][0])
    finally:
        S.Unit._add = add
    assert sum(seen) < len(unit.sizes)
