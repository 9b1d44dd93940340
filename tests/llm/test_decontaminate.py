import re

import pytest

from helixframe.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, window=13):
    out = {}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            v = words(text)
            n = min(window, len(v))
            if text is None or not n:
                continue
            runs = {tuple(v[j:j + n]) for j in range(len(v) - n + 1)}
            for j in range(len(w) - n + 1):
                if tuple(w[j:j + n]) in runs:
                    hit |= set(range(j, j + n))
                    found |= {str(item)} - {"None"}
        out[i] = (len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("window,item_bytes", [(13, 1 << 20), (3, 200), (5, 1)])
def test_against_brute_force(spark, docs_of, spoken, monkeypatch, window, item_bytes):
    pool = [spoken(s, 40, 6) for s in range(4)]  # few words: many partial matches
    items = [(i, pool[i % 4][i:i + 30 + 7 * i]) for i in range(8)] + [(20, "one"), (21, "A short item"), (22, ""), (23, None), (None, "one two"),
             (24, pool[0]), (25, pool[0]), (26, "!!")]
    docs = [(i, spoken(i, 200, 6)) for i in range(12)] + [(100, None), (101, ""), (102, pool[0]), (103, "x " * 50 + pool[1].upper() + " y" * 700),
            (104, "one"), (105, "a, SHORT -- item; one"), (106, pool[0] + pool[2]), (107, "!!! ...")]
    t = spark.createDataFrame(items, "item_id long, text string")
    real = D.build_automata
    monkeypatch.setattr(D, "build_automata", lambda *a, **k: real(*a, **k, item_bytes=item_bytes))
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in D.decontaminate(docs_of(docs), t, window=window).collect()}
    assert got == brute(docs, items, window)


def test_spans_and_clean_text(spark, docs_of):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    r = D.decontaminate(docs_of([(1, f"Before, {item.upper()}; after é."), (2, None)]), items).collect()
    r = {x.doc_id: x for x in r}
    assert r[1].spans == [(1, 14)] and r[1].longest == 14 and r[1].clean_text == "Before, ; after é." and r[1].n_hit == 14
    assert r[2].clean_text is None and not r[2].contaminated


def test_items_without_an_id_hit_words(spark, docs_of):
    """Their windows count like any other's; they are in no list."""
    items = spark.createDataFrame([(None, "alpha beta gamma"), (4, "gamma delta")], "item_id long, text string")
    r = D.decontaminate(docs_of([(1, "x alpha beta gamma delta y")]), items).first()
    assert (r.n_hit, r["items"], r.contaminated) == (4, ["4"], True)


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.decontaminate(docs_of([]), none).collect() == []
    assert [r.n_hit for r in D.decontaminate(docs_of([(1, "a b")]), none).collect()] == [0]


def test_automaton_holds_all_runs_and_no_others():
    a = D.SuffixAutomaton(3)
    seqs = ["a b a b c", "b c a", "a a a"]
    for i, s in enumerate(seqs):
        a.add(str(i), [w.encode() for w in s.split()])
    a.finish()
    runs = {tuple(s.split()[i:j]) for s in seqs for i in range(len(s.split())) for j in range(i + 1, len(s.split()) + 1)}
    import itertools
    for n in (1, 2, 3, 4):
        for c in itertools.product("abc", repeat=n):
            state = 0
            for w in c:
                state = a.next[state].get(a.vocabulary[w.encode()]) if state is not None else None
            assert (state is not None) == (c in runs)


def test_one_id_of_many_rows_lies_in_several_automata(spark, docs_of, spoken):
    items = [(1, spoken(s, 40)) for s in range(40)] + [(1, spoken(0, 40))] * 20
    t = spark.createDataFrame(items, "item_id long, text string")
    files = D.build_automata(t, item_bytes=800)
    parts = [D._load(f) for f in files]
    assert len(files) > 4 and max(len(a.next) for a in parts) < sum(len(a.next) for a in parts) / 3
    docs = docs_of([(i, spoken(i, 40)) for i in (0, 7, 39)] + [(100, spoken(900, 40))])
    got = {r.doc_id: (r.n_hit, r["items"]) for r in D.decontaminate(docs, t).select("doc_id", "n_hit", "items").collect()}
    assert got == {0: (40, ["1"]), 7: (40, ["1"]), 39: (40, ["1"]), 100: (0, [])}
