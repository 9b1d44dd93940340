import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe.llm import exact_dedup as D

F3 = D.Fingerprinter()


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def direct(data, radix, prime):
    h = 0
    for b in data:
        h = (h * radix + b) % prime
    return h


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300), st.binary(max_size=300))
def test_fingerprints_compose(a, b):
    run = lambda x: F3.run(np.frombuffer(x, np.uint8).astype(np.uint64))
    whole = run(a + b)
    assert whole == tuple(direct(a + b, r, p) for r, p in zip(D.RADIX, D.PRIMES, strict=True))
    left, right = F3.shift(run(a), len(b)), run(b)
    assert whole == tuple((x + y) % p for x, y, p in zip(left, right, D.PRIMES, strict=True))


def test_chunks_of_a_long_run_combine():
    data = np.random.default_rng(3).integers(0, 256, 3 * D.CHUNK + 17).astype(np.uint8)
    assert F3.run(data.astype(np.uint64)) == tuple(direct(data.tobytes(), r, p) for r, p in zip(D.RADIX, D.PRIMES, strict=True))


ROWS = [(1, "Same text"), (2, "same TEXT"), (3, "other"), (4, ""), (5, None), (None, "same text"), (7, "É"), (8, "é"), (9, "x" * 5000),
        (10, "X" * 5000), (11, "x" * 4999 + "y"), (12, "ab c"), (12, "ab c"), (13, "a bc")]


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[low(t)] if x is not None]
        out.append((i, max(ids) if ids else None, len(groups[low(t)]), hashlib.sha256(low(t).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("options", [{}, {"huge_bytes": 700, "compare_bytes": 64}, {"primes": (7, 5), "compare_bytes": 64}])
def test_against_brute_force(docs_of, options):
    """Plain; with documents in parallel chunks; and with primes so small that unequal texts collide."""
    got = D.exact_dedup(docs_of(ROWS), **options).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=repr) == expected(ROWS)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({low(t) for _, t in ROWS}) and all(r.doc_id == r.keep_id for r in kept)


def test_rows_that_stay(docs_of):
    d = docs_of(ROWS)
    out = D.drop_copies(d)
    assert out.columns == d.columns
    rows = out.collect()
    assert sorted(low(r.text) for r in rows) == sorted({low(t) for _, t in ROWS})


def test_empty_table(docs_of):
    assert D.exact_dedup(docs_of([])).collect() == [] and D.drop_copies(docs_of([])).collect() == []


def test_hot_group(docs_of):
    rows = [(i, "the same words again") for i in range(3000)] + [(i, f"text {i}") for i in range(3000, 4000)]
    got = D.exact_dedup(docs_of(rows, parts=8)).where("kept").collect()
    assert len(got) == 1001 and {r.keep_id: r.group_size for r in got}[2999] == 3000
