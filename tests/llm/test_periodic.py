"""Periodic runs against every stretch and period of short sequences."""

import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import LONG, SMALL, edges, no_rows
from trialweave.llm import periodic, queries


def slow_runs(w, least=6, exponent=4):
    """Every stretch that has a period, cannot be longer with it, is long enough and has no smaller one, lag by lag."""
    w, out = np.asarray(w, dtype=np.int64), set()
    for q in range(1, len(w) // exponent + 1):
        same = np.concatenate([[False], w[:-q] == w[q:], [False]]).astype(np.int8)
        starts, ends = np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)
        for i, j in zip(starts.tolist(), ends.tolist(), strict=True):
            if j + q - i >= max(least, exponent * q) and not any((w[i : j + q - d] == w[i + d : j + q]).all() for d in range(1, q)):
                out.add((i, j + q - i, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(1, 9), st.integers(1, 8))
def test_runs_equal_every_stretch(w, p, times):
    for seq in (w, w + w[:p] * times + w[::-1]):
        assert periodic.runs_of(np.array(seq, dtype=np.int64)) == slow_runs(seq)


def test_other_exponents():
    rng = random.Random(4)
    for _ in range(100):
        w = [rng.randrange(2) for _ in range(rng.randrange(40))] + [0, 1, 1] * rng.randrange(6)
        for least, exponent in ((1, 3), (6, 3), (20, 4), (2, 5)):
            assert periodic.runs_of(np.array(w, dtype=np.int64), least, exponent) == slow_runs(w, least, exponent)


def test_one_word_many_times_is_one_run_found_in_linear_work():
    n = 300_000
    assert periodic.runs_of(np.zeros(n, dtype=np.int64)) == [(0, n, 1)]
    w = np.arange(n) % 70_000
    assert periodic.runs_of(w) == [(0, n, 70_000)]


def slow_row(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    codes = {x: k for k, x in enumerate(dict.fromkeys(w))}
    runs = slow_runs([codes[x] for x in w])
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    gone = {i for s, n_, q in runs for i in range(s + q, s + n_)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    s, n_, q = best or (None, None, None)
    return (
        doc_id, len(runs), s, n_, q, 1000 * n_ // q if best else None,
        sha("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def test_query_equals_brute_force(spark):
    import duckdb

    docs = duckdb.sql(f"select doc_id, text from '{SMALL}/documents.parquet'").fetchall()
    got = sorted(tuple(r) for r in queries.op13(spark, SMALL).collect())
    assert got == sorted(slow_row(*d) for d in docs)
    assert sum(r[1] > 0 for r in got) > 10


def test_edges(spark):
    df = edges(spark, "runs", "n_words", "collapsed")
    got = sorted(map(str, ((r["doc_id"], r["n_words"], r["runs"], r["collapsed"]) for r in periodic.find_runs(df).collect())))
    assert len(got) == df.count()
    assert str((1, 0, [], "")) in got and str((2, 0, [], "")) in got and got.count(str((4, 1, [], "one"))) == 2
    long = periodic.find_runs(df.where("doc_id = 6")).first()
    assert [tuple(r) for r in long["runs"]] == [(0, 60_000, 977)] and long["collapsed"] == " ".join(LONG.split()[:977])
    assert periodic.find_runs(no_rows(spark)).collect() == []
