from __future__ import annotations

import random
import re
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from docs_fixture import docs_of  # noqa: F401 (fixture)
from rollcall.llm import periodic
from rollcall.llm.periodic import Lce, find_runs, periodic_runs
from rollcall.llm.queries import planted_runs

SMALL = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_runs(w, least=6, exponent=4):
    """Maximal stretches for every period, each interval with its smallest one."""
    n, best = len(w), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, exponent * q):
                best.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in best.items())


def brute(doc_id, text):
    w = words_of(text)
    n = len(w)
    h = crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    top = min(((-k, s, q) for s, k, q in runs), default=None)
    first = (None,) * 4 if top is None else (top[1], -top[0], top[2], 1000 * -top[0] // top[2])
    def digest(t):
        return sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *first, digest("".join(f"{s},{k},{q}\n" for s, k, q in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in gone)))


def key(row):
    return str(row)


def test_cover_reaches_every_pair():
    assert {(a - b) % 13 for a in periodic.COVER for b in periodic.COVER} == set(range(13))
    assert periodic._shifts().max() < 13


@pytest.mark.parametrize("size, letters, seed", [(1, 1, 0), (2, 1, 0), (14, 1, 1), (60, 1, 2), (200, 2, 3), (400, 3, 4), (700, 50, 5)])
def test_lce_equals_direct_comparison(size, letters, seed):
    rng = np.random.default_rng(seed)
    seq = rng.integers(0, letters, size)
    seq = np.concatenate([seq, seq[:size // 2], seq])   # long common extensions
    n = len(seq)
    lce = Lce(seq)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(n)))
    a, b = a[a != b][::7], b[a != b][::7]
    def direct(i, j):
        k = 0
        while max(i, j) + k < n and seq[i + k] == seq[j + k]:
            k += 1
        return k
    assert lce(a, b).tolist() == [direct(i, j) for i, j in zip(a.tolist(), b.tolist())]


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    r = random.Random(seed)
    texts = [[], [0], [0] * 5, [0] * 6, [0] * 300, [0, 1] * 4, [0, 1] * 3 + [0], list(range(40))]
    for _ in range(60):
        t = []
        while len(t) < r.randrange(120):
            unit = [r.randrange(r.choice((1, 2, 3, 30))) for _ in range(r.randrange(1, 9))]
            t += unit * r.randrange(1, 7) + unit[:r.randrange(len(unit) + 1)]
        texts.append(t)
    texts += [texts[-1]] * 2
    got = [[tuple(x) for x in runs.tolist()] for runs in find_runs(texts)]
    assert got == [brute_runs(t) for t in texts]
    two = [[tuple(x) for x in runs.tolist()] for runs in find_runs(texts, 2, 2)]
    assert two == [brute_runs(t, 2, 2) for t in texts]


def test_grid_in_pieces(monkeypatch):
    r = random.Random(9)
    texts = [[r.randrange(2) for _ in range(r.randrange(90))] for _ in range(20)]
    whole = [x.tolist() for x in find_runs(texts)]
    monkeypatch.setattr(periodic, "POINTS", 7)
    assert [x.tolist() for x in find_runs(texts)] == whole


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = sorted((tuple(r) for r in planted_runs(docs).collect()), key=key)
    assert got == sorted((brute(r.doc_id, r.text) for r in docs.collect()), key=key)
    assert any(r[1] for r in got)


def test_nulls_repeats_and_long_texts(docs_of):
    texts = [(None, "a b " * 20), (None, None), (7, None), (7, ""), (8, " \n\t "), (9, "x y\x85z " * 9), (10, "A a A a A a A a"), (9, "x y\x85z " * 9),
             (11, "one two three " * 3000), (12, " ".join(f"w{i}" for i in range(3000))), (26, "é ü " * 10 + "tail"), (31, "lone")]
    texts += [(i, " ".join(f"w{k % 17}" for k in range(60))) for i in range(40, 80)]
    got = sorted((tuple(r) for r in planted_runs(docs_of(texts).repartition(3)).collect()), key=key)
    assert got == sorted((brute(*t) for t in texts), key=key)


def test_whole_results_and_clashing_names(docs_of):
    docs = docs_of(["go " * 7 + "home now", None])
    for c in ("runs", "collapsed", "_row", "_text", "n_words"):
        docs = docs.withColumn(c, F.lit("x"))
    out = {r.doc_id: r for r in periodic_runs(docs, carry=["doc_id", "runs", "collapsed", "_row"]).collect()}
    assert out[0].collapsed == "go home now" and [tuple(r) for r in out[0].runs] == [(0, 7, 1)] and out[0].runs_of_row == out[0]._row == "x"
    assert out[1].collapsed == "" and out[1].runs == []
    assert planted_runs(docs_of([])).count() == 0
