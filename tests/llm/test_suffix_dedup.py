from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docs_fixture import docs_of  # noqa: F401 (fixture)
from rollcall.llm import suffix_dedup as sd
from rollcall.llm.suffix_dedup import Collection, drop_repeats, later_windows, repeated_blocks, text_anchors


def brute(items, length):
    """(id, n_bytes, n_removed, n_spans, kept digest) in the order of documents."""
    docs = sorted({(i, t or "") for i, t in items}, key=lambda x: (x[0] is not None, x[0] or 0))
    seen, out = set(), {}
    for key in docs:
        b = key[1].encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            w = b[s:s + length]
            if w in seen:
                gone[s:s + length] = True
            seen.add(w)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]).astype(int)) == 1)
        out[key] = (len(b), int(gone.sum()), len(edges), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return sorted(((i, *out[i, t or ""]) for i, t in items), key=str)


def say(rnd, n, alphabet="abcdé fg\n"):
    return "".join(rnd.choice(alphabet) for _ in range(n))


def corpus(seed):
    rnd = random.Random(seed)
    passages = [say(rnd, rnd.choice([99, 100, 101, 150, 400])) for _ in range(8)]
    items = []
    for i in range(50):
        text = say(rnd, rnd.choice([0, 5, 120, 600]))
        for _ in range(rnd.choice([0, 1, 2])):
            p = rnd.choice(passages)
            cut = rnd.choice([0, 0, rnd.randrange(len(p))])
            text = text[:len(text) // 2] + p[cut:] + text[len(text) // 2:]
        items.append((i * 3, text))
    items += [(1000 + i, items[rnd.randrange(50)][1]) for i in range(10)]                       # exact copies
    near = list(items[7][1] + passages[4])
    for i in range(8):
        near[rnd.randrange(len(near))] = "X"
        items.append((2000 + i, "".join(near)))
    return items


@pytest.mark.parametrize("seed,hot", [(1, 20000), (2, 3)])
def test_as_brute_force(docs_of, monkeypatch, seed, hot):
    monkeypatch.setattr(sd, "HOT", hot)
    monkeypatch.setattr(sd, "BATCH", 3000)
    monkeypatch.setattr(sd, "SHARD", 700)
    items = corpus(seed)
    got = sorted((tuple(r) for r in drop_repeats(docs_of(items), digest=True).collect()), key=str)
    assert got == brute(items, 100)


def test_odd_texts(docs_of):
    rnd = random.Random(4)
    items = [(0, None), (1, ""), (2, "a" * 99), (3, "a" * 100), (4, "a" * 350), (5, "ab" * 300), (6, "b" + "ab" * 120), (7, "é" * 60),
             (8, "x" + "é" * 80), (9, "\x00" * 130 + "z"), (10, "\n" * 101), (None, "a" * 120), (11, say(rnd, 150_000, "abcdefgh")), (12, None)]
    items += [(13, items[12][1][50_000:60_000])]
    got = sorted((tuple(r) for r in drop_repeats(docs_of(items), digest=True).collect()), key=str)
    assert got == brute(items, 100)


def test_repeated_rows_shared_ids_empty_table_and_extra_columns(docs_of):
    rnd = random.Random(9)
    a, b = say(rnd, 300), say(rnd, 200)
    docs = docs_of([(5, a), (5, a), (7, a + b), (6, b)]).withColumn("_spans", F.lit(1)).withColumn("doc", F.lit("d"))
    got = sorted((r.doc_id, r.doc, r.n_removed, r.kept.decode()) for r in drop_repeats(docs, carry=["doc"]).collect())
    assert got == [(5, "d", 0, a), (5, "d", 0, a), (6, "d", 0, b), (7, "d", len((a + b).encode()), "")]
    two = drop_repeats(docs_of([(1, a), (1, a + "!"), (None, b), (None, b)])).collect()
    assert sorted(r.n_removed for r in two if r.doc_id == 1) == [0, len(a.encode())]
    assert all(r.n_removed == 0 for r in two if r.doc_id is None)
    assert drop_repeats(docs_of([])).collect() == []


def test_every_window_has_one_anchor_at_its_own_place(monkeypatch):
    rnd = random.Random(2)
    b = np.frombuffer((say(rnd, 900, "ab") + "a" * 300 + say(rnd, 400)).encode(), np.uint8)
    a, c, first, own = text_anchors(b, 100, 32)
    assert first[0] == 0 and (first[1:] == (first + own)[:-1]).all() and first[-1] + own[-1] == len(b) - 99
    monkeypatch.setattr(sd, "PIECE", 256)
    anchor_of = {}
    for x, s, n in zip(*(v.tolist() for v in (text_anchors(b, 100, 32)[i] for i in (0, 2, 3)))):
        anchor_of |= dict.fromkeys(range(s, s + n), x)
    whole = {}
    for x, s, n in zip(a.tolist(), first.tolist(), own.tolist()):
        whole |= dict.fromkeys(range(s, s + n), x)
    assert anchor_of == whole


def test_spans_that_touch_are_joined(spark, monkeypatch):
    monkeypatch.setattr(sd, "STRETCH", 50)
    rnd = random.Random(3)
    spans = [(d, a, a + rnd.choice([5, 30, 80])) for d in (1, 2, -4) for a in rnd.sample(range(600), 40)]
    got = sd.joined(spark.createDataFrame(spans, "doc long, a long, b long")).collect()
    covered = lambda rows: {(d, i) for d, a, b in rows for i in range(a, b)}
    assert covered(map(tuple, got)) == covered(spans) and len(got) < len(spans)
    for d, a, b in map(tuple, got):
        assert not any(d == e and x // 50 == a // 50 and (x, y) != (a, b) and x <= b and a <= y for e, x, y in map(tuple, got))


def test_a_text_that_repeats_itself_has_few_spans(docs_of):
    """A million windows of one text are copies; a document gets a span or two for each stretch."""
    n = 1_000_000
    docs = docs_of([(1, "a" * n), (2, "xyz" * 1000)])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("binary").alias("text"))
    spans = {r.doc: r.spans for r in sd.later_spans(texts).collect()}
    assert len(spans[1]) <= 2 * (n // sd.STRETCH + 1)
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in drop_repeats(docs, digest=True).collect()}
    assert got == {1: (n - 1, 1), 2: (2997, 1)}


@pytest.mark.parametrize("seed", range(6))
def test_merged_blocks_are_the_common_prefixes(seed):
    rnd = random.Random(seed)
    base = say(rnd, 200, "ab").encode()
    strings = [base[rnd.randrange(100):][:rnd.randint(1, 90)] + say(rnd, rnd.randint(0, 30), "abc").encode() for _ in range(40)] + [b"", base, base]
    c = Collection(strings, 10)
    block = repeated_blocks(c, 40, rnd.choice([50, 300, 10**6]))
    prefix = {}
    for k, s in enumerate(strings):
        for i in range(len(s)):
            prefix.setdefault(s[i:i + 40], set()).add(block[c.start[k] + i])
    assert all(len(x) == 1 for x in prefix.values())
    assert len(set.union(*prefix.values())) == len(prefix)
    for r in c.shards(300):
        order = c.suffix_order(*r)
        tails = [strings[c.owner[p]][p - c.start[c.owner[p]]:] for p in order]
        assert tails == sorted(tails)


def test_later_windows_of_strings():
    s, first, end = later_windows([b"q" * 5 + b"w" * 100, b"w" * 100 + b"e"], np.array([6, 2]), np.array([9, 4]), np.array([0, 7]), 100)
    assert [x.tolist() for x in (s, first, end)] == [[0], [5], [6]]
