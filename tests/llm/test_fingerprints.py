from __future__ import annotations

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from docs_fixture import docs_of  # noqa: F401 (fixture)
from rollcall.llm import fingerprints as fp


def shingles(text, k=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(ws[i:i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set()


def edited(items):
    """(id, n_chars, edited text, text, next text) by descending id, ties by the text's hash."""
    def h(t):
        x = xxhash.xxh64_intdigest(t.encode(), 42) if t is not None else 42
        return x - 2**64 if x >= 2**63 else x
    items = sorted(items, key=lambda x: (x[0] is not None, x[0] or 0, h(x[1])), reverse=True)
    out = []
    for i, (doc_id, t) in enumerate(items):
        t, nxt = t or "", items[(i + 1) % len(items)][1] or ""
        out.append((doc_id, len(t), t[:len(t) - len(t) // 2] + nxt[:len(t) // 2], t, nxt))
    return out


def say(rnd, n):
    return " ".join(rnd.choice(["Ab", "cé", "d", "ef", "漢", "g𝄞"]) + str(rnd.randrange(50)) for _ in range(n))


@pytest.mark.parametrize("per_part", [2000, 3])
def test_edited_text_order_and_likeness(docs_of, monkeypatch, per_part):
    monkeypatch.setattr(fp, "ROWS_PER_PART", per_part)
    rnd = random.Random(8)
    items = [(i * 7, say(rnd, rnd.choice([0, 1, 3, 20, 60]))) for i in range(40)]
    items += [(300, None), (301, None), (1000, items[5][1]), (1001, items[5][1]), (280, "tie a"), (280, "tie b"), (None, "no id x"), (None, "no id")]
    items += [(2000, say(rnd, 30000))]
    got = fp.edited_pairs(docs_of(items)).collect()
    want = edited(items)
    assert sorted((str(r.doc_id), r.n_chars, r.edited) for r in got) == sorted((str(w[0]), w[1], w[2]) for w in want)
    # Sketches of texts with at most k shingles are whole: likeness is exact.
    by = {(w[0], w[2]): w for w in want}
    for r in got:
        _, _, e, t, nxt = by[r.doc_id, r.edited]
        for near, other in ((r.near_edited, e), (r.near_next, nxt)):
            a, b = shingles(t), shingles(other)
            if len(a | b) <= fp.K:
                assert near == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
            elif len(a & b) == 0:
                assert near == 0


def test_estimates_and_merge(spark):
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(100000)]
    a = [rnd.choice(words) for _ in range(6000)]
    b = a[:4000] + [rnd.choice(words) for _ in range(2000)]
    df = spark.createDataFrame([(" ".join(a), " ".join(b))], "a string, b string")
    df = fp.with_sketch(fp.with_sketch(df, F.col("a"), "sa"), F.col("b"), "sb")
    r = df.select(fp.resemblance(F.col("sa"), F.col("sb")).alias("j"), fp.containment(F.col("sa"), F.col("sb")).alias("c"),
                  fp.distinct_shingles(F.col("sa")).alias("n"), "sa", "sb", fp.merged([F.col("sa"), F.col("sb")]).alias("m")).first()
    assert abs(r.j - 0.5) < 0.15 and abs(r.c - 2 / 3) < 0.25 and abs(r.n / 5996 - 1) < 0.3
    parts = spark.createDataFrame([("x", r.sa), ("x", r.sb), ("y", [])], "g string, s array<long>")
    assert [(x.g, x.s) for x in fp.merge_parts(parts, ["g"], "s").collect()] == [("x", r.m)]


def test_small_tables_and_hex(docs_of):
    assert fp.edited_pairs(docs_of([])).collect() == []
    r = fp.edited_pairs(docs_of([(3, "abcd efgh")])).withColumn("hex", fp.as_hex(F.col("sketch"))).collect()[0]
    assert (r.edited, r.n_chars, r.near_next, len(r.hex)) == ("abcd abcd", 9, 1.0, 16)
    assert [x.doc_id for x in fp.edited_pairs(docs_of([(None, None)])).collect()] == [None]


def test_sketch_holds_the_least_hashes(spark):
    rnd = random.Random(2)
    text = say(rnd, 900)
    got = fp.with_sketch(spark.createDataFrame([(text,)], "t string"), F.col("t"), "s").first().s
    ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    def h(words):
        x = 42
        for w in words:     # Spark's hash of several columns: each seeded by the one before
            x = xxhash.xxh64_intdigest(w.encode(), x)
        return x - 2**64 if x >= 2**63 else x
    assert got == sorted({h(ws[i:i + 5]) for i in range(len(ws) - 4)})[:fp.K]


@pytest.mark.parametrize("ids", [[*range(300), 2**62], [*range(20), *[None] * 300], [7] * 200 + [9] * 100, [None] * 250])
def test_uneven_ids_stay_in_small_parts(spark, docs_of, monkeypatch, ids):
    monkeypatch.setattr(fp, "ROWS_PER_PART", 10)
    items = [(x, f"text number {i}") for i, x in enumerate(ids)]
    rows = docs_of(items).select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), "text")
    placed, _ = fp._in_parts(rows)
    assert placed.groupBy("part").count().agg(F.max("count")).first()[0] <= 80
    got = sorted((str(r.doc_id), r.n_chars, r.edited) for r in fp.edited_pairs(docs_of(items)).collect())
    assert got == sorted((str(w[0]), w[1], w[2]) for w in edited(items))


def test_clashing_names(docs_of):
    docs = docs_of([(i, f"text {i}") for i in range(5)])
    for c in ("id", "h", "part", "extra", "sketch", "next_text", "_file", "n_chars_"):
        docs = docs.withColumn(c, F.lit("mine"))
    assert len(fp.edited_pairs(docs).collect()) == 5
