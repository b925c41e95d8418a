from __future__ import annotations

import random
import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from docs_fixture import docs_of  # noqa: F401 (fixture)
from rollcall.llm.decontaminate import contamination, without_contaminated

ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, size=10):
    out = []
    for doc_id, text in docs:
        ws, hit, found = words(text), set(), set()
        for item_id, it in items:
            iw = words(it)
            n = min(size, len(iw))
            wins = {tuple(iw[i:i + n]) for i in range(len(iw) - n + 1)} if n else set()
            for i in range(len(ws)):
                if n and tuple(ws[i:i + n]) in wins and i + n <= len(ws):
                    hit.update(range(i, i + n))
                    found.add(item_id)
        out.append((doc_id, len(ws), len(hit), len(found), sorted(str(x) for x in found if x is not None), bool(hit)))
    return sorted(out, key=str)


def compare(spark, docs_of, docs, items):
    got = contamination(docs_of(docs), spark.createDataFrame(items, ITEMS)).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.item_ids, r.contaminated) for r in got), key=str)
    assert got == brute([(d[0], d[1]) for d in docs], items)


def test_as_brute_force(spark, docs_of):
    rnd = random.Random(2)
    vocab = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(40)]
    say = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, say(rnd.choice([1, 2, 3, 6, 9, 10, 11, 40]))) for i in range(30)]
    items += [(100, items[7][1]), (101, None), (102, "... ,"), (103, "a b a b a b a b a b a b a b"), (9, "x y x y")]
    docs = [(i, say(rnd.choice([0, 1, 4, 50, 200]))) for i in range(40)]
    for i in range(40):
        it = items[rnd.randrange(30)][1].split()
        a = rnd.randrange(len(it))
        docs.append((100 + i, f"{say(20)}, {'-'.join(it[a:a + 14]).upper()}. {say(5)}"))
    docs += [(500, "a b a b a b a b a b a b a b a b a b a b a b"), (501, None), (502, ""), (503, "x y x y x y"), (500, "q")]
    docs += [(600, docs[45][1]), (600, docs[45][1]), (None, items[7][1]), (601, " ".join([say(3000), items[7][1], say(3000)]))]
    compare(spark, docs_of, docs, items)


def test_empty_tables_and_hot_passage(spark, docs_of):
    passage = " ".join(f"common{i}" for i in range(30))
    docs = [(i, f"start {i} {passage} end") for i in range(300)]
    compare(spark, docs_of, docs, [(1, passage), (2, "x " + passage)])
    compare(spark, docs_of, docs[:3], [])
    compare(spark, docs_of, [], [(1, passage)])


def test_filter_keeps_clean_rows_with_clashing_columns(spark, docs_of):
    passage = " ".join(f"p{i}" for i in range(12))
    docs = docs_of([(1, passage), (1, "clean"), (2, None), (None, passage + " q")]).withColumn("h1", F.lit(1)).withColumn("kind", F.lit("k"))
    out = without_contaminated(docs, spark.createDataFrame([(1, passage)], ITEMS))
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, "clean"), (2, None)]
