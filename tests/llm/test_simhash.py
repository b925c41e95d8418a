from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docs_fixture import docs_of  # noqa: F401 (fixture)
from rollcall.llm.simhash import _syndromes, components, fingerprint, near_duplicate_groups, near_links, one_of_each_group


def brute_fp(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    sh = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(items, bits=4):
    """Smallest key reachable, for (key, fingerprint) items."""
    root = list(range(len(items)))
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(items)):
        for j in range(i):
            if (items[i][1] ^ items[j][1]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (k, _) in enumerate(items):
        least.setdefault(find(i), []).append(k)
    return {k: min(least[find(i)]) for i, (k, _) in enumerate(items)}


def texts():
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    out = []
    for i in range(60):
        base = [rnd.choice(words) for _ in range(rnd.choice([1, 2, 3, 5, 30, 300]))]
        out.append(" ".join(base))
        for _ in range(rnd.choice([0, 0, 1, 3])):
            copy = list(base)
            copy[rnd.randrange(len(copy))] = rnd.choice(words)
            out.append("\t".join(copy).upper())
    return out + ["", None, "  \n", "Ä ä É", "one two three four " * 4000, "Ünï cödé\x1cx y z"]


def test_fingerprints_and_components_as_brute_force(docs_of):
    items = texts()
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in near_duplicate_groups(docs_of(items)).collect()}
    prints = {i: brute_fp(t) for i, t in enumerate(items)}
    want = brute_components(list(prints.items()))
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}
    assert fingerprint(b"a b") == brute_fp("A  b")


def test_spark_hash_is_the_same(spark):
    assert spark.sql("SELECT xxhash64('a b c d') AS h").first().h % 2**64 == xxhash.xxh64_intdigest(b"a b c d", 42)


def test_every_part_value_has_one_home_and_patterns_are_whole():
    patterns, home = _syndromes()
    assert sum(map(len, patterns)) == 1 + 23 + 253 + 1771 + 8855
    assert all((np.bitwise_count(p) <= 3).sum() == 1 for p in patterns)
    assert np.bitwise_count(home).max() == 3


@pytest.mark.parametrize("pairs_per_task", [50_000_000, 40])
def test_links_connect_all_within_four_bits(spark, monkeypatch, pairs_per_task):
    monkeypatch.setattr("rollcall.llm.simhash.PAIRS_PER_TASK", pairs_per_task)
    rnd = random.Random(9)
    fps = set()
    for _ in range(40):
        x = rnd.getrandbits(64)
        fps.add(x)
        for _ in range(6):   # chains of steps of 1 to 6 bits
            for _ in range(rnd.randint(1, 6)):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in fps], "fp long")
    got = {r.node % 2**64: r.root for r in components(near_links(df)).collect()}
    want = brute_components([((x - 2**64 if x >= 2**63 else x), x) for x in fps])
    assert {x: got.get(x, x - 2**64 if x >= 2**63 else x) for x in fps} == {k % 2**64: v for k, v in want.items()}


def test_hot_group_empty_table_null_ids_and_extra_columns(docs_of):
    docs = docs_of([(i, "the same text of one big group") for i in range(500)] + [(7, "other words stand here now"), (None, None), (None, "")])
    out = near_duplicate_groups(docs.withColumn("_fp", F.lit("x")).withColumn("root", F.lit(1)), carry=["root"])
    rows = out.collect()
    assert len(rows) == 503 and out.columns == ["doc_id", "root", "fingerprint", "component_id", "component_fp"]
    assert {r.component_id for r in rows if r.doc_id is None} == {None}
    assert sum(r.component_id == 0 for r in rows) == 500
    assert near_duplicate_groups(docs_of([])).collect() == []


def test_one_row_of_each_group_stays(docs_of):
    docs = docs_of([(5, "the same text of one group"), (3, "the same text of one group"), (3, "the same text of one group"), (9, "quite another text is this one"),
                    (None, "third text"), (None, "third text"), (None, "fourth text, no id"), (2, None), (1, "")]).withColumn("_id", F.lit(0)).withColumn("component_fp", F.lit("c"))
    out = one_of_each_group(docs)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(
        [(3, "the same text of one group"), (9, "quite another text is this one"), (None, "third text"), (None, "fourth text, no id"), (1, "")], key=str)
    assert one_of_each_group(docs.limit(0)).collect() == []
