from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from rollcall.llm import common, sharding
from rollcall.llm.sharding import Ends, balanced_cuts, minimax_cuts, shard_rows, smallest_capacity


def brute_capacity(sizes, k):
    """Smallest largest part, by dynamic programming."""
    n, pre = len(sizes), [0]
    for s in sizes:
        pre.append(pre[-1] + s)
    best = [0] + [float("inf")] * n
    for _ in range(k):
        best = [min(max(best[j], pre[i] - pre[j]) for j in range(i + 1)) for i in range(n + 1)]
    return best[n]


@pytest.mark.parametrize("seed", range(12))
def test_capacity_is_minimal_and_cuts_keep_it(seed):
    rnd = random.Random(seed)
    sizes = [rnd.choice([1, 2, 5, rnd.randint(1, 60)]) for _ in range(rnd.randint(1, 40))]
    k = rnd.randint(1, 9)
    ends, at, known = [], 0, Ends()
    for s in sizes:
        at += s
        ends.append(at)
    known.put({(0, 0, e): (e, e, 1) for e in ends})
    capacity = smallest_capacity(known, at, max(sizes), k)
    assert capacity == brute_capacity(sizes, k) and not known.touched
    cuts = [0, *balanced_cuts(known, at, capacity, k), at]
    assert cuts == sorted(cuts) and all(c in (0, *ends) for c in cuts)
    assert max(b - a for a, b in zip(cuts, cuts[1:])) == capacity


def test_refinement_reaches_the_exact_answer(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLICES", 5)
    monkeypatch.setattr(sharding, "FINER", 3)
    rnd = random.Random(4)
    sizes = [rnd.randint(1, 500) for _ in range(60)]
    ends = [sum(sizes[:i + 1]) for i in range(60)]
    capacity, cuts = minimax_cuts(spark.createDataFrame([(e,) for e in ends], "end long"), ends[-1], max(sizes), 6)
    assert capacity == brute_capacity(sizes, 6)
    cuts = [0, *cuts, ends[-1]]
    assert max(b - a for a, b in zip(cuts, cuts[1:])) == capacity


def sharded(spark, rows, k):
    df = spark.createDataFrame(rows, "doc_id long, g long, size long").withColumn("at", F.xxhash64("g")).withColumn("place", F.xxhash64("doc_id"))
    return df, shard_rows(df, ["g"], "size", "at", "place", k).collect()


def test_groups_slots_ties_nulls_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(common, "ROWS_PER_WINDOW", 50)
    rnd = random.Random(1)
    rows = [(i, rnd.randint(0, 300), rnd.randint(0, 90)) for i in range(1500)]
    rows += [(7, 3, 4), (7, 3, 4), (None, None, 5), (None, 2, None)]
    df, out = sharded(spark, rows, 8)
    assert sorted((r.doc_id, r.g, r["size"]) for r in out if r.doc_id is not None) == sorted(x for x in rows if x[0] is not None) and len(out) == len(rows)
    where = {}
    for r in out:
        assert where.setdefault(r.g, r.shard) == r.shard
    for s in range(8):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    loads = [sum(r["size"] or 0 for r in out if r.shard == s) for s in range(8)]
    order = [x[0] for x in df.groupBy("g").agg(F.min("at").alias("a"), F.sum("size").alias("s")).orderBy("a", "g").select(F.coalesce("s", F.lit(0))).collect()]
    assert max(loads) == brute_capacity(order, 8)


def test_hot_group_leaves_no_shard_empty_and_empty_table(spark):
    _, out = sharded(spark, [(i, 0 if i % 3 == 0 else i, 10) for i in range(600)], 16)
    loads = [sum(r["size"] for r in out if r.shard == s) for s in range(16)]
    assert max(loads) == 2000 and min(loads) > 0
    assert sharded(spark, [], 4)[1] == []
    assert [r.shard for r in sharded(spark, [(1, 1, 5)], 4)[1]] is not None


def test_clashing_names_nulls_and_repeated_rows(spark):
    rows = spark.createDataFrame([(1, "a", 3), (1, "a", 3), (None, None, None), (2, "b", 5)], "doc_id long, g string, size long")
    rows = rows.withColumns({c: F.lit("mine") for c in ("shard", "slot", "_part", "_at")}).withColumn("place", F.xxhash64("doc_id"))
    out = shard_rows(rows, ["g"], "size", "place", "place", 3).collect()
    assert len(out) == 4 and all(r.shard_of_row == r.slot_of_row == r._part == r._at == "mine" for r in out)
    assert len({r.shard for r in out if r.g == "a"}) == 1
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
