from __future__ import annotations

import random
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from docs_fixture import docs_of  # noqa: F401 (fixture)
from rollcall.llm import common
from rollcall.llm.mixing import mix, placed, schedule, whole_weights, windows


@pytest.mark.parametrize("seed", range(15))
def test_edf_meets_every_window_and_deviates_less_than_a_block(seed):
    rnd = random.Random(seed)
    parts = [rnd.choice([1, 2, 7, 40, 300]) for _ in range(rnd.randint(1, 25))]
    total, served = sum(parts), Counter()
    for t, (i, j, release, deadline) in enumerate(windows(parts, parts)):
        assert j == served[i] and release <= t < deadline
        served[i] += 1
        assert all(abs(served[i] * total - (t + 1) * a) < total for i, a in enumerate(parts))
    assert [served[i] for i in range(len(parts))] == parts


def check(out, n, block_rows):
    assert sorted(r.position for r in out) == list(range(n))
    by_slot = {}
    for r in out:
        assert r.release <= r.slot < r.deadline
        by_slot.setdefault(r.slot, set()).add((r.source, r.block))
    assert all(len(x) == 1 for x in by_slot.values()) and sorted(by_slot) == list(range(len(by_slot)))
    order = sorted(out, key=lambda r: r.position)
    assert [r.slot for r in order] == sorted(r.slot for r in order)
    assert max(Counter(r.slot for r in out).values()) <= block_rows


def test_every_row_once_in_gapless_order(docs_of):
    rnd = random.Random(3)
    items = [(i, f"t{i}", rnd.choice(["a", "a", "a", "b", "c"]) if i % 50 else None) for i in range(1000)] + [(5, "t5", "a"), (5, "t5", "a")]
    out = mix(docs_of(items), block_rows=4).collect()
    check(out, 1002, 4)
    assert Counter(r.doc_id for r in out)[5] == 3
    # While every source lasts, each keeps its share to within a block.
    weight = {r.source: r.target_weight for r in out}
    assert abs(sum(weight.values()) - 1) < 1e-9


def test_given_weights_hold_until_a_source_ends(docs_of):
    items = [(i, "x", "ab"[i % 2]) for i in range(400)]
    out = mix(docs_of(items), weights={"a": 3, "b": 1}, block_rows=1).collect()
    check(out, 400, 1)
    first = Counter(r.source for r in out if r.position < 200)
    assert abs(first["a"] - 150) <= 1


def test_empty_table_and_clashing_columns(docs_of):
    docs = docs_of([(i, "x", f"s{i % 9}") for i in range(200)])
    for c in ("slot", "block", "position", "_n", "name", "_row"):
        docs = docs.withColumn(c, F.lit("mine"))
    out = mix(docs, carry=["slot", "block", "position", "_n", "name", "_row"], block_rows=3)
    rows = out.collect()
    check(rows, 200, 3)
    assert len(set(out.columns)) == len(out.columns)
    assert all(r.slot_of_row == r.block_of_row == r.position_of_row == r._n == r.name == r._row == "mine" for r in rows)
    assert mix(docs_of([])).collect() == []


def test_rows_of_one_place_are_spread(spark, monkeypatch):
    """Most rows without an id: no window holds them all, and the order is whole."""
    monkeypatch.setattr(common, "ROWS_PER_WINDOW", 50)
    docs = spark.range(4000).select(F.when(F.col("id") % 10 == 0, F.col("id")).alias("doc_id"), F.lit("hot").alias("source"))
    check(mix(docs).collect(), 4000, 8)
    far = spark.range(3000).select(F.when(F.col("id") == 0, F.lit(2**62)).otherwise(F.col("id")).alias("place"), F.lit(0).alias("g"))
    got = common.numbered(far, "g", "place", "n").collect()
    assert [r.place for r in sorted(got, key=lambda r: r.n)] == [*range(1, 3000), 2**62] and sorted(r.n for r in got) == list(range(3000))


def test_a_written_plan_places_the_same_rows_again(docs_of):
    docs = docs_of([(i, "x", f"s{i % 5}") for i in range(500)])
    plan = schedule(docs, weights={"s1": 5, "s0": 1})
    want = {r.doc_id: r.position for r in mix(docs, weights={"s1": 5, "s0": 1}).collect()}
    assert {r.doc_id: r.position for r in placed(docs.repartition(3), plan).collect()} == want


def ideal(counts, weights, slots):
    """Blocks of each source that the ideal mixture has served by each slot."""
    left, out, got = dict(enumerate(counts)), [], [Fraction(0)] * len(counts)
    for _ in range(slots):
        room = Fraction(1)
        while room:
            whole = sum(Fraction(weights[i]) for i in left)
            step = min(room, *[(counts[i] - got[i]) * whole / Fraction(weights[i]) for i in left])
            for i in list(left):
                got[i] += step * Fraction(weights[i]) / whole
                if got[i] == counts[i]:
                    del left[i]
            room -= step
        out.append(list(got))
    return out


@pytest.mark.parametrize("weights, blocks", [([0.9996, 0.0004], [4000, 6]), ([1 / 3, 0.1, 7 ** 0.7, 1e-5], [60, 60, 300, 2]), ([2.0, 2.0, 1.0], [10, 10, 5]), ([5], [4])])
def test_unrounded_weights_deviate_less_than_a_block_to_the_end(weights, blocks):
    served, n = [0] * len(blocks), sum(blocks)
    slots = list(windows(blocks, whole_weights(weights)))
    for slot, ((i, j, release, deadline), wanted) in enumerate(zip(slots, ideal(blocks, weights, n), strict=True)):
        assert j == served[i] and release <= slot < deadline
        served[i] += 1
        assert all(abs(a - b) < 1 for a, b in zip(served, wanted))
    assert served == blocks


def test_target_weight_is_the_given_one(docs_of):
    items = [(i, "x", "a" if i % 100 else "b") for i in range(3000)]
    out = mix(docs_of(items), weights={"a": 0.9996, "b": 0.0004}, block_rows=1).collect()
    check(out, 3000, 1)
    assert {r.source: r.target_weight for r in out} == pytest.approx({"a": 0.9996, "b": 0.0004}, rel=1e-12)
    assert sum(r.source == "b" for r in out if r.slot < 2900) <= 2


def test_weights_hold_for_sources_of_few_blocks(docs_of):
    items = [(i, "x", f"s{i % 20}") for i in range(200)]
    out = mix(docs_of(items), weights={f"s{i}": 200 if i == 7 else 1 for i in range(20)}).collect()
    check(out, 200, 8)
    assert sum(r.source == "s7" for r in out if r.position < 24) == 10


def test_each_of_many_sources_keeps_its_own_weight(docs_of):
    weights = {f"host{i}": 1 + i % 7 + (50 if i == 299 else 0) for i in range(300)}
    items = [(i, "x", f"host{i % 300}") for i in range(300 * 12)]
    out = mix(docs_of(items), weights=weights, block_rows=2).collect()
    check(out, 3600, 2)
    whole = sum(weights.values())
    assert {r.source: r.target_weight for r in out} == pytest.approx({s: w / whole for s, w in weights.items()})
    # Until the first source ends, the ideal mixture gives each its weight's share of the slots.
    until = int(6 * whole / max(weights.values()))
    served = Counter(r.source for r in {(r.source, r.block): r for r in out if r.slot < until}.values())
    assert all(abs(served[s] - until * w / whole) < 1 for s, w in weights.items())
