"""Limits in order against a row-by-row run."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from rollcall.operators.limits import enforce_limits

REQUESTS = "tenant_id int, kind string, at int, id int, action string"
LIMITS = "tenant_id int, kind string, limit int, used int"


def one_by_one(rows, limits):
    usage = {(t, k): u or 0 for t, k, _, u in limits}
    cap = {(t, k): n for t, k, n, _ in limits if n is not None and t is not None}
    out = {}
    for t, k, at, i, action in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[3])):
        g = t, k
        if g not in cap:
            out[i] = "accepted" if action == "register" else "freed", None
            continue
        if action == "register":
            ok = usage[g] < cap[g]
            usage[g] += ok
            said = "accepted" if ok else "rejected"
        else:
            said = "freed" if usage[g] else "ignored"
            usage[g] = max(0, usage[g] - 1)
        out[i] = said, min(usage[g], cap[g])
    return out


@pytest.mark.parametrize("seed, pieces, cancels", [(1, 7, .3), (2, 5, .55), (3, 9, .48), (4, 1, .4)])
def test_equals_a_row_by_row_run(spark, seed, pieces, cancels):
    """One group has most requests and continues over most pieces."""
    r = random.Random(seed)
    rows = [(r.choice([1] * 9 + [2, 3, 4, None]), "v", r.choice([r.randrange(500), None]) if r.random() < .02 else r.randrange(500), i, "cancel" if r.random() < cancels else "register")
            for i in range(1500)]
    limits = [(1, "v", 20, 3), (2, "v", 0, 0), (3, "v", 5, 12), (None, "v", 5, 0), (9, "v", 1, 1)]
    want = one_by_one(rows, limits)
    df = spark.createDataFrame(rows, REQUESTS).repartition(4)
    out = enforce_limits(df, spark.createDataFrame(limits, LIMITS), ["tenant_id", "kind"], ["at", "id"], pieces=pieces)
    assert {x.id: (x.decision, x.usage) for x in out.collect()} == want
    assert out.columns == [*df.columns, "decision", "usage"]


def test_usage_far_above_a_limit_that_was_lowered(spark):
    rows = [(1, "v", i, i, "cancel" if i % 2 else "register") for i in range(60)]
    limits = [(1, "v", 4, 20)]
    out = enforce_limits(spark.createDataFrame(rows, REQUESTS), spark.createDataFrame(limits, LIMITS), ["tenant_id", "kind"], ["at", "id"], pieces=6)
    got = {x.id: x.decision for x in out.collect()}
    assert [got[i] for i in range(0, 60, 2)] == ["rejected"] * 17 + ["accepted"] * 13      # after 17 cancellations a place is free


def test_empty_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "v", 1, 1, "register")], REQUESTS)
    limits = spark.createDataFrame([(1, "v", 1, 0)], LIMITS)
    for c in ("decision", "usage", "g", "piece", "step", "cap", "_row"):
        df = df.withColumn(c, F.lit("mine"))
    out = enforce_limits(df, limits, ["tenant_id", "kind"], ["at", "id"]).collect()
    assert [(r.decision, r.usage, r.decision_of_row, r.cap, r._row) for r in out] == [("accepted", 1, "mine", "mine", "mine")]
    assert enforce_limits(df.limit(0), limits, ["tenant_id", "kind"], ["at", "id"]).collect() == []
