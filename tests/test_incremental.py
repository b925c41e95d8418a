"""Incremental tenant analytics against the full report."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from rollcall.operators import incremental
from rollcall.operators.incremental import AnalyticsView, changed_rows, signed
from rollcall.operators.reports import tenant_analytics
from rollcall.sources.io import scratch_path

SCHEMAS = {
    "tenants": "tenant_id int, name string, slug string, is_active boolean, created_at timestamp_ntz",
    "subscriptions": "subscription_id long, tenant_id int, plan_id int, status string",
    "events": "event_id long, tenant_id int",
    "visitors": "visitor_id long, tenant_id int, status string",
    "checkins": "checkin_id long, tenant_id int, visitor_id long",
    "staff": "user_id long, tenant_id int, is_active boolean"}
KEYS = {"tenants": "tenant_id", "subscriptions": "subscription_id", "events": "event_id", "visitors": "visitor_id", "checkins": "checkin_id", "staff": "user_id"}


def tables(r):
    """One random state of all tables."""
    t = [(i, f"T{i}" if r.random() < .9 else None, f"t{i}", r.random() < .8, None) for i in range(8) if r.random() < .85]
    pick = lambda: r.choice([0, 0, 0, 0, 1, 2, 3, 4, 5, 6, 7, None])
    some = lambda n: [i for i in range(n) if r.random() < .8]
    v = [(i, pick(), r.choice(["registered", "checked_in", "confirmed"])) for i in some(120)]
    return {"tenants": t, "subscriptions": [(i, pick(), r.randrange(1, 5), r.choice(["active", "active", "expired"])) for i in some(14)],
            "events": [(i, pick()) for i in some(30)], "visitors": v, "checkins": [(i, x[1], x[0]) for i in some(200) for x in [r.choice(v)]],
            "staff": [(i, pick(), r.random() < .7) for i in some(20)]}


def frames(spark, state):
    return {k: spark.createDataFrame(rows, SCHEMAS[k]) for k, rows in state.items()}


def full(dom, f):
    return sorted(map(str, tenant_analytics(f["tenants"], f["subscriptions"], dom.plans, f["events"], f["visitors"],
                                            f["checkins"].select("visitor_id"), f["staff"]).collect()))


def shown(view):
    order = ["tenant_id", "tenant_name", "tenant_slug", "plan_name", "tenant_created_at", "total_events", "total_visitors", "total_checkins", "total_users",
             "registered_visitors", "checked_in_visitors", "checkin_percentage"]
    return sorted(map(str, view.read().select(*order).collect()))


@pytest.mark.parametrize("seed, compact", [(1, 16), (2, 2)])
def test_equals_the_full_report_after_every_refresh(spark, dom, monkeypatch, seed, compact):
    monkeypatch.setattr(incremental, "COMPACT", compact)
    r = random.Random(seed)
    view = AnalyticsView(spark, scratch_path(spark, "analytics"))
    old = frames(spark, {k: [] for k in SCHEMAS})
    for n in range(4):
        new = frames(spark, tables(r))
        view.refresh({k: changed_rows(old[k], new[k], KEYS[k]) for k in SCHEMAS}, dom.plans)
        assert shown(view) == full(dom, new)
        assert view.version()[0] == n + 1 and (n + 1 - view.version()[1] < compact)
        old = new


def test_publishes_only_tenants_whose_report_changes(spark, dom):
    view = AnalyticsView(spark, scratch_path(spark, "analytics"))
    state = frames(spark, tables(random.Random(3)))
    view.refresh({k: signed(f, 1) for k, f in state.items()}, dom.plans)
    active = [x.tenant_id for x in state["tenants"].where("is_active").collect()]
    more = spark.createDataFrame([(900, active[0], "registered")], SCHEMAS["visitors"])
    view.refresh({"visitors": signed(more, 1)}, dom.plans)
    path = f"{view.root}/view/version=2"
    assert [x.tenant_id for x in spark.read.schema(incremental.VIEW).parquet(path).collect()] == [active[0]]
    assert spark.read.schema(incremental.CELLS).parquet(f"{view.root}/cells/version=2").count() == 2
    # Rows that cancel out publish nothing.
    view.refresh({"visitors": signed(more, 1).unionByName(signed(more, -1))}, dom.plans)
    assert spark.read.schema(incremental.VIEW).parquet(f"{view.root}/view/version=3").count() == 0


def test_a_refresh_that_failed_leaves_the_old_version(spark, dom):
    view = AnalyticsView(spark, scratch_path(spark, "analytics"))
    state = frames(spark, tables(random.Random(4)))
    view.refresh({k: signed(f, 1) for k, f in state.items()}, dom.plans)
    want = shown(view)
    half = spark.createDataFrame([("visitors", 1, None, 99)], incremental.CELLS)
    view._write(half, "cells", 2)      # its pointer was never written
    assert shown(view) == want
    view.refresh({}, dom.plans)
    assert shown(view) == want and view.version()[0] == 2


def test_reads_changed_rows_alone(spark, dom):
    """The plan of the new counts scans the changes and the view's own files."""
    cells = incremental._cells({"visitors": signed(dom.visitors.where("visitor_id = 5"), 1)}, dom.plans)
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderkey,5)" in plan and "lineitem" not in plan


def test_changed_rows_are_signed(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (4, None)], "k int, v string")
    got = sorted(map(tuple, changed_rows(a, b, "k").collect()), key=str)
    assert got == sorted([(2, None, -1), (2, "y", 1), (3, "z", -1), (4, None, 1)], key=str)
    assert changed_rows(a, a, "k").where(F.lit(True)).count() == 0
