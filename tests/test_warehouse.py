"""Bucketed materialisation: same answers, and the visitor/check-in join
reads co-located buckets without a shuffle."""

from __future__ import annotations

from conftest import rows
from rollcall.operators import reports
from rollcall.sources.io import scratch_path
from rollcall.sources.warehouse import materialize


def test_bucketed_domain_same_results_no_exchange(spark, dom):
    wh = materialize(dom, scratch_path(spark, "warehouse"), database="rollcall_test", buckets=4)
    a = reports.dashboard_stats(dom.occasions, dom.visitors, dom.categories, dom.checkins)
    b = reports.dashboard_stats(wh.occasions, wh.visitors, wh.categories, wh.checkins)
    assert rows(a) == rows(b)
    # visitors LEFT JOIN (check-ins counted per visitor): both sides bucketed
    # on visitor_id, so neither the aggregate nor the join needs an exchange.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        per_visitor = wh.checkins.groupBy("visitor_id").count()
        joined = wh.visitors.join(per_visitor, "visitor_id", "left")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan
        raw = dom.visitors.join(dom.checkins.groupBy("visitor_id").count(), "visitor_id", "left")
        assert "Exchange hashpartitioning" in raw._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
    s1 = reports.visitor_summary(dom.visitors, dom.categories, dom.occasions, dom.checkins)
    s2 = reports.visitor_summary(wh.visitors, wh.categories, wh.occasions, wh.checkins)
    assert s1.count() == s2.count()
