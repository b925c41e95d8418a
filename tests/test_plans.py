"""Physical plans: four-row dimensions never make the large side move."""

from __future__ import annotations

import re

import pytest

from conftest import SMALL, rows
from tools.plan_audit import dimension_exchanges, initial_plan
import __spark_entry__ as E

# Every query that joins the category or plan dimension without running a stream or a sink.
NAMES = ["search_visitors", "visitor_summary", "attendance_status", "visitors_with_category", "recent_checkins", "dashboard_stats",
         "event_stats", "tenant_analytics", "category_counts", "active_categories", "latest_subscription",
         "subscription_with_last_payment", "plan_usage", "payment_quote", "payment_quote_repriced", "ticket_checksum", "ticket_verify", "assign_codes", "assign_codes_single"]


@pytest.mark.parametrize("name", NAMES)
def test_no_exchange_on_a_dimension_key(spark, name):
    assert dimension_exchanges(initial_plan(E.QUERIES[name](spark, SMALL))) == []


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["active_categories", "validate_categories"])
def test_categories_in_use_meet_distinct_values_not_visitors(spark, name):
    assert re.search(r"Join LeftSemi.*\n *:- .*\n *\+- Aggregate \[category_id", optimized(E.QUERIES[name](spark, SMALL)))


def test_categories_in_use_with_repeats_nulls_and_unknown(spark, dom):
    from rollcall.operators import reports
    v = spark.createDataFrame([(1, 4), (2, 4), (3, None), (4, 9), (5, 1)], "visitor_id long, category_id int")
    assert rows(reports.used_categories(dom.categories, v), "category_id", "code") == [(1, "VIP"), (4, "PTC")]


@pytest.mark.parametrize("wanted", ["payment_status = 'success'", "payment_status IN ('failed', 'expired')", "amount > 5 AND plan_id = 2"])
def test_a_notice_is_parsed_once_under_any_filter(dom, wanted):
    from rollcall.operators import billing
    assert optimized(billing.map_payment_status(dom.webhooks).where(wanted)).count("from_json") == 1


def test_settled_notices_are_parsed_once(dom):
    from rollcall.operators import billing
    from rollcall.streaming.live import _settled
    assert optimized(_settled(billing.map_payment_status(dom.webhooks))).count("from_json") == 1
