"""SQL functions: results beside the operators, and plans without per-row work."""

from __future__ import annotations

import re

import pytest

from conftest import rows
from rollcall.functions import contacts
from rollcall.operators import billing
from rollcall.plans import sql_functions


@pytest.fixture(scope="module")
def fns(spark, dom):
    return sql_functions.register_functions(dom, "2024-03-01 00:00:00")


def test_one_tenant_by_name(spark, dom, fns):
    want = billing.subscription_with_last_payment(dom.subscriptions, dom.plans, dom.payments).where("tenant_id = 3")
    got = spark.sql("SELECT 3 AS tenant_id, s.* FROM subscription_of(3) s")
    assert rows(got, *want.columns) == rows(want)
    assert spark.sql("SELECT * FROM subscription_of(-1)").count() == 0
    assert spark.sql("SELECT within_limit(-1, 'events') AS a, within_limit(NULL, 'events') AS b, within_limit(3, 'nothing') AS c").first()[:] == (False, False, False)


@pytest.mark.parametrize("text, table", [
    ("SELECT t.tenant_id, s.plan_name FROM tenants t, LATERAL subscription_of(t.tenant_id) s", "supplier"),
    ("SELECT tenant_id, within_limit(tenant_id, 'users') AS ok FROM staff", "customer")])
def test_calls_are_planned_as_joins(spark, fns, text, table):
    plan = spark.sql(text)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "LateralJoin" not in plan and "scalar-subquery" not in plan and "lateral-subquery" not in plan
    physical = spark.sql(text)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in physical and "Cartesian" not in physical


def test_scalar_functions(spark, fns):
    df = spark.createDataFrame([("0812-34 56",), ("+62 811",), (None,), ("abc",)], "p string").createOrReplaceTempView("phones")
    got = spark.sql("SELECT p, clean_phone(p) AS c FROM phones")
    want = got.select("p", contacts.phone_clean("p").alias("c"))
    assert rows(got.select("p", "c")) == rows(want)
    assert spark.sql("SELECT next_code('VIP', 2024, 7) AS a, next_code('SPK', 1999, 12345) AS b").first()[:] == ("VIP240007", "SPK9912345")
    assert re.fullmatch(r"[a-z_]+", "".join(fns))
