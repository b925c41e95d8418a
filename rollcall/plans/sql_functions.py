"""The reference's stored functions as Spark SQL functions, callable per row of
any query:

    SELECT t.tenant_id, s.* FROM tenants t, LATERAL subscription_of(t.tenant_id) s
    SELECT tenant_id, within_limit(tenant_id, 'events') FROM tenants

Their bodies are SQL over the report views, so Spark takes the correlation out
of them and plans a call as a join with the view: however many rows call a
function, the view is computed once."""

from __future__ import annotations

from ..sources.views import Domain
from .sql_views import register_report_views

# Names and result columns of the functions.
FUNCTIONS = {
    "subscription_of": """
        (of_tenant INT) RETURNS TABLE (subscription_id BIGINT, plan_name STRING, plan_slug STRING, plan_price DOUBLE, status STRING,
            starts_at TIMESTAMP_NTZ, ends_at TIMESTAMP_NTZ, last_payment_date TIMESTAMP_NTZ, last_payment_amount DOUBLE,
            last_payment_provider STRING, next_billing_date TIMESTAMP_NTZ)
        COMMENT 'Newest active subscription of a tenant with its last successful payment; no row without one'
        RETURN SELECT subscription_id, plan_name, plan_slug, plan_price, status, starts_at, ends_at, last_payment_date, last_payment_amount,
                      last_payment_provider, next_billing_date
               FROM tenant_subscription WHERE tenant_id = of_tenant""",
    "usage_of": """
        (of_tenant INT) RETURNS TABLE (limit_type STRING, usage BIGINT, limit_value BIGINT, allowed BOOLEAN)
        COMMENT 'Usage of a tenant against the limits of its plan, a row per limit'
        RETURN SELECT limit_type, usage, limit_value, allowed FROM tenant_limits WHERE tenant_id = of_tenant""",
    "within_limit": """
        (of_tenant INT, kind STRING) RETURNS BOOLEAN
        COMMENT 'Whether a tenant may add one more; false without a plan or for an unknown kind'
        RETURN coalesce((SELECT bool_or(allowed) FROM tenant_limits WHERE tenant_id = of_tenant AND limit_type = kind), false)""",
    "clean_phone": r"""
        (phone STRING) RETURNS STRING
        COMMENT 'Digits and plus signs alone, a leading 08 as +628'
        RETURN regexp_replace(regexp_replace(phone, r'[^0-9+]', ''), r'^08', '+628')""",
    "next_code": """
        (category_code STRING, for_year INT, n BIGINT) RETURNS STRING
        COMMENT 'Registration code of the n-th visitor of a category: code, two digits of the year, at least four of the number'
        RETURN concat(category_code, lpad(cast(for_year % 100 AS STRING), 2, '0'), lpad(cast(n AS STRING), greatest(4, length(cast(n AS STRING))), '0'))""",
}


def register_functions(dom: Domain, as_of: str | None = None) -> list[str]:
    """Registers the report views and, over them, the functions as temporary
    functions of the session."""
    register_report_views(dom, as_of)
    for name, body in FUNCTIONS.items():
        dom.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return list(FUNCTIONS)
