"""The domain views as DuckDB SQL, for the oracle twins of the registered
queries. Written independently of the Spark views in ``sources/views.py``;
both follow the mapping in FIXTURES.md and must agree value for value."""

from __future__ import annotations

import re

from ..sources import seeds
from ..sources.views import (EMAIL_SHAPE, FIRST_NAMES, HOST_RE, OCCASION_EPOCH,
                             PATH_RE, PHONE_SHAPE, SUBSCRIPTION_EPOCH, TENANT_EPOCH)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _plans_values() -> str:
    rows = []
    for (pid, name, slug, price, cur, cycle, me, mv, mu, feats, active, order) in seeds.PLAN_ROWS:
        flist = "[" + ", ".join(_q(f) for f in feats) + "]"
        rows.append(f"({pid}, {_q(name)}, {_q(slug)}, CAST({price} AS DECIMAL(10,2)), {_q(cur)}, "
                    f"{_q(cycle)}, {me}, {mv}, {mu}, {flist}, {str(active).upper()}, {order})")
    return ("SELECT * FROM (VALUES " + ", ".join(rows) + ") AS p(plan_id, name, slug, price, "
            "currency, billing_cycle, max_events, max_visitors_per_event, max_admin_users, "
            "features, is_active, sort_order)")


def _categories_values() -> str:
    rows = [f"({cid}, {_q(name)}, {_q(code)}, {_q(color)}, {prio}, {str(a).upper()}, "
            f"{str(d).upper()})" for cid, name, code, color, prio, a, d in seeds.CATEGORY_ROWS]
    return ("SELECT * FROM (VALUES " + ", ".join(rows) + ") AS c(category_id, name, code, color, "
            "priority, is_active, is_default)")


def _code_case(expr: str) -> str:
    whens = " ".join(f"WHEN {cid} THEN {_q(code)}" for cid, _n, code, *_ in seeds.CATEGORY_ROWS)
    return f"CASE {expr} {whens} END"


_NAMES = "[" + ", ".join(_q(n) for n in FIRST_NAMES) + "]"

VIEWS: dict[str, str] = {
    "plans": _plans_values(),
    "categories": _categories_values(),
    "tenants": f"""
        SELECT n_nationkey AS tenant_id, n_name AS name,
               lower(replace(n_name, '_', '-')) AS slug,
               lower(replace(n_name, '_', '-')) AS subdomain,
               CAST(NULL AS VARCHAR) AS custom_domain,
               (n_nationkey % 8) <> 7 AS is_active,
               TIMESTAMP '{TENANT_EPOCH}' + to_days(CAST(n_nationkey AS INTEGER)) AS created_at
        FROM nation""",
    "subscriptions": f"""
        SELECT s_suppkey AS subscription_id, s_nationkey AS tenant_id,
               CAST(s_suppkey % 4 + 1 AS INTEGER) AS plan_id,
               CASE WHEN s_suppkey % 5 = 0 THEN 'expired' WHEN s_suppkey % 5 = 1 THEN 'cancelled'
                    ELSE 'active' END AS status,
               TIMESTAMP '{SUBSCRIPTION_EPOCH}' + to_days(CAST(s_suppkey AS INTEGER)) AS starts_at,
               CASE WHEN s_suppkey % 3 = 0 THEN CAST(NULL AS TIMESTAMP)
                    ELSE TIMESTAMP '{SUBSCRIPTION_EPOCH}' + to_days(CAST(s_suppkey AS INTEGER) + 30)
               END AS ends_at,
               TIMESTAMP '{SUBSCRIPTION_EPOCH}' + to_days(CAST(s_suppkey AS INTEGER)) AS created_at,
               'billing' || CAST(s_suppkey AS VARCHAR) || '@example.com' AS billing_email
        FROM supplier""",
    "staff": """
        SELECT s_suppkey AS user_id, s_nationkey AS tenant_id, s_name AS first_name,
               'staff' || CAST(s_suppkey AS VARCHAR) || '@example.com' AS email,
               CASE s_suppkey % 5 WHEN 0 THEN 'owner' WHEN 1 THEN 'admin' WHEN 2 THEN 'manager'
                    WHEN 3 THEN 'staff' ELSE 'viewer' END AS role,
               s_acctbal > 0 AS is_active,
               CAST(s_suppkey % 17 AS INTEGER) AS login_count,
               CAST(0 AS INTEGER) AS failed_login_attempts
        FROM supplier""",
    "occasions": f"""
        SELECT c_custkey AS event_id, c_nationkey AS tenant_id, c_name AS event_name,
               lower(replace(c_name, '#', '-')) AS slug,
               DATE '{OCCASION_EPOCH}' + CAST(c_custkey % 366 AS INTEGER) AS event_date,
               '09:00:00' AS start_time,
               CASE WHEN c_custkey % 50 = 0 THEN '08:30:00' ELSE '17:00:00' END AS end_time,
               CAST((c_custkey % 20) * 50 + 50 AS INTEGER) AS max_capacity,
               CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'draft' WHEN 'BUILDING' THEN 'published'
                    WHEN 'FURNITURE' THEN 'active' WHEN 'HOUSEHOLD' THEN 'completed'
                    ELSE 'cancelled' END AS status
        FROM customer""",
    "visitors": f"""
        SELECT o_orderkey AS visitor_id, c_nationkey AS tenant_id, o_custkey AS event_id,
               {_code_case("CAST(substr(o_orderpriority, 1, 1) AS INTEGER)")}
                 || strftime(o_orderdate, '%y')
                 || lpad(CAST(o_orderkey AS VARCHAR), CAST(greatest(4, length(CAST(o_orderkey AS VARCHAR))) AS INTEGER), '0')
                 AS registration_code,
               {_NAMES}[o_orderkey % 4 + 1] AS first_name,
               'Tamu' || CAST(o_orderkey % 1000 AS VARCHAR) AS last_name,
               'u' || CAST(o_orderkey % 7000 AS VARCHAR) || '@example.com' AS email,
               CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS category_id,
               CASE o_orderstatus WHEN 'F' THEN 'checked_in' WHEN 'P' THEN 'confirmed'
                    ELSE 'registered' END AS status,
               o_orderdate AS registered_at
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "checkins": """
        SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-'
                 || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) || '-'
                 || CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR) AS checkin_id,
               l_orderkey AS visitor_id, l_shipdate AS checkin_time,
               CAST(l_linenumber AS VARCHAR) AS gate_number, l_suppkey AS checked_in_by,
               l_linestatus = 'F' AS is_stored
        FROM lineitem""",
    "payments": """
        SELECT 'SUB-' || CAST(c_nationkey AS VARCHAR) || '-' || CAST(o_orderkey AS VARCHAR) AS order_id,
               c_nationkey AS tenant_id, CAST(o_orderkey % 4 + 1 AS INTEGER) AS plan_id,
               o_totalprice AS amount, 'IDR' AS currency,
               CASE WHEN o_orderkey % 2 = 0 THEN 'midtrans' ELSE 'xendit' END AS provider,
               CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status,
               CASE WHEN o_orderkey % 3 = 0 THEN 'yearly' ELSE 'monthly' END AS billing_period,
               '{"email":"u' || CAST(o_orderkey % 7000 AS VARCHAR) || '@example.com","firstName":"Budi"}'
                 AS customer_data,
               o_orderdate AS created_at,
               o_orderdate + INTERVAL 24 HOUR AS expires_at
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "webhooks": """
        SELECT o_orderkey AS notice_id,
               CASE WHEN o_orderkey % 2 = 0 THEN 'midtrans' ELSE 'xendit' END AS provider,
               o_orderdate + to_hours(CAST(o_orderkey % 48 AS INTEGER)) AS received_at,
               CASE WHEN o_orderkey % 2 = 0 THEN json_object(
                   'order_id', 'SUB-' || CAST(c_nationkey AS VARCHAR) || '-' || CAST(o_orderkey AS VARCHAR),
                   'transaction_status', CASE o_orderstatus
                        WHEN 'F' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'capture' ELSE 'settlement' END
                        WHEN 'O' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'capture' ELSE 'pending' END
                        ELSE CASE o_orderkey % 3 WHEN 0 THEN 'capture' WHEN 1 THEN 'deny' ELSE 'expire' END END,
                   'fraud_status', CASE WHEN o_orderkey % 3 = 0 THEN
                        CASE o_orderstatus WHEN 'F' THEN 'accept' WHEN 'O' THEN 'review' ELSE 'challenge' END END,
                   'gross_amount', CAST(o_totalprice AS VARCHAR),
                   'custom_field1', CAST(c_nationkey AS VARCHAR),
                   'custom_field2', CAST(o_orderkey % 4 + 1 AS VARCHAR),
                   'custom_field3', CASE WHEN o_orderkey % 3 = 0 THEN 'yearly' ELSE 'monthly' END)::VARCHAR
               ELSE json_object(
                   'external_id', 'SUB-' || CAST(c_nationkey AS VARCHAR) || '-' || CAST(o_orderkey AS VARCHAR),
                   'status', CASE o_orderstatus WHEN 'F' THEN 'PAID' WHEN 'O' THEN 'PENDING'
                        ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'EXPIRED' ELSE 'FAILED' END END,
                   'amount', o_totalprice,
                   'metadata', json_object('tenant_id', CAST(c_nationkey AS VARCHAR),
                                           'plan_id', CAST(o_orderkey % 4 + 1 AS VARCHAR),
                                           'billing_period', CASE WHEN o_orderkey % 3 = 0 THEN 'yearly' ELSE 'monthly' END),
                   'id', 'inv-' || CAST(o_orderkey AS VARCHAR))::VARCHAR
               END AS body
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "request_log": """
        SELECT event_id AS request_id, ts, user_id AS client,
               CAST(user_id % 25 AS INTEGER) AS tenant_id,
               CASE event_type WHEN 'click' THEN 'auth' WHEN 'signup' THEN 'register'
                    ELSE 'other' END AS route,
               CASE event_type WHEN 'click' THEN '/api/auth/login' WHEN 'signup' THEN '/api/register'
                    ELSE '/api/' || event_type END AS path,
               CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
               value AS duration_ms
        FROM events""",
    "scans": """
        SELECT event_id AS scan_id, ts, user_id AS scanner,
               CAST(user_id % 25 AS INTEGER) AS tenant_id, event_type <> 'error' AS ok
        FROM events""",
    "contacts": f"""
        SELECT doc_id, CAST(i - 1 AS INTEGER) AS nth, es[i] AS email, ps[i] AS phone
        FROM (SELECT doc_id, es, ps, unnest(range(1, greatest(len(es), len(ps), 1) + 1)) AS i
              FROM (SELECT doc_id, coalesce(regexp_extract_all(text, {_q(EMAIL_SHAPE)}), []) AS es,
                           coalesce(regexp_extract_all(text, {_q(PHONE_SHAPE)}), []) AS ps
                    FROM documents))""",
    "requests": f"""
        SELECT page_id AS request_id, url,
               lower(regexp_extract(url, {_q(HOST_RE)}, 1)) AS host,
               regexp_extract(url, {_q(PATH_RE)}, 1) AS path,
               CASE WHEN page_id % 11 = 0 THEN CAST(page_id % 30 AS INTEGER) END AS header_tenant_id
        FROM pages""",
    "sites": """
        SELECT CAST(first_page + 1000 AS INTEGER) AS tenant_id, brand AS name, brand AS slug,
               brand AS subdomain, custom_domain, (first_page % 8) <> 7 AS is_active
        FROM (SELECT string_split(host, '.')[-3] AS brand, min(request_id) AS first_page,
                     max(CASE WHEN len(string_split(host, '.')) >= 4 THEN host END) AS custom_domain
              FROM requests WHERE len(string_split(host, '.')) >= 3
              GROUP BY 1)""",
}

# Views that other views read.
DEPENDS = {"sites": ["requests"]}


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the CTEs of the domain views it names."""
    needed: list[str] = []

    def add(name: str):
        for dep in DEPENDS.get(name, []):
            add(dep)
        if name not in needed:
            needed.append(name)

    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql):
            add(name)
    if not needed:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in needed)
    body = sql.lstrip()
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:]}"
    return f"WITH {ctes}\n{body}"
