"""DuckDB twins of the registered queries (same names, same column names).

Each is plain SQL over the driver tables; domain views are prefixed as CTEs
by ``with_views``. Each is written from the stated rule of its operator, in a
form of its own, so the two are independent computations of the same answer.
"""

from __future__ import annotations

from ..sources import seeds
from .oracle_views import with_views

_RAW: dict[str, str] = {}


def sql(name: str, text: str):
    _RAW[name] = text


sql("load_views", " UNION ALL ".join(
    f"SELECT '{v}' AS view, count(*) AS row_count FROM {v}" for v in (
        "tenants", "plans", "subscriptions", "staff", "occasions", "categories", "visitors",
        "checkins", "payments", "webhooks", "request_log", "scans", "contacts", "requests", "sites")))

sql("tenant_lookup", "SELECT * FROM visitors WHERE tenant_id = 3 AND status = 'confirmed'")

sql("published_events", """
    SELECT * FROM occasions WHERE status IN ('published', 'active')
    ORDER BY event_date ASC, event_id""")

sql("search_visitors", """
    WITH hits AS (
      SELECT *, row_number() OVER (ORDER BY registered_at DESC NULLS FIRST, visitor_id) AS place
      FROM visitors
      WHERE len(list_filter([first_name, last_name, email, registration_code], lambda x: contains(lower(x), 'agus'))) > 0)
    SELECT visitor_id, tenant_id, event_id, registration_code, first_name, last_name, email, status, registered_at,
           (SELECT k.name FROM categories k WHERE k.category_id = hits.category_id) AS category_name,
           (SELECT k.code FROM categories k WHERE k.category_id = hits.category_id) AS category_code
    FROM hits WHERE place <= 50""")

sql("search_visitors_indexed", """
    SELECT visitor_id, tenant_id, event_id, registration_code, first_name, last_name, email, status, registered_at,
           k.name AS category_name, k.code AS category_code
    FROM visitors LEFT JOIN categories k USING (category_id)
    WHERE concat_ws(chr(10), first_name, last_name, email, registration_code) ILIKE '%tamu77%'
    ORDER BY registered_at DESC NULLS FIRST, visitor_id LIMIT 200""")

sql("search_index_counts", """
    WITH fields AS (
      SELECT visitor_id, lower(unnest([first_name, last_name, email, registration_code])) AS f FROM visitors)
    SELECT trigram, count(DISTINCT visitor_id) AS visitors
    FROM (SELECT visitor_id, substr(f, unnest(range(1, len(f) - 1)), 3) AS trigram FROM fields)
    GROUP BY trigram""")

# One row per scan, and one for each visitor without a scan; 'present' needs a scan time.
_SUMMARY = """
    SELECT p.visitor_id, p.registration_code, p.first_name, p.last_name, p.email,
           k.name AS category_name, k.code AS category_code, k.color AS category_color,
           o.event_name, o.event_date, p.status, p.registered_at, p.checkin_id, p.checkin_time, p.checked_in_by,
           CASE WHEN p.checkin_time IS NULL
                THEN coalesce(MAP {'confirmed': 'Terkonfirmasi', 'registered': 'Terdaftar', 'cancelled': 'Dibatalkan'}[p.status],
                              'Tidak Hadir')
                ELSE 'Hadir' END AS attendance_status
    FROM (SELECT visitors.*, s.checkin_id, s.checkin_time, s.checked_in_by
          FROM checkins s JOIN visitors USING (visitor_id)
          UNION ALL
          SELECT visitors.*, NULL, NULL, NULL FROM visitors ANTI JOIN checkins USING (visitor_id)) p
    LEFT JOIN (SELECT category_id AS cid, name, code, color FROM categories) k ON k.cid = p.category_id
    LEFT JOIN (SELECT event_id AS oid, event_name, event_date FROM occasions) o ON o.oid = p.event_id"""

sql("visitor_summary", _SUMMARY)

sql("attendance_status", f"""
    SELECT attendance_status, count(*) AS rows FROM ({_SUMMARY}) s GROUP BY attendance_status""")

sql("visitors_with_category", """
    WITH chosen AS (
      SELECT visitor_id, tenant_id, event_id, registration_code, status, registered_at, category_id
      FROM visitors WHERE status = 'confirmed'
      ORDER BY registered_at DESC NULLS FIRST, visitor_id LIMIT 100),
    with_scans AS (
      SELECT chosen.*, s.checkin_id, s.checkin_time,
             row_number() OVER (ORDER BY registered_at DESC NULLS FIRST, visitor_id, s.checkin_id NULLS FIRST) AS place
      FROM chosen LEFT JOIN checkins s USING (visitor_id))
    SELECT w.visitor_id, w.tenant_id, w.event_id, w.registration_code, w.status, w.registered_at,
           k.name AS category_name, k.code AS category_code, w.checkin_id, w.checkin_time
    FROM with_scans w LEFT JOIN categories k ON k.category_id = w.category_id
    WHERE w.place <= 100""")

sql("recent_checkins", """
    WITH last_ten AS (
      SELECT * FROM checkins SEMI JOIN visitors USING (visitor_id)
      ORDER BY checkin_time DESC NULLS FIRST, checkin_id LIMIT 10)
    SELECT t.checkin_id, t.visitor_id, t.checkin_time, p.first_name, p.last_name, p.registration_code,
           (SELECT k.name FROM categories k WHERE k.category_id = p.category_id) AS category_name,
           (SELECT w.first_name FROM staff w WHERE w.user_id = t.checked_in_by) AS checked_in_by_name
    FROM last_ten t, visitors p WHERE p.visitor_id = t.visitor_id""")

sql("count_by_tenant", "SELECT tenant_id, count(*) AS count FROM visitors GROUP BY tenant_id")

# A visitor weighs as many rows as scans, one at least.
sql("dashboard_stats", """
    WITH n AS (SELECT visitor_id, count(*) AS scans FROM checkins GROUP BY visitor_id),
    w AS (SELECT event_id, status, k.code, coalesce(scans, 0) AS scans, greatest(coalesce(scans, 0), 1) AS weight
          FROM visitors LEFT JOIN n USING (visitor_id) LEFT JOIN categories k USING (category_id)),
    by_status AS (PIVOT (SELECT event_id, status, weight FROM w) ON status IN ('registered', 'confirmed')
                  USING sum(weight) GROUP BY event_id),
    by_code AS (PIVOT (SELECT event_id, code, weight FROM w) ON code IN ('VIP', 'SPR', 'SPK', 'PTC')
                USING sum(weight) GROUP BY event_id),
    totals AS (SELECT event_id, sum(weight) AS rows_, sum(scans) AS scans FROM w GROUP BY event_id)
    SELECT o.event_id, o.event_name,
           CAST(coalesce(rows_, 0) AS BIGINT) AS total_registered, CAST(coalesce(registered, 0) AS BIGINT) AS total_pending,
           CAST(coalesce(confirmed, 0) AS BIGINT) AS total_confirmed, CAST(coalesce(scans, 0) AS BIGINT) AS total_checkedin,
           CAST(coalesce(VIP, 0) AS BIGINT) AS total_vip, CAST(coalesce(SPR, 0) AS BIGINT) AS total_sponsor,
           CAST(coalesce(SPK, 0) AS BIGINT) AS total_speaker, CAST(coalesce(PTC, 0) AS BIGINT) AS total_participant
    FROM occasions o LEFT JOIN totals USING (event_id) LEFT JOIN by_status USING (event_id) LEFT JOIN by_code USING (event_id)""")

_EVENT_STATS = """
    WITH cells AS (SELECT event_id, tenant_id, status, k.code, count(*) AS n
                   FROM visitors LEFT JOIN categories k USING (category_id) GROUP BY ALL),
    found AS (
      SELECT event_id, tenant_id, sum(n) AS people, sum(n * (status = 'registered')::INT) AS waiting,
             sum(n * (status = 'checked_in')::INT) AS arrived, sum(n * (code IS NOT DISTINCT FROM 'VIP')::INT) AS vip,
             sum(n * (code IS NOT DISTINCT FROM 'SPR')::INT) AS spr, sum(n * (code IS NOT DISTINCT FROM 'SPK')::INT) AS spk,
             sum(n * (code IS NOT DISTINCT FROM 'PTC')::INT) AS ptc
      FROM cells GROUP BY event_id, tenant_id)
    SELECT event_id, tenant_id, CAST(coalesce(people, 0) AS BIGINT) AS total_visitors,
           CAST(coalesce(waiting, 0) AS BIGINT) AS registered_count, CAST(coalesce(arrived, 0) AS BIGINT) AS checked_in_count,
           CAST(coalesce(vip, 0) AS BIGINT) AS vip_count, CAST(coalesce(spr, 0) AS BIGINT) AS sponsor_count,
           CAST(coalesce(spk, 0) AS BIGINT) AS speaker_count, CAST(coalesce(ptc, 0) AS BIGINT) AS participant_count
    FROM occasions LEFT JOIN found USING (event_id, tenant_id)"""

sql("event_stats", _EVENT_STATS)

# The literal many-branch COUNT(DISTINCT) would build billions of rows here,
# so the twin counts each branch with correlated scalar subqueries instead.
sql("tenant_analytics", """
    SELECT t.tenant_id, t.name AS tenant_name, t.slug AS tenant_slug, sp.name AS plan_name,
           t.created_at AS tenant_created_at,
           (SELECT count(DISTINCT e.event_id) FROM occasions e WHERE e.tenant_id = t.tenant_id) AS total_events,
           (SELECT count(DISTINCT v.visitor_id) FROM visitors v WHERE v.tenant_id = t.tenant_id) AS total_visitors,
           (SELECT count(DISTINCT c.checkin_id) FROM checkins c JOIN visitors v ON c.visitor_id = v.visitor_id
             WHERE v.tenant_id = t.tenant_id) AS total_checkins,
           (SELECT count(DISTINCT tu.user_id) FROM staff tu WHERE tu.tenant_id = t.tenant_id AND tu.is_active) AS total_users,
           (SELECT count(DISTINCT v.visitor_id) FILTER (WHERE v.status = 'registered') FROM visitors v
             WHERE v.tenant_id = t.tenant_id) AS registered_visitors,
           (SELECT count(DISTINCT v.visitor_id) FILTER (WHERE v.status = 'checked_in') FROM visitors v
             WHERE v.tenant_id = t.tenant_id) AS checked_in_visitors,
           (SELECT CASE WHEN count(*) = 0 THEN NULL
                        ELSE CAST((count(*) FILTER (WHERE v.status = 'checked_in') * 20000 + count(*))
                                  // (2 * count(*)) AS DOUBLE) / 100 END
              FROM visitors v WHERE v.tenant_id = t.tenant_id)
             AS checkin_percentage
    FROM tenants t
    LEFT JOIN (SELECT DISTINCT ts.tenant_id, p.name FROM subscriptions ts
               JOIN plans p ON ts.plan_id = p.plan_id WHERE ts.status = 'active') sp
      ON sp.tenant_id = t.tenant_id
    WHERE t.is_active""")

# Row after row of each tenant, as the limit check meets them.
sql("enforce_visitor_limits", """
    SELECT tenant_id, visitor_id, "at", action, decision, "usage" FROM (
    WITH RECURSIVE asked AS (
      SELECT tenant_id, visitor_id, registered_at AS "at", 'register' AS action FROM visitors
      UNION ALL SELECT tenant_id, visitor_id, registered_at + INTERVAL 90 DAY, 'cancel' FROM visitors WHERE visitor_id % 4 = 0),
    steps AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY "at", visitor_id, action) AS i FROM asked),
    plan AS (
      SELECT s.tenant_id, p.max_visitors_per_event AS cap, s.tenant_id % 3 * 150 AS used
      FROM (SELECT tenant_id, arg_max(plan_id, (created_at, subscription_id)) AS plan_id
            FROM subscriptions WHERE status = 'active' GROUP BY tenant_id) s JOIN plans p USING (plan_id)),
    walk AS (
      SELECT tenant_id, CAST(0 AS BIGINT) AS i, cap, CAST(used AS BIGINT) AS u, '' AS decision FROM plan
      UNION ALL
      SELECT walk.tenant_id, r.i, cap,
             CASE WHEN action = 'cancel' THEN greatest(u - 1, 0) WHEN u < cap THEN u + 1 ELSE u END,
             CASE WHEN action = 'cancel' THEN CASE WHEN u > 0 THEN 'freed' ELSE 'ignored' END
                  WHEN u < cap THEN 'accepted' ELSE 'rejected' END
      FROM walk JOIN steps r ON r.tenant_id = walk.tenant_id AND r.i = walk.i + 1)
    SELECT r.*, coalesce(walk.decision, CASE WHEN action = 'cancel' THEN 'freed' ELSE 'accepted' END) AS decision,
           CAST(least(u, cap) AS BIGINT) AS "usage"
    FROM steps r LEFT JOIN walk USING (tenant_id, i)) found""")

# Changes applied one after another must end where a full count does.
sql("refresh_incremental", _RAW["tenant_analytics"])

sql("category_counts", """
    SELECT gc.category_id, gc.name AS category_name,
           (SELECT count(*) FROM visitors v WHERE v.category_id = gc.category_id) AS visitors,
           (SELECT count(*) FROM visitors) AS total_registered
    FROM categories gc""")

sql("page", """
    SELECT * FROM payments ORDER BY created_at DESC NULLS FIRST, order_id ASC LIMIT 100 OFFSET 20""")

sql("active_categories", """
    SELECT category_id, name, code, priority FROM categories
    WHERE is_active AND category_id IN (SELECT category_id FROM visitors)
    ORDER BY priority ASC, category_id ASC""")


def oracle_sql() -> dict[str, str]:
    return {name: with_views(text) for name, text in _RAW.items()}


# -- billing ---------------------------------------------------------------

AS_OF_SUBS = "TIMESTAMP '2024-03-01 00:00:00'"
AS_OF_PAYMENTS = "TIMESTAMP '1998-01-01 00:00:00'"

_LATEST_SUB = """
    SELECT * FROM (
      SELECT ts.*, row_number() OVER (PARTITION BY ts.tenant_id
                                      ORDER BY ts.created_at DESC NULLS FIRST, ts.subscription_id DESC) AS rn
      FROM subscriptions ts WHERE ts.status = 'active' {extra}) WHERE rn = 1"""

sql("active_subscriptions", f"""
    SELECT subscription_id, tenant_id, plan_id, status, ends_at FROM subscriptions
    WHERE status = 'active' AND (ends_at IS NULL OR ends_at > {AS_OF_SUBS})""")

sql("latest_subscription", f"""
    SELECT s.tenant_id, s.subscription_id, s.plan_id, p.name AS plan_name, p.slug AS plan_slug,
           s.created_at, p.max_events, p.max_visitors_per_event, p.max_admin_users,
           array_to_string(p.features, '|') AS features_list
    FROM ({_LATEST_SUB.format(extra="")}) s JOIN plans p ON p.plan_id = s.plan_id""")

sql("subscription_with_last_payment", f"""
    SELECT s.tenant_id, s.subscription_id, p.name AS plan_name, p.slug AS plan_slug,
           CAST(p.price AS DOUBLE) AS plan_price, s.status, s.starts_at, s.ends_at,
           pay.created_at AS last_payment_date, pay.amount AS last_payment_amount,
           pay.provider AS last_payment_provider, s.ends_at AS next_billing_date
    FROM ({_LATEST_SUB.format(extra="")}) s
    JOIN plans p ON p.plan_id = s.plan_id
    LEFT JOIN (SELECT tenant_id, created_at, amount, provider,
                      row_number() OVER (PARTITION BY tenant_id
                                         ORDER BY created_at DESC NULLS FIRST, order_id DESC) AS rn
               FROM payments WHERE status = 'success') pay
      ON pay.tenant_id = s.tenant_id AND pay.rn = 1""")

sql("plan_usage", f"""
    WITH cur AS (
      SELECT s.tenant_id, p.max_events, p.max_admin_users, p.max_visitors_per_event
      FROM ({_LATEST_SUB.format(extra=f"AND (ts.ends_at IS NULL OR ts.ends_at > {AS_OF_SUBS})")}) s
      JOIN plans p ON p.plan_id = s.plan_id),
    t AS (SELECT t.tenant_id, c.max_events, c.max_admin_users, c.max_visitors_per_event
          FROM tenants t LEFT JOIN cur c ON c.tenant_id = t.tenant_id),
    ev AS (SELECT tenant_id, count(*) AS u FROM occasions GROUP BY tenant_id),
    us AS (SELECT tenant_id, count(*) AS u FROM staff WHERE is_active GROUP BY tenant_id),
    big AS (SELECT tenant_id, max(n) AS u FROM (SELECT tenant_id, event_id, count(*) AS n
                                                FROM visitors GROUP BY tenant_id, event_id) GROUP BY tenant_id)
    SELECT t.tenant_id, 'events' AS limit_type, coalesce(ev.u, 0) AS usage,
           CAST(t.max_events AS BIGINT) AS limit_value, coalesce(coalesce(ev.u, 0) < t.max_events, false) AS allowed
    FROM t LEFT JOIN ev ON ev.tenant_id = t.tenant_id
    UNION ALL
    SELECT t.tenant_id, 'users', coalesce(us.u, 0), CAST(t.max_admin_users AS BIGINT),
           coalesce(coalesce(us.u, 0) < t.max_admin_users, false)
    FROM t LEFT JOIN us ON us.tenant_id = t.tenant_id
    UNION ALL
    SELECT t.tenant_id, 'visitors_per_event', coalesce(big.u, 0), CAST(t.max_visitors_per_event AS BIGINT),
           coalesce(coalesce(big.u, 0) < t.max_visitors_per_event, false)
    FROM t LEFT JOIN big ON big.tenant_id = t.tenant_id""")


# A function called for every tenant gives what the whole report does.
sql("sql_subscription_of", _RAW["subscription_with_last_payment"])
sql("sql_usage_of", _RAW["plan_usage"])
sql("sql_within_limit", f"""
    SELECT f.user_id,
           (SELECT count(*) FROM occasions o WHERE o.tenant_id = f.tenant_id) < coalesce(c.max_events, 0) AS events,
           (SELECT count(*) FROM staff u WHERE u.is_active AND u.tenant_id = f.tenant_id) < coalesce(c.max_admin_users, 0) AS users,
           false AS other
    FROM staff f LEFT JOIN (
      SELECT s.tenant_id, p.max_events, p.max_admin_users
      FROM ({_LATEST_SUB.format(extra=f"AND (ts.ends_at IS NULL OR ts.ends_at > {AS_OF_SUBS})")}) s
      JOIN plans p ON p.plan_id = s.plan_id) c USING (tenant_id)""")


def _quote_sql(plans_sql: str) -> str:
    return f"""
    WITH pl AS ({plans_sql}),
    q AS (SELECT pay.order_id, pay.plan_id, pay.billing_period, pay.provider,
                 CASE WHEN pl.currency = 'USD' AND pay.provider IN ('midtrans', 'xendit')
                      THEN (CASE WHEN pay.billing_period = 'yearly' THEN pl.price * 12 * 0.8 ELSE pl.price END) * 15000
                      ELSE (CASE WHEN pay.billing_period = 'yearly' THEN pl.price * 12 * 0.8 ELSE pl.price END)
                 END AS amt
          FROM payments pay JOIN pl ON pl.plan_id = pay.plan_id WHERE pl.is_active)
    SELECT order_id, plan_id, billing_period, provider, CAST(amt AS DOUBLE) AS amount_idr,
           CAST(floor(amt + 0.5) AS BIGINT) AS provider_amount FROM q"""


def _idr_values() -> str:
    rows = []
    for slug, price, feats in seeds.IDR_PRICES:
        flist = "[" + ", ".join("'" + f.replace("'", "''") + "'" for f in feats) + "]"
        rows.append(f"('{slug}', CAST({price} AS DECIMAL(10,2)), {flist})")
    return "(VALUES " + ", ".join(rows) + ") AS np(slug, price, features)"


sql("payment_quote", _quote_sql("SELECT * FROM plans"))

sql("payment_quote_repriced", _quote_sql(f"""
    SELECT p.plan_id, p.name, p.slug,
           CASE WHEN np.slug IS NOT NULL THEN np.price ELSE p.price END AS price,
           CASE WHEN np.slug IS NOT NULL THEN 'IDR' ELSE p.currency END AS currency,
           p.is_active
    FROM plans p LEFT JOIN {_idr_values()} ON np.slug = p.slug"""))

_NOTICES = """
    SELECT notice_id, provider, received_at, order_id, tx AS provider_status,
           CASE WHEN provider = 'midtrans' THEN
                  CASE WHEN tx = 'capture' AND fraud = 'challenge' THEN 'challenge'
                       WHEN tx = 'capture' AND fraud = 'accept' THEN 'success'
                       WHEN tx = 'capture' THEN 'pending'
                       WHEN tx = 'settlement' THEN 'success'
                       WHEN tx IN ('cancel', 'deny', 'expire') THEN 'failed'
                       ELSE 'pending' END
                WHEN provider = 'xendit' THEN
                  CASE WHEN tx = 'PAID' THEN 'success' WHEN tx IN ('EXPIRED', 'FAILED') THEN 'failed'
                       ELSE 'pending' END END AS payment_status,
           CASE WHEN provider = 'midtrans' THEN
                  CASE WHEN tx = 'settlement' THEN 'success'
                       WHEN tx IN ('cancel', 'deny', 'expire') THEN 'failed' ELSE 'pending' END
                WHEN provider = 'xendit' THEN
                  CASE WHEN tx = 'PAID' THEN 'success' WHEN tx IN ('EXPIRED', 'FAILED') THEN 'failed'
                       ELSE 'pending' END END AS polled_status,
           amount, tenant_id, plan_id, billing_period, body AS raw_response
    FROM (SELECT notice_id, provider, received_at, body,
                 CASE WHEN provider = 'midtrans' THEN json_extract_string(body, '$.order_id')
                      ELSE json_extract_string(body, '$.external_id') END AS order_id,
                 CASE WHEN provider = 'midtrans' THEN json_extract_string(body, '$.transaction_status')
                      ELSE json_extract_string(body, '$.status') END AS tx,
                 CASE WHEN provider = 'midtrans' THEN json_extract_string(body, '$.fraud_status') END AS fraud,
                 CAST(CASE WHEN provider = 'midtrans' THEN json_extract_string(body, '$.gross_amount')
                           ELSE json_extract_string(body, '$.amount') END AS DOUBLE) AS amount,
                 CAST(CASE WHEN provider = 'midtrans' THEN json_extract_string(body, '$.custom_field1')
                           ELSE json_extract_string(body, '$.metadata.tenant_id') END AS INTEGER) AS tenant_id,
                 CAST(CASE WHEN provider = 'midtrans' THEN json_extract_string(body, '$.custom_field2')
                           ELSE json_extract_string(body, '$.metadata.plan_id') END AS INTEGER) AS plan_id,
                 CASE WHEN provider = 'midtrans' THEN json_extract_string(body, '$.custom_field3')
                      ELSE json_extract_string(body, '$.metadata.billing_period') END AS billing_period
          FROM webhooks)"""

_LAST_NOTICE = f"""
    SELECT * FROM (SELECT n.*, row_number() OVER (PARTITION BY order_id
                                                  ORDER BY received_at DESC, notice_id DESC) AS rn
                   FROM ({_NOTICES}) n) WHERE rn = 1"""

sql("map_payment_status", _NOTICES)

# Notices of any shape; what cannot be used keeps its text and says why.
_RAW_NOTICES = """
    SELECT notice_id, CASE WHEN notice_id % 19 = 0 THEN 'stripe' ELSE provider END AS provider, received_at,
           CASE WHEN notice_id % 11 = 0 THEN left(body, -1) WHEN notice_id % 13 = 0 THEN '[' || body || ']'
                WHEN notice_id % 17 = 0 THEN '{"status":"PAID"}'
                WHEN notice_id % 4 = 1 THEN left(body, -1) || ',"channel":{"bank":"bank' || notice_id % 5 || '","tries":' || notice_id % 3 || '}}'
                ELSE body END AS body, 't' || notice_id % 7 AS token
    FROM webhooks"""
_JUDGED = f"""
    SELECT *, CASE WHEN j IS NULL THEN 'malformed body' WHEN json_type(j) <> 'OBJECT' THEN 'not an object'
                   WHEN provider NOT IN ('midtrans', 'xendit') THEN 'unknown provider'
                   WHEN j ->> (CASE provider WHEN 'midtrans' THEN '$.order_id' ELSE '$.external_id' END) IS NULL THEN 'no order id' END AS error_message
    FROM (SELECT *, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS j FROM ({_RAW_NOTICES}))"""

sql("notice_log", f"""
    SELECT notice_id, provider, received_at, token, error_message,
           CASE provider WHEN 'midtrans' THEN j ->> '$.order_id' WHEN 'xendit' THEN j ->> '$.external_id' END AS order_id,
           TRY_CAST(CASE provider WHEN 'midtrans' THEN j ->> '$.custom_field1' WHEN 'xendit' THEN j ->> '$.metadata.tenant_id' END AS INTEGER) AS tenant_id,
           CAST(CASE WHEN error_message IS NULL THEN 200 WHEN error_message = 'no order id' THEN 500
                     WHEN error_message = 'unknown provider' THEN 404 ELSE 400 END AS INTEGER) AS status_code,
           CASE WHEN error_message IS NOT NULL THEN body END AS raw_body, j ->> '$.channel.bank' AS bank
    FROM ({_JUDGED})""")

sql("notice_fields", f"""
    WITH top AS (SELECT provider, unnest(json_keys(j)) AS k, j FROM ({_JUDGED}) WHERE error_message IS NULL),
    one AS (SELECT provider, '$.' || k AS path, json_extract(j, '$.' || k) AS v FROM top),
    two AS (SELECT provider, path, unnest(json_keys(v)) AS k, v FROM one WHERE json_type(v) = 'OBJECT'),
    fields AS (SELECT * FROM one UNION ALL SELECT provider, path || '.' || k, json_extract(v, '$.' || k) FROM two)
    SELECT provider, path, CASE WHEN json_type(v) IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'number' WHEN json_type(v) = 'VARCHAR' THEN 'string'
                                ELSE lower(json_type(v)) END AS kind, count(*) AS notices
    FROM fields GROUP BY ALL""")

sql("apply_payments_logged", f"""
    WITH good AS (SELECT notice_id, provider, received_at, body FROM ({_JUDGED}) WHERE error_message IS NULL)
    SELECT p.order_id, p.tenant_id, coalesce(l.payment_status, p.status) AS status, l.received_at AS updated_at
    FROM payments p LEFT JOIN ({_LAST_NOTICE.replace("FROM webhooks", "FROM good")}) l ON l.order_id = p.order_id""")

sql("apply_payments", f"""
    SELECT p.order_id, p.tenant_id, coalesce(l.payment_status, p.status) AS status,
           l.received_at AS updated_at, l.raw_response
    FROM payments p LEFT JOIN ({_LAST_NOTICE}) l ON l.order_id = p.order_id""")

sql("upsert_subscriptions", f"""
    WITH b AS ({_LATEST_SUB.format(extra="")}),
    ok AS (SELECT l.*, json_extract_string(p.customer_data, '$.email') AS new_email,
                  CAST(CAST(date_trunc('month', CAST(l.received_at AS DATE))
                            + to_months(CASE WHEN l.billing_period = 'yearly' THEN 12 ELSE 1 END) AS DATE)
                       + CAST(day(l.received_at) - 1 AS INTEGER) AS TIMESTAMP) AS ends
           FROM (SELECT n.* FROM ({_NOTICES}) n WHERE n.payment_status = 'success'
                 QUALIFY row_number() OVER (PARTITION BY n.order_id ORDER BY n.received_at DESC, n.notice_id DESC) = 1) l
           LEFT JOIN payments p ON p.order_id = l.order_id),
    u AS (SELECT * FROM (SELECT ok.*, row_number() OVER (PARTITION BY tenant_id
                                                        ORDER BY received_at DESC, order_id DESC) AS rk
                         FROM ok) WHERE rk = 1)
    SELECT coalesce(b.tenant_id, u.tenant_id) AS tenant_id, b.subscription_id,
           CASE WHEN u.tenant_id IS NOT NULL THEN u.plan_id ELSE b.plan_id END AS plan_id,
           CASE WHEN u.tenant_id IS NOT NULL THEN 'active' ELSE b.status END AS status,
           CASE WHEN u.tenant_id IS NOT NULL THEN u.received_at ELSE b.starts_at END AS starts_at,
           CASE WHEN u.tenant_id IS NOT NULL THEN u.ends ELSE b.ends_at END AS ends_at,
           CASE WHEN b.tenant_id IS NOT NULL THEN b.billing_email ELSE u.new_email END AS billing_email,
           u.received_at AS updated_at, u.order_id AS last_order_id,
           CASE WHEN b.tenant_id IS NULL
                THEN json_object('provider', u.provider, 'orderId', u.order_id, 'billingPeriod', u.billing_period)::VARCHAR END AS metadata
    FROM b FULL OUTER JOIN u ON b.tenant_id = u.tenant_id""")

sql("payment_expiry", f"""
    SELECT order_id, tenant_id,
           CASE WHEN status = 'pending' AND created_at + INTERVAL 24 HOUR <= {AS_OF_PAYMENTS}
                THEN 'expired' ELSE status END AS status, created_at
    FROM payments""")

# -- registration ----------------------------------------------------------
sql("validate_visitors", r"""
    SELECT visitor_id, concat_ws(',',
        CASE WHEN NOT (first_name IS NOT NULL AND length(trim(first_name)) > 0) THEN 'name_required' END,
        CASE WHEN NOT (length(first_name) <= 255) THEN 'name_length' END,
        CASE WHEN NOT (email IS NOT NULL AND length(trim(email)) > 0) THEN 'email_required' END,
        CASE WHEN NOT (length(email) <= 255) THEN 'email_length' END,
        CASE WHEN NOT regexp_matches(email, '^[^\s@]+@[^\s@]+\.[^\s@]+$') THEN 'email_format' END,
        CASE WHEN NOT (length(registration_code) <= 50) THEN 'code_length' END,
        CASE WHEN NOT (category_id BETWEEN 1 AND 4) THEN 'category_range' END,
        CASE WHEN NOT (event_id >= 1) THEN 'event_id_positive' END,
        CASE WHEN NOT (status IN ('registered', 'confirmed', 'checked_in', 'checked_out', 'no_show', 'cancelled'))
             THEN 'status_enum' END) AS violations
    FROM visitors""")

sql("validate_events", r"""
    SELECT event_id, concat_ws(',',
        CASE WHEN NOT (event_name IS NOT NULL AND length(trim(event_name)) > 0) THEN 'name_required' END,
        CASE WHEN NOT (length(event_name) <= 255) THEN 'name_length' END,
        CASE WHEN NOT (length(slug) <= 255) THEN 'slug_length' END,
        CASE WHEN NOT regexp_matches(slug, '^[a-z0-9-]+$') THEN 'slug_format' END,
        CASE WHEN NOT (status IN ('draft', 'published', 'active', 'completed', 'cancelled')) THEN 'status_enum' END,
        CASE WHEN NOT (end_time > start_time) THEN 'end_after_start' END) AS violations
    FROM occasions""")

sql("validate_tenants", r"""
    SELECT tenant_id, concat_ws(',',
        CASE WHEN trim(coalesce(name, '')) = '' THEN 'name_required' END,
        CASE WHEN length(name) > 255 THEN 'name_length' END,
        CASE WHEN trim(coalesce(slug, '')) = '' THEN 'slug_required' END,
        CASE WHEN length(slug) > 100 THEN 'slug_length' END,
        CASE WHEN NOT regexp_full_match(slug, '[a-z0-9-]+') THEN 'slug_format' END,
        CASE WHEN length(subdomain) > 100 THEN 'subdomain_length' END,
        CASE WHEN NOT regexp_full_match(subdomain, '[a-z0-9-]+') THEN 'subdomain_format' END) AS violations
    FROM tenants""")

sql("validate_categories", """
    SELECT category_id, concat_ws(',',
        CASE WHEN length(name) > 100 THEN 'name_length' END,
        CASE WHEN length(code) > 10 THEN 'code_length' END,
        CASE WHEN NOT regexp_full_match(color, '#[0-9A-Fa-f]{6}') THEN 'color_format' END) AS violations
    FROM categories WHERE category_id IN (SELECT category_id FROM visitors)""")

sql("validate_subscriptions", """
    SELECT subscription_id, CASE WHEN status NOT IN ('active', 'cancelled', 'expired', 'suspended', 'trialing')
                                 THEN 'status_enum' ELSE '' END AS violations
    FROM subscriptions""")

sql("validate_staff", """
    SELECT user_id, concat_ws(',',
        CASE WHEN role NOT IN ('owner', 'admin', 'manager', 'staff', 'viewer') THEN 'role_enum' END,
        CASE WHEN trim(coalesce(email, '')) = '' THEN 'email_required' END) AS violations
    FROM staff""")

sql("validate_payments", """
    SELECT order_id, concat_ws(',',
        CASE WHEN provider NOT IN ('midtrans', 'xendit', 'stripe') THEN 'provider_enum' END,
        CASE WHEN status NOT IN ('pending', 'success', 'failed', 'cancelled', 'expired', 'challenge') THEN 'status_enum' END,
        CASE WHEN billing_period NOT IN ('monthly', 'yearly') THEN 'billing_period_enum' END) AS violations
    FROM payments""")

sql("validate_contacts", r"""
    SELECT doc_id, nth, concat_ws(',',
        CASE WHEN trim(coalesce(phone, '')) = '' THEN 'phone_required' END,
        CASE WHEN NOT regexp_matches(email, '^[^\s@]+@[^\s@]+\.[^\s@]+$') THEN 'email_format' END) AS violations
    FROM contacts""")

sql("unique_visitors", """
    SELECT 'unique_tenant_event_email' AS rule, concat_ws('|', tenant_id, event_id, email) AS key, count(*) AS rows
    FROM visitors WHERE tenant_id IS NOT NULL AND event_id IS NOT NULL AND email IS NOT NULL
    GROUP BY tenant_id, event_id, email HAVING count(*) > 1
    UNION ALL
    SELECT 'unique_tenant_registration_code', concat_ws('|', tenant_id, registration_code), count(*)
    FROM visitors WHERE tenant_id IS NOT NULL AND registration_code IS NOT NULL
    GROUP BY tenant_id, registration_code HAVING count(*) > 1""")

sql("unique_staff", """
    SELECT 'unique_tenant_email' AS rule, concat_ws('|', tenant_id, email) AS key, count(*) AS rows
    FROM staff WHERE tenant_id IS NOT NULL AND email IS NOT NULL GROUP BY tenant_id, email HAVING count(*) > 1""")

sql("unique_events", """
    SELECT 'unique_tenant_event_slug' AS rule, concat_ws('|', tenant_id, slug) AS key, count(*) AS rows
    FROM occasions WHERE tenant_id IS NOT NULL AND slug IS NOT NULL GROUP BY tenant_id, slug HAVING count(*) > 1""")

sql("unique_categories", """
    SELECT 'unique_tenant_category_code' AS rule, v.tenant_id || '|' || k.code AS key, count(DISTINCT v.event_id) AS rows
    FROM visitors v JOIN categories k USING (category_id)
    GROUP BY v.tenant_id, k.code HAVING count(DISTINCT v.event_id) > 1""")

sql("unique_payment_settings", """
    SELECT 'unique_tenant_provider' AS rule, concat_ws('|', tenant_id, provider) AS key, count(DISTINCT billing_period) AS rows
    FROM payments GROUP BY tenant_id, provider HAVING count(DISTINCT billing_period) > 1""")

sql("admit_checkins_by_tenant", """
    WITH scan AS (SELECT c.*, w.tenant_id FROM checkins c LEFT JOIN staff w ON w.user_id = c.checked_in_by),
    req AS (
      SELECT s.checkin_id AS request_id, s.tenant_id, s.visitor_id, v.event_id, v.visitor_id IS NOT NULL AS known,
             EXISTS (SELECT 1 FROM scan o WHERE o.is_stored AND o.tenant_id = s.tenant_id AND o.visitor_id = s.visitor_id) AS seen,
             min(struct_pack(t := s.checkin_time, i := s.checkin_id))
               OVER (PARTITION BY s.tenant_id, s.visitor_id) AS earliest
      FROM scan s LEFT JOIN visitors v ON v.visitor_id = s.visitor_id AND v.tenant_id = s.tenant_id
      WHERE NOT s.is_stored),
    judged AS (
      SELECT *, CASE WHEN seen THEN 'duplicate' WHEN NOT known THEN 'not_found' WHEN earliest.i <> request_id THEN 'duplicate' END AS reason
      FROM req)
    SELECT request_id, tenant_id, visitor_id, event_id, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS decision, reason
    FROM judged""")

sql("admit_checkins", """
    WITH stored AS (SELECT DISTINCT visitor_id FROM checkins WHERE is_stored),
    req AS (SELECT checkin_id AS request_id, visitor_id, checkin_time AS scan_time
            FROM checkins WHERE NOT is_stored),
    j AS (SELECT r.*, v.event_id, v.visitor_id IS NOT NULL AS known, s.visitor_id IS NOT NULL AS seen
          FROM req r LEFT JOIN visitors v ON v.visitor_id = r.visitor_id
          LEFT JOIN stored s ON s.visitor_id = r.visitor_id),
    k AS (SELECT j.*, row_number() OVER (PARTITION BY visitor_id, known AND NOT seen
                                         ORDER BY scan_time, request_id) AS rn FROM j),
    d AS (SELECT k.*, CASE WHEN seen THEN 'duplicate' WHEN NOT known THEN 'not_found'
                           WHEN rn = 1 THEN NULL ELSE 'duplicate' END AS reason FROM k)
    SELECT request_id, visitor_id, event_id, scan_time,
           CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS decision, reason
    FROM d""")

sql("assign_codes", """
    WITH ex AS (
      SELECT v.tenant_id, v.category_id,
             max(TRY_CAST(substr(v.registration_code, length(gc.code || '94') + 1) AS HUGEINT)) AS mx
      FROM visitors v JOIN categories gc ON gc.category_id = v.category_id
      WHERE v.registered_at < TIMESTAMP '1994-07-01 00:00:00'
        AND starts_with(v.registration_code, gc.code || '94')
      GROUP BY v.tenant_id, v.category_id),
    nw AS (
      SELECT v.visitor_id, v.tenant_id, v.category_id, gc.code,
             row_number() OVER (PARTITION BY v.tenant_id, v.category_id
                                ORDER BY v.registered_at, v.visitor_id) AS seq
      FROM visitors v LEFT JOIN categories gc ON gc.category_id = v.category_id
      WHERE v.registered_at >= TIMESTAMP '1994-07-01 00:00:00'),
    num AS (SELECT nw.*, CAST(coalesce(ex.mx, 0) + nw.seq AS VARCHAR) AS n
            FROM nw LEFT JOIN ex ON ex.tenant_id = nw.tenant_id AND ex.category_id = nw.category_id)
    SELECT visitor_id, tenant_id, category_id,
           CASE WHEN code IS NULL THEN NULL
                ELSE code || '94' || lpad(n, CAST(greatest(4, length(n)) AS INTEGER), '0') END AS registration_code
    FROM num""")

sql("assign_codes_single", """
    SELECT visitor_id, category_id, code || lpad(n, CAST(greatest(3, length(n)) AS INTEGER), '0') AS registration_code
    FROM (SELECT visitor_id, category_id, k.code,
                 CAST(row_number() OVER (PARTITION BY category_id ORDER BY registered_at, visitor_id) AS VARCHAR) AS n
          FROM visitors LEFT JOIN categories k USING (category_id))""")

# A visitor without a code is as many above a number brought before as visitors without one came since.
sql("assign_codes_arriving", """
    WITH a AS (
      SELECT visitor_id, tenant_id, category_id, registered_at, k.code || strftime(registered_at, '%y') AS prefix,
             CASE WHEN registered_at < TIMESTAMP '1994-07-01 00:00:00' OR visitor_id % 3 = 0 THEN registration_code END AS own
      FROM visitors LEFT JOIN categories k USING (category_id)),
    counted AS (
      SELECT *, CASE WHEN starts_with(own, prefix) THEN TRY_CAST(substr(own, length(prefix) + 1) AS HUGEINT) END AS brought,
             count(*) FILTER (own IS NULL) OVER w AS came
      FROM a WINDOW w AS (PARTITION BY tenant_id, prefix ORDER BY registered_at, visitor_id)),
    numbered AS (
      SELECT *, CAST(came + greatest(0, coalesce(max(brought - came) OVER w, 0)) AS VARCHAR) AS n
      FROM counted WINDOW w AS (PARTITION BY tenant_id, prefix ORDER BY registered_at, visitor_id))
    SELECT visitor_id, tenant_id, category_id,
           coalesce(own, prefix || lpad(n, CAST(greatest(4, length(n)) AS INTEGER), '0')) AS registration_code
    FROM numbered""")

# A NULL in the key equals nothing: such rows are all kept.
_DEDUPE = """
    SELECT visitor_id, visitor_id = f AS kept, CASE WHEN visitor_id <> f THEN f END AS duplicate_of
    FROM (SELECT visitor_id, CASE WHEN ({nulls}) THEN visitor_id
                 ELSE first_value(visitor_id) OVER (PARTITION BY {keys} ORDER BY registered_at, visitor_id) END AS f
          FROM visitors)"""
sql("dedupe_registrations", _DEDUPE.format(
    keys="tenant_id, event_id, email", nulls="tenant_id IS NULL OR event_id IS NULL OR email IS NULL"))
sql("dedupe_registrations_global", _DEDUPE.format(keys="email", nulls="email IS NULL"))

sql("ticket_checksum", """
    SELECT visitor_id, registration_code,
           substr(md5(CAST(visitor_id AS VARCHAR) || registration_code || email), 1, 8) AS checksum
    FROM visitors WHERE registration_code IS NOT NULL""")

# -- tenancy and contacts --------------------------------------------------
sql("resolve_tenant", """
    WITH dir AS (SELECT tenant_id, slug, subdomain, custom_domain, is_active FROM tenants
                 UNION ALL SELECT tenant_id, slug, subdomain, custom_domain, is_active FROM sites),
    r AS (SELECT request_id, host, path, header_tenant_id,
                 CASE WHEN len(string_split(host, '.')) >= 3 THEN string_split(host, '.')[1] END AS k_sub,
                 CASE WHEN NOT contains(host, 'localhost') THEN host END AS k_dom,
                 CASE WHEN starts_with(path, '/t/') AND len(string_split(path, '/')) > 2
                           AND string_split(path, '/')[3] <> '' THEN string_split(path, '/')[3] END AS k_slug
          FROM requests)
    SELECT r.request_id, r.host, r.path,
           coalesce(h.tenant_id, s.t, d.t, g.t) AS tenant_id,
           CASE WHEN h.tenant_id IS NOT NULL THEN 'header' WHEN s.t IS NOT NULL THEN 'subdomain'
                WHEN d.t IS NOT NULL THEN 'custom_domain' WHEN g.t IS NOT NULL THEN 'path' END AS resolved_by,
           CASE WHEN coalesce(h.tenant_id, s.t, d.t) IS NULL AND g.t IS NOT NULL
                THEN coalesce(nullif(substr(r.path, length('/t/' || r.k_slug) + 1), ''), '/')
                ELSE r.path END AS path_without_tenant
    FROM r
    LEFT JOIN (SELECT DISTINCT tenant_id FROM dir) h ON h.tenant_id = r.header_tenant_id
    LEFT JOIN (SELECT subdomain AS k, min(tenant_id) AS t FROM dir
               WHERE is_active AND subdomain IS NOT NULL GROUP BY subdomain) s ON s.k = r.k_sub
    LEFT JOIN (SELECT custom_domain AS k, min(tenant_id) AS t FROM dir
               WHERE is_active AND custom_domain IS NOT NULL GROUP BY custom_domain) d ON d.k = r.k_dom
    LEFT JOIN (SELECT slug AS k, min(tenant_id) AS t FROM dir
               WHERE is_active AND slug IS NOT NULL GROUP BY slug) g ON g.k = r.k_slug""")

sql("normalize_contacts", r"""
    SELECT doc_id, nth, email, phone,
           CASE WHEN starts_with(regexp_replace(phone, '[^0-9+]', '', 'g'), '08')
                THEN '+62' || substr(regexp_replace(phone, '[^0-9+]', '', 'g'), 2)
                ELSE regexp_replace(phone, '[^0-9+]', '', 'g') END AS phone_normalized,
           coalesce(regexp_matches(CASE WHEN starts_with(regexp_replace(phone, '[^0-9+]', '', 'g'), '08')
                                        THEN '+62' || substr(regexp_replace(phone, '[^0-9+]', '', 'g'), 2)
                                        ELSE regexp_replace(phone, '[^0-9+]', '', 'g') END,
                                   '^(\+62|62|0)[0-9]{9,13}$'), false) AS phone_valid,
           lower(trim(email)) AS email_normalized,
           coalesce(regexp_matches(lower(trim(email)), '^[^\s@]+@[^\s@]+\.[^\s@]+$'), false) AS email_valid
    FROM contacts WHERE email IS NOT NULL OR phone IS NOT NULL""")

# -- table changes -----------------------------------------------------------
sql("insert_ignore", """
    WITH v AS (SELECT visitor_id, tenant_id, event_id, email, registered_at FROM visitors),
    b AS (SELECT * FROM v WHERE registered_at < TIMESTAMP '2001-01-01 00:00:00'),
    n AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, event_id, email
                                       ORDER BY registered_at, visitor_id) AS rn
          FROM v WHERE registered_at >= TIMESTAMP '2001-01-01 00:00:00')
    SELECT * FROM b
    UNION ALL
    SELECT visitor_id, tenant_id, event_id, email, registered_at FROM n
    WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM b WHERE b.tenant_id = n.tenant_id
                                 AND b.event_id = n.event_id AND b.email = n.email)""")

sql("apply_patch", """
    WITH p AS (SELECT client AS user_id, CAST(count(*) AS INTEGER) AS login_count, max(ts) AS last_login
               FROM request_log WHERE route = 'auth' GROUP BY client)
    SELECT b.user_id, b.tenant_id,
           CASE WHEN p.user_id IS NOT NULL THEN b.login_count + coalesce(p.login_count, 0)
                ELSE b.login_count END AS login_count,
           CASE WHEN p.user_id IS NOT NULL THEN p.last_login END AS last_login,
           CASE WHEN p.user_id IS NOT NULL THEN TIMESTAMP '2024-02-01 00:00:00' END AS updated_at
    FROM staff b LEFT JOIN p ON p.user_id = b.user_id""")

sql("purge_whole_tenant", """
    WITH gone AS (SELECT tenant_id FROM tenants WHERE NOT is_active),
    owned AS (
      SELECT 'tenants' AS table_name, CAST(tenant_id AS VARCHAR) AS row_key, tenant_id FROM tenants
      UNION ALL SELECT 'events', CAST(event_id AS VARCHAR), tenant_id FROM occasions
      UNION ALL SELECT 'staff', CAST(user_id AS VARCHAR), tenant_id FROM staff
      UNION ALL SELECT 'subscriptions', CAST(subscription_id AS VARCHAR), tenant_id FROM subscriptions
      UNION ALL SELECT 'visitors', CAST(visitor_id AS VARCHAR), tenant_id FROM visitors
      UNION ALL SELECT 'payments', order_id, tenant_id FROM payments
      UNION ALL (SELECT DISTINCT 'payment_settings', CAST(tenant_id AS VARCHAR) || '-' || provider, tenant_id FROM payments)
      UNION ALL SELECT 'activity', CAST(request_id AS VARCHAR), tenant_id FROM request_log
      UNION ALL SELECT 'checkins', c.checkin_id, v.tenant_id FROM checkins c LEFT JOIN visitors v USING (visitor_id))
    SELECT table_name, row_key FROM owned WHERE tenant_id IS NULL OR tenant_id NOT IN (FROM gone)""")

sql("purge_visitors", """
    SELECT visitor_id, tenant_id, event_id FROM visitors
    WHERE tenant_id NOT IN (SELECT tenant_id FROM tenants WHERE NOT is_active)""")

sql("purge_checkins", """
    SELECT checkin_id, visitor_id FROM checkins
    WHERE visitor_id NOT IN (SELECT visitor_id FROM visitors
                             WHERE tenant_id IN (SELECT tenant_id FROM tenants WHERE NOT is_active))""")

# -- logs ----------------------------------------------------------------------
# The sketches' own values differ from run to run: every one must be within the stated rank error.
sql("request_quantiles", """
    SELECT route, CAST(date_trunc('week', ts) AS TIMESTAMP) AS week, count(*) AS requests, true AS p50_ok, true AS p95_ok, true AS p99_ok
    FROM request_log GROUP BY ALL""")

sql("request_kpis", """
    SELECT route, count(*) AS requests,
           count(*) FILTER (WHERE status >= 500) AS errors,
           round(count(*) FILTER (WHERE status >= 500) / count(*), 6) AS error_rate,
           round(avg(duration_ms), 6) AS avg_ms,
           round(quantile_cont(duration_ms, 0.95), 6) AS p95_ms,
           round(count(*) FILTER (WHERE duration_ms < 200) / count(*), 6) AS under_target_share,
           round(count(*) FILTER (WHERE duration_ms > 1000) / count(*), 6) AS slow_share,
           avg(duration_ms) < 100 AS mean_ok,
           quantile_cont(duration_ms, 0.95) < 200 AS p95_ok,
           count(*) FILTER (WHERE status >= 500) / count(*) < 0.001 AS errors_ok
    FROM request_log GROUP BY route""")

sql("scanner_stats", """
    SELECT scanner, count(*) AS total_scans, count(*) FILTER (WHERE ok) AS successful_scans,
           max(ts) AS last_scan,
           (count(*) FILTER (WHERE ok) * 200 + count(*)) // (2 * count(*)) AS success_rate
    FROM scans GROUP BY scanner""")

sql("rate_limit_hits", """
    SELECT window_start, window_end, tenant_id, route, "count", "limit", "count" - "limit" AS blocked
    FROM (SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end,
                 tenant_id, route, count(*) AS "count"
          FROM request_log WHERE path NOT IN ('/health', '/api/health')
          GROUP BY 1, 2, 3, 4) c
    JOIN (VALUES ('auth', 5), ('register', 10), ('other', 100)) AS l(route, "limit") USING (route)
    WHERE "count" > "limit\"""")



def _windows(key: str, width: str, over: str) -> str:
    """Windows one after another, each from the first request after the one before."""
    return f"""
    SELECT * FROM (WITH RECURSIVE req AS (
      SELECT {key} AS who, route, date_trunc('millisecond', ts) AS t FROM request_log WHERE path NOT IN ('/health', '/api/health')),
    later AS (
      SELECT DISTINCT who, route, t AS s,
             min(t) OVER (PARTITION BY who, route ORDER BY t RANGE BETWEEN INTERVAL {width} FOLLOWING AND UNBOUNDED FOLLOWING) AS next
      FROM req),
    w AS (
      SELECT who, route, min(t) AS s FROM req GROUP BY who, route
      UNION ALL
      SELECT who, route, later.next FROM w JOIN later USING (who, route, s) WHERE later.next IS NOT NULL)
    SELECT w.s AS window_start, w.s + INTERVAL {width} AS window_end, w.who AS {key}, w.route,
           count(*) AS "count", any_value(l."limit") AS "limit", greatest(count(*) - any_value(l."limit"), 0) AS blocked
    FROM w JOIN req ON req.who = w.who AND req.route = w.route AND req.t >= w.s AND req.t < w.s + INTERVAL {width}
    JOIN (VALUES ('auth', 5), ('register', 10), ('other', 100)) AS l(route, "limit") ON l.route = w.route
    GROUP BY w.s, w.who, w.route {over}) found"""


sql("client_windows", _windows("tenant_id", "1 DAY", 'HAVING count(*) > any_value(l."limit")'))
sql("client_windows_all", _windows("client", "15 MINUTES", ""))

_LINES = """
    SELECT request_id,
           CASE WHEN status = 500 AND client % 7 = 0 THEN 'garbage ' || CAST(request_id AS VARCHAR)
           ELSE '10.0.' || CAST(client % 256 AS VARCHAR) || '.' || CAST(request_id % 256 AS VARCHAR)
                || ' - - [' || strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0000] "GET ' || path
                || ' HTTP/1.1" ' || CAST(status AS VARCHAR) || ' ' || CAST(request_id % 5000 AS VARCHAR)
                || ' "-" "Mozilla/5.0" "-" rt=' || rt || ' uct="0.000" uht="0.001" urt="' || rt || '"'
           END AS value
    FROM (SELECT *, CAST(ms // 1000 AS VARCHAR) || '.' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') AS rt
          FROM (SELECT *, CAST(floor(duration_ms) AS BIGINT) AS ms FROM request_log))"""


def _access_sql() -> str:
    from ..operators.logs import ACCESS_LOG_RE
    pat = "'" + ACCESS_LOG_RE.replace("'", "''") + "'"

    def g(i):
        return f"nullif(m.g{i}, '')"

    names = "[" + ", ".join(f"'g{i}'" for i in range(1, 14)) + "]"
    return f"""
    SELECT regexp_matches(value, {pat}) AS parsed,
           {g(1)} AS remote_addr, nullif({g(2)}, '-') AS remote_user,
           strptime(split_part({g(3)}, ' ', 1), '%d/%b/%Y:%H:%M:%S') AS time,
           CASE WHEN {g(3)} IS NULL THEN NULL ELSE split_part({g(3)}, ' ', -1) END AS tz_offset,
           split_part({g(4)}, ' ', 1) AS method, split_part({g(4)}, ' ', 2) AS uri,
           CAST({g(5)} AS INTEGER) AS status, CAST(nullif({g(6)}, '-') AS BIGINT) AS body_bytes,
           CAST({g(10)} AS DOUBLE) AS request_time,
           TRY_CAST(nullif({g(13)}, '-') AS DOUBLE) AS upstream_response_time
    FROM (SELECT value, regexp_extract(value, {pat}, {names}) AS m FROM ({_LINES}) lines)"""


sql("parse_access_log", _access_sql())


# -- sources and sinks -----------------------------------------------------------
sql("read_json_events", """
    SELECT CASE WHEN bad THEN NULL ELSE 'GET' END AS method,
           CASE WHEN bad THEN NULL ELSE path END AS url,
           CASE WHEN bad THEN NULL ELSE status END AS status,
           CASE WHEN bad THEN NULL ELSE CAST(floor(duration_ms) AS DOUBLE) END AS duration_ms,
           CASE WHEN bad THEN NULL ELSE tenant_id END AS tenant_id,
           CASE WHEN bad THEN NULL ELSE ts END AS timestamp,
           bad AS is_corrupt
    FROM (SELECT *, status = 500 AND client % 7 = 0 AS bad FROM request_log)""")

sql("export_csv", _EVENT_STATS)

sql("refresh_snapshot", _RAW["tenant_analytics"])

# Stream twins: the batch answer over the whole feed, open windows included.
sql("live_dashboard_stream", """
    SELECT CAST(d AS TIMESTAMP) AS window_start, CAST(d + 1 AS TIMESTAMP) AS window_end, category_id,
           CAST(sum(n) AS BIGINT) AS checkins
    FROM (SELECT CAST(checkin_time AS DATE) AS d, visitor_id, count(*) AS n FROM checkins GROUP BY ALL)
    JOIN visitors USING (visitor_id) GROUP BY d, category_id""")

sql("running_totals_stream", """
    SELECT event_id, category_id, CAST(sum(n) AS BIGINT) AS checkins
    FROM visitors JOIN (SELECT visitor_id, count(*) AS n FROM checkins GROUP BY visitor_id) USING (visitor_id)
    GROUP BY event_id, category_id""")

sql("checkin_stream", """
    SELECT visitor_id, event_id, tenant_id FROM visitors SEMI JOIN checkins USING (visitor_id)""")

sql("rate_limit_stream", _RAW["rate_limit_hits"])

# -- tickets and audit trail ---------------------------------------------------
# Every sealed ticket must open with the key and re-verify its checksum.
sql("ticket_verify", """
    SELECT true AS valid, count(*) AS tickets FROM visitors WHERE registration_code IS NOT NULL""")

sql("audit_versions", """
    WITH old AS (
      SELECT visitor_id, tenant_id, CASE WHEN visitor_id % 103 <> 5 THEN email END AS email,
             CASE WHEN visitor_id % 101 = 3 THEN 'registered' ELSE status END AS status
      FROM visitors WHERE visitor_id % 97 <> 1),
    now AS (SELECT * FROM visitors WHERE visitor_id % 89 <> 7),
    o AS (SELECT visitor_id, 'tenant_id' AS field, CAST(tenant_id AS VARCHAR) AS old_value FROM old
          UNION ALL SELECT visitor_id, 'email', email FROM old UNION ALL SELECT visitor_id, 'status', status FROM old),
    n AS (SELECT visitor_id, 'tenant_id' AS field, CAST(tenant_id AS VARCHAR) AS new_value FROM now
          UNION ALL SELECT visitor_id, 'email', email FROM now UNION ALL SELECT visitor_id, 'status', status FROM now)
    SELECT CASE WHEN o.field IS NULL THEN 'insert' WHEN n.field IS NULL THEN 'delete' ELSE 'update' END AS action,
           'visitor' AS entity_type, visitor_id AS entity_id, field, old_value, new_value,
           CASE WHEN o.field IS NULL THEN 'added' WHEN n.field IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM o FULL JOIN n USING (visitor_id, field)
    WHERE o.field IS NULL OR n.field IS NULL OR old_value IS DISTINCT FROM new_value""")

sql("audit_changes", """
    WITH a AS (
      SELECT event_type AS action, 'user' AS entity_type, user_id AS entity_id, props AS old_values,
             CASE event_type
               WHEN 'click' THEN props
               WHEN 'view' THEN '{"k": ' || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) + 1 AS VARCHAR) || '}'
               WHEN 'purchase' THEN '{"k": ' || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) AS VARCHAR)
                                    || ', "paid": "yes"}'
               WHEN 'signup' THEN '{}'
               ELSE '{"k": null}' END AS new_values
      FROM events),
    f AS (
      SELECT action, entity_type, entity_id, old_values, new_values,
             unnest(list_distinct(list_concat(coalesce(json_keys(old_values), []),
                                              coalesce(json_keys(new_values), [])))) AS field
      FROM a),
    d AS (
      SELECT *, list_contains(coalesce(json_keys(old_values), []), field) AS has_o,
                list_contains(coalesce(json_keys(new_values), []), field) AS has_n,
                json_extract_string(old_values, '$."' || field || '"') AS ov,
                json_extract_string(new_values, '$."' || field || '"') AS nv
      FROM f)
    SELECT action, entity_type,
           CASE WHEN NOT has_o THEN 'added' WHEN NOT has_n THEN 'removed' ELSE 'changed' END AS change,
           count(*) AS changes, count(DISTINCT entity_id) AS entities
    FROM d WHERE (ov IS DISTINCT FROM nv) OR has_o <> has_n
    GROUP BY 1, 2, 3""")

# A scan is in if no other of the visitor comes before it, stored ones before all.
sql("checkin_stream_keyed", """
    SELECT c.checkin_id AS request_id, c.visitor_id, v.event_id,
           CASE WHEN v.visitor_id IS NOT NULL AND c.checkin_id = f.first THEN 'accepted' ELSE 'rejected' END AS decision,
           CASE WHEN v.visitor_id IS NULL THEN 'not_found' WHEN c.checkin_id IS DISTINCT FROM f.first THEN 'duplicate' END AS reason
    FROM checkins c LEFT JOIN visitors v USING (visitor_id)
    LEFT JOIN (SELECT visitor_id, CASE WHEN bool_or(is_stored) THEN NULL
                                       ELSE arg_min(checkin_id, (checkin_time, checkin_id)) END AS first
               FROM checkins GROUP BY visitor_id) f USING (visitor_id)
    WHERE NOT c.is_stored""")

sql("checkin_stream_exact", """
    WITH b1 AS (
      SELECT c.checkin_id AS request_id, c.visitor_id, c.checkin_time AS scan_time, v.event_id,
             v.visitor_id IS NOT NULL AS known
      FROM checkins c LEFT JOIN visitors v ON v.visitor_id = c.visitor_id WHERE c.is_stored),
    d1 AS (
      SELECT *, row_number() OVER (PARTITION BY visitor_id, known ORDER BY scan_time, request_id) AS rn
      FROM b1),
    r1 AS (
      SELECT request_id, visitor_id, event_id,
             CASE WHEN known AND rn = 1 THEN 'accepted' ELSE 'rejected' END AS decision,
             CASE WHEN NOT known THEN 'not_found' WHEN rn = 1 THEN NULL ELSE 'duplicate' END AS reason
      FROM d1),
    seen AS (SELECT DISTINCT visitor_id FROM r1 WHERE decision = 'accepted'),
    b2 AS (
      SELECT c.checkin_id AS request_id, c.visitor_id, c.checkin_time AS scan_time, v.event_id,
             v.visitor_id IS NOT NULL AS known, s.visitor_id IS NOT NULL AS was_seen
      FROM checkins c LEFT JOIN visitors v ON v.visitor_id = c.visitor_id
      LEFT JOIN seen s ON s.visitor_id = c.visitor_id WHERE NOT c.is_stored),
    d2 AS (
      SELECT *, row_number() OVER (PARTITION BY visitor_id, known AND NOT was_seen
                                   ORDER BY scan_time, request_id) AS rn
      FROM b2),
    r2 AS (
      SELECT request_id, visitor_id, event_id,
             CASE WHEN NOT was_seen AND known AND rn = 1 THEN 'accepted' ELSE 'rejected' END AS decision,
             CASE WHEN was_seen THEN 'duplicate' WHEN NOT known THEN 'not_found'
                  WHEN rn = 1 THEN NULL ELSE 'duplicate' END AS reason
      FROM d2)
    SELECT * FROM r1 UNION ALL SELECT * FROM r2""")

sql("mark_checked_in", """
    WITH stored AS (SELECT DISTINCT visitor_id FROM checkins WHERE is_stored),
    acc AS (SELECT DISTINCT c.visitor_id FROM checkins c
            JOIN visitors v ON v.visitor_id = c.visitor_id
            WHERE NOT c.is_stored AND c.visitor_id NOT IN (SELECT visitor_id FROM stored))
    SELECT v.visitor_id, v.tenant_id,
           CASE WHEN a.visitor_id IS NOT NULL THEN 'checked_in' ELSE v.status END AS status,
           CASE WHEN a.visitor_id IS NOT NULL THEN TIMESTAMP '2024-02-01 00:00:00' END AS updated_at
    FROM visitors v LEFT JOIN acc a ON a.visitor_id = v.visitor_id""")

# Every pending payment that no final notice settles within a day of its creation.
sql("payment_expiry_stream", f"""
    WITH settled AS (SELECT order_id, received_at FROM ({_NOTICES})
                     WHERE payment_status IN ('success', 'failed', 'cancelled', 'expired'))
    SELECT order_id, tenant_id, created_at, 'expired' AS status FROM payments
    WHERE status = 'pending'
      AND order_id NOT IN (SELECT p.order_id FROM payments p JOIN settled n USING (order_id)
                           WHERE n.received_at BETWEEN p.created_at AND p.created_at + INTERVAL 24 HOUR)""")

sql("recent_checkins_per_scanner", """
    SELECT t.checked_in_by, t.rank, t.checkin_id, t.visitor_id, t.checkin_time,
           v.first_name, v.last_name, v.registration_code, tu.first_name AS checked_in_by_name
    FROM (SELECT c.*, row_number() OVER (PARTITION BY c.checked_in_by
                                         ORDER BY c.checkin_time DESC NULLS FIRST, c.checkin_id) AS rank
          FROM checkins c WHERE c.visitor_id IN (SELECT visitor_id FROM visitors)) t
    JOIN visitors v ON v.visitor_id = t.visitor_id
    LEFT JOIN staff tu ON tu.user_id = t.checked_in_by
    WHERE t.rank <= 5""")

sql("request_kpis_by_tenant", """
    SELECT tenant_id, count(*) AS requests,
           count(*) FILTER (WHERE status >= 500) AS errors,
           round(count(*) FILTER (WHERE status >= 500) / count(*), 6) AS error_rate,
           round(avg(duration_ms), 6) AS avg_ms,
           round(quantile_cont(duration_ms, 0.95), 6) AS p95_ms,
           round(count(*) FILTER (WHERE duration_ms < 200) / count(*), 6) AS under_target_share,
           round(count(*) FILTER (WHERE duration_ms > 1000) / count(*), 6) AS slow_share,
           avg(duration_ms) < 100 AS mean_ok,
           quantile_cont(duration_ms, 0.95) < 200 AS p95_ok,
           count(*) FILTER (WHERE status >= 500) / count(*) < 0.001 AS errors_ok
    FROM request_log GROUP BY tenant_id""")

sql("cancel_payments", """
    WITH req AS (SELECT DISTINCT order_id, tenant_id FROM payments WHERE billing_period = 'yearly')
    SELECT p.order_id, p.tenant_id,
           CASE WHEN r.order_id IS NOT NULL AND p.status = 'pending' THEN 'cancelled' ELSE p.status END AS status,
           CASE WHEN r.order_id IS NOT NULL AND p.status = 'pending' THEN 'cancelled'
                WHEN r.order_id IS NOT NULL THEN 'rejected' END AS cancel_result,
           CASE WHEN r.order_id IS NOT NULL AND p.status = 'pending'
                THEN TIMESTAMP '2024-02-01 00:00:00' END AS cancelled_at
    FROM payments p LEFT JOIN req r ON r.order_id = p.order_id AND r.tenant_id = p.tenant_id""")
