"""Operators on hand-made frames for every quirk listed in FIXTURES §C,
checked against brute-force Python where the rule is easy to restate."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from conftest import rows
from rollcall.operators import common
from rollcall.operators import billing, changes, logs, registration, reports, tenancy
from rollcall.operators.common import number_within_groups, pick_per_group
from rollcall.sources import seeds

T0 = dt.datetime(2024, 1, 1)


def ts(days=0, hours=0):
    return T0 + dt.timedelta(days=days, hours=hours)


# -- skew-safe building blocks ---------------------------------------------------
def test_number_within_groups_equals_row_number_with_hot_group(spark):
    rnd = random.Random(7)
    data = [(("hot" if rnd.random() < 0.5 else f"g{rnd.randrange(20)}"), rnd.randrange(50), i)
            for i in range(3000)]
    df = spark.createDataFrame(data, "g string, t int, id int")
    got = number_within_groups(df, ["g"], ["t", "id"], out="seq", partitions=7)
    want = df.withColumn("seq", F.row_number().over(Window.partitionBy("g").orderBy("t", "id")))
    assert rows(got, "id", "seq") == rows(want, "id", "seq")


def test_pick_per_group_is_deterministic_on_ties(spark):
    df = spark.createDataFrame([(1, ts(1), 10), (1, ts(1), 11), (1, None, 9), (2, ts(0), 5)],
                               "k int, t timestamp_ntz, id int")
    from rollcall.operators.common import nulls_high
    got = pick_per_group(df, ["k"], [nulls_high(F.col("t")), F.col("id")], ["id"])
    assert rows(got) == [(1, 9), (2, 5)]
    got2 = pick_per_group(df.where(F.col("t").isNotNull()), ["k"], [F.col("t"), F.col("id")], ["id"])
    assert rows(got2) == [(1, 11), (2, 5)]


# -- O20 fan-out ----------------------------------------------------------------
def test_dashboard_counts_check_in_fanout(spark, dom):
    ev = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "event_id long, event_name string")
    vis = spark.createDataFrame(
        [(10, 1, "registered", 1), (11, 1, "confirmed", 2), (12, 2, "checked_in", 5)],
        "visitor_id long, event_id long, status string, category_id int")
    ck = spark.createDataFrame([(10, "a"), (10, "b"), (10, "c"), (12, "d")],
                               "visitor_id long, checkin_id string")
    got = {r.event_id: r for r in reports.dashboard_stats(ev, vis, dom.categories, ck).collect()}
    assert got[1].total_registered == 4 and got[1].total_pending == 3
    assert got[1].total_confirmed == 1 and got[1].total_checkedin == 3
    assert got[1].total_vip == 3 and got[1].total_sponsor == 1
    assert got[2].total_registered == 1 and got[2].total_participant == 0
    assert got[3].total_registered == 0


# -- O22 multiplicity and percent -------------------------------------------------
def test_tenant_analytics_plan_rows(spark, dom):
    tenants = spark.createDataFrame(
        [(1, "t1", "t1", True, T0), (2, "t2", "t2", True, T0), (3, "t3", "t3", False, T0)],
        "tenant_id int, name string, slug string, is_active boolean, created_at timestamp_ntz")
    subs = spark.createDataFrame([(1, 1, 1, "active"), (2, 1, 2, "active"), (3, 1, 2, "active"),
                                  (4, 2, 3, "expired")],
                                 "subscription_id long, tenant_id int, plan_id int, status string")
    ev = spark.createDataFrame([(100, 1)], "event_id long, tenant_id int")
    vis = spark.createDataFrame([(1000, 1, "checked_in"), (1001, 1, "registered"), (1002, 1, "checked_in")],
                                "visitor_id long, tenant_id int, status string")
    ck = spark.createDataFrame([(1000, "x"), (1000, "y")], "visitor_id long, checkin_id string")
    staff = spark.createDataFrame([(1, 1, True), (2, 1, False)], "user_id long, tenant_id int, is_active boolean")
    got = reports.tenant_analytics(tenants, subs, dom.plans, ev, vis, ck, staff)
    r = rows(got, "tenant_id", "plan_name", "total_events", "total_visitors", "total_checkins",
             "total_users", "checkin_percentage")
    assert r == [(1, "Free", 1, 3, 2, 1, 66.67), (1, "Starter", 1, 3, 2, 1, 66.67),
                 (2, None, 0, 0, 0, 0, None)]


def test_category_counts_zero_for_unused(spark, dom):
    vis = spark.createDataFrame([(1, 1), (2, 1), (3, 5)], "visitor_id long, category_id int")
    got = rows(reports.category_counts(vis, dom.categories), "category_id", "visitors", "total_registered")
    assert got == [(1, 2, 3), (2, 0, 3), (3, 0, 3), (4, 0, 3)]


# -- top-k with NULL keys and ties ---------------------------------------------------
def test_page_nulls_first_desc_and_tiebreak(spark):
    df = spark.createDataFrame([(1, ts(1)), (2, None), (3, ts(1)), (4, ts(2))], "id int, created_at timestamp_ntz")
    got = [r.id for r in reports.page(df, limit=3, tie_breaker="id").collect()]
    assert got == [2, 4, 1]
    got = [r.id for r in reports.page(df, desc=False, limit=10, offset=1, tie_breaker="id").collect()]
    assert got == [3, 4, 2]


def test_search_keeps_wildcards(spark, dom):
    v = spark.createDataFrame(
        [(1, 1, 1, "VIP240001", "Budi", "X", "b@x.id", 1, "registered", ts(1)),
         (2, 1, 1, "SPR240001", "Ani", "Y", "a_n@x.id", 2, "registered", ts(2)),
         (3, 1, 2, "PTC240001", "Agus", "Z", "agus@x.id", 4, "registered", ts(3))],
        "visitor_id long, tenant_id int, event_id long, registration_code string, first_name string, "
        "last_name string, email string, category_id int, status string, registered_at timestamp_ntz")
    assert [r.visitor_id for r in reports.search_visitors(v, dom.categories, "a_", event_id=1).collect()] == [2]
    assert [r.visitor_id for r in reports.search_visitors(v, dom.categories, "VIP").collect()] == [1]
    assert [r.visitor_id for r in reports.search_visitors(v, dom.categories, "x.id", limit=2).collect()] == [3, 2]


# -- O24 plan limits ------------------------------------------------------------------
def test_plan_usage(spark, dom):
    tenants = spark.createDataFrame([(1,), (2,)], "tenant_id int")
    subs = spark.createDataFrame(
        [(1, 1, 1, "active", ts(0), None), (2, 1, 2, "active", ts(5), ts(6)),
         (3, 2, 2, "active", ts(0), ts(1))],
        "subscription_id long, tenant_id int, plan_id int, status string, created_at timestamp_ntz, "
        "ends_at timestamp_ntz")
    ev = spark.createDataFrame([(10, 1)], "event_id long, tenant_id int")
    staff = spark.createDataFrame([(1, 1, True)], "user_id long, tenant_id int, is_active boolean")
    vis = spark.createDataFrame([(i, 1, 10) for i in range(60)], "visitor_id long, tenant_id int, event_id long")
    got = rows(billing.plan_usage(tenants, subs, dom.plans, ev, staff, vis, "2024-01-10 00:00:00"),
               "tenant_id", "limit_type", "usage", "limit_value", "allowed")
    # Tenant 1: the newer Starter subscription ended, the Free one is current.
    assert got == [(1, "events", 1, 1, False), (1, "users", 1, 1, False),
                   (1, "visitors_per_event", 60, 50, False),
                   (2, "events", 0, None, False), (2, "users", 0, None, False),
                   (2, "visitors_per_event", 0, None, False)]


# -- O28 codes ---------------------------------------------------------------------
def test_assign_codes_continue_pad_and_skip_bad_suffix(spark, dom):
    existing = spark.createDataFrame(
        [(1, 1, 1, "VIP249999"), (2, 1, 1, "VIP24abc"), (3, 1, 2, "SPR230005"), (4, 2, 1, "VIP240007")],
        "visitor_id long, tenant_id int, category_id int, registration_code string")
    new = spark.createDataFrame(
        [(10, 1, 1, None, ts(1)), (11, 1, 1, "", ts(2)), (12, 1, 2, None, ts(1)),
         (13, 2, 1, None, ts(1)), (14, 1, 5, None, ts(1)), (15, 1, 1, "KEEP1", ts(0))],
        "visitor_id long, tenant_id int, category_id int, registration_code string, registered_at timestamp_ntz")
    got = dict(rows(registration.assign_codes(new, existing, dom.categories, "saas", "2024-06-01 00:00:00"),
                    "visitor_id", "registration_code"))
    assert got == {10: "VIP2410000", 11: "VIP2410001", 12: "SPR240001", 13: "VIP240008",
                   14: None, 15: "KEEP1"}
    single = dict(rows(registration.assign_codes(new, existing.where("visitor_id = 3"),
                                                 dom.categories, "single"), "visitor_id", "registration_code"))
    # single style: numbered per category over all tenants, suffix read from position 4
    assert (single[10], single[13], single[11]) == ("VIP001", "VIP002", "VIP003")
    assert single[12] == "SPR230006"


def test_assign_codes_unique_on_real_batch(spark, dom):
    v = dom.visitors
    cut = F.lit("2001-01-01 00:00:00").cast("timestamp_ntz")
    new = v.where(F.col("registered_at") >= cut).withColumn("registration_code", F.lit(None).cast("string"))
    out = registration.assign_codes(new, v.where(F.col("registered_at") < cut), dom.categories,
                                    "saas", "2001-08-01 00:00:00")
    coded = out.where(F.col("registration_code").isNotNull())
    assert coded.count() == coded.select("tenant_id", "registration_code").distinct().count()


# -- O29 dedupe ---------------------------------------------------------------------
def test_dedupe_first_wins(spark):
    df = spark.createDataFrame(
        [(1, 1, 1, "a@x", ts(2)), (2, 1, 1, "a@x", ts(1)), (3, 1, 2, "a@x", ts(0)), (4, 1, 1, "a@x", ts(1))],
        "visitor_id long, tenant_id int, event_id long, email string, registered_at timestamp_ntz")
    got = rows(registration.dedupe_registrations(df), "visitor_id", "kept", "duplicate_of")
    assert got == [(1, False, 2), (2, True, None), (3, True, None), (4, False, 2)]
    glob = rows(registration.dedupe_registrations(df, keys=("email",)), "visitor_id", "kept")
    assert glob == [(1, False), (2, False), (3, True), (4, False)]


# -- O15 admission ----------------------------------------------------------------------
def test_admit_checkins_rules(spark):
    visitors = spark.createDataFrame([(1, 100), (2, 100), (3, 200)], "visitor_id long, event_id long")
    stored = spark.createDataFrame([(3,), (99,)], "visitor_id long")
    req = spark.createDataFrame(
        [("r1", 1, ts(0, 2)), ("r2", 1, ts(0, 1)), ("r3", 2, ts(0)), ("r4", 3, ts(0)),
         ("r5", 7, ts(0)), ("r6", 99, ts(0))],
        "request_id string, visitor_id long, scan_time timestamp_ntz")
    got = rows(registration.admit_checkins(req, visitors, stored), "request_id", "decision", "reason", "event_id")
    assert got == [("r1", "rejected", "duplicate", 100), ("r2", "accepted", None, 100),
                   ("r3", "accepted", None, 100), ("r4", "rejected", "duplicate", 200),
                   ("r5", "rejected", "not_found", None), ("r6", "rejected", "duplicate", None)]


def test_admit_never_twice_on_real_data(spark, dom):
    c = dom.checkins
    req = c.select(F.col("checkin_id").alias("request_id"), "visitor_id",
                   F.col("checkin_time").alias("scan_time"))
    out = registration.admit_checkins(req, dom.visitors, c.where(F.lit(False)))
    acc = out.where(F.col("decision") == "accepted")
    assert acc.count() == acc.select("visitor_id").distinct().count()
    assert acc.count() == c.select("visitor_id").distinct().join(dom.visitors, "visitor_id").count()


# -- O11 validation --------------------------------------------------------------------
def test_validate_rows(spark):
    ev = spark.createDataFrame([("E1", "good-slug", "published", "09:00:00", "17:00:00"),
                                ("", "Bad Slug", "open", "10:00:00", "09:00:00"),
                                ("E3", None, "draft", None, "10:00:00")],
                               "event_name string, slug string, status string, start_time string, end_time string")
    got = [r.violations for r in registration.validate_rows(ev, "occasions").collect()]
    assert got == [[], ["name_required", "slug_format", "status_enum", "end_after_start"], []]


# -- O17 tenant attribution ---------------------------------------------------------------
def test_resolve_tenant_routes(spark):
    tenants = spark.createDataFrame(
        [(1, "acme", "acme", "events.acme.com", True), (2, "old", "old", "old.example.org", False),
         (3, "beta", "beta", None, True)],
        "tenant_id int, slug string, subdomain string, custom_domain string, is_active boolean")
    req = spark.createDataFrame(
        [(1, "x.example.com", "/", 2), (2, "acme.example.com", "/", None), (3, "events.acme.com", "/", None),
         (4, "example.com", "/t/beta/page", None), (5, "old.example.org", "/", None),
         (6, "localhost", "/t/acme", None), (7, "nowhere.net", "/x", None), (8, "old.app.com", "/t/", None)],
        "request_id long, host string, path string, header_tenant_id int")
    got = rows(tenancy.resolve_tenant(req, tenants), "request_id", "tenant_id", "resolved_by")
    assert got == [(1, 2, "header"), (2, 1, "subdomain"), (3, 1, "custom_domain"), (4, 3, "path"),
                   (5, None, None), (6, 1, "path"), (7, None, None), (8, None, None)]


# -- O32-O35 table changes --------------------------------------------------------------------
def test_upsert_last_wins_and_idempotent(spark):
    base = spark.createDataFrame([(1, 10, "a", "keep"), (2, 20, "b", "keep")],
                                 "k int, plan int, status string, note string")
    upd = spark.createDataFrame([(1, 11, "x", 1), (1, 12, "y", 2), (3, 30, "z", 1)],
                                "k int, plan int, status string, seq int")
    once = changes.upsert(base, upd, "k", ["plan", "status"], order_by="seq")
    assert rows(once, "k", "plan", "status", "note") == [(1, 12, "y", "keep"), (2, 20, "b", "keep"),
                                                         (3, 30, "z", None)]
    twice = changes.upsert(once.select(*base.columns), upd, "k", ["plan", "status"], order_by="seq")
    assert rows(twice, "k", "plan", "status", "note") == rows(once, "k", "plan", "status", "note")


def test_insert_ignore(spark):
    base = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "dup", 0), (2, "first", 1), (2, "second", 2), (3, "c", 0)],
                                "k int, v string, o int")
    got = rows(changes.insert_ignore(base, new.drop("o").withColumn("o", F.col("k")), "k", order_by="o"), "k")
    assert [k for (k,) in got] == [1, 2, 3]
    got = rows(changes.insert_ignore(base, new, "k", order_by="o"), "k", "v")
    assert got == [(1, "a"), (2, "first"), (3, "c")]
    assert changes.insert_ignore(base, new.select("k", "v")).count() == 5


def test_apply_patch(spark):
    base = spark.createDataFrame([(1, 3, "a"), (2, 0, "b")], "id int, login_count int, role string")
    patch = spark.createDataFrame([(1, 2, "admin")], "id int, login_count int, role string")
    got = rows(changes.apply_patch(base, patch, "id", "2024-02-01 00:00:00", add_cols=["login_count"]),
               "id", "login_count", "role", "updated_at")
    assert got == [(1, 5, "admin", dt.datetime(2024, 2, 1)), (2, 0, "b", None)]


def test_purge_cascades(spark):
    vis = spark.createDataFrame([(1, 1), (2, 2), (3, 1)], "visitor_id long, tenant_id int")
    ck = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (9, "orphan")], "visitor_id long, checkin_id string")
    out = changes.purge({"visitors": vis, "checkins": ck}, spark.createDataFrame([(1,)], "tenant_id int"),
                        children={"checkins": ("visitors", "visitor_id", "visitor_id")})
    assert rows(out["visitors"], "visitor_id") == [(2,)]
    assert rows(out["checkins"], "checkin_id") == [("b",), ("orphan",)]


# -- O38 audit ------------------------------------------------------------------------------
def test_audit_changes_kinds(spark):
    act = spark.createDataFrame(
        [("update", "visitor", 1, '{"a": 1, "b": "x", "n": null}', '{"a": 2, "c": true, "n": null}'),
         ("update", "visitor", 2, None, '{"a": 1}'), ("noop", "visitor", 3, '{"a": 1}', '{"a": 1}')],
        "action string, entity_type string, entity_id int, old_values string, new_values string")
    got = rows(logs.audit_changes(act), "entity_id", "field", "old_value", "new_value", "change")
    assert got == [(1, "a", "1", "2", "changed"), (1, "b", "x", None, "removed"),
                   (1, "c", None, "true", "added"), (2, "a", None, "1", "added")]


# -- O39-O41 billing --------------------------------------------------------------------------
def test_activate_subscriptions_month_end(spark):
    subs = spark.createDataFrame([(1, 11, 1, "active", T0, None, "old@x")],
                                 "tenant_id int, subscription_id long, plan_id int, status string, "
                                 "starts_at timestamp_ntz, ends_at timestamp_ntz, billing_email string")
    notices = spark.createDataFrame(
        [(1, "o1", dt.datetime(2024, 1, 31, 10), "success", 1, 2, "monthly"),
         (2, "o2", dt.datetime(2024, 2, 29, 9), "success", 2, 3, "yearly"),
         (3, "o3", dt.datetime(2024, 12, 31, 8), "success", 3, 4, "monthly"),
         (4, "o4", dt.datetime(2025, 1, 5), "failed", 3, 2, "monthly")],
        "notice_id long, order_id string, received_at timestamp_ntz, payment_status string, tenant_id int, "
        "plan_id int, billing_period string").withColumn("provider", F.lit("midtrans"))
    pays = spark.createDataFrame([("o1", '{"email":"a@x"}'), ("o2", '{"email":"b@x"}'), ("o3", '{}')],
                                 "order_id string, customer_data string")
    got = rows(billing.activate_subscriptions(subs, notices, pays),
               "tenant_id", "subscription_id", "plan_id", "ends_at", "billing_email")
    assert got == [(1, 11, 2, dt.datetime(2024, 3, 2), "old@x"),
                   (2, None, 3, dt.datetime(2025, 3, 1), "b@x"),
                   (3, None, 4, dt.datetime(2025, 1, 31), None)]


def test_cancel_only_pending(spark):
    pays = spark.createDataFrame([("o1", 1, "pending"), ("o2", 1, "success"), ("o3", 2, "pending")],
                                 "order_id string, tenant_id int, status string")
    req = spark.createDataFrame([("o1", 1), ("o2", 1), ("o3", 9)], "order_id string, tenant_id int")
    got = rows(billing.cancel_payments(pays, req, "2024-01-01 00:00:00"), "order_id", "status", "cancel_result")
    assert got == [("o1", "cancelled", "cancelled"), ("o2", "success", "rejected"), ("o3", "pending", None)]


def test_payment_expiry_batch(spark):
    pays = spark.createDataFrame([("a", "pending", ts(0)), ("b", "pending", ts(0, 1)), ("c", "success", ts(-5))],
                                 "order_id string, status string, created_at timestamp_ntz")
    got = rows(billing.payment_expiry(pays, "2024-01-02 00:00:00"), "order_id", "status")
    assert got == [("a", "expired"), ("b", "pending"), ("c", "success")]


def test_reprice_only_listed(spark, dom):
    prices = seeds.idr_prices(spark).where("slug <> 'enterprise'")
    got = {r.slug: (float(r.price), r.currency) for r in billing.reprice_plans(dom.plans, prices).collect()}
    assert got == {"free": (0.0, "IDR"), "starter": (449000.0, "IDR"),
                   "professional": (1199000.0, "IDR"), "enterprise": (199.99, "USD")}


# -- O37 tickets -------------------------------------------------------------------------------
def test_tickets_verify_and_detect_tampering(spark, dom):
    key = "0123456789abcdef01234567"
    t = registration.ticket_payload(dom.visitors.limit(20), dom.categories, key, "2024-01-01 00:00:00")
    ok = registration.verify_tickets(t, key)
    assert ok.where(~F.col("valid")).count() == 0
    wrong = registration.verify_tickets(t, "x" * 24)
    assert wrong.where(F.col("valid")).count() == 0
    payload = t.first().payload
    assert '"checksum"' in payload and '"nama_lengkap"' in payload


# -- O25/O26/O44 logs --------------------------------------------------------------------------
def test_scanner_and_kpis(spark):
    scans = spark.createDataFrame([("s1", True, ts(0)), ("s1", False, ts(1)), ("s1", True, ts(2))],
                                  "scanner string, ok boolean, ts timestamp_ntz")
    r = logs.scanner_stats(scans).first()
    assert (r.total_scans, r.successful_scans, r.success_rate, r.last_scan) == (3, 2, 67, ts(2))
    log = spark.createDataFrame([("a", 200, float(d)) for d in range(1, 101)], "route string, status int, duration_ms double")
    k = logs.request_kpis(log).first()
    assert k.requests == 100 and k.errors == 0 and abs(k.p95_ms - 95.05) < 1e-9


def test_rate_limit_windows(spark):
    base = dt.datetime(2024, 1, 1, 0, 0)
    data = [(1, "auth", "/api/auth/login", base + dt.timedelta(minutes=m)) for m in range(0, 12, 2)]
    data += [(1, "auth", "/api/health", base + dt.timedelta(minutes=1))] * 3
    data += [(2, "auth", "/api/auth/login", base + dt.timedelta(minutes=14 + m)) for m in range(4)]
    log = spark.createDataFrame(data, "client long, route string, path string, ts timestamp_ntz")
    got = rows(logs.rate_limit_hits(log), "client", "count", "limit", "blocked")
    assert got == [(1, 6, 5, 1)]


def test_access_log_parse(spark):
    lines = spark.createDataFrame(
        [('1.2.3.4 - - [10/Oct/2024:13:55:36 +0700] "GET /api/x HTTP/1.1" 200 512 "-" "curl/8" "-" '
          'rt=0.012 uct="0.000" uht="0.010" urt="0.011"',),
         ('5.6.7.8 - bob [01/Jan/2024:00:00:00 +0000] "POST /t/acme HTTP/2.0" 502 - "r" "ua" "9.9.9.9" '
          'rt=1.500 uct="-" uht="-" urt="-"',), ("not a log line",)], "value string")
    got = [tuple(r) for r in logs.parse_access_log(lines).drop("line").collect()]
    assert got[0] == (True, "1.2.3.4", None, dt.datetime(2024, 10, 10, 13, 55, 36), "+0700", "GET", "/api/x",
                      200, 512, 0.012, 0.011)
    assert got[1][2] == "bob" and got[1][7] == 502 and got[1][8] is None and got[1][10] is None
    assert got[2][0] is False and all(x is None for x in got[2][1:])


def test_report_views_queryable_by_name(spark, dom):
    from rollcall.plans.sql_views import register_report_views
    names = register_report_views(dom, as_of="2024-03-01 00:00:00")
    assert "dashboard_stats" in names and "tenant_limits" in names
    one = spark.sql("SELECT total_registered, total_checkedin FROM dashboard_stats WHERE event_id = 5")
    want = reports.dashboard_stats(dom.occasions, dom.visitors, dom.categories, dom.checkins) \
        .where("event_id = 5").select("total_registered", "total_checkedin")
    assert rows(one) == rows(want)
    allowed = spark.sql("SELECT allowed FROM tenant_limits WHERE tenant_id = 1 AND limit_type = 'events'")
    assert allowed.count() == 1
    assert spark.sql("SELECT count(*) FROM visitor_summary").first()[0] >= dom.visitors.count()


def test_admit_checkins_with_split_visitors_equals_plain(spark, dom, monkeypatch):
    c = dom.checkins
    req = c.where(~F.col("is_stored")).select(F.col("checkin_id").alias("request_id"), "visitor_id",
                                              F.col("checkin_time").alias("scan_time"))
    stored = c.where(F.col("is_stored"))
    cols = ("request_id", "decision", "reason", "event_id")
    plain = registration.admit_checkins(req, dom.visitors, stored)
    monkeypatch.setattr(common, "HEAVY_ROWS", 2)
    salted = registration.admit_checkins(req, dom.visitors, stored)
    assert rows(plain, *cols) == rows(salted, *cols)
    assert salted.count() == req.count()


def test_per_scanner_top_k_limits_before_shuffle(spark, dom):
    df = reports.recent_checkins_per_scanner(dom.checkins, dom.visitors, dom.staff, n=5)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    counts = rows(df.groupBy("checked_in_by").count(), "count")
    assert all(c <= 5 for (c,) in counts)


# -- NULL and repeated keys, hot keys -------------------------------------------
def test_null_keys_are_kept_apart(spark):
    df = spark.createDataFrame([(1, 1, 5, None, ts(0)), (2, 1, 5, None, ts(1)), (3, 1, 5, "a", ts(2)), (4, 1, 5, "a", ts(1))],
                               "visitor_id long, tenant_id int, event_id long, email string, registered_at timestamp_ntz")
    got = rows(registration.dedupe_registrations(df), "visitor_id", "kept", "duplicate_of")
    assert got == [(1, True, None), (2, True, None), (3, False, 4), (4, True, None)]
    base = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    new = spark.createDataFrame([(None, 3), (None, 4), ("a", 5), ("b", 7), ("b", 6)], "k string, v int")
    for order in ("v", None):
        assert rows(changes.insert_ignore(base, new, "k", order_by=order)) == [("a", 1), ("b", 6), (None, 2), (None, 3), (None, 4)]


def test_repeated_keys_give_one_row(spark):
    base = spark.createDataFrame([(1, 10, 0, None), (2, 20, 0, None)], "k int, v int, n int, updated_at timestamp_ntz")
    twice = spark.createDataFrame([(1, 11), (1, 12), (3, 30), (3, 31)], "k int, v int")
    got = changes.upsert(base.select("k", "v"), twice, "k", ["v"])
    assert rows(got, "k", "v") == [(1, 12), (2, 20), (3, 31)]
    patch = spark.createDataFrame([(1, 5, 1), (1, 4, 2)], "k int, v int, n int")
    got = changes.apply_patch(base, patch, "k", "2024-01-01 00:00:00", add_cols=["n"])
    assert rows(got, "k", "v", "n") == [(1, 5, 3), (2, 20, 0)]
    got = changes.apply_patch(base, patch, "k", "2024-01-01 00:00:00", add_cols=["n"], order_by="n")
    assert rows(got, "k", "v", "n") == [(1, 4, 3), (2, 20, 0)]


def test_notices_repeated_and_out_of_order(spark):
    subs = spark.createDataFrame([(7, 70, 1, "active", ts(0), ts(9), "old@x.y")],
                                 "tenant_id int, subscription_id long, plan_id int, status string, starts_at timestamp_ntz, "
                                 "ends_at timestamp_ntz, billing_email string")
    pay = spark.createDataFrame([("a", 7, "pending", '{"email":"a@x.y"}'), ("b", 8, "pending", '{"email":"b@x.y"}'), ("c", 9, "pending", "{}")],
                                "order_id string, tenant_id int, status string, customer_data string")
    notes = spark.createDataFrame(
        [(3, "a", ts(3), "success", 7, 2), (4, "a", ts(4), "pending", 7, 2), (1, "b", ts(5), "failed", 8, 3), (2, "b", ts(2), "success", 8, 3),
         (5, "b", ts(1), "success", 8, 3), (6, "c", ts(1), "failed", 9, 3)],
        "notice_id long, order_id string, received_at timestamp_ntz, payment_status string, tenant_id int, plan_id int") \
        .withColumns({"billing_period": F.lit("monthly"), "provider": F.lit("xendit"), "raw_response": F.concat(F.lit("body "), "notice_id")})
    got = {r.tenant_id: r for r in billing.activate_subscriptions(subs, notes, pay).collect()}
    assert set(got) == {7, 8} and got[7].plan_id == 2 and got[7].starts_at == ts(3) and got[7].billing_email == "old@x.y" and got[7].metadata is None
    assert got[8].starts_at == ts(2) and got[8].billing_email == "b@x.y"
    assert got[8].metadata == '{"provider":"xendit","orderId":"b","billingPeriod":"monthly"}'
    done = rows(billing.apply_payment_notices(pay, notes), "order_id", "status", "raw_response")
    assert done == [("a", "pending", "body 4"), ("b", "failed", "body 1"), ("c", "failed", "body 6")]


def test_long_code_suffixes_continue(spark, dom):
    cols = "visitor_id long, tenant_id int, category_id int, registration_code string, registered_at timestamp_ntz"
    for used, want in (("3000000000", "VIP013000000001"), ("9" * 25, "VIP01" + "1" + "0" * 25), ("12x", "VIP010001")):
        old = spark.createDataFrame([(1, 1, 1, "VIP01" + used, ts(0))], cols)
        new = spark.createDataFrame([(2, 1, 1, None, ts(1))], cols)
        got = registration.assign_codes(new, old, dom.categories, as_of="2001-01-01 00:00:00")
        assert rows(got, "registration_code") == [(want,)]


def test_admission_by_tenant_and_hot_visitor(spark):
    vis = spark.createDataFrame([(1, 100, 1), (2, 200, 2)], "visitor_id long, event_id long, tenant_id int")
    req = spark.createDataFrame([("a", 1, 1, ts(5)), ("b", 2, 1, ts(1)), ("c", 1, 1, ts(6)), ("d", 2, 2, ts(3)), ("e", None, 1, ts(0)), ("f", 1, None, ts(0))],
                                "request_id string, tenant_id int, visitor_id long, scan_time timestamp_ntz")
    got = rows(registration.admit_checkins(req, vis, vis.limit(0), keys=("tenant_id", "visitor_id")), "request_id", "reason")
    assert got == [("a", None), ("b", "not_found"), ("c", "duplicate"), ("d", None), ("e", "not_found"), ("f", "not_found")]


def test_hot_key_join_spreads_the_hot_key_and_null_keys(spark):
    from rollcall.operators.common import join_on_hot_key
    for_this = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in for_this}
    for k, v in for_this.items():
        spark.conf.set(k, v)
    try:
        many = spark.range(60_000).select("id", F.when(F.col("id") % 10 < 6, 1).when(F.col("id") % 10 < 8, None).otherwise(F.col("id") % 500).cast("long").alias("k"))
        one = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
        out = join_on_hot_key(many, one, ["k"], F.col("id"), heavy_rows=1000)
        # Only the hot key's row is repeated: the rest of ``one`` is sent once.
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "sequence(0, CASE WHEN" in plan
        light = join_on_hot_key(many, one, ["k"], F.col("id"))
        assert "explode" not in light._jdf.queryExecution().optimizedPlan().toString() and light.count() == 60_000
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 60_000 and max(sizes) < 3 * 60_000 / 16
        assert out.where("k IS NULL AND v IS NOT NULL OR k IS NOT NULL AND v <> 2 * k OR k IS NOT NULL AND v IS NULL").count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_uniqueness_rules_and_tenant_path(spark):
    v = spark.createDataFrame([(1, 1, "a@x", "C1"), (1, 1, "a@x", "C2"), (1, 2, "a@x", "C1"), (1, 1, None, None), (1, 1, None, None)],
                              "tenant_id int, event_id long, email string, registration_code string")
    assert rows(registration.uniqueness_violations(v, "visitors")) == [
        ("unique_tenant_event_email", "1|1|a@x", 2), ("unique_tenant_registration_code", "1|C1", 2)]
    ten = spark.createDataFrame([(5, "acme", "acme", None, True)], "tenant_id int, slug string, subdomain string, custom_domain string, is_active boolean")
    req = spark.createDataFrame([(1, "localhost", "/t/acme/api/x", None), (2, "localhost", "/t/acme", None), (3, "localhost", "/t/nobody/api", None),
                                 (4, "acme.example.com", "/t/acme/api", None)], "request_id long, host string, path string, header_tenant_id int")
    got = rows(tenancy.resolve_tenant(req, ten), "request_id", "resolved_by", "path_without_tenant")
    assert got == [(1, "path", "/api/x"), (2, "path", "/"), (3, None, "/t/nobody/api"), (4, "subdomain", "/t/acme/api")]


def test_shared_folder_is_required_off_local():
    from rollcall.session import ensure_checkpoint_dir

    class Conf(dict):
        def get(self, k, default=None):
            return dict.get(self, k, default)

    class Session:
        conf = Conf({"spark.master": "yarn"})
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())


def test_every_contact_of_a_text(spark, tmp_path):
    from rollcall.sources.views import Domain
    text = "a@b.com-foo@c.org x@y.zz, 0812345678901 and +62812-3456-7890; end"
    spark.createDataFrame([(1, text), (2, "none"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = rows(Domain(spark, str(tmp_path)).contacts, "doc_id", "nth", "email", "phone")
    assert got == [(1, 0, "a@b.com", "0812345678901"), (1, 1, "-foo@c.org", "+62812-3456-7890"), (1, 2, "x@y.zz", None),
                   (2, 0, None, None), (3, 0, None, None)]
