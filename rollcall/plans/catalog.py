"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame
over the whole driver tables. Their DuckDB twins live in ``oracle.py``
under the same names and produce the same column names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import billing, changes, incremental, limits, logs, notices, numbering, quantiles, registration, reports, search, tenancy, versions, windows
from ..functions.scalars import plus_days
from ..sources import io as rio
from ..sources import seeds
from ..sources.views import Domain
from . import sql_functions
from ..streaming import admission, live
from ..streaming.runner import run_available_now, run_foreach_batch, run_updates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def dom(spark: SparkSession, sf_dir: str) -> Domain:
    return Domain(spark, sf_dir)


# -- reports -----------------------------------------------------------------
@query("load_views")
def q_load_views(spark, sf_dir):
    d = dom(spark, sf_dir)
    counts = [getattr(d, v).agg(F.count(F.lit(1)).alias("row_count"))
              .select(F.lit(v).alias("view"), "row_count") for v in Domain.VIEW_NAMES]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("tenant_lookup")
def q_tenant_lookup(spark, sf_dir):
    d = dom(spark, sf_dir)
    return reports.tenant_lookup(d.visitors, tenant_id=3, status="confirmed")


@query("published_events")
def q_published_events(spark, sf_dir):
    return reports.published_events(dom(spark, sf_dir).occasions)


@query("search_visitors")
def q_search_visitors(spark, sf_dir):
    d = dom(spark, sf_dir)
    return reports.search_visitors(d.visitors, d.categories, term="agus", limit=50, offset=0) \
        .select("visitor_id", "tenant_id", "event_id", "registration_code", "first_name",
                "last_name", "email", "status", "registered_at", "category_name", "category_code")


@query("search_visitors_indexed")
def q_search_visitors_indexed(spark, sf_dir):
    """A rare term through the trigram index over all visitors."""
    d = dom(spark, sf_dir)
    index = search.build(d.visitors)
    return search.search(index, d.categories, term="Tamu77", limit=200) \
        .select("visitor_id", "tenant_id", "event_id", "registration_code", "first_name",
                "last_name", "email", "status", "registered_at", "category_name", "category_code")


@query("search_index_counts")
def q_search_index_counts(spark, sf_dir):
    """How many visitors hold each trigram, from the postings of the index."""
    lists = search.build(dom(spark, sf_dir).visitors).postings
    return lists.groupBy("trigram").agg(F.sum(F.size("ids")).alias("visitors"))


@query("attendance_status")
def q_attendance_status(spark, sf_dir):
    d = dom(spark, sf_dir)
    s = reports.visitor_summary(d.visitors, d.categories, d.occasions, d.checkins)
    return s.groupBy("attendance_status").agg(F.count(F.lit(1)).alias("rows"))


@query("visitor_summary")
def q_visitor_summary(spark, sf_dir):
    d = dom(spark, sf_dir)
    return reports.visitor_summary(d.visitors, d.categories, d.occasions, d.checkins).select(
        "visitor_id", "registration_code", "first_name", "last_name", "email", "category_name",
        "category_code", "category_color", "event_name", "event_date", "status", "registered_at",
        "checkin_id", "checkin_time", "checked_in_by", "attendance_status")


@query("visitors_with_category")
def q_visitors_with_category(spark, sf_dir):
    d = dom(spark, sf_dir)
    return reports.visitors_with_category(d.visitors, d.categories, d.checkins,
                                          status="confirmed", limit=100, offset=0).select(
        "visitor_id", "tenant_id", "event_id", "registration_code", "status", "registered_at",
        "category_name", "category_code", "checkin_id", "checkin_time")


@query("recent_checkins")
def q_recent_checkins(spark, sf_dir):
    d = dom(spark, sf_dir)
    return reports.recent_checkins(d.checkins, d.visitors, d.categories, d.staff, n=10).select(
        "checkin_id", "visitor_id", "checkin_time", "first_name", "last_name",
        "registration_code", "category_name", "checked_in_by_name")


@query("count_by_tenant")
def q_count_by_tenant(spark, sf_dir):
    return reports.count_by_tenant(dom(spark, sf_dir).visitors)


@query("dashboard_stats")
def q_dashboard_stats(spark, sf_dir):
    d = dom(spark, sf_dir)
    return reports.dashboard_stats(d.occasions, d.visitors, d.categories, d.checkins)


@query("event_stats")
def q_event_stats(spark, sf_dir):
    d = dom(spark, sf_dir)
    return reports.event_stats(d.occasions, d.visitors, d.categories)


@query("tenant_analytics")
def q_tenant_analytics(spark, sf_dir):
    d = dom(spark, sf_dir)
    return reports.tenant_analytics(d.tenants, d.subscriptions, d.plans, d.occasions,
                                    d.visitors, d.checkins, d.staff)


@query("category_counts")
def q_category_counts(spark, sf_dir):
    d = dom(spark, sf_dir)
    return reports.category_counts(d.visitors, d.categories)


@query("page")
def q_page(spark, sf_dir):
    d = dom(spark, sf_dir)
    return reports.page(d.payments, order_by="created_at", desc=True, limit=100, offset=20,
                        tie_breaker="order_id")


@query("active_categories")
def q_active_categories(spark, sf_dir):
    d = dom(spark, sf_dir)
    used = reports.used_categories(d.categories, d.visitors)
    return reports.active_categories(used).select("category_id", "name", "code", "priority")


# -- billing -----------------------------------------------------------------

AS_OF_SUBS = "2024-03-01 00:00:00"
AS_OF_PAYMENTS = "1998-01-01 00:00:00"
CODE_CUTOFF = "1994-07-01 00:00:00"
CODE_LATER = "1996-01-01 00:00:00"
CODE_YEAR_OF = "1994-08-01 00:00:00"
CODE_AS_OF = "2001-08-01 00:00:00"
REGISTRATION_CUTOFF = "2001-01-01 00:00:00"
PATCH_AS_OF = "2024-02-01 00:00:00"
TICKET_KEY = "rollcall-ticket-key-0024"   # 24 bytes -> AES-192


@query("active_subscriptions")
def q_active_subscriptions(spark, sf_dir):
    d = dom(spark, sf_dir)
    return billing.active_subscriptions(d.subscriptions, AS_OF_SUBS).select(
        "subscription_id", "tenant_id", "plan_id", "status", "ends_at")


@query("latest_subscription")
def q_latest_subscription(spark, sf_dir):
    d = dom(spark, sf_dir)
    return billing.latest_subscription(d.subscriptions, d.plans).select(
        "tenant_id", "subscription_id", "plan_id", "plan_name", "plan_slug", "created_at",
        "max_events", "max_visitors_per_event", "max_admin_users",
        F.concat_ws("|", "features").alias("features_list"))


@query("subscription_with_last_payment")
def q_subscription_with_last_payment(spark, sf_dir):
    d = dom(spark, sf_dir)
    return billing.subscription_with_last_payment(d.subscriptions, d.plans, d.payments)


@query("plan_usage")
def q_plan_usage(spark, sf_dir):
    d = dom(spark, sf_dir)
    return billing.plan_usage(d.tenants, d.subscriptions, d.plans, d.occasions, d.staff,
                              d.visitors, AS_OF_SUBS)


@query("enforce_visitor_limits")
def q_enforce_visitor_limits(spark, sf_dir):
    """Registrations of each tenant in order against its plan's visitor limit;
    every fourth visitor cancels 90 days later."""
    d = dom(spark, sf_dir)
    v = d.visitors.select("tenant_id", "visitor_id", "registered_at")
    events = v.select("tenant_id", "visitor_id", F.col("registered_at").alias("at"), F.lit("register").alias("action")).unionByName(
        v.where(F.col("visitor_id") % 4 == 0).select("tenant_id", "visitor_id", plus_days(F.col("registered_at"), 90).alias("at"), F.lit("cancel").alias("action")))
    plan = billing.latest_subscription(d.subscriptions, d.plans).select(
        "tenant_id", F.col("max_visitors_per_event").alias("limit"), (F.col("tenant_id") % 3 * 150).alias("used"))
    return limits.enforce_limits(events, plan, ["tenant_id"], ["at", "visitor_id", "action"])


@query("sql_subscription_of")
def q_sql_subscription_of(spark, sf_dir):
    """The table function called for each tenant."""
    sql_functions.register_functions(dom(spark, sf_dir), AS_OF_SUBS)
    return spark.sql("SELECT t.tenant_id, s.* FROM tenants t, LATERAL subscription_of(t.tenant_id) s")


@query("sql_usage_of")
def q_sql_usage_of(spark, sf_dir):
    sql_functions.register_functions(dom(spark, sf_dir), AS_OF_SUBS)
    return spark.sql("SELECT t.tenant_id, u.* FROM tenants t, LATERAL usage_of(t.tenant_id) u")


@query("sql_within_limit")
def q_sql_within_limit(spark, sf_dir):
    """The scalar function called for each staff member and limit."""
    sql_functions.register_functions(dom(spark, sf_dir), AS_OF_SUBS)
    return spark.sql("""SELECT user_id, within_limit(tenant_id, 'events') AS events, within_limit(tenant_id, 'users') AS users,
                               within_limit(tenant_id, 'other') AS other FROM staff""")


def _quote(plans, d):
    q = billing.payment_quote(plans, d.payments.select("order_id", "plan_id", "billing_period",
                                                       "provider"))
    return q.select("order_id", "plan_id", "billing_period", "provider",
                    F.col("amount_idr").cast("double").alias("amount_idr"), "provider_amount")


@query("payment_quote")
def q_payment_quote(spark, sf_dir):
    d = dom(spark, sf_dir)
    return _quote(d.plans, d)


@query("payment_quote_repriced")
def q_payment_quote_repriced(spark, sf_dir):
    d = dom(spark, sf_dir)
    return _quote(billing.reprice_plans(d.plans, seeds.idr_prices(spark)), d)


@query("map_payment_status")
def q_map_payment_status(spark, sf_dir):
    return billing.map_payment_status(dom(spark, sf_dir).webhooks)


@query("apply_payments")
def q_apply_payments(spark, sf_dir):
    d = dom(spark, sf_dir)
    notices = billing.map_payment_status(d.webhooks)
    return billing.apply_payment_notices(d.payments, notices).select(
        "order_id", "tenant_id", "status", "updated_at", "raw_response")


def raw_notices(d):
    """The provider notices with what a provider may send one day: a bank channel
    that no schema knows, cut bodies, arrays, a provider without a reader, and
    bodies without an order."""
    n = F.col("notice_id")
    body, more = F.col("body"), F.concat(F.lit(',"channel":{"bank":"bank'), (n % 5).cast("string"), F.lit('","tries":'), (n % 3).cast("string"), F.lit("}}"))
    cut = F.substring(body, F.lit(1), F.length(body) - 1)
    body = (F.when(n % 11 == 0, cut).when(n % 13 == 0, F.concat(F.lit("["), body, F.lit("]"))).when(n % 17 == 0, F.lit('{"status":"PAID"}'))
             .when(n % 4 == 1, F.concat(cut, more)).otherwise(body))
    return d.webhooks.select("notice_id", F.when(n % 19 == 0, "stripe").otherwise(F.col("provider")).alias("provider"), "received_at", body.alias("body"),
                             F.concat(F.lit('{"x-callback-token":"t'), (n % 7).cast("string"), F.lit('"}')).alias("headers"))


def _notice_log(spark, sf_dir):
    path = rio.scratch_path(spark, "notices")
    notices.append(raw_notices(dom(spark, sf_dir)), path)
    return notices.read_log(spark, path)


@query("notice_log")
def q_notice_log(spark, sf_dir):
    """Every notice as logged: usable ones by their paths, failed ones with the
    answer, the error and the text that came."""
    return _notice_log(spark, sf_dir).select(
        "notice_id", "provider", "received_at", "order_id", "tenant_id", "status_code", "error_message", "raw_body",
        F.try_variant_get("payload", "$.channel.bank", "string").alias("bank"),
        F.try_variant_get("headers", "$['x-callback-token']", "string").alias("token"))


@query("notice_fields")
def q_notice_fields(spark, sf_dir):
    """The fields that each provider's payloads hold, known to a reader or not."""
    return notices.fields_in_use(_notice_log(spark, sf_dir))


@query("apply_payments_logged")
def q_apply_payments_logged(spark, sf_dir):
    """Payments after the usable notices of the log."""
    usable = notices.usable(_notice_log(spark, sf_dir)).drop("raw_response")
    return billing.apply_payment_notices(dom(spark, sf_dir).payments, usable).select("order_id", "tenant_id", "status", "updated_at")


def _subscription_base(d):
    return billing.latest_subscription(d.subscriptions, d.plans).select(
        "tenant_id", "subscription_id", "plan_id", "status", "starts_at", "ends_at",
        "billing_email")


@query("upsert_subscriptions")
def q_upsert_subscriptions(spark, sf_dir):
    d = dom(spark, sf_dir)
    notices = billing.map_payment_status(d.webhooks)
    return billing.activate_subscriptions(_subscription_base(d), notices, d.payments)


@query("payment_expiry")
def q_payment_expiry(spark, sf_dir):
    d = dom(spark, sf_dir)
    return billing.payment_expiry(d.payments, AS_OF_PAYMENTS).select(
        "order_id", "tenant_id", "status", "created_at")


# -- registration --------------------------------------------------------------
@query("validate_visitors")
def q_validate_visitors(spark, sf_dir):
    d = dom(spark, sf_dir)
    return registration.validate_rows(d.visitors, "visitors").select(
        "visitor_id", F.array_join("violations", ",").alias("violations"))


@query("validate_events")
def q_validate_events(spark, sf_dir):
    d = dom(spark, sf_dir)
    return registration.validate_rows(d.occasions, "occasions").select(
        "event_id", F.array_join("violations", ",").alias("violations"))


def _broken(df, rules, key):
    return registration.validate_rows(df, rules).select(key, F.array_join("violations", ",").alias("violations"))


@query("validate_tenants")
def q_validate_tenants(spark, sf_dir):
    return _broken(dom(spark, sf_dir).tenants, "tenants", "tenant_id")


@query("validate_categories")
def q_validate_categories(spark, sf_dir):
    """The categories that visitors use."""
    d = dom(spark, sf_dir)
    used = reports.used_categories(d.categories, d.visitors)
    return _broken(used, "categories", "category_id")


@query("validate_subscriptions")
def q_validate_subscriptions(spark, sf_dir):
    return _broken(dom(spark, sf_dir).subscriptions, "subscriptions", "subscription_id")


@query("validate_staff")
def q_validate_staff(spark, sf_dir):
    return _broken(dom(spark, sf_dir).staff, "staff", "user_id")


@query("validate_payments")
def q_validate_payments(spark, sf_dir):
    return _broken(dom(spark, sf_dir).payments, "payments", "order_id")


@query("validate_contacts")
def q_validate_contacts(spark, sf_dir):
    d = dom(spark, sf_dir)
    return registration.validate_rows(d.contacts, "contacts").select(
        "doc_id", "nth", F.array_join("violations", ",").alias("violations"))


@query("unique_visitors")
def q_unique_visitors(spark, sf_dir):
    return registration.uniqueness_violations(dom(spark, sf_dir).visitors, "visitors")


@query("unique_staff")
def q_unique_staff(spark, sf_dir):
    return registration.uniqueness_violations(dom(spark, sf_dir).staff, "staff")


@query("unique_events")
def q_unique_events(spark, sf_dir):
    return registration.uniqueness_violations(dom(spark, sf_dir).occasions, "occasions")


@query("unique_payment_settings")
def q_unique_payment_settings(spark, sf_dir):
    """One settings row per tenant and provider: the providers that a tenant's
    payments used, one row per billing period, so repeats show."""
    used = dom(spark, sf_dir).payments.select("tenant_id", "provider", "billing_period").distinct()
    return registration.uniqueness_violations(used, "payment_settings")


@query("unique_categories")
def q_unique_categories(spark, sf_dir):
    """One category row per tenant and code: the categories that the visitors of
    each event chose, one row per event, so repeats show."""
    d = dom(spark, sf_dir)
    chosen = d.visitors.select("tenant_id", "event_id", "category_id").distinct()
    return registration.uniqueness_violations(chosen.join(d.categories.select("category_id", "code"), "category_id"), "categories")


@query("admit_checkins_by_tenant")
def q_admit_checkins_by_tenant(spark, sf_dir):
    """Scans carry the scanning staff member's tenant; both lookups test it."""
    d = dom(spark, sf_dir)
    by = d.staff.select(F.col("user_id").alias("checked_in_by"), "tenant_id")
    c = d.checkins.join(by, "checked_in_by", "left")
    requests = c.where(~F.col("is_stored")).select(
        F.col("checkin_id").alias("request_id"), "tenant_id", "visitor_id", F.col("checkin_time").alias("scan_time"))
    return registration.admit_checkins(requests, d.visitors, c.where(F.col("is_stored")),
                                       keys=("tenant_id", "visitor_id")).select(
        "request_id", "tenant_id", "visitor_id", "event_id", "decision", "reason")


@query("admit_checkins")
def q_admit_checkins(spark, sf_dir):
    d = dom(spark, sf_dir)
    c = d.checkins
    stored = c.where(F.col("is_stored"))
    requests = c.where(~F.col("is_stored")).select(
        F.col("checkin_id").alias("request_id"), "visitor_id",
        F.col("checkin_time").alias("scan_time"), "gate_number")
    return registration.admit_checkins(requests, d.visitors, stored).select(
        "request_id", "visitor_id", "event_id", "scan_time", "decision", "reason")


@query("assign_codes")
def q_assign_codes(spark, sf_dir):
    d = dom(spark, sf_dir)
    v = d.visitors
    cutoff = F.lit(CODE_CUTOFF).cast("timestamp_ntz")
    existing = v.where(F.col("registered_at") < cutoff)
    new = v.where(F.col("registered_at") >= cutoff) \
        .withColumn("registration_code", F.lit(None).cast("string"))
    return registration.assign_codes(new, existing, d.categories, style="saas",
                                     as_of=CODE_YEAR_OF).select(
        "visitor_id", "tenant_id", "category_id", "registration_code")


@query("assign_codes_single")
def q_assign_codes_single(spark, sf_dir):
    """The single-tenant style over all visitors, whose codes are taken away."""
    d = dom(spark, sf_dir)
    v = d.visitors.withColumn("registration_code", F.lit(None).cast("string"))
    return registration.assign_codes(v, v.limit(0), d.categories, style="single").select(
        "visitor_id", "category_id", "registration_code")


@query("assign_codes_arriving")
def q_assign_codes_arriving(spark, sf_dir):
    """Codes given as visitors arrive: three streams one after another into one
    log. Those before the cutoff, and every third later one, bring their code."""
    static = dom(spark, sf_dir)
    v = Domain(spark, sf_dir, streamed=["orders"]).visitors
    at = F.col("registered_at")
    cutoff, later = (F.lit(x).cast("timestamp_ntz") for x in (CODE_CUTOFF, CODE_LATER))
    brings = (at < cutoff) | (F.col("visitor_id") % 3 == 0)
    v = v.withColumn("registration_code", F.when(brings, F.col("registration_code")))
    log = numbering.CodeLog(spark, rio.scratch_path(spark, "codes"), static.categories)
    for name, part in (("stored", at < cutoff), ("next", (at >= cutoff) & (at < later)), ("last", at >= later)):
        run_foreach_batch(v.where(part), f"codes_{name}", log.handler(name))
    return log.codes().select("visitor_id", "tenant_id", "category_id", "registration_code")


@query("dedupe_registrations")
def q_dedupe_registrations(spark, sf_dir):
    d = dom(spark, sf_dir)
    return registration.dedupe_registrations(d.visitors).select(
        "visitor_id", "kept", "duplicate_of")


@query("dedupe_registrations_global")
def q_dedupe_registrations_global(spark, sf_dir):
    d = dom(spark, sf_dir)
    return registration.dedupe_registrations(d.visitors, keys=("email",)).select(
        "visitor_id", "kept", "duplicate_of")


@query("ticket_checksum")
def q_ticket_checksum(spark, sf_dir):
    d = dom(spark, sf_dir)
    return registration.ticket_payload(d.visitors, d.categories, TICKET_KEY, CODE_AS_OF) \
        .select("visitor_id", "registration_code", "checksum")


@query("ticket_verify")
def q_ticket_verify(spark, sf_dir):
    d = dom(spark, sf_dir)
    t = registration.ticket_payload(d.visitors, d.categories, TICKET_KEY, CODE_AS_OF)
    return registration.verify_tickets(t, TICKET_KEY).groupBy("valid") \
        .agg(F.count(F.lit(1)).alias("tickets"))


# -- tenancy and contacts --------------------------------------------------------
@query("resolve_tenant")
def q_resolve_tenant(spark, sf_dir):
    d = dom(spark, sf_dir)
    directory = d.tenants.select("tenant_id", "slug", "subdomain", "custom_domain", "is_active") \
        .unionByName(d.sites.select("tenant_id", "slug", "subdomain", "custom_domain", "is_active"))
    return tenancy.resolve_tenant(d.requests, directory).select(
        "request_id", "host", "path", "tenant_id", "resolved_by", "path_without_tenant")


@query("normalize_contacts")
def q_normalize_contacts(spark, sf_dir):
    d = dom(spark, sf_dir)
    c = d.contacts.where(F.col("email").isNotNull() | F.col("phone").isNotNull())
    return tenancy.normalize_contacts(c)


# -- table changes ------------------------------------------------------------------
@query("insert_ignore")
def q_insert_ignore(spark, sf_dir):
    d = dom(spark, sf_dir)
    v = d.visitors.select("visitor_id", "tenant_id", "event_id", "email", "registered_at")
    cutoff = F.lit(REGISTRATION_CUTOFF).cast("timestamp_ntz")
    return changes.insert_ignore(v.where(F.col("registered_at") < cutoff),
                                 v.where(F.col("registered_at") >= cutoff),
                                 key=["tenant_id", "event_id", "email"],
                                 order_by=["registered_at", "visitor_id"])


@query("apply_patch")
def q_apply_patch(spark, sf_dir):
    d = dom(spark, sf_dir)
    base = d.staff.select("user_id", "tenant_id", "login_count",
                          F.lit(None).cast("timestamp_ntz").alias("last_login"))
    logins = (d.request_log.where(F.col("route") == "auth")
              .groupBy(F.col("client").alias("user_id"))
              .agg(F.count(F.lit(1)).cast("int").alias("login_count"),
                   F.max("ts").alias("last_login")))
    return changes.apply_patch(base, logins, "user_id", PATCH_AS_OF, add_cols=["login_count"])


def _purged(spark, sf_dir):
    d = dom(spark, sf_dir)
    gone = d.tenants.where(~F.col("is_active")).select("tenant_id")
    return changes.purge({"visitors": d.visitors, "checkins": d.checkins}, gone,
                         children={"checkins": ("visitors", "visitor_id", "visitor_id")})


@query("purge_whole_tenant")
def q_purge_whole_tenant(spark, sf_dir):
    """Every tenant-owned table after inactive tenants are erased: the key of
    each row that stays, by table."""
    d = dom(spark, sf_dir)
    gone = d.tenants.where(~F.col("is_active")).select("tenant_id")
    settings = d.payments.select("tenant_id", "provider").distinct() \
        .withColumn("setting", F.concat_ws("-", "tenant_id", "provider"))
    owned = {"tenants": (d.tenants, "tenant_id"), "events": (d.occasions, "event_id"), "staff": (d.staff, "user_id"),
             "subscriptions": (d.subscriptions, "subscription_id"), "visitors": (d.visitors, "visitor_id"),
             "payments": (d.payments, "order_id"), "payment_settings": (settings, "setting"),
             "activity": (d.request_log, "request_id"), "checkins": (d.checkins, "checkin_id")}
    left = changes.purge({k: v for k, (v, _) in owned.items()}, gone,
                         children={"checkins": ("visitors", "visitor_id", "visitor_id")})
    out = None
    for name, (_, key) in owned.items():
        some = left[name].select(F.lit(name).alias("table_name"), F.col(key).cast("string").alias("row_key"))
        out = some if out is None else out.unionByName(some)
    return out


@query("purge_visitors")
def q_purge_visitors(spark, sf_dir):
    return _purged(spark, sf_dir)["visitors"].select("visitor_id", "tenant_id", "event_id")


@query("purge_checkins")
def q_purge_checkins(spark, sf_dir):
    return _purged(spark, sf_dir)["checkins"].select("checkin_id", "visitor_id")


# -- logs ---------------------------------------------------------------------------
@query("request_kpis")
def q_request_kpis(spark, sf_dir):
    return logs.request_kpis(dom(spark, sf_dir).request_log, by=["route"])


@query("scanner_stats")
def q_scanner_stats(spark, sf_dir):
    return logs.scanner_stats(dom(spark, sf_dir).scans, by=["scanner"])


@query("rate_limit_hits")
def q_rate_limit_hits(spark, sf_dir):
    return logs.rate_limit_hits(dom(spark, sf_dir).request_log, key="tenant_id", window="1 day")


@query("client_windows")
def q_client_windows(spark, sf_dir):
    """Limiter windows that begin with the client's first request; tenants are
    the clients and a day the window, so that limits are passed."""
    return windows.client_windows(dom(spark, sf_dir).request_log, key="tenant_id", window="1 day")


@query("client_windows_all")
def q_client_windows_all(spark, sf_dir):
    """All windows of 15 minutes of each client and route."""
    return windows.client_windows(dom(spark, sf_dir).request_log, only_over=False)


def access_lines(d):
    """Proxy access-log lines rendered from the request log."""
    r = d.request_log
    ms = F.floor("duration_ms").cast("long")
    rt = F.concat((ms / 1000).cast("long").cast("string"), F.lit("."),
                  F.lpad((ms % 1000).cast("string"), 3, "0"))
    line = F.concat(
        F.lit("10.0."), (F.col("client") % 256).cast("string"), F.lit("."),
        (F.col("request_id") % 256).cast("string"), F.lit(" - - ["),
        F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0000] \"GET "), F.col("path"),
        F.lit(" HTTP/1.1\" "), F.col("status").cast("string"), F.lit(" "),
        (F.col("request_id") % 5000).cast("string"),
        F.lit(" \"-\" \"Mozilla/5.0\" \"-\" rt="), rt,
        F.lit(" uct=\"0.000\" uht=\"0.001\" urt=\""), rt, F.lit("\""))
    bad = (F.col("status") == 500) & (F.col("client") % 7 == 0)
    return r.select(F.col("request_id"),
                    F.when(bad, F.concat(F.lit("garbage "), F.col("request_id").cast("string")))
                     .otherwise(line).alias("value"))


@query("parse_access_log")
def q_parse_access_log(spark, sf_dir):
    d = dom(spark, sf_dir)
    return logs.parse_access_log(access_lines(d)).drop("line")


def activity(d):
    """Audit rows rendered from the event stream: each event edits the
    user's record; old and new values are JSON objects."""
    e = d.table("events")
    k = F.get_json_object("props", "$.k").cast("int")
    et = F.col("event_type")
    new = (F.when(et == "click", F.col("props"))
            .when(et == "view", F.concat(F.lit('{"k": '), (k + 1).cast("string"), F.lit("}")))
            .when(et == "purchase", F.concat(F.lit('{"k": '), k.cast("string"),
                                             F.lit(', "paid": "yes"}')))
            .when(et == "signup", F.lit("{}"))
            .otherwise(F.lit('{"k": null}')))
    return e.select(et.alias("action"), F.lit("user").alias("entity_type"),
                    F.col("user_id").alias("entity_id"), F.col("props").alias("old_values"),
                    new.alias("new_values"))


@query("audit_changes")
def q_audit_changes(spark, sf_dir):
    d = dom(spark, sf_dir)
    return logs.audit_counts(logs.audit_changes(activity(d)))


@query("audit_versions")
def q_audit_versions(spark, sf_dir):
    """Field changes between an earlier version of the visitors and today's, from
    the buckets whose digests differ."""
    v, k = dom(spark, sf_dir).visitors.select("visitor_id", "tenant_id", "email", "status"), F.col("visitor_id")
    earlier = v.where(k % 97 != 1).withColumns({
        "email": F.when(k % 103 != 5, F.col("email")), "status": F.when(k % 101 == 3, "registered").otherwise(F.col("status"))})
    table = versions.VersionedTable(spark, rio.scratch_path(spark, "versions"), "visitor_id", buckets=32)
    old, new = table.write(earlier), table.write(v.where(k % 89 != 7))
    return logs.audit_changes(table.audit(old, new, v.schema, "visitor"))


# -- sources and sinks -----------------------------------------------------------

NTZ_JSON = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


@query("read_json_events")
def q_read_json_events(spark, sf_dir):
    """Request-log JSON lines rendered from the events table (some lines
    malformed), written to the shared folder and read back with the
    declared schema."""
    d = dom(spark, sf_dir)
    r = d.request_log
    body = F.to_json(F.struct(
        F.lit("GET").alias("method"), F.col("path").alias("url"), F.col("status"),
        F.concat(F.floor("duration_ms").cast("long").cast("string"), F.lit("ms")).alias("duration"),
        F.concat(F.lit("10.0.0."), (F.col("client") % 256).cast("string")).alias("ip"),
        F.lit("Mozilla/5.0").alias("userAgent"), F.col("tenant_id").cast("string").alias("tenantId"),
        F.col("ts").alias("timestamp")), {"timestampNTZFormat": NTZ_JSON})
    bad = (F.col("status") == 500) & (F.col("client") % 7 == 0)
    line = F.when(bad, F.concat(F.lit('{"method": "GET", "url": broken '),
                                F.col("request_id").cast("string"))).otherwise(body)
    path = rio.scratch_path(spark, "json_events")
    r.select(line.alias("value")).write.text(path)
    ev = rio.read_json_events(spark, path, rio.REQUEST_LOG_SCHEMA)
    return ev.select("method", "url", "status", rio.duration_ms().alias("duration_ms"),
                     F.col("tenantId").cast("int").alias("tenant_id"), "timestamp",
                     F.col(rio.CORRUPT).isNotNull().alias("is_corrupt"))


@query("export_csv")
def q_export_csv(spark, sf_dir):
    """Event stats exported as CSV, one folder per tenant, read back."""
    d = dom(spark, sf_dir)
    stats = reports.event_stats(d.occasions, d.visitors, d.categories)
    path = rio.export_csv(stats, rio.scratch_path(spark, "export"), partition_by="tenant_id")
    schema = ("event_id BIGINT, total_visitors BIGINT, registered_count BIGINT, "
              "checked_in_count BIGINT, vip_count BIGINT, sponsor_count BIGINT, "
              "speaker_count BIGINT, participant_count BIGINT, tenant_id INT")
    return spark.read.schema(schema).option("header", True).csv(path)


@query("refresh_snapshot")
def q_refresh_snapshot(spark, sf_dir):
    """Tenant analytics rebuilt and swapped in (key tenant + plan), then read
    through the pointer."""
    d = dom(spark, sf_dir)
    ta = reports.tenant_analytics(d.tenants, d.subscriptions, d.plans, d.occasions,
                                  d.visitors, d.checkins, d.staff)
    root = rio.scratch_path(spark, "snapshots", "tenant_analytics")
    rio.refresh_snapshot(ta, root, key=["tenant_id", "plan_name"])
    return rio.current_snapshot(spark, root)


@query("refresh_incremental")
def q_refresh_incremental(spark, sf_dir):
    """Tenant analytics loaded from an earlier state of the tables and brought
    to today's by two refreshes that read the changed rows alone: inserts,
    updates and deletes of every table. The result is the full report."""
    d = dom(spark, sf_dir)
    tables = {"tenants": (d.tenants, "tenant_id"), "events": (d.occasions, "event_id"), "visitors": (d.visitors, "visitor_id"),
              "staff": (d.staff, "user_id"), "subscriptions": (d.subscriptions, "subscription_id"),
              "checkins": (d.checkins.join(d.visitors.select("visitor_id", "tenant_id"), "visitor_id"), "visitor_id")}
    earlier = {"tenants": {"is_active": F.lit(True), "name": F.concat(F.lit("old "), "name")}, "visitors": {"status": F.lit("registered")},
               "staff": {"is_active": ~F.col("is_active")}, "subscriptions": {"status": F.lit("active")}}
    first, second, third = {}, {}, {}
    for name, (t, key) in tables.items():
        k = F.col(key) % 10
        inserted, updated, doomed = k == 1, (k == 3) & F.lit(name in earlier), k == 7
        older = t.withColumns(earlier.get(name, {}))
        gone = (older if name != "tenants" else older.withColumn(key, F.lit(1000) + F.col(key))).where(doomed)
        first[name] = incremental.signed(t.where(~inserted & ~updated).unionByName(older.where(updated)).unionByName(gone), 1)
        second[name] = incremental.signed(t.where(inserted), 1).unionByName(incremental.signed(gone, -1))
        third[name] = incremental.signed(older.where(updated), -1).unionByName(incremental.signed(t.where(updated), 1))
    view = incremental.AnalyticsView(spark, rio.scratch_path(spark, "analytics"))
    for step in (first, second, {k: v for k, v in third.items() if k in earlier}):
        view.refresh(step, d.plans)
    return view.read()


# -- streams (availableNow over files derived from the tables) ------------------
STREAM_DELAY = "1 day"
# When the payment feeds are taken to have ended.
FEED_END = "2100-01-01 00:00:00"


def _ntz(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


def _scans(spark, sf_dir):
    """The check-ins as a stream of scans, read from the table's own files."""
    c = Domain(spark, sf_dir, streamed=["lineitem"]).checkins
    return live.event_time(c.select(F.col("checkin_id").alias("request_id"), "visitor_id",
                                    F.col("checkin_time").alias("scan_time")), "scan_time")


@query("live_dashboard_stream")
def q_live_dashboard_stream(spark, sf_dir):
    counts = run_updates(live.live_counts(_scans(spark, sf_dir), window="1 day", delay=STREAM_DELAY),
                         "live_counts", ["window_start", "window_end", "visitor_id"])
    res = live.live_dashboard(counts, dom(spark, sf_dir).visitors, by=["category_id"])
    return _ntz(res, "window_start", "window_end")


@query("running_totals_stream")
def q_running_totals_stream(spark, sf_dir):
    totals = live.running_totals(_scans(spark, sf_dir), dom(spark, sf_dir).visitors)
    return run_updates(totals, "running_totals", ["event_id", "category_id"])


@query("rate_limit_stream")
def q_rate_limit_stream(spark, sf_dir):
    log = live.event_time(Domain(spark, sf_dir, streamed=["events"]).request_log, "ts")
    out = live.rate_limit_stream(log, key="tenant_id", window="1 day", delay=STREAM_DELAY)
    return _ntz(run_updates(out, "rate_limit", ["window_start", "window_end", "tenant_id", "route"]),
                "window_start", "window_end")


@query("checkin_stream")
def q_checkin_stream(spark, sf_dir):
    """Watermark admission: one admitted scan per known visitor."""
    out = live.checkin_stream(_scans(spark, sf_dir), dom(spark, sf_dir).visitors, delay="3650 days")
    return spark.read.parquet(run_available_now(out, "checkin")).select("visitor_id", "event_id", "tenant_id")


@query("checkin_stream_keyed")
def q_checkin_stream_keyed(spark, sf_dir):
    """All-time admission with keyed state: the stored check-ins are the first
    state, the new scans arrive as a stream."""
    d = dom(spark, sf_dir)
    c = Domain(spark, sf_dir, streamed=["lineitem"]).checkins.where(~F.col("is_stored"))
    scans = c.select(F.col("checkin_id").alias("request_id"), "visitor_id", F.col("checkin_time").alias("scan_time"))
    stored = d.checkins.where(F.col("is_stored")).select("visitor_id")
    out = run_available_now(admission.keyed_admission(scans, stored), "admission", keyed_state=True)
    changes_ = spark.read.schema(admission.CHANGES).parquet(out)
    return admission.current_decisions(changes_, d.visitors).select("request_id", "visitor_id", "event_id", "decision", "reason")


@query("checkin_stream_exact")
def q_checkin_stream_exact(spark, sf_dir):
    """Exact live admission run incrementally: the stored scans arrive first
    (one availableNow run), the new scans later (a second stream); each
    micro-batch is decided against all earlier accepts."""
    d = dom(spark, sf_dir)
    decisions = rio.scratch_path(spark, "streams", "decisions")
    for stored in (True, False):
        c = Domain(spark, sf_dir, streamed=["lineitem"]).checkins.where(F.col("is_stored") == stored)
        scans = c.select(F.col("checkin_id").alias("request_id"), "visitor_id", F.col("checkin_time").alias("scan_time"))
        handler = live.exact_admission_batch(d.visitors, decisions, "stored" if stored else "new")
        run_foreach_batch(scans, "exact", handler)
    return live.read_decisions(spark, decisions).select("request_id", "visitor_id", "event_id", "decision", "reason")


@query("mark_checked_in")
def q_mark_checked_in(spark, sf_dir):
    """Visitor status after admitting the new scans against the stored ones."""
    d = dom(spark, sf_dir)
    c = d.checkins
    requests = c.where(~F.col("is_stored")).select(
        F.col("checkin_id").alias("request_id"), "visitor_id", F.col("checkin_time").alias("scan_time"))
    decisions = registration.admit_checkins(requests, d.visitors, c.where(F.col("is_stored")))
    return registration.mark_checked_in(d.visitors.select("visitor_id", "tenant_id", "status"),
                                        decisions, PATCH_AS_OF)


@query("payment_expiry_stream")
def q_payment_expiry_stream(spark, sf_dir):
    """Pending payments and provider notices as two streams; what no final
    notice settles within 24 h of creation expires: from the stream where the
    watermark (1 h delay, the minimum over both inputs) has passed, from the
    flush at the end of the feed for the rest."""
    def feeds(d):
        pays = live.event_time(d.payments.select("order_id", "tenant_id", "created_at", "status"), "created_at")
        notes = live.event_time(billing.map_payment_status(d.webhooks)
                                .select("order_id", "received_at", "notice_id", "payment_status"), "received_at")
        return pays, notes
    out = live.payment_expiry_stream(*feeds(Domain(spark, sf_dir, streamed=["orders"])), hours=24, delay="1 hour")
    emitted = spark.read.parquet(run_available_now(out, "payment_expiry"))
    pays, notes = feeds(dom(spark, sf_dir))
    end = F.lit(FEED_END).cast("timestamp")
    return _ntz(emitted.unionByName(live.payment_expiry_rest(pays, notes, emitted, end, hours=24)), "created_at")


@query("recent_checkins_per_scanner")
def q_recent_checkins_per_scanner(spark, sf_dir):
    d = dom(spark, sf_dir)
    return reports.recent_checkins_per_scanner(d.checkins, d.visitors, d.staff, n=5).select(
        "checked_in_by", "rank", "checkin_id", "visitor_id", "checkin_time", "first_name",
        "last_name", "registration_code", "checked_in_by_name")


@query("request_quantiles")
def q_request_quantiles(spark, sf_dir):
    """Weekly quantiles of every route from stored hourly sketches, and whether
    their ranks in the whole log are within the stated error."""
    d, qs, by = dom(spark, sf_dir), (0.5, 0.95, 0.99), ["route", "week"]
    path = rio.scratch_path(spark, "sketches")
    quantiles.append(d.request_log, path)

    def weekly(df, ts):
        return df.withColumn("week", F.window(ts, "7 days", startTime="4 days").getField("start"))    # from Monday

    found = quantiles.quantiles(weekly(spark.read.parquet(path), "hour"), by, qs)
    off = quantiles.rank_errors(weekly(d.request_log, "ts"), found, by, qs)
    ok = [(F.col(c) <= quantiles.RANK_ERROR).alias(f"{c}_ok") for c in ("p50", "p95", "p99")]
    return found.select(*by, "requests").join(off.select(*by, *ok), by, "left")


@query("request_kpis_by_tenant")
def q_request_kpis_by_tenant(spark, sf_dir):
    return logs.request_kpis(dom(spark, sf_dir).request_log, by=["tenant_id"])


@query("cancel_payments")
def q_cancel_payments(spark, sf_dir):
    """Every yearly payment gets a cancel request from its tenant; only the
    pending ones may be cancelled, the rest are rejected."""
    d = dom(spark, sf_dir)
    requests = d.payments.where(F.col("billing_period") == "yearly").select("order_id", "tenant_id")
    return billing.cancel_payments(d.payments, requests, PATCH_AS_OF).select(
        "order_id", "tenant_id", "status", "cancel_result", "cancelled_at")
