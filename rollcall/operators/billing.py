"""Plans, subscriptions and payments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.payments import payment_status, provider_amount, quote_amount
from ..functions.scalars import js_month_shift, plus_hours, ts_ntz
from .common import nulls_high, pick_per_group


def _as_of(as_of):
    """A point in time: 'YYYY-MM-DD HH:MM:SS' text, a Column, or None for now."""
    if as_of is None:
        return F.localtimestamp()
    return ts_ntz(as_of) if isinstance(as_of, str) else as_of


# O10 ---------------------------------------------------------------------
def active_subscriptions(subs: DataFrame, as_of=None) -> DataFrame:
    """status = 'active' and not yet ended at ``as_of``."""
    now = _as_of(as_of)
    return subs.where((F.col("status") == "active")
                      & (F.col("ends_at").isNull() | (F.col("ends_at") > now)))


# O27 ---------------------------------------------------------------------
def latest_subscription(subs: DataFrame, plans: DataFrame, as_of=False) -> DataFrame:
    """Newest active subscription per tenant with its plan limits. By default
    the end date is not tested (as the app's lookup does); with ``as_of`` (a
    time, or None for now) O10's test is applied first (as the limit check
    does). Newest = created
    last, NULL created first (PostgreSQL DESC), ties to the larger id."""
    active = subs.where(F.col("status") == "active") if as_of is False \
        else active_subscriptions(subs, as_of)
    carry = ["subscription_id", "plan_id", "status", "starts_at", "ends_at", "created_at",
             "billing_email"]
    carry = [c for c in carry if c in subs.columns]
    latest = pick_per_group(active, ["tenant_id"],
                            [nulls_high(F.col("created_at")), F.col("subscription_id")], carry)
    p = (plans.select("plan_id", F.col("name").alias("plan_name"),
                                 F.col("slug").alias("plan_slug"), "max_events",
                                 "max_visitors_per_event", "max_admin_users", "features",
                                 F.col("price").alias("plan_price")))
    return latest.join(p, "plan_id", "inner")


# O12 ---------------------------------------------------------------------
def reprice_plans(plans: DataFrame, prices: DataFrame) -> DataFrame:
    """Set price, currency IDR and features for the listed slugs only."""
    pr = (prices.select("slug", F.col("price").alias("_price"),
                                   F.col("features").alias("_features")))
    hit = F.col("_price").isNotNull()
    out = plans.join(pr, "slug", "left")
    return out.select(
        *[F.when(hit, F.col("_price")).otherwise(F.col("price")).cast("decimal(10,2)").alias("price")
          if c == "price" else
          F.when(hit, F.lit("IDR")).otherwise(F.col("currency")).alias("currency")
          if c == "currency" else
          F.when(hit, F.col("_features")).otherwise(F.col("features")).alias("features")
          if c == "features" else F.col(c)
          for c in plans.columns])


# O18 ---------------------------------------------------------------------
def subscription_with_last_payment(subs: DataFrame, plans: DataFrame,
                                   payments: DataFrame) -> DataFrame:
    """Per tenant: newest active subscription, its plan, and the latest
    successful payment (ties on time broken by the larger order id)."""
    sub = latest_subscription(subs, plans)
    paid = pick_per_group(payments.where(F.col("status") == "success"), ["tenant_id"],
                          [nulls_high(F.col("created_at")), F.col("order_id")],
                          ["created_at", "amount", "provider"])
    paid = paid.select("tenant_id", F.col("created_at").alias("last_payment_date"),
                       F.col("amount").alias("last_payment_amount"),
                       F.col("provider").alias("last_payment_provider"))
    return sub.join(paid, "tenant_id", "left").select(
        "tenant_id", "subscription_id", "plan_name", "plan_slug",
        F.col("plan_price").cast("double").alias("plan_price"), "status", "starts_at", "ends_at",
        "last_payment_date", "last_payment_amount", "last_payment_provider",
        F.col("ends_at").alias("next_billing_date"))


# O24 ---------------------------------------------------------------------
def plan_usage(tenants: DataFrame, subs: DataFrame, plans: DataFrame, events: DataFrame,
               staff: DataFrame, visitors: DataFrame, as_of=None) -> DataFrame:
    """Usage against the current plan's limits, three rows per tenant:
    events (all the tenant's events), users (active staff) and
    visitors_per_event (the tenant's largest event). ``allowed`` is
    usage < limit; a tenant with no current plan is never allowed."""
    plan = latest_subscription(subs, plans, as_of=as_of).select(
        "tenant_id", "max_events", "max_admin_users", "max_visitors_per_event")
    t = tenants.select("tenant_id").join(plan, "tenant_id", "left")
    ev = events.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("usage"))
    users = staff.where(F.col("is_active")).groupBy("tenant_id") \
        .agg(F.count(F.lit(1)).alias("usage"))
    per_event = visitors.groupBy("tenant_id", "event_id").agg(F.count(F.lit(1)).alias("n"))
    biggest = per_event.groupBy("tenant_id").agg(F.max("n").alias("usage"))

    def branch(kind: str, usage: DataFrame, limit_col: str) -> DataFrame:
        u = F.coalesce(F.col("usage"), F.lit(0).cast("long"))
        lim = F.col(limit_col).cast("long")
        return t.join(usage, "tenant_id", "left").select(
            "tenant_id", F.lit(kind).alias("limit_type"), u.alias("usage"),
            lim.alias("limit_value"),
            F.coalesce(u < lim, F.lit(False)).alias("allowed"))

    return (branch("events", ev, "max_events")
            .unionByName(branch("users", users, "max_admin_users"))
            .unionByName(branch("visitors_per_event", biggest, "max_visitors_per_event")))


# O39 ---------------------------------------------------------------------
def payment_quote(plans: DataFrame, requests: DataFrame) -> DataFrame:
    """Amount to charge per request (plan_id, billing_period, provider):
    yearly = 12 months at 80 %, USD converted to IDR, the provider amount
    rounded half-up to whole units."""
    p = (plans.where(F.col("is_active"))
                    .select("plan_id", "price", "currency", F.col("name").alias("plan_name")))
    out = requests.join(p, "plan_id", "inner")
    period = F.coalesce(F.col("billing_period"), F.lit("monthly"))
    amount = quote_amount("price", "currency", period, "provider")
    return out.withColumn("amount_idr", amount) \
              .withColumn("provider_amount", provider_amount(F.col("amount_idr")))


# O40 ---------------------------------------------------------------------
# Union of both providers' notice bodies; each body is parsed once.
NOTICE_SCHEMA = ("order_id STRING, transaction_status STRING, fraud_status STRING, "
                 "gross_amount STRING, custom_field1 STRING, custom_field2 STRING, "
                 "custom_field3 STRING, external_id STRING, status STRING, amount STRING, "
                 "metadata STRUCT<tenant_id: STRING, plan_id: STRING, billing_period: STRING>, "
                 "id STRING")


def map_payment_status(webhooks: DataFrame, polled: bool = False) -> DataFrame:
    """Normalise provider notices: order id, state, amount, tenant, plan and
    billing period pulled out of each provider's body, and the normalised
    status as the webhook handler (and the status poll) map it."""
    # Through a generator: no filter on a parsed field passes it and takes the parser along, so a body is parsed once.
    body = F.inline_outer(F.array(F.struct(F.from_json("body", NOTICE_SCHEMA).alias("b"))))
    parsed = webhooks.select("notice_id", "provider", "received_at", F.col("body").alias("raw_response"), body)
    first = F.col("provider") == "midtrans"

    def pick(a: str, b: str):
        return F.when(first, F.col(f"b.{a}")).otherwise(F.col(f"b.{b}"))

    fields = parsed.select(
        "notice_id", "provider", "received_at", "raw_response",
        pick("order_id", "external_id").alias("order_id"),
        pick("transaction_status", "status").alias("provider_status"),
        F.when(first, F.col("b.fraud_status")).alias("_fraud"),
        pick("gross_amount", "amount").cast("double").alias("amount"),
        pick("custom_field1", "metadata.tenant_id").cast("int").alias("tenant_id"),
        pick("custom_field2", "metadata.plan_id").cast("int").alias("plan_id"),
        pick("custom_field3", "metadata.billing_period").alias("billing_period"))
    return fields.select(
        "notice_id", "provider", "received_at", "order_id", "provider_status",
        payment_status("provider", "provider_status", "_fraud", polled=polled).alias("payment_status"),
        payment_status("provider", "provider_status", "_fraud", polled=True).alias("polled_status"),
        "amount", "tenant_id", "plan_id", "billing_period", "raw_response")


# O41 ---------------------------------------------------------------------
def latest_notices(notices: DataFrame, carry: Sequence[str] | None = None) -> DataFrame:
    """The last notice per order (by receipt time, then notice id) with the
    ``carry`` columns (all of them by default)."""
    carry = list(carry) if carry is not None else [c for c in notices.columns if c != "order_id"]
    return pick_per_group(notices, ["order_id"],
                          [F.col("received_at"), F.col("notice_id")], carry)


def apply_payment_notices(payments: DataFrame, notices: DataFrame) -> DataFrame:
    """Set each payment's status from its latest notice and stamp updated_at;
    ``raw_response`` is that notice's body where the notices carry one."""
    raw = ["raw_response"] if "raw_response" in notices.columns else []
    last = latest_notices(notices, ["payment_status", "received_at", *raw]).select(
        "order_id", F.col("payment_status").alias("_new"), F.col("received_at").alias("_at"),
        *[F.col(c).alias(f"_{c}") for c in raw])
    out = payments.join(last, "order_id", "left")
    cols = [F.coalesce(F.col("_new"), F.col("status")).alias("status") if c == "status"
            else F.col(c) for c in payments.columns if c not in ("updated_at", *raw)]
    base_updated = F.col("updated_at") if "updated_at" in payments.columns \
        else F.lit(None).cast("timestamp_ntz")
    cols += [F.coalesce(F.col(f"_{c}"), F.col(c) if c in payments.columns else F.lit(None)).alias(c) for c in raw]
    return out.select(*cols, F.coalesce(F.col("_at"), base_updated).alias("updated_at"))


def activate_subscriptions(subs: DataFrame, notices: DataFrame, payments: DataFrame) -> DataFrame:
    """Upsert one subscription per tenant from its latest *successful* notice
    (each success acts when it comes; a later pending or failed notice of the
    order takes nothing back): plan, status 'active', starts at the notice
    time and ends one month (or year) later with JavaScript's day overflow;
    billing e-mail from the payment's customer data and metadata (provider,
    order, billing period) are set only on insert; updated_at on update."""
    ok = latest_notices(notices.where(F.col("payment_status") == "success"),
                        ["received_at", "notice_id", "tenant_id", "plan_id", "billing_period", "provider"])
    months = F.when(F.col("billing_period") == "yearly", F.lit(12)).otherwise(F.lit(1))
    ok = ok.join(payments.select("order_id", F.get_json_object("customer_data", "$.email")
                                 .alias("new_email")), "order_id", "left")
    upd = pick_per_group(ok.withColumn("ends", js_month_shift(F.col("received_at"), months)),
                         ["tenant_id"], [F.col("received_at"), F.col("order_id")],
                         ["plan_id", "received_at", "ends", "new_email", "order_id", "billing_period", "provider"])
    from .changes import upsert
    updates = upd.select(
        "tenant_id", "plan_id", F.lit("active").alias("status"),
        F.col("received_at").alias("starts_at"), F.col("ends").alias("ends_at"),
        F.col("new_email").alias("billing_email"), F.col("received_at").alias("updated_at"),
        F.col("order_id").alias("last_order_id"),
        F.to_json(F.struct("provider", F.col("order_id").alias("orderId"),
                           F.col("billing_period").alias("billingPeriod"))).alias("metadata"))
    return upsert(subs, updates, key=["tenant_id"],
                  set_cols=["plan_id", "status", "starts_at", "ends_at", "updated_at",
                            "last_order_id"],
                  insert_only_cols=["billing_email", "metadata"])


def cancel_payments(payments: DataFrame, cancels: DataFrame, as_of) -> DataFrame:
    """Cancel requested payments of the same tenant; only 'pending' ones may
    be cancelled. Adds ``cancel_result``: cancelled / rejected / NULL."""
    req = cancels.select("order_id", "tenant_id", F.lit(True).alias("_req")).distinct()
    out = payments.join(req, ["order_id", "tenant_id"], "left")
    can = F.col("_req") & (F.col("status") == "pending")
    return out.select(
        *[F.when(can, F.lit("cancelled")).otherwise(F.col("status")).alias("status")
          if c == "status" else F.col(c) for c in payments.columns],
        F.when(can, "cancelled").when(F.col("_req"), "rejected").alias("cancel_result"),
        F.when(can, _as_of(as_of)).alias("cancelled_at"))


# O45 ---------------------------------------------------------------------
def payment_expiry(payments: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """A pending payment created ``hours`` or more before ``as_of`` expires."""
    now = _as_of(as_of)
    due = (F.col("status") == "pending") & (plus_hours(F.col("created_at"), hours) <= now)
    return payments.withColumn("status", F.when(due, "expired").otherwise(F.col("status")))
