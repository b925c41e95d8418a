"""Reporting operators: lookups, listings, joins and counts over the domain
views (O06-O09, O13, O14, O16, O19-O23, O30, O31)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import attendance_status as attendance_label
from ..functions.scalars import percent_2dp
from .common import left_join_keep_fanout

# Category codes counted by the dashboards and their output names.
CODE_COLUMNS = [("VIP", "vip"), ("SPR", "sponsor"), ("SPK", "speaker"), ("PTC", "participant")]


def _category_dim(categories: DataFrame) -> DataFrame:
    # A small dimension: Spark broadcasts it when its size estimate is under
    # the auto-broadcast threshold, and AQE re-checks with measured sizes.
    return (categories.select(
        "category_id",
        F.col("name").alias("category_name"),
        F.col("code").alias("category_code"),
        F.col("color").alias("category_color")))


# O06 ---------------------------------------------------------------------
def tenant_lookup(df: DataFrame, tenant_id=None, **equals) -> DataFrame:
    """Equality filters ANDed with the tenant; every ``findBy*`` is this."""
    cond = F.lit(True)
    if tenant_id is not None:
        cond = cond & (F.col("tenant_id") == F.lit(tenant_id))
    for name, value in equals.items():
        cond = cond & (F.col(name) == F.lit(value))
    return df.where(cond)


# O07 ---------------------------------------------------------------------
def published_events(events: DataFrame, tenant_id=None) -> DataFrame:
    out = events.where(F.col("status").isin("published", "active"))
    if tenant_id is not None:
        out = out.where(F.col("tenant_id") == F.lit(tenant_id))
    return out.orderBy(F.col("event_date").asc_nulls_last(), F.col("event_id"))


# O08 ---------------------------------------------------------------------
def search_visitors(visitors: DataFrame, categories: DataFrame, term: str,
                    event_id=None, tenant_id=None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Case-insensitive substring over names, e-mail and code; ``%`` and
    ``_`` in the term stay wildcards, as in the reference's ILIKE."""
    pattern = f"%{term}%"
    v = visitors
    if event_id is not None:
        v = v.where(F.col("event_id") == F.lit(event_id))
    if tenant_id is not None:
        v = v.where(F.col("tenant_id") == F.lit(tenant_id))
    hit = (F.col("first_name").ilike(pattern) | F.col("last_name").ilike(pattern)
           | F.col("email").ilike(pattern) | F.col("registration_code").ilike(pattern))
    out = v.where(hit).join(_category_dim(categories), "category_id", "left")
    return (out.orderBy(F.col("registered_at").desc_nulls_first(), F.col("visitor_id").asc())
               .offset(offset).limit(limit))


# O09 ---------------------------------------------------------------------
def attendance_status(df: DataFrame) -> DataFrame:
    return df.withColumn("attendance_status", attendance_label("checkin_time", "status"))


# O13 ---------------------------------------------------------------------
def visitor_summary(visitors: DataFrame, categories: DataFrame, events: DataFrame,
                    checkins: DataFrame) -> DataFrame:
    """visitor LEFT JOIN category LEFT JOIN event LEFT JOIN check-in, one row
    per check-in (fan-out kept), with the attendance label."""
    v = visitors.select("visitor_id", "registration_code", "first_name", "last_name", "email",
                        "category_id", "event_id", "status", "registered_at")
    ev = events.select("event_id", "event_name", "event_date")
    v = v.join(_category_dim(categories), "category_id", "left").join(ev, "event_id", "left")
    c = checkins.select("visitor_id", "checkin_id", "checkin_time", "checked_in_by")
    rows = left_join_keep_fanout(v, c, ["visitor_id"])
    return attendance_status(rows)


# O14 ---------------------------------------------------------------------
def visitors_with_category(visitors: DataFrame, categories: DataFrame, checkins: DataFrame,
                           event_id=None, tenant_id=None, status=None, category_id=None,
                           limit: int = 100, offset: int = 0) -> DataFrame:
    """One event's visitors with category and check-in time; optional
    predicates are added only when given; newest registration first.

    A left join drops no visitor and gives each at least one row, so the page
    holds rows of the first ``offset + limit`` visitors only: those are taken
    first, and only their check-ins are looked up."""
    v = visitors
    for name, value in (("event_id", event_id), ("tenant_id", tenant_id),
                        ("status", status), ("category_id", category_id)):
        if value is not None:
            v = v.where(F.col(name) == F.lit(value))
    v = v.orderBy(F.col("registered_at").desc_nulls_first(), F.col("visitor_id").asc()).limit(offset + limit)
    c = checkins.select("visitor_id", "checkin_id", "checkin_time") \
        .join(v.select("visitor_id"), "visitor_id", "left_semi")   # Spark knows the limit: sent whole if that is small
    rows = v.join(c, "visitor_id", "left").join(_category_dim(categories), "category_id", "left")
    return (rows.orderBy(F.col("registered_at").desc_nulls_first(), F.col("visitor_id").asc(),
                         F.col("checkin_id").asc_nulls_first())
                .offset(offset).limit(limit))


# O16 ---------------------------------------------------------------------
def recent_checkins(checkins: DataFrame, visitors: DataFrame, categories: DataFrame,
                    staff: DataFrame, event_id=None, tenant_id=None, n: int = 10) -> DataFrame:
    """The last ``n`` check-ins of known visitors. The visitor only has to
    exist, so a semi join and the top ``n`` come first; names are looked up
    for the ``n`` rows that are left."""
    v = visitors.select("visitor_id", "tenant_id", "event_id", "first_name", "last_name",
                        "registration_code", "category_id")
    if event_id is not None:
        v = v.where(F.col("event_id") == F.lit(event_id))
    if tenant_id is not None:
        v = v.where(F.col("tenant_id") == F.lit(tenant_id))
    cat = (categories.select("category_id", F.col("name").alias("category_name"),
                                        F.col("color").alias("category_color")))
    who = staff.select(F.col("user_id").alias("checked_in_by"),
                       F.col("first_name").alias("checked_in_by_name"))
    last = (checkins.join(v.select("visitor_id"), "visitor_id", "left_semi")
            .orderBy(F.col("checkin_time").desc_nulls_first(), F.col("checkin_id").asc()).limit(n))
    rows = (last.join(v, "visitor_id", "inner")
                .join(cat, "category_id", "left")
                .join(who, "checked_in_by", "left"))
    return (rows.orderBy(F.col("checkin_time").desc_nulls_first(), F.col("checkin_id").asc())
                .limit(n))


def recent_checkins_per_scanner(checkins: DataFrame, visitors: DataFrame, staff: DataFrame,
                                n: int = 5) -> DataFrame:
    """The scanner screen's list: the last ``n`` admitted check-ins of every
    scanning staff member, newest first.

    Written as ``row_number() <= n`` over each scanner; Spark plans it with a
    partial window group limit before the shuffle, so every map task ships
    at most ``n`` rows per scanner and a scanner doing most of the scans
    does not land in one task. Names are joined onto the few kept rows."""
    known = checkins.join(visitors.select("visitor_id"), "visitor_id", "left_semi")
    w = Window.partitionBy("checked_in_by").orderBy(F.col("checkin_time").desc_nulls_first(),
                                                    F.col("checkin_id").asc())
    # The limit filters the row_number column itself (which lets Spark plan
    # the partial group limit); the cast to long comes after it.
    top = (known.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
                .withColumn("rank", F.col("rank").cast("long")))
    v = visitors.select("visitor_id", "first_name", "last_name", "registration_code")
    who = staff.select(F.col("user_id").alias("checked_in_by"),
                       F.col("first_name").alias("checked_in_by_name"))
    return top.join(v, "visitor_id", "inner").join(who, "checked_in_by", "left")


# O19 ---------------------------------------------------------------------
def count_by_tenant(df: DataFrame, tenant_id=None) -> DataFrame:
    if tenant_id is not None:
        return df.where(F.col("tenant_id") == F.lit(tenant_id)) \
                 .agg(F.count(F.lit(1)).alias("count"))
    return df.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("count"))


# O20 ---------------------------------------------------------------------
def dashboard_stats(events: DataFrame, visitors: DataFrame, categories: DataFrame,
                    checkins: DataFrame) -> DataFrame:
    """Per event: registered, pending, confirmed, checked-in and per-category
    counts, as the reporting view defines them: COUNT(v.id) is taken after
    the check-in join, so a visitor with k check-ins counts k times.

    Instead of materialising that fan-out, check-ins are first counted per
    visitor (partial aggregation), each visitor carries a weight
    max(k, 1), and the weights are summed per event. Same numbers, no
    fan-out shuffle, and a visitor with a huge number of scans costs nothing.
    """
    per_visitor = checkins.groupBy("visitor_id").agg(F.count(F.lit(1)).alias("_k"))
    v = (visitors.select("visitor_id", "event_id", "status", "category_id")
                 .join(per_visitor, "visitor_id", "left")
                 .join(_category_dim(categories).select("category_id", "category_code"),
                       "category_id", "left"))
    k = F.coalesce(F.col("_k"), F.lit(0))
    w = F.greatest(k, F.lit(1))

    def weighted(cond: Column) -> Column:
        return F.sum(F.when(cond, w).otherwise(F.lit(0)))

    aggs = [F.sum(w).alias("total_registered"),
            weighted(F.col("status") == "registered").alias("total_pending"),
            weighted(F.col("status") == "confirmed").alias("total_confirmed"),
            F.sum(k).alias("total_checkedin")]
    aggs += [weighted(F.col("category_code") == code).alias(f"total_{name}")
             for code, name in CODE_COLUMNS]
    per_event = v.groupBy("event_id").agg(*aggs)
    names = ["total_registered", "total_pending", "total_confirmed", "total_checkedin"] + \
            [f"total_{name}" for _, name in CODE_COLUMNS]
    out = events.select("event_id", "event_name").join(per_event, "event_id", "left")
    return out.select("event_id", "event_name",
                      *[F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in names])


# O21 ---------------------------------------------------------------------
def event_stats(events: DataFrame, visitors: DataFrame, categories: DataFrame) -> DataFrame:
    """Per event (set-based form of the per-event query, no check-in join)."""
    v = visitors.select("visitor_id", "event_id", "tenant_id", "status", "category_id") \
        .join(_category_dim(categories).select("category_id", "category_code"), "category_id", "left")

    def cnt(cond: Column) -> Column:
        return F.count(F.when(cond, F.lit(1)))

    aggs = [F.count("visitor_id").alias("total_visitors"),
            cnt(F.col("status") == "registered").alias("registered_count"),
            cnt(F.col("status") == "checked_in").alias("checked_in_count")]
    aggs += [cnt(F.col("category_code") == code).alias(f"{name}_count")
             for code, name in CODE_COLUMNS]
    per_event = v.groupBy("event_id", "tenant_id").agg(*aggs)
    names = ["total_visitors", "registered_count", "checked_in_count"] + \
            [f"{name}_count" for _, name in CODE_COLUMNS]
    out = events.select("event_id", "tenant_id").join(per_event, ["event_id", "tenant_id"], "left")
    return out.select("event_id", "tenant_id",
                      *[F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in names])


# O22 ---------------------------------------------------------------------
def tenant_analytics(tenants: DataFrame, subscriptions: DataFrame, plans: DataFrame,
                     events: DataFrame, visitors: DataFrame, checkins: DataFrame,
                     staff: DataFrame) -> DataFrame:
    """Per active tenant x active plan name: distinct events, visitors,
    check-ins, active staff, registered / checked-in visitors and check-in
    percent.

    The reference joins four one-to-many branches and takes COUNT(DISTINCT)
    over the product; Catalyst does not undo that, and the product explodes
    (billions of rows at a small scale). Each branch is aggregated per tenant
    on its own (ids are unique, so distinct counts are row counts) and the
    per-tenant rows are joined: same result, linear cost.
    """
    t = tenants.where(F.col("is_active")).select(
        "tenant_id", F.col("name").alias("tenant_name"), F.col("slug").alias("tenant_slug"),
        F.col("created_at").alias("tenant_created_at"))
    plan_names = (subscriptions.where(F.col("status") == "active")
                  .join((plans.select("plan_id", F.col("name").alias("plan_name"))),
                        "plan_id", "inner")
                  .select("tenant_id", "plan_name").distinct())
    ev = events.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("total_events"))
    vis = visitors.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("total_visitors"),
        F.count(F.when(F.col("status") == "registered", F.lit(1))).alias("registered_visitors"),
        F.count(F.when(F.col("status") == "checked_in", F.lit(1))).alias("checked_in_visitors"))
    ck_per_visitor = checkins.groupBy("visitor_id").agg(F.count(F.lit(1)).alias("_k"))
    ck = (ck_per_visitor.join(visitors.select("visitor_id", "tenant_id"), "visitor_id", "inner")
          .groupBy("tenant_id").agg(F.sum("_k").alias("total_checkins")))
    users = staff.where(F.col("is_active")).groupBy("tenant_id") \
        .agg(F.count(F.lit(1)).alias("total_users"))
    out = (t.join(plan_names, "tenant_id", "left")
            .join(ev, "tenant_id", "left").join(vis, "tenant_id", "left")
            .join(ck, "tenant_id", "left").join(users, "tenant_id", "left"))
    zero = F.lit(0).cast("long")
    counts = ["total_events", "total_visitors", "total_checkins", "total_users",
              "registered_visitors", "checked_in_visitors"]
    out = out.select("tenant_id", "tenant_name", "tenant_slug", "plan_name", "tenant_created_at",
                     *[F.coalesce(F.col(c), zero).alias(c) for c in counts])
    return out.withColumn("checkin_percentage",
                          percent_2dp("checked_in_visitors", "total_visitors"))


# O23 ---------------------------------------------------------------------
def category_counts(visitors: DataFrame, categories: DataFrame) -> DataFrame:
    """Visitors per category (0 for a category nobody chose) and the overall
    total on every row (a scalar subquery: one partial count, no window)."""
    per_cat = visitors.groupBy("category_id").agg(F.count(F.lit(1)).alias("visitors"))
    total = visitors.select(F.count(F.lit(1))).scalar()
    out = (categories.select("category_id", F.col("name").alias("category_name"))
           .join(per_cat, "category_id", "left"))
    return out.select(
        "category_id", "category_name",
        F.coalesce(F.col("visitors"), F.lit(0).cast("long")).alias("visitors"),
        total.alias("total_registered"))


# O30 ---------------------------------------------------------------------
def page(df: DataFrame, order_by: str = "created_at", desc: bool = True, limit: int = 100,
         offset: int = 0, tie_breaker: str | None = None) -> DataFrame:
    """One sorted page; PostgreSQL puts NULLs first in DESC, last in ASC. A
    unique tie-breaker makes the page deterministic. ``offset + limit`` rows
    meet in one task, so this is for pages near the top; to walk a whole
    table, filter on the last key seen instead of raising the offset."""
    key = F.col(order_by).desc_nulls_first() if desc else F.col(order_by).asc_nulls_last()
    keys = [key] + ([F.col(tie_breaker).asc()] if tie_breaker else [])
    return df.orderBy(*keys).offset(offset).limit(limit)


# O31 ---------------------------------------------------------------------
def used_categories(categories: DataFrame, visitors: DataFrame) -> DataFrame:
    """The categories that visitors use. Every task hands on the few values it
    has seen instead of its visitors, whom a join on the category would send to
    one task for each value."""
    used = visitors.select("category_id").distinct()
    return categories.join(used, "category_id", "left_semi")


def active_categories(categories: DataFrame, tenant_id=None) -> DataFrame:
    out = categories.where(F.col("is_active"))
    if tenant_id is not None and "tenant_id" in categories.columns:
        out = out.where(F.col("tenant_id") == F.lit(tenant_id))
    return out.orderBy(F.col("priority").asc(), F.col("category_id").asc())
