"""O01 load_views: base parquet tables and the domain views over them.

Each view is a narrow projection of one or two driver tables, so Catalyst
prunes the parquet scan to the columns a query uses and pushes its filters
into the scan. Views are lazy DataFrames; nothing is read until an action.

Mapping (driver table -> domain view):
  nation            -> tenants
  supplier          -> subscriptions, staff
  customer          -> occasions (the reference's "events")
  orders x customer -> visitors, payments
  lineitem          -> checkins
  events            -> request_log, scans
  documents         -> contacts
  pages             -> requests, sites
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import lpad_keep, plus_days, plus_hours, ts_ntz
from . import seeds

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations")

# Fixed values of the mapping (ours, shared with the DuckDB twins).
TENANT_EPOCH = "2023-01-01 00:00:00"
SUBSCRIPTION_EPOCH = "2024-01-01 00:00:00"
OCCASION_EPOCH = "2024-01-01"
FIRST_NAMES = ["Budi", "Siti", "Agus", "Dewi"]
EMAIL_SHAPE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"
# The same matches for Java's backtracking engine without re-scanning every
# word from every offset: a match may only start where a local-part run
# starts (a later start in the same run reaches the same '@'), and the run
# is taken possessively (it cannot contain '@', so giving back never helps).
# The next match may begin where the last one ended.
EMAIL_SHAPE_JAVA = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"
PHONE_SHAPE = r"(\+62|62|0)[0-9][0-9 -]{7,16}[0-9]"
HOST_RE = r"^[A-Za-z]+://([^/?#:]+)"
PATH_RE = r"^[A-Za-z]+://[^/?#]*([^?#]*)"


def category_code(category_id) -> Column:
    """Seed category code by id; NULL for an id with no category."""
    pairs = []
    for cid, _name, code, *_ in seeds.CATEGORY_ROWS:
        pairs += [F.lit(cid), F.lit(code)]
    return F.create_map(*pairs)[category_id]


class Domain:
    """The domain views over one directory of driver parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str, streamed: Sequence[str] = ()):
        """``streamed``: base tables read as file streams; the views over them
        are then streaming DataFrames."""
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.streamed = frozenset(streamed)

    def table(self, name: str) -> DataFrame:
        path = f"{self.sf_dir}/{name}.parquet"
        if name in self.streamed:
            # A pattern, as a stream takes a plain path for a folder and a table may be one file.
            return self.spark.readStream.schema(self.spark.read.parquet(path).schema).parquet(f"{path[:-1]}[t]")
        return self.spark.read.parquet(path)

    # -- seed dimensions (four rows each) ---------------------------------
    @cached_property
    def plans(self) -> DataFrame:
        return seeds.plans(self.spark)

    @cached_property
    def categories(self) -> DataFrame:
        return seeds.categories(self.spark)

    # -- tenants and staff ------------------------------------------------
    @cached_property
    def tenants(self) -> DataFrame:
        n = self.table("nation")
        slug = F.lower(F.replace(F.col("n_name"), F.lit("_"), F.lit("-")))
        return n.select(
            F.col("n_nationkey").alias("tenant_id"),
            F.col("n_name").alias("name"),
            slug.alias("slug"),
            slug.alias("subdomain"),
            F.lit(None).cast("string").alias("custom_domain"),
            ((F.col("n_nationkey") % 8) != 7).alias("is_active"),
            plus_days(ts_ntz(TENANT_EPOCH), F.col("n_nationkey")).alias("created_at"),
        )

    @cached_property
    def subscriptions(self) -> DataFrame:
        s = self.table("supplier")
        k = F.col("s_suppkey")
        created = plus_days(ts_ntz(SUBSCRIPTION_EPOCH), k)
        return s.select(
            k.alias("subscription_id"),
            F.col("s_nationkey").alias("tenant_id"),
            (k % 4 + 1).cast("int").alias("plan_id"),
            F.when(k % 5 == 0, "expired").when(k % 5 == 1, "cancelled")
             .otherwise("active").alias("status"),
            created.alias("starts_at"),
            F.when(k % 3 == 0, F.lit(None).cast("timestamp_ntz"))
             .otherwise(plus_days(created, 30)).alias("ends_at"),
            created.alias("created_at"),
            F.concat(F.lit("billing"), k.cast("string"), F.lit("@example.com")).alias("billing_email"),
        )

    @cached_property
    def staff(self) -> DataFrame:
        s = self.table("supplier")
        k = F.col("s_suppkey")
        return s.select(
            k.alias("user_id"),
            F.col("s_nationkey").alias("tenant_id"),
            F.col("s_name").alias("first_name"),
            F.concat(F.lit("staff"), k.cast("string"), F.lit("@example.com")).alias("email"),
            F.when(k % 5 == 0, "owner").when(k % 5 == 1, "admin").when(k % 5 == 2, "manager")
             .when(k % 5 == 3, "staff").otherwise("viewer").alias("role"),
            (F.col("s_acctbal") > 0).alias("is_active"),
            (k % 17).cast("int").alias("login_count"),
            F.lit(0).alias("failed_login_attempts"),
        )

    # -- events ("occasions") ---------------------------------------------
    @cached_property
    def occasions(self) -> DataFrame:
        c = self.table("customer")
        k = F.col("c_custkey")
        seg = F.col("c_mktsegment")
        return c.select(
            k.alias("event_id"),
            F.col("c_nationkey").alias("tenant_id"),
            F.col("c_name").alias("event_name"),
            F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("-"))).alias("slug"),
            F.date_add(F.lit(OCCASION_EPOCH).cast("date"), (k % 366).cast("int")).alias("event_date"),
            F.lit("09:00:00").alias("start_time"),
            F.when(k % 50 == 0, "08:30:00").otherwise("17:00:00").alias("end_time"),
            ((k % 20) * 50 + 50).cast("int").alias("max_capacity"),
            F.when(seg == "AUTOMOBILE", "draft").when(seg == "BUILDING", "published")
             .when(seg == "FURNITURE", "active").when(seg == "HOUSEHOLD", "completed")
             .otherwise("cancelled").alias("status"),
        )

    # -- visitors and check-ins -------------------------------------------
    def _orders_with_tenant(self) -> DataFrame:
        o = self.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus",
                                        "o_totalprice", "o_orderdate", "o_orderpriority")
        c = self.table("customer").select("c_custkey", "c_nationkey")
        return o.join(c, o.o_custkey == c.c_custkey, "inner")

    @cached_property
    def visitors(self) -> DataFrame:
        k = F.col("o_orderkey")
        cat = F.substring("o_orderpriority", 1, 1).cast("int")
        names = F.array(*[F.lit(n) for n in FIRST_NAMES])
        return self._orders_with_tenant().select(
            k.alias("visitor_id"),
            F.col("c_nationkey").alias("tenant_id"),
            F.col("o_custkey").alias("event_id"),
            F.concat(category_code(cat), F.date_format("o_orderdate", "yy"),
                     lpad_keep(k, 4)).alias("registration_code"),
            F.element_at(names, (k % 4 + 1).cast("int")).alias("first_name"),
            F.concat(F.lit("Tamu"), (k % 1000).cast("string")).alias("last_name"),
            F.concat(F.lit("u"), (k % 7000).cast("string"), F.lit("@example.com")).alias("email"),
            cat.alias("category_id"),
            F.when(F.col("o_orderstatus") == "F", "checked_in")
             .when(F.col("o_orderstatus") == "P", "confirmed")
             .otherwise("registered").alias("status"),
            F.col("o_orderdate").alias("registered_at"),
        )

    @cached_property
    def checkins(self) -> DataFrame:
        li = self.table("lineitem")
        # lineitem has no key: (order, line, part, supplier) repeats at the
        # smallest scale, adding the price in cents makes it unique.
        cents = F.round(F.col("l_extendedprice") * 100).cast("long")
        cid = F.concat_ws("-", *[F.col(c).cast("string") for c in
                                 ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
                          cents.cast("string"))
        return li.select(
            cid.alias("checkin_id"),
            F.col("l_orderkey").alias("visitor_id"),
            F.col("l_shipdate").alias("checkin_time"),
            F.col("l_linenumber").cast("string").alias("gate_number"),
            F.col("l_suppkey").alias("checked_in_by"),
            (F.col("l_linestatus") == "F").alias("is_stored"),
        )

    # -- billing ------------------------------------------------------------
    @cached_property
    def payments(self) -> DataFrame:
        k = F.col("o_orderkey")
        email = F.concat(F.lit("u"), (k % 7000).cast("string"), F.lit("@example.com"))
        st = F.col("o_orderstatus")
        return self._orders_with_tenant().select(
            F.concat(F.lit("SUB-"), F.col("c_nationkey").cast("string"), F.lit("-"),
                     k.cast("string")).alias("order_id"),
            F.col("c_nationkey").alias("tenant_id"),
            (k % 4 + 1).cast("int").alias("plan_id"),
            F.col("o_totalprice").alias("amount"),
            F.lit("IDR").alias("currency"),
            F.when(k % 2 == 0, "midtrans").otherwise("xendit").alias("provider"),
            F.when(st == "F", "success").when(st == "O", "pending")
             .otherwise("failed").alias("status"),
            F.when(k % 3 == 0, "yearly").otherwise("monthly").alias("billing_period"),
            F.concat(F.lit('{"email":"'), email, F.lit('","firstName":"Budi"}')).alias("customer_data"),
            F.col("o_orderdate").alias("created_at"),
            plus_hours(F.col("o_orderdate"), 24).alias("expires_at"),
        )

    @cached_property
    def webhooks(self) -> DataFrame:
        """Provider notices, one per order: the first provider's body carries
        transaction/fraud state and custom fields, the second's an invoice
        status and a metadata object."""
        k = F.col("o_orderkey")
        st = F.col("o_orderstatus")
        first = k % 2 == 0
        order_id = F.concat(F.lit("SUB-"), F.col("c_nationkey").cast("string"), F.lit("-"),
                            k.cast("string"))
        tx = F.when(first, F.when(st == "F", F.when(k % 3 == 0, "capture").otherwise("settlement"))
                           .when(st == "O", F.when(k % 3 == 0, "capture").otherwise("pending"))
                           .otherwise(F.when(k % 3 == 0, "capture")
                                       .when(k % 3 == 1, "deny").otherwise("expire"))) \
              .otherwise(F.when(st == "F", "PAID").when(st == "O", "PENDING")
                          .otherwise(F.when(k % 3 == 0, "EXPIRED").otherwise("FAILED")))
        fraud = F.when(first & (k % 3 == 0),
                       F.when(st == "F", "accept").when(st == "O", "review").otherwise("challenge"))
        period = F.when(k % 3 == 0, "yearly").otherwise("monthly")
        tenant = F.col("c_nationkey").cast("string")
        plan = (k % 4 + 1).cast("string")
        body_first = F.to_json(F.struct(
            order_id.alias("order_id"), tx.alias("transaction_status"),
            fraud.alias("fraud_status"), F.col("o_totalprice").cast("string").alias("gross_amount"),
            tenant.alias("custom_field1"), plan.alias("custom_field2"),
            period.alias("custom_field3")), {"ignoreNullFields": "false"})
        body_second = F.to_json(F.struct(
            order_id.alias("external_id"), tx.alias("status"),
            F.col("o_totalprice").alias("amount"),
            F.struct(tenant.alias("tenant_id"), plan.alias("plan_id"),
                     period.alias("billing_period")).alias("metadata"),
            F.concat(F.lit("inv-"), k.cast("string")).alias("id")))
        return self._orders_with_tenant().select(
            k.alias("notice_id"),
            F.when(first, "midtrans").otherwise("xendit").alias("provider"),
            (F.col("o_orderdate") + F.make_dt_interval(hours=(k % 48).cast("int"))).alias("received_at"),
            F.when(first, body_first).otherwise(body_second).alias("body"),
        )

    # -- request log, scans ---------------------------------------------------
    @cached_property
    def request_log(self) -> DataFrame:
        e = self.table("events")
        et = F.col("event_type")
        route = F.when(et == "click", "auth").when(et == "signup", "register").otherwise("other")
        return e.select(
            F.col("event_id").alias("request_id"),
            F.col("ts"),
            F.col("user_id").alias("client"),
            (F.col("user_id") % 25).cast("int").alias("tenant_id"),
            route.alias("route"),
            F.when(et == "click", "/api/auth/login").when(et == "signup", "/api/register")
             .otherwise(F.concat(F.lit("/api/"), et)).alias("path"),
            F.when(et == "error", 500).otherwise(200).alias("status"),
            F.col("value").alias("duration_ms"),
        )

    @cached_property
    def scans(self) -> DataFrame:
        e = self.table("events")
        return e.select(
            F.col("event_id").alias("scan_id"),
            F.col("ts"),
            F.col("user_id").alias("scanner"),
            (F.col("user_id") % 25).cast("int").alias("tenant_id"),
            (F.col("event_type") != "error").alias("ok"),
        )

    # -- text sources ---------------------------------------------------------
    @cached_property
    def contacts(self) -> DataFrame:
        """Every e-mail and phone of a text: the n-th of each share row n; a
        text without any has one row of NULLs."""
        d = self.table("documents")
        found = d.select("doc_id", F.expr(f"regexp_extract_all(text, r'{EMAIL_SHAPE_JAVA}', 0)").alias("email"),
                         F.expr(f"regexp_extract_all(text, r'{PHONE_SHAPE}', 0)").alias("phone"))
        return found.select("doc_id", F.posexplode_outer(F.arrays_zip("email", "phone")).alias("nth", "c")) \
            .select("doc_id", F.coalesce("nth", F.lit(0)).alias("nth"), F.col("c.email").alias("email"),
                    F.col("c.phone").alias("phone"))

    @cached_property
    def requests(self) -> DataFrame:
        p = self.table("pages")
        k = F.col("page_id")
        return p.select(
            k.alias("request_id"),
            F.col("url"),
            F.lower(F.regexp_extract("url", HOST_RE, 1)).alias("host"),
            F.regexp_extract("url", PATH_RE, 1).alias("path"),
            F.when(k % 11 == 0, (k % 30).cast("int")).alias("header_tenant_id"),
        )

    @cached_property
    def sites(self) -> DataFrame:
        """Tenant directory derived from the page hosts: one tenant per brand
        label (the label before the two-label suffix)."""
        r = self.requests
        labels = F.split("host", r"\.")
        brand = F.element_at(labels, -3)
        four = F.when(F.size(labels) >= 4, F.col("host"))
        g = (r.where(F.size(labels) >= 3)
              .groupBy(brand.alias("brand"))
              .agg(F.min("request_id").alias("first_page"), F.max(four).alias("custom_domain")))
        tid = (F.col("first_page") + 1000).cast("int")
        return g.select(
            tid.alias("tenant_id"),
            F.col("brand").alias("name"),
            F.col("brand").alias("slug"),
            F.col("brand").alias("subdomain"),
            F.col("custom_domain"),
            ((F.col("first_page") % 8) != 7).alias("is_active"),
        )

    # -------------------------------------------------------------------------
    VIEW_NAMES = ("tenants", "plans", "subscriptions", "staff", "occasions", "categories",
                  "visitors", "checkins", "payments", "webhooks", "request_log", "scans",
                  "contacts", "requests", "sites")

    def register(self) -> "Domain":
        """Expose every base table and domain view as a temp view for SQL."""
        for t in BASE_TABLES:
            self.table(t).createOrReplaceTempView(t)
        for v in self.VIEW_NAMES:
            getattr(self, v).createOrReplaceTempView(v)
        return self


def load_views(spark: SparkSession, sf_dir: str, register: bool = True) -> Domain:
    dom = Domain(spark, sf_dir)
    return dom.register() if register else dom
