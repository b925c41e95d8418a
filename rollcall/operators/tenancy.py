"""Tenant attribution (O17) and contact normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.contacts import email_clean, email_valid, phone_clean, phone_valid
from .common import join_on_hot_key

# Resolution routes in the order the resolver tries them.
ROUTES = ("header", "subdomain", "custom_domain", "path")


def _lookup(tenants: DataFrame, key_col: str, key: str, out: str, active_only: bool) -> DataFrame:
    t = tenants.where(F.col(key_col).isNotNull())
    if active_only:
        t = t.where(F.col("is_active"))
    # One tenant per lookup key (the first by id when a key is shared).
    return t.groupBy(F.col(key_col).alias(key)).agg(F.min("tenant_id").alias(out))


# O17 ---------------------------------------------------------------------
def resolve_tenant(requests: DataFrame, tenants: DataFrame) -> DataFrame:
    """First hit wins: header tenant id (no active test) -> first host label
    when the host has 3+ labels (active) -> whole host as custom domain
    (active, host without 'localhost') -> '/t/<slug>' path (active).

    Each route is an equi left join against a de-duplicated lookup of the
    tenant table that deals the requests of one host to many tasks and keeps
    requests without that route's key (NULL) out of any one task.
    ``path_without_tenant`` is the path that the handlers see: a leading
    '/t/<slug>' of the path route is removed."""
    labels = F.split(F.col("host"), r"\.")
    sub_key = F.when(F.size(labels) >= 3, F.element_at(labels, 1))
    dom_key = F.when(~F.col("host").contains("localhost"), F.col("host"))
    parts = F.split(F.col("path"), "/")
    slug_key = F.when(F.col("path").startswith("/t/") & (F.size(parts) > 2)
                      & (F.element_at(parts, 3) != ""), F.element_at(parts, 3))
    r = (requests.withColumn("_k_header", F.col("header_tenant_id"))
                 .withColumn("_k_sub", sub_key)
                 .withColumn("_k_dom", dom_key)
                 .withColumn("_k_slug", slug_key))
    by_id = tenants.select(F.col("tenant_id").alias("_k_header"),
                           F.col("tenant_id").alias("_t_header")).distinct()
    lookups = [(by_id, "_k_header"), (_lookup(tenants, "subdomain", "_k_sub", "_t_sub", True), "_k_sub"),
               (_lookup(tenants, "custom_domain", "_k_dom", "_t_dom", True), "_k_dom"),
               (_lookup(tenants, "slug", "_k_slug", "_t_slug", True), "_k_slug")]
    for lookup, key in lookups:
        r = join_on_hot_key(r, lookup, [key], F.col("request_id"))
    hits = [F.col("_t_header"), F.col("_t_sub"), F.col("_t_dom"), F.col("_t_slug")]
    route = F.when(hits[0].isNotNull(), ROUTES[0]).when(hits[1].isNotNull(), ROUTES[1]) \
        .when(hits[2].isNotNull(), ROUTES[2]).when(hits[3].isNotNull(), ROUTES[3])
    rest = F.regexp_replace("path", r"^/t/[^/]+", "")
    return (r.withColumn("tenant_id", F.coalesce(*hits))
             .withColumn("resolved_by", route)
             .withColumn("path_without_tenant", F.when(F.col("resolved_by") != ROUTES[3], F.col("path"))
                         .when(F.col("resolved_by").isNull(), F.col("path"))
                         .otherwise(F.when(rest == "", "/").otherwise(rest)))
             .drop("_k_header", "_k_sub", "_k_dom", "_k_slug",
                   "_t_header", "_t_sub", "_t_dom", "_t_slug"))


# O36 ---------------------------------------------------------------------
def normalize_contacts(df: DataFrame, phone: str = "phone", email: str = "email") -> DataFrame:
    """Phone: keep digits and '+', '08...' -> '+628...'; validity is tested
    on that cleaned value, as the form's blur check sees the field after its
    input handler has rewritten it. E-mail: trimmed, lower-case, validity by the form's
    pattern."""
    return (df.withColumn("phone_normalized", phone_clean(phone))
              .withColumn("phone_valid", phone_valid(phone_clean(phone)))
              .withColumn("email_normalized", email_clean(email))
              .withColumn("email_valid", email_valid(email_clean(email))))
