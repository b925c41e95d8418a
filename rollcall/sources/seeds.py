"""Seed dimension rows: the four subscription plans and four guest categories.

These are fixed values (they must equal the reference's seed data).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Subscription plans as seeded (name, slug, price USD, max events,
# max visitors per event, max admin users, features, sort order).
PLAN_ROWS = [
    (1, "Free", "free", Decimal("0.00"), "USD", "monthly", 1, 50, 1,
     ["Basic QR codes", "Email notifications", "Basic analytics", "Standard support"], True, 1),
    (2, "Starter", "starter", Decimal("29.99"), "USD", "monthly", 5, 500, 3,
     ["Custom branding", "Advanced analytics", "CSV export", "Priority support",
      "Custom categories", "Event templates"], True, 2),
    (3, "Professional", "professional", Decimal("79.99"), "USD", "monthly", 25, 2500, 10,
     ["White label solution", "API access", "Custom domains", "Advanced integrations",
      "Bulk operations", "Advanced reporting"], True, 3),
    (4, "Enterprise", "enterprise", Decimal("199.99"), "USD", "monthly", 999999, 999999, 999999,
     ["Everything included", "Custom features", "Dedicated support", "SLA guarantee",
      "On-premise option", "Custom integrations"], True, 4),
]

# The IDR re-pricing (slug, price IDR, features).
IDR_PRICES = [
    ("free", Decimal("0"), ["Basic QR codes", "Email notifications", "Basic analytics",
                            "Standard support", "Bank transfer payment"]),
    ("starter", Decimal("449000"), ["Custom branding", "Advanced analytics", "CSV export",
                                    "Priority support", "Custom categories", "Event templates",
                                    "Multiple payment methods", "Indonesian payment gateways"]),
    ("professional", Decimal("1199000"), ["White label solution", "API access", "Custom domains",
                                          "Advanced integrations", "Bulk operations",
                                          "Advanced reporting", "All payment methods",
                                          "Recurring subscriptions", "Multi-currency support"]),
    ("enterprise", Decimal("2999000"), ["Everything included", "Custom features",
                                        "Dedicated support", "SLA guarantee", "On-premise option",
                                        "Custom integrations", "Priority payment processing",
                                        "Custom payment flows", "Advanced fraud protection"]),
]

# Guest categories (id, name, code, colour, priority, default).
CATEGORY_ROWS = [
    (1, "VIP", "VIP", "#FFD700", 1, True, False),
    (2, "Sponsor", "SPR", "#FF6B35", 2, True, False),
    (3, "Speaker", "SPK", "#4ECDC4", 2, True, False),
    (4, "Participant", "PTC", "#45B7D1", 4, True, True),
]

PLAN_SCHEMA = T.StructType([
    T.StructField("plan_id", T.IntegerType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("slug", T.StringType(), False),
    T.StructField("price", T.DecimalType(10, 2), False),
    T.StructField("currency", T.StringType(), False),
    T.StructField("billing_cycle", T.StringType(), False),
    T.StructField("max_events", T.IntegerType(), False),
    T.StructField("max_visitors_per_event", T.IntegerType(), False),
    T.StructField("max_admin_users", T.IntegerType(), False),
    T.StructField("features", T.ArrayType(T.StringType(), False), False),
    T.StructField("is_active", T.BooleanType(), False),
    T.StructField("sort_order", T.IntegerType(), False),
])

PRICE_SCHEMA = T.StructType([
    T.StructField("slug", T.StringType(), False),
    T.StructField("price", T.DecimalType(10, 2), False),
    T.StructField("features", T.ArrayType(T.StringType(), False), False),
])

CATEGORY_SCHEMA = T.StructType([
    T.StructField("category_id", T.IntegerType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("code", T.StringType(), False),
    T.StructField("color", T.StringType(), False),
    T.StructField("priority", T.IntegerType(), False),
    T.StructField("is_active", T.BooleanType(), False),
    T.StructField("is_default", T.BooleanType(), False),
])


def _values(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """The rows as a VALUES relation, whose size Spark knows when it plans: a
    join with one is a broadcast, never a shuffle of the other side by a key
    of four values."""
    def literal(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        if isinstance(v, list):
            return "array(" + ", ".join(map(literal, v)) + ")"
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else str(v)
    values = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    names = ", ".join(schema.names)
    raw = spark.sql(f"SELECT * FROM VALUES {values} AS t({names})")
    return raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def plans(spark: SparkSession) -> DataFrame:
    return _values(spark, PLAN_ROWS, PLAN_SCHEMA)


def idr_prices(spark: SparkSession) -> DataFrame:
    return _values(spark, IDR_PRICES, PRICE_SCHEMA)


def categories(spark: SparkSession) -> DataFrame:
    return _values(spark, CATEGORY_ROWS, CATEGORY_SCHEMA)
