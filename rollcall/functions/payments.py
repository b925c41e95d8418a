"""Payment-provider state mapping and price arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import col_of, js_round

# Provider states and what they map to.
#   first provider (webhook): capture+challenge -> challenge, capture+accept -> success,
#     capture+other -> pending, settlement -> success, cancel/deny/expire -> failed,
#     pending -> pending, anything else -> pending
#   first provider (polled): settlement -> success, cancel/deny/expire -> failed, else pending
#   second provider: PAID -> success, EXPIRED/FAILED -> failed, PENDING/other -> pending
FIRST_PROVIDER = "midtrans"
SECOND_PROVIDER = "xendit"
FAILED_STATES = ["cancel", "deny", "expire"]
SECOND_FAILED_STATES = ["EXPIRED", "FAILED"]

# Yearly price = monthly x 12 x 0.8; USD -> IDR at 15000.
YEARLY_MONTHS = 12
YEARLY_FACTOR = "0.8"
USD_TO_IDR = 15000


def payment_status(provider, transaction_status, fraud_status=None,
                   polled: bool = False) -> Column:
    """Normalised payment status of a provider notice."""
    prov = col_of(provider)
    ts = col_of(transaction_status)
    fraud = col_of(fraud_status) if fraud_status is not None else F.lit(None).cast("string")
    if polled:
        first = (F.when(ts == "settlement", "success")
                 .when(ts.isin(FAILED_STATES), "failed")
                 .otherwise("pending"))
    else:
        first = (F.when((ts == "capture") & (fraud == "challenge"), "challenge")
                 .when((ts == "capture") & (fraud == "accept"), "success")
                 .when(ts == "capture", "pending")
                 .when(ts == "settlement", "success")
                 .when(ts.isin(FAILED_STATES), "failed")
                 .otherwise("pending"))
    second = (F.when(ts == "PAID", "success")
              .when(ts.isin(SECOND_FAILED_STATES), "failed")
              .otherwise("pending"))
    return F.when(prov == FIRST_PROVIDER, first).when(prov == SECOND_PROVIDER, second)


def quote_amount(price, currency, billing_period, provider=None) -> Column:
    """Exact decimal amount for a plan price and billing period; a USD price
    is converted to IDR when the provider is one of the two gateways."""
    p = col_of(price).cast("decimal(18,2)")
    yearly = p * F.lit(YEARLY_MONTHS) * F.lit(YEARLY_FACTOR).cast("decimal(3,1)")
    amt = F.when(col_of(billing_period) == "yearly", yearly).otherwise(p)
    gateway = F.lit(True) if provider is None \
        else col_of(provider).isin(FIRST_PROVIDER, SECOND_PROVIDER)
    return F.when((col_of(currency) == "USD") & gateway, amt * F.lit(USD_TO_IDR)).otherwise(amt) \
        .cast("decimal(20,3)")


def provider_amount(amount) -> Column:
    """Amount sent to the provider: JavaScript Math.round on the exact value."""
    return js_round(col_of(amount)).cast("long")
