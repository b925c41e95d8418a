"""Column functions against hand-computed values (FIXTURES §C quirks)."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from rollcall.functions.contacts import email_clean, email_valid, phone_clean, phone_valid
from rollcall.functions.payments import payment_status, provider_amount, quote_amount
from rollcall.functions.scalars import (js_month_shift, js_round, lpad_keep, percent_2dp,
                                        percent_whole, ticket_checksum)


def one(spark, expr, data, schema):
    return [r[0] for r in spark.createDataFrame(data, schema).select(expr).collect()]


def test_js_month_shift_keeps_overflow(spark):
    data = [(dt.datetime(2024, 1, 31, 15, 30), 1), (dt.datetime(2024, 2, 29), 12),
            (dt.datetime(2024, 12, 31), 1), (dt.datetime(2023, 1, 31), 1),
            (dt.datetime(2024, 3, 15), 12)]
    got = one(spark, js_month_shift(F.col("t").cast("timestamp_ntz"), F.col("m")), data, "t timestamp, m int")
    assert got == [dt.datetime(2024, 3, 2), dt.datetime(2025, 3, 1), dt.datetime(2025, 1, 31),
                   dt.datetime(2023, 3, 3), dt.datetime(2025, 3, 15)]


def test_lpad_never_cuts(spark):
    got = one(spark, lpad_keep("n", 4), [(1,), (12,), (9999,), (12345,)], "n int")
    assert got == ["0001", "0012", "9999", "12345"]


def test_percent_exact_half_up(spark):
    data = [(1, 8), (1, 3), (2, 3), (0, 5), (5, 0), (1, 16), (7, 7)]
    got = one(spark, percent_2dp("k", "n"), data, "k long, n long")
    exact = [None if n == 0 else float((Decimal(k) / Decimal(n) * 100).quantize(Decimal("0.01"), "ROUND_HALF_UP"))
             for k, n in data]
    assert got == exact
    assert one(spark, percent_whole("k", "n"), data, "k long, n long") == [13, 33, 67, 0, 0, 6, 100]


def test_js_round_half_up(spark):
    got = one(spark, js_round("x"), [(2.5,), (-2.5,), (0.49,), (1234.5,)], "x double")
    assert got == [3, -2, 0, 1235]


def test_payment_status_all_states(spark):
    data = [("midtrans", "capture", "challenge"), ("midtrans", "capture", "accept"),
            ("midtrans", "capture", "review"), ("midtrans", "settlement", None),
            ("midtrans", "cancel", None), ("midtrans", "deny", None), ("midtrans", "expire", None),
            ("midtrans", "pending", None), ("midtrans", "refund", None),
            ("xendit", "PAID", None), ("xendit", "EXPIRED", None), ("xendit", "FAILED", None),
            ("xendit", "PENDING", None), ("xendit", "SETTLED", None)]
    schema = "p string, s string, f string"
    hook = one(spark, payment_status("p", "s", "f"), data, schema)
    assert hook == ["challenge", "success", "pending", "success", "failed", "failed", "failed",
                    "pending", "pending", "success", "failed", "failed", "pending", "pending"]
    polled = one(spark, payment_status("p", "s", "f", polled=True), data, schema)
    assert polled[:3] == ["pending", "pending", "pending"]
    assert polled[3] == "success"


def test_quote_and_provider_amount(spark):
    data = [(Decimal("29.99"), "USD", "monthly"), (Decimal("29.99"), "USD", "yearly"),
            (Decimal("449000"), "IDR", "yearly"), (Decimal("0.00"), "USD", "yearly")]
    got = spark.createDataFrame(data, "p decimal(10,2), c string, b string") \
        .select(quote_amount("p", "c", "b").alias("a")) \
        .select(F.col("a").cast("double"), provider_amount(F.col("a"))).collect()
    assert [tuple(r) for r in got] == [(449850.0, 449850), (4318560.0, 4318560),
                                       (4310400.0, 4310400), (0.0, 0)]


def test_phone_rules(spark):
    data = [("0812-3456 789",), ("+6281234567890",), ("6281234567890",), ("0812345",),
            ("081234567890123456",), ("08 12 34 56 78 90",), (None,)]
    schema = "p string"
    assert one(spark, phone_clean("p"), data, schema) == [
        "+628123456789", "+6281234567890", "6281234567890", "+62812345", "+6281234567890123456",
        "+6281234567890", None]
    assert one(spark, phone_valid("p"), data, schema) == [True, True, True, False, False, True, False]
    assert one(spark, phone_valid(phone_clean("p")), [("(0812) 3456-7890",)], schema) == [True]


def test_email_rules(spark):
    data = [("  Budi.Santoso@Example.COM ",), ("no at sign",), ("a b@c.d",), ("x@y",), (None,)]
    cleaned = one(spark, email_clean("e"), data, "e string")
    assert cleaned == ["budi.santoso@example.com", "no at sign", "a b@c.d", "x@y", None]
    assert one(spark, email_valid(email_clean("e")), data, "e string") == [True, False, False, False, False]


def test_ticket_checksum_is_md5_prefix(spark):
    import hashlib
    got = one(spark, ticket_checksum("i", "c", "e"), [(7, "VIP240001", "a@b.c")], "i long, c string, e string")
    assert got == [hashlib.md5(b"7VIP240001a@b.c").hexdigest()[:8]]
