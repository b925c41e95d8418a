"""The notice log: bodies of any shape, failed ones kept aside."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from rollcall.operators import billing, notices
from rollcall.sources.io import scratch_path

AT = dt.datetime(2024, 1, 1)
RAW = "notice_id long, provider string, received_at timestamp_ntz, body string, headers string"


def first(order, **more):
    return json.dumps({"order_id": order, "transaction_status": "settlement", "gross_amount": "12.50", "custom_field1": "7", "custom_field2": "2",
                       "custom_field3": "yearly", **more})


def second(order, **more):
    return json.dumps({"external_id": order, "status": "PAID", "amount": 12.5, "metadata": {"tenant_id": "7", "plan_id": 2}, **more})


ROWS = [(1, "midtrans", AT, first("A"), '{"x-callback-token": "t"}'), (2, "xendit", AT, second("B", channel={"bank": "bca", "no": 5}), None),
        (3, "midtrans", AT, first("C")[:-3], "{broken"), (4, "xendit", AT, "[1, 2]", None), (5, "stripe", AT, first("D"), None),
        (6, "midtrans", AT, second("E"), None), (7, "xendit", AT, None, None), (8, None, AT, first("F"), None), (9, "midtrans", AT, "", None),
        (10, "xendit", AT, second(""), None), (11, "midtrans", AT, '{"order_id": "G", "order_id": "H"}', None),
        (12, "midtrans", AT, first("I", custom_field1="x", gross_amount=[1]), None), (13, "xendit", AT, second("J", channel="card", tags=[]), None),
        (14, "xendit", AT, '"text"', None)]


def log_of(spark, rows=ROWS):
    path = scratch_path(spark, "notices")
    notices.append(spark.createDataFrame(rows, RAW), path)
    return notices.read_log(spark, path)


def test_failed_notices_are_kept_aside(spark):
    log = log_of(spark)
    bad = {r.notice_id: (r.status_code, r.error_message, r.raw_body) for r in notices.failed(log).collect()}
    want = {3: "malformed body", 4: "not an object", 5: "unknown provider", 6: "no order id", 7: "malformed body", 8: "unknown provider",
            9: "malformed body", 10: "no order id", 11: "malformed body", 14: "not an object"}
    assert {k: v[1] for k, v in bad.items()} == want
    assert all(v[0] == notices.STATUS_CODES[v[1]] for v in bad.values())
    assert all(v[2] == ROWS[k - 1][3] for k, v in bad.items())
    good = log.where("error_message IS NULL").collect()
    assert {r.notice_id for r in good} == {1, 2, 12, 13} and all(r.status_code == 200 and r.raw_body is None for r in good)


def test_new_fields_survive(spark):
    log = log_of(spark)
    got = {r.notice_id: r.bank for r in log.select("notice_id", F.try_variant_get("payload", "$.channel.bank", "string").alias("bank")).collect()}
    assert got[2] == "bca" and got[13] is None and got[1] is None
    token = log.where("notice_id = 1").select(F.try_variant_get("headers", "$['x-callback-token']", "string")).first()[0]
    assert token == "t" and log.where("notice_id = 3").first().headers is None
    fields = {(r.provider, r.path, r.kind): r.notices for r in notices.fields_in_use(log).collect()}
    assert fields["xendit", "$.channel", "object"] == 1 and fields["xendit", "$.channel", "string"] == 1
    assert fields["xendit", "$.channel.no", "number"] == 1 and fields["xendit", "$.tags", "array"] == 1
    assert fields["midtrans", "$.gross_amount", "string"] == 1 and fields["midtrans", "$.gross_amount", "array"] == 1
    assert fields["xendit", "$.metadata.plan_id", "number"] == 2
    shapes = {r.provider: r.payload_schema for r in notices.schemas(log).collect()}
    assert "order_id: STRING" in shapes["midtrans"] and "metadata: OBJECT<plan_id: BIGINT, tenant_id: STRING>" in shapes["xendit"]


def test_values_of_another_kind_are_null(spark):
    r = notices.usable(log_of(spark)).where("notice_id = 12").first()
    assert (r.order_id, r.tenant_id, r.amount, r.payment_status, r.plan_id) == ("I", None, None, "success", 2)


def test_usable_notices_as_the_parser_with_a_schema(spark, dom):
    path = scratch_path(spark, "notices")
    notices.append(dom.webhooks, path)
    got, want = notices.usable(notices.read_log(spark, path)), billing.map_payment_status(dom.webhooks)
    cols = [c for c in want.columns if c != "raw_response"]
    assert want.count() > 100
    assert got.select(*cols).exceptAll(want.select(*cols)).isEmpty() and want.select(*cols).exceptAll(got.select(*cols)).isEmpty()


def test_a_body_is_parsed_once_and_not_again(spark, dom):
    rows = notices.log_notices(dom.webhooks).where("error_message = 'no order id' AND tenant_id = 3")
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1
    plan = notices.usable(log_of(spark)).where("payment_status = 'success'")._jdf.queryExecution().optimizedPlan().toString()
    assert "parseJson" not in plan


def test_an_empty_log(spark):
    log = notices.read_log(spark, scratch_path(spark, "nothing"))
    assert notices.usable(log).collect() == [] and notices.failed(log).collect() == [] and notices.fields_in_use(log).collect() == []
    assert log_of(spark, []).collect() == []
