"""Stream forms against their batch twins on small hand-made feeds."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import rows
from rollcall.operators import registration
from rollcall.sources.io import scratch_path
from rollcall.streaming import live
from rollcall.streaming.runner import run_available_now, run_foreach_batch, run_updates

T0 = dt.datetime(2024, 1, 1, 8, 0)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


SCAN_SCHEMA = "request_id string, visitor_id long, scan_time timestamp"


def feed(spark, name, batches, schema):
    """Write each batch as its own file set, oldest first; a file stream with
    one file per trigger replays them as separate micro-batches."""
    path = scratch_path(spark, "feeds", name)
    for rows_ in batches:
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(path)
    return path


def visitors(spark):
    return spark.createDataFrame([(1, 100, 1), (2, 100, 1), (3, 200, 2)],
                                 "visitor_id long, event_id long, tenant_id int")


def test_exact_admission_across_batches_equals_batch_rule(spark):
    batches = [
        [("a1", 1, at(0)), ("a2", 1, at(1)), ("a3", 9, at(2))],      # second scan in one batch, unknown
        [("b1", 2, at(10)), ("b2", 1, at(11))],                       # visitor 1 again, later batch
        [("c1", 3, at(20)), ("c2", 2, at(21)), ("c3", 3, at(19))],    # late offline scan c3 wins for 3
    ]
    path = feed(spark, "scans", batches, SCAN_SCHEMA)
    stream = spark.readStream.schema(SCAN_SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    decisions = scratch_path(spark, "decisions")
    run_foreach_batch(stream, "exact", live.exact_admission_batch(visitors(spark), decisions, "s1"))
    dec = live.read_decisions(spark, decisions)
    got_ok = rows(dec.where("decision = 'accepted'"), "request_id")
    got_bad = rows(dec.where("decision = 'rejected'"), "request_id", "reason")
    all_req = spark.createDataFrame([r for b in batches for r in b], SCAN_SCHEMA)
    want = registration.admit_checkins(all_req, visitors(spark), all_req.where(F.lit(False)))
    assert got_ok == rows(want.where("decision = 'accepted'"), "request_id")
    assert got_bad == rows(want.where("decision = 'rejected'"), "request_id", "reason")
    assert got_ok == [("a1",), ("b1",), ("c3",)]


def test_watermark_dedupe_keeps_first_within_delay(spark):
    batches = [[("a1", 1, at(0)), ("a2", 9, at(0))], [("a3", 1, at(30)), ("b1", 2, at(40))]]
    path = feed(spark, "wm", batches, SCAN_SCHEMA)
    stream = spark.readStream.schema(SCAN_SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    out = live.checkin_stream(stream, visitors(spark), delay="1 hour")
    got = rows(spark.read.parquet(run_available_now(out, "wm")), "request_id", "event_id")
    assert got == [("a1", 100), ("b1", 100)]


def test_watermark_drops_scans_later_than_delay(spark):
    # After batch 1 (09:40) the watermark is 08:40; Spark filters late rows
    # against the previous batch's watermark, so in batch 3 visitor 2's
    # offline scan from 08:05 is dropped, and visitor 1's repeat at 09:30
    # (inside the delay) is removed as a duplicate.
    batches = [[("a1", 1, at(100))], [("b1", 3, at(105))], [("late", 2, at(5)), ("dup", 1, at(90))]]
    path = feed(spark, "late", batches, SCAN_SCHEMA)
    stream = spark.readStream.schema(SCAN_SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    out = live.checkin_stream(stream, visitors(spark), delay="1 hour")
    got = rows(spark.read.parquet(run_available_now(out, "late")), "request_id")
    assert got == [("a1",), ("b1",)]


def test_running_totals_complete_mode(spark):
    batches = [[("a1", 1, at(0)), ("a2", 3, at(1))], [("b1", 2, at(5)), ("b2", 3, at(6))]]
    path = feed(spark, "totals", batches, SCAN_SCHEMA)
    stream = spark.readStream.schema(SCAN_SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    q = (live.running_totals(stream, visitors(spark), by=["event_id"]).writeStream
         .format("memory").queryName("running_totals").outputMode("complete")
         .option("checkpointLocation", scratch_path(spark, "ckpt_totals"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    assert rows(spark.table("running_totals")) == [(100, 2), (200, 2)]


def test_exact_admission_new_checkpoint_retry_and_unreadable_history(spark):
    decisions = scratch_path(spark, "decisions")
    first = spark.createDataFrame([("a1", 1, at(0)), ("a2", 2, at(1))], SCAN_SCHEMA)
    second = spark.createDataFrame([("b1", 1, at(5)), ("b2", 3, at(6))], SCAN_SCHEMA)
    live.exact_admission_batch(visitors(spark), decisions, "one")(first, 0)
    live.exact_admission_batch(visitors(spark), decisions, "one")(first, 0)      # the same batch again
    live.exact_admission_batch(visitors(spark), decisions, "two")(second, 0)     # a new checkpoint counts from 0
    got = rows(live.read_decisions(spark, decisions), "request_id", "decision")
    assert got == [("a1", "accepted"), ("a2", "accepted"), ("b1", "rejected"), ("b2", "accepted")]
    spark.createDataFrame([("not parquet",)], "value string").coalesce(1).write.text(f"{decisions}/stream=bad/batch=0/decision=accepted/x.parquet")
    with pytest.raises(Exception):
        live.exact_admission_batch(visitors(spark), decisions, "three")(second, 0)


def test_live_dashboard_counts_open_windows(spark):
    batches = [[("a1", 1, at(0)), ("a2", 1, at(1))], [("b1", 2, at(70)), ("b2", 3, at(2)), ("b3", 9, at(3))]]
    path = feed(spark, "dash", batches, SCAN_SCHEMA)
    stream = spark.readStream.schema(SCAN_SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    counts = run_updates(live.live_counts(stream), "dash", ["window_start", "window_end", "visitor_id"])
    got = rows(live.live_dashboard(counts, visitors(spark), by=["event_id"]), "window_start", "event_id", "checkins")
    assert got == [(at(0), 100, 2), (at(0), 200, 1), (at(60), 100, 1)]


def test_payment_expiry_stream_with_flush_equals_the_rule(spark):
    pay_schema = "order_id string, tenant_id int, created_at timestamp, status string"
    note_schema = "order_id string, received_at timestamp, notice_id long, payment_status string"
    day = 60 * 24
    pays = [[("settled", 1, at(0), "pending"), ("silent", 1, at(0), "pending"), ("late", 2, at(60), "pending"),
             ("asked", 2, at(30), "pending"), ("paid", 1, at(0), "success")],
            [("end", 0, at(day * 10), "pending"), ("end2", 0, at(day * 10), "pending")]]
    notes = [[("settled", at(30), 1, "failed"), ("late", at(60 + 60 * 25), 2, "success"), ("asked", at(40), 3, "pending")],
             [("end", at(day * 10 + 1), 4, "success")]]
    ppath, npath = feed(spark, "pays", pays, pay_schema), feed(spark, "notes", notes, note_schema)
    ps = spark.readStream.schema(pay_schema).option("maxFilesPerTrigger", 1).parquet(ppath)
    ns = spark.readStream.schema(note_schema).option("maxFilesPerTrigger", 1).parquet(npath)
    out = live.payment_expiry_stream(ps, ns, hours=24, delay="1 hour")
    emitted = spark.read.parquet(run_available_now(out, "expiry"))
    assert rows(emitted, "order_id", "status") == [("asked", "expired"), ("late", "expired"), ("silent", "expired")]
    rest = live.payment_expiry_rest(spark.read.parquet(ppath), spark.read.parquet(npath), emitted, F.lit(at(day * 12)), hours=24)
    assert rows(rest, "order_id") == [("end2",)]


def test_json_events_stream_keeps_malformed_aside(spark):
    from rollcall.sources.io import REQUEST_LOG_SCHEMA, read_json_events
    path = scratch_path(spark, "json_stream")
    lines = ['{"method": "GET", "url": "/api/x", "status": 200, "duration": "12ms", "tenantId": "3"}',
             '{"method": "POST", "url": broken',
             '{"method": "GET", "url": "/health", "status": 200, "duration": "1ms"}']
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    stream = read_json_events(spark, path, REQUEST_LOG_SCHEMA, streaming=True)
    out = run_available_now(stream.selectExpr("url", "status", "_corrupt_record IS NOT NULL AS bad"),
                            "json_stream")
    got = rows(spark.read.parquet(out), "url", "status", "bad")
    assert got == [("/api/x", 200, False), ("/health", 200, False), (None, None, True)]


def test_salted_dedupe_keeps_one_scan_for_a_hot_visitor(spark):
    batches = [[(f"h{i}", 1, at(i % 30)) for i in range(200)] + [("x", 3, at(1))],
               [(f"k{i}", 1, at(40 + i % 10)) for i in range(100)]]
    path = feed(spark, "hot", batches, SCAN_SCHEMA)
    stream = spark.readStream.schema(SCAN_SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    out = live.checkin_stream(stream, visitors(spark), delay="1 hour", salt_buckets=8)
    got = spark.read.parquet(run_available_now(out, "hot"))
    assert rows(got.groupBy("visitor_id").count()) == [(1, 1), (3, 1)]
