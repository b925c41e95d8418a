"""Sinks and snapshots (O04, O05) and the JSON reader."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import rows
from rollcall.operators import reports
from rollcall.sources import io as rio


def test_snapshot_rejects_duplicate_key_and_keeps_old_version(spark, dom):
    root = rio.scratch_path(spark, "snap")
    first = spark.createDataFrame([(1, "Free", 1), (2, "Free", 2)], "tenant_id int, plan_name string, n int")
    rio.refresh_snapshot(first, root, key="tenant_id")
    assert rows(rio.current_snapshot(spark, root), "tenant_id", "n") == [(1, 1), (2, 2)]
    # O22 keeps one row per active plan name, so a tenant with two active
    # plans repeats: publishing keyed on tenant alone must be refused.
    from rollcall.sources.views import Domain
    d = Domain(spark, "/root/testdata/sf0.01")   # enough subscriptions for two active plans
    ta = reports.tenant_analytics(d.tenants, d.subscriptions, d.plans, d.occasions,
                                  d.visitors, d.checkins, d.staff)
    assert ta.groupBy("tenant_id").count().where("count > 1").count() > 0
    with pytest.raises(rio.DuplicateKeyError):
        rio.refresh_snapshot(ta, root, key="tenant_id")
    assert rows(rio.current_snapshot(spark, root), "tenant_id", "n") == [(1, 1), (2, 2)]
    rio.refresh_snapshot(ta, root, key=["tenant_id", "plan_name"], partition_by="tenant_id")
    assert rio.current_snapshot(spark, root).count() == ta.count()


def test_export_csv_round_trip(spark, dom):
    stats = reports.event_stats(dom.occasions, dom.visitors, dom.categories)
    path = rio.export_csv(stats, rio.scratch_path(spark, "csv"), partition_by="tenant_id")
    back = spark.read.option("header", True).option("inferSchema", True).csv(path)
    assert back.count() == stats.count()
    assert set(back.columns) == set(stats.columns)
    assert back.agg(F.sum("total_visitors")).first()[0] == dom.visitors.count()


def test_json_reader_batch_split(spark):
    path = rio.scratch_path(spark, "json")
    lines = ['{"qr_data": "abc", "location": "Main Entrance", "scanned_by": "7", '
             '"id": "off-1", "timestamp": "2024-01-01T08:00:00.000000"}',
             'not json at all',
             '{"qr_data": "def", "location": "Gate 2"}']
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    good, bad = rio.split_valid(rio.read_json_events(spark, path, rio.CHECKIN_REQUEST_SCHEMA))
    assert rows(good, "qr_data", "location", "id") == [("abc", "Main Entrance", "off-1"),
                                                       ("def", "Gate 2", None)]
    assert [r[rio.CORRUPT] for r in bad.collect()] == ["not json at all"]


def test_provider_notice_schemas_read_the_bodies(spark, dom):
    from rollcall.operators.billing import map_payment_status
    for provider, schema, key in (("midtrans", rio.FIRST_PROVIDER_NOTICE_SCHEMA, "order_id"),
                                  ("xendit", rio.SECOND_PROVIDER_NOTICE_SCHEMA, "external_id")):
        path = rio.scratch_path(spark, "notices", provider)
        hooks = dom.webhooks.where(F.col("provider") == provider)
        hooks.select(F.col("body").alias("value")).write.text(path)
        ev = rio.read_json_events(spark, path, schema)
        good, bad = rio.split_valid(ev)
        assert bad.count() == 0
        mapped = map_payment_status(hooks).select("order_id")
        assert rows(good.select(F.col(key).alias("order_id"))) == rows(mapped)


def test_snapshot_versions_keep_history(spark):
    root = rio.scratch_path(spark, "snap_hist")
    for n in (1, 2, 3):
        rio.refresh_snapshot(spark.createDataFrame([(k, n) for k in range(3)], "k int, n int"), root, key="k")
    versions = [r.version for r in rio.snapshot_versions(spark, root).collect()]
    assert len(versions) == 3 and versions == sorted(versions)
    assert rows(rio.current_snapshot(spark, root), "n") == [(3,)] * 3
    assert rows(rio.current_snapshot(spark, root, versions[0]), "n") == [(1,)] * 3
