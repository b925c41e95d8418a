"""Quantiles from stored sketches against the exact ones."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from rollcall.operators import quantiles as qt
from rollcall.sources.io import scratch_path

LOG = "route string, ts timestamp_ntz, duration_ms double"
AT = dt.datetime(2024, 3, 4)


def requests(seed, n):
    r = random.Random(seed)
    route = lambda: r.choice(["hot"] * 8 + ["cold", None])
    return [(route(), AT + dt.timedelta(minutes=r.randrange(60 * 24 * 14)), r.choice([r.lognormvariate(4, 1), 100.0])) for _ in range(n)]


def test_a_period_within_the_rank_error_without_the_log(spark):
    rows = requests(1, 20_000)
    path = scratch_path(spark, "sketches")
    for part in (rows[:12_000], rows[12_000:]):                 # the second part has late requests for every hour
        qt.append(spark.createDataFrame(part, LOG), path)
    stored = spark.read.parquet(path)
    end = AT + dt.timedelta(days=7)
    got = {r.route: r for r in qt.quantiles(stored, start=AT, end=end).collect()}
    for route in ("hot", "cold", None):
        own = sorted(d for k, t, d in rows if k == route and t < end)
        assert got[route].requests == len(own)
        for q, v in ((.5, got[route].p50), (.95, got[route].p95), (.99, got[route].p99)):
            below, upto = sum(d < v for d in own) / len(own), sum(d <= v for d in own) / len(own)
            assert below - qt.RANK_ERROR <= q <= upto + qt.RANK_ERROR
    hours = stored.groupBy("route", "hour").count()
    assert hours.where("count = 2").count() > 0
    small = qt.compact(stored)
    assert small.count() == hours.count() and small.agg(F.sum("requests")).first()[0] == len(rows)
    days = qt.compact(stored, period=F.window("hour", "1 day").getField("start"))
    assert days.where("route = 'hot'").count() == 14
    again = {r.route: r.requests for r in qt.quantiles(days, start=AT, end=end).collect()}
    assert again == {k: r.requests for k, r in got.items()}


def test_few_requests_are_exact_and_none_is_null(spark):
    rows = [("a", AT, float(i)) for i in range(100)] + [("b", AT, None), (None, AT, 3.0), ("c", None, 1.0)]
    s = qt.hourly_sketches(spark.createDataFrame(rows, LOG))
    got = {r.route: tuple(r)[1:] for r in qt.quantiles(s, qs=(.5, 1.0)).collect()}
    assert got["a"][0] == 100 and 49 <= got["a"][1] <= 50 and got["a"][2] == 99
    assert got["b"] == (1, None, None) and got[None] == (1, 3.0, 3.0) and "c" not in got
    assert qt.quantiles(s.limit(0)).collect() == []


def test_rank_errors(spark):
    log = spark.createDataFrame([("a", AT, float(i)) for i in range(100)], LOG)
    found = spark.createDataFrame([("a", 49.0, 69.0)], "route string, p50 double, p95 double")
    e = qt.rank_errors(log, found, "route", (.5, .95)).first()
    assert e.p50 == 0 and abs(e.p95 - .25) < 1e-9
