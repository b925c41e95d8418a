"""Limiter windows against a sequential simulation."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollcall.operators import windows
from rollcall.operators.windows import client_windows, window_starts

SCHEMA = "client long, route string, path string, ts timestamp_ntz"
T0 = dt.datetime(2024, 1, 1)


def simulated(rows, width_ms):
    out, open_ = {}, {}
    for c, route, path, ts in sorted((r for r in rows if r[3] is not None and r[2] not in ("/health", "/api/health")), key=lambda r: r[3]):
        t = (ts - T0) // dt.timedelta(milliseconds=1)
        if (c, route) not in open_ or t >= open_[c, route] + width_ms:
            open_[c, route] = t
        k = (open_[c, route], c, route)
        out[k] = out.get(k, 0) + 1
    return sorted(((T0 + dt.timedelta(milliseconds=s), c, r, n) for (s, c, r), n in out.items()), key=str)


def got(df):
    return sorted(((r.window_start, r.client, r.route, r["count"]) for r in df.collect()), key=str)


def requests(r, n, gap):
    t, rows = 0.0, []
    for i in range(n):
        t += r.expovariate(1 / gap)
        c = r.choice([1] * 8 + [2, 3, None])
        rows.append((c, r.choice(["auth", "other"]) if c != 1 else "other", "/api/x" if i % 31 else "/health", T0 + dt.timedelta(seconds=t) if i % 41 else None))
    return rows


@pytest.mark.parametrize("seed, gap, pieces", [(1, 30, 7), (2, 300, 5), (3, 2, 9), (4, 2000, 4), (5, 30, 1)])
def test_equals_sequential_simulation(spark, seed, gap, pieces):
    """One client has most requests and spans most pieces; dense and idle traffic."""
    rows = requests(random.Random(seed), 900, gap)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(client_windows(df, pieces=pieces, only_over=False)) == simulated(rows, 900_000)


def test_window_longer_than_many_pieces_and_evenly_dense_times(spark):
    rows = [(1, "other", "/api", T0 + dt.timedelta(seconds=i)) for i in range(4000)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(client_windows(df, pieces=16, only_over=False)) == simulated(rows, 900_000)
    assert got(client_windows(df, window="17 seconds", pieces=16, only_over=False)) == simulated(rows, 17_000)
    assert got(client_windows(df, window="1 day", pieces=16, only_over=False)) == [(T0, 1, "other", 4000)]


def test_over_the_limit_alone_and_edges(spark):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [(1, "auth", "/api", at(s)) for s in (0, 1, 2, 3, 4, 899, 899.9994, 900, 901)] + [(2, "nolimit", "/api", at(0))] * 9
    out = client_windows(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.window_start, r.window_end, r.client, r["count"], r.limit, r.blocked) for r in out] == [(at(0), at(900), 1, 7, 5, 2)]
    assert client_windows(spark.createDataFrame([], SCHEMA)).collect() == []


def test_hot_client_stays_spread(spark, monkeypatch):
    seen = []
    old = windows._carried
    monkeypatch.setattr(windows, "_carried", lambda cells, width: seen.append(cells) or old(cells, width))
    rows = [(1, "other", "/api", T0 + dt.timedelta(seconds=i)) for i in range(3000)]
    client_windows(spark.createDataFrame(rows, SCHEMA), pieces=10).collect()
    sizes = [r["count"] for r in seen[0].groupBy("piece").count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 900


def test_starts_of_all_keys_at_once():
    r = np.random.default_rng(1)
    key = np.sort(r.integers(0, 9, 300))
    key = np.unique(key, return_inverse=True)[1]
    t = np.concatenate([np.sort(r.choice(10_000, (key == k).sum(), replace=False)) for k in range(key.max() + 1)])
    marks = window_starts(key, t, 700)
    for k in range(key.max() + 1):
        end = None
        for x, m in zip(t[key == k], marks[key == k]):
            assert m == (end is None or x >= end)
            end = x + 700 if m else end
