"""Keyed admission state against the batch rule, with shuffled and late arrivals."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rollcall.operators.registration import admit_checkins
from rollcall.sources.io import scratch_path
from rollcall.streaming import admission
from rollcall.streaming.runner import STATE_STORE, keyed_state_store, run_available_now

SCANS = "request_id string, visitor_id long, scan_time timestamp"
T0 = dt.datetime(2024, 1, 1, 8, 0)


def feed(spark, batches):
    path = scratch_path(spark, "feeds", "scans")
    for b in batches:
        spark.createDataFrame(b, SCANS).coalesce(1).write.mode("append").parquet(path)
    return path


def streamed(spark, batches, **how):
    path = feed(spark, batches)
    stream = spark.readStream.schema(SCANS).option("maxFilesPerTrigger", 1).parquet(path)
    out = run_available_now(admission.keyed_admission(stream, **how), "admission")
    return spark.read.schema(admission.CHANGES).parquet(out)


def visitors(spark):
    return spark.createDataFrame([(i, 100 + i % 3) for i in range(1, 12)], "visitor_id long, event_id long")


def decided(df):
    return sorted(tuple(r) for r in df.select("request_id", "visitor_id", "event_id", "decision", "reason").collect())


@pytest.mark.parametrize("seed", range(2))
def test_equals_the_batch_rule_on_shuffled_arrivals(spark, seed):
    r = random.Random(seed)
    scans = [(f"r{i:03d}", r.choice([1, 1, 1, 2, 3, 4, 5, 50, None]), T0 + dt.timedelta(minutes=r.randrange(90)) if i % 17 else None) for i in range(150)]
    r.shuffle(scans)
    batches = [scans[i:i + 40] for i in range(0, len(scans), 40)]
    changes = streamed(spark, batches)
    whole = spark.createDataFrame(scans, SCANS)
    want = admit_checkins(whole, visitors(spark), whole.where(F.lit(False)))
    assert decided(admission.current_decisions(changes, visitors(spark))) == decided(want)
    # A request is accepted once at most; every accepted scan that is taken back was accepted before.
    n = {x.request_id: x for x in changes.groupBy("request_id").agg(F.count_if("accepted").alias("yes"), F.count_if(~F.col("accepted")).alias("no")).collect()}
    assert all(x.yes <= 1 and x.no <= 1 for x in n.values()) and any(x.yes and x.no for x in n.values())


def test_stored_checkins_are_the_first_state(spark):
    scans = [[("a", 1, T0), ("b", 2, T0)], [("c", 2, T0 - dt.timedelta(hours=1)), ("d", 3, T0)]]
    stored = spark.createDataFrame([(1,), (1,), (3,), (None,)], "visitor_id long")
    changes = streamed(spark, scans, stored=stored)
    whole = spark.createDataFrame(sum(scans, []), SCANS)
    want = admit_checkins(whole, visitors(spark), stored)
    assert decided(admission.current_decisions(changes, visitors(spark))) == decided(want)


def test_hot_visitor_sends_one_scan_a_batch_to_the_state(spark):
    batch = [(f"r{i}", 1, T0 + dt.timedelta(seconds=i)) for i in range(500)]
    df = spark.createDataFrame(batch, SCANS).coalesce(1).select("request_id", "visitor_id", "scan_time", F.unix_micros("scan_time").alias("at"))
    marked = df.mapInPandas(admission._earliest_here(), "request_id string, visitor_id long, scan_time timestamp, at long, candidate boolean")
    assert [r.request_id for r in marked.where("candidate").collect()] == ["r0"]


def test_watermark_makes_decisions_final_and_drops_older_scans(spark):
    hours = lambda h: T0 + dt.timedelta(hours=h)
    batches = [[("a", 1, hours(5))], [("b", 1, hours(4.5)), ("c", 2, hours(9))], [("late", 3, hours(1)), ("d", 2, hours(9.5))], [("e", 4, hours(20))], [("f", 4, hours(21))]]
    changes = streamed(spark, batches, delay="2 hours")
    got = {r.request_id: r for r in admission.current_decisions(changes, visitors(spark)).collect()}
    assert got["b"].decision == "accepted" and got["a"].reason == "duplicate"
    assert "late" not in got and got["d"].reason == "duplicate" and got["e"].decision == "accepted"
    assert got["b"].final and got["c"].final and not got["a"].final and not got["e"].final


def test_state_is_dropped_after_keep(spark):
    hours = lambda h: T0 + dt.timedelta(hours=h)
    batches = [[("a", 1, hours(1))], [("x", 2, hours(8))], [("y", 2, hours(9))], [("b", 1, hours(10))]]
    changes = streamed(spark, batches, delay="1 hour", keep="2 hours")
    yes = {r.request_id for r in changes.where("accepted").collect()}
    assert {"a", "b", "x"} <= yes and "y" not in yes


def test_options_that_do_not_go_together(spark):
    df = spark.createDataFrame([], SCANS)
    with pytest.raises(ValueError):
        admission.keyed_admission(df, keep="1 hour")
    with pytest.raises(ValueError):
        admission.keyed_admission(df, delay="1 hour", ttl="1 hour")


#: What a session has that sets no state store.
DEFAULT_STORE = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"


def test_starts_in_a_session_with_the_default_state_store(spark):
    s = spark.newSession()
    s.conf.set(STATE_STORE, DEFAULT_STORE)
    path = feed(s, [[("a", 1, T0), ("b", 1, T0 + dt.timedelta(hours=1))], [("c", 1, T0 - dt.timedelta(hours=1)), ("d", 2, T0)]])
    stream = s.readStream.schema(SCANS).option("maxFilesPerTrigger", 1).parquet(path)
    out = run_available_now(admission.keyed_admission(stream), "admission", keyed_state=True)
    got = {r.request_id: r.decision for r in admission.current_decisions(s.read.schema(admission.CHANGES).parquet(out), visitors(s)).collect()}
    assert got == {"a": "rejected", "b": "rejected", "c": "accepted", "d": "accepted"}
    assert s.conf.get(STATE_STORE) == DEFAULT_STORE


def test_state_store_setting_is_lent_only_where_it_is_the_default(spark):
    s = spark.newSession()
    for own, meanwhile in ((DEFAULT_STORE, s.conf.get(STATE_STORE)), ("some.other.Store", "some.other.Store")):
        s.conf.set(STATE_STORE, own)
        with pytest.raises(RuntimeError), keyed_state_store(s):
            assert s.conf.get(STATE_STORE) == meanwhile
            raise RuntimeError
        assert s.conf.get(STATE_STORE) == own


def test_registered_query_in_a_session_with_the_default_state_store(spark):
    from rollcall.plans.catalog import QUERIES
    s = spark.newSession()
    s.conf.set(STATE_STORE, DEFAULT_STORE)
    sf = scratch_path(s, "tables")
    day = lambda n: T0 + dt.timedelta(days=n)
    tables = {
        "customer": ("c_custkey long, c_nationkey int", [(7, 1)]),
        "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
                   [(k, 7, "O", 1.0, T0, "1-URGENT") for k in (1, 2, 3)]),
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_linestatus string, l_shipdate timestamp_ntz",
                     [(1, 5, 6, 1, 1.0, "O", day(2)), (1, 5, 6, 2, 1.0, "O", day(1)),      # the earlier of two
                      (2, 5, 6, 1, 1.0, "F", day(3)), (2, 5, 6, 2, 1.0, "O", day(1)),      # checked in already
                      (9, 5, 6, 1, 1.0, "O", day(1))]),                                    # no such visitor
    }
    for name, (schema, data) in tables.items():
        s.createDataFrame(data, schema).coalesce(1).write.parquet(f"{sf}/{name}.parquet")
    assert decided(QUERIES["checkin_stream_keyed"](s, sf)) == [
        ("1-1-5-6-100", 1, 7, "rejected", "duplicate"), ("1-2-5-6-100", 1, 7, "accepted", None),
        ("2-2-5-6-100", 2, 7, "rejected", "duplicate"), ("9-1-5-6-100", 9, None, "rejected", "not_found")]


def test_requests_that_arrive_more_than_once_are_decided_as_one_and_all_answered(spark):
    later, sooner = T0 + dt.timedelta(hours=1), T0 - dt.timedelta(hours=1)
    a, b, c, d, e, f, g = ("a", 1, T0), ("b", 2, T0), ("c", 3, T0), ("d", 3, later), ("e", 4, T0), ("f", 99, T0), ("g", None, T0)
    batches = [[a, a, a, b, c, c, d, d, e, f, f, g, g],                        # copies beside each other
               [a, ("b", 2, later), ("e", 4, sooner), f, g],                   # a copy later, the same request at other times
               [("d", 3, sooner), ("h", 5, later), ("h", 5, T0), ("h", 5, later)]]   # rejected first, then the earliest
    changes = streamed(spark, batches)
    whole = spark.createDataFrame(sum(batches, []), SCANS)
    got = decided(admission.current_decisions(changes, visitors(spark)))
    assert got == decided(admit_checkins(whole, visitors(spark), whole.where(F.lit(False))))
    assert [x[0] for x in got if x[3] == "accepted"] == ["a"] * 4 + ["b"] * 2 + ["d"] * 3 + ["e"] * 2 + ["h"] * 3
    # The log accepts a scan once, whatever its copies.
    assert changes.where("accepted").groupBy("request_id", "at").count().where("count > 1").isEmpty()


def test_copies_of_a_stored_visitors_scan(spark):
    stored = spark.createDataFrame([(1,)], "visitor_id long")
    changes = streamed(spark, [[("a", 1, T0), ("a", 1, T0), ("", 1, None)], [("a", 1, T0)]], stored=stored)
    assert decided(admission.current_decisions(changes, visitors(spark))) == [("", 1, 101, "rejected", "duplicate")] + [("a", 1, 101, "rejected", "duplicate")] * 3


def test_many_answers_to_one_request_are_made_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(admission, "_AT_ONCE", 3)
    changes = spark.createDataFrame([("a", 1, 0, True, False, 5), ("a", 1, 0, None, False, 3), ("b", 2, 0, True, False, 1)], admission.CHANGES)
    assert decided(admission.current_decisions(changes, visitors(spark))) == [("a", 1, 101, "accepted", None)] * 8 + [("b", 2, 102, "accepted", None)]


def test_large_visitor_ids_beside_a_missing_one_and_times_of_any_year(spark):
    big = 2**53
    far = dt.datetime(2400, 1, 1)
    changes = streamed(spark, [[("a", big, T0), ("b", big + 1, far), ("c", None, T0), ("d", big + 1, far + dt.timedelta(days=1))]])
    known = spark.createDataFrame([(big, 7), (big + 1, 8)], "visitor_id long, event_id long")
    assert decided(admission.current_decisions(changes, known)) == [
        ("a", big, 7, "accepted", None), ("b", big + 1, 8, "accepted", None), ("c", None, None, "rejected", "not_found"),
        ("d", big + 1, 8, "rejected", "duplicate")]


def test_registered_query_equals_its_sql_where_rows_come_twice(spark):
    import duckdb
    from rollcall.plans.catalog import QUERIES
    from rollcall.plans.oracle import oracle_sql
    sf = scratch_path(spark, "tables")
    day = lambda n: T0 + dt.timedelta(days=n)
    lines = [(1, 5, 6, 1, 1.0, "O", day(2)), (1, 5, 6, 2, 1.0, "O", day(1)), (2, 5, 6, 1, 1.0, "F", day(3)),
             (2, 5, 6, 2, 1.0, "O", day(1)), (3, 5, 6, 1, 1.0, "O", day(1)), (9, 5, 6, 1, 1.0, "O", day(1))]
    tables = {
        "customer": ("c_custkey long, c_nationkey int", [(7, 1)]),
        "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
                   [(k, 7, "O", 1.0, T0, "1-URGENT") for k in (1, 2, 3, 3)]),
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_linestatus string, l_shipdate timestamp_ntz",
                     [*lines, *lines, (1, 5, 6, 2, 1.0, "O", day(4))]),      # and one at another time
    }
    con = duckdb.connect()
    for name, (schema, data) in tables.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{sf}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf.removeprefix('file:')}/{name}.parquet/*.parquet')")
    key = lambda t: tuple((x is None, str(x)) for x in t)
    got = sorted((tuple(r) for r in QUERIES["checkin_stream_keyed"](spark, sf).collect()), key=key)
    want = sorted(con.execute(oracle_sql()["checkin_stream_keyed"]).fetchall(), key=key)
    assert got == want and len(got) == 13


@pytest.mark.parametrize("with_stored", [False, True])
def test_state_is_called_by_bucket_not_by_visitor(spark, monkeypatch, with_stored):
    monkeypatch.setattr(admission, "BUCKETS", 8, raising=False)
    path = feed(spark, [[(f"r{i}", i, T0) for i in range(400)], [(f"s{i}", i, T0 - dt.timedelta(hours=1)) for i in range(0, 500, 2)]])
    stored = spark.range(300, 600).select(F.col("id").alias("visitor_id")) if with_stored else None
    stream = spark.readStream.schema(SCANS).option("maxFilesPerTrigger", 1).parquet(path)
    with keyed_state_store(spark):
        q = admission.keyed_admission(stream, stored).writeStream.format("parquet").option("path", scratch_path(spark, "streams", "calls", "out")) \
            .option("checkpointLocation", scratch_path(spark, "streams", "calls", "ckpt")).trigger(availableNow=True).start()
    q.awaitTermination()
    written = [p["stateOperators"][0]["numRowsUpdated"] for p in q.recentProgress if p["numInputRows"]]
    assert len(written) == 2 and 0 < max(written) <= 8 * 2


@pytest.mark.parametrize("parts", [1, 2, 32])
def test_equals_the_batch_rule_where_visitors_share_a_bucket(spark, monkeypatch, parts):
    monkeypatch.setattr(admission, "_PARTS", parts, raising=False)
    r = random.Random(parts)
    scans = [(f"r{r.randrange(90):03d}", r.choice([1, 2, 3, 4, 5, 6, 7, 50, None]), T0 + dt.timedelta(minutes=r.randrange(90)) if i % 17 else None) for i in range(120)]
    scans = list({x[0]: x for x in scans}.values())
    scans += scans[:20:7]
    batches = [scans[i:i + 18] for i in range(0, len(scans), 18)]
    stored = spark.createDataFrame([(1,), (8,), (None,)], "visitor_id long")
    changes = streamed(spark, batches, stored=stored, buckets=2)
    whole = spark.createDataFrame(sum(batches, []), SCANS)
    assert decided(admission.current_decisions(changes, visitors(spark))) == decided(admit_checkins(whole, visitors(spark), stored))


@pytest.mark.parametrize("parts", [1, 32])
def test_final_and_kept_visitors_of_one_bucket(spark, monkeypatch, parts):
    monkeypatch.setattr(admission, "_PARTS", parts, raising=False)
    monkeypatch.setattr(admission, "BUCKETS", 1, raising=False)
    hours = lambda h: T0 + dt.timedelta(hours=h)
    batches = [[("a", 1, hours(5)), ("b", 2, hours(6)), ("n", 6, None)], [("c", 2, hours(5.5)), ("d", 3, hours(9))], [("e", 4, hours(9.5)), ("late", 7, hours(1))],
               [("f", 5, hours(20))], [("x", 10, hours(20))], [("g", 1, hours(21)), ("h", 3, hours(19)), ("i", 5, hours(19.5)), ("s", 9, hours(20))], [("j", 5, hours(30))]]
    stored = spark.createDataFrame([(9,)], "visitor_id long")
    log = [(x.request_id, x.accepted, x.final) for x in streamed(spark, batches, stored=stored, delay="2 hours", keep="3 hours").collect()]
    # Each accepted scan that the watermark passed is final once; what was taken back never is.
    assert sorted(x[0] for x in log if x[2]) == sorted(["n", "a", "c", "d", "e", "g", "h", "i", "x"])
    # Visitors 1 and 3 were dropped, so their later scans are accepted anew; 5 is not yet, stored ones stay.
    assert sorted(x[0] for x in log if x[1] and not x[2]) == ["a", "b", "c", "d", "e", "f", "g", "h", "i", "n", "x"]
    assert sorted(x for x in log if x[0] in ("b", "s")) == [("b", False, False), ("b", True, False), ("s", False, False)]


class ListState:
    """A bucket's state without a stream."""
    def __init__(self):
        self.parts = []

    def getListState(self, *_):
        return self

    def get(self):
        return iter(self.parts)

    def appendValue(self, x):
        self.parts.append(x)

    def put(self, parts):
        self.parts = parts

    def clear(self):
        self.parts = []


@pytest.mark.parametrize("parts", [1, 32])
def test_state_of_a_visitor_is_dropped_by_the_clock(monkeypatch, parts):
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import TimerValues
    monkeypatch.setattr(admission, "_PARTS", parts)
    p = admission._processor(False, None, 1000)
    p.init(ListState())
    p.handleInitialState((0,), pd.DataFrame({"key": [0], "visitor_id": [9]}), TimerValues(0, 0))

    def at(clock, *visitors):
        rows = pd.DataFrame([(0, f"{v}@{clock}", v, True, clock, 1, True) for v in visitors], columns=["key", "request_id", "visitor_id", "known", "at", "scans", "candidate"])
        return [r for x in p.handleInputRows((0,), iter([rows]), TimerValues(clock, 0)) for r in x.loc[x["said"] == 1, "request_id"]]

    assert at(500, 1, 9) == ["1@500"]
    assert at(999, 1, 2, 9) == ["2@999"]
    assert at(1000, 1, 2, 9) == ["9@1000"]         # the stored one a second after the start
    assert at(1500, 1, 2, 9) == ["1@1500"]
    assert at(1999, 1, 2, 9) == ["2@1999"]
    assert at(9000, 3) == ["3@9000"] and len(p.newest(p.load(), 9000)) == 1
