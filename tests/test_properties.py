"""Properties from the test strategy: O22 equals counting by hand, numbering
equals row_number for any partitioning, upsert is idempotent, codes are
unique."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from conftest import SMALL, rows
from rollcall.operators import changes, reports
from rollcall.operators.common import number_within_groups
from rollcall.sources.views import load_views

def test_tenant_analytics_against_counting_by_hand(spark):
    """Every tenant and plan counted row by row in Python."""
    d = load_views(spark, SMALL)
    got = reports.tenant_analytics(d.tenants, d.subscriptions, d.plans, d.occasions, d.visitors, d.checkins, d.staff)
    table = {n: getattr(d, n).collect() for n in ("tenants", "subscriptions", "plans", "occasions", "visitors", "checkins", "staff")}
    plan_name = {p.plan_id: p.name for p in table["plans"]}
    home = {v.visitor_id: v.tenant_id for v in table["visitors"]}
    want = []
    for t in table["tenants"]:
        if not t.is_active:
            continue
        people = [v for v in table["visitors"] if v.tenant_id == t.tenant_id]
        arrived = sum(v.status == "checked_in" for v in people)
        named = {plan_name[s.plan_id] for s in table["subscriptions"] if s.tenant_id == t.tenant_id and s.status == "active"}
        for plan in named or {None}:
            want.append((t.tenant_id, plan, len({e.event_id for e in table["occasions"] if e.tenant_id == t.tenant_id}),
                         len({v.visitor_id for v in people}),
                         len({c.checkin_id for c in table["checkins"] if home.get(c.visitor_id) == t.tenant_id}),
                         len({w.user_id for w in table["staff"] if w.tenant_id == t.tenant_id and w.is_active}),
                         sum(v.status == "registered" for v in people), arrived,
                         (arrived * 20000 + len(people)) // (2 * len(people)) / 100 if people else None))
    cols = ["tenant_id", "plan_name", "total_events", "total_visitors", "total_checkins", "total_users",
            "registered_visitors", "checked_in_visitors", "checkin_percentage"]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.select(*cols).collect())


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 5)), min_size=1, max_size=200),
       st.integers(1, 9))
def test_numbering_matches_row_number(spark, data, parts):
    df = spark.createDataFrame([(g, t, i) for i, (g, t) in enumerate(data)], "g int, t int, id int")
    got = number_within_groups(df, ["g"], ["t", "id"], out="seq", partitions=parts)
    want = df.withColumn("seq", F.row_number().over(Window.partitionBy("g").orderBy("t", "id")))
    assert rows(got, "id", "seq") == rows(want, "id", "seq")


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 100), st.integers(0, 3)), max_size=40))
def test_upsert_idempotent(spark, updates):
    base = spark.createDataFrame([(k, k * 10, "b") for k in range(4)], "k int, v int, tag string")
    upd = spark.createDataFrame([(k, v, s) for k, v, s in updates] or [(0, 0, 0)], "k int, v int, seq int")
    upd = upd.dropDuplicates(["k", "seq"])
    once = changes.upsert(base, upd, "k", ["v"], order_by="seq")
    twice = changes.upsert(once.select(*base.columns), upd, "k", ["v"], order_by="seq")
    assert rows(once.select(*base.columns)) == rows(twice.select(*base.columns))
    assert once.count() == len({0, 1, 2, 3} | {k for k, _, _ in updates} if updates else {0, 1, 2, 3})


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 30)), min_size=1, max_size=150),
       st.sampled_from([0.0, 0.5, 0.95, 1.0]), st.integers(1, 6))
def test_percentile_exact_matches_builtin(spark, data, q, parts):
    from rollcall.operators.common import percentile_exact
    df = spark.createDataFrame([(g, float(v)) for g, v in data], "g int, v double")
    got = dict(rows(percentile_exact(df, ["g"], "v", q, partitions=parts), "g", "p"))
    want = dict(rows(df.groupBy("g").agg(F.percentile("v", F.lit(q)).alias("p")), "g", "p"))
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 9)), min_size=1, max_size=120),
       st.integers(1, 7))
def test_running_sum_matches_window(spark, data, parts):
    from rollcall.operators.common import running_within_groups
    df = spark.createDataFrame([(g, w, i) for i, (g, w) in enumerate(data)], "g int, w long, id int")
    got = running_within_groups(df, ["g"], ["id"], out="s", weight="w", partitions=parts)
    want = df.withColumn("s", F.sum("w").over(Window.partitionBy("g").orderBy("id")
                                               .rowsBetween(Window.unboundedPreceding, 0)))
    assert rows(got, "id", "s") == rows(want, "id", "s")


@pytest.mark.parametrize("parts,reuse", [(3, "true"), (8, "true"), (8, "false"), (29, "false")])
def test_numbering_and_percentile_on_many_rows_with_payload(spark, parts, reuse):
    """Range boundaries are sampled: the number of a row must not depend on
    two plans cutting at the same place, nor on exchange reuse."""
    from rollcall.operators.common import percentile_exact
    before = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        df = spark.range(200_000).select(
            F.when(F.col("id") % 5 < 3, 0).otherwise(F.col("id") % 7).alias("g"), F.pmod(F.hash("id"), F.lit(5000)).alias("t"), "id",
            F.sha2(F.col("id").cast("string"), 256).alias("payload"), F.pmod(F.xxhash64("id"), F.lit(9000)).cast("double").alias("v"))
        got = number_within_groups(df, ["g"], ["t", "id"], out="n", partitions=parts)
        want = df.withColumn("m", F.row_number().over(Window.partitionBy("g").orderBy("t", "id"))).select(F.col("id").alias("i"), "m")
        assert got.join(want, F.col("id") == F.col("i")).where("n <> m").count() == 0 and got.count() == 200_000
        p = percentile_exact(df, ["g"], "v", 0.95, partitions=parts)
        w = df.groupBy(F.col("g").alias("h")).agg(F.percentile("v", F.lit(0.95)).alias("q"))
        assert p.join(w, F.col("g") == F.col("h")).where("abs(p - q) > 1e-9").count() == 0 and p.count() == w.count()
    finally:
        spark.conf.set("spark.sql.exchange.reuse", before)


def test_null_group_is_a_group(spark):
    from rollcall.operators.common import percentile_exact
    data = [(None if i % 3 == 0 else i % 2, float(i), i) for i in range(60)]
    df = spark.createDataFrame(data, "g int, v double, id int")
    got = number_within_groups(df, ["g"], ["id"], out="n", partitions=5)
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("id")))
    assert rows(got, "id", "n") == rows(want, "id", "n")
    p = dict(rows(percentile_exact(df, ["g"], "v", 0.5, partitions=4), "g", "p"))
    w = dict(rows(df.groupBy("g").agg(F.percentile("v", F.lit(0.5)).alias("p")), "g", "p"))
    assert p == w
