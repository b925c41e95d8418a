"""Codes given as visitors arrive, against a row-by-row run."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rollcall.operators import numbering
from rollcall.operators.numbering import CodeLog, number_as_inserted
from rollcall.sources.io import scratch_path
from rollcall.streaming.runner import run_foreach_batch

ROWS = "visitor_id long, tenant_id int, category_id int, registration_code string, registered_at timestamp_ntz"


def arrivals(dom, seed, n=160):
    codes = {r.category_id: r.code for r in dom.categories.collect()}
    r = random.Random(seed)
    out = []
    for i in range(n):
        cat, at = r.choice([1, 1, 1, 2, 3, 99, None]), dt.datetime(2024, 12, 20) + dt.timedelta(hours=r.randrange(24 * 20))
        own = f"{codes.get(cat)}{at:%y}"
        code = r.choice([None, None, None, "", own + str(r.randrange(60)).zfill(4), own + "x9", "ZZ990001", own + "9" * r.choice([2, 60])])
        out.append((i, r.choice([7, 7, 7, 8, None]), cat, code, at))
    return codes, out


def one_by_one(codes, batches):
    last, out = {}, []
    for batch in batches:
        for v, t, c, code, at in sorted(batch, key=lambda x: (x[4], x[0])):
            prefix = f"{codes[c]}{at:%y}" if c in codes else None
            key = (t, prefix)
            if code:
                end = code[len(prefix):] if prefix and code.startswith(prefix) else ""
                if end.isdigit() and int(end) < 10**37:
                    last[key] = max(last.get(key, 0), int(end))
            elif prefix:
                last[key] = last.get(key, 0) + 1
                code = prefix + str(last[key]).zfill(4)
            out.append((v, code or None))
    return sorted(out), {k: v for k, v in last.items()}


def given(log):
    return sorted((r.visitor_id, r.registration_code) for r in log.codes().collect())


@pytest.mark.parametrize("seed, compact", [(1, 32), (2, 2)])
def test_as_row_by_row_over_batches(spark, dom, monkeypatch, seed, compact):
    monkeypatch.setattr(numbering, "COMPACT", compact)
    codes, rows = arrivals(dom, seed)
    batches = [rows[:70], [], rows[70:75], rows[75:]]
    log = CodeLog(spark, scratch_path(spark, "codes"), dom.categories)
    for i, batch in enumerate(batches):
        log.allocate(spark.createDataFrame(batch, ROWS), "a", i)
    want, last = one_by_one(codes, batches)
    assert given(log) == want
    assert {(r.tenant_id, r.prefix): int(r["last"]) for r in log.last_numbers().collect()} == last


def test_repeated_and_failed_batches(spark, dom):
    codes, rows = arrivals(dom, 3)
    batches = [rows[:50], rows[50:100], rows[100:]]
    log = CodeLog(spark, scratch_path(spark, "codes"), dom.categories)
    frames = [spark.createDataFrame(b, ROWS) for b in batches]
    log.allocate(frames[0], "a", 0)
    log.allocate(frames[0], "a", 0)                                  # repeated: nothing is given twice
    # A batch that broke off after its codes and numbers, before its pointer.
    spark.createDataFrame([(7, "X24", 500)], "tenant_id int, prefix string, last int").selectExpr(
        "tenant_id", "prefix", f"cast(last AS {numbering.NUMBER}) AS last").write.parquet(f"{log.root}/last/step=2")
    assert given(log) == one_by_one(codes, batches[:1])[0]
    log.allocate(frames[1], "a", 1)
    log.allocate(frames[2], "b", 0)                                  # another stream goes on
    assert given(log) == one_by_one(codes, batches)[0]
    assert not log.last_numbers().where("prefix = 'X24'").collect()


def test_restarted_streams(spark, dom):
    """One file a run over one checkpoint: each run goes on where the last one ended."""
    codes, rows = arrivals(dom, 4)
    source, ckpt = scratch_path(spark, "arriving"), scratch_path(spark, "ckpt")
    log = CodeLog(spark, scratch_path(spark, "codes"), dom.categories)
    for part in (rows[:60], rows[60:90], rows[90:]):
        spark.createDataFrame(part, ROWS).coalesce(1).write.mode("append").parquet(source)
        run_foreach_batch(spark.readStream.schema(ROWS).parquet(source), "arriving", log.handler("arriving"), ckpt=ckpt)
    assert given(log) == one_by_one(codes, [rows[:60], rows[60:90], rows[90:]])[0]


def test_one_group_over_many_pieces(spark):
    r = random.Random(5)
    rows = [(1 if r.random() < .9 else 2, i, None if r.random() < .8 else r.randrange(900)) for i in range(600)]
    df = spark.createDataFrame(rows, "g int, i int, b int").withColumn("t", F.col("b").isNull())
    got = {x.i: x.number for x in number_as_inserted(df, "g", ["i"], "t", "b", partitions=9).collect()}
    last = {}
    for g, i, b in rows:
        last[g] = max(last.get(g, 0), b) if b is not None else last.get(g, 0) + 1
        assert got[i] == (last[g] if b is None else None)
    assert number_as_inserted(df.limit(0), "g", ["i"], "t", "b").collect() == []
