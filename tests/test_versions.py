"""Audit rows between two versions of a table against a full comparison."""

from __future__ import annotations

import json
import random

import pytest

from rollcall.operators import logs
from rollcall.operators.versions import VersionedTable
from rollcall.sources.io import scratch_path

ROWS = "id long, a string, b double"


def table(spark, buckets=16, key="id"):
    return VersionedTable(spark, scratch_path(spark, "versions"), key, buckets)


def state(r, n=300):
    return {i: (r.choice(["x", "y", None, ""]), r.choice([1.5, None, 0.0])) for i in [*range(n), None] if r.random() < .9}


def frame(spark, rows):
    return spark.createDataFrame([(k, *v) for k, v in rows.items()], ROWS)


def audited(t, old, new, schema):
    return sorted(((r.action, r.entity_id, r.old_values and tuple(json.loads(r.old_values).values()), r.new_values and tuple(json.loads(r.new_values).values()))
                   for r in t.audit(old, new, schema, "thing").collect()), key=str)


def expected(a, b):
    out = [("insert", k, None, v) for k, v in b.items() if k not in a] + [("delete", k, v, None) for k, v in a.items() if k not in b]
    return sorted(out + [("update", k, a[k], b[k]) for k in a if k in b and a[k] != b[k]], key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_as_a_full_comparison(spark, seed):
    r = random.Random(seed)
    t, states = table(spark), [state(r), state(r), {}, state(r)]
    for i, s in enumerate(states):
        assert t.write(frame(spark, s)) == i + 1
    schema = frame(spark, {}).schema
    for i, s in enumerate(states):
        assert {x[0]: tuple(x[1:]) for x in t.read(i + 1, schema).collect()} == s
    for old, new in ((1, 2), (2, 1), (2, 3), (3, 4), (1, 4), (4, 4)):
        assert audited(t, old, new, schema) == expected(states[old - 1], states[new - 1])


def test_only_what_differs_is_written_and_read(spark):
    r = random.Random(3)
    a = state(r)
    b = {**a, 5: ("new", 9.0)}
    t = table(spark)
    t.write(frame(spark, a)), t.write(frame(spark, b)), t.write(frame(spark, b))
    assert len(t.differing(1, 2)) == 1 and t.differing(2, 3) == []
    homes = [e.home for e in t.manifest(2).collect()]
    assert homes.count(2) == 1 and homes.count(1) == len(homes) - 1
    assert sorted(e.home for e in t.manifest(3).collect()) == sorted(homes)
    schema = frame(spark, {}).schema
    files = t.audit(1, 2, schema, "thing").inputFiles()
    assert {f.split("bucket=")[1].split("/")[0] for f in files} == {str(t.differing(1, 2)[0])}
    assert audited(t, 1, 2, schema) == expected(a, b) and audited(t, 2, 3, schema) == []


def test_nulls_that_change_places_and_a_failed_version(spark):
    t, schema = table(spark, 1), "id long, a string, b string"
    one = spark.createDataFrame([(1, "v", None)], schema)
    t.write(one)
    two = spark.createDataFrame([(1, None, "v")], schema)
    two.withColumnRenamed("id", "bucket").write.parquet(f"{t.root}/rows/version=2/broken")    # broke off before its manifest
    assert t.last() == 1
    assert t.write(two) == 2 and t.differing(1, 2) == [0]
    got = logs.audit_changes(t.audit(1, 2, one.schema, "thing")).collect()
    assert sorted((r.field, r.old_value, r.new_value, r.change) for r in got) == [("a", "v", None, "changed"), ("b", None, "v", "changed")]


def test_keys_of_two_columns(spark):
    t = table(spark, 4, ["g", "id"])
    schema = "g string, id long, v string"
    a = spark.createDataFrame([("p", 1, "x"), ("q", 1, "y"), (None, 1, "z")], schema)
    b = spark.createDataFrame([("p", 1, "x"), ("q", 1, "Y"), (None, 2, "z")], schema)
    t.write(a), t.write(b)
    got = sorted((r.action, r.entity_id, r.old_values, r.new_values) for r in t.audit(1, 2, a.schema, "thing", "id").select("action", "entity_id", "old_values", "new_values").na.fill("").collect())
    assert got == [("delete", 1, '{"v":"z"}', ""), ("insert", 2, "", '{"v":"z"}'), ("update", 1, '{"v":"y"}', '{"v":"Y"}')]
