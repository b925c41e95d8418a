from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from docs_fixture import docs_of  # noqa: F401 (fixture)
import corpus_pipeline as cp
from rollcall.llm import toxicity as tox
from rollcall.llm.common import table
from test_decontaminate import brute as brute_contamination
from test_simhash import brute_components, brute_fp

SF = "/root/testdata/sf0.001"


def test_whole_run_as_brute_force(spark):
    docs = {r.doc_id: r for r in table(spark, SF, "documents").collect()}
    model = tox.fit(table(spark, SF, "documents"), table(spark, SF, "labels"))
    clean = {i: r for i, r in docs.items() if model.score(model.features(r.text)) < cp.TOXIC}
    groups = brute_components([(i, brute_fp(r.text)) for i, r in sorted(clean.items())])
    single = {i: r for i, r in clean.items() if groups[i] == i}
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    kept = {x[0] for x in brute_contamination([(i, r.text) for i, r in single.items()], items) if not x[-1]}
    out = cp.run(spark, SF).collect()
    assert {r.doc_id for r in out} == kept and len(out) == len(kept) > 50
    assert all(r.text == docs[r.doc_id].text and r.source == docs[r.doc_id].source for r in out)
    assert sorted(r.position for r in out) == list(range(len(out)))
    order = sorted(out, key=lambda r: r.position)
    assert [r.shard for r in order] == sorted(r.shard for r in order)      # no equal texts are left: contiguous
    for s in range(cp.SHARDS):
        assert [r.slot for r in order if r.shard == s] == list(range(sum(r.shard == s for r in out)))


def test_stages_return_the_columns_of_documents(spark):
    docs = table(spark, SF, "documents")
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
    assert cp.STAGES[-1][1](spark, docs, SF).columns == [*docs.columns, "position", "shard", "slot"]


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_odd_rows_and_clashing_columns(spark, docs_of, name):
    stage = dict(cp.STAGES)[name]
    rnd = random.Random(1)
    say = lambda n: " ".join(rnd.choice("abcdefghij") + str(rnd.randrange(99)) for _ in range(n))
    item = re.sub(r"\s+", " ", table(spark, SF, "benchmark").first().text)
    rows = [(i, say(20), f"s{i % 3}") for i in range(40)] + [(40, None, None), (41, "", "s0"), (None, say(9), "s1"), (42, say(20000), "s1"), (3, "again", None)]
    rows += [(50, say(5) + " " + item + " " + say(5), "s0")] + [(60 + i, "the very same text of many rows", "s2") for i in range(30)]
    docs = docs_of(rows + rows[:2])
    for c in ("_row", "score", "shard", "slot", "position", "h1", "_text", "component_fp", "_n"):
        docs = docs.withColumn(c, F.lit("mine"))
    out = stage(spark, docs, SF)
    got = out.collect()
    assert out.columns[:len(docs.columns)] == docs.columns and all(r._row == r.slot == r.shard == "mine" for r in got)
    ids = [r.doc_id for r in got]
    if name in ("mixing", "sharding", "toxicity"):
        assert len(got) == len(rows) + 2
    if name == "near_dedup":
        assert sum(60 <= (i or 0) < 90 for i in ids) == 1 and ids.count(0) == 1 and None in ids
    if name == "decontaminate":
        assert 50 not in ids and len(got) == len(rows) + 1
    assert stage(spark, docs.limit(0), SF).collect() == []


def test_runs_order_follows_the_mixing_stages_weights(spark, monkeypatch, tmp_path):
    docs = spark.range(16000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"),
                                     F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = table(spark, str(tmp_path), "documents")
    keep = lambda spark, docs, sf_dir: docs
    monkeypatch.setattr(cp, "STAGES", [(n, f if n in ("mixing", "sharding") else keep) for n, f in cp.STAGES])
    orders = []
    for heavy, weights in (("a", {"a": 3, "b": 1}), ("b", {"a": 1, "b": 3})):
        monkeypatch.setattr(cp, "WEIGHTS", weights)
        wanted = cp.mix(cp._rows(docs), carry=["_row"], weights=weights).orderBy("position").collect()
        got = sorted(cp.run(spark, str(tmp_path)).collect(), key=lambda r: r.position)
        assert [r.doc_id for r in got] == [r.doc_id for r in wanted]
        assert [r.position for r in got] == list(range(16000))
        assert abs(sum(r.source == heavy for r in got[:8000]) - 6000) <= 8
        orders.append([r.doc_id for r in got])
    assert orders[0] != orders[1]


def test_sharding_takes_the_order_of_the_files(spark, docs_of, tmp_path):
    path = str(tmp_path / "laid")
    items = [(i * 7919 % 997, f"text {i}", f"s{i % 3}") for i in range(997)]
    docs_of(items).coalesce(1).write.option("maxRecordsPerFile", 100).parquet(path)
    docs = spark.read.parquet(path)
    order = [r.doc_id for r in sorted(cp.sharding(spark, docs, SF).collect(), key=lambda r: r.position)]
    assert order == [i for i, _, _ in items]
    some = sorted(cp.sharding(spark, docs.where("doc_id % 3 = 0"), SF).collect(), key=lambda r: r.position)
    assert [r.doc_id for r in some] == [i for i in order if i % 3 == 0] and [r.position for r in some] == list(range(len(some)))


def test_order_of_the_mixture_survives_other_files(spark, docs_of, tmp_path):
    """Sharding finds the mixture by its rows: joined, split or renamed files change nothing."""
    docs = docs_of([(i, f"text {i}", f"s{i % 3}") for i in range(600)] + [(7, "text 7", "s1")] * 3 + [(None, None, None)] * 2)
    mixed = cp.settle(cp.mixing(spark, docs, SF), "mixed")
    want = sorted((r.position, r.doc_id, r.shard, r.slot) for r in cp.sharding(spark, mixed, SF).collect() if r.doc_id is not None)
    mixed.repartition(4, "text").write.parquet(str(tmp_path / "other"))
    got = cp.sharding(spark, spark.read.parquet(str(tmp_path / "other")), SF).collect()
    assert sorted((r.position, r.doc_id, r.shard, r.slot) for r in got if r.doc_id is not None) == want
    laid = [r.doc_id for r in mixed.coalesce(1).collect()]
    by = {r.position: r.doc_id for r in got}
    assert sorted(by) == list(range(605)) and set(laid) == set(by.values())
