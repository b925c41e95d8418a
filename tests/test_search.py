"""Trigram search against a scan, and what it reads."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rollcall.operators import search
from rollcall.operators.reports import search_visitors
from rollcall.sources.io import scratch_path

SCHEMA = ("visitor_id long, tenant_id int, event_id long, registration_code string, first_name string, last_name string, email string, "
          "category_id int, status string, registered_at timestamp_ntz")


def people(spark):
    names = [("Agus", "Wirawan"), ("agusta", None), ("BUDI", "AGUS-tin"), (None, None), ("", ""), ("Élodie", "İnan"), ("10%", "a_b"), ("ab", "c"), ("Ann\\e", "x")]
    rows = [(i, i % 3, i % 5, f"VIP24{i:04d}" if i % 4 else None, *names[i % len(names)], f"u{i % 70}@example.com", 1 + i % 4, "registered", None) for i in range(900)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def index(spark):
    old = search.BLOCK_ROWS, search.PAGE
    search.BLOCK_ROWS, search.PAGE = 50, 8
    yield search.build(people(spark))
    search.BLOCK_ROWS, search.PAGE = old


def ids(df):
    return [r.visitor_id for r in df.collect()]


TERMS = ["agus", "AGUS", "gus-t", "wira", "ab", "a", "", "u6", "u69@", "example.com", "24001", "%", "u_9@", "ag%an", "0\\%", "a\\_b", "élo", "İna", "nobody", "zz", "vip24", "ann\\\\e"]


@pytest.mark.parametrize("term", TERMS)
@pytest.mark.parametrize("only", [{}, {"tenant_id": 2, "event_id": 4}])
def test_same_rows_as_a_scan(spark, dom, index, term, only):
    want = ids(search_visitors(people(spark), dom.categories, term, limit=1000, **only))
    assert ids(search.search(index, dom.categories, term, limit=1000, **only)) == want
    page = ids(search.search(index, dom.categories, term, limit=7, offset=3, **only))
    assert page == want[3:10]


def test_rarest_trigram_first_and_when_a_scan_is_as_good(index):
    assert index.chosen("u69@example")[0] in ("69@", "u69")
    assert index.chosen("example.com") is None     # every row holds it
    assert index.chosen("ab") is None and index.chosen("_%") is None
    assert index.chosen("qqq") == []


def test_postings_are_sorted_bounded_and_complete(spark, index):
    lists = index.postings
    assert lists.where("ids <> array_sort(ids)").count() == 0
    assert lists.agg(F.max(F.size("ids"))).first()[0] <= 40       # "com" is in all 900 rows
    got = {(r.trigram, r.id) for r in lists.select("trigram", F.explode("ids").alias("id")).collect()}
    want = set()
    for r in people(spark).collect():
        for f in (r.first_name, r.last_name, r.email, r.registration_code):
            low = (f or "").replace("İ", "i̇").lower()
            want |= {(low[i:i + 3], r.visitor_id) for i in range(len(low) - 2)}
    assert got == want
    assert {(r.trigram, r.n) for r in index.counts.collect()} == {(g, sum(1 for x, _ in want if x == g)) for g in {g for g, _ in want}}


def test_lookup_reads_one_bucket_and_few_blocks(index):
    plan = index.lookup(["wir"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan or "PartitionFilters: [(_bucket" in plan
    assert "EqualTo(trigram,wir)" in plan or "In(trigram, [wir])" in plan
    blocks = index.candidates("VIP240005").select("_block").distinct().count()
    assert 0 < blocks < index.blocks
    plan = index.matching("VIP240005")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_block#" in plan or "PartitionFilters: [isnotnull(_block#" in plan


def test_added_rows_are_found_and_the_index_opens_again(spark, dom, index):
    made = search.build(people(spark), scratch_path(spark, "trigrams"))
    more = spark.createDataFrame([(5000, 1, 1, None, "Agusman", None, "new@example.org", 1, "registered", None), (None, 1, 1, None, "Agus", None, None, 1, "x", None)], SCHEMA)
    made.add(more)
    again = search.open_index(spark, made.path)
    whole = people(spark).unionByName(more.where("visitor_id IS NOT NULL"))
    for term in ("agus", "agusm", "new@", "example.org"):
        assert ids(search.search(again, dom.categories, term, limit=2000)) == ids(search_visitors(whole, dom.categories, term, limit=2000))


def test_empty_table(spark, dom):
    none = search.build(people(spark).limit(0))
    for term in ("agus", "a"):
        assert ids(search.search(none, dom.categories, term)) == []
