from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docs_fixture import docs_of  # noqa: F401 (fixture)
from rollcall.llm import licenses
from rollcall.llm.queries import license_scan

SMALL = "/root/testdata/sf0.001"
BASE = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    places, labels = [], set()
    for label, phrase in BASE.items():
        want = phrase.split()
        found = [i for i in range(len(words)) if words[i:i + len(want)] == want]
        places += found
        labels |= {label} if found else set()
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))


def scanned(docs):
    return {r.doc_id: r for r in license_scan(docs).collect()}


def test_base_columns_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = scanned(docs)
    for r in docs.collect():
        g = got[r.doc_id]
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == brute(r.text)
        assert set(filter(None, g.base_labels.split(","))) <= set(filter(None, g.labels.split(",")))
        assert 0 <= g.score <= 1


def test_base_places_in_dense_texts(docs_of):
    random.seed(4)
    vocabulary = ["cc", "by", "general", "public", "license", "all", "rights", "reserved", "CC", "General", "é", "x1", "\x7f", "-"]
    texts = [" ".join(random.choices(vocabulary, k=random.randrange(60))) for _ in range(200)]
    texts += [None, "", "---", "cc by " * 5000, "all rights all rights reserved", "cc\x00by", "General-Public_License", "ccby cc by", "CC BY-SA"]
    got = scanned(docs_of(texts))
    for i, t in enumerate(texts):
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels) == brute(t), t


FILL = "the quick survey of rivers and hills was finished before winter came to any person in the valley with free time".split()


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choices(FILL, k=n))


@pytest.mark.parametrize("label, text, _", licenses.TEMPLATES)
def test_each_notice_is_found_in_prose(docs_of, label, text, _):
    docs = docs_of([prose(300, 1) + " " + text.upper() + " " + prose(200, 2), prose(500, 3)])
    got = scanned(docs)
    assert label in got[0].labels.split(",") and got[0].score >= 0.9
    assert got[1].labels == "" and got[1].score == 0


def test_altered_notice_and_missing_key_phrase(docs_of):
    mit = next(t for n, t, _ in licenses.TEMPLATES if n == "mit")
    shifted = mit.replace("to any person", "by Example Person of Somewhere 2024 to any person")
    without = mit.replace("free of charge", "at a charge")
    both = shifted + "\n" + prose(2000, 5) + "\n" + next(t for n, t, _ in licenses.TEMPLATES if n == "bsd")
    scattered = " ".join(sum(([w, *FILL] for w in mit.split()), []))
    got = scanned(docs_of([shifted, without, both, scattered]))
    assert got[0].labels == "mit"
    assert got[1].labels == ""
    assert got[2].labels == "bsd,mit"
    assert got[3].labels == ""


def test_counts_cover_all_documents_and_ties(docs_of):
    docs = docs_of(["mit license"] * 7 + ["all rights reserved"] * 3 + [None])
    index = licenses.build_index(docs.repartition(4))
    assert index.idf[b"mit"] < index.idf[b"reserved"] < index.idf[b"apache"]


def test_clashing_names_nulls_and_empty_table(spark, docs_of):
    docs = docs_of([(None, "cc by"), (3, None), (3, None)])
    for c in ("labels", "score", "_row", "_text", "word"):
        docs = docs.withColumn(c, F.lit("x"))
    out = licenses.scan_licenses(docs, carry=["doc_id", "labels", "score", "_row"])
    assert {"labels_of_row", "score_of_row", "_row"} <= set(out.columns)
    assert sorted((r.doc_id is None, r.n_words, r.score, r._row) for r in out.collect()) == [(False, 0, 0.0, "x")] * 2 + [(True, 2, 1.0, "x")]
    empty = license_scan(docs_of([]))
    assert empty.count() == 0 and empty.schema["first_word"].dataType == T.LongType()
