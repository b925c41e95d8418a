from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

import pyarrow as pa
from rollcall.llm import line_dedup
from pyspark.sql import functions as F

from docs_fixture import docs_of  # noqa: F401 (fixture)
from rollcall.llm.line_dedup import PerfectHash, drop_frequent_lines


def brute(items, min_chars=20, min_docs=3):
    def key(line):
        k = re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line)
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in k)
    docs = [(i, (t or "").split("\n")) for i, t in items]
    held = defaultdict(set)
    for i, lines in docs:
        for x in lines:
            if len(key(x)) >= min_chars:
                held[key(x)].add(i)
    out = []
    for i, lines in docs:
        kept = [x for x in lines if not (len(held[key(x)]) >= min_docs and i != max(held[key(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


LONG = "The same boiler plate line of the site"
CASES = {
    "plain": [(0, f"a\n{LONG}\nb"), (1, f"{LONG.upper()}  \n c"), (2, f"\t{LONG}\x0b\n{LONG}\nx"), (9, "")],
    "two only": [(0, LONG), (1, LONG), (2, LONG + "!")],
    "short": [(i, "nineteen characters"[:19]) for i in range(5)],
    "code points": [(i, "é" * 19 + "\n" + "é" * 20) for i in range(4)],
    "upper is ascii": [(0, "É" * 25), (1, "é" * 25), (2, "É" * 25), (3, "É" * 25)],
    "null": [(0, None), (1, None), (2, "\n\n")],
    "very long": [(i, "\n".join(f"line number {j % 50} of the long text" for j in range(20000))) for i in range(4)],
    "empty": [],
}


@pytest.mark.parametrize("case", CASES)
def test_as_brute_force(docs_of, case):
    got = drop_frequent_lines(docs_of(CASES[case]), digest=True).collect()
    assert sorted(map(tuple, got)) == brute(CASES[case])


def test_repeated_rows_null_ids_and_clashing_columns(spark, docs_of):
    from pyspark.sql import functions as F
    docs = docs_of([(1, LONG), (1, LONG), (2, LONG), (None, "x\n" + LONG)]).withColumn("_drops", F.lit(1)).withColumn("h1", F.lit("z"))
    got = sorted((tuple(r) for r in drop_frequent_lines(docs, carry=["h1"]).collect()), key=str)
    assert got == sorted([(1, "z", 1, 1, ""), (1, "z", 1, 1, ""), (2, "z", 1, 0, LONG), (None, "z", 2, 1, "x")], key=str)


def test_perfect_hash_is_minimal_and_perfect():
    keys = np.unique(np.random.default_rng(3).integers(0, 2**63, 20000).astype(np.uint64))
    mphf = PerfectHash.build(keys)
    assert sorted(mphf.slots(keys)) == list(range(len(keys)))
    assert PerfectHash.build(keys[:0]).slots(keys[:5]).tolist() == [-1] * 5


def test_few_keys_per_shard(docs_of, monkeypatch):
    monkeypatch.setattr("rollcall.llm.line_dedup.KEYS_PER_SHARD", 7)
    items = [(i, "\n".join(f"this is the common line number {j}" for j in range(i % 40, 60))) for i in range(60)]
    assert sorted(map(tuple, drop_frequent_lines(docs_of(items), digest=True).collect())) == brute(items)


def test_clashing_names(docs_of):
    line = "a line that many documents hold"
    docs = docs_of([f"{line}\nown {i}" for i in range(5)])
    names = ["doc", "_text", "_doc", "_drops", "_row", "n_lines", "kept", "key", "h1"]
    for c in names:
        docs = docs.withColumn(c, F.lit("mine"))
    out = drop_frequent_lines(docs, carry=names)
    assert {"n_lines_of_row", "kept_of_row"} <= set(out.columns) and len(set(out.columns)) == len(out.columns)
    got = {r.doc_id: r for r in out.collect()}
    assert got[4].kept == f"{line}\nown 4" and got[0].kept == "own 0" and all(r.kept_of_row == r._text == r.doc == "mine" for r in got.values())


def test_equal_keys_are_refused_and_meeting_values_probed_exactly(monkeypatch):
    with pytest.raises(ValueError):
        line_dedup.PerfectHash.build(np.array([5, 7, 5], np.uint64))
    monkeypatch.setattr(line_dedup, "joined", lambda a, b: (a.view(np.uint64) % np.uint64(4)))
    h1, h2 = np.arange(8, dtype="<i8"), np.arange(100, 108, dtype="<i8")
    heavy = pa.table({"shard": pa.array([0] * 8, pa.int32()), "h1": h1, "h2": h2, "n": np.full(8, 3), "keep": np.arange(8)})
    index = line_dedup._index_of(1)((pa.scalar(0),), heavy)
    lines = pa.table({"h1": np.r_[h1, h1], "h2": np.r_[h2, h2 + 1], "doc": np.r_[np.arange(8), np.arange(8)] + np.r_[np.zeros(4, int), np.ones(12, int)]})
    got = line_dedup._probe(lines, index)
    assert got.column("doc").to_pylist() == [5, 6, 7, 8]
