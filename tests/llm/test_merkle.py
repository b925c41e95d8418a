from __future__ import annotations

from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from docs_fixture import docs_of  # noqa: F401 (fixture)
from rollcall.llm import merkle
from rollcall.llm.queries import merkle_manifest


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, lower=False):
    doc_id, text, lang, source, n_chars = row
    if lower and text is not None:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def grow(nodes):
    """Root and, for each leaf, its path: (place, siblings) level by level."""
    paths, where = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(s, min(s + 16, len(nodes))) for s in range(0, len(nodes), 16)]
        for run in runs:
            for k in run:
                for x in where[k]:
                    paths[x].append((k - run[0], [nodes[j] for j in run if j != k]))
        where = [[x for k in run for x in where[k]] for run in runs]
        nodes = [h(*[nodes[k] for k in run]) for run in runs]
    return nodes[0], paths


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        some = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = (some, *grow([leaf(r) for r in some]))
    root, tops = grow([trees[s][1] for s in names])
    out = []
    for s, top in zip(names, tops):
        some, sub, paths = trees[s]
        for r, p in zip(some, paths):
            tampered = r[0] is not None and crc32(str(r[0]).encode()) % 5 == 0
            folded = merkle.fold(leaf(r, tampered), [*p, *top])
            out.append((r[0], leaf(r), sub, root, h(*[d for _, o in [*p, *top] for d in o]), folded, folded == root))
    return sorted(out, key=str)


def rows_of(n):
    rows = []
    for i in range(n):
        source = None if i % 7 == 0 else "hot" if i % 3 else f"s{i % 40}-é"
        rows.append((i * 37 % 1009, None if i % 11 == 0 else f"Text {i} " * (i % 5), "en" if i % 4 else None, source, i if i % 5 else None))
    rows += [(None, "Null id", None, None, 3), (None, "Null id", None, None, 3), (5, "Again", "en", "hot", 1), (5, "Again", "en", "hot", 1), (6, "", "", "", 0)]
    return rows


@pytest.mark.parametrize("n, depth", [(0, 3), (1, 3), (300, 1), (700, 2), (420, 3)])
def test_equals_sequential_trees(spark, docs_of, n, depth):
    rows = rows_of(n)[:n] if n < 2 else rows_of(n)
    docs = spark.createDataFrame(rows, docs_of([]).schema).repartition(5)
    got = sorted((tuple(r) for r in merkle_manifest(docs, depth=depth).collect()), key=str)
    assert got == (brute(rows) if rows else [])


@pytest.mark.parametrize("n", [1, 15, 16, 17, 255, 256, 257, 4095, 4096, 4097, 5000])
def test_positions_are_the_postorder(n):
    """Nodes in the order in which an appender that reads leaf by leaf completes them."""
    levels, count = [], n
    while True:
        levels.append(count)
        if count == 1:
            break
        count = -(-count // 16)
    order = []
    for i in range(n):
        order.append((0, i))
        for level in range(1, len(levels)):
            if (i + 1) % 16 ** level == 0 or i == n - 1:
                order.append((level, i // 16 ** level))
    place = {}
    for level, count in enumerate(levels):
        index = np.arange(count)
        place |= {(level, int(k)): int(p) for k, p in zip(index, merkle.position(level, index, np.minimum((index + 1) * 16 ** level, n)))}
    assert [place[x] for x in order] == list(range(len(order)))


def test_log_is_gapless_and_blocks_are_bounded(spark):
    leaves = spark.range(700).select(F.lit("t").alias("tree"), F.col("id").alias("i"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    made = merkle.forest(leaves, depth=1)
    assert len(made.rounds) == 3
    places = sorted(r.position for r in made.log.collect())
    assert places == list(range(700 + 44 + 3 + 1))
    assert made.rounds[0].groupBy("tree", "block").count().agg(F.max("count")).first()[0] <= 17


def test_columns_with_clashing_names(spark, docs_of):
    docs = spark.createDataFrame(rows_of(40), docs_of([]).schema)
    for c in ("tree", "i", "digest", "leaf", "root", "_row", "_n", "proof"):
        docs = docs.withColumn(c, F.lit("x"))
    m = merkle.manifest(docs, "source", "doc_id", merkle.leaf_of(F.col("doc_id"), F.col("text")), carry=["root", "tree", "proof"])
    out = merkle.prove(m)
    assert {"root_of_row", "tree", "proof_of_row"} <= set(out.columns)
    assert all(r.verified and r.root_of_row == "x" and isinstance(r.proof, list) for r in out.collect())
