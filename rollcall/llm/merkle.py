"""Merkle dataset manifest: a forest of 16-ary hash trees in a postorder append log.

Each row is a leaf. The leaves of one source stand by id (null ids first, rows
of one id by their leaf's bytes) and make a tree: while there are several
nodes, every ``FAN`` consecutive ones, the last run's fewer or even one, become
their hash. What remains is the source's subroot; the subroots, ordered by
source (null first, UTF-8 bytewise), make the top tree in the same way, and
what remains there is the root. A digest enters the next hash as hex text.

- **Builders** take an aligned block of ``FAN ** depth`` leaves each and append
  a node to the log as soon as its subtree is complete. A block is bounded, so
  a source that holds most rows is many blocks; the roots of the blocks are the
  leaves of the next round's builders, until each tree has one.
- **Positions** in a tree's log are closed-form: before a node stand its own
  subtree, the nodes of its level before it and the larger subtrees that ended
  before it began, all counts of whole powers of ``FAN``. So a builder places
  its nodes without knowing any other builder's, and a proof finds siblings by
  position, without searching.
- **Proofs** are taken block by block: a leaf's siblings inside the block come
  from the block's slice of the log, those above it are the same for the whole
  block and are handed down round by round, the top tree's first.

Null values hash as ``-``, so a null differs from an empty text. Rows that
repeat stay leaves of their own, each with its own proof. A text of any length
is hashed whole, in one row. An empty table has no log, no proofs and a null
root. Other columns and their names play no part: rows are taken by the named
columns, carried ones travel in a struct.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.llm.common import settle
from rollcall.operators.common import number_within_groups

FAN, DEPTH = 16, 3
_LOG = "tree string, block long, level int, i long, end long, position long, digest binary, root boolean"
_PATH = "array<struct<at:int,others:array<string>>>"


def leaf_of(*values: Column) -> Column:
    """SHA-256 of the values in order, each ``-`` if null, else its length in
    bytes, ``:`` and the value; as bytes."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def position(level: int, index: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Place in the tree's postorder log of the ``index``-th nodes of a level;
    ``end`` is the leaf after a node's last."""
    first = index * FAN ** level
    at = index + (end if level else 0)
    for lower in range(1, level):
        at = at - (-end // FAN ** lower)
    width = FAN ** (level + 1)
    while len(first) and int(first.max()) >= width:
        at = at + first // width
        width *= FAN
    return at


def _parent(hexes: list[str]) -> bytes:
    return sha256("".join(hexes).encode()).digest()


def _builder(round_: int, depth: int):
    """Builds one aligned block; writes its nodes in the order of completion."""
    low, size = depth * round_, FAN ** depth

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("i").to_numpy())
        index, end = t.column("i").to_numpy()[order], t.column("end").to_numpy()[order]
        digests = t.column("digest").take(pa.array(order)).to_pylist()
        alone = index[0] == 0 and len(index) < size     # the tree's only block: it ends with its root
        levels = [(low, index, end, digests)]
        for level in range(low + 1, low + depth + 1):
            if alone and len(digests) == 1:
                break
            hexes, runs = [d.hex() for d in digests], np.arange(0, len(digests), FAN)
            digests = [_parent(hexes[s:s + FAN]) for s in runs]
            index, end = index[runs] // FAN, end[np.minimum(runs + FAN, len(end)) - 1]
            levels.append((level, index, end, digests))
        top = levels[-1]
        if round_:
            levels = levels[1:]     # the round before has written its roots
        place = np.concatenate([position(*x[:3]) for x in levels])
        done = pa.array(np.argsort(place))
        whole = {
            "level": np.repeat([x[0] for x in levels], [len(x[1]) for x in levels]).astype(np.int32),
            "i": np.concatenate([x[1] for x in levels]), "end": np.concatenate([x[2] for x in levels]), "position": place}
        n = len(place)
        cols = {"tree": pa.array([key[0].as_py()] * n, pa.string()), "block": pa.array([key[1].as_py()] * n, pa.int64()),
                **{k: pa.array(v) for k, v in whole.items()}, "digest": pa.array([d for x in levels for d in x[3]], pa.binary()),
                "root": pa.array(whole["level"] == top[0])}
        return pa.table(cols).take(done)
    return run


@dataclass
class Forest:
    """``rounds``: the written log, one table for each round of builders;
    ``roots``: (tree, digest)."""

    rounds: list[DataFrame]
    roots: DataFrame
    depth: int

    @property
    def log(self) -> DataFrame:
        """All nodes: (tree, level, i, position, digest)."""
        out = self.rounds[0]
        for more in self.rounds[1:]:
            out = out.unionByName(more)
        return out.select("tree", "level", "i", "position", "digest")

    def block(self) -> Column:
        return F.expr(f"i div {FAN ** self.depth}")

    def slice_of(self, round_: int, upper: DataFrame | None) -> DataFrame:
        """Per (tree, block) the nodes that a proof may ask for, and one row (of
        level -1) with what stands above the block."""
        none = [F.lit(None).cast(_PATH).alias("own"), F.lit(None).cast(_PATH).alias("top"), F.lit(None).cast("binary").alias("subroot")]
        nodes = ["tree", "block", "level", "i", "end", "position", "digest"]
        some = self.rounds[round_].select(*nodes, *none)
        if round_:
            below = self.rounds[round_ - 1].where("root").withColumn("block", self.block())
            some = some.unionByName(below.select(*nodes, *none).join(self.rounds[round_].select("tree").distinct(), "tree", "left_semi"))
        if upper is not None:
            zero = {"level": F.lit(-1), "i": F.lit(0).cast("long"), "end": F.lit(0).cast("long"), "position": F.lit(-1).cast("long"),
                    "digest": F.lit(None).cast("binary")}
            some = some.unionByName(upper.withColumns({**zero, **{c: F.lit(None).cast("binary" if c == "subroot" else _PATH)
                                                                   for c in ("own", "top", "subroot") if c not in upper.columns}}))
        return some

    def paths(self, round_: int = 0) -> DataFrame:
        """(tree, i, own): for each leaf of a round's blocks the path to its
        tree's root, level by level: place among its siblings, and these."""
        upper = self.paths(round_ + 1).withColumnRenamed("i", "block") if round_ + 1 < len(self.rounds) else None
        found = self.slice_of(round_, upper).groupBy("tree", "block").applyInArrow(_leaf_paths(self.depth * round_), f"tree string, i long, own {_PATH}")
        return settle(found, "paths")


def forest(leaves: DataFrame, depth: int = DEPTH) -> Forest:
    """The trees over ``leaves`` (tree, i, digest); ``i`` counts the leaves of a
    tree from 0, neither is null."""
    rounds, roots = [], []
    now = leaves.withColumn("end", F.col("i") + 1)
    while True:
        built = settle(now.withColumn("block", F.expr(f"i div {FAN ** depth}")).groupBy("tree", "block")
                       .applyInArrow(_builder(len(rounds), depth), _LOG), "log")
        rounds.append(built)
        tops = built.where("root")
        # Trees of several blocks go on: one row for each block of a tree that has a second.
        more = settle(tops.where("block > 0").select("tree").distinct(), "growing")
        roots.append(tops.join(more, "tree", "left_anti").select("tree", "digest"))
        if more.isEmpty():
            break
        now = tops.join(more, "tree", "left_semi").select("tree", F.col("block").alias("i"), "end", "digest")
    out = roots[0]
    for some in roots[1:]:
        out = out.unionByName(some)
    return Forest(rounds, settle(out, "roots"), depth)


def _runs(t: pa.Table, low: int) -> tuple[int, list[list[list[str]]]]:
    """The block's first leaf, and for each level under its root the runs of
    siblings as hex, addressed by their positions in the log."""
    place = t.column("position").to_numpy()
    order = np.argsort(place)
    place, digest = place[order], t.column("digest")
    level, index = t.column("level").to_numpy(), t.column("i").to_numpy()
    last, base = int(t.column("end").to_numpy().max()), int(index[level == low].min())
    out = []
    for up in range(low, int(level.max())):
        index = np.arange(base // FAN ** (up - low), -(-last // FAN ** up))
        wanted = position(up, index, np.minimum((index + 1) * FAN ** up, last))
        at = np.searchsorted(place, wanted)
        assert (place[at] == wanted).all()
        hexes = [d.hex() for d in digest.take(pa.array(order[at])).to_pylist()]
        out.append([hexes[s:s + FAN] for s in range(0, len(hexes), FAN)])
    return base, out


def _path(runs: list[list[list[str]]], leaf: int) -> list[tuple[int, list[str]]]:
    out = []
    for level in runs:
        run, at = level[leaf // FAN], leaf % FAN
        out.append((at, run[:at] + run[at + 1:]))
        leaf //= FAN
    return out


def _above(t: pa.Table, name: str) -> list[tuple[int, list[str]]]:
    found = [x for x in t.column(name).to_pylist() if x is not None]
    return [(x["at"], x["others"]) for x in found[0]] if found else []


def _split(t: pa.Table) -> tuple[pa.Table, pa.Table]:
    node = pa.array(t.column("level").to_numpy() >= 0)
    return t.filter(node), t.filter(pc.invert(node))


def _leaf_paths(low: int):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        nodes, upper = _split(t)
        above = _above(upper, "own")
        base, runs = _runs(nodes, low)
        n = int((nodes.column("level").to_numpy() == low).sum())
        own = [[{"at": a, "others": o} for a, o in [*_path(runs, j), *above]] for j in range(n)]
        kind = pa.list_(pa.struct([("at", pa.int32()), ("others", pa.list_(pa.string()))]))
        return pa.table({"tree": pa.array([key[0].as_py()] * n, pa.string()), "i": pa.array(range(base, base + n), pa.int64()),
                         "own": pa.array(own, kind)})
    return run


def fold(digest: str, path: Sequence[tuple[int, Sequence[str]]]) -> str:
    """The root that a leaf and its siblings give."""
    for at, others in path:
        digest = sha256("".join([*others[:at], digest, *others[at:]]).encode()).hexdigest()
    return digest


@dataclass
class Manifest:
    """The trees of the sources, the top tree over their subroots, ``root`` as
    hex (None without rows), ``leaves``: (tree, i, digest, claim, _row), and
    ``above``: each tree's subroot and its path in the top tree."""

    sources: Forest
    top: Forest
    root: str | None
    leaves: DataFrame
    above: DataFrame


def manifest(docs: DataFrame, source: str, order: str, leaf: Column, claim: Column | None = None, carry: Sequence[str] = (),
             depth: int = DEPTH) -> Manifest:
    """Builds and writes the manifest. ``claim``: the leaf to be checked against
    it, if not the row's own. ``carry``: columns that proofs give back."""
    kept = list(dict.fromkeys([order, *carry]))
    name = F.coalesce(F.concat(F.lit("="), docs[source].cast("string")), F.lit(""))
    slim = docs.select(name.alias("tree"), docs[order].alias("_order"), leaf.alias("digest"),
                       (leaf if claim is None else F.coalesce(claim, leaf)).alias("claim"), F.struct(*[docs[c] for c in kept]).alias("_row"))
    # The last key of the order is the row's own number, so rows that are all alike spread over the pieces too.
    slim = settle(slim.withColumn("_nth", F.monotonically_increasing_id()), "leaves")
    placed = number_within_groups(slim, ["tree"], ["_order", "digest", "_nth"], out="_n")
    leaves = settle(placed.select("tree", (F.col("_n") - 1).alias("i"), "digest", "claim", "_row"), "placed")
    sources = forest(leaves.select("tree", "i", "digest"), depth)
    ranked = number_within_groups(sources.roots.withColumn("_all", F.lit(0)), ["_all"], ["tree"], out="_n")
    ranked = settle(ranked.select(F.col("tree").alias("source"), F.lit("").alias("tree"), (F.col("_n") - 1).alias("i"), "digest"), "subroots")
    top = forest(ranked.drop("source"), depth)
    root = top.roots.first()    # one row
    above = top.paths().withColumnRenamed("own", "top").join(ranked.select("i", "source", F.col("digest").alias("subroot")), "i")
    above = settle(above.select(F.col("source").alias("tree"), "top", "subroot"), "above")
    return Manifest(sources, top, bytes(root.digest).hex() if root else None, leaves, above)


def prove(m: Manifest, digest: bool = False) -> DataFrame:
    """For every leaf its carried columns, ``leaf``, ``subroot`` and ``root``,
    ``proof`` (its siblings level by level, left to right), ``folded_root``, what
    the claim and the siblings give, and ``verified``: whether that is the root.
    With ``digest``, ``proof`` is the SHA-256 of the siblings joined."""
    kind = T.StringType() if digest else T.ArrayType(T.StringType())
    row = m.leaves.schema["_row"]
    names = ["leaf", "subroot", "root", "folded_root"]
    schema = T.StructType([row, *[T.StructField(c, T.StringType()) for c in names], T.StructField("proof", kind)])
    blocks = m.sources.rounds[0].where("root").select("tree", "block")
    if len(m.sources.rounds) > 1:
        blocks = blocks.join(m.sources.paths(1).withColumnRenamed("i", "block"), ["tree", "block"], "left")
    upper = blocks.join(m.above, "tree")
    keys = ["tree", "block"]
    left = m.sources.slice_of(0, upper).groupBy(*keys)
    right = m.leaves.withColumn("block", m.sources.block()).groupBy(*keys)
    found = left.cogroup(right).applyInArrow(_proofs(m.root, digest), schema)
    taken = set(names) | {"proof", "verified"}
    back = [F.col(f"_row.`{c}`").alias(c if c not in taken else f"{c}_of_row") for c in row.dataType.names]
    return found.select(*back, *names, "proof", (F.col("folded_root") == F.col("root")).alias("verified"))


def _proofs(root: str | None, digest: bool):
    def run(log: pa.Table, rows: pa.Table) -> pa.Table:
        nodes, upper = _split(log)
        base, runs = _runs(nodes, 0)
        own, top = _above(upper, "own"), _above(upper, "top")
        subroot = [d for d in upper.column("subroot").to_pylist() if d][0].hex()
        proofs, folded = [], []
        for i, claim in zip(rows.column("i").to_pylist(), rows.column("claim").to_pylist()):
            path = [*_path(runs, i - base), *own, *top]
            siblings = [d for _, others in path for d in others]
            proofs.append(sha256("".join(siblings).encode()).hexdigest() if digest else siblings)
            folded.append(fold(claim.hex(), path))
        n = rows.num_rows
        return pa.table({"_row": rows.column("_row"), "leaf": pa.array([d.hex() for d in rows.column("digest").to_pylist()], pa.string()),
                         "subroot": pa.array([subroot] * n, pa.string()), "root": pa.array([root] * n, pa.string()),
                         "folded_root": pa.array(folded, pa.string()),
                         "proof": pa.array(proofs, pa.string() if digest else pa.list_(pa.string()))})
    return run
