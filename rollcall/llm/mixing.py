"""Mixing sources to target weights by Pfair scheduling.

Each source's rows stand in a fixed pseudo-random order and are cut into blocks,
one block a slot. In the ideal mixture all sources are served at once, each at
its weight's share among the sources that last; a source that is used up leaves
its share to the others. The time at which source i of weight w has had x blocks
there is t(x / w), where t(v) is the sum over all sources of min(v * weight,
blocks). Block j gets the Pfair window [floor(t(j / w)), ceil(t((j + 1) / w))):
its release time and its deadline. Earliest-deadline-first fills each slot with
a released block whose deadline comes first. The ideal mixture serves one block
a slot, so every block meets its window: at every slot, from the first to the
last, each source has had its ideal share to within less than one block.

Weights count as they are given: windows are computed in whole numbers from the
exact ratio of the weights, nothing is rounded before floor and ceil.

Rows are only touched by DataFrame operations: a row's number in its source
gives its block, and a written table of (source, block) gives the slot. The
driver makes that table in pieces of PIECE slots: it holds a few numbers for
each source and one piece, and its time is linear in the number of blocks.

A null source is a source of its own. Rows that repeat a ``doc_id`` are rows.
Weights: a mapping from source (None for null) to a positive weight; sources
without one get the smallest given weight. Without a mapping a source of n
rows has weight n ** ALPHA. An empty table gives no rows. Texts play no part
unless they are carried, of whatever length they are.
"""

from __future__ import annotations

import heapq
import math
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import numbered, settle
from rollcall.session import ensure_checkpoint_dir

BLOCK_ROWS, ALPHA = 8, 0.7
#: Slots that the driver schedules and writes at a time.
PIECE = 1 << 18


def whole_weights(weights: list[float]) -> list[int]:
    """Integers in exactly the ratio of the weights."""
    exact = [Fraction(w) for w in weights]
    scale = math.lcm(*[x.denominator for x in exact])
    return [x.numerator * (scale // x.denominator) for x in exact]


def windows(blocks: list[int], weights: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """(source, block, release, deadline) of every slot, in order. There is a
    block of each source; weights are positive integers."""
    shift = 2 * max(w.bit_length() for w in weights)     # two different ratios differ by more than 2 ** -shift
    order = sorted(range(len(blocks)), key=lambda i: (blocks[i] << shift) // weights[i])
    ends = [blocks[i] / weights[i] for i in order]
    done, active = [0], [sum(weights)]      # before the k-th source ends: blocks of those that have, weights of the others
    for i in order[:-1]:
        done.append(done[-1] + blocks[i])
        active.append(active[-1] - weights[i])

    def times(i: int, j: int) -> tuple[int, int]:
        """Floor and ceiling of the time at which source i has had j blocks."""
        w = weights[i]
        k = min(bisect_left(ends, j / w), len(order) - 1)
        while blocks[order[k]] * w < j * weights[order[k]]:
            k += 1
        while k and blocks[order[k - 1]] * w >= j * weights[order[k - 1]]:
            k -= 1
        part = j * active[k]
        return done[k] + part // w, done[k] - (-part // w)

    block, release = [0] * len(blocks), [0] * len(blocks)
    after = [times(i, 1) for i in range(len(blocks))]    # of the current block's end
    ready = [(after[i][1], i) for i in range(len(blocks))]
    heapq.heapify(ready)
    later: list[tuple[int, int]] = []
    for slot in range(sum(blocks)):
        while later and later[0][0] <= slot:
            i = heapq.heappop(later)[1]
            heapq.heappush(ready, (after[i][1], i))
        deadline, i = heapq.heappop(ready)
        assert slot < deadline
        yield i, block[i], release[i], deadline
        block[i] += 1
        if block[i] < blocks[i]:
            release[i], after[i] = after[i][0], times(i, block[i] + 1)
            heapq.heappush(later, (release[i], i))


def schedule(docs: DataFrame, source_col: str = "source", weights: dict | None = None, block_rows: int = BLOCK_ROWS,
             alpha: float = ALPHA, path: str | None = None) -> DataFrame:
    """The written plan, one row for each block: its source, windows, slot and
    the position of its first row. Any table of the same sources and sizes can
    be placed by it. ``path``: where it is written, if not in a new folder."""
    spark = docs.sparkSession
    sizes = settle(docs.groupBy(_name(source_col).alias("_name")).agg(F.count(F.lit(1)).alias("n")), "sources")
    known = sizes.orderBy(F.desc("n"), "_name").toArrow()
    names, counts = known["_name"].to_pylist(), known["n"].to_pylist()
    if weights:
        given = {"" if k is None else f"={k}": w for k, w in weights.items()}
        least = min(given.values())
        wanted = [given.get(n, least) for n in names]
    else:
        wanted = [n ** alpha for n in counts]
    return _written_plan(spark, names, counts, whole_weights(wanted), block_rows, path)


def placed(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", source_col: str = "source", carry: list[str] = (),
           block_rows: int = BLOCK_ROWS, place: str | None = None) -> DataFrame:
    """As ``mix``, by a plan that is there. ``place``: a long that orders the rows
    of a source; a hash of the columns that are kept if there is none."""
    kept = list(dict.fromkeys([id_col, source_col, *carry]))
    order = F.xxhash64(*[docs[c] for c in kept]) if place is None else docs[place]
    rows = docs.select(F.struct(*[docs[c] for c in kept]).alias("_row"), _name(source_col).alias("_name"), order.alias("_place"))
    ranked = numbered(rows, "_name", "_place", "_n").withColumn("_block", F.expr(f"_n div {block_rows}"))
    found = ranked.join(plan, (F.col("_name") == F.col("name")) & (F.col("_block") == F.col("block")))
    added = [c for c, _ in _ADDED]
    return found.select(
        *[F.col(f"_row.`{c}`").alias(c if c not in added else f"{c}_of_row") for c in kept], F.col("share").alias("target_weight"),
        "block", "slot", "release", "deadline", (F.col("first") + F.expr(f"_n % {block_rows}")).alias("position"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", carry: list[str] = (),
        weights: dict | None = None, block_rows: int = BLOCK_ROWS, alpha: float = ALPHA) -> DataFrame:
    """``id_col``, ``source_col`` and the ``carry`` columns of every row, with
    target_weight, block, slot, release, deadline and ``position``, the row's
    place in the mixture, gapless from 0. A column that is kept and has one of
    these names comes back with ``_of_row`` appended."""
    return placed(docs, schedule(docs, source_col, weights, block_rows, alpha), id_col, source_col, carry, block_rows)


def _name(source_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))


_ADDED = [("target_weight", "double"), ("block", "long"), ("slot", "long"), ("release", "long"), ("deadline", "long"), ("position", "long")]
PLAN = "name string, share double, block long, slot long, release long, deadline long, first long"


def _written_plan(spark, names: list[str], counts: list[int], weights: list[int], block_rows: int, path: str | None) -> DataFrame:
    """One row per block; ``first`` is the position of the block's first row."""
    path = path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-mixture-{uuid.uuid4().hex}"
    spark.createDataFrame([], PLAN).write.mode("overwrite").parquet(path)
    if not names:
        return spark.read.schema(PLAN).parquet(path)
    whole = sum(weights)
    shares = [w / whole for w in weights]
    slots, slot, first = windows([-(-n // block_rows) for n in counts], weights), 0, 0
    while piece := list(islice(slots, PIECE)):
        source, block, release, deadline = zip(*piece)
        starts = []
        for i, j in zip(source, block):
            starts.append(first)
            first += min(block_rows, counts[i] - j * block_rows)
        cols = [pa.array([names[i] for i in source], pa.string()), pa.array([shares[i] for i in source], pa.float64()), pa.array(block, pa.int64()),
                pa.array(range(slot, slot + len(piece)), pa.int64()), pa.array(release, pa.int64()), pa.array(deadline, pa.int64()), pa.array(starts, pa.int64())]
        slot += len(piece)
        table = pa.Table.from_arrays(cols, ["name", "share", "block", "slot", "release", "deadline", "first"])
        spark.createDataFrame(table, PLAN).write.mode("append").parquet(path)
    return spark.read.schema(PLAN).parquet(path)
