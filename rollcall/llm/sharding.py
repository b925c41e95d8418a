"""Sharding: minimax contiguous partition of ordered atomic groups.

Rows of one group (equal texts) stay together. Groups stand in a fixed order
and are cut into ``shards`` contiguous runs so that the largest run is as small
as it can be: a binary search over integer capacities, each checked greedily
(fill a shard to the capacity, cut, go on), finds the smallest feasible one.
The cuts keep that capacity; where it leaves a choice, each cut is the one
nearest to an equal share of what is left, so that no shard stays empty while
another is filled up.

The greedy check only asks for the last group end at or before a position.
Group ends are a table of prefix sums and never leave Spark: the driver holds
a summary of at most 4096 slices of positions (first end, last end, number of
ends), runs search and cuts on the ends that it knows, and asks Spark to refine
those slices alone inside which an answer depended, 64 times finer, until none
does. Then every answer was exact.

Sizes are not negative; null sizes count 0. An empty table gives no rows.
More shards than groups leave shards empty. Null is a value like others in a
group's key. Groups of one place in the order stand by their key; rows that
repeat are one group and keep a slot each. Texts play no part but by their size.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollcall.llm import common
from rollcall.llm.common import numbered, settle, slice_of

SLICES, FINER = 4096, 64


class Ends:
    """Group ends, known up to slices: (first, last, number of ends) each."""

    def __init__(self):
        self.slices: dict[tuple[int, int], tuple[int, int, int]] = {}
        self.touched: set[tuple[int, int]] = set()
        self.order: list = []

    def put(self, found: dict[tuple[int, int], tuple[int, int, int]], instead_of=()) -> None:
        for k in instead_of:
            del self.slices[k]
        self.slices |= found
        self.order = sorted((*v, k) for k, v in self.slices.items())
        self.first, self.last = [x[0] for x in self.order], [x[1] for x in self.order]
        self.touched = set()

    def floor(self, x: int) -> int:
        """The last known end at or before ``x``; 0 before the first."""
        i = bisect_right(self.first, x) - 1
        if i < 0:
            return 0
        first, last, n, key = self.order[i]
        if x >= last:
            return last
        if n > 2:
            self.touched.add(key)
        return first

    def ceil(self, x: int) -> int:
        """The first known end at or after ``x`` (0 is one)."""
        if x <= 0:
            return 0
        i = bisect_left(self.last, x)
        first, last, n, key = self.order[i]
        if x <= first:
            return first
        if n > 2 and x < last:
            self.touched.add(key)
        return last


def smallest_capacity(ends: Ends, total: int, largest: int, shards: int) -> int:
    def fits(capacity: int) -> bool:
        at = 0
        for _ in range(shards):
            to = ends.floor(at + capacity)
            if to >= total:
                return True
            if to == at:
                return False
            at = to
        return False
    low = max(largest, -(-total // shards))
    high = -(-total // shards) + largest
    while not fits(high):   # only while slices hide ends
        high += max(1, high)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


def balanced_cuts(ends: Ends, total: int, capacity: int, shards: int) -> list[int]:
    """shards - 1 cuts at group ends; no part is above the capacity."""
    least = [0] * shards + [total]      # earliest cut after which the rest still fits
    for i in range(shards - 1, 0, -1):
        least[i] = ends.ceil(least[i + 1] - capacity)
    cuts, at = [], 0
    for i in range(1, shards):
        most = ends.floor(at + capacity)
        want = at + (total - at) // (shards - i + 1)
        before, after = ends.floor(want), ends.ceil(want)
        pick = after if after <= most and (before <= at or after - want < want - before) else before
        at = min(max(pick, least[i], at), most)
        cuts.append(at)
    return cuts


def minimax_cuts(ends: DataFrame, total: int, largest: int, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity and the cuts, from the table of group ends (``end``)."""
    if total <= 0:
        return 0, [0] * (shards - 1)
    widths = [-(-(total + 1) // SLICES)]

    def slices(level: int, parents: list[int]) -> dict:
        """Summary of the ends inside these slices of the level above."""
        while len(widths) <= level:
            widths.append(-(-widths[-1] // FINER))
        above = F.expr(f"end div {widths[level - 1]}") if level else F.lit(0)
        some = ends.withColumn("above", above)
        some = some.where(F.col("above").isin(parents)) if level else some
        return {(level, r.above, r.k): (r.a, r.b, r.n) for r in
                some.groupBy("above", F.expr(f"end div {widths[level]}").alias("k")).agg(
                    F.min("end").alias("a"), F.max("end").alias("b"), F.count(F.lit(1)).alias("n")).collect()}

    known = Ends()
    known.put(slices(0, []))
    while True:
        capacity = smallest_capacity(known, total, largest, shards)
        cuts = balanced_cuts(known, total, capacity, shards)
        if not known.touched:
            return capacity, cuts
        found, gone = {}, list(known.touched)
        for level in sorted({k[0] for k in gone}):
            found |= slices(level + 1, [k[2] for k in gone if k[0] == level])
        known.put(found, gone)


def shard_rows(rows: DataFrame, group: list[str], size: str, order: str, place: str, shards: int) -> DataFrame:
    """``rows`` with ``shard`` and ``slot`` (gapless from 0 in each shard).

    ``group``: columns that name a row's group; ``size``: a row's size;
    ``order``: a long by which groups (by their least one) are ordered;
    ``place``: a long that orders the rows of a shard. Both should spread
    evenly over their range, as hashes and dense positions do. Columns named
    ``shard`` or ``slot`` come back with ``_of_row`` appended.
    """
    back = [F.col(f"_row.`{c}`").alias(f"{c}_of_row" if c in ("shard", "slot") else c) for c in rows.columns]
    keys = [f"_g{i}" for i in range(len(group))]
    rows = settle(rows.select(F.struct(*[rows[c] for c in rows.columns]).alias("_row"), *[rows[g].alias(k) for g, k in zip(group, keys)], rows[order].alias("_order"),
                              rows[place].alias("_place"), F.coalesce(rows[size].cast("long"), F.lit(0)).alias("_size")), "rows")
    groups = settle(rows.groupBy(*keys).agg(F.sum("_size").alias("size"), F.min("_order").alias("at")), "groups")
    whole = groups.agg(F.count(F.lit(1)).alias("groups"), F.sum("size").alias("size"),
                       F.max("size").alias("largest"), F.min("at").alias("low"), F.max("at").alias("high")).first()
    if not whole.groups:
        return rows.select(*back, F.lit(None).cast("int").alias("shard"), F.lit(None).cast("long").alias("slot"))
    ends = settle(_group_ends(groups, keys, whole), "ends")
    cuts = minimax_cuts(ends, whole.size, whole.largest, shards)[1]
    start = F.col("end") - F.col("group_size")
    shard = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in [-1, *cuts]]), lambda c: c <= start)) - 1
    dealt = ends.select(*[F.col(k).alias(f"_in{k}") for k in keys], shard.alias("shard"))
    on = F.lit(True)
    for k in keys:
        on = on & rows[k].eqNullSafe(dealt[f"_in{k}"])
    sharded = settle(rows.join(dealt, on, "left").select("_row", "_place", "shard"), "sharded")
    return numbered(sharded, "shard", "_place", "slot").select(*back, "shard", "slot")


def _group_ends(groups: DataFrame, group: list[str], whole) -> DataFrame:
    """The groups with the end of each in the whole order: a window inside
    each of at most 4096 parts of the order, plus what stands before the part."""
    parts = max(1, min(SLICES, whole.groups // common.ROWS_PER_WINDOW * 4 + 1))
    some = groups.withColumn("part", slice_of(F.col("at"), whole.low, whole.high, parts))
    inside = Window.partitionBy("part").orderBy("at", *group).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (some.groupBy("part").agg(F.sum("size").alias("n"))
               .select(F.col("part").alias("_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before")))
    return (some.withColumn("_sum", F.sum("size").over(inside)).join(offsets, F.col("part") == F.col("_part"))
            .select(*group, F.col("size").alias("group_size"), (F.col("_sum") + F.col("_before")).alias("end")))
