"""Limiter windows that begin at a client's first request.

A client's window opens with its first request and lasts ``window``; the next
request at or after its end opens the next one. So where a window begins depends
on the one before, back to the client's first request. Times count in whole
milliseconds, as the limiter's clock does.

1. Requests are counted per (client and route, millisecond) with map-side
   aggregation; times are cut into range pieces of (client and route, time),
   which are written. A client with most requests is many pieces.
2. Inside a piece the next window's first request is a binary search, for all
   rows at once, and a chain of windows is followed from a given entry.
3. Where a client continues in a piece, the entry is what the pieces before have
   left open. For every end of a window that could be carried into a piece (one
   that begins in the piece before it and reaches over its end) the piece says
   which end it would carry on: a table of links (end, next end). Which ends
   are real follows from the first piece by pointer doubling: links are joined
   with themselves, so the reach doubles each round, and the ends reached are
   added up. There are as many rounds as the logarithm of the pieces of a client.
4. Each piece then counts its windows from its real entry, and windows that
   span pieces are summed.

Only (client, piece) pairs of clients that continue over pieces come to the
driver: one client at most continues from a piece to the next, so these are at
most two for each piece.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.io import scratch_path
from .logs import HEALTH_PATHS, RATE_LIMITS, RATE_WINDOW

#: Keys of a piece that are searched at a time (bounds key number times time range in 64 bits).
_KEYS = 1 << 20


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def window_starts(key: np.ndarray, t: np.ndarray, width: int, entry: np.ndarray | None = None) -> np.ndarray:
    """For rows sorted by (key number, time) which ones open a window. ``entry``:
    per key, the time from which a window may open (None: its first row)."""
    starts = np.zeros(len(t), bool)
    if not len(t):
        return starts
    span = int(t.max() - t.min()) + width + 1
    place = key.astype(np.int64) * span + (t - t.min())
    ends = np.searchsorted(key, np.arange(int(key.max()) + 1), "right")
    at = np.searchsorted(key, np.arange(int(key.max()) + 1), "left")
    if entry is not None:
        low = np.clip(entry - t.min(), 0, span - 1)
        at = np.searchsorted(place, np.arange(len(entry)) * span + low, "left")
    at = at[at < ends]
    while len(at):
        starts[at] = True
        after = np.searchsorted(place, place[at] + width, "left")
        # A binary search inside the key's own rows: its places end before the next key's begin.
        at = after[after < ends[key[at]]]
    return starts


def _ends_of(t: np.ndarray, width: int, rows: np.ndarray) -> np.ndarray:
    """For each row of one key's sorted times the end of the last window of the
    chain that opens with it, found by doubling the steps."""
    n = len(t)
    step = np.searchsorted(t, t + width, "left")        # n: none in this piece
    last = np.arange(n)
    jump = step.copy()
    while True:
        go = jump < n
        if not go.any():
            return t[last[rows]] + width
        last[go] = last[jump[go]]
        jump[go] = jump[jump[go]]


def _possible_ends(width: int, spans: dict[str, list[tuple[int, int, int]]]):
    """Per (piece, key) the ends that it can hand on, each with the piece that
    it falls into, the first with requests from then on (none: null): of chains
    that open in rows which a window from before can reach; in the key's first
    piece, of the chain of the first row. ``spans``: (first, last, piece)."""
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        piece, k = key[0].as_py(), key[1].as_py()
        own = [p for _, _, p in spans[k]]
        lasts = np.array([last for _, last, _ in spans[k]])
        t = np.sort(rows.column("t").to_numpy())
        nth = own.index(piece)
        reach = 1 if not nth else int(np.searchsorted(t, lasts[nth - 1] + width, "left")) + 1
        ends = np.unique(_ends_of(t, width, np.arange(min(reach, len(t)))))
        into = [own[i] if i < len(own) else None for i in np.searchsorted(lasts, ends, "left").tolist()]
        return pa.table({"k": pa.array([k] * len(ends), pa.string()), "x": pa.array(ends, pa.int64()), "piece": pa.array(into, pa.int32())})
    return run


def _links(width: int):
    """Per (piece, key) and carried end the next end that is carried on."""
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, asked: pa.Table) -> pa.Table:
        t = np.sort(rows.column("t").to_numpy())
        x = asked.column("x").to_numpy()
        at = np.searchsorted(t, x, "left")
        x, at = x[at < len(t)], at[at < len(t)]
        y = _ends_of(t, width, at) if len(at) else x
        return pa.table({"k": pa.array([key[1].as_py()] * len(x), pa.string()), "x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64())})
    return run


def _count(width: int, carried: dict[tuple[int, str], int]):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        piece = key[0].as_py()
        rows = rows.sort_by([("k", "ascending"), ("t", "ascending")])
        names = rows.column("k").combine_chunks().dictionary_encode()
        code, t, n = names.indices.to_numpy(), rows.column("t").to_numpy(), rows.column("n").to_numpy()
        names = names.dictionary.to_pylist()
        out = defaultdict(list)
        for first in range(0, len(names), _KEYS):
            low, high = np.searchsorted(code, [first, first + _KEYS])
            some, times = code[low:high] - first, t[low:high]
            own = names[first:first + _KEYS]
            entry = np.array([carried.get((piece, k), -(2**62)) for k in own], np.int64)
            opens = window_starts(some, times, width, entry)
            # A row belongs to the last window that opened in its key, else to the carried one.
            at = np.maximum.accumulate(np.where(opens, np.arange(len(times)), -1))
            inside = (at >= 0) & (some[at] == some)
            start = np.where(inside, times[at], entry[some] - width)
            cut = np.flatnonzero(np.r_[True, (some[1:] != some[:-1]) | (start[1:] != start[:-1])]) if len(times) else np.empty(0, int)
            out["k"] += [own[c] for c in some[cut]]
            out["start"].append(start[cut])
            out["n"].append(np.add.reduceat(n[low:high], cut) if len(cut) else n[:0])
        return pa.table({"k": pa.array(out["k"], pa.string()), "start": pa.array(np.concatenate(out["start"]), pa.int64()),
                         "n": pa.array(np.concatenate(out["n"]), pa.int64())})
    return run


def _carried(cells: DataFrame, width: int) -> dict[tuple[int, str], int]:
    """The end of the window that is open at the beginning of a piece, for
    clients that continue there."""
    spans = _written(cells.groupBy("k", "piece").agg(F.min("t").alias("first"), F.max("t").alias("last")), "spans")
    several = _written(spans.groupBy("k").agg(F.count(F.lit(1)).alias("pieces")).where("pieces > 1").select("k"), "several")
    pieces: dict[str, list] = defaultdict(list)
    for r in spans.join(several, "k", "left_semi").collect():       # at most two for each piece
        pieces[r.k].append((r.first, r.last, r.piece))
    if not pieces:
        return {}
    for some in pieces.values():
        some.sort()
    spark = cells.sparkSession
    listed = spark.createDataFrame([(k, p) for k, some in pieces.items() for _, _, p in some], "k string, piece int")
    own = _written(cells.join(F.broadcast(listed), ["k", "piece"], "left_semi").select("k", "piece", "t"), "continuing")
    by, ends = ["piece", "k"], "k string, x long, piece int"
    asked = own.groupBy(*by).applyInArrow(_possible_ends(width, pieces), ends).where("piece IS NOT NULL").distinct()
    links = _written(own.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(_links(width), "k string, x long, y long"), "links")
    firsts = spark.createDataFrame([(k, some[0][2]) for k, some in pieces.items()], "k string, piece int")
    first = own.join(F.broadcast(firsts), by, "left_semi").groupBy(*by).applyInArrow(_possible_ends(width, pieces), ends).select("k", "x")
    reached = _written(first, "reached")
    for _ in range(max(len(p) for p in pieces.values()).bit_length()):
        step = reached.join(links, ["k", "x"]).select("k", F.col("y").alias("x"))
        reached = _written(reached.unionByName(step).distinct(), "reached")
        far = links.select("k", F.col("x").alias("y"), F.col("y").alias("z"))
        links = _written(links.join(far, ["k", "y"]).select("k", "x", F.col("z").alias("y")), "links")
    real: dict[str, list[int]] = defaultdict(list)
    for r in reached.collect():     # one for each piece of a client at most
        real[r.k].append(r.x)
    out = {}
    for k, some in pieces.items():
        open_ends = sorted(real[k])
        for first_t, _, p in some[1:]:
            out[p, k] = max(x for x in open_ends if x - width < first_t)
    return out


def client_windows(log: DataFrame, key: str = "client", window: str = RATE_WINDOW, limits: Mapping[str, int] | None = None,
                   ts: str = "ts", pieces: int | None = None, only_over: bool = True) -> DataFrame:
    """Per client, route and window, from the client's first request on, the
    ``count`` of requests, the route's ``limit`` and how many were ``blocked``;
    those over the limit, or all with ``only_over`` false. Health checks are not
    counted; requests without a time are in no window; a null client is one
    client; a route without a limit is never over it."""
    limits = dict(limits or RATE_LIMITS)
    pairs = []
    for route, n in limits.items():
        pairs += [F.lit(route), F.lit(n)]
    spark = log.sparkSession
    width = int(spark.range(1).select(F.expr(f"unix_millis(timestamp_seconds(0) + INTERVAL {window})")).first()[0])
    counted = log.where(F.col(ts).isNotNull() & ~F.coalesce(F.col("path").isin(HEALTH_PATHS), F.lit(False)))
    whole = F.to_json(F.struct(F.col(key).alias("c"), F.col("route").alias("r")), {"ignoreNullFields": "false"})
    ms = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / 1000).cast("long")
    cells = counted.select(whole.alias("k"), F.col(key).alias("_key"), F.col("route").alias("_route"), ms.alias("t")) \
        .groupBy("k", "t").agg(F.first("_key").alias("_key"), F.first("_route").alias("_route"), F.count(F.lit(1)).alias("n"))
    count = pieces or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = _written(_written(cells, "cells").repartitionByRange(count, "k", "t").withColumn("piece", F.spark_partition_id()), "pieces")
    carried = _carried(cells.select("k", "t", "piece"), width)
    parts = cells.select("piece", "k", "t", "n").groupBy("piece").applyInArrow(_count(width, carried), "k string, start long, n long")
    names = cells.groupBy("k").agg(F.first("_key").alias(key), F.first("_route").alias("route"))
    found = parts.groupBy("k", "start").agg(F.sum("n").alias("count")).join(names, "k")
    at = F.timestamp_millis(F.col("start")).cast("timestamp_ntz")
    found = found.select(at.alias("window_start"), (at + F.expr(f"INTERVAL {window}")).alias("window_end"), key, "route", "count",
                         F.create_map(*pairs)[F.col("route")].alias("limit"))
    found = found.withColumn("blocked", F.greatest(F.coalesce(F.col("count") - F.col("limit"), F.lit(0)), F.lit(0)).cast("long"))
    return found.where("blocked > 0") if only_over else found
