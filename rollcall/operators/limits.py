"""Plan limits enforced in the order of requests.

A registration is accepted while the usage is under the limit and adds one to
it; a cancellation frees one place, never below none. So what a request does to
the usage is a shift within bounds, and any run of requests is one too:
``usage -> min(high, max(low, usage + shift))``. That makes an associative scan:

1. requests are cut into range pieces of (group, order), which are written;
2. each piece sums up its requests of a group as (shift, low, high);
3. for groups that continue over pieces (one from a piece to the next at most)
   these sums, at most two for each piece, give the usage at which each piece
   begins;
4. each piece then decides its requests one by one.

A group with most requests is many pieces, and no request is looked at twice in
one task. Usage above the limit when the requests begin stays above: the first
cancellations bring it down to the limit, and nothing is accepted before.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.io import scratch_path
from .common import as_list, join_on_hot_key, running_within_groups


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _in_order(t: pa.Table) -> pa.Table:
    return t.take(pa.array(np.lexsort((t.column("nth").to_numpy(), t.column("code").to_numpy()))))


def _coded(t: pa.Table) -> tuple[pa.Table, list[str]]:
    names = t.column("g").combine_chunks().dictionary_encode()
    return _in_order(t.append_column("code", names.indices)), names.dictionary.to_pylist()


def _sums():
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t, names = _coded(t)
        out = {}
        for code, step, limit in zip(t.column("code").to_pylist(), t.column("step").to_pylist(), t.column("cap").to_pylist()):
            shift, low, high = out.get(code) or (0, 0, limit)
            out[code] = (shift + step, min(limit, max(0, low + step)), min(limit, max(0, high + step)))
        cols = list(zip(*out.values())) if out else [[], [], []]
        return pa.table({"piece": pa.array([key[0].as_py()] * len(out), pa.int32()), "g": pa.array([names[c] for c in out], pa.string()),
                         **{n: pa.array(c, pa.int64()) for n, c in zip(("shift", "low", "high"), cols)}})
    return run


def _decide(begins: dict[tuple[int, str], int]):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t, names = _coded(t)
        usage: dict[int, int] = {}
        piece, decisions, after = key[0].as_py(), [], []
        for code, step, limit, first in zip(*(t.column(c).to_pylist() for c in ("code", "step", "cap", "first"))):
            now = usage.get(code)
            if now is None:
                now = begins.get((piece, names[code]), first)
            if step > 0:
                decisions.append("accepted" if now < limit else "rejected")
            elif step < 0:
                decisions.append("freed" if now else "ignored")
            else:
                decisions.append("freed")
            usage[code] = now = min(limit, max(0, now + step))
            after.append(now)
        return pa.table({"_row": t.column("_row"), "decision": pa.array(decisions, pa.string()), "usage": pa.array(after, pa.int64())})
    return run


def enforce_limits(requests: DataFrame, limits: DataFrame, group: Sequence[str], order: Sequence[str], action: str = "action",
                   pieces: int | None = None) -> DataFrame:
    """``requests`` with ``decision`` and ``usage``, the places taken after the
    request. ``action`` is 'register' or 'cancel'; ``order`` must end in a unique
    column. ``limits`` has a row per group: ``limit`` and ``used``, the places
    taken before. Registrations are 'accepted' or 'rejected', cancellations
    'freed', or 'ignored' where nothing is taken. A group without a limit is not
    checked: all is accepted, and its usage is unknown (null). Usage counts up to
    the limit."""
    group, order = as_list(group), as_list(order)
    spark = requests.sparkSession
    row = F.struct(*[requests[c] for c in requests.columns]).alias("_row")
    whole = F.to_json(F.struct(*[requests[c].alias(f"k{i}") for i, c in enumerate(group)]), {"ignoreNullFields": "false"}).alias("g")
    keys = [requests[c].alias(f"_k{i}") for i, c in enumerate(group)]
    step = F.when(requests[action] == "register", 1).when(requests[action] == "cancel", -1).otherwise(0).cast("long").alias("step")
    rows = requests.select(row, whole, *keys, step, *[requests[c].alias(f"_o{i}") for i, c in enumerate(order)])
    on = [f"_k{i}" for i in range(len(group))]
    cap = limits.select(*[limits[c].alias(k) for c, k in zip(group, on)], limits["limit"].cast("long").alias("cap"),
                        F.coalesce(limits["used"].cast("long"), F.lit(0)).alias("used"))
    places = [f"_o{i}" for i in range(len(order))]
    rows = join_on_hot_key(rows, cap, on, F.struct(*places))
    free = rows.where("cap IS NULL").select("_row", F.when(F.col("step") > 0, "accepted").otherwise("freed").alias("decision"), F.lit(None).cast("long").alias("usage"))
    checked = _written(rows.where("cap IS NOT NULL").drop(*on), "limited")
    if not checked.where("used > cap").isEmpty():
        # The first cancellations only bring a usage above the limit down to it.
        over = checked.where("used > cap AND step < 0")
        counted = running_within_groups(over, ["g"], places, out="_nth_cancel")
        gone = counted.withColumn("step", F.when(F.col("_nth_cancel") <= F.col("used") - F.col("cap"), 0).otherwise(-1).cast("long")).drop("_nth_cancel")
        checked = _written(checked.where("NOT (used > cap AND step < 0)").unionByName(gone), "limited")
    count = pieces or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = checked.repartitionByRange(count, "g", *places).sortWithinPartitions("g", *places)
    slim = ranged.select("_row", "g", "step", "cap", F.least("used", "cap").alias("first"), F.spark_partition_id().alias("piece"),
                         F.monotonically_increasing_id().alias("nth"))
    cells = _written(slim, "pieces")
    sums = _written(cells.select("piece", "g", "step", "cap", "nth").groupBy("piece").applyInArrow(_sums(), "piece int, g string, shift long, low long, high long"), "sums")
    several = sums.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g")
    firsts = cells.groupBy("g").agg(F.max("first").alias("first"))
    chains: dict[str, list] = defaultdict(list)
    for r in sums.join(several, "g", "left_semi").join(firsts, "g").collect():     # at most two for each piece
        chains[r.g].append((r.piece, r.shift, r.low, r.high, r.first))
    begins = {}
    for g, chain in chains.items():
        chain.sort()
        usage = chain[0][4]
        for piece, shift, low, high, _ in chain:
            begins[piece, g] = usage
            usage = min(high, max(low, usage + shift))
    schema = T.StructType([cells.schema["_row"], T.StructField("decision", T.StringType()), T.StructField("usage", T.LongType())])
    decided = cells.groupBy("piece").applyInArrow(_decide(begins), schema)
    names = [c if c not in ("decision", "usage") else f"{c}_of_row" for c in requests.columns]
    return decided.unionByName(free).select(*[F.col(f"_row.`{c}`").alias(n) for c, n in zip(requests.columns, names)], "decision", "usage")
