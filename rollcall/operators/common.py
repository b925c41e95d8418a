"""Join and grouping building blocks that stay correct and balanced when one
key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..sources.io import scratch_path


def as_list(cols) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def left_join_keep_fanout(one: DataFrame, many: DataFrame, on: Sequence[str]) -> DataFrame:
    """``one LEFT JOIN many`` with one output row per matching ``many`` row.

    Written as (many INNER JOIN one) UNION (one rows without a match) so the
    large, possibly skewed ``many`` side is the streamed side of an inner
    join, which AQE can split when one key is hot; a plain left outer join
    can only split its left side. The unmatched branch anti-joins against
    the distinct keys of ``many``, which partial aggregation keeps small.
    """
    on = as_list(on)
    matched = many.join(one, on, "inner")
    keys = many.select(*on).where(F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in on))).distinct()
    unmatched = one.join(keys, on, "left_anti")
    return matched.unionByName(unmatched, allowMissingColumns=True)


def pick_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column],
                   carry: Sequence[str], largest: bool = True, count: str | None = None) -> DataFrame:
    """One row per group: the row with the largest (or smallest) ``order``
    tuple, returning ``group + carry`` columns, and the group's rows as
    ``count`` if it is named.

    Uses ``max``/``min`` over a struct, which Spark aggregates partially on
    the map side, so a hot group costs one small record per task instead of
    shipping all its rows to one reducer (as ``row_number`` would). The
    ``order`` tuple must end in a unique column so the pick is deterministic.
    """
    group = as_list(group)
    fields = [o.alias(f"_o{i}") for i, o in enumerate(order)] + [F.col(c) for c in carry]
    agg = F.max if largest else F.min
    rows = [F.count(F.lit(1)).alias(count)] if count else []
    picked = df.groupBy(*group).agg(agg(F.struct(*fields)).alias("_pick"), *rows)
    return picked.select(*group, *[F.col(f"_pick.{c}").alias(c) for c in carry], *([count] if count else []))


def nulls_high(c: Column) -> Column:
    """Sort key that ranks NULL above every value (PostgreSQL DESC puts NULLs
    first, so for a 'largest first' pick NULL must compare as largest)."""
    return F.struct(c.isNull().alias("n"), c.alias("v"))


_SEQ_FIELD = "_seq_local"
_PID_FIELD = "_seq_pid"


def running_within_groups(df: DataFrame, group: Sequence[str], order: Sequence[str],
                          out: str = "seq", weight: str | None = None,
                          partitions: int | None = None) -> DataFrame:
    """Add ``out`` = running count (or running sum of ``weight``, inclusive)
    within each group in ``order`` (which must end in a unique column).
    Same result as a window ``partitionBy(group).orderBy(order)`` with
    ``row_number()`` / ``sum(weight)``, but a hot group is spread across
    many tasks:

    1. range-partition on (group, order) so a big group spans several
       pieces, and write the rows with their piece number to the shared
       folder once. Range boundaries come from a random sample, so a second
       plan of the same exchange may cut elsewhere; everything below reads
       the written rows;
    2. accumulate within each (piece, group): no window partition is larger
       than one piece;
    3. per (piece, group) totals give each continuing group the sum of its
       rows in earlier pieces. Only a group that starts in an earlier piece
       needs such an offset, so that table has at most one row per piece and
       is broadcast with a proven bound.
    """
    group, order = as_list(group), as_list(order)
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "ranged")
    (df.repartitionByRange(n, *group, *order).withColumn(_PID_FIELD, F.spark_partition_id())
       .write.parquet(path))
    ranged = spark.read.schema(T.StructType([*df.schema.fields, T.StructField(_PID_FIELD, T.IntegerType())])).parquet(path)
    amount = F.lit(1).cast("long") if weight is None else F.coalesce(F.col(weight).cast("long"), F.lit(0))
    w = (Window.partitionBy(_PID_FIELD, *group).orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = ranged.withColumn(_SEQ_FIELD, F.sum(amount).over(w))
    totals = ranged.groupBy(_PID_FIELD, *group).agg(F.sum(amount).alias("_n"))
    before = Window.partitionBy(*group).orderBy(_PID_FIELD).rowsBetween(Window.unboundedPreceding, -1)
    carry = (totals.withColumn("_carry", F.sum("_n").over(before))
                   .where(F.col("_carry") > 0)
                   .select(_PID_FIELD, *group, "_carry"))
    joined = _join_null_safe(local, F.broadcast(carry), [_PID_FIELD, *group], "left")
    return (joined.withColumn(out, F.col(_SEQ_FIELD) + F.coalesce(F.col("_carry"), F.lit(0)))
                  .drop(_SEQ_FIELD, _PID_FIELD, "_carry"))


def _join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join on ``keys`` where NULL matches NULL (a NULL group is a group)."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"_r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(r, cond, how).drop(*[f"_r_{k}" for k in keys])


def number_within_groups(df: DataFrame, group: Sequence[str], order: Sequence[str],
                         out: str = "seq", partitions: int | None = None) -> DataFrame:
    """``row_number()`` within groups, skew-safe (see ``running_within_groups``)."""
    return running_within_groups(df, group, order, out=out, partitions=partitions)


#: Rows of one key that one task joins.
HEAVY_ROWS = 1_000_000


def join_on_hot_key(many: DataFrame, one: DataFrame, on: Sequence[str], spread: Column, rows: str | None = None,
                    heavy_rows: int | None = None) -> DataFrame:
    """``many LEFT JOIN one`` where a key may hold most rows of ``many``. ``one``
    has one row per key, with the number of the key's rows in ``many`` as
    ``rows`` (an aggregation that makes ``one`` counts them on its way; without
    it they are counted here). It is written, as it is read twice.

    Light keys are joined as they are, sent once. A key of more rows than a task
    should join is dealt by ``spread`` to as many parts as it needs, and its row
    of ``one`` alone is repeated. Heavy keys are found map-side, by a broadcast:
    one has at least 1 / (4 * partitions) of all rows, so there are at most four
    for each partition. Rows with a NULL key meet nothing and do not move."""
    on = as_list(on)
    spark = many.sparkSession
    known = F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in on))
    if rows is None:
        rows = "_rows"
        one = one.join(many.where(known).groupBy(*on).agg(F.count(F.lit(1)).alias(rows)), on)
    path = scratch_path(spark, "per_key")
    one.write.parquet(path)
    one = spark.read.schema(one.schema).parquet(path)
    extra = [c for c in one.columns if c not in on and c != rows]
    size = one.agg(F.sum(rows).alias("all"), F.max(rows).alias("most")).first()
    limit = max(heavy_rows or HEAVY_ROWS, -(-(size["all"] or 0) // (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    keyed = many.where(known)
    if (size["most"] or 0) <= limit:
        met = keyed.join(one.drop(rows), on, "left").select(*many.columns, *extra)
    else:
        parts = F.ceil(F.col(rows) / limit).cast("int")
        heavy = one.where(F.col(rows) > limit).select(*[F.col(c).alias(f"_h_{c}") for c in on], parts.alias("_parts"))
        same = F.lit(True)
        for c in on:
            same = same & (F.col(c) == F.col(f"_h_{c}"))
        part = F.pmod(F.xxhash64(spread), F.coalesce("_parts", F.lit(1))).cast("int")
        dealt = keyed.join(F.broadcast(heavy), same, "left").withColumn("_part", part).select(*many.columns, "_part")
        last = F.when(F.col(rows) > limit, parts - 1).otherwise(F.lit(0))
        each = one.withColumn("_part", F.explode(F.sequence(F.lit(0), last))).drop(rows)
        met = dealt.join(each, [*on, "_part"], "left").select(*many.columns, *extra)
    alone = many.where(~known).select(*many.columns, *[F.lit(None).cast(one.schema[c].dataType).alias(c) for c in extra])
    return met.unionByName(alone)


def percentile_exact(df: DataFrame, group: Sequence[str], value: str, q: float,
                     out: str = "p", partitions: int | None = None, weight: str | None = None) -> DataFrame:
    """Exact percentile with linear interpolation (as ``percentile`` /
    ``quantile_cont``) per group, without holding a group in one task. With
    ``weight`` a row stands for that many values.

    Values are counted per (group, value) with partial aggregation, running
    counts over the distinct values come from ``running_within_groups``, and
    only the (at most two) distinct values that hold ranks floor(q(n-1)) and
    ceil(q(n-1)) are kept per group for the interpolation.
    """
    group = as_list(group)
    v = F.col(value)
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    hist = df.where(v.isNotNull()).groupBy(*group, v.alias("_v")).agg(n.alias("_c"))
    cum = running_within_groups(hist, group, ["_v"], out="_cum", weight="_c", partitions=partitions)
    sizes = cum.groupBy(*group).agg(F.max("_cum").alias("_n"))
    pos = F.lit(q) * (F.col("_n") - 1)
    lo, hi = F.floor(pos), F.ceil(pos)
    first_rank = F.col("_cum") - F.col("_c")          # 0-based rank of this value's first copy
    covers = lambda k: (first_rank <= k) & (k < F.col("_cum"))
    marked = _join_null_safe(cum, sizes, group, "inner").select(
        *group, "_v", pos.alias("_pos"), lo.alias("_lo"),
        F.when(covers(lo), F.col("_v")).alias("_vlo"), F.when(covers(hi), F.col("_v")).alias("_vhi"))
    picked = marked.where(F.col("_vlo").isNotNull() | F.col("_vhi").isNotNull())
    agg = picked.groupBy(*group).agg(F.max("_vlo").alias("_a"), F.max("_vhi").alias("_b"),
                                     F.max("_pos").alias("_pos"), F.max("_lo").alias("_lo"))
    frac = F.col("_pos") - F.col("_lo")
    return agg.select(*group, (F.col("_a") + (F.col("_b") - F.col("_a")) * frac).alias(out))
