"""Row changes as whole-table transforms (O32-O35): each returns the new
version of a table; writing it (O05) is a separate step."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_list, pick_per_group


def _last_per_key(updates: DataFrame, key: list[str], order_by, largest: bool = True) -> DataFrame:
    """One row per key. Without ``order_by`` the row whose other columns
    compare largest (smallest), column by column, is taken, so the choice is
    the same in every run."""
    carry = [c for c in updates.columns if c not in key]
    order = [F.col(c) for c in as_list(order_by)] if order_by is not None else [F.col(c) for c in carry]
    return pick_per_group(updates, key, order, carry, largest=largest)


def _has_key(key: Sequence[str]):
    return F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in key))


# O32 ---------------------------------------------------------------------
def upsert(base: DataFrame, updates: DataFrame, key, set_cols: Sequence[str],
           order_by=None, insert_only_cols: Sequence[str] = ()) -> DataFrame:
    """INSERT ... ON CONFLICT (key) DO UPDATE SET set_cols.

    The last update per key wins (``order_by`` ascending, last = largest; none
    given: the largest row, column by column). A NULL key conflicts with
    nothing: such updates are all inserted.
    A matched row takes ``set_cols`` from the update and keeps every other
    column; an unmatched update is inserted with the columns it has
    (``insert_only_cols`` are used only on insert); unmatched base rows stay.
    Updates are reduced to one row per key by partial aggregation before
    the full outer join, so a key updated many times does not skew it.
    """
    key = as_list(key)
    upd = _last_per_key(updates.where(_has_key(key)), key, order_by).unionByName(updates.where(~_has_key(key)))
    b = base.withColumn("_in_base", F.lit(True))
    u = upd.select(*key, *[F.col(c).alias(f"_u_{c}") for c in upd.columns if c not in key],
                   F.lit(True).alias("_in_upd"))
    j = b.join(u, key, "full_outer")
    in_base = F.coalesce(F.col("_in_base"), F.lit(False))
    in_upd = F.coalesce(F.col("_in_upd"), F.lit(False))
    cols = list(base.columns) + [c for c in upd.columns if c not in base.columns]
    out = []
    for c in cols:
        has_b, has_u = c in base.columns, c in upd.columns
        if c in key:
            out.append(F.col(c))
        elif has_u and c in set_cols:
            out.append((F.when(in_upd, F.col(f"_u_{c}")).otherwise(F.col(c)) if has_b
                        else F.col(f"_u_{c}")).alias(c))
        elif has_u and (c in insert_only_cols or not has_b):
            out.append((F.when(in_base, F.col(c)).otherwise(F.col(f"_u_{c}")) if has_b
                        else F.when(~in_base, F.col(f"_u_{c}"))).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


# O33 ---------------------------------------------------------------------
def insert_ignore(base: DataFrame, new: DataFrame, key=None, order_by=None) -> DataFrame:
    """INSERT ... ON CONFLICT DO NOTHING: append rows whose key is not in
    ``base`` and, within the batch, only the first row per key (smallest
    ``order_by``; none given: the smallest row, column by column). Rows with
    a NULL in their key conflict with nothing and are all inserted, as under a
    unique constraint. Without a key this is a plain append."""
    if key is None:
        return base.unionByName(new, allowMissingColumns=True)
    key = as_list(key)
    first = _last_per_key(new.where(_has_key(key)), key, order_by, largest=False)
    fresh = first.join(base.select(*key).distinct(), key, "left_anti").select(*new.columns)
    return base.unionByName(fresh.unionByName(new.where(~_has_key(key))), allowMissingColumns=True)


# O34 ---------------------------------------------------------------------
def apply_patch(base: DataFrame, patch: DataFrame, key, as_of, add_cols: Sequence[str] = (),
                stamp: str = "updated_at", order_by=None) -> DataFrame:
    """UPDATE base SET ... WHERE key matches, with updated_at stamped by the
    trigger. Patch columns replace the base value; ``add_cols`` are counter
    increments (col = col + n). Rows without a patch are unchanged. A key
    that is patched more than once takes its last patch (``order_by``; none
    given: the largest row, column by column) and the sum of its increments."""
    from ..functions.scalars import ts_ntz
    key = as_list(key)
    now = ts_ntz(as_of) if isinstance(as_of, str) else as_of
    order = [F.col(c) for c in as_list(order_by)] if order_by is not None else \
        [F.col(c) for c in patch.columns if c not in key]
    values = [c for c in patch.columns if c not in key and c not in add_cols]
    p = patch.groupBy(*key).agg(
        F.max(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *[F.col(c).alias(f"_v_{c}") for c in values],
                       F.lit(True).alias("_hit"))).alias("_last"),
        *[F.sum(c).cast(patch.schema[c].dataType).alias(f"_p_{c}") for c in add_cols if c in patch.columns])
    p = p.select(*key, *[F.col(f"_last._v_{c}").alias(f"_p_{c}") for c in values],
                 *[F.col(f"_p_{c}") for c in add_cols if c in patch.columns], F.col("_last._hit").alias("_hit"))
    j = base.join(p, key, "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    out = []
    for c in base.columns:
        if c in key or c not in patch.columns:
            out.append(F.col(c))
        elif c in add_cols:
            out.append(F.when(hit, F.col(c) + F.coalesce(F.col(f"_p_{c}"), F.lit(0)))
                       .otherwise(F.col(c)).alias(c))
        else:
            out.append(F.when(hit, F.col(f"_p_{c}")).otherwise(F.col(c)).alias(c))
    if stamp:
        old = F.col(stamp) if stamp in base.columns else F.lit(None).cast("timestamp_ntz")
        out = [o for o, c in zip(out, base.columns) if c != stamp]
        out.append(F.when(hit, now).otherwise(old).alias(stamp))
    return j.select(*out)


# O35 ---------------------------------------------------------------------
def purge(tables: Mapping[str, DataFrame], tenant_ids: DataFrame,
          children: Mapping[str, tuple[str, str, str]] | None = None) -> dict[str, DataFrame]:
    """Erase tenants: drop every row of their tenant-owned tables, then
    cascade to child tables that reach the tenant only through a parent
    (``children[name] = (parent, child_col, parent_col)``)."""
    ids = tenant_ids.select("tenant_id").distinct()
    out: dict[str, DataFrame] = {}
    removed: dict[str, DataFrame] = {}
    for name, df in tables.items():
        if "tenant_id" in df.columns:
            out[name] = df.join(ids, "tenant_id", "left_anti")
            removed[name] = df.join(ids, "tenant_id", "left_semi")
    for name, (parent, child_col, parent_col) in (children or {}).items():
        gone = removed[parent].select(F.col(parent_col).alias(child_col)).distinct()
        src = out.get(name, tables[name])
        out[name] = src.join(gone, child_col, "left_anti")
    return out
