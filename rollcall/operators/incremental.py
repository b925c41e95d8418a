"""Tenant analytics kept up to date from changes.

The report is a set of counts per tenant. Each base table hands on its changed
rows with a sign: an insert is +1, a delete -1, an update the old row with -1
and the new one with +1. The counting algorithm adds the signed rows to what was
counted before; nothing else of the tables is read. A plan name is shown while
the number of the tenant's active subscriptions to it is above 0.

Stored under one folder, a sub-folder per version:

- ``cells``: (cell, tenant_id, detail, n), the counts that a refresh changed;
- ``tenants``: the tenants' rows that it changed, with ``gone``;
- ``view``: per tenant whose report changed its rows, an empty list if it has
  none now.

The current value of a key is that of its latest version. A version counts once
a pointer to it has been appended, which is the last thing a refresh does: one
that fails leaves the old version current, and the next one writes over its
folder. Every COMPACT versions all current values are written again, and readers
start from there.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import percent_2dp

COMPACT = 16
CELLS = "cell string, tenant_id int, detail string, n long"
TENANTS = "tenant_id int, name string, slug string, is_active boolean, created_at timestamp_ntz, gone boolean"
COUNTS = ("events", "visitors", "checkins", "users", "registered", "checked_in")
_ROW = ("tenant_name string, tenant_slug string, plan_name string, tenant_created_at timestamp_ntz, total_events long, total_visitors long, "
        "total_checkins long, total_users long, registered_visitors long, checked_in_visitors long, checkin_percentage double")
VIEW = f"tenant_id int, rows array<struct<{', '.join(c.replace(' ', ':', 1) for c in _ROW.split(', '))}>>"


def signed(rows: DataFrame, sign: int) -> DataFrame:
    return rows.withColumn("sign", F.lit(sign))


def changed_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The signed rows that lead from one version of a table to another, for
    sources that hand on no changes of their own. Both are read."""
    names = old.columns
    a = old.select(F.col(key).alias("_k"), F.struct(*names).alias("_a"))
    b = new.select(F.col(key).alias("_k"), F.struct(*names).alias("_b"))
    both = a.join(b, "_k", "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b")))
    out = both.select(F.explode(F.array(F.struct(F.col("_a").alias("row"), F.lit(-1).alias("sign")), F.struct(F.col("_b").alias("row"), F.lit(1).alias("sign")))).alias("x"))
    return out.where("x.row IS NOT NULL").select("x.row.*", "x.sign")


def _cells(changes: Mapping[str, DataFrame], plans: DataFrame) -> DataFrame:
    """The signed counts of the changed rows, one row per cell that is touched."""
    def of(rows: DataFrame, cell: str, cond: Column | None = None, detail: Column | None = None) -> DataFrame:
        rows = rows.where(cond) if cond is not None else rows
        return rows.select(F.lit(cell).alias("cell"), F.col("tenant_id").cast("int").alias("tenant_id"),
                           (F.lit(None).cast("string") if detail is None else detail).alias("detail"), F.col("sign").cast("long").alias("n"))

    parts = []
    if "events" in changes:
        parts.append(of(changes["events"], "events"))
    if "visitors" in changes:
        v = changes["visitors"]
        # One pass over the changed visitors gives the three counts.
        kinds = F.array_compact(F.array(F.lit("visitors"), F.when(F.col("status").isin("registered", "checked_in"), F.col("status"))))
        parts.append(v.select(F.explode(kinds).alias("cell"), F.col("tenant_id").cast("int").alias("tenant_id"),
                              F.lit(None).cast("string").alias("detail"), F.col("sign").cast("long").alias("n")))
    if "checkins" in changes:
        parts.append(of(changes["checkins"], "checkins"))
    if "staff" in changes:
        parts.append(of(changes["staff"], "users", F.col("is_active")))
    if "subscriptions" in changes:
        named = changes["subscriptions"].where(F.col("status") == "active").join(plans.select("plan_id", F.col("name").alias("_plan")), "plan_id")
        parts.append(of(named, "plan", None, F.col("_plan")))
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    if out is None:
        return plans.sparkSession.createDataFrame([], CELLS)
    return out.groupBy("cell", "tenant_id", "detail").agg(F.sum("n").alias("n")).where("n <> 0")


@dataclass
class AnalyticsView:
    spark: SparkSession
    root: str

    # -- versions -----------------------------------------------------------
    def version(self) -> tuple[int, int]:
        """The published version and the one that readers start from; (0, 1) before the first."""
        try:
            last = self.spark.read.schema("version long, base long").parquet(f"{self.root}/pointers").agg(F.max(F.struct("version", "base"))).first()[0]
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            last = None
        return (last.version, last.base) if last else (0, 1)

    def _write(self, df: DataFrame, name: str, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/version={version}")

    def _current(self, name: str, schema: str, key: list[str], upto: tuple[int, int] | None = None) -> DataFrame:
        """The latest published value of each key."""
        last, base = upto or self.version()
        full = T.StructType([*T.StructType.fromDDL(schema).fields, T.StructField("version", T.LongType())])
        if last < base:
            return self.spark.createDataFrame([], full).drop("version")
        rows = self.spark.read.schema(full).option("basePath", f"{self.root}/{name}").parquet(f"{self.root}/{name}")
        rows = rows.where(F.col("version").between(base, last))
        carry = [c for c in T.StructType.fromDDL(schema).names if c not in key]
        latest = rows.groupBy(*key).agg(F.max_by(F.struct(*carry), "version").alias("_last"))
        return latest.select(*key, *[F.col(f"_last.{c}").alias(c) for c in carry])

    def cells(self, upto=None) -> DataFrame:
        return self._current("cells", CELLS, ["cell", "tenant_id", "detail"], upto)

    def tenants(self, upto=None) -> DataFrame:
        return self._current("tenants", TENANTS, ["tenant_id"], upto).where("NOT gone")

    def read(self) -> DataFrame:
        """The report as published last."""
        return self._current("view", VIEW, ["tenant_id"]).select("tenant_id", F.inline("rows"))

    # -- refresh ------------------------------------------------------------
    def refresh(self, changes: Mapping[str, DataFrame], plans: DataFrame) -> int:
        """Applies signed changes of ``tenants``, ``subscriptions``, ``events``,
        ``visitors``, ``checkins`` and ``staff`` (each row with its tenant_id)
        and publishes the next version; returns its number. Tables without
        changes are left out. A row that changed several times comes with its
        first old image and its last new one. Rows without a tenant are in no
        report."""
        before = self.version()
        version = before[0] + 1
        whole = version - before[1] >= COMPACT
        self._write(_cells(changes, plans), "delta", version)
        delta = self.spark.read.schema(CELLS).parquet(f"{self.root}/delta/version={version}")

        old = self.cells(before)
        key = ["cell", "tenant_id", "detail"]
        touched = old.select(*key, F.lit(0).alias("new"), "n").unionByName(delta.select(*key, F.lit(1).alias("new"), "n"))
        now = touched.groupBy(*key).agg(F.sum("n").alias("n"), F.max("new").alias("new"))
        self._write((now if whole else now.where("new = 1")).select(*key, "n"), "cells", version)

        images = self.spark.createDataFrame([], TENANTS)
        if "tenants" in changes:
            cols = ["name", "slug", "is_active", "created_at"]
            # Of a tenant's changed rows the new image wins; only an old one means that it is gone.
            last = changes["tenants"].groupBy(F.col("tenant_id").cast("int").alias("tenant_id")).agg(F.max_by(F.struct(*cols), "sign").alias("r"), F.max("sign").alias("s"))
            images = last.select("tenant_id", *[F.col(f"r.{c}").alias(c) for c in cols], (F.col("s") < 0).alias("gone"))
        kept = self._current("tenants", TENANTS, ["tenant_id"], before)
        if whole:
            images = images.unionByName(kept.join(images.select("tenant_id"), "tenant_id", "left_anti"))
        self._write(images, "tenants", version)

        upto = (version, version if whole else before[1])
        ids = delta.select("tenant_id").unionByName(self.spark.read.schema(TENANTS).parquet(f"{self.root}/tenants/version={version}").select("tenant_id")).distinct()
        made = self._report(upto, None if whole else ids)
        published = self._current("view", VIEW, ["tenant_id"], before).withColumnRenamed("rows", "_old")
        differs = made.join(published, "tenant_id", "left").where(F.lit(whole) | ~F.col("rows").eqNullSafe(F.coalesce("_old", F.array().cast(made.schema["rows"].dataType))))
        self._write(differs.select("tenant_id", "rows"), "view", version)
        self.spark.createDataFrame([(version, upto[1])], "version long, base long").coalesce(1).write.mode("append").parquet(f"{self.root}/pointers")
        return version

    def _report(self, upto: tuple[int, int], ids: DataFrame | None) -> DataFrame:
        """(tenant_id, rows) of the given tenants, all without ``ids``."""
        cells, tenants = self.cells(upto), self.tenants(upto)
        if ids is None:
            ids = cells.select("tenant_id").unionByName(tenants.select("tenant_id")).distinct()
        else:
            cells, tenants = cells.join(ids, "tenant_id", "left_semi"), tenants.join(ids, "tenant_id", "left_semi")
        one = cells.groupBy("tenant_id").agg(
            *[F.coalesce(F.sum(F.when(F.col("cell") == c, F.col("n"))), F.lit(0)).alias(f"_{c}") for c in COUNTS],
            F.sort_array(F.collect_list(F.when((F.col("cell") == "plan") & (F.col("n") > 0), F.col("detail")))).alias("_plans"))
        t = tenants.where("is_active").join(one, "tenant_id", "left")
        plan = F.explode(F.when(F.size("_plans") > 0, F.col("_plans")).otherwise(F.array(F.lit(None).cast("string"))))
        t = t.withColumn("plan_name", plan)
        n = {c: F.coalesce(F.col(f"_{c}"), F.lit(0).cast("long")) for c in COUNTS}
        named = {"tenant_name": F.col("name"), "tenant_slug": F.col("slug"), "plan_name": F.col("plan_name"), "tenant_created_at": F.col("created_at"),
                 "total_events": n["events"], "total_visitors": n["visitors"], "total_checkins": n["checkins"], "total_users": n["users"],
                 "registered_visitors": n["registered"], "checked_in_visitors": n["checked_in"]}
        t = t.select("tenant_id", *[v.alias(k) for k, v in named.items()])
        t = t.withColumn("checkin_percentage", percent_2dp("checked_in_visitors", "total_visitors"))
        kind = T.StructType.fromDDL(VIEW)["rows"].dataType
        fields = [F.col(f.name).cast(f.dataType).alias(f.name) for f in kind.elementType.fields]
        rows = t.groupBy("tenant_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("rows"))
        return ids.join(rows, "tenant_id", "left").select("tenant_id", F.coalesce("rows", F.array().cast(kind)).alias("rows"))
