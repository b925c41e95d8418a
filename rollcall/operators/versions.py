"""Table versions that share what did not change, and the audit rows between two
of them (O38).

A version deals the rows to buckets by a hash of their key and keeps a digest of
each bucket: its number of rows and the sums of two 64-bit row hashes. A bucket
whose digest is that of the version before is not written again; the manifest
says which version holds its rows. Two versions are compared by their manifests
first, so only rows of buckets that differ are read and joined.

Stored under one folder: ``rows/version=/bucket=`` and ``manifest/version=``. The
manifest is written last; a version without one does not exist, and one that
failed is written over. The key (one column or more) names a row, a NULL in it
is a value; column types must be ones that Spark hashes. Versions of one folder
have the same columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_list

SUM = "decimal(38,0)"
MANIFEST = f"bucket int, n long, h1 {SUM}, h2 {SUM}, home long"


def _hash(cols: Sequence[str], seed: int) -> Column:
    # Spark's hash passes over NULL: which columns are NULL is hashed with them.
    nulls = F.concat(*[F.col(f"`{c}`").isNull().cast("int").cast("string") for c in cols])
    return F.xxhash64(F.lit(seed), nulls, *[F.col(f"`{c}`") for c in cols])


@dataclass
class VersionedTable:
    """``buckets``: so many that one holds some hundred MB at most; at most
    that many numbers reach the driver or a broadcast."""
    spark: SparkSession
    root: str
    key: str | Sequence[str]
    buckets: int = 256

    def _manifests(self) -> DataFrame | None:
        schema = T.StructType([*T.StructType.fromDDL(MANIFEST).fields, T.StructField("version", T.LongType())])
        try:
            return self.spark.read.schema(schema).option("basePath", f"{self.root}/manifest").parquet(f"{self.root}/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def manifest(self, version: int) -> DataFrame:
        m = self._manifests()
        return self.spark.createDataFrame([], MANIFEST) if m is None else m.where(F.col("version") == version).drop("version")

    def last(self) -> int:
        """The number of the last version, 0 before the first."""
        m = self._manifests()
        return (m.agg(F.max("version")).first()[0] if m is not None else None) or 0

    def write(self, df: DataFrame) -> int:
        """Stores ``df`` as the next version and returns its number. ``df`` is read
        twice, for the digests and for the buckets that changed."""
        before = self.last()
        version = before + 1
        names = df.columns
        dealt = df.withColumn("bucket", F.pmod(_hash(as_list(self.key), 0), F.lit(self.buckets)).cast("int"))
        digests = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *[F.sum(_hash(names, s).cast("decimal(20,0)")).cast(SUM).alias(f"h{s}") for s in (1, 2)])
        old = self.manifest(before).select(F.col("bucket").alias("b"), F.col("n").alias("on"), F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("home").alias("was"))
        met = digests.join(old, F.col("bucket") == F.col("b"), "left")
        same = F.coalesce((F.col("n") == F.col("on")) & (F.col("h1") == F.col("o1")) & (F.col("h2") == F.col("o2")), F.lit(False))
        entries = met.select("bucket", "n", "h1", "h2", F.when(same, F.col("was")).otherwise(F.lit(version)).cast("long").alias("home")).collect()
        new = [e.bucket for e in entries if e.home == version]
        rows = dealt.where(F.col("bucket").isin(new)) if new else dealt.limit(0)
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/rows/version={version}")
        # An empty version has one bucket without rows, so that it is there.
        held = [tuple(e) for e in entries] or [(0, 0, None, None, version)]
        self.spark.createDataFrame(held, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/version={version}")
        return version

    def read(self, version: int, schema: T.StructType, buckets: Sequence[int] | None = None) -> DataFrame:
        """The rows of a version (of the given buckets). Folders are named from the
        manifest: no others are listed or read."""
        homes = self.manifest(version).where("n > 0").select("home", "bucket").collect()
        wanted = None if buckets is None else set(buckets)
        paths = [f"{self.root}/rows/version={h.home}/bucket={h.bucket}" for h in homes if wanted is None or h.bucket in wanted]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def differing(self, old: int, new: int) -> list[int]:
        """The buckets whose digests differ, from the manifests alone."""
        a, b = ({e.bucket: (e.n, e.h1, e.h2) for e in self.manifest(v).where("n > 0").collect()} for v in (old, new))
        return sorted(k for k in {*a, *b} if a.get(k) != b.get(k))

    def audit(self, old: int, new: int, schema: T.StructType, entity_type: str, entity_id: str | None = None) -> DataFrame:
        """A row for each inserted, updated or deleted row between two versions, as
        ``audit_changes`` takes them: action, entity_type, entity_id (the key,
        or the named column of it), old_values and new_values (JSON of the other
        columns, NULL where there is no row)."""
        key = as_list(self.key)
        buckets = self.differing(old, new)
        rest = [c for c in schema.names if c not in key]

        def side(version: int, name: str) -> DataFrame:
            rows = self.read(version, schema, buckets)
            body = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rest]), {"ignoreNullFields": "false"})
            return rows.select(*[F.col(f"`{c}`").alias(f"{name}_{i}") for i, c in enumerate(key)], _hash(rest, 1).alias(f"{name}_h"), body.alias(f"{name}_values"))

        on = F.lit(True)
        for i in range(len(key)):
            on = on & F.col(f"old_{i}").eqNullSafe(F.col(f"new_{i}"))
        met = side(old, "old").join(side(new, "new"), on, "full_outer")
        changed = met.where(F.col("old_values").isNull() | F.col("new_values").isNull() | ~F.col("old_h").eqNullSafe(F.col("new_h")))
        action = F.when(F.col("old_values").isNull(), "insert").when(F.col("new_values").isNull(), "delete").otherwise("update")
        at = key.index(entity_id) if entity_id else 0
        return changed.select(action.alias("action"), F.lit(entity_type).alias("entity_type"),
                              F.when(F.col("new_values").isNull(), F.col(f"old_{at}")).otherwise(F.col(f"new_{at}")).alias("entity_id"), "old_values", "new_values")
