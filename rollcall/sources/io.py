"""Readers and writers.

Scratch and snapshot locations live under the session's shared folder
(``spark.checkpoint.dir``), never a machine-local temp folder, so every
executor and a restarted driver see the same files.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

CORRUPT = "_corrupt_record"

# Body of a scanner check-in request (online and replayed offline form).
CHECKIN_REQUEST_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("qr_data", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("scanned_by", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()),
])

# One line of the JSON request log.
REQUEST_LOG_SCHEMA = T.StructType([
    T.StructField("method", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("duration", T.StringType()),
    T.StructField("ip", T.StringType()),
    T.StructField("userAgent", T.StringType()),
    T.StructField("tenantId", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()),
])


# Notice bodies of the two payment providers.
FIRST_PROVIDER_NOTICE_SCHEMA = T.StructType([
    T.StructField(n, T.StringType()) for n in
    ("order_id", "transaction_status", "fraud_status", "gross_amount",
     "custom_field1", "custom_field2", "custom_field3")])

SECOND_PROVIDER_NOTICE_SCHEMA = T.StructType([
    T.StructField("external_id", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("metadata", T.StructType([
        T.StructField("tenant_id", T.StringType()),
        T.StructField("plan_id", T.StringType()),
        T.StructField("billing_period", T.StringType())])),
    T.StructField("id", T.StringType()),
])


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return "/".join([root, "rollcall", *parts, uuid.uuid4().hex])


# O02 ---------------------------------------------------------------------
def read_json_events(spark: SparkSession, path: str, schema: T.StructType,
                     streaming: bool = False, max_files_per_trigger: int | None = None) -> DataFrame:
    """JSON lines with a declared schema. Malformed lines are kept aside in
    ``_corrupt_record`` (NULL for good lines) instead of failing the job."""
    full = T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType())])
    reader = spark.readStream if streaming else spark.read
    reader = (reader.schema(full).option("mode", "PERMISSIVE")
                    .option("columnNameOfCorruptRecord", CORRUPT)
                    .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"))
    if streaming and max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.json(path)


def split_valid(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows without the corrupt column, malformed rows).

    Spark refuses a query on a raw JSON scan whose only referenced column is
    the corrupt-record column (e.g. ``bad.count()``); the malformed-row
    filter therefore also reads the first schema column through a term that
    is always true (``length(coalesce(first, '')) >= 0``), which the
    optimizer does not fold away."""
    bad = F.col(CORRUPT).isNotNull()
    first = next(c for c in events.columns if c != CORRUPT)
    with_field = bad & (F.length(F.coalesce(F.col(first).cast("string"), F.lit(""))) >= 0)
    return events.where(~bad).drop(CORRUPT), events.where(with_field)


def duration_ms(col: str = "duration"):
    """'12ms' -> 12.0; anything else -> NULL."""
    return F.regexp_extract(F.col(col), r"^([0-9]+(?:\.[0-9]+)?)ms$", 1).try_cast("double")


# O04 ---------------------------------------------------------------------
def export_csv(df: DataFrame, path: str, partition_by=None, header: bool = True) -> str:
    """Report export as CSV with a header row, optionally one folder per
    partition value; written by the executors in parallel."""
    w = df.write.mode("overwrite").option("header", header)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.csv(path)
    return path


# O05 ---------------------------------------------------------------------
class DuplicateKeyError(ValueError):
    pass


def refresh_snapshot(df: DataFrame, root: str, key, partition_by=None) -> str:
    """Rebuild a snapshot and swap it in whole.

    The new version is written to its own folder; its key is checked for
    uniqueness on the written files (a distributed count; only the verdict
    reaches the driver); only then is it published by appending one pointer
    row whose name sorts after every earlier one: versions are numbered from
    the published pointers, not by a driver's clock. Pointers are never
    rewritten, so a reader sees either the old or the new version, never a
    half-written one, and older versions stay readable. A duplicate key
    leaves the old version current.
    """
    spark = df.sparkSession
    version = f"v-{_last_number(spark, root) + 1:020d}-{uuid.uuid4().hex[:8]}"
    target = f"{root.rstrip('/')}/{version}"
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.parquet(target)
    keys = [key] if isinstance(key, str) else list(key)
    dupes = (spark.read.parquet(target).groupBy(*keys).count()
             .where(F.col("count") > 1).limit(1).count())
    if dupes:
        raise DuplicateKeyError(f"snapshot key {keys} is not unique; {target} not published")
    (spark.createDataFrame([(version,)], "version string").coalesce(1)
          .write.mode("append").text(f"{root.rstrip('/')}/pointers"))
    return target


def _last_number(spark: SparkSession, root: str) -> int:
    """Number of the latest published version; 0 before the first."""
    try:
        last = snapshot_versions(spark, root).agg(F.max("version")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0
    return int(last.split("-")[1]) if last else 0


def snapshot_versions(spark: SparkSession, root: str) -> DataFrame:
    """Published versions, oldest first (one row per refresh)."""
    return spark.read.text(f"{root.rstrip('/')}/pointers") \
        .select(F.col("value").alias("version")).orderBy("version")


def current_snapshot(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """Read the latest published version (or a given earlier one)."""
    if version is None:
        version = snapshot_versions(spark, root).agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{root.rstrip('/')}/{version}")
