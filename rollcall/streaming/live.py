"""Structured Streaming forms (O42-O45) and the stream side of O44/O45.

Event time must be TIMESTAMP (with zone) for watermarks; the driver's
tables hold TIMESTAMP_NTZ, so sources are cast with the session zone set to
UTC (``event_time``). Each builder returns a streaming DataFrame or starts a
query; the caller picks trigger, sink and checkpoint location (under the
shared checkpoint folder).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.common import as_list
from ..operators.logs import HEALTH_PATHS, RATE_LIMITS
from ..operators.registration import admit_checkins


def event_time(df: DataFrame, col: str) -> DataFrame:
    """Cast an NTZ column to TIMESTAMP so it can carry a watermark."""
    return df.withColumn(col, F.col(col).cast("timestamp"))


# O42 ---------------------------------------------------------------------
def checkin_stream(scans: DataFrame, visitors: DataFrame, delay: str = "1 day",
                   time_col: str = "scan_time", salt_buckets: int = 16) -> DataFrame:
    """Live admission, watermark form: one scan per visitor within the
    watermark is kept, the first that the stream sees (of scans in one
    micro-batch any of them; ``exact_admission_batch`` picks the earliest scan
    time). A late offline replay still counts if it arrives within ``delay``;
    an older one is dropped. Joined to the static visitor
    table (stream-static inner join: unknown visitors drop out). State per
    visitor is dropped once the watermark passes, so a repeat scan much
    later is not caught here; ``exact_admission_batch`` gives the all-time
    rule.

    Micro-batches run without AQE, so the de-duplication is salted: first
    per (visitor, request-id bucket), which spreads a visitor scanned very
    often over ``salt_buckets`` state tasks, then per visitor over at most
    ``salt_buckets`` survivors. Rows older than the watermark are dropped;
    Spark tests lateness against the previous micro-batch's watermark."""
    v = visitors.select("visitor_id", "event_id", "tenant_id")
    salted = scans.withColumn("_salt", F.abs(F.xxhash64("request_id")) % salt_buckets)
    return (salted.withWatermark(time_col, delay)
                  .dropDuplicatesWithinWatermark(["visitor_id", "_salt"])
                  .dropDuplicatesWithinWatermark(["visitor_id"])
                  .drop("_salt")
                  .join(v, "visitor_id", "inner"))


def exact_admission_batch(visitors: DataFrame, decisions_path: str, stream_id: str,
                          time_col: str = "scan_time"):
    """``foreachBatch`` handler for the exact rule: each micro-batch is
    admitted (O15) against every scan accepted so far; accepted rows are the
    stored check-ins. ``stream_id`` names the stream's checkpoint: batch ids
    count from 0 in each checkpoint, so (stream, batch) names a batch. Its
    decisions are one folder, written as a whole: a batch that is repeated after
    a failure is decided again without its own earlier decisions and replaces
    them, so nothing is admitted twice and nothing is left half-written."""

    def handle(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        own = (F.col("stream") == stream_id) & (F.col("batch") == batch_id)
        past = read_decisions(spark, decisions_path, batch.schema["visitor_id"].dataType.simpleString())
        touched = batch.select("visitor_id").distinct()
        stored = past.where((F.col("decision") == "accepted") & ~own).select("visitor_id") \
            .join(touched, "visitor_id", "left_semi")
        decided = admit_checkins(batch, visitors, stored, time_col=time_col)
        # Partitioned by decision: reading the accepted set skips all rejects.
        decided.write.mode("overwrite").partitionBy("decision").parquet(
            f"{decisions_path}/stream={stream_id}/batch={batch_id}")

    return handle


def read_decisions(spark: SparkSession, decisions_path: str, visitor_type: str = "bigint") -> DataFrame:
    """All decisions so far with stream and batch; none before the first batch.
    Only a missing folder counts as none: any other failure to read is raised."""
    try:
        found = spark.read.option("basePath", decisions_path).parquet(f"{decisions_path}/stream=*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"visitor_id {visitor_type}, stream string, batch long, decision string")
    return found.withColumns({"stream": F.col("stream").cast("string"), "batch": F.col("batch").cast("long")})


# O43 ---------------------------------------------------------------------
def live_counts(scans: DataFrame, window: str = "1 hour", delay: str = "1 day",
                time_col: str = "scan_time") -> DataFrame:
    """Check-ins per tumbling window and visitor: the stateful part of the live
    dashboard. Run in update mode it gives open windows as they stand; the
    watermark only bounds how long a window's state is kept."""
    return (scans.withWatermark(time_col, delay)
                 .groupBy(F.window(time_col, window).alias("w"), "visitor_id")
                 .agg(F.count(F.lit(1)).alias("n"))
                 .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "visitor_id", "n"))


def live_dashboard(counts: DataFrame, visitors: DataFrame,
                   by: Sequence[str] = ("event_id", "category_id")) -> DataFrame:
    """Check-in counts per window and ``by`` keys (visitor attributes) from the
    current ``live_counts``. The join to the visitors is outside the stream, on
    one row per visitor and window: a visitor scanned very often is one row,
    and Spark re-plans the join from measured sizes, which micro-batches do not."""
    by = as_list(by)
    v = visitors.select("visitor_id", *[c for c in by if c != "visitor_id"])
    return (counts.join(v, "visitor_id", "inner").groupBy("window_start", "window_end", *by)
                  .agg(F.sum("n").alias("checkins")))


def running_totals(scans: DataFrame, visitors: DataFrame,
                   by: Sequence[str] = ("event_id", "category_id")) -> DataFrame:
    """Running check-in counts per ``by`` (complete or update output mode)."""
    v = visitors.select("visitor_id", *[c for c in as_list(by) if c != "visitor_id"])
    return scans.join(v, "visitor_id", "inner").groupBy(*as_list(by)) \
        .agg(F.count(F.lit(1)).alias("checkins"))


# O44 ---------------------------------------------------------------------
def rate_limit_stream(log: DataFrame, key: str = "client", window: str = "15 minutes",
                      limits: Mapping[str, int] | None = None, delay: str = "15 minutes",
                      ts: str = "ts") -> DataFrame:
    """Stream form of O44. In update mode a window is reported from the moment it
    passes its limit; in append mode once the watermark closes it."""
    limits = dict(limits or RATE_LIMITS)
    pairs = []
    for route, n in limits.items():
        pairs += [F.lit(route), F.lit(n)]
    ceiling = F.create_map(*pairs)[F.col("route")]
    counted = (log.where(~F.col("path").isin(HEALTH_PATHS))
                  .withWatermark(ts, delay)
                  .groupBy(F.window(ts, window).alias("w"), key, "route")
                  .agg(F.count(F.lit(1)).alias("count")))
    return (counted.withColumn("limit", ceiling).where(F.col("count") > F.col("limit"))
                   .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                           key, "route", "count", "limit",
                           (F.col("count") - F.col("limit")).alias("blocked")))


# O45 ---------------------------------------------------------------------
#: States after which a payment no longer waits for its provider.
FINAL_STATES = ("success", "failed", "cancelled", "expired")


def _waiting(payments: DataFrame) -> DataFrame:
    return payments.where(F.col("status") == "pending").select("order_id", "tenant_id", "created_at")


def _settled(notices: DataFrame) -> DataFrame:
    return notices.where(F.col("payment_status").isin(*FINAL_STATES)).select(
        F.col("order_id").alias("n_order_id"), "received_at", "notice_id")


def _in_time(hours: int):
    return ((F.col("order_id") == F.col("n_order_id")) & (F.col("received_at") >= F.col("created_at"))
            & (F.col("received_at") <= F.col("created_at") + F.expr(f"INTERVAL {hours} HOURS")))


def payment_expiry_stream(payments: DataFrame, notices: DataFrame, hours: int = 24,
                          delay: str = "1 hour") -> DataFrame:
    """Pending payments that no notice with a final state settles within
    ``hours`` of creation (a notice that says 'pending' settles nothing): a
    stream-stream left outer join with watermarks on both sides and a
    time-range condition; the unmatched payment is emitted (as expired) once
    the watermark passes creation + ``hours``. What the watermark has not yet
    passed is ``payment_expiry_rest``'s."""
    p = _waiting(payments).withWatermark("created_at", delay)
    n = _settled(notices).withWatermark("received_at", delay)
    j = p.join(n, _in_time(hours), "leftOuter")
    return j.where(F.col("notice_id").isNull()).select(
        "order_id", "tenant_id", "created_at", F.lit("expired").alias("status"))


def payment_expiry_rest(payments: DataFrame, notices: DataFrame, emitted: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """The flush when a feed has ended: by the same rule, payments due at
    ``as_of`` that the stream has not emitted."""
    due = _waiting(payments).where(F.col("created_at") + F.expr(f"INTERVAL {hours} HOURS") <= as_of)
    due = due.join(emitted.select("order_id"), "order_id", "left_anti")
    return due.join(_settled(notices), _in_time(hours), "left_anti").select(
        "order_id", "tenant_id", "created_at", F.lit("expired").alias("status"))
