"""Request logs, scanner counters and audit trails."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import percent_whole
from ..sources.io import scratch_path
from .common import as_list, percentile_exact

# The proxy's access-log line layout
#   $remote_addr - $remote_user [$time_local] "$request" $status $body_bytes_sent
#   "$http_referer" "$http_user_agent" "$http_x_forwarded_for" rt=$request_time
#   uct="$upstream_connect_time" uht="$upstream_header_time" urt="$upstream_response_time"
ACCESS_LOG_RE = (r'^(\S+) - (\S+) \[([^\]]+)\] "([^"]*)" (\d{3}) (\d+|-) "([^"]*)" "([^"]*)" '
                 r'"([^"]*)" rt=([0-9.]+) uct="([^"]*)" uht="([^"]*)" urt="([^"]*)"')
ACCESS_LOG_TIME = "dd/MMM/yyyy:HH:mm:ss"

# Service targets (mean < 100 ms, p95 < 200 ms, errors < 0.1 %),
# slow request threshold 1 s.
MEAN_TARGET_MS = 100.0
TARGET_MS = 200.0
ERROR_TARGET = 0.001
SLOW_MS = 1000.0

# Rate-limit windows and ceilings per route; health checks skipped.
RATE_WINDOW = "15 minutes"
RATE_LIMITS = {"auth": 5, "register": 10, "other": 100}
HEALTH_PATHS = ["/health", "/api/health"]


# O03 ---------------------------------------------------------------------
def parse_access_log(lines: DataFrame, col: str = "value") -> DataFrame:
    """Split proxy access-log lines into fields; lines that do not match
    keep ``parsed = false`` and NULL fields."""
    v = F.col(col)
    # One regex pass rewrites a matching line into its 13 groups joined by a
    # separator that cannot occur in a log line; split gives them all. The
    # pass sits in its own projection so it runs once per line (inside a
    # CASE branch Catalyst would not share it between the 13 fields).
    sep = "\u0001"
    split = lines.select(
        v.alias("line"), v.rlike(ACCESS_LOG_RE).alias("parsed"),
        F.split(F.regexp_replace(v, ACCESS_LOG_RE, sep.join(f"${i}" for i in range(1, 14))),
                sep).alias("_g"))

    def g(i: int):
        return F.when(F.col("parsed"), F.nullif(F.element_at("_g", i), F.lit("")))

    req = g(4)
    return split.select(
        "line", "parsed",
        g(1).alias("remote_addr"),
        F.nullif(g(2), F.lit("-")).alias("remote_user"),
        F.to_timestamp_ntz(F.substring_index(g(3), " ", 1), F.lit(ACCESS_LOG_TIME)).alias("time"),
        F.substring_index(g(3), " ", -1).alias("tz_offset"),
        F.split_part(req, F.lit(" "), F.lit(1)).alias("method"),
        F.split_part(req, F.lit(" "), F.lit(2)).alias("uri"),
        g(5).cast("int").alias("status"),
        F.nullif(g(6), F.lit("-")).cast("long").alias("body_bytes"),
        g(10).cast("double").alias("request_time"),
        F.nullif(g(13), F.lit("-")).try_cast("double").alias("upstream_response_time"),
    )


# O25 ---------------------------------------------------------------------
def request_kpis(log: DataFrame, by: Sequence[str] | str = ("route",),
                 duration: str = "duration_ms", approx: bool = False) -> DataFrame:
    """Requests, error share, mean and p95 duration, share under the p95
    target and share over the slow threshold, per ``by``, with a pass flag
    for each service target (mean, p95, error rate).

    The log is read once: it is counted per (key, duration) with map-side
    aggregation and written, and counts, mean and shares come from that table,
    as does the exact p95 (``percentile_exact``), which runs over pieces of the
    distinct durations, so a route carrying most of the traffic is spread over
    many tasks. ``approx=True`` uses a fixed-size sketch instead."""
    by = as_list(by)
    d = F.col(duration)
    if approx:
        p = F.percentile_approx(d, 0.95, 10000)
        rows = log.withColumn("_n", F.lit(1).cast("long")).withColumn("_errors", (F.col("status") >= 500).cast("long"))
        return rows.groupBy(*by).agg(*_kpis(d), F.round(p, 6).alias("p95_ms"), (p < TARGET_MS).alias("p95_ok"))
    path = scratch_path(log.sparkSession, "durations")
    cells = log.groupBy(*by, duration).agg(F.count(F.lit(1)).alias("_n"), F.count(F.when(F.col("status") >= 500, 1)).alias("_errors"))
    cells.write.parquet(path)
    cells = log.sparkSession.read.schema(cells.schema).parquet(path)
    p95 = percentile_exact(cells, by, duration, 0.95, out="_p95", weight="_n")
    return (cells.groupBy(*by).agg(*_kpis(d)).join(p95, by, "left")
               .withColumn("p95_ms", F.round("_p95", 6))
               .withColumn("p95_ok", F.col("_p95") < TARGET_MS).drop("_p95"))


def _kpis(d: Column) -> list[Column]:
    """From rows that stand for ``_n`` requests of one duration, ``_errors`` of them failed."""
    n, errors = F.sum("_n"), F.coalesce(F.sum("_errors"), F.lit(0))
    timed = F.sum(F.when(d.isNotNull(), F.col("_n")))
    mean = F.sum(d * F.col("_n")) / timed

    def share(cond: Column) -> Column:
        return F.round(F.coalesce(F.sum(F.when(cond, F.col("_n"))), F.lit(0)) / n, 6)

    return [n.alias("requests"), errors.alias("errors"), F.round(errors / n, 6).alias("error_rate"),
            F.round(mean, 6).alias("avg_ms"), share(d < TARGET_MS).alias("under_target_share"),
            share(d > SLOW_MS).alias("slow_share"), (mean < MEAN_TARGET_MS).alias("mean_ok"), (errors / n < ERROR_TARGET).alias("errors_ok")]


# O26 ---------------------------------------------------------------------
def scanner_stats(scans: DataFrame, by: Sequence[str] | str = ("scanner",)) -> DataFrame:
    """Total scans, successful ones, success percent (whole number, 0 when
    none) and last scan time. Failed scans count in the total."""
    by = as_list(by)
    return (scans.groupBy(*by)
                 .agg(F.count(F.lit(1)).alias("total_scans"),
                      F.count_if(F.col("ok")).alias("successful_scans"),
                      F.max("ts").alias("last_scan"))
                 .withColumn("success_rate", percent_whole("successful_scans", "total_scans")))


# O38 ---------------------------------------------------------------------
def audit_changes(activity: DataFrame, old: str = "old_values", new: str = "new_values",
                  keep: Sequence[str] = ("action", "entity_type", "entity_id")) -> DataFrame:
    """One row per field whose value differs between the old and new JSON
    objects: added (old missing), removed (new missing) or changed. Values
    are compared as JSON text; NULL to NULL is no change."""
    m = "map<string,string>"
    o = F.coalesce(F.from_json(F.col(old), m), F.create_map().cast(m))
    nw = F.coalesce(F.from_json(F.col(new), m), F.create_map().cast(m))
    fields = F.array_distinct(F.concat(F.map_keys(o), F.map_keys(nw)))
    rows = activity.select(*keep, o.alias("_o"), nw.alias("_n"), F.explode(fields).alias("field"))
    ov = F.col("_o")[F.col("field")]
    nv = F.col("_n")[F.col("field")]
    has_o = F.map_contains_key("_o", F.col("field"))
    has_n = F.map_contains_key("_n", F.col("field"))
    kind = F.when(~has_o, "added").when(~has_n, "removed").otherwise("changed")
    return (rows.where(~ov.eqNullSafe(nv) | (has_o != has_n))
                .select(*keep, "field", ov.alias("old_value"), nv.alias("new_value"),
                        kind.alias("change")))


def audit_counts(changes: DataFrame, by: Sequence[str] = ("action", "entity_type")) -> DataFrame:
    return changes.groupBy(*by, "change").agg(F.count(F.lit(1)).alias("changes"),
                                             F.count_distinct("entity_id").alias("entities"))


# O44 ---------------------------------------------------------------------
def rate_limit_hits(log: DataFrame, key: str = "client", window: str = RATE_WINDOW,
                    limits: Mapping[str, int] | None = None, ts: str = "ts") -> DataFrame:
    """Keys over their route's ceiling per fixed (epoch-aligned) window.
    ``count`` is all requests in the window; ``blocked`` the ones past the
    ceiling. Health checks are not counted."""
    limits = dict(limits or RATE_LIMITS)
    pairs = []
    for route, n in limits.items():
        pairs += [F.lit(route), F.lit(n)]
    ceiling = F.create_map(*pairs)[F.col("route")]
    counted = (log.where(~F.col("path").isin(HEALTH_PATHS))
                  .groupBy(F.window(ts, window).alias("w"), key, "route")
                  .agg(F.count(F.lit(1)).alias("count")))
    return (counted.withColumn("limit", ceiling)
                   .where(F.col("count") > F.col("limit"))
                   .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                           key, "route", "count", "limit",
                           (F.col("count") - F.col("limit")).alias("blocked")))
